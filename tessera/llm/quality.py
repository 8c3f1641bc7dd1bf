"""Quality rules: counts of the text itself, and perplexity bands of each language."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import _words as W
from tessera.llm._rows import others, whole
from tessera.llm.perplexity import COUNTED, UNIT, by_language, counted, fitted, text_grams
from tessera.plans.tables import saved

#: A document with fewer words fails, as does one with a larger share of repeated words (percent).
MIN_WORDS, MAX_REPEATED = 50, 50
#: A band's reach on a side of the median, in distances from it to the quantile at BAND_QUANTILE on that side, and the least reach on either side in nats.
BAND_WIDTH, BAND_QUANTILE, LEAST_REACH = 4.0, 0.1, 0.1
#: Characters of a passage; a document's score is that of its median passage.
PASSAGE = 128
#: Bytes of text of a batch. Each batch asks once for every n-gram that it holds.
BATCH_BYTES = 24 << 20
#: Bytes that a task packs at a time.
PACK_BYTES = 8 << 20

_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def quality(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", whole_rows: bool = False, batch_bytes: int = BATCH_BYTES
) -> DataFrame:
    """Judges documents by rules on their words and by n-gram perplexity in their language.

    Returns per input row: ``id_col long``; ``n_words``, ``word_chars`` (code points in
    words), ``n_symbols`` (characters of ``#*$%&|<>``), ``n_dup_lines`` (lines with a word
    that equal an earlier line), ``n_repeat_words`` (words in three-word windows that the
    text holds twice or more), all long; ``base_failed boolean`` (fewer than 50 words, or
    more than half of them repeated); ``kept boolean``; ``language string``;
    ``log_perplexity double`` (nats per character, null without characters) and
    ``passage_perplexity double`` (that of the median passage, to thousandths).  With
    ``whole_rows`` also ``row``, a struct of all columns of the input row.

    Method: documents are dealt into batches of about ``batch_bytes`` of text, which
    travel as compressed Arrow streams.  Each batch counts its n-grams of four code points by language;
    Spark sums the counts and fits a modified Kneser-Ney model of each language
    (``perplexity.fitted``), a table that grows with the corpus.  Each batch gets the entries
    of its own n-grams by a join on language and n-gram, as two arrays sorted by hash, and
    finds them by binary search.  A document's score is the log-perplexity of its median
    passage of 128 characters (the lower one of two), so that prose with passages in another
    language stays while a text that is mostly noise, or mostly in another language, goes.  A
    language's band runs from its median to four times the distance of its lower or upper decile,
    and at least 0.1 nats either way; its quantiles come from exact counts of scores in
    thousandths, over documents that pass the rules on words.  Documents whose score is
    outside the band are rejected.

    Null language: its own group, ``und``.  Null and empty texts have no words and fail.
    Ids need not be unique or non-null; every row is judged by itself.  An empty table gives
    no rows; other columns are carried, if asked for, and otherwise not read.
    """
    text, key = F.col(text_col).cast("string"), F.col(id_col).cast("long")
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    batches = max(1, -(-total // batch_bytes))
    dealt = docs.select(
        F.pmod(F.when(key.isNull(), F.xxhash64(text)).otherwise(F.xxhash64(key)), F.lit(batches)).cast("long").alias("batch"),
        key.alias("doc_id"),
        text.alias("text"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("language"),
        F.xxhash64(text).alias("content"),
        *([others(docs, text_col)] if whole_rows else []),
    )
    streams = dealt.mapInArrow(_packed, "batch long, stream binary").repartition(batches, "batch")
    grouped = streams.groupBy("batch")

    counts = saved(grouped.applyInArrow(_counted, ", ".join(f"{c} {'long' if t == pa.int64() else 'string'}" for c, t in COUNTED)), "zstd")
    model = fitted(counts)
    asked = counts.select("batch", "language", "gram", "hash").join(model, ["language", "gram"]).select("batch", "language", "hash", "cost")

    schema = T.StructType.fromDDL("doc_id long, language string, " + ", ".join(f"{c} long" for c in _BASE) + ", thousandths long, log_perplexity double")
    if whole_rows:
        schema = schema.add("text", "string").add("row", dealt.schema["row"].dataType)
    judged = grouped.cogroup(asked.groupBy("batch")).applyInArrow(_judge, schema)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    judged = saved(judged.withColumn("base_failed", failed), "zstd")
    bands = _bands(judged.filter(~F.col("base_failed") & F.col("thousandths").isNotNull()))
    inside = F.col("thousandths").between(F.col("low"), F.col("high"))
    return judged.join(bands, "language", "left").select(
        F.col("doc_id").alias(id_col),
        *_BASE,
        "base_failed",
        (~F.col("base_failed") & F.coalesce(inside, F.lit(True))).alias("kept"),
        "language",
        "log_perplexity",
        (F.col("thousandths") / 1000).alias("passage_perplexity"),
        *([whole(docs, text_col)] if whole_rows else []),
    )


def _bands(judged: DataFrame) -> DataFrame:
    """For each language the lowest and highest log-perplexity that passes, in thousandths of a nat."""
    counts = judged.groupBy("language", "thousandths").agg(F.count("*").alias("n"))
    rising = Window.partitionBy("language").orderBy("thousandths")
    ranked = counts.withColumns({"upto": F.sum("n").over(rising), "total": F.sum("n").over(Window.partitionBy("language"))})

    def quantile(q: float):
        return F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("thousandths")))

    found = ranked.groupBy("language").agg(quantile(BAND_QUANTILE).alias("q_low"), quantile(0.5).alias("q_mid"), quantile(1 - BAND_QUANTILE).alias("q_high"))
    return found.select(
        "language",
        (F.col("q_mid") - F.greatest(F.lit(1000 * LEAST_REACH), BAND_WIDTH * (F.col("q_mid") - F.col("q_low")))).alias("low"),
        (F.col("q_mid") + F.greatest(F.lit(1000 * LEAST_REACH), BAND_WIDTH * (F.col("q_high") - F.col("q_mid")))).alias("high"),
    )


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each batch as compressed Arrow streams of bounded size."""
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))

    def flushed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        of = rows.column("batch").to_numpy()
        for batch in np.unique(of):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=options) as stream:
                stream.write_table(rows.filter(pa.array(of == batch)).combine_chunks())
            yield pa.RecordBatch.from_pydict({"batch": pa.array([int(batch)]), "stream": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    held: list[pa.RecordBatch] = []
    for batch in batches:
        for part in W.slices(batch):
            held.append(part)
            if sum(h.nbytes for h in held) > PACK_BYTES:
                yield from flushed(held)
                held = []
    if held:
        yield from flushed(held)


def _unpacked(streams: pa.Table) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(s.as_buffer()).read_all() for s in streams.column("stream")])


def _counted(streams: pa.Table) -> pa.Table:
    found = counted(_unpacked(streams))
    _give_back()
    return found


def _give_back() -> None:
    """Returns freed memory to the system, since idle workers keep it from the JVM beside them; a no-op where the C library has no such call."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _judge(streams: pa.Table, model: pa.Table) -> pa.Table:
    _give_back()
    out = []
    table = _unpacked(streams)
    for language, texts in by_language(table):
        entries = model.filter(pa.compute.equal(model.column("language"), language))
        hashes = entries.column("hash").to_numpy().view(np.uint64)
        order = np.argsort(hashes)
        hashes, costs = hashes[order], entries.column("cost").to_numpy()[order]
        for part in texts:
            words = W.batch_words(part)
            whole, middle, n = _surprise(part, hashes, costs)
            known = n > 0
            columns = {"doc_id": part.column("doc_id"), "language": part.column("language"), "n_words": words.counts}
            columns |= _base(words)
            columns["thousandths"] = pa.array(np.round(1000 * middle).astype(np.int64), mask=~known)
            columns["log_perplexity"] = pa.array(whole, mask=~known)
            if "row" in table.column_names:
                columns |= {"text": part.column("text"), "row": part.column("row")}
            out.append(pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v, pa.int64()) for k, v in columns.items()}))
    del table, model, streams
    _give_back()
    return pa.Table.from_batches(out)


def _surprise(part: pa.RecordBatch, hashes: np.ndarray, costs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text -log p per character, in all and of its median passage, and its number of characters."""
    grams, at, _ = text_grams(part.column("text").to_pylist())
    n = np.diff(at)
    if not len(grams):
        return np.zeros(len(n)), np.zeros(len(n)), n
    sums = np.zeros(len(grams) + 1, np.int64)
    np.cumsum(costs[np.searchsorted(hashes, grams)], out=sums[1:])
    pieces = np.where(n > 0, np.maximum(1, n // PASSAGE), 0)  # the last piece takes what is left over
    first = np.zeros(len(n) + 1, np.int64)
    np.cumsum(pieces, out=first[1:])
    of = np.repeat(np.arange(len(n)), pieces)
    start = at[of] + PASSAGE * (np.arange(first[-1]) - first[of])
    end = np.r_[start[1:], at[-1]]
    per = (sums[end] - sums[start]) / (end - start) / UNIT
    ranked = per[np.lexsort((per, of))]
    middle = np.zeros(len(n))
    middle[n > 0] = ranked[(first[:-1] + np.maximum(pieces - 1, 0) // 2)[n > 0]]
    return (sums[at[1:]] - sums[at[:-1]]) / np.maximum(n, 1) / UNIT, middle, n


def _per_text(at: np.ndarray, marks: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(marks) + 1, np.int64)
    np.cumsum(marks, out=sums[1:])
    return np.diff(sums[at])


def _base(words: W.Words) -> dict[str, np.ndarray]:
    data, texts = words.data, words.texts()
    letters = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=letters[1:])
    chars = _per_text(words.first, letters[words.end] - letters[words.start])

    codes, starts = words.interned()[0], words.window_starts(3)
    window = texts[starts]
    for k in range(3):
        window = W.joint(window, codes[starts + k])
    again = starts[np.bincount(window, minlength=1)[window] > 1] if len(starts) else starts
    covered = np.zeros(len(words.start), bool)
    for k in range(3):
        covered[again + k] = True

    breaks = np.flatnonzero(data == 0x0A)
    line_start = np.union1d(words.text_at[:-1][np.diff(words.text_at) > 0], breaks + 1)
    line_start = line_start[line_start < len(data)]
    next_break = np.append(breaks, len(data))[np.searchsorted(breaks, line_start)]
    owner = np.searchsorted(words.text_at, line_start, "right") - 1
    line_end = np.minimum(next_break, words.text_at[owner + 1])
    worded = np.searchsorted(words.start, line_end) > np.searchsorted(words.start, line_start)
    line_start, line_end, owner = line_start[worded], line_end[worded], owner[worded]
    line = W.joint(owner, W.equal_ranges(data, line_start, line_end)[0])
    later = np.ones(len(line), bool)
    later[np.unique(line, return_index=True)[1]] = False
    return {
        "word_chars": chars,
        "n_symbols": _per_text(words.text_at, _SYMBOL[data]),
        "n_dup_lines": np.bincount(owner[later], minlength=len(words.first) - 1),
        "n_repeat_words": _per_text(words.first, covered),
    }
