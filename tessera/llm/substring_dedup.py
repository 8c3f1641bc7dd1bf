"""Substring deduplication by level-wise doubling of repeated word windows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import _words as W
from tessera.llm._rows import others, whole

#: Bytes of text of a batch, and batches to a partition.
BATCH_BYTES, BATCHES_TO_PARTITION = 8 << 20, 2
#: Windows are doubled from the first length at or above this.
SHORTEST = 12
_NO_ID = np.iinfo(np.int64).max


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 50, with_text: bool = True, whole_rows: bool = False
) -> DataFrame:
    """Removes words that an earlier document already has within a window of ``size`` words.

    A word goes if some window of ``size`` consecutive words of its document covers it and
    the same words also start in a document with a smaller id.  Windows are those of the
    input, not of what is left.  Words are maximal runs of bytes other than 0x20 and
    0x09-0x0D, unchanged.

    Returns one row per input row: ``id_col long, n_words long, n_removed long, kept_sha256
    string`` (of the kept words joined by one space) and, if asked for, ``kept_text``: the
    text without the removed words and the white space that follows them.  With
    ``whole_rows`` also ``row``, a struct of all columns of the input row.

    Method: level-wise doubling, here 13, 25 and 50 words.  Documents are dealt into batches
    by a hash.  At each length the shorter window with the smallest hash stands for every
    full window around it (equal windows pick equal ones), which leaves one position in
    about twenty at first.  Those that occur in two documents survive, and only full windows
    around a survivor are extended to twice the length and compared again, up to the full
    length; a batch in which none survives has nothing more to do.  The text shuffles once,
    and that exchange serves all levels.  A batch sends one row per distinct key, so a
    passage that a third of all documents share gives one row per batch and not per document.

    Windows are known by two polynomials modulo 2**61 - 1 in numbers mixed from all bytes of
    their words, or from 120-bit digests of words of 16 bytes and more.  Two different windows
    of 50 words agree with a chance of about 2**-110, which for 10**13 windows is one false
    match in 10**7 corpora.

    Null text: no words.  Texts shorter than ``size`` words keep everything.  A null id
    counts as larger than every other.  Rows that share an id never remove each other's
    words, and each keeps its own text.  An empty table gives no rows; other columns are
    carried, if asked for, and otherwise not read.
    """
    text, key = F.col(text_col).cast("string"), F.col(id_col).cast("long")
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    batches = max(1, -(-total // BATCH_BYTES))
    dealt = docs.select(
        F.pmod(F.when(key.isNull(), F.xxhash64(text)).otherwise(F.xxhash64(key)), F.lit(batches)).cast("long").alias("batch"),
        key.alias("id"),
        text.alias("text"),
        *([others(docs, text_col)] if whole_rows else []),
    ).repartition(max(1, -(-batches // BATCHES_TO_PARTITION)), "batch")
    grouped = dealt.groupBy("batch")

    survivors, shorter = None, 0
    for length in lengths(size):
        schema = "batch long, a long, b long, low long, high long"
        if survivors is None:
            found = grouped.applyInArrow(_levels(size, length), schema)
        else:
            found = grouped.cogroup(survivors.groupBy("batch")).applyInArrow(_levels(size, length, shorter), schema)
        by_key = Window.partitionBy("a", "b")
        if length < size:
            shared = found.withColumns({"first": F.min("low").over(by_key), "last": F.max("high").over(by_key)}).filter("first < last").select("batch", "a", "b")
        else:
            shared = found.withColumn("first", F.min("low").over(by_key)).filter("first < high").select("batch", "a", "b", "first")
        survivors, shorter = shared, length

    schema = T.StructType.fromDDL("id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
    if whole_rows:
        schema = schema.add("text", "string").add("row", dealt.schema["row"].dataType)
    kept = grouped.cogroup(survivors.groupBy("batch")).applyInArrow(lambda t, seen: _kept(t, seen, size, with_text), schema)
    if not whole_rows:
        return kept.withColumnRenamed("id", id_col)
    return kept.select(F.col("id").alias(id_col), "n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text, whole(docs, text_col))


def lengths(size: int) -> list[int]:
    """The lengths of the levels: each at most twice the one before, the last the full size."""
    found = [size]
    while -(-found[0] // 2) >= SHORTEST:
        found.insert(0, -(-found[0] // 2))
    return found


def _ids(table: pa.Table) -> np.ndarray:
    return table.column("id").fill_null(_NO_ID).to_numpy()


def _words(table: pa.Table) -> W.Words:
    return W.find_words(*W.text_bytes(table.column("text").combine_chunks()))


def _stands(values: np.ndarray, starts: np.ndarray, size: int, length: int) -> np.ndarray:
    """For each full window that starts at these words, where the window of this length starts that stands for it: the one whose words' sum mixes to the least."""
    if length == size or not len(starts):
        return starts
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(W.mix(values), out=sums[1:])
    return W.sliding_minimum_at(W.mix(sums[length:] - sums[:-length]), size - length + 1)[starts]


def _levels(size: int, length: int, shorter: int | None = None) -> Callable[..., pa.Table]:
    if shorter is None:
        return lambda table: _level(table, None, size, length, 0)
    return lambda table, keys: _level(table, keys, size, length, shorter)


def _level(table: pa.Table, shared: pa.Table | None, size: int, length: int, shorter: int) -> pa.Table:
    """The keys at this length of all full windows, or of those around a shared key of the level before."""
    words = _words(table)
    starts = words.window_starts(size)
    none = np.empty(0, np.int64)
    if not len(starts) or (shared is not None and not shared.num_rows):
        return _by_key(table, none.view(np.uint64), none.view(np.uint64), none)
    values = words.values()
    if shared is not None:
        at, window = np.unique(_stands(values[0], starts, size, shorter), return_inverse=True)
        starts = starts[(_places(*_sorted(shared)[:2], *_keys(values, at, shorter)) >= 0)[window]]
    chosen = np.unique(_stands(values[0], starts, size, length))
    return _by_key(table, *_keys(values, chosen, length), _ids(table)[words.texts()[chosen]])


def _keys(values: tuple[np.ndarray, np.ndarray], at: np.ndarray, length: int) -> list[np.ndarray]:
    """The two halves of the keys of the windows that start at these words."""
    return [W.hashes_at(v, at, length, base) for v, base in zip(values, W.BASES, strict=True)]


def _by_key(table: pa.Table, a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> pa.Table:
    """A row for each distinct key, with the smallest and largest id that has it."""
    order = np.lexsort((b, a))
    a, b, ids = a[order], b[order], ids[order]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.empty(0, np.int64)
    low, high = (f.reduceat(ids, first) if len(first) else ids for f in (np.minimum, np.maximum))
    batch = table.column("batch")[0].as_py() if table.num_rows else 0
    return pa.table({"batch": np.full(len(first), batch, np.int64), "a": a[first].view(np.int64), "b": b[first].view(np.int64), "low": low, "high": high})


def _sorted(shared: pa.Table) -> list[np.ndarray]:
    """The columns of the keys, and whatever comes with them, by rising first key."""
    a = shared.column("a").to_numpy().view(np.uint64)
    order = np.argsort(a)
    return [a[order], shared.column("b").to_numpy().view(np.uint64)[order], *(shared.column(c).to_numpy()[order] for c in shared.column_names[3:])]


def _known(sorted_: np.ndarray, values: np.ndarray) -> np.ndarray:
    return sorted_[np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)] == values


def _places(keys_a: np.ndarray, keys_b: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where each pair (a, b) stands among the keys, which rise by their first half; -1: nowhere."""
    if not len(keys_a):
        return np.full(len(a), -1)
    at = np.searchsorted(keys_a, a)
    last = len(keys_a) - 1
    while True:  # one round, unless two keys agree in their first half
        here = np.minimum(at, last)
        next_ = (at <= last) & (keys_a[here] == a) & (keys_b[here] != b)
        if not next_.any():
            return np.where((at <= last) & (keys_a[here] == a), here, -1)
        at = at + next_


def _kept(table: pa.Table, seen: pa.Table, size: int, with_text: bool) -> pa.Table:
    words, ids = _words(table), _ids(table)
    starts = words.window_starts(size) if seen.num_rows else np.empty(0, np.int64)
    gone = starts
    if len(starts):
        keys_a, keys_b, first = _sorted(seen)
        values = words.values()
        starts = starts[_known(keys_a, W.hashes_at(values[0], starts, size, W.BASES[0]))]
        at = _places(keys_a, keys_b, *_keys(values, starts, size))
        gone = starts[(at >= 0) & (ids[words.texts()[starts]] > first[at])]
    edge = np.zeros(len(words.start) + 1, np.int64)
    np.add.at(edge, gone, 1)
    np.add.at(edge, gone + size, -1)
    keep = np.cumsum(edge)[:-1] == 0
    joined, ends = joined_words(words, keep)
    before = np.r_[0, np.cumsum(keep)][words.first]
    removed = words.counts - np.diff(before)
    view = memoryview(joined)
    sums = [hashlib.sha256(view[ends[a] : max(ends[a], ends[b] - 1)]).hexdigest() for a, b in zip(before[:-1], before[1:], strict=True)]
    columns = {"id": table.column("id"), "n_words": words.counts, "n_removed": removed, "kept_sha256": pa.array(sums, pa.string())}
    if with_text:
        columns["kept_text"] = pa.array(_cut(table, words, keep, removed), pa.string())
    if "row" in table.column_names:
        columns |= {"text": table.column("text"), "row": table.column("row")}
    return pa.table(columns)


def joined_words(words: W.Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept words, each followed by a space, and where each begins (one more entry at the end)."""
    start, length = words.start[keep], words.end[keep] - words.start[keep] + 1
    ends = np.zeros(len(start) + 1, np.int64)
    np.cumsum(length, out=ends[1:])
    source = np.repeat(start - ends[:-1], length) + np.arange(ends[-1])
    joined = np.append(words.data, np.uint8(32))[source]
    joined[ends[1:] - 1] = 32
    return joined, ends


def _cut(table: pa.Table, words: W.Words, keep: np.ndarray, removed: np.ndarray) -> list[str | None]:
    texts = table.column("text").to_pylist()
    for i in np.flatnonzero(removed):
        a, b, at = words.first[i], words.first[i + 1], words.text_at[i]
        raw, base = words.data[at : words.text_at[i + 1]], at
        nexts = np.append(words.start[a + 1 : b], words.text_at[i + 1]) - base
        mask = np.ones(len(raw) + 1, np.int64)
        edge = np.zeros(len(raw) + 1, np.int64)
        gone = ~keep[a:b]
        np.add.at(edge, words.start[a:b][gone] - base, 1)
        np.add.at(edge, nexts[gone], -1)
        mask = np.cumsum(edge)[:-1] == 0
        texts[i] = raw[mask].tobytes().decode("utf-8")
    return texts
