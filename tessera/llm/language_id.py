"""Language identification by Bayesian fusion of several kinds of evidence."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (as pa.compute)
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _words as W
from tessera.llm._ngrams import GRAMS, SYMBOLS, count_grams, symbol_grams, text_grams
from tessera.operators.mesh import dense_ids
from tessera.plans.tables import saved

#: Log-likelihoods in units of 2**-16 nats: sums do not depend on their order.
UNIT = 1 << 16
#: Characters that count as independent evidence: the text's likelihood is tempered to so many at most.
EFFECTIVE = 50
#: Chance that declared markup, or an address suffix, names the language of the text.
TRUST = {"declared": 0.9, "suffix": 0.7}
#: Weight, in documents, of the level above in a host's prior.
PRIOR_WEIGHT = 5.0
#: Pseudo-count of a gram in a language.
ALPHA = 0.5
#: Text of a batch, whose n-grams are asked for together.
BATCH_BYTES = 32 << 20
#: Country suffixes and the language they suggest (fixed values).
SUFFIXES = {"at": "de", "ch": "de", "de": "de", "es": "es", "mx": "es", "ar": "es", "fr": "fr", "be": "fr", "uk": "en", "us": "en", "au": "en", "ie": "en"}


def identify(rows: DataFrame, training: DataFrame, min_posterior: float = 0.0, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Names the language of each text.

    ``rows``: ``id long, text string, declared string`` (language of the markup, such as
    ``de`` or ``de-AT``), ``host string``.  ``training``: ``text, lang``; every row counts and every label with a text is a
    language, however rare.  Returns per row: ``id, language string`` (the likeliest; ``und`` when
    training has no language), ``text_language string`` (by text alone, null without text),
    ``posterior double``, ``kept boolean`` (posterior of ``min_posterior`` at least).

    Method: naive Bayes over character four-grams in a 32-symbol alphabet, counted by Spark
    over all training rows, gives the likelihood of the text, tempered to 50 characters.  The counts stay a table:
    a batch of rows (``batch_bytes`` of text, one after the other in a partition) asks for the n-grams it has, a join answers with their counts in all
    languages, and only symbols of texts and those answers are shuffled.  Declared markup and the
    address suffix multiply the likelihood by the chance of such a declaration.  The prior is that of
    the host: posteriors by text are summed by host, registered domain, suffix and overall
    in grouped aggregations, and each level is smoothed towards the one above.  A row's own
    share counts in no level of its prior.

    The language set comes from the training labels, ordered by name; ties go to the first.  Nothing that grows with
    labels or texts is collected or broadcast by force; a row's working space grows with the number of languages.
    Rows may repeat or share an id; each is named by itself.
    Null text, declaration or host is no evidence.  Declared languages and suffixes that
    training does not know are no evidence either.  An empty table gives no rows; other
    columns are not read.  Partitions of ``rows`` have to come out alike each time they are computed, as those of files do;
    an n-gram that was not asked for is an error.
    """
    labelled = training.filter("lang is not null and text is not null").select(F.col("lang").cast("string").alias("language"), F.col("text").cast("string").alias("text"))
    names = saved(dense_ids(labelled, "language", "code").select("language", F.col("code").cast("int").alias("code")))
    if names.isEmpty():
        return rows.select("id", F.lit("und").alias("language"), F.lit(None).cast("string").alias("text_language"), F.lit(0.0).alias("posterior"), F.lit(min_posterior <= 0).alias("kept"))
    counts = saved(labelled.mapInArrow(count_grams, "language string, gram int, n long").groupBy("language", "gram").agg(F.sum("n").alias("n")).join(names, "language"))
    totals = names.join(counts.groupBy("code").agg(F.sum("n").alias("n")), "code", "left").select(F.lit(TOTALS).alias("gram"), "code", F.coalesce("n", F.lit(0)).alias("n"))
    model = saved(counts.select("gram", "code", "n").unionByName(totals).groupBy("gram").agg(F.collect_list(F.struct("code", "n")).alias("counts")))

    given = rows.select(
        F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.lower(F.regexp_extract("declared", "^([A-Za-z]+)", 1)).alias("declared"), F.lower(F.col("host")).alias("host")
    )
    asked = given.select("text").mapInArrow(partial(_asked, size=batch_bytes), "batch long, gram int").join(model, "gram", "left")
    sent = given.mapInArrow(partial(_sent, size=batch_bytes), "batch long, stream binary")
    scored = sent.groupBy("batch").cogroup(asked.groupBy("batch")).applyInArrow(_scored, "id long, declared string, host string, score array<long>, share array<int>")
    return _fused(saved(scored), names, min_posterior)


#: Stands for the n-gram whose counts are the languages' totals.
TOTALS = -1


def _batched(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
    """Slices with the number of their batch, and whether it begins with them."""
    first, held, chunk = TaskContext.get().partitionId() << 24, size, -1
    for batch in batches:
        for part in W.slices(batch):
            begins = held >= size
            held, chunk = (0, chunk + 1) if begins else (held, chunk)
            held += int(np.diff(W.text_bytes(part.column("text"))[1][[0, -1]])[0])
            yield first + chunk, begins, part


def _asked(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Each n-gram of each batch, once, and the totals."""
    own, seen = -1, np.zeros(GRAMS, bool)

    def given() -> pa.RecordBatch:
        grams = np.r_[TOTALS, np.flatnonzero(seen)].astype(np.int32)
        return pa.RecordBatch.from_pydict({"batch": np.full(len(grams), own), "gram": grams})

    for number, begins, part in _batched(batches, size):
        if begins and own >= 0:
            yield given()
            seen[:] = False
        own = number
        seen[text_grams(part.column("text").to_pylist())[0]] = True
    if own >= 0:
        yield given()


def _sent(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The rows of each batch, symbols in place of texts, as compressed streams."""
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))
    for number, _, part in _batched(batches, size):
        grams, at = text_grams(part.column("text").to_pylist())
        symbols = pa.LargeBinaryArray.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer((grams & (SYMBOLS - 1)).astype(np.uint8))])
        rows = pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "declared", "host")), symbols], names=["id", "declared", "host", "symbols"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=options) as stream:
            stream.write_batch(rows)
        yield pa.RecordBatch.from_pydict({"batch": pa.array([number], pa.int64()), "stream": pa.array([sink.getvalue().to_pybytes()], pa.binary())})


def _costs(model: pa.Table) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
    """Where each n-gram of the batch stands, -1 for others; and for each language the cost of an n-gram it has not, the places of those it has and their costs."""
    model = model.combine_chunks()
    grams, lists = model.column("gram").to_numpy(), model.column("counts").combine_chunks()
    entries = lists.flatten()
    owner = np.repeat(np.arange(len(grams)), np.diff(_offsets(lists)))
    code, n = entries.field("code").to_numpy(), entries.field("n").to_numpy()
    place = np.full(GRAMS, -1, np.int32)
    real = np.flatnonzero(grams != TOTALS)
    place[grams[real]] = real
    order = np.argsort(code, kind="stable")
    owner, code, n = owner[order], code[order], n[order]
    languages = []
    for own in np.split(np.arange(len(code)), np.flatnonzero(np.diff(code)) + 1):
        is_total = grams[owner[own]] == TOTALS
        total = np.log(n[own[is_total]][0] + ALPHA * GRAMS)
        cost = lambda x, total=total: np.round(UNIT * (np.log(x + ALPHA) - total)).astype(np.int64)
        languages.append((int(cost(np.zeros(1))[0]), owner[own[~is_total]], cost(n[own[~is_total]])))
    return place, languages


def _offsets(lists: pa.ListArray) -> np.ndarray:
    """Offsets of a list column whose null lists are empty."""
    return np.r_[0, np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False))]


def _scored(streams: pa.Table, model: pa.Table) -> pa.Table:
    """Tempered log-likelihoods by text, in the order of the languages, and the posterior by text in thousandths (none without text)."""
    place, languages = _costs(model)
    out = []
    for stream in streams.column("stream"):
        part = pa.ipc.open_stream(stream.as_buffer()).read_all().combine_chunks()
        symbols = part.column("symbols").combine_chunks()
        at = np.frombuffer(symbols.buffers()[1], np.int64)[symbols.offset : symbols.offset + len(symbols) + 1]
        grams = symbol_grams(np.frombuffer(symbols.buffers()[2] or b"", np.uint8)[at[0] : at[-1]], at - at[0])
        at, where = at - at[0], place[grams]
        if (where < 0).any():
            raise ValueError("a batch has n-grams that it did not ask for: its rows differ from those that asked")
        n = np.diff(at)
        score = np.empty((part.num_rows, len(languages)), np.int64)
        for i, (unseen, known, costs) in enumerate(languages):
            table = np.full(model.num_rows, unseen)
            table[known] = costs
            sums = np.zeros(len(where) + 1, np.int64)
            np.cumsum(table[where], out=sums[1:])
            score[:, i] = sums[at[1:]] - sums[at[:-1]]
        score = np.where((n > EFFECTIVE)[:, None], score * EFFECTIVE // np.maximum(n, 1)[:, None], score)
        odds = np.exp((score - score.max(1, keepdims=True)) / UNIT)
        share = np.round(1000 * odds / odds.sum(1, keepdims=True)).astype(np.int32) * (n > 0)[:, None]
        first = np.arange(part.num_rows + 1) * len(languages)
        columns = {c: part.column(c) for c in ("id", "declared", "host")} | {"score": W.lists(first, pa.array(score.ravel())), "share": W.lists(first, pa.array(share.ravel().astype(np.int32)))}
        out.append(pa.table(columns))
    empty = pa.schema([("id", pa.int64()), ("declared", pa.string()), ("host", pa.string()), ("score", pa.list_(pa.int64())), ("share", pa.list_(pa.int32()))])
    return pa.concat_tables(out) if out else empty.empty_table()


def _fused(scored: DataFrame, names: DataFrame, min_posterior: float) -> DataFrame:
    by_suffix = F.create_map(*(F.lit(x) for pair in SUFFIXES.items() for x in pair))
    labelled = scored.withColumns({"suffix": F.regexp_extract("host", r"([^.]+)$", 1), "domain": F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)})
    shares = labelled.select("host", "domain", "suffix", F.posexplode("share").alias("code", "n")).filter("n > 0")
    hosts = saved(shares.groupBy("host", "domain", "suffix", "code").agg(F.sum(F.col("n").cast("long")).alias("n")))  # the levels above sum these
    named = hosts.filter("host is not null")

    def level(table: DataFrame, key: list[str], name: str) -> DataFrame:
        sums = table.groupBy(*key, "code").agg(F.sum("n").alias("n"))
        return sums.groupBy(*key).agg(F.collect_list(F.struct("code", "n")).alias(name))  # a place for each language

    of_host = level(named, ["host", "domain", "suffix"], "n_host")
    known = of_host.join(level(named, ["domain", "suffix"], "n_domain"), ["domain", "suffix"]).join(level(named, ["suffix"], "n_suffix"), "suffix").drop("domain", "suffix")
    overall = hosts.groupBy("code").agg(F.sum("n").alias("n")).agg(F.collect_list(F.struct("code", "n")).alias("n_all"))  # one row
    votes = {c: names.select(F.col("language").alias(f"_{c}"), F.col("code").alias(f"{c}_code")) for c in ("declared", "by_suffix")}
    joined = labelled.withColumn("by_suffix", by_suffix[F.col("suffix")]).drop("suffix", "domain").join(saved(known), "host", "left").crossJoin(overall)
    for c, codes in votes.items():
        joined = joined.join(codes, F.col(c) == F.col(f"_{c}"), "left").drop(f"_{c}")
    ready = joined.select("id", "score", "share", "n_all", "n_suffix", "n_domain", "n_host", "declared_code", "by_suffix_code")
    found = ready.mapInArrow(_decided, "id long, code int, text_code int, posterior double")
    text_names = names.select(F.col("language").alias("text_language"), F.col("code").alias("text_code"))
    result = found.join(names, "code").join(text_names, "text_code", "left")
    return result.select("id", "language", "text_language", "posterior", (F.col("posterior") >= min_posterior).alias("kept"))


def _dense(column: pa.Array, size: int) -> np.ndarray:
    """Lists of (code, n) as rows of a matrix."""
    out, entries = np.zeros((len(column), size)), column.flatten()
    out[np.repeat(np.arange(len(column)), np.diff(_offsets(column))), entries.field("code").to_numpy()] = entries.field("n").to_numpy()
    return out


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The likeliest language of each row from all evidence, the likeliest by text, and the former's posterior."""
    for whole in batches:
        for low in range(0, whole.num_rows, DECIDED):
            batch = whole.slice(low, DECIDED)
            score, share = (batch.column(c).flatten().to_numpy().reshape(batch.num_rows, -1) for c in ("score", "share"))
            size = score.shape[1]
            prior = np.full(score.shape, 1 / size)
            for name in ("n_all", "n_suffix", "n_domain", "n_host"):
                column = batch.column(name)
                rest = (_dense(column, size) - share) / 1000
                next_ = (rest + PRIOR_WEIGHT * prior) / (rest.sum(1, keepdims=True) + PRIOR_WEIGHT)
                there = np.ones(len(column), bool) if name == "n_all" else pa.compute.is_valid(column).to_numpy(zero_copy_only=False)
                prior = np.where(there[:, None], next_, prior)
            logs = score / UNIT + np.log(prior)
            for name, trust in (("declared_code", TRUST["declared"]), ("by_suffix_code", TRUST["suffix"])):
                said = pa.compute.fill_null(batch.column(name), -1).to_numpy()
                chance = np.where(np.arange(size) == said[:, None], trust, (1 - trust) / max(1, size - 1))
                logs += np.where((said >= 0)[:, None], np.log(chance), 0)
            best = logs.argmax(1)
            posterior = np.round(1 / np.exp(logs - logs.max(1, keepdims=True)).sum(1), 6)
            by_text = pa.array(score.argmax(1).astype(np.int32), mask=share.max(1) == 0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(best, pa.int32()), by_text, pa.array(posterior)], names=["id", "code", "text_code", "posterior"])


#: Rows that are decided at a time.
DECIDED = 2048
