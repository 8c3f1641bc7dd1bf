"""Modified Kneser-Ney models of character n-grams, counted and fitted by Spark."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import _words as W
from tessera.plans.tables import saved

#: Characters of an n-gram.
ORDER = 4
#: Costs are -log p in units of 2**-16 nats, so sums do not depend on their order.
UNIT = 1 << 16
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Rows of counts that a task holds before it sums them up.
_PENDING = 1 << 18
#: Limits that no digest of a text reaches: an n-gram of two texts or more has them as low and high.
_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


#: Columns of the counts of a batch.
COUNTED = [("batch", pa.int64()), ("language", pa.string()), ("hash", pa.int64()), ("gram", pa.string()), ("n", pa.int64()), ("low", pa.int64()), ("high", pa.int64())]


def text_grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash of the n-gram that ends at each character of the texts, where each text starts in that array, and the code points of each n-gram.

    Any code point is a symbol of its own.  Before its first character a text has line feeds.
    """
    pad = "\n" * (ORDER - 1)
    lengths = np.fromiter((len(t or "") for t in texts), np.int64, len(texts))
    codes = np.frombuffer((pad + pad.join(t or "" for t in texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lengths, out=at[1:])
    # The n-gram at position p ends at character p + ORDER - 1, so text i owns those from its own start on.
    own = np.repeat((ORDER - 1) * np.arange(len(texts)), lengths) + np.arange(at[-1])
    symbols = codes.astype(np.uint64)
    hashes = np.zeros(max(0, len(codes) - ORDER + 1), np.uint64)
    for k in range(ORDER):
        hashes = hashes * _FACTOR + symbols[k : k + len(hashes)]
    return W.mix(hashes)[own], at, np.lib.stride_tricks.sliding_window_view(codes, ORDER)[own] if len(codes) >= ORDER else np.empty((0, ORDER), np.uint32)


def counted(table: pa.Table) -> pa.Table:
    """The n-grams of a batch (``batch, language, text, content``): rows ``batch, language, hash, gram, n, low, high``.

    low and high are the smallest and largest ``content`` of the texts that hold the n-gram
    if there is one such text, else the limits.
    """
    out = []
    for language, texts in by_language(table):
        held: list[tuple[np.ndarray, ...]] = []
        for part in texts:
            hashes, at, symbols = text_grams(part.column("text").to_pylist())
            content = np.repeat(part.column("content").to_numpy(), np.diff(at))
            order = np.argsort(hashes, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(hashes[order]) != 0]) if len(order) else order
            if not len(first):
                continue
            ranked = content[order]
            held.append((hashes[order[first]], np.diff(np.r_[first, len(order)]), np.minimum.reduceat(ranked, first), np.maximum.reduceat(ranked, first), symbols[order[first]]))
            if sum(len(h[0]) for h in held) > _PENDING:
                held = [_summed(held)]
        if held:
            hashes, n, low, high, symbols = _summed(held)
            several = low < high
            spelled = np.ascontiguousarray(symbols).tobytes().decode("utf-32-le")
            rows = {
                "batch": np.full(len(n), table.column("batch")[0].as_py(), np.int64), "language": pa.array([language]).take(pa.array(np.zeros(len(n), np.int64))), "hash": hashes.view(np.int64),
                "gram": [spelled[i : i + ORDER] for i in range(0, len(spelled), ORDER)], "n": n, "low": np.where(several, _LOW, low), "high": np.where(several, _HIGH, high),
            }
            out.append(pa.table(rows))
    return pa.concat_tables(out) if out else pa.table({c: pa.array([], t) for c, t in COUNTED})


def _summed(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    hashes, n, low, high, symbols = (np.concatenate(c) for c in zip(*held, strict=True))
    order = np.argsort(hashes, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(hashes[order]) != 0])
    return hashes[order[first]], np.add.reduceat(n[order], first), np.minimum.reduceat(low[order], first), np.maximum.reduceat(high[order], first), symbols[order[first]]


def by_language(table: pa.Table):
    """For each language of a table its name and its rows, in slices of bounded text."""
    languages = table.column("language").combine_chunks().dictionary_encode()
    codes = languages.indices.to_numpy()
    for code, name in enumerate(languages.dictionary.to_pylist()):
        rows = table.filter(pa.array(codes == code))
        yield name, (part for batch in rows.to_batches() for part in W.slices(batch))


def fitted(counts: DataFrame) -> DataFrame:
    """The model of each language: rows ``language, gram, cost long`` for every n-gram that occurs.

    ``counts``: ``language, gram, n, low, high``, several rows for an n-gram if need be.  An
    interpolated modified Kneser-Ney model; lower orders count the distinct characters before
    an n-gram, and each order's three discounts come from its counts of counts.  An n-gram
    that only one text holds (exact copies are one text) counts as unseen, and the mass that it would have
    had goes to the lower order: so no text makes itself likely.

    All steps are grouped sums and joins on language and n-gram or context; nothing is
    collected or broadcast by force, and the tables grow with the distinct n-grams.
    """
    levels = {ORDER: saved(counts.groupBy("language", "gram").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")))}
    for order in range(ORDER - 1, 0, -1):
        ends = levels[order + 1].groupBy("language", F.substring("gram", 2, order).alias("gram"))
        levels[order] = saved(ends.agg(F.count("*").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")))
    model = levels[1].groupBy("language").agg((1 / (F.count("*") + 1)).alias("p")).withColumn("gram", F.lit(""))
    for order in range(1, ORDER + 1):
        model = _level(levels[order], model, order)
    return model.select("language", "gram", F.round(-UNIT * F.log("p")).cast("long").alias("cost"))


def _level(grams: DataFrame, lower: DataFrame, order: int) -> DataFrame:
    """Probabilities of the n-grams of an order, from those of the order below."""
    of = {k: F.count_if(F.col("n") == k) for k in (1, 2, 3, 4)}
    found = grams.groupBy("language").agg(*(c.alias(f"n{k}") for k, c in of.items())).select("language", *(d.alias(f"d{k}") for k, d in _discounts().items()))
    context, seen = F.substring("gram", 1, order - 1), F.col("low") < F.col("high")
    contexts = grams.groupBy("language", context.alias("context")).agg(
        F.sum("n").alias("total"), F.coalesce(F.sum(F.when(seen, F.col("n"))), F.lit(0)).alias("of_seen"), *(F.count_if(seen & (F.least("n", F.lit(3)) == k)).alias(f"c{k}") for k in (1, 2, 3))
    )
    kept = F.col("of_seen") - sum((F.col(f"c{k}") * F.col(f"d{k}") for k in (1, 2, 3)), F.lit(0.0))
    contexts = contexts.join(found, "language").withColumn("left_over", 1 - kept / F.col("total"))
    discount = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    below = lower.select("language", F.col("gram").alias("ending"), F.col("p").alias("below"))
    joined = grams.withColumns({"context": context, "ending": F.substring("gram", 2, order - 1)}).join(contexts, ["language", "context"]).join(below, ["language", "ending"])
    own = F.when(seen, (F.col("n") - discount) / F.col("total")).otherwise(0.0)
    return joined.select("language", "gram", (own + F.col("left_over") * F.col("below")).alias("p"))


def _discounts() -> dict[int, Column]:
    """The discounts for counts of 1, 2 and 3 or more, from the counts of counts; 0.5, 0.75 and 0.9 where these are too few."""
    n1, n2, n3, n4 = (F.col(f"n{k}").cast("double") for k in (1, 2, 3, 4))
    y = F.try_divide(n1, n1 + 2 * n2)
    guesses = {1: (1 - 2 * y * F.try_divide(n2, n1), 0.5), 2: (2 - 3 * y * F.try_divide(n3, n2), 0.75), 3: (3 - 4 * y * F.try_divide(n4, n3), 0.9)}
    enough = (n1 > 0) & (n2 > 0)
    return {k: F.when(enough & (g > 0) & (g < k), g).otherwise(F.lit(plain)) for k, (g, plain) in guesses.items()}
