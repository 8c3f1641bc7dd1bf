"""Near-duplicate detection with b-bit MinHash."""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import _words as W
from tessera.llm._rows import others, whole
from tessera.plans.components import connected_components
from tessera.plans.tables import saved

#: Bands, minima of a band, and low bits kept of each minimum. At a similarity of 0.8 a
#: link shares no band with a chance of (1 - 0.8**6)**48, about 5e-7.
BANDS, ROWS, BITS = 48, 6, 2
MINIMA = BANDS * ROWS
SIGNATURE_LONGS = MINIMA * BITS // 64

_random = np.random.default_rng(11)
_A = (_random.integers(0, 1 << 32, (MINIMA, 1), dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _random.integers(0, 1 << 32, (MINIMA, 1), dtype=np.uint64).astype(np.uint32)
#: Minima of the wide signature that documents in mixed buckets get.
WIDE = 2048
_BAND = _random.integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
_WIDE_A = (_random.integers(0, 1 << 32, (WIDE, 1), dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_WIDE_B = _random.integers(0, 1 << 32, (WIDE, 1), dtype=np.uint64).astype(np.uint32)
#: Shingles that are hashed at a time: the block stays in a core's cache.
_BLOCK = 512

_SIGNATURES = "row long, doc_id long, n_shingles long, content binary, bands array<long>, " + ", ".join(f"s{i} long" for i in range(SIGNATURE_LONGS))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, whole_rows: bool = False
) -> DataFrame:
    """Groups documents whose word shingles have a Jaccard similarity of percent / 100 or more.

    A-Z are lower-cased; words are maximal runs of bytes other than 0x20 and 0x09-0x0D.  A
    document's set holds its distinct ``words``-word shingles; with fewer words, the whole
    sequence as one.  Returns per input row: ``doc_id long`` (under the name ``id_col``),
    ``n_shingles long``, ``component_id long`` (the smallest id that links reach, itself
    included), ``kept boolean`` (it is that id) and ``leader boolean`` (the one row of its
    component that stays).  With ``whole_rows`` also ``row``, a struct of all columns of the
    input row.

    Method: each set becomes 288 minima.  48 bands of 6 give candidate buckets; of each
    minimum two low bits stay, packed into nine longs.  Equal sets, known by a BLAKE2b digest
    of 256 bits over the words of their sorted shingles, collapse to one row first.  Each bucket has a
    centre, the member that meets the most others; each document is compared with the centre
    that it meets most often, by the collision-corrected estimate from bit counts and then on
    full shingle sets, word by word.  After components of these links, documents in buckets
    that still hold several components get 2048 minima, and every pair across components
    whose wider estimate is within five standard errors of the threshold is confirmed too.
    What is already linked emits no more pairs.  A link that shares no bucket is missed with
    a chance below 1e-6.

    Every row is a document of its own: rows may share an id or have none, and each links by
    its own text.  Rows with a null id have the component id of the others, null if there is
    none; their ``kept`` is ``leader``.  The leader is the row with the smallest id, nulls
    last, and of several such rows the first.  Null, empty and blank texts have an empty set,
    link with nothing and lead themselves.  An empty table gives no rows; other columns are
    carried, if asked for, and otherwise not read.
    """
    held = saved(
        docs.select(
            F.monotonically_increasing_id().alias("row_id"),
            F.col(id_col).cast("long").alias("doc_id"),
            F.col(text_col).cast("string").alias("text"),
            *([others(docs, text_col)] if whole_rows else []),
        ),
        "zstd",
    )
    texts = held.select(F.col("row_id").alias("row"), "doc_id", "text")
    signed = saved(texts.mapInArrow(lambda batches: _sign(batches, words), _SIGNATURES))
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    same = saved(signed.filter("n_shingles > 0").groupBy("content").agg(F.min(place).alias("least"), F.count("*").alias("n")).filter("n > 1").select("content", F.col("least.row").alias("rep")))
    with_rep = signed.join(same, "content", "left").withColumn("rep", F.coalesce("rep", "row"))
    members = with_rep.select("row", "doc_id", "n_shingles", "rep")
    reps = saved(with_rep.filter("row = rep and n_shingles > 0").drop("rep", "content"))
    sketches = reps.drop("bands", "doc_id")

    bands = reps.select("row", F.explode("bands").alias("key"))
    shared = saved(bands.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    buckets = saved(bands.join(shared, "key"))
    # The member that meets the most others in all its buckets is likely to be what the rest are copies of.
    crowd = buckets.groupBy("row").agg(F.sum("n").alias("crowd"))
    ranked = saved(buckets.join(saved(crowd), "row").select("key", "row", F.struct("crowd", (-F.col("row")).alias("minus")).alias("place")))
    centres = saved(ranked.groupBy("key").agg(F.max("place").alias("centre")))
    stars = ranked.join(centres, "key").filter("place < centre").select(F.col("row").alias("a"), (-F.col("centre.minus")).alias("b"))
    met = stars.groupBy("a", "b").agg(F.count("*").alias("times"))
    best = met.groupBy("a").agg(F.max(F.struct("times", (-F.col("b")).alias("minus_b"))).alias("best")).select("a", (-F.col("best.minus_b")).alias("b"))
    likely = _sketched(best, sketches).filter(F.col("similarity") >= _least(percent)).select("a", "b")
    links = saved(_confirmed(likely, texts, words, percent))
    component = connected_components(links)

    labelled = saved(buckets.select("key", "row").join(component.withColumnRenamed("node", "row"), "row", "left").withColumn("component", F.coalesce("component", "row")))
    mixed = saved(labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("key"))
    rest = saved(labelled.join(mixed, "key"))
    wide = texts.join(rest.select("row").distinct().hint("merge"), "row", "left_semi").mapInArrow(lambda batches: _sign_wide(batches, words), "row long, wide array<long>")
    rest = saved(rest.join(saved(wide), "row").join(reps.select("row", "bands"), "row"))
    x, y = rest.alias("x"), rest.alias("y")
    across = x.join(
        y,
        (F.col("x.key") == F.col("y.key"))
        & (F.col("x.component") < F.col("y.component"))
        & (F.array_min(F.array_intersect("x.bands", "y.bands")) == F.col("x.key"))  # a pair counts in one bucket only
        & (_similarity(F.aggregate(F.zip_with("x.wide", "y.wide", _differing), F.lit(0), lambda n, d: n + d), WIDE) >= F.lit(_least(percent, WIDE, 5))),
    ).select(F.least("x.row", "y.row").alias("b"), F.greatest("x.row", "y.row").alias("a"))
    more = _confirmed(across.distinct().select("a", "b"), texts, words, percent)
    component = connected_components(saved(links.unionByName(more))).withColumnRenamed("node", "rep")

    joined = saved(members.join(component, "rep", "left").withColumn("component", F.coalesce("component", "rep")))
    first = joined.groupBy("component").agg(F.min(place).alias("least"))
    is_leader = F.col("row") == F.col("least.row")
    found = joined.join(first, "component").select(
        "row",
        F.col("doc_id").alias(id_col),
        "n_shingles",
        F.col("least.doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.col("least.doc_id"), is_leader).alias("kept"),
        is_leader.alias("leader"),
    )
    if not whole_rows:
        return found.drop("row")
    # Both sides grow with the documents, so neither is broadcast.
    return held.select("row_id", whole(docs, text_col)).join(found.withColumnRenamed("row", "found_row").hint("merge"), F.col("row_id") == F.col("found_row")).drop("row_id", "found_row")


def _least(percent: int, minima: int = MINIMA, errors: int = 6) -> float:
    """Estimates below this rule a pair out: so many standard errors under the threshold."""
    s, by_chance = percent / 100, 0.5**BITS
    match = s + (1 - s) * by_chance
    return s - errors * math.sqrt(match * (1 - match) / minima) / (1 - by_chance)


def _differing(left: Column, right: Column) -> Column:
    """How many of the two-bit fields of two longs differ."""
    either = left.bitwiseXOR(right)
    return F.bit_count(either.bitwiseOR(F.shiftrightunsigned(either, 1)).bitwiseAND(F.lit(0x5555555555555555)))


def _similarity(differing: Column, minima: int) -> Column:
    """The estimate from the number of differing fields, corrected for low bits that agree by chance."""
    by_chance = 0.5**BITS
    return ((1 - differing / F.lit(minima)) - by_chance) / (1 - by_chance)


def _sketched(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    left = sketches.select(F.col("row").alias("a"), *(F.col(f"s{i}").alias(f"l_s{i}") for i in range(SIGNATURE_LONGS)))
    right = sketches.select(F.col("row").alias("b"), *(F.col(f"s{i}").alias(f"r_s{i}") for i in range(SIGNATURE_LONGS)))
    differing = sum((_differing(F.col(f"l_s{i}"), F.col(f"r_s{i}")) for i in range(SIGNATURE_LONGS)), F.lit(0))
    return pairs.join(left, "a").join(right, "b").select("a", "b", _similarity(differing, MINIMA).alias("similarity"))


def _confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs whose full shingle sets are similar enough."""
    left = texts.select(F.col("row").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("row").alias("b"), F.col("text").alias("text_b"))
    # Pairs grow with the documents, so neither side is ever broadcast.
    both = saved(pairs).hint("merge").join(left, "a").join(right.hint("merge"), "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(lambda batches: _compare(batches, words, percent), "a long, b long")


class Shingles:
    """The distinct shingles of each text: numbers that equal shingles alone share, and the words that they start with."""

    def __init__(self, found: W.Words, size: int) -> None:
        self.codes = found.interned(lower=True)[0]
        self.first, self.size = found.first, size
        at = np.arange(max(0, len(self.codes) - size + 1))
        self.number = self.codes[at]
        for k in range(1, size):
            self.number = W.joint(self.number, self.codes[at + k])

    def text(self, i: int) -> np.ndarray:
        """Where the distinct shingles of a text start; a text with fewer words is one shingle."""
        first, last = self.first[i], self.first[i + 1]
        if last - first < self.size:
            return np.full(min(1, last - first), first)
        return first + np.unique(self.number[first : last - self.size + 1], return_index=True)[1]

    def key(self, i: int) -> tuple | np.ndarray:
        """The distinct shingles of a text, sorted, by number; as words where it has too few of them."""
        first, last = self.first[i], self.first[i + 1]
        return tuple(self.codes[first:last]) if last - first < self.size else np.unique(self.number[first : last - self.size + 1])


def _hashes(found: W.Words, size: int) -> Iterator[tuple[np.ndarray, bytes]]:
    """For each text the sorted 64-bit hashes of its shingles, and a digest of the words of all of them."""
    shingles = Shingles(found, size)
    values = np.stack(found.keys(lower=True), axis=1)
    for i, (first, last) in enumerate(zip(found.first[:-1], found.first[1:], strict=True)):
        at = shingles.text(i)
        width = min(size, last - first)
        if not width:
            yield np.empty(0, np.uint64), b""
            continue
        words = values[at[:, None] + np.arange(width)]
        hashes = np.full(len(at), width, np.uint64)
        for k in range(width):
            hashes = W.mix(hashes * np.uint64(0x9E3779B97F4A7C15) + words[:, k, 0] + W.mix(words[:, k, 1]))
        order = np.argsort(hashes)
        yield hashes[order], blake2b(np.ascontiguousarray(words[order]), digest_size=32, salt=int(width).to_bytes(8, "little")).digest()


def _minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray, block: int) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)[None, :]
    found = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, x.shape[1], block):
        some = a * x[:, at : at + block]
        some += b
        np.minimum(found, some.min(axis=1), out=found)
    return found.astype(np.uint64)


def _packed(minima: np.ndarray) -> np.ndarray:
    """The low bits of the minima, packed into longs."""
    shifts = np.arange(0, 64, BITS, dtype=np.uint64)
    bits = W.mix(minima) & np.uint64((1 << BITS) - 1)
    return (bits.reshape(-1, 64 // BITS) << shifts).sum(axis=1, dtype=np.uint64)


def _sign_wide(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in W.slices(batch):
            wide = [_packed(_minima(s, _WIDE_A, _WIDE_B, _BLOCK // 8)) if len(s) else np.zeros(WIDE * BITS // 64, np.uint64) for s, _ in _hashes(W.batch_words(part), words)]
            first = np.arange(len(wide) + 1) * (WIDE * BITS // 64)
            yield pa.RecordBatch.from_arrays([part.column("row"), W.lists(first, pa.array(np.concatenate(wide).view(np.int64)))], names=["row", "wide"])


def _sign(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in W.slices(batch):
            n, bands, packed, sums = [], [], [], []
            for shingles, content in _hashes(W.batch_words(part), words):
                n.append(len(shingles))
                sums.append(content)
                if not len(shingles):
                    bands.append(np.empty(0, np.int64))
                    packed.append(np.zeros(SIGNATURE_LONGS, np.uint64))
                    continue
                low = _minima(shingles, _A, _B, _BLOCK)
                keys = W.mix((low.reshape(BANDS, ROWS) * _BAND).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
                bands.append(keys.view(np.int64))
                packed.append(_packed(low))
            first = np.r_[0, np.cumsum([len(b) for b in bands])]
            columns = [part.column("row"), part.column("doc_id"), pa.array(n, pa.int64()), pa.array(sums, pa.binary()), W.lists(first, pa.array(np.concatenate(bands)))]
            columns += [pa.array(c.copy()) for c in np.array(packed).view(np.int64).T]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "n_shingles", "content", "bands", *(f"s{i}" for i in range(SIGNATURE_LONGS))])


def _compare(batches: Iterator[pa.RecordBatch], words: int, percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs that pass; words of both texts get their numbers together, so equal numbers are equal words."""
    for batch in batches:
        for part in W.slices(batch, "text_a"):
            n = part.num_rows
            both = pa.concat_arrays([part.column("text_a"), part.column("text_b")])
            shingles = Shingles(W.find_words(*W.text_bytes(both)), words)
            passed = []
            for i in range(n):
                x, y = shingles.key(i), shingles.key(n + i)
                if isinstance(x, tuple) or isinstance(y, tuple):
                    passed.append(isinstance(x, tuple) and isinstance(y, tuple) and len(x) > 0 and x == y)
                    continue
                common = len(np.intersect1d(x, y, assume_unique=True))
                passed.append(100 * common >= percent * (len(x) + len(y) - common) and common > 0)
            yield part.select(["a", "b"]).filter(pa.array(passed, pa.bool_()))
