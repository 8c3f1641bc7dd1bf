"""Sparse matrices as entries ``row, col, val``, and graphs as edges ``a, b, w``."""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.scans import running_before, sums_before
from tessera.plans.tables import saved


def transpose(entries: DataFrame) -> DataFrame:
    return entries.select(F.col("col").alias("row"), F.col("row").alias("col"), "val")


def prune(entries: DataFrame, by: str, low: int, high: int) -> DataFrame:
    """Keeps entries of the rows (or columns) that have between ``low`` and ``high`` entries."""
    fit = entries.groupBy(by).agg(F.count("*").alias("n")).filter(F.col("n").between(low, high)).select(by)
    return entries.join(fit, by, "left_semi")


def heaviest(entries: DataFrame, by: str, fraction: float) -> DataFrame:
    """Keeps the largest entries of each row until their squares make up the fraction of the row's squared norm."""
    down = Window.partitionBy(by).orderBy(F.desc(F.abs("val")), "col" if by == "row" else "row").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(by)
    square = F.col("val") * F.col("val")
    marked = entries.withColumns({"_before": F.coalesce(F.sum(square).over(down), F.lit(0.0)), "_all": F.sum(square).over(whole)})
    return marked.filter(F.col("_before") < fraction * F.col("_all")).drop("_before", "_all")


def top_entries(entries: DataFrame, by: str, k: int, keep: float) -> DataFrame:
    """Keeps the k largest entries of each row, and all entries of at least ``keep``; ties to the smaller other index."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("val"), "col" if by == "row" else "row"))
    return entries.withColumn("_rank", rank).filter((F.col("_rank") <= k) | (F.col("val") >= keep)).drop("_rank")


def above_mean(entries: DataFrame, by: str, times: float) -> DataFrame:
    """Keeps entries over so many times the mean entry of their row."""
    mean = entries.groupBy(by).agg(F.avg("val").alias("_mean"))
    return entries.join(mean, by).filter(F.col("val") > times * F.col("_mean")).drop("_mean")


def norms(entries: DataFrame, by: str) -> DataFrame:
    """``by, n, total, squares, norm`` of each row or column."""
    return entries.groupBy(by).agg(
        F.count("*").alias("n"), F.sum("val").alias("total"), F.sum(F.col("val") * F.col("val")).alias("squares"), F.sqrt(F.sum(F.col("val") * F.col("val"))).alias("norm")
    )


def normalise(entries: DataFrame, by: str, order: int = 2) -> DataFrame:
    """Divides every row by its norm (2) or its sum (1)."""
    size = norms(entries, by).select(by, F.col("norm" if order == 2 else "total").alias("_size"))
    return entries.join(size, by).withColumn("val", F.when(F.col("_size") > 0, F.col("val") / F.col("_size")).otherwise(F.col("val"))).drop("_size")


#: Exponents of the scalings by a power (fixed values).
POWERS = {"sqrt": 0.5, "pow25": 0.25, "pow65": 0.65, "pow75": 0.75, "pow85": 0.85}
#: The scalings by a row's largest value: what each value starts from (fixed values).
LARGEST = {"maxtf": 0.5, "maxtf2": 0.1}


def scale(entries: DataFrame, how: str) -> DataFrame:
    """Rescales values; a zero stays zero under powers and ``log``.

    ``maxtf`` and ``maxtf2``: b + (1 - b) v / the largest |v| of the row, with b of 0.5 and 0.1.
    ``sqrt``, ``pow25``, ``pow65``, ``pow75``, ``pow85``: 0.1 + |v| to that power, with the sign of v on it.
    ``log``: 1 + log2 |v|, with the sign of v on the logarithm.  ``idf``: v ln(rows / rows with the column).
    ``idf2``: v ln((rows + 2 f) / (f + rows with the column)), f being half the mean size of a column, 10 at least.
    """
    v = F.col("val")
    if how in LARGEST:
        base = LARGEST[how]
        largest = entries.groupBy("row").agg(F.max(F.abs("val")).alias("_max"))
        return entries.join(largest, "row").withColumn("val", base + (1 - base) * v / F.col("_max")).drop("_max")
    if how in POWERS:
        return entries.withColumn("val", F.when(v != 0, 0.1 + F.signum(v) * F.pow(F.abs(v), F.lit(POWERS[how]))).otherwise(v))
    if how == "log":
        return entries.withColumn("val", F.when(v != 0, 1 + F.signum(v) * F.log2(F.abs(v))).otherwise(v))
    if how in ("idf", "idf2"):
        have = entries.groupBy("col").agg(F.count("*").alias("_have"))
        whole = entries.agg(F.count_distinct("row").alias("_rows"), F.greatest(F.lit(10), F.floor(0.5 * F.count("*") / F.count_distinct("col"))).alias("_f"))
        rows, f = F.col("_rows"), F.when(F.lit(how == "idf2"), F.col("_f")).otherwise(0)
        weighed = entries.join(have, "col").crossJoin(F.broadcast(whole))  # one row
        return weighed.withColumn("val", v * F.log((rows + 2 * f) / (f + F.col("_have")))).drop("_rows", "_f", "_have")
    raise ValueError(f"unknown scaling {how!r}")


def similar_rows(entries: DataFrame, k: int, least: float, measure: str = "cosine") -> DataFrame:
    """For each row the k most similar other rows: ``row, other, similarity, rank``; ties go to the smaller row.

    Measures: ``dot``; ``cosine``; ``tanimoto``, the product over the sum of squares less the product;
    ``jaccard`` of column sets; ``min``, the sum of the smaller values over that of the larger ones;
    ``amin``, the same over the sum of the row itself, which is not symmetric.  The last two take values
    that are not negative.  Rows meet through an inverted index of their columns, so prune frequent
    columns first.
    """
    sizes = {"dot": "n", "cosine": "norm", "tanimoto": "squares", "jaccard": "n", "min": "total", "amin": "total"}
    size = norms(entries, "row").select("row", F.col(sizes[measure]).alias("size"))
    x, y = entries.alias("x"), entries.alias("y")
    shared = {"jaccard": F.lit(1), "min": F.least("x.val", "y.val"), "amin": F.least("x.val", "y.val")}.get(measure, F.col("x.val") * F.col("y.val"))
    common = x.join(y, (F.col("x.col") == F.col("y.col")) & (F.col("x.row") < F.col("y.row"))).groupBy(F.col("x.row").alias("a"), F.col("y.row").alias("b")).agg(F.sum(shared).alias("common"))
    sized = common.join(size.select(F.col("row").alias("a"), F.col("size").alias("na")), "a").join(size.select(F.col("row").alias("b"), F.col("size").alias("nb")), "b")
    turned = sized.select(F.col("b").alias("a"), F.col("a").alias("b"), "common", F.col("nb").alias("na"), F.col("na").alias("nb"))
    against = {"dot": F.lit(1.0), "cosine": F.col("na") * F.col("nb"), "amin": F.col("na")}.get(measure, F.col("na") + F.col("nb") - F.col("common"))
    found = sized.unionByName(turned).select(F.col("a").alias("row"), F.col("b").alias("other"), (F.col("common") / against).alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("similarity"), "other"))
    return found.filter(F.col("similarity") >= least).withColumn("rank", rank).filter(F.col("rank") <= k)


def similar_sets(entries: DataFrame, k: int, least: float, measure: str = "jaccard") -> DataFrame:
    """As ``similar_rows`` over all columns, however frequent, for ``least`` over 0.

    ``measure``: ``jaccard`` of the column sets, ``min`` (sums of the lesser values over those of the greater ones) or ``amin`` (of the
    lesser values over the row's own).  Values have to be positive.  Rows with equal entries are compared once, through the smallest of them.
    Of two rows that are similar enough the rarest column that both have is among the
    rarest of the row: all but a tail of frequent columns that holds less than ``least`` of its sum; but for ``amin`` of both rows.  Pairs
    that meet there, and whose sums allow it, are compared on all their columns.
    """
    value = F.lit(1) if measure == "jaccard" else F.col("val")
    entries = entries.select("row", "col", value.alias("val"))
    have = entries.groupBy("col").agg(F.count("*").alias("have"))
    ranked = entries.join(have, "col").groupBy("row").agg(F.array_sort(F.collect_set(F.struct("have", "col", "val"))).alias("cols"))
    groups = saved(ranked.withColumns({"head": F.min("row").over(Window.partitionBy("cols")), "place": F.row_number().over(Window.partitionBy("cols").orderBy("row"))}))
    heads = groups.filter("place = 1").select(F.col("row").alias("head"), F.inline("cols"))
    tail = Window.partitionBy("head").orderBy(F.desc("have"), F.desc("col"))
    total = Window.partitionBy("head")
    held = saved(heads.select("head", "col", "val", F.sum("val").over(total).alias("n"), F.sum("val").over(tail).alias("tail")))
    rare = held.filter(F.col("tail") >= least * F.col("n") - 1e-9).select("head", "col", "n")  # a hair below keeps what rounding lifts
    x, y = rare.alias("x"), (held.select("head", "col", "n") if measure == "amin" else rare).alias("y")
    if measure == "amin":
        near = (F.col("y.n") >= least * F.col("x.n") - 1e-9) & (F.col("x.head") != F.col("y.head"))
    else:
        near = (F.least("x.n", "y.n") >= least * F.greatest("x.n", "y.n") - 1e-9) & (F.col("x.head") < F.col("y.head"))
    pairs = saved(x.join(y, (F.col("x.col") == F.col("y.col")) & near).select(F.col("x.head").alias("a"), F.col("x.n").alias("na"), F.col("y.head").alias("b"), F.col("y.n").alias("nb")).distinct())
    if measure == "jaccard":  # whole sets meet, without a row for each common column
        sets = groups.filter("place = 1").select(F.col("row").alias("head"), F.col("cols.col").alias("set"))
        left, right = (sets.select(F.col("head").alias(c), F.col("set").alias(f"set_{c}")) for c in "ab")
        common = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", F.size(F.array_intersect("set_a", "set_b")).alias("common"))
    else:
        left = held.select(F.col("head").alias("a"), "col", F.col("val").alias("left"))
        right = held.select(F.col("head").alias("b"), "col", F.col("val").alias("right"))
        common = pairs.join(left, "a").join(right, ["b", "col"]).groupBy("a", "b", "na", "nb").agg(F.sum(F.least("left", "right")).alias("common"))
    against = F.col("na") if measure == "amin" else F.col("na") + F.col("nb") - F.col("common")
    compared = saved(common.select("a", "b", (F.col("common") / against).alias("similarity")).filter(F.col("similarity") >= least))
    both = compared if measure == "amin" else compared.unionByName(compared.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    return _to_rows(groups, both, k)


def _to_rows(groups: DataFrame, both: DataFrame, k: int) -> DataFrame:
    """From similarities ``a, b`` of groups of equal rows to the k most similar rows of each row. ``groups``: ``row, head, place`` of each row, the place counted from 1 within its group."""
    # Of k groups ahead of a group each has a row ahead of all of its rows, and of a group its smallest rows come first.
    best = both.withColumn("_at", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("similarity"), "b"))).filter(F.col("_at") <= k).drop("_at")
    same = groups.filter("place = 1").select(F.col("row").alias("a"), F.col("row").alias("b"), F.lit(1.0).alias("similarity"))
    others = groups.filter(F.col("place") <= k + 1).select(F.col("head").alias("b"), F.col("row").alias("other"))
    offered = best.unionByName(same).join(others, "b").select(F.col("a").alias("head"), "other", "similarity")
    found = groups.select("row", "head").join(offered, "head").filter("row <> other").select("row", "other", "similarity")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("similarity"), "other"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


#: In ``nearest_sets``: most rows of a block, rows and others compared at once, and columns counted by a matrix product.
BLOCK, ROWS, OTHERS, COMMON = 32768, 128, 4096, 256
#: Similarities in single precision are this close, as a share, to those in double precision.
SLACK = 1e-6


def nearest_sets(entries: DataFrame, k: int, least: float) -> DataFrame:
    """As ``similar_sets`` of column sets, for a ``least`` over 0 that is too low for tails of frequent columns to rule out pairs.

    Rows with equal sets are compared once, through the smallest of them.  These are dealt into blocks by a hash, and
    every pair of blocks meets in a task of its own, which counts the columns that any two of its rows have in common: the most
    frequent ones by a matrix product, the others by lists of the rows that have them.  It gives the k most similar rows of each row, and the best of
    all blocks count.  There are about three pairs of blocks for each core, so each row is sent as often as there are blocks, but the counting
    grows with the square of the rows.
    """
    entries = entries.filter(F.col("row").isNotNull()).select("row", "col")
    # Columns of a single row count in the size of its set only; such a set equals no other.
    have = entries.groupBy("col").agg(F.count("*").alias("have")).filter("have > 1")
    numbers = saved(sums_before(have, [F.desc("have"), F.asc("col")], {"number": F.lit(1)}).select("col", F.col("number").cast("int").alias("number")))
    sets = entries.join(numbers, "col", "left").groupBy("row").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("number")).alias("cols"))
    sets = saved(sets.filter(F.size("cols") > 0).withColumn("own", F.when(F.col("n") > F.size("cols"), F.col("row"))))
    heads = saved(sets.groupBy("cols", "own").agg(F.min("row").alias("head"), F.min("n").alias("n")))
    equal = sets.filter("own IS NULL").join(heads.filter("own IS NULL").select("cols", "head"), "cols").select("row", "head")
    groups = saved(equal.unionByName(sets.filter("own IS NOT NULL").select("row", F.col("row").alias("head"))))

    rows = heads.count()
    blocks = max(-(-rows // BLOCK), min(isqrt(6 * entries.sparkSession.sparkContext.defaultParallelism), -(-rows // ROWS)), 1)
    dealt = heads.select("head", "n", "cols", F.pmod(F.xxhash64("head"), F.lit(blocks)).cast("int").alias("block"))
    sent = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumns({"x": F.least("block", "with"), "y": F.greatest("block", "with")}).drop("with")
    met = sent.repartition(2 * blocks * (blocks + 1), "x", "y").groupBy("x", "y").applyInArrow(lambda table: _met(table, k, least), "a long, b long, similarity double")
    return _to_rows(groups.withColumn("place", F.row_number().over(Window.partitionBy("head").orderBy("row"))), saved(met), k)


class _Best:
    """Keeps the k best of the pairs given for each of n keys, ties to the smaller other; ``floor`` is what a key's pairs have to reach to count, a hair below it."""

    def __init__(self, n: int, k: int, least: float):
        self.k, self.most, self.new = k, max(n * k, OTHERS), 0
        self.pairs = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        self.floor = np.full(n, least * (1 - SLACK), np.float32)

    def add(self, key: np.ndarray, other: np.ndarray, similarity: np.ndarray) -> None:
        fit = similarity >= self.floor[key]
        self.pairs.append((key[fit], other[fit], similarity[fit]))
        self.new += int(fit.sum())
        if self.new > self.most:
            self.settled()

    def settled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, other, similarity = (np.concatenate(c) for c in zip(*self.pairs, strict=True))
        order = np.lexsort((other, -similarity, key))
        key = key[order]
        place = np.arange(len(key)) - np.searchsorted(key, key)
        kept = place < self.k
        key, other, similarity, place = key[kept], other[order][kept], similarity[order][kept], place[kept]
        full = place == self.k - 1
        self.floor[key[full]] = similarity[full] * (1 - SLACK)
        self.pairs, self.new = [(key, other, similarity)], 0
        return self.pairs[0]


def _side(table: pa.Table, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The rows of a block in order, their sizes, and their entries as places of rows and numbers of columns."""
    side = table.filter(pc.equal(table["block"], block)).sort_by("head").combine_chunks()
    cols = side["cols"].combine_chunks() if isinstance(side["cols"], pa.ChunkedArray) else side["cols"]
    row = np.repeat(np.arange(len(cols)), pc.list_value_length(cols).to_numpy(zero_copy_only=False))
    return side["head"].to_numpy(), side["n"].to_numpy().astype(np.float64), row, cols.flatten().to_numpy(zero_copy_only=False)


def _met(table: pa.Table, k: int, least: float) -> pa.Table:
    """The k best of each row of two blocks among the rows of the other one, or of a block within it."""
    x, y = table["x"][0].as_py(), table["y"][0].as_py()
    heads, sizes, row, col = _side(table, x)
    others, their_sizes, their_row, their_col = (heads, sizes, row, col) if x == y else _side(table, y)
    none = np.zeros(0, np.int64)
    if not len(heads) or not len(others):
        return pa.table({"a": none, "b": none, "similarity": none.astype(float)})
    shared = np.intersect1d(col, their_col)
    common = min(COMMON, len(shared))

    def split(row, col, n):
        """The first columns as a matrix, and the places of rows and columns of the others."""
        at = np.searchsorted(shared, col)
        in_both = np.append(shared, -1)[at] == col
        row, at = row[in_both], at[in_both]
        matrix = np.zeros((n, common), np.float32)
        matrix[row[at < common], at[at < common]] = 1
        return matrix, row[at >= common], at[at >= common]

    left, row, col = split(row, col, len(heads))
    right, their_row, their_col = split(their_row, their_col, len(others))
    by_col = np.argsort(their_col, kind="stable")
    having = np.split(their_row[by_col], np.searchsorted(their_col[by_col], np.arange(common + 1, len(shared)))) if len(shared) > common else []
    ends = np.searchsorted(row, np.arange(len(heads) + 1))
    theirs, found = _Best(len(others), k, least), []
    for start in range(0, len(heads), ROWS):
        chunk = range(start, min(start + ROWS, len(heads)))
        counts = left[chunk.start : chunk.stop] @ right.T
        for i in chunk:
            if ends[i] < ends[i + 1]:
                counts[i - start] += np.bincount(np.concatenate([having[c - common] for c in col[ends[i] : ends[i + 1]]]), minlength=len(others))
        if x == y:
            counts[np.arange(len(chunk)), np.arange(chunk.start, chunk.stop)] = 0
        ours, own = _Best(len(chunk), k, least), sizes[chunk.start : chunk.stop]
        for at in range(0, len(others), OTHERS):
            part, size = counts[:, at : at + OTHERS], their_sizes[at : at + OTHERS]
            union = np.add.outer(own.astype(np.float32), size.astype(np.float32)) - part
            floor = ours.floor[:, None] if x == y else np.minimum.outer(ours.floor, theirs.floor[at : at + OTHERS])
            i, j = np.nonzero(part >= floor * union)
            both = part[i, j].astype(np.float64)
            similarity = both / (own[i] + size[j] - both)
            fit = similarity >= least
            i, j, similarity = i[fit], j[fit] + at, similarity[fit]
            ours.add(i, j, similarity)
            if x != y:
                theirs.add(j, i + start, similarity)
            ours.settled()
        i, j, similarity = ours.pairs[0]
        found.append((heads[i + start], others[j], similarity))
    j, i, similarity = theirs.settled()
    found.append((others[j], heads[i], similarity))
    return pa.table(dict(zip(("a", "b", "similarity"), (np.concatenate(c) for c in zip(*found, strict=True)), strict=True)))


def item_sets(entries: DataFrame, least: int, most: int | None = None, shortest: int = 1, longest: int | None = None) -> DataFrame:
    """Sets of columns that at least ``least`` rows (and ``most``, if given) have together: ``items array`` in order and ``freq long``, for sets of ``shortest`` to ``longest`` columns.

    By FP-growth over all rows; it finds longer sets too, which are left out.
    """
    from pyspark.ml.fpm import FPGrowth

    baskets = saved(entries.groupBy("row").agg(F.collect_set("col").alias("items")))
    rows = baskets.count()
    if not rows:
        return baskets.select("items", F.lit(0).cast("long").alias("freq"))
    found = FPGrowth(minSupport=min(1.0, (least - 0.5) / rows), itemsCol="items").fit(baskets).freqItemsets
    size = F.size("items")
    found = found.filter((F.col("freq") >= least) & (size >= shortest))
    if most is not None:
        found = found.filter(F.col("freq") <= most)
    if longest is not None:
        found = found.filter(size <= longest)
    return found.select(F.array_sort("items").alias("items"), "freq")


def symmetric(edges: DataFrame, how: str = "max") -> DataFrame:
    """Edges in both directions; where both are there, the larger, smaller or summed weight."""
    f = {"max": F.max, "min": F.min, "sum": F.sum}[how]
    return edges.select("a", "b", "w").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("a", "b").agg(f("w").alias("w"))


def page_rank(edges: DataFrame, rounds: int = 10, follow: float = 0.85, restart: DataFrame | None = None, tolerance: float = 0.0) -> DataFrame:
    """``node, rank`` of a random walk that starts, and restarts with 1 - ``follow``, by the shares of ``restart``.

    ``restart`` is ``node, share``, the shares adding up to 1; all nodes alike without it.  Nodes without
    out-edges lead back there as well.  Ends after so many rounds, or once no rank moves by ``tolerance`` or more.
    """
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b"))
    if restart is None:
        nodes = saved(nodes.distinct())
        home = nodes.withColumn("share", F.lit(1.0 / max(nodes.count(), 1)))
    else:
        named = nodes.select("node", F.lit(0.0).alias("share")).unionByName(restart.select("node", "share"))
        home = saved(named.groupBy("node").agg(F.sum("share").alias("share")))
    out = edges.groupBy("a").agg(F.sum("w").alias("out"))
    steps = saved(edges.join(out, "a").select("a", "b", (F.col("w") / F.col("out")).alias("p")))
    sinks = saved(home.join(out, home["node"] == out["a"], "left_anti").select("node"))
    ranks = home.select("node", F.col("share").alias("rank"))
    for _ in range(rounds):
        lost = ranks.join(sinks, "node", "left_semi").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        moved = steps.join(ranks, steps["a"] == ranks["node"]).groupBy("b").agg(F.sum(F.col("rank") * F.col("p")).alias("moved"))
        came = F.lit(1 - follow + follow * lost) * F.col("share") + follow * F.coalesce("moved", F.lit(0.0))
        before, ranks = ranks, saved(home.join(moved, home["node"] == moved["b"], "left").select("node", came.alias("rank")))
        if tolerance > 0:
            most = ranks.join(before.withColumnRenamed("rank", "old"), "node").agg(F.max(F.abs(F.col("rank") - F.col("old")))).first()[0]
            if most is None or most < tolerance:
                break
    return ranks


def shortest_paths(edges: DataFrame, start: int) -> DataFrame:
    """``node, distance, hops`` from a start node along weights that are not negative; the fewest hops among shortest paths."""
    spark = edges.sparkSession
    best = spark.createDataFrame([(start, 0.0, 0)], "node long, distance double, hops long")
    steps = saved(edges.select(F.col("a").cast("long").alias("node"), F.col("b").cast("long").alias("next"), F.col("w").cast("double").alias("w")))
    front = best
    while True:
        reached = front.join(steps, "node").select(F.col("next").alias("node"), (F.col("distance") + F.col("w")).alias("distance"), (F.col("hops") + 1).alias("hops"))
        merged = saved(best.unionByName(reached).groupBy("node").agg(F.min(F.struct("distance", "hops")).alias("m")).select("node", "m.distance", "m.hops"))
        front = saved(merged.join(best, ["node", "distance", "hops"], "left_anti"))
        best = merged
        if front.isEmpty():
            return best


def roc(scored: DataFrame, score: str, positive: str) -> DataFrame:
    """One row: ``n, positives, area`` under the ROC curve, by summed ranks with ties at half."""
    levels = scored.groupBy(score).agg(F.count("*").alias("n"), F.sum(F.col(positive).cast("long")).alias("p")).withColumn("q", F.col("n") - F.col("p"))
    counted = sums_before(levels, [score], {"q_below": F.col("q")})
    total = counted.agg(F.sum("n").alias("n"), F.sum("p").alias("positives"), F.sum("q").alias("q"), F.sum(F.col("p") * (F.col("q_below") + F.col("q") / 2)).alias("won"))
    return total.select("n", "positives", (F.col("won") / (F.col("positives") * F.col("q"))).alias("area"))


def ranking(scored: DataFrame, score: str, positive: str, key: str) -> DataFrame:
    """One row on a list from the highest score down, ties by key: ``n, positives, accuracy, median_false``.

    ``accuracy``: the best percentage of right verdicts that a cut after some row gives.
    ``median_false``: the share of negatives ahead of the positive at half the list's positives; null
    without negatives, 0 without positives.  An empty table gives 0 rows counted and nulls.
    """
    rows = scored.select(F.col(score).alias("s"), F.col(key).alias("k"), F.coalesce(F.col(positive).cast("long"), F.lit(0)).alias("p")).withColumn("q", 1 - F.col("p"))
    totals = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("p"), F.lit(0)).alias("positives"), F.coalesce(F.sum("q"), F.lit(0)).alias("negatives"))
    ahead = sums_before(rows, [F.desc("s"), F.asc("k")], {"tp": F.col("p"), "fp": F.col("q")}).crossJoin(F.broadcast(totals))  # one row
    right = F.col("tp") + F.col("p") + F.col("negatives") - F.col("fp") - F.col("q")
    middle = (F.col("p") == 1) & (F.col("tp") + 1 == F.floor((F.col("positives") + 1) / 2))
    found = ahead.agg(F.max(100.0 * right / F.col("n")).alias("accuracy"), F.coalesce(F.max(F.when(middle, F.col("fp"))), F.lit(0)).alias("before"))
    return totals.crossJoin(F.broadcast(found)).select("n", "positives", "accuracy", F.when(F.col("negatives") > 0, F.col("before") / F.col("negatives")).alias("median_false"))


def first_negatives(scored: DataFrame, score: str, positive: str, key: str, limit: int) -> DataFrame:
    """One row on a list from the highest score down, ties by key, up to its ``limit``-th negative: ``positives`` of the whole list, ``tp`` and ``fp`` up to there, ``area``.

    ``area`` is that under the ROC curve over these negatives, as a share of all positives times ``fp``.  Rows of equal scores are a straight piece of the curve,
    whose area is rounded down to a whole number.  Without a positive up to there, without negatives and for an empty table it is 0.
    """
    rows = scored.select(F.col(score).alias("s"), F.col(key).alias("k"), F.coalesce(F.col(positive).cast("long"), F.lit(0)).alias("p")).withColumn("q", 1 - F.col("p"))
    whole = rows.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("positives"))
    ahead = sums_before(rows, [F.desc("s"), F.asc("k")], {"fp": F.col("q")}).filter(F.col("fp") < limit)
    levels = saved(ahead.groupBy("s").agg(F.sum("p").alias("p"), F.sum("q").alias("q")))
    pieces = sums_before(levels, [F.desc("s")], {"before": F.col("p")})
    won = F.sum(F.floor((2 * F.col("before") + F.col("p")) * F.col("q") / 2))
    found = pieces.agg(*(F.coalesce(x, F.lit(0)).alias(n) for n, x in (("tp", F.sum("p")), ("fp", F.sum("q")), ("won", won))))
    area = F.when(F.col("tp") * F.col("fp") > 0, F.col("won") / (F.col("positives") * F.col("fp"))).otherwise(0.0)
    return whole.crossJoin(F.broadcast(found)).select("positives", "tp", "fp", area.alias("area"))  # one row


def submatrix(entries: DataFrame, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None) -> DataFrame:
    """Entries of the rows and columns in ranges ``(first, number)``, which count from 0 in the result; None takes all."""
    for name, part in (("row", rows), ("col", cols)):
        if part is not None:
            first, n = part
            entries = entries.filter(F.col(name).between(first, first + n - 1)).withColumn(name, F.col(name) - first)
    return entries


def picked_rows(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of a list ``position, row`` under their positions; a row that is listed twice comes twice."""
    return wanted.select("position", "row").join(entries, "row").select(F.col("position").alias("row"), *(c for c in entries.columns if c != "row"))


def part_rows(entries: DataFrame, parts: DataFrame) -> DataFrame:
    """The matrix of every part: ``part, row, whole_row, col, val``, rows counted from 0 within the part in the order of the whole.

    ``parts``: ``row, part``, a row for each row of the matrix, also for those without entries, which count.  A part may hold most rows: numbers come
    from running sums over ranges.
    """
    numbered = running_before(parts.select("part", "row"), "part", ["row"], {"position": F.lit(1)}, {})
    return numbered.join(entries, "row").select("part", F.col("position").alias("row"), F.col("row").alias("whole_row"), "col", "val")


def permutation(ids: DataFrame, seed: int) -> DataFrame:
    """``id, position``: a pseudo-random order of distinct ids, the same for a seed wherever it runs; positions count from 0."""
    mixed = ids.select("id", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"))).alias("_mixed"))
    return sums_before(mixed, ["_mixed", "id"], {"position": F.lit(1)}).select("id", "position")


def renumbered(entries: DataFrame, order: DataFrame, by: str = "row") -> DataFrame:
    """The entries with rows, columns or ``both`` under their positions in an order ``id, position``; what has none is left out.

    With ``both`` and the positions of some nodes it is the subgraph that they induce.
    """
    for name in ("row", "col") if by == "both" else (by,):
        entries = entries.join(order.select(F.col("id").alias(name), "position"), name).drop(name).withColumnRenamed("position", name)
    return entries.select("row", "col", "val")


def pair_similarity(entries: DataFrame, pairs: DataFrame, measure: str = "cosine", whole: bool = True) -> DataFrame:
    """``a, b, similarity`` of given pairs of rows: ``cosine``, ``tanimoto``, ``min`` or ``amin`` as in ``similar_rows``; 0 where the measure's divisor is not positive, also for rows without entries.

    With ``whole=False`` sums stop where the shorter of both rows ends: columns after the lesser of both last ones do not count.
    """
    if measure not in ("cosine", "tanimoto", "min", "amin"):
        raise ValueError(f"unknown measure {measure}")
    pairs = pairs.select("a", "b").distinct()
    size = F.col("val") * F.col("val") if measure in ("cosine", "tanimoto") else F.col("val")
    last = entries.groupBy("row").agg(F.max("col").alias("last"))
    named = saved(pairs.join(last.select(F.col("row").alias("a"), F.col("last").alias("_la")), "a", "left").join(last.select(F.col("row").alias("b"), F.col("last").alias("_lb")), "b", "left").withColumn("_last", F.least("_la", "_lb")).select("a", "b", "_last", F.col("_la").isNotNull() & F.col("_lb").isNotNull()).toDF("a", "b", "_last", "_both"))
    sides = [named.join(entries.select(F.col("row").alias(x), F.col("col").alias("_col"), size.alias("_size"), F.col("val").alias("_val")), x).select("a", "b", "_last", "_both", "_col", *(c.alias(n) for n, c in ((f"v{x}", F.col("_val")), (f"s{x}", F.col("_size")), (f"v{y}", F.lit(None).cast("double")), (f"s{y}", F.lit(None).cast("double"))))) for x, y in ("ab", "ba")]
    met = sides[0].unionByName(sides[1])
    if not whole:
        met = met.filter(F.col("_both") & (F.col("_col") <= F.col("_last")))
    cells = met.groupBy("a", "b", "_col").agg(*(F.max(c).alias(c) for c in ("va", "sa", "vb", "sb")))
    common = F.col("va") * F.col("vb") if measure in ("cosine", "tanimoto") else F.when(F.col("va").isNotNull() & F.col("vb").isNotNull(), F.least("va", "vb"))
    sums = cells.groupBy("a", "b").agg(*(F.coalesce(F.sum(c), F.lit(0.0)).alias(n) for n, c in (("x", common), ("p", F.col("sa")), ("q", F.col("sb")))))
    divisor = {"cosine": F.sqrt(F.col("p") * F.col("q")), "amin": F.col("p")}.get(measure, F.col("p") + F.col("q") - F.col("x"))
    return pairs.join(sums, ["a", "b"], "left").select("a", "b", F.coalesce(F.when(divisor > 0, F.col("x") / divisor), F.lit(0.0)).alias("similarity"))
