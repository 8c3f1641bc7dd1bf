"""Hard negatives by coordinate pruning in buckets of vectors of like length."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.top_k import _rows, _scores
from tessera.plans.tables import saved

#: Rows of a bucket's part, and anchors that meet it at a time.
PART, ASKED = 4096, 512
#: Lengths of a bucket lie within this factor, so there are at most some hundred buckets.
GROWTH = 1.25
#: Coordinates of an anchor, the largest first, whose feasible ranges are intersected.
FOCUS = 6
#: Feasible ranges that hold more than this share of a part rule too little out to be intersected.
WIDE = 0.5
#: Bounds are widened by this much. Doubles lose about width * 2**-52.
SLACK = 1e-9


def mine_hard_negatives(
    vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, id_col: str = "vec_id", vector_col: str = "vector", label_col: str = "label"
) -> DataFrame:
    """Finds for each anchor its nearest rows of the same label and, for each of those, hard negatives.

    ``vectors``: ``id_col long, vector_col array<long>`` of integers, ``label_col``.  ``anchors``: ``id_col`` of the
    rows that are anchors.  A score is the inner product with the anchor; the higher comes first, then the smaller id.
    An anchor's positives are its first ``positives`` other rows of its label.  For each of them its negatives are the first ``negatives`` rows
    of other labels whose score is at least ``low`` and at most ``high`` hundredths of the positive's.  Returns ``anchor_id,
    positive_id, rank int`` (from 1), ``negative_id, positive_score, negative_score``; fewer rows where there are fewer.

    Method: buckets of vectors of like length, cut by a hash of the id into parts of about 4096 rows, so that neither a
    common length nor a common label meets in one task.  Each anchor is solved in one part first, which gives it a
    floor; buckets too short to reach it are left out.  A part sorts the values of a coordinate, of vectors of unit
    length, once.  By Cauchy and Schwarz a row whose cosine with the anchor is at least t (at most u) has a value x of a coordinate where
    the anchor has f with ``f x + sqrt((1 - f^2)(1 - x^2)) >= t`` (``f x - sqrt(...) <= u``), which is a range of the sorted list; the ranges of the anchor's six
    largest coordinates are intersected and what is left is verified in integers.  Positives are sought among the parts of the label, negatives among all.

    What this prunes depends on the data: much where scores come near the product of the lengths, next to nothing where all directions are alike.

    Rows with a null id, label or vector, or a null component, take no part; of rows that share an id the smallest (vector, label) counts.  A
    shorter vector counts as filled up with zeros.  An anchor without another row of its label, or a positive with a negative score, has no
    rows.  Scores have to fit a long.  Empty tables give no rows; other columns are not read.
    """
    whole = F.coalesce(F.forall(vector_col, lambda c: c.isNotNull()), F.lit(False))
    table = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<long>").alias("vector"), F.col(f"`{label_col}`").cast("string").alias("label"))
    table = table.withColumnRenamed("vector", vector_col).filter(whole & F.col("id").isNotNull() & F.col("label").isNotNull()).withColumnRenamed(vector_col, "vector")
    data = table.groupBy("id").agg(F.min(F.struct("vector", "label")).alias("row")).select("id", "row.*")
    squares = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    data = saved(data.withColumn("size", F.sqrt(squares)).withColumn("bucket", F.when(F.col("size") > 0, F.floor(F.log("size") / F.log(F.lit(GROWTH)))).otherwise(-1)))
    width = data.agg(F.max(F.size("vector"))).first()[0] or 0
    ids = anchors.select(F.col(f"`{id_col}`").cast("long").alias("id")).dropna().distinct()
    asked = saved(data.join(ids, "id", "left_semi").select("id", "vector", "label", "size"))

    any_want = F.array(F.struct(F.lit(0).cast("long").alias("want"), F.lit(None).cast("long").alias("least"), F.lit(None).cast("long").alias("most")))
    same = _found(asked.withColumn("wants", any_want), data, "label", width, positives, same=True)
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "found_id")
    near = saved(same.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= positives).select("anchor_id", F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score")))

    ceiling = lambda n: -F.floor(-F.col("positive_score") * n / F.lit(100).cast("decimal(38,0)"))
    least, most = ceiling(F.lit(low).cast("decimal(3,0)")).cast("long"), F.floor(F.col("positive_score") * F.lit(high).cast("decimal(3,0)") / F.lit(100).cast("decimal(38,0)")).cast("long")
    wanted = near.select("anchor_id", F.col("positive_id").alias("want"), least.alias("least"), most.alias("most")).filter("least <= most")
    wanted = wanted.groupBy(F.col("anchor_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("want", "least", "most"))).alias("wants"))  # a few for each anchor
    other = _found(asked.join(wanted, "id"), data, None, width, negatives, same=False)
    order = Window.partitionBy("anchor_id", "want").orderBy(F.desc("score"), "found_id")
    ranked = other.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives).withColumnRenamed("want", "positive_id")
    return ranked.join(near, ["anchor_id", "positive_id"]).select("anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


_FOUND = "anchor_id long, want long, found_id long, score long"


def _found(asked: DataFrame, data: DataFrame, group: str | None, width: int, k: int, same: bool) -> DataFrame:
    """At least the k best rows for each want of each anchor; parts are those of a group, or of all rows."""
    by = [group] if group else []
    label = F.col("label") if group else F.lit("")
    data, asked = data.withColumn("of", label), asked.withColumn("of", label)
    sizes = data.groupBy("of", "bucket").agg(F.count("*").alias("n"), F.min("size").alias("shortest"), F.max("size").alias("longest"))
    sizes = saved(sizes.withColumn("parts", F.ceil(F.col("n") / PART).cast("long")))
    counts = asked.groupBy("of").agg(F.ceil(F.count("*") / ASKED).cast("long").alias("chunks"))
    hashed = F.xxhash64("id", F.lit(12))
    bounded = (lambda df: df) if by else F.broadcast  # without groups there is a row for each bucket

    chunked = asked.join(bounded(counts), "of").withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(5)), "chunks"))
    about = saved(sizes.join(bounded(counts), "of"))
    parts = data.join(bounded(about), ["of", "bucket"]).withColumn("part", F.pmod(hashed, "parts"))
    parts = saved(parts.select("of", "bucket", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), "id", "vector", "label", "size"))

    filled = F.struct(F.least("n", F.lit(PART // 4)), "bucket", "parts")  # the longest vectors, unless there are few of them
    first = about.groupBy("of").agg(F.max(filled).alias("first")).select("of", F.col("first.bucket").alias("home"), F.col("first.parts").alias("home_parts"))
    chunked = saved(chunked.join(bounded(first), "of").withColumn("home_part", F.pmod(hashed, "home_parts")))
    columns = ["of", "bucket", "part", "chunk", "id", "vector", "label", "size", "wants"]
    start = _solved(chunked.withColumns({"bucket": F.col("home"), "part": F.col("home_part")}).select(columns), parts, width, k, same)
    start = saved(start)
    order = Window.partitionBy("anchor_id", "want").orderBy(F.desc("score"))
    floors = start.withColumn("n", F.row_number().over(order)).filter(F.col("n") == k).groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("want", "score"))).alias("floors"))

    floored = F.transform("wants", lambda w: F.struct(w["want"].alias("want"), F.greatest(w["least"], F.try_element_at("floors", w["want"])).alias("least"), w["most"].alias("most")))
    known = chunked.join(floors, chunked["id"] == floors["anchor_id"], "left").withColumn("wants", floored).drop("floors", "anchor_id")
    reach = F.col("size") * F.col("longest") * (1 + SLACK) + 1
    spread = known.join(bounded(about.drop("chunks", "n")), "of").filter(F.exists("wants", lambda w: w["least"].isNull() | (w["least"] <= reach)))
    spread = spread.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).filter((F.col("bucket") != F.col("home")) | (F.col("part") != F.col("home_part")))
    return start.unionByName(_solved(spread.select(columns), parts, width, k, same))


def _solved(asked: DataFrame, parts: DataFrame, width: int, k: int, same: bool) -> DataFrame:
    key = ["of", "bucket", "part", "chunk"]
    return asked.groupBy(key).cogroup(parts.groupBy(key)).applyInArrow(partial(_solve, width=width, k=k, same=same), _FOUND)


def feasible(f: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For unit vectors with a coordinate f: the range of that coordinate of all unit vectors at a cosine from ``least`` to ``most``.

    A cosine of t at an angle of arccos(f) from the axis leaves arccos(f) +- arccos(t) for the other vector, so its
    coordinate is largest at the difference of both angles; cosines up to ``most`` and from ``least`` widen that to a range of angles.
    """
    own = np.arccos(np.clip(f, -1, 1))
    near, far = np.arccos(np.clip(most, -1, 1)), np.arccos(np.clip(least, -1, 1))  # angles between the vectors
    # From the axis: the smallest angle is how far own lies outside [near, far], the largest own + far or its mirror image at pi.
    smallest = np.maximum(np.maximum(near - own, own - far), 0)
    total = own + far
    largest = np.where(total <= np.pi, total, np.where(own + near >= np.pi, 2 * np.pi - own - near, np.pi))
    return np.cos(np.minimum(largest, np.pi)) - SLACK, np.cos(smallest) + SLACK


def candidates(units: np.ndarray, orders: dict[int, np.ndarray], anchor: np.ndarray, least: float, most: float) -> np.ndarray | None:
    """The rows within the feasible ranges of the anchor's focus coordinates, or None where these rule out too little."""
    focus = np.argsort(-np.abs(anchor))[:FOCUS]
    low, high = feasible(anchor[focus], np.full(len(focus), least), np.full(len(focus), most))
    ranges = []
    for j, a, b in zip(focus.tolist(), low, high, strict=True):
        if j not in orders:
            orders[j] = np.argsort(units[:, j])
        values = units[:, j]
        start, end = np.searchsorted(values, [a], "left", sorter=orders[j])[0], np.searchsorted(values, [b], "right", sorter=orders[j])[0]
        ranges.append((end - start, j, start, end))
    ranges.sort()
    narrow = [r for r in ranges if r[0] <= WIDE * len(units)]
    if not narrow:
        return None
    seen = np.zeros(len(units), np.int8)
    for _, j, start, end in narrow:
        seen[orders[j][start:end]] += 1
    return np.flatnonzero(seen == len(narrow))


def _solve(asked: pa.Table, data: pa.Table, width: int, k: int, same: bool) -> pa.Table:
    """The k best rows of a part for each want of a chunk of anchors."""
    none = np.empty(0, np.int64)
    found = [(none, none, none, none)]
    if asked.num_rows and data.num_rows:
        ids = data.column("id").to_numpy()
        order = np.argsort(ids)
        data, ids = data.take(pa.array(order)), ids[order]
        v, size = _rows(data.column("vector"), width), data.column("size").to_numpy()
        q, length = _rows(asked.column("vector"), width), asked.column("size").to_numpy()
        exact = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * width < 2**53
        units = v / np.where(size > 0, size, 1)[:, None]
        turned = q / np.where(length > 0, length, 1)[:, None]
        labels = pa.chunked_array([*asked.column("label").chunks, *data.column("label").chunks]).combine_chunks().dictionary_encode().indices.to_numpy()
        own, of = labels[: len(q)], labels[len(q) :]
        orders: dict[int, np.ndarray] = {}
        shortest, longest = size.min(), size.max()
        wants, anchor_ids = asked.column("wants").to_pylist(), asked.column("id").to_pylist()
        chosen: list[np.ndarray | None] = []
        for i in range(len(q)):
            pruned = None
            if length[i] > 0 and longest > 0:  # zeros have a bucket of their own
                least, most = _cosines(wants[i], length[i], shortest, longest)
                pruned = candidates(units, orders, turned[i], least, most)
            chosen.append(pruned)
        dense = [i for i, c in enumerate(chosen) if c is None]
        all_scores = dict(zip(dense, _scores(q[dense], v, exact), strict=True)) if dense else {}
        for i, at in enumerate(chosen):
            at = np.arange(len(v)) if at is None else at
            at = at[(ids[at] != anchor_ids[i]) & ((of[at] == own[i]) == same)]
            scores = all_scores[i][at] if i in all_scores else _scores(q[i : i + 1], v[at], exact)[0]
            for want in wants[i]:
                fit = np.ones(len(at), bool)
                if want["least"] is not None:
                    fit &= scores >= want["least"]
                if want["most"] is not None:
                    fit &= scores <= want["most"]
                fit = np.flatnonzero(fit)
                if len(fit) > 4 * k:  # only what the k-th best leaves needs sorting
                    fit = fit[scores[fit] >= np.partition(scores[fit], len(fit) - k)[len(fit) - k]]
                best = fit[np.argsort(-scores[fit], kind="stable")[:k]]
                found.append((np.full(len(best), anchor_ids[i]), np.full(len(best), want["want"]), ids[at[best]], scores[best]))
    names = ["anchor_id", "want", "found_id", "score"]
    return pa.table(dict(zip(names, (np.concatenate(c) for c in zip(*found, strict=True)), strict=True)))


def _cosines(wants: list[dict], length: float, shortest: float, longest: float) -> tuple[float, float]:
    """The least and the largest cosine of a row that any want may take."""
    least, most = [w["least"] for w in wants], [w["most"] for w in wants]
    low = -1.0 if None in least else min(least) / length / (longest if min(least) > 0 else shortest)
    top = 1.0 if None in most else max(most) / length / (shortest if max(most) > 0 else longest)
    return max(low - SLACK, -1.0), min(top + SLACK, 1.0)

