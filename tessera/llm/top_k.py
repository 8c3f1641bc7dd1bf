"""Exact top-k search by inner product with a Voronoi join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.tables import saved

#: Most pivots, most groups of queries, and rows of a block on either side of a local join.
PIVOTS, GROUPS, BLOCK = 1024, 256, 1024
#: Cells that each query is solved in first, which gives it a floor.
NEAREST = 3
#: Bounds are widened by this share of both lengths. Doubles lose about width * 2**-52 of it.
SLACK = 1e-9


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "vector") -> DataFrame:
    """Finds for each query the k rows of ``vectors`` with the highest inner product.

    Both tables hold ``id_col long`` and ``vector_col array<long>`` of integers.  A row with
    the query's own id is no candidate.  Returns ``query_id long, rank int`` (from 1),
    ``id_col long, score long``, ties to the smaller id; all candidates if there are fewer
    than k.

    Method: Voronoi join.  There are about as many pivots as the square root of the rows, up
    to 1024; data and queries belong to the nearest one.  Along the direction u of its pivot
    a vector has a part b = v.u and a distance w from that axis, so that for any query q with
    a = q.u and a distance h from the axis, ``q.v <= a b + h w``.  First each query is solved
    in the three cells whose pivots it agrees with most: its k-th score there is its floor.
    Queries of neighbouring cells form at most 256 groups; a group's summary holds for each
    cell the range of a, the largest h and the smallest floor.  A row is sent only to the
    groups whose summary it can beat, and within a block each query looks only at the rows
    whose own bound reaches its floor.  Groups are cut into blocks of about 1024 rows by a
    hash of the id, on both sides, so no cell, however large, meets in one task.  Scores are
    integers and exact; bounds are widened by 1e-9 of both lengths, far beyond their rounding.

    What this prunes depends on the data: much where vectors form clusters, next to nothing
    where all directions are alike, since then even the true k-th score rules out no cell.

    Null vectors, and vectors that hold nulls, take no part.  A shorter vector counts as
    filled up with zeros.  Of rows that share an id the smallest vector counts.  Scores have
    to fit a long.  Empty tables give no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    data = saved(_clean(vectors, id_col, vector_col))
    asked = saved(_clean(queries, id_col, vector_col))
    rows, n_asked = data.count(), asked.count()
    if not rows or not n_asked:
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score long")
    pivots = [r["vector"] for r in data.orderBy(F.xxhash64("id"), "id").limit(min(PIVOTS, max(1, round(rows**0.5)))).collect()]
    width = max(r[0] or 0 for r in (d.agg(F.max(F.size("vector"))).first() for d in (data, asked)))
    axes = _axes(_matrix(pivots, width))
    # Neighbouring cells share a group of queries: pivots by the nearest of a few of them.
    leads = axes[: min(GROUPS, len(axes), -(-n_asked // BLOCK))]
    group_of = np.argmax(axes @ leads.T, axis=1)

    located = saved(data.mapInArrow(lambda batches: _locate(batches, axes), "id long, vector array<long>, cell int, b double, w double"))
    placed = saved(asked.mapInArrow(lambda batches: _placed(batches, axes, group_of), "id long, vector array<long>, home array<int>, part int"))
    at_home = placed.select("id", "vector", "home", F.explode("home").alias("cell"), F.lit(NO_FLOOR).alias("floor"))
    first = saved(_solved(at_home, located, ["cell"], width, k))
    best = _best(first, k)
    floors = saved(best.filter(F.col("rank") == k).select(F.col("query_id").alias("floor_id"), F.col("score").alias("floor")))
    grouped = saved(placed.join(floors, F.col("id") == F.col("floor_id"), "left").select("id", "vector", "home", "part", F.coalesce("floor", F.lit(NO_FLOOR)).alias("floor")))

    parts = grouped.mapInArrow(lambda batches: _summaries(batches, axes), "part int, cell int, least double, most double, away double, length double, floor long")
    summaries = parts.groupBy("part", "cell").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.max("away").alias("away"), F.max("length").alias("length"), F.min("floor").alias("floor"))
    bounds = _table(summaries.collect(), len(leads), len(axes))  # at most GROUPS * PIVOTS rows
    sent = located.mapInArrow(lambda batches: _needed(batches, bounds), "id long, vector array<long>, cell int, b double, w double, part int")
    rest = _solved(grouped, sent, ["part"], width, k, axes)
    return _best(first.unionByName(rest), k).select("query_id", "rank", F.col("vec_id").alias(id_col), "score")


#: Below every score.
NO_FLOOR = -(1 << 62)


def _solved(asked: DataFrame, data: DataFrame, keys: list[str], width: int, k: int, axes: np.ndarray | None = None) -> DataFrame:
    """Joins queries and rows of equal keys in pairs of blocks. With axes: but for the cells that the query was solved in first."""
    sizes = data.groupBy(keys).agg(F.count("*").alias("rows")).join(asked.groupBy(keys).agg(F.count("*").alias("asked")), keys)
    blocks = saved(sizes.select(*keys, F.ceil(F.col("rows") / BLOCK).cast("long").alias("d_blocks"), F.ceil(F.col("asked") / BLOCK).cast("long").alias("q_blocks")))
    blocks = F.broadcast(blocks)  # a row for each pivot or group
    hashed, zero = F.xxhash64("id", F.lit(3)), F.lit(0).cast("long")
    left = asked.join(blocks, keys).withColumns({"q": F.pmod(hashed, "q_blocks"), "d": F.explode(F.sequence(zero, F.col("d_blocks") - 1))})
    right = data.join(blocks, keys).withColumns({"q": F.explode(F.sequence(zero, F.col("q_blocks") - 1)), "d": F.pmod(hashed, "d_blocks")})
    by = [*keys, "q", "d"]
    left, right = left.select(*by, "id", "vector", "home", "floor"), right.select(*by, "id", "vector", F.col("cell").alias("at"), "b", "w")
    return left.groupBy(by).cogroup(right.groupBy(by)).applyInArrow(lambda q, v: _solve(q, v, width, k, axes), "query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def scaled_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, others: list[str] | None = None) -> DataFrame:
    """Vectors of floor(scale * x) for every component x, as double, and ``others`` as they are; rows with null or non-finite components go."""
    x = F.transform(vector_col, lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return table.filter(F.col(vector_col).isNotNull() & F.coalesce(fine, F.lit(False))).select(
        F.col(id_col).cast("long").alias(id_col), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("vector"), *(others or [])
    )


def _clean(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    whole = F.col(vector_col).isNotNull() & F.coalesce(F.forall(vector_col, lambda c: c.isNotNull()), F.lit(False))
    return table.filter(F.col(id_col).isNotNull() & whole).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(F.col(vector_col)).alias("vector"))


def _matrix(vectors: list[list[int]], width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for row, vector in zip(out, vectors, strict=True):
        row[: len(vector)] = vector
    return out


def _rows(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """A list column as a matrix, short rows filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    at = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]]
    length = np.diff(at)
    if (length == width).all():
        return flat.reshape(len(length), width)
    out = np.zeros((len(length), width), np.int64)
    out[np.arange(width) < length[:, None]] = flat
    return out


def _axes(pivots: np.ndarray) -> np.ndarray:
    """The pivots' directions; a pivot of zeros has none."""
    length = np.sqrt((pivots.astype(float) ** 2).sum(1, keepdims=True))
    return pivots / np.where(length > 0, length, 1)


def _lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x**2).sum(1))


def _locate(batches, axes: np.ndarray):
    """The cell of each row: the axis it lies closest to; its part along that axis and its distance from it."""
    for batch in batches:
        x = _rows(batch.column("vector"), axes.shape[1]).astype(float)
        cell = (x @ axes.T).argmax(1)
        b = (x * axes[cell]).sum(1)
        w = _lengths(x - b[:, None] * axes[cell])
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vector"), pa.array(cell, pa.int32()), pa.array(b), pa.array(w)], names=["id", "vector", "cell", "b", "w"])


def _placed(batches, axes: np.ndarray, group_of: np.ndarray):
    """The cells that each query is solved in first, the best one first, and the group of that one."""
    for batch in batches:
        x = _rows(batch.column("vector"), axes.shape[1]).astype(float)
        home = np.argsort(-(x @ axes.T), axis=1, kind="stable")[:, :NEAREST]
        lists = pa.FixedSizeListArray.from_arrays(pa.array(home.ravel(), pa.int32()), home.shape[1]).cast(pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vector"), lists, pa.array(group_of[home[:, 0]], pa.int32())], names=["id", "vector", "home", "part"])


def _away(along: np.ndarray, length: np.ndarray) -> np.ndarray:
    """At least the distance of queries from axes, by their parts along them and their lengths."""
    return np.sqrt(np.maximum(length[:, None] ** 2 * (1 + 1e-12) - along**2 * (1 - 1e-12), 0))


def _summaries(batches, axes: np.ndarray):
    """For each group and cell the range of its queries' parts along the axis, their largest distance from it, and their smallest floor."""
    for batch in batches:
        x = _rows(batch.column("vector"), axes.shape[1]).astype(float)
        part, floor, length = batch.column("part").to_numpy(), batch.column("floor").to_numpy(), _lengths(x)
        along = x @ axes.T
        away = _away(along, length)
        for g in np.unique(part):
            of = part == g
            n = len(axes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, g), pa.int32()), pa.array(np.arange(n), pa.int32()), *(pa.array(c) for c in (along[of].min(0), along[of].max(0), away[of].max(0), np.full(n, length[of].max()), np.full(n, floor[of].min())))],
                names=["part", "cell", "least", "most", "away", "length", "floor"],
            )


def _table(summaries: list, groups: int, cells: int) -> np.ndarray:
    """Five values for each cell and group; a group without queries has an infinite floor."""
    out = np.zeros((5, cells, groups))
    out[4] = np.inf
    for r in summaries:
        out[:, r["cell"], r["part"]] = r["least"], r["most"], r["away"], r["length"], r["floor"]
    return out


def _needed(batches, bounds: np.ndarray):
    """Sends each row to the groups of queries that it may serve."""
    for whole in batches:
        for at in range(0, whole.num_rows, BLOCK):
            batch = whole.slice(at, BLOCK)
            cell, b, w = (batch.column(c).to_numpy() for c in ("cell", "b", "w"))
            least, most, away, length, floor = (x[cell] for x in bounds)
            b, w = b[:, None], w[:, None]
            bound = np.maximum(least * b, most * b) + away * w + SLACK * length * (np.abs(b) + w)
            row, part = np.nonzero(bound >= floor)
            chosen = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*chosen.columns, pa.array(part, pa.int32())], names=["id", "vector", "cell", "b", "w", "part"])


def passing(q: np.ndarray, floor: np.ndarray, home: np.ndarray, cell: np.ndarray, b: np.ndarray, w: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """For each query and row whether the row's bound reaches the query's floor and its cell was not solved before."""
    length = _lengths(q)
    along = q @ axes.T
    away = _away(along, length)
    bound = along[:, cell] * b + away[:, cell] * w + SLACK * length[:, None] * (np.abs(b) + w)
    before = np.zeros((len(q), len(axes)), bool)
    np.put_along_axis(before, home, True, axis=1)
    return (bound >= floor[:, None]) & ~before[:, cell]


def _solve(asked: pa.Table, data: pa.Table, width: int, k: int, axes: np.ndarray | None) -> pa.Table:
    """The k best of a block of vectors for each of a block of queries."""
    none = np.empty(0, np.int64)
    found = [(none, none, none)]
    if asked.num_rows and data.num_rows:
        ids = data.column("id").to_numpy()
        order = np.argsort(ids)
        data = data.take(pa.array(order))
        ids, v = ids[order], _rows(data.column("vector"), width)
        q, own, floor = _rows(asked.column("vector"), width), asked.column("id").to_numpy(), asked.column("floor").to_numpy()
        exact = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * width < 2**53
        open_ = np.ones((len(q), len(v)), bool)
        if axes is not None:
            open_ = passing(q.astype(float), floor, np.array(asked.column("home").to_pylist(), np.int64), data.column("at").to_numpy(), data.column("b").to_numpy(), data.column("w").to_numpy(), axes)
        open_ &= ids != own[:, None]
        dense = open_.mean() > 0.2
        scores = _scores(q, v, exact) if dense else None
        for i, (query, least) in enumerate(zip(own, floor, strict=True)):
            at = np.flatnonzero(open_[i])
            row = scores[i, at] if dense else _scores(q[i : i + 1], v[at], exact)[0]
            fit = np.flatnonzero(row >= least)
            best = fit[np.argsort(-row[fit], kind="stable")[:k]]
            found.append((np.full(len(best), query), ids[at[best]], row[best]))
    query_id, vec_id, score = (np.concatenate(c) for c in zip(*found, strict=True))
    return pa.table({"query_id": query_id, "vec_id": vec_id, "score": score})


def _scores(q: np.ndarray, v: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products, through doubles where these are exact."""
    return np.rint(q.astype(float) @ v.T.astype(float)).astype(np.int64) if exact else q @ v.T
