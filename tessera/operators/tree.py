"""Adaptive quadtrees and octrees over points: refinement to a fixpoint, 2:1 balance and interface roles.

``axes`` names the integer coordinates: two of them make a quadtree, three an octree.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.tables import saved


def node_counts(points: DataFrame, max_level: int, axes: str = "ij") -> DataFrame:
    """Points in the nodes of all levels, ``level, axes, n``, for coordinates at ``max_level``; nodes without points have no row."""
    counts = saved(points.groupBy(*axes).agg(F.count("*").alias("n")))
    levels = F.explode(F.sequence(F.lit(0), F.lit(max_level)))
    return (
        counts.select(levels.alias("level"), *axes, "n")
        .select("level", *(F.expr(f"shiftright({c}, {max_level} - level)").alias(c) for c in axes), "n")
        .groupBy("level", *axes).agg(F.sum("n").alias("n"))
    )


def refine(points: DataFrame, max_level: int, most: int, axes: str = "ij") -> DataFrame:
    """Leaves ``level, axes, n`` of a tree over points with coordinates at ``max_level``: a node with more than ``most`` points splits.

    Counts of all levels come from one pass by shifting the coordinates; empty leaves next to
    occupied ones are leaves too.
    """
    nodes = saved(node_counts(points, max_level, axes))
    split = nodes.filter((F.col("n") > most) & (F.col("level") < max_level)).select("level", *axes)
    root = points.sparkSession.range(1).select(F.lit(0).alias("level"), *(F.lit(0).cast("long").alias(c) for c in axes))
    candidates = children(split, axes).unionByName(root)
    leaves = candidates.join(split, ["level", *axes], "left_anti").join(nodes, ["level", *axes], "left")
    return leaves.select("level", *axes, F.coalesce("n", F.lit(0)).alias("n"))


def children(split: DataFrame, axes: str, extra: Sequence[str] = ()) -> DataFrame:
    """The cells one level finer, with the extra columns of their parents."""
    part = F.explode(F.sequence(F.lit(0), F.lit(2 ** len(axes) - 1)))
    return split.select((F.col("level") + 1).alias("level"), *axes, *extra, part.alias("_part")).select(
        "level", *((F.col(c) * 2 + F.shiftright("_part", d) % 2).cast("long").alias(c) for d, c in enumerate(axes)), *extra
    )


def _moved(offsets: list[tuple[int, ...]], axes: str) -> Column:
    return F.explode(F.array(*(F.struct(*(F.lit(o).alias(c) for c, o in zip(axes, offset, strict=True))) for offset in offsets)))


def balance(leaves: DataFrame, max_level: int, axes: str = "ij") -> DataFrame:
    """Splits leaves until neighbours, over faces, edges and corners, differ by one level at most: ``level, axes``.

    From the finest level up, the parent of every leaf needs all its neighbours to exist at the
    parent's level; each such cell forces its ancestors to split.
    """
    key = ["level", *axes]
    current = saved(leaves.select(F.col("level").cast("int").alias("level"), *(F.col(c).cast("long").alias(c) for c in axes)))
    near = _moved(list(product((-1, 0, 1), repeat=len(axes))), axes)
    width = F.expr("shiftleft(1L, level)")
    while True:
        parents = current.filter("level >= 2").select((F.col("level") - 1).alias("level"), *(F.shiftright(c, 1).alias(c) for c in axes)).distinct()
        wanted = parents.select(*key, near.alias("d")).select("level", *((F.col(c) + F.col(f"d.{c}")).alias(c) for c in axes))
        for c in axes:
            wanted = wanted.filter((F.col(c) >= 0) & (F.col(c) < width))
        up = F.explode(F.sequence(F.lit(1), F.col("level")))
        above = wanted.distinct().select(*key, up.alias("u")).select((F.col("level") - F.col("u")).alias("level"), *(F.expr(f"shiftright({c}, u)").alias(c) for c in axes))
        coarse = saved(current.join(above.distinct(), key, "left_semi"))
        if coarse.isEmpty():
            return current
        current = saved(current.join(coarse, key, "left_anti").unionByName(children(coarse, axes)))


def interfaces(leaves: DataFrame, axes: str = "ij") -> DataFrame:
    """Pairs of a leaf and a neighbour over a face one level finer: ``level, axes`` and ``fine_`` of each axis."""
    within = list(product((0, 1), repeat=len(axes) - 1))
    offsets = [(*w[:d], side, *w[d:]) for d in range(len(axes)) for side in (-1, 2) for w in within]
    asked = leaves.select("level", *axes, _moved(offsets, axes).alias("d")).select("level", *axes, *((2 * F.col(c) + F.col(f"d.{c}")).alias(f"fine_{c}") for c in axes))
    fine = leaves.select((F.col("level") - 1).alias("level"), *(F.col(c).alias(f"fine_{c}") for c in axes))
    return asked.join(fine, ["level", *(f"fine_{c}" for c in axes)]).select("level", *axes, *(f"fine_{c}" for c in axes))
