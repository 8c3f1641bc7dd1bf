"""Partition graphs from the cells of a tree: atoms at a block level with their work, edges with their traffic.

Cells: ``level int``, whole coordinates at that level on each axis, ``cell_type`` (as in ``shapes``)
and ``members``, the number of faces a boundary cell belongs to.  Dry cells take no part.  With a column ``role``, as
``grid_pool.cell_pool`` gives it, auxiliary cells cost their part and belong where the cell does that they stand for.
An atom is the ancestor of its cells at the block level, or a coarser leaf; it is known by ``atom``, a struct of
level and coordinates.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.grid_pool import AUXILIARY
from tessera.operators.partition import message_time
from tessera.operators.shapes import BOUNDARY, DRY, _links


@dataclass(frozen=True)
class Costs:
    """What an update of a wet cell costs, each face of a boundary cell on top, an auxiliary cell and a coarse-fine pair; a factor for each level (1 if there are none); weight and bytes of a link and of a pair."""

    wet: float = 1.0
    each_face: float = 1.0
    auxiliary: float = 0.25
    each_pair: float = 1.0
    levels: tuple[float, ...] = ()
    link_weight: float = 1.0
    pair_weight: float = 1.0
    link_bytes: float = 8.0
    pair_bytes: float = 64.0

    def __post_init__(self) -> None:
        values = [self.wet, self.each_face, self.auxiliary, self.each_pair, *self.levels, self.link_weight, self.pair_weight, self.link_bytes, self.pair_bytes]
        if not all(0 <= x < float("inf") for x in values) or not all(x > 0 for x in (self.wet, *self.levels)):
            raise ValueError("costs have to be finite and not negative, those of wet cells and levels positive")

    def of(self, level: Column) -> Column:
        """A level is updated twice as often as the one above it, whatever an update costs there."""
        rate = F.pow(F.lit(2.0), level)
        if not self.levels:
            return rate
        factor = F.get(F.array(*map(F.lit, self.levels)), level.cast("int"))
        return rate * F.when(factor.isNull(), F.raise_error(F.lit("the costs do not cover all levels"))).otherwise(factor)


COSTS = Costs()


def atom_of(level: Column, coordinates: list[Column], names: str, block_level: int) -> Column:
    """The atom of a cell: cells finer than the block level go to their ancestor there."""
    up = F.greatest(level - block_level, F.lit(0)).cast("int")
    return F.struct(F.least(level, F.lit(block_level)).cast("int").alias("level"), *(F.call_function("shiftright", c.cast("long"), up).alias(n) for c, n in zip(coordinates, names, strict=True)))


def _rate(level: Column) -> Column:
    """A level is updated twice as often as the one above it."""
    return F.pow(F.lit(2.0), level)


def _own(cells: DataFrame, axes: str, block_level: int) -> DataFrame:
    """Cells that take part, with their ``atom`` and ``_stands_in``: whether they are auxiliary."""
    auxiliary = F.col("role") == AUXILIARY if "role" in cells.columns else F.lit(False)
    taken = cells.withColumn("_stands_in", auxiliary).filter(F.col("_stands_in") | (F.col("cell_type") != DRY))
    up = F.when(F.col("_stands_in"), 1).otherwise(0)
    return taken.withColumn("atom", atom_of(F.col("level") - up, [F.call_function("shiftright", F.col(c).cast("long"), up) for c in axes], axes, block_level))


def _pair_atoms(pairs: DataFrame, axes: str, block_level: int) -> DataFrame:
    """Pairs as ``tree.interfaces`` gives them, as ``a, b`` (atoms of the coarse and the fine cell) and the coarse ``level``."""
    coarse = atom_of(F.col("level"), [F.col(c) for c in axes], axes, block_level)
    fine = atom_of(F.col("level") + 1, [F.col(f"fine_{c}") for c in axes], axes, block_level)
    return pairs.select(coarse.alias("a"), fine.alias("b"), "level")


def atoms(cells: DataFrame, pairs: DataFrame, block_level: int, axes: str = "ij", costs: Costs = COSTS) -> DataFrame:
    """``atom, work, cells``: what its cells cost a step of the coarsest level, and half of each coarse-fine pair it takes part in.

    A boundary cell pays once for each of its faces, and once without any; an auxiliary cell pays as often as the level it stands for.
    """
    extra = F.when(F.col("cell_type") == BOUNDARY, costs.each_face * F.greatest(F.coalesce("members", F.lit(0)), F.lit(1))).otherwise(F.lit(0.0))
    work = F.when(F.col("_stands_in"), costs.auxiliary * costs.of(F.greatest(F.col("level") - 1, F.lit(0)))).otherwise((costs.wet + extra) * costs.of(F.col("level")))
    own = _own(cells, axes, block_level).select("atom", work.alias("work"), F.lit(1).cast("long").alias("cells"))
    shared = _pair_atoms(pairs, axes, block_level).select(F.explode(F.array("a", "b")).alias("atom"), (0.5 * costs.each_pair * costs.of(F.col("level"))).alias("work"), F.lit(0).cast("long").alias("cells"))
    return own.unionByName(shared).groupBy("atom").agg(F.sum("work").alias("work"), F.sum("cells").alias("cells"))


def level_work(cells: DataFrame, owners: DataFrame, block_level: int, axes: str = "ij", costs: Costs = COSTS) -> DataFrame:
    """``rank, level, work, real, auxiliary``: work and cells of each rank by level, without pairs; owners are ``atom, rank``."""
    extra = F.when(F.col("cell_type") == BOUNDARY, costs.each_face * F.greatest(F.coalesce("members", F.lit(0)), F.lit(1))).otherwise(F.lit(0.0))
    work = F.when(F.col("_stands_in"), costs.auxiliary * costs.of(F.greatest(F.col("level") - 1, F.lit(0)))).otherwise((costs.wet + extra) * costs.of(F.col("level")))
    own = _own(cells, axes, block_level).join(owners, "atom")
    return own.groupBy("rank", "level").agg(F.sum(work).alias("work"), F.count_if(~F.col("_stands_in")).alias("real"), F.count_if(F.col("_stands_in")).alias("auxiliary"))


def edges(cells: DataFrame, pairs: DataFrame, block_level: int, axes: str = "ij", model: str | None = None, costs: Costs = COSTS) -> DataFrame:
    """``a, b, weight, bytes, phases`` between different atoms, a before b.

    Links join real cells of one level in the directions of the lattice ``model`` (D2Q9 or D3Q19 if none is named), each pair once, by an equi-join on
    moved coordinates.  Bit l of the phases stands for links of level l, bit l + 32 for pairs.  Counts come
    first, so that sums do not depend on their order.
    """
    own = _own(cells, axes, block_level).filter(~F.col("_stands_in")).select("level", *axes, "atom")
    vectors = [tuple(int(x) for x in step[: len(axes)]) for _, *step, _ in _links(model or f"D{len(axes)}Q{9 if len(axes) == 2 else 19}")]
    ahead = [d for d in vectors if d > (0,) * len(axes)]  # one of each two opposite directions
    moves = F.inline(F.array(*(F.struct(*(F.lit(x).alias(f"d{c}") for c, x in zip(axes, d, strict=True))) for d in ahead)))
    asked = own.select("level", *axes, F.col("atom").alias("a"), moves).select("level", *((F.col(c) + F.col(f"d{c}")).alias(c) for c in axes), "a")
    links = asked.join(own.withColumnRenamed("atom", "b"), ["level", *axes]).select("a", "b", "level", F.lit(0).alias("kind"))
    met = links.unionByName(_pair_atoms(pairs, axes, block_level).withColumn("kind", F.lit(1))).filter("a <> b")
    counted = met.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "level", "kind").agg(F.count("*").alias("n"))
    scaled = F.col("n") * _rate(F.col("level"))
    by_kind = lambda link, pair: scaled * F.when(F.col("kind") == 0, link).otherwise(pair)
    return counted.groupBy("a", "b").agg(
        F.sum(by_kind(costs.link_weight, costs.pair_weight)).alias("weight"), F.sum(by_kind(costs.link_bytes, costs.pair_bytes)).alias("bytes"), F.bit_or(F.expr("shiftleft(1L, cast(level + 32 * kind as int))")).alias("phases")
    )


def rank_costs(found: DataFrame, between: DataFrame, owners: DataFrame, latency: float, bandwidth: float) -> DataFrame:
    """Of each rank: ``rank, atoms, work, largest, cut, peers, time``; owners are ``atom, rank``.

    ``cut`` is the weight of its edges to other ranks, ``time`` what its messages take, one for each
    phase with each peer.  Ranks without cut edges have 0 there.
    """
    loads = found.join(owners, "atom").groupBy("rank").agg(F.count("*").alias("atoms"), F.sum("work").alias("work"), F.max("work").alias("largest"))
    a = owners.select(F.col("atom").alias("a"), F.col("rank").alias("rank_a"))
    b = owners.select(F.col("atom").alias("b"), F.col("rank").alias("rank_b"))
    crossing = between.join(a, "a").join(b, "b").filter("rank_a <> rank_b")
    traffic = crossing.groupBy(F.least("rank_a", "rank_b").alias("rank_a"), F.greatest("rank_a", "rank_b").alias("rank_b")).agg(
        F.sum("weight").alias("weight"), F.sum("bytes").alias("bytes"), F.bit_or("phases").alias("phases")
    )
    ends = traffic.select(F.explode(F.array("rank_a", "rank_b")).alias("rank"), "weight", message_time(F.col("phases"), F.col("bytes"), latency, bandwidth).alias("time"))
    costs = ends.groupBy("rank").agg(F.sum("weight").alias("cut"), F.count("*").alias("peers"), F.sum("time").alias("time"))
    return loads.join(costs, "rank", "left").fillna(0, ["cut", "peers", "time"])
