"""Weighted graph partitions: work, edges, traffic, boxes, cuts and ghosts.

Atoms: ``atom_id long, lo, hi long`` (cells along an axis, hi exclusive), ``work double``.
Edges: ``a, b long, level int`` or aggregated ``weight, bytes, phases``. Owners: ``atom_id, rank``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.components import connected_components
from tessera.plans.scans import running_before, sums_before
from tessera.plans.tables import freed, saved


def edge_totals(contacts: DataFrame, by: list[str], bytes_each: float) -> DataFrame:
    """Aggregates single contacts ``a, b, level`` to edges: count first, so the sums do not depend on their order."""
    low, high = F.least("a", "b"), F.greatest("a", "b")
    keyed = contacts.filter("a <> b").select(*by, low.alias("lo"), high.alias("hi"), "level")
    counted = keyed.groupBy(*by, "lo", "hi", "level").agg(F.count("*").alias("n"))
    scaled = F.col("n") * F.pow(F.lit(2.0), F.col("level"))
    return counted.groupBy(*by, "lo", "hi").agg(
        F.sum("n").alias("contacts"), F.sum(scaled).alias("weight"), F.sum(scaled * bytes_each).alias("bytes"), F.bit_or(F.expr("shiftleft(1L, level)")).alias("phases")
    )


def message_time(phases: Column, bytes_: Column, latency: float, bandwidth: float) -> Column:
    """A message for each phase bit l, or l + 32, costs 2^l latencies; bytes cost their time on the wire."""
    sent = lambda l: F.getbit(phases, l) + F.getbit(phases, l + 32)
    waits = F.aggregate(F.sequence(F.lit(0), F.lit(30)), F.lit(0.0), lambda s, l: s + sent(l) * F.pow(F.lit(2.0), l))
    return waits * latency + bytes_ / bandwidth


def rank_loads(atoms: DataFrame, owners: DataFrame) -> DataFrame:
    """Per rank: ``atoms, work, lo, hi`` (its box), ``largest`` (its largest atom)."""
    return atoms.join(owners, "atom_id").groupBy("rank").agg(
        F.count("*").alias("atoms"), F.sum("work").alias("work"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("work").alias("largest")
    )


def imbalance(loads: DataFrame) -> DataFrame:
    """One row: ``ranks, total, most`` and ``imbalance`` (largest load over the mean)."""
    return loads.agg(F.count("*").alias("ranks"), F.sum("work").alias("total"), F.max("work").alias("most"), (F.max("work") / F.avg("work")).alias("imbalance"))


def legal_cuts(atoms: DataFrame, group: str) -> DataFrame:
    """Planes between atoms of a group that none of its atoms straddles: ``group, plane, below`` (work under the plane).

    Everything that begins before a plane must end there at the latest.  Atoms are summed by their low
    end first, and a group's planes are found range by range.
    """
    at = atoms.groupBy(group, "lo").agg(F.max("hi").alias("_hi"), F.sum("work").alias("_work")).filter("lo is not null")
    seen = running_before(at, group, ["lo"], {"below": F.col("_work")}, {"_top": F.col("_hi")})
    return seen.filter("_top <= lo").select(group, F.col("lo").alias("plane"), "below")


def bisected(atoms: DataFrame, depth: int) -> DataFrame:
    """Owners by repeated weighted bisection of the atoms' order along the axis: ``atom_id, rank``.

    Work is summed by coordinate, with the work before each coordinate from one scan by ranges.  Every
    round then splits each part where the running work passes half; a part is an interval, so its share
    of the running work starts at its smallest.  Atoms at one coordinate stay together, and those
    without a coordinate have no owner.
    """
    placed = atoms.filter("lo is not null")
    at = sums_before(placed.groupBy("lo").agg(F.sum("work").alias("w")), ["lo"], {"before": F.col("w")}).withColumn("rank", F.lit(0).cast("long"))
    for _ in range(depth):
        parts = at.groupBy("rank").agg(F.min("before").alias("start"), F.sum("w").alias("all"))
        upper = F.col("before") - F.col("start") + F.col("w") / 2 > F.col("all") / 2
        at = saved(at.join(F.broadcast(parts), "rank").select("lo", "w", "before", (F.col("rank") * 2 + upper.cast("long")).alias("rank")))  # 2 ** depth parts at most
    return placed.join(at.select("lo", "rank"), "lo").select("atom_id", "rank")


def ghosts(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """Atoms that a rank needs from another: ``rank, peer, atom_id`` for both ends of every cut edge."""
    a = owners.select(F.col("atom_id").alias("a"), F.col("rank").alias("rank_a"))
    b = owners.select(F.col("atom_id").alias("b"), F.col("rank").alias("rank_b"))
    cut = edges.select("a", "b").join(a, "a").join(b, "b").filter("rank_a <> rank_b")
    need = cut.select(F.col("rank_a").alias("rank"), F.col("rank_b").alias("peer"), F.col("b").alias("atom_id"))
    return need.unionByName(cut.select(F.col("rank_b").alias("rank"), F.col("rank_a").alias("peer"), F.col("a").alias("atom_id"))).distinct()


def local_views(owners: DataFrame, needed: DataFrame) -> DataFrame:
    """What each rank holds and under which number: ``rank, ghost boolean, atom_id, local``.

    A rank's own atoms come first and then its ghosts (``needed`` as from ``ghosts``, from any number
    of peers), both by id, numbered from 0.  Running numbers over all ranks less each rank's first one,
    so that no rank meets in one task.  Ranks without ghosts have only their atoms.
    """
    own = owners.select("rank", F.lit(False).alias("ghost"), "atom_id")
    rows = own.unionByName(needed.select("rank", F.lit(True).alias("ghost"), "atom_id").distinct())
    numbered = sums_before(rows, ["rank", "ghost", "atom_id"], {"local": F.lit(1)})
    bases = numbered.groupBy("rank").agg(F.min("local").alias("_base"))
    return numbered.join(bases, "rank").select("rank", "ghost", "atom_id", (F.col("local") - F.col("_base")).alias("local"))


def part_components(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The pieces that parts fall into: ``node, part, component``, the smallest node of the piece.

    ``edges``: ``a, b``; ``labels``: ``node, part``, each node once.  Only edges within a part connect; a node without one is a piece of its own.
    """
    a = labels.select(F.col("node").alias("a"), F.col("part").alias("part_a"))
    b = labels.select(F.col("node").alias("b"), F.col("part").alias("part_b"))
    within = edges.select("a", "b").join(a, "a").join(b, "b").filter("part_a = part_b").select("a", "b")
    found = connected_components(within).withColumnRenamed("node", "_node")
    return labels.join(found, F.col("node") == F.col("_node"), "left").select("node", "part", F.coalesce("component", F.col("node").cast("long")).alias("component"))


def contiguous(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels ``node, part`` under which no part is in several pieces, as far as the graph itself hangs together.

    ``edges``: ``a, b, w``; ``labels``: ``node, part`` and, if there is one, ``work`` (1 without).  Of each part the piece with the most work, the one with the
    smallest node of equal ones, is its core.  Every round a piece that is no core goes to the core it has the
    heaviest edges with, the smaller part of equal ones; pieces that touch no core wait for one to come nearer.  Each move joins two pieces, so rounds
    end; they are as many as pieces lie in a row.  What has no way to any core stays.
    """
    labels = saved(labels.select("node", "part", (F.col("work") if "work" in labels.columns else F.lit(1.0)).cast("double").alias("work")))
    edges = saved(edges.select("a", "b", F.col("w").cast("double").alias("w")))
    while True:
        pieces = saved(part_components(edges, labels).join(labels.select("node", "work"), "node"))
        sizes = pieces.groupBy("part", "component").agg(F.sum("work").alias("size"))
        cores = sizes.groupBy("part").agg((-F.max(F.struct("size", (-F.col("component")).alias("minus")))["minus"]).alias("component"))
        marked = saved(pieces.join(cores.withColumn("core", F.lit(True)), ["part", "component"], "left").withColumn("core", F.coalesce("core", F.lit(False))))
        ends = lambda side: marked.select(F.col("node").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("part", "component", "core")))  # noqa: E731, B023
        both = edges.join(ends("a"), "a").join(ends("b"), "b")
        ways = [both.filter(f"not core_{x} and core_{y}").select(F.col(f"component_{x}").alias("component"), F.col(f"part_{y}").alias("to"), "w") for x, y in ("ab", "ba")]
        heaviest = ways[0].unionByName(ways[1]).groupBy("component", "to").agg(F.sum("w").alias("w"))
        moves = saved(heaviest.groupBy("component").agg((-F.max(F.struct("w", (-F.col("to")).alias("minus")))["minus"]).alias("to")))
        if moves.isEmpty():
            return labels.select("node", "part")
        moved = marked.join(moves, "component", "left")
        labels = saved(moved.select("node", F.when(F.col("core"), F.col("part")).otherwise(F.coalesce("to", "part")).alias("part"), "work"))
        freed(pieces, marked, moves)
