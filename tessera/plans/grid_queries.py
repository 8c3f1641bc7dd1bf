"""Partition graphs over a quadtree of line items: 64 by 64 places for each block of orders, blocks side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import grid_graph, tree
from tessera.plans.geometry_queries import points
from tessera.plans.tables import saved


def _grid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    """Cells, coarse-fine pairs and the block level: the places of a block and of 64 rows are one atom of 16 by 16."""
    place = points(spark, sf_dir).select((F.col("x").cast("long") + 64 * F.col("block")).alias("i"), (F.col("y") * 5 + F.col("id") % 5).cast("long").alias("j"), "block")
    depth = 6 + (place.agg(F.max("block")).first()[0] or 0).bit_length()
    wet = saved(tree.refine(place, depth, 20).filter("n > 0"))
    members = (F.col("n") % 3).alias("members")
    cells = wet.select(F.col("level").cast("int").alias("level"), "i", "j", F.when(F.col("n") % 2 == 0, 1).otherwise(2).alias("cell_type"), members)
    return cells, saved(tree.interfaces(cells.select("level", "i", "j"))), depth - 4


def grid_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atoms of the tree with their work."""
    return grid_graph.atoms(*_grid(spark, sf_dir)).select("atom.*", "work", "cells")


def grid_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between atoms with their traffic."""
    ends = [F.col(f"{e}.{c}").alias(f"{e}_{c}") for e in "ab" for c in ("level", "i", "j")]
    return grid_graph.edges(*_grid(spark, sf_dir)).select(*ends, "weight", "bytes", "phases")


def grid_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs of eight ranks that have the atoms in stripes along i."""
    cells, pairs, block_level = _grid(spark, sf_dir)
    found = saved(grid_graph.atoms(cells, pairs, block_level))
    owners = found.select("atom", (F.col("atom.i") % 8).alias("rank"))
    return grid_graph.rank_costs(found, grid_graph.edges(cells, pairs, block_level), owners, 2.0, 64.0)


QUERIES = {f.__name__: f for f in (grid_atoms, grid_edges, grid_ranks)}

_GRID = """
    m AS (SELECT (6 + ceil(log2(max(l_orderkey // 128) + 1)))::INTEGER AS m FROM lineitem),
    p AS (SELECT l_quantity::BIGINT + 64 * (l_orderkey // 128) AS i, (round(l_discount * 100) * 5 + (l_orderkey * 8 + l_linenumber) % 5)::BIGINT AS j FROM lineitem),
    n AS MATERIALIZED (SELECT level, (i >> (m - level)) AS i, (j >> (m - level)) AS j, count(*) AS n FROM p, (SELECT m, unnest(range(m + 1))::INTEGER AS level FROM m) GROUP BY ALL),
    s AS MATERIALIZED (SELECT level, i, j FROM n, m WHERE n > 20 AND level < m),
    c AS (SELECT level + 1 AS level, i * 2 + q % 2 AS i, j * 2 + q // 2 AS j FROM s, (SELECT unnest(range(4)) AS q) UNION ALL SELECT 0, 0, 0),
    w AS MATERIALIZED (SELECT c.level, c.i, c.j, n.n, least(c.level, m - 4) AS al, c.i >> greatest(c.level - m + 4, 0) AS ai, c.j >> greatest(c.level - m + 4, 0) AS aj
        FROM c ANTI JOIN s USING (level, i, j) JOIN n USING (level, i, j), m),
    f AS MATERIALIZED (SELECT x.level, x.al, x.ai, x.aj, y.al AS bl, y.ai AS bi, y.aj AS bj FROM w x JOIN w y ON y.level = x.level + 1 AND (
        (y.i IN (2 * x.i - 1, 2 * x.i + 2) AND y.j // 2 = x.j AND y.j >= 0) OR (y.j IN (2 * x.j - 1, 2 * x.j + 2) AND y.i // 2 = x.i AND y.i >= 0))),
    a AS MATERIALIZED (SELECT al AS level, ai AS i, aj AS j, sum(work)::DOUBLE AS work, sum(cells)::BIGINT AS cells FROM (
        SELECT al, ai, aj, (CASE WHEN n % 2 = 0 THEN 1 + greatest(n % 3, 1) ELSE 1 END) * 2.0 ** level AS work, 1 AS cells FROM w
        UNION ALL SELECT al, ai, aj, 0.5 * 2.0 ** level, 0 FROM f UNION ALL SELECT bl, bi, bj, 0.5 * 2.0 ** level, 0 FROM f) GROUP BY ALL),
    k AS (SELECT x.level, 0 AS kind, (x.al, x.ai, x.aj) AS a, (y.al, y.ai, y.aj) AS b FROM w x JOIN w y ON x.level = y.level
            AND (y.i, y.j) IN ((x.i + 1, x.j - 1), (x.i + 1, x.j), (x.i + 1, x.j + 1), (x.i, x.j + 1))
          UNION ALL SELECT level, 1, (al, ai, aj), (bl, bi, bj) FROM f),
    g AS (SELECT least(a, b) AS a, greatest(a, b) AS b, level, kind, count(*) AS n FROM k WHERE a <> b GROUP BY ALL),
    e AS MATERIALIZED (SELECT a[1] AS a_level, a[2] AS a_i, a[3] AS a_j, b[1] AS b_level, b[2] AS b_i, b[3] AS b_j, sum(n * 2.0 ** level)::DOUBLE AS weight,
        sum(n * 2.0 ** level * CASE kind WHEN 0 THEN 8 ELSE 64 END)::DOUBLE AS bytes, bit_or(1::BIGINT << (level + 32 * kind)) AS phases FROM g GROUP BY a, b)
"""

SQL = {
    "grid_atoms": f"WITH {_GRID} SELECT * FROM a",
    "grid_edges": f"WITH {_GRID} SELECT * FROM e",
    "grid_ranks": f"""
        WITH {_GRID},
        t AS (SELECT least(a_i % 8, b_i % 8) AS x, greatest(a_i % 8, b_i % 8) AS y, sum(weight) AS weight, sum(bytes) AS bytes, bit_or(phases) AS phases FROM e WHERE a_i % 8 <> b_i % 8 GROUP BY 1, 2),
        u AS (SELECT *, bytes / 64 + 2 * list_sum([((phases >> l) & 1) * 2.0 ** (l % 32) FOR l IN range(63)]) AS time FROM t),
        v AS (SELECT x AS rank, weight, time FROM u UNION ALL SELECT y, weight, time FROM u),
        z AS (SELECT rank, sum(weight) AS cut, count(*) AS peers, sum(time) AS time FROM v GROUP BY rank),
        l AS (SELECT i % 8 AS rank, count(*) AS atoms, sum(work) AS work, max(work) AS largest FROM a GROUP BY 1)
        SELECT rank, atoms, work, largest, coalesce(cut, 0)::DOUBLE AS cut, coalesce(peers, 0) AS peers, coalesce(time, 0)::DOUBLE AS time FROM l LEFT JOIN z USING (rank)
    """,
}
