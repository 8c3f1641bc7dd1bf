"""Queries over refinement regions and units: a tree for each supplier, lengths of roots of areas for each part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import regions
from tessera.sources import cases, units

_ORIGIN, _WIDTH = (0.0, 0.0, 0.0), 2.0


def _forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's domain of four cells an axis, around a ball whose place and size vary with the key."""
    k = F.col("s_suppkey")
    balls = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        k, *((4.0 + (k % m) * 0.25).alias(f"c{x}") for x, m in zip("xyz", (8, 5, 3), strict=True)), (1.5 + (k % 4) * 0.25).alias("radius")
    )
    roots = balls
    for axis in "ijk":
        roots = roots.withColumn(axis, F.explode(F.sequence(F.lit(0), F.lit(3))))
    centre, radius = tuple(F.col(f"c{x}") for x in "xyz"), F.col("radius")
    fluid = regions.BoxRegion(_ORIGIN, (8.0, 8.0, 8.0)) - regions.BallRegion(centre, radius)
    rules = [regions.Rule(regions.BallRegion(centre, 2 * radius), 1), regions.Rule(fluid, 2, 0.25, (6,))]
    return regions.refine_by_rules(roots, rules, fluid, origin=_ORIGIN, width=_WIDTH)


def ruled_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of each supplier's tree: refined in a wide ball, and more in a band around the ball that is cut out."""
    return _forest(spark, sf_dir).groupBy("s_suppkey", "level").agg(F.count("*").alias("leaves"))


def wet_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same trees without the leaves that lie in the ball."""
    return _forest(spark, sf_dir).filter("wet").groupBy("s_suppkey", "level").agg(F.count("*").alias("leaves"))


def root_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Permeability lengths and stress rates of parts, written with brackets and fractions as exponents."""
    k = F.col("p_partkey")
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("root = "), F.col("p_size").cast("string"), F.lit(" [(N*m)/kg]^(1/2)")),
        F.concat(F.lit("stress rate = "), F.col("p_size").cast("string"), F.lit(" kg m^-1 s^-3")),
        F.when(k % 3 == 0, F.lit("broken = 1 ([m])")),
        F.when(k % 4 == 0, F.lit("noise = 5 W/Hz^{1/2}")),
    )
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(k.alias("case_id"), text.alias("text"))
    parsed = cases.parse_cases(cases.case_lines(parts))
    return parsed.select("case_id", "name", "kind", F.round("value", 9).alias("value"), units.si_text(F.col("exponents")).alias("unit"))


def _cells(level: int, parents: str) -> str:
    side = 2.0 / 2**level
    places = ", ".join(f"{c} * {side} + 0.5 * {side} AS {m}" for c, m in zip("ijk", ("mx", "my", "mz"), strict=True))
    reach = f"(0.5 * sqrt({side} * {side} + {side} * {side} + {side} * {side}))"
    band = f"(abs(d - radius) <= 0.25 + {reach} AND {level} < 2)"
    return f"""
        a{level} AS (SELECT *, sqrt((mx - cx) * (mx - cx) + (my - cy) * (my - cy) + (mz - cz) * (mz - cz)) AS d FROM (SELECT *, {places} FROM ({parents}))),
        c{level} AS MATERIALIZED (SELECT s_suppkey, cx, cy, cz, radius, i, j, k, d - radius < -{reach} AS dry, NOT dry AND (({level} < 1 AND d - 2 * radius <= {reach}) OR {band}) AS split FROM a{level})
    """


def _children(level: int) -> str:
    return f"SELECT s_suppkey, cx, cy, cz, radius, 2 * i + q % 2 AS i, 2 * j + q // 2 % 2 AS j, 2 * k + q // 4 AS k FROM c{level}, (SELECT unnest(range(8)) AS q) WHERE split"


_TREES = f"""
    WITH s AS (SELECT s_suppkey, 4 + s_suppkey % 8 * 0.25::DOUBLE AS cx, 4 + s_suppkey % 5 * 0.25::DOUBLE AS cy, 4 + s_suppkey % 3 * 0.25::DOUBLE AS cz, 1.5::DOUBLE + s_suppkey % 4 * 0.25::DOUBLE AS radius FROM supplier),
    r AS (SELECT s.*, a.i, b.i AS j, c.i AS k FROM s, (SELECT unnest(range(4)) AS i) a, (SELECT unnest(range(4)) AS i) b, (SELECT unnest(range(4)) AS i) c),
    {_cells(0, "SELECT * FROM r")}, {_cells(1, _children(0))}, {_cells(2, _children(1))},
    leaves AS (SELECT s_suppkey, 0 AS level, dry FROM c0 WHERE NOT split UNION ALL SELECT s_suppkey, 1, dry FROM c1 WHERE NOT split UNION ALL SELECT s_suppkey, 2, dry FROM c2)
"""

QUERIES = {f.__name__: f for f in (ruled_leaves, wet_leaves, root_units)}

SQL = {
    "ruled_leaves": f"{_TREES} SELECT s_suppkey, level, count(*) AS leaves FROM leaves GROUP BY ALL",
    "wet_leaves": f"{_TREES} SELECT s_suppkey, level, count(*) AS leaves FROM leaves WHERE NOT dry GROUP BY ALL",
    "root_units": """
        SELECT p_partkey AS case_id, 'root' AS name, 'quantity' AS kind, p_size::DOUBLE AS value, 'm/s' AS unit FROM part
        UNION ALL SELECT p_partkey, 'stress_rate', 'quantity', p_size::DOUBLE, 'kg/(m*s^3)' FROM part
        UNION ALL SELECT p_partkey, 'broken', 'error', NULL, NULL FROM part WHERE p_partkey % 3 = 0
        UNION ALL SELECT p_partkey, 'noise', 'quantity', 5.0, '(kg*m^2)/(s^5/2)' FROM part WHERE p_partkey % 4 = 0
    """,
}
