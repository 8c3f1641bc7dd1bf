"""Case files written from orders and parts: verdicts of the rules, tables of known parameters, typed reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import builtins, cases, registry


def _order_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case an order, in 29 variants of a sound one: values left out, added, out of range or contradictory."""
    k = F.col("o_orderkey")
    variant = k % 29

    def unless(line: Column | str, *variants: int) -> Column:
        return F.when(~variant.isin(*variants), line if isinstance(line, Column) else F.lit(line))

    def only(variant_no: int, *lines: str) -> Column:
        return F.when(variant == variant_no, F.lit("\n".join(lines)))

    text = F.concat_ws(
        "\n",
        unless("rho = 1000 kg/m^3", 2, 5, 26), only(5, "rho = -1 kg/m^3"), only(26, "rho = 3 m"), unless("mu = 1 mPa*s", 1, 6),
        unless(F.concat(F.lit("Re = "), 100 + k % 50), 9, 10), F.lit("characteristic length = 10 cm"), unless("dx: 5 mm", 11),
        unless(F.concat(F.lit("tau = "), 52 + 2 * (k % 10), F.lit("e-2")), 12, 13, 14, 16, 17, 18, 28),
        unless(F.concat(F.lit("max steps = "), 1000 + k % 7), 19, 21, 22), unless("lattice = D3Q19", 24), unless("collision = bgk", 23, 25),
        only(1, "nu = 1e-6 m^2/s"), only(2, "nu = 1e-6 m^2/s"), only(3, "nu = 1e-6 m^2/s"), only(4, "nu = 2e-6 m^2/s"),
        F.when(variant == 7, F.concat(F.lit("reference velocity = "), 1000 + k % 50 * 10, F.lit(" um/s"))), only(8, "reference velocity = 1 m/s"), only(9, "reference velocity = 1 cm/s"),
        only(13, "tau = 0.5"), only(14, "omega = 1.6"), only(15, "omega = 1.6", "ma = 5", "u lat = 5", "dt = 5 s"),
        F.when(variant == 16, F.concat(F.lit("lattice velocity = "), 2 + k % 10, F.lit("e-2"))), only(17, "mach = 0.05"), only(18, "time step = 100 ms"),
        only(19, "end time = 101.3 s"), only(20, "end time = 101.3 s"), only(22, "nsteps = 10.5"), only(23, "collision = swirl"),
        only(25, "wall = immersed boundary", "inlet = 'ZH vel'", "outlet = standard", "collision = central-moment"), only(27, "viscosity = 1 mPa*s"), only(28, "tau = 2.5"),
    )
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("case_id"), text.alias("text"))


def case_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors, warnings, scaling and models of all order cases."""
    done = registry.verdicts(_order_cases(spark, sf_dir))
    sound = F.col("error").isNull()
    return done.select(
        "case_id", "error", F.when(sound, F.array_join("warnings", " | ")).alias("warnings"), F.when(sound, F.round("relaxation_time", 9)).alias("tau"), F.when(sound, F.round("mach_number", 9)).alias("mach"),
        F.when(sound, F.round("time_step", 9)).alias("time_step"), F.when(sound, F.col("max_steps").cast("long")).alias("steps"), F.when(sound, F.round("physical_time", 6)).alias("seconds"),
        F.when(sound, F.concat_ws("/", *builtins.MODELS)).alias("models"),
    )


def _part_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checked lines of a case a part, with known parameters and its own."""
    k, size = F.col("p_partkey"), F.col("p_size")
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("probe length = "), size, F.lit(" cm")), F.concat(F.lit("cell count = "), F.when(k % 4 == 0, F.lit("0.5")).otherwise(size.cast("string"))),
        F.concat(F.lit("tag = '"), "p_brand", F.lit("'")), F.when(k % 2 == 0, F.lit("verbose = Yes")), F.concat(F.lit("limit = "), F.when(k % 3 == 0, F.lit("1e39")).otherwise(F.lit("0.5")), F.lit(" s")),
        F.lit("mesh = part.stl"), F.when(k % 5 == 0, F.lit("density = on")), F.when(k % 7 == 0, F.lit("tag = again")), F.when(k % 2 == 0, F.lit("x-periodic = no")),
    )
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(k.alias("case_id"), text.alias("text"))
    return registry.checked(cases.parse_cases(cases.case_lines(part)))


def case_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed reads of the parts' own parameters."""
    wanted = [("probe_length", "double", builtins.LENGTH, None), ("cell_count", "int", builtins.NONE, None), ("tag", "string", None, 9), ("verbose", "bool", None, None), ("limit", "float", builtins.TIME, None)]
    return registry.read_as(_part_rows(spark, sf_dir), wanted).select("case_id", "name", F.round("double_value", 9).alias("double_value"), "int_value", "flag", "word", "problem")


def case_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known parameters, own ones and those that nothing reads, by part."""
    return registry.counts(_part_rows(spark, sf_dir), ["probe_length", "tag", "verbose"]).withColumn("unbound", F.array_join("unbound", ","))


def case_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many parts state each known parameter."""
    table = registry.full_table(_part_rows(spark, sf_dir))
    return table.groupBy("name").agg(F.count("*").alias("n_cases"), F.count_if("stated").alias("n_stated"))


QUERIES = {f.__name__: f for f in (case_verdicts, case_reads, case_counts, case_table)}

SQL = {
    "case_verdicts": """
        WITH c AS (SELECT o_orderkey AS k, o_orderkey % 29 AS v, CASE WHEN o_orderkey % 29 = 9 THEN 1000.0::DOUBLE ELSE 100 + o_orderkey % 50 END AS re FROM orders),
        d AS (SELECT *, re * 1e-5 AS u, CASE v WHEN 16 THEN (2 + k % 10) / 100 WHEN 17 THEN 0.05 / sqrt(3) WHEN 18 THEN re * 1e-5 * 0.1 / 0.005 END AS seed FROM c),
        t AS (SELECT *, CASE WHEN seed IS NOT NULL THEN 0.5 + 3 * seed * 20 / re WHEN v = 14 THEN 0.625 WHEN v = 28 THEN 2.5 ELSE (52 + 2 * (k % 10)) / 100 END AS tau FROM d),
        l AS (SELECT *, coalesce(seed, re * (tau - 0.5) / 3 / 20) AS ul FROM t),
        s AS (SELECT *, 0.005 * ul / u AS dt, CASE v
                WHEN 5 THEN 'density must be finite and above 0' WHEN 6 THEN 'two of density, dynamic_viscosity and kinematic_viscosity are needed'
                WHEN 10 THEN 'two of reynolds_number, characteristic_length and characteristic_velocity are needed' WHEN 11 THEN 'grid_spacing is needed'
                WHEN 12 THEN 'one of relaxation_time, relaxation_frequency, lattice_characteristic_velocity, mach_number and time_step is needed'
                WHEN 13 THEN 'relaxation_time must be above 0.5' WHEN 21 THEN 'physical_time or max_steps is needed' WHEN 22 THEN 'max_steps must be an integer'
                WHEN 23 THEN 'collision_model is unknown: swirl' WHEN 24 THEN 'lattice_model is needed' WHEN 26 THEN 'line 1: wrong dimension' WHEN 27 THEN 'line 10: stated twice' END AS error FROM l),
        n AS (SELECT *, CASE WHEN v = 19 THEN ceil(101.3 / dt) ELSE 1000 + k % 7 END AS n_steps,
              CASE v WHEN 1 THEN 'density is usual with dynamic_viscosity' WHEN 2 THEN 'dynamic_viscosity is usual with density' WHEN 3 THEN 'kinematic_viscosity is redundant' WHEN 4 THEN 'kinematic_viscosity is inconsistent'
                WHEN 7 THEN 'characteristic_velocity is redundant' WHEN 8 THEN 'characteristic_velocity is inconsistent' WHEN 9 THEN 'reynolds_number and characteristic_length are preferred'
                WHEN 14 THEN 'relaxation_time is preferred' WHEN 16 THEN 'lattice_characteristic_velocity usually follows' WHEN 17 THEN 'mach_number usually follows' WHEN 18 THEN 'time_step usually follows'
                WHEN 15 THEN 'relaxation_frequency is inconsistent | lattice_characteristic_velocity is inconsistent | mach_number is inconsistent | time_step is inconsistent'
                WHEN 19 THEN 'physical_time is raised to whole steps' WHEN 20 THEN 'physical_time is inconsistent' END AS w FROM s)
        SELECT k AS case_id, error,
               CASE WHEN error IS NULL THEN concat_ws(' | ', w, CASE WHEN ul * sqrt(3) > 0.1 THEN 'mach_number above 0.1' END, CASE WHEN tau < 0.55 THEN 'relaxation_time below 0.55' END,
                    CASE WHEN tau > 2 THEN 'relaxation_time above 2' END) END AS warnings,
               CASE WHEN error IS NULL THEN round(tau, 9) END AS tau, CASE WHEN error IS NULL THEN round(ul * sqrt(3), 9) END AS mach, CASE WHEN error IS NULL THEN round(dt, 9) END AS time_step,
               CASE WHEN error IS NULL THEN n_steps::BIGINT END AS steps, CASE WHEN error IS NULL THEN round(n_steps * dt, 6) END AS seconds,
               CASE WHEN error IS NULL THEN CASE WHEN v = 25 THEN 'D3Q19/Cascaded/IBM/ZouHeVelocity/Default' ELSE 'D3Q19/BGK' END END AS models FROM n
    """,
    "case_reads": """
        WITH p AS (SELECT p_partkey AS k, p_size AS size, p_brand AS brand FROM part)
        SELECT k AS case_id, 'probe_length' AS name, round(size / 100, 9) AS double_value, NULL::INTEGER AS int_value, NULL::BOOLEAN AS flag, NULL AS word, NULL AS problem FROM p
        UNION ALL SELECT k, 'cell_count', NULL, CASE WHEN k % 4 > 0 THEN size END, NULL, NULL, CASE WHEN k % 4 = 0 THEN 'not whole' END FROM p
        UNION ALL SELECT k, 'tag', NULL, NULL, NULL, CASE WHEN strlen(brand) < 9 THEN brand END, CASE WHEN strlen(brand) >= 9 THEN 'too long' END FROM p
        UNION ALL SELECT k, 'verbose', NULL, NULL, CASE WHEN k % 2 = 0 THEN true END, NULL, CASE WHEN k % 2 > 0 THEN 'not stated' END FROM p
        UNION ALL SELECT k, 'limit', CASE WHEN k % 3 > 0 THEN 0.5 END, NULL, NULL, NULL, CASE WHEN k % 3 = 0 THEN 'out of range' END FROM p
    """,
    "case_counts": """
        SELECT p_partkey AS case_id, 1 + (p_partkey % 2 = 0)::BIGINT AS n_builtin, 4 + (p_partkey % 2 = 0)::BIGINT AS n_own, 2 + (p_partkey % 2 = 0)::BIGINT AS n_bound, 'cell_count,limit' AS unbound FROM part
    """,
    "case_table": "WITH k AS (SELECT unnest(["
    + ", ".join(f"'{name}'" for name, _, _, _ in builtins.PARAMETERS)
    + "]) AS name) SELECT name, count(*) AS n_cases, (sum((name = 'geometry_file' OR name = 'periodic_x' AND p_partkey % 2 = 0)::INTEGER))::BIGINT AS n_stated FROM k, part GROUP BY name",
}
