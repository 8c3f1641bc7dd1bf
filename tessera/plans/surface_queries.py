"""Queries over closed surfaces, planar faces and octrees: a box for each supplier or customer, a height field over parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import features, mesh, mesh_checks, nearest, ports, solids, tree
from tessera.plans.geometry_queries import box_facets, points
from tessera.plans.tables import saved


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A closed box for each supplier; sizes and places vary with the key."""
    k = F.col("s_suppkey")
    low = tuple((k % m).cast("double") + 0.25 for m in (20, 7, 11))
    high = tuple(lo + (n + k % m).cast("double") for lo, n, m in zip(low, (5, 4, 3), (6, 5, 4), strict=True))
    return box_facets(spark.read.parquet(f"{sf_dir}/supplier.parquet"), "s_suppkey", low, high)


_BOXES = """
    SELECT s_suppkey, s_suppkey % 20 + 0.25 AS x0, s_suppkey % 7 + 0.25 AS y0, s_suppkey % 11 + 0.25 AS z0,
           x0 + 5 + s_suppkey % 6 AS x1, y0 + 4 + s_suppkey % 5 AS y1, z0 + 3 + s_suppkey % 4 AS z1 FROM supplier
"""
_WET = f"""
    SELECT *, i + 0.5 AS x, j + 0.5 AS y, k + 0.5 AS z FROM ({_BOXES}), (SELECT unnest(range(32)) AS i), (SELECT unnest(range(32)) AS j), (SELECT unnest(range(32)) AS k)
    WHERE i + 0.5 > x0 AND i + 0.5 < x1 AND j + 0.5 > y0 AND j + 0.5 < y1 AND k + 0.5 > z0 AND k + 0.5 < z1
"""
_NEAR_WALL = "x - 1 <= x0 OR x + 1 >= x1 OR y - 1 <= y0 OR y + 1 >= y1 OR z - 1 <= z0 OR z + 1 >= z1"


def solid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundary and interior cells of every supplier's box."""
    return solids.cell_types(_boxes(spark, sf_dir), 1.0, "s_suppkey").groupBy("s_suppkey", "cell_type").agg(F.count("*").alias("n"))


def solid_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link hits of the boundary cells on their box."""
    facets = _boxes(spark, sf_dir)
    cells = saved(solids.cell_types(facets, 1.0, "s_suppkey").filter("cell_type = 1"))
    hits = solids.link_hits(cells, facets, "D3Q19", 1.0, "s_suppkey")
    return hits.groupBy("s_suppkey").agg(F.count("*").alias("n"), F.min("q").alias("min_q"), F.max("q").alias("max_q"), F.sum("q").alias("sum_q"))


def flow_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three nested boxes for every three customers: a root, a box in it, and one more in the root or in that box; every fifth is wound inward."""
    key = F.col("c_custkey")
    group, member = F.floor(key / 3), key % 3
    inset = F.when(member == 0, 0.0).when(member == 1, 1.0).when(group % 2 == 0, 7.0).otherwise(2.0)
    size = F.when(member == 0, 12.0).when(member == 1, 5.0).otherwise(2.0)
    places = [16.0 * (group % 100) + inset, 16.0 * F.floor(group / 100) + inset, inset]
    facets = box_facets(spark.read.parquet(f"{sf_dir}/customer.parquet"), "c_custkey", tuple(places), tuple(p + size for p in places))
    facets = saved(solids.turned(facets, key % 5 == 0))
    volumes = mesh.signed_volumes(facets, "c_custkey").withColumn("mesh", F.floor(key / 3))
    contains = solids.containment(facets, "c_custkey")
    return solids.flow_sides(volumes, saved(contains), "c_custkey", "mesh", internal=True)


def _height_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two triangles for each square of four parts, forty parts a row, at heights 0, 1 and 2."""
    return saved(_fields(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.floor(F.col("p_size") / 17).cast("double").alias("h"))))


def _fields(parts: DataFrame) -> DataFrame:
    squares = parts.filter("p_partkey % 40 < 39").select("p_partkey", F.col("h").alias("h0"))
    for n, step in ((1, 1), (2, 40), (3, 41)):
        squares = squares.join(parts.select((F.col("p_partkey") - step).alias("p_partkey"), F.col("h").alias(f"h{n}")), "p_partkey")
    p = F.col("p_partkey")
    corner = [(p + d, ((p + d) % 40).cast("double"), F.floor((p + d) / 40).cast("double"), F.col(f"h{n}")) for n, d in enumerate((0, 1, 40, 41))]
    triangles = [
        F.struct((2 * p + half).alias("facet_id"), *(corner[i][0].alias(f"v{n}") for n, i in enumerate(t)), *(corner[i][1 + a].alias(f"{v}{x}") for v, i in zip("abc", t, strict=True) for a, x in enumerate("xyz")))
        for half, t in enumerate(((0, 1, 2), (1, 3, 2)))
    ]
    return squares.select(F.explode(F.array(*triangles)).alias("t")).select("t.*")


_FIELD = """
    h AS MATERIALIZED (SELECT p_partkey AS p, p_size // 17 AS h FROM part),
    s AS MATERIALIZED (SELECT a.p, a.h AS h0, b.h AS h1, c.h AS h2, d.h AS h3 FROM h a JOIN h b ON b.p = a.p + 1 JOIN h c ON c.p = a.p + 40 JOIN h d ON d.p = a.p + 41 WHERE a.p % 40 < 39),
    f AS MATERIALIZED (SELECT 2 * p AS id, h1 - h0 AS gx, h2 - h0 AS gy, p, p + 1 AS q, p + 40 AS r FROM s UNION ALL SELECT 2 * p + 1, h3 - h2, h3 - h1, p + 1, p + 41, p + 40 FROM s),
    e AS MATERIALIZED (SELECT id, gx, gy, least(p, q) AS lo, greatest(p, q) AS hi FROM f UNION ALL SELECT id, gx, gy, least(q, r), greatest(q, r) FROM f UNION ALL SELECT id, gx, gy, least(r, p), greatest(r, p) FROM f),
    l AS MATERIALIZED (SELECT x.id AS a, y.id AS b FROM e x JOIN e y ON x.lo = y.lo AND x.hi = y.hi AND x.id <> y.id AND x.gx = y.gx AND x.gy = y.gy)
"""
_FACES = f"""
    WITH RECURSIVE {_FIELD},
    r AS (SELECT a AS id, a AS seen FROM l UNION SELECT r.id, l.b FROM r JOIN l ON r.seen = l.a),
    m AS MATERIALIZED (SELECT id, min(seen) AS face_id FROM r GROUP BY id)
"""


def mesh_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of every supplier that follow its box as a mesh: split twice where cells meet the solid and come near its surface."""
    facets = _boxes(spark, sf_dir)
    roots = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey")
    for axis, n in zip("ijk", (4, 2, 3), strict=True):
        roots = roots.withColumn(axis, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    leaves = nearest.refine_by_meshes(roots, facets, "s_suppkey", 2, 0.25, width=8.0)
    return leaves.groupBy("s_suppkey", "level", "relation").agg(F.count("*").alias("leaves"))


def field_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distance from each fortieth part's place, at height 3, to the nearest facet of all the height field."""
    facets = _height_field(spark, sf_dir).withColumn("field", F.lit(0))
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.lit(0).alias("field"), F.lit(20.5).alias("x"), (F.floor(F.col("p_partkey") / 40) + 0.25).cast("double").alias("y"), F.lit(3.0).alias("z"))
    found = nearest.nearest_facets(parts.filter("p_partkey % 40 = 20"), facets, "field", "p_partkey")
    return found.select("p_partkey", F.round("distance", 9).alias("distance"))


def points_in_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts and line numbers of line items, placed above the square of their part, in the closed surface between the height field (zero at its rim) and its ground: one surface of all facets."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.floor(F.col("p_size") / 17).cast("double").alias("h"))
    rows = parts.agg(F.max(F.floor(F.col("p_partkey") / 40)).alias("last"))  # one row
    at, row = F.col("p_partkey") % 40, F.floor(F.col("p_partkey") / 40)
    flat = parts.crossJoin(rows).withColumn("h", F.when(at.isin(0, 39) | (row <= 1) | (row >= F.col("last") - 1), 0.0).otherwise(F.col("h"))).filter((row >= 1) & (row < F.col("last")))
    top = _fields(flat).drop("v0", "v1", "v2")
    ground = top.withColumns({f"{v}z": F.lit(0.0) for v in "abc"}).withColumn("facet_id", F.col("facet_id") + (1 << 40))
    facets = saved(top.unionByName(ground).withColumn("field", F.lit(0)))
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    places = items.select(
        (F.col("l_partkey") * 8 + F.col("l_linenumber")).alias("id"), (F.col("l_partkey") % 40 + 0.25).cast("double").alias("x"), (F.floor(F.col("l_partkey") / 40) + 0.5).cast("double").alias("y"), (F.col("l_linenumber") * 0.25 + 0.125).cast("double").alias("z")
    )
    return mesh.enclosed(places.distinct(), facets, "field").groupBy((F.col("id") % 8).alias("line")).agg(F.count("*").alias("n"), F.min("id").alias("first"))


def planar_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.face_measures(_height_field(spark, sf_dir)).withColumn("area", F.round("area", 6))


def feature_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.feature_edges(_height_field(spark, sf_dir))


def curve_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.curve_ends(features.feature_edges(_height_field(spark, sf_dir)))


def mesh_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bar for each supplier, in six variants: sound, with a facet less, turned, twice or collapsed, and with another bar in it; ``place`` is the facet of a bar at fault, where one is."""
    k, half = F.col("s_suppkey"), F.lit(0.5)
    low = (k % 9).cast("double"), (k % 5).cast("double"), (k % 7).cast("double")
    table = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    bar = box_facets(table, "s_suppkey", low, (low[0] + 1 + k % 15, low[1] + 1, low[2] + 1))
    moved = tuple(x + half for x in low)
    second = box_facets(table.filter("s_suppkey % 6 = 5"), "s_suppkey", moved, (moved[0] + 1 + k % 15, moved[1] + 1, moved[2] + 1)).withColumn("facet_id", F.col("facet_id") + 20)
    variant, n = k % 6, F.col("facet_id")
    bar = solids.turned(bar.filter(~((variant == 1) & (n == 5))), (variant == 2) & (n == 4))
    bar = bar.withColumns({f"c{x}": F.when((variant == 4) & (n == 7), F.col(f"a{x}")).otherwise(F.col(f"c{x}")) for x in "xyz"})
    again = bar.filter((variant == 3) & (n == 0)).withColumn("facet_id", F.lit(12))
    facets = bar.union(again).union(second).withColumn("facet_id", 100 * k + n)
    place = F.when(F.col("problem").isin("repeated facet", "coincident corners"), F.col("at") - 100 * k)
    return mesh_checks.mesh_verdicts(facets, "s_suppkey").select("s_suppkey", "n_facets", "n_poor", "n_oversized", "problem", place.alias("place"))


def _octree(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = points(spark, sf_dir).select(F.col("x").cast("long").alias("i"), (5 * F.col("y") + F.col("id") % 5).cast("long").alias("j"), (7 * F.col("z") + F.col("id") % 7).cast("long").alias("k"))
    return tree.refine(place, 6, 20, "ijk")


def octree_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _octree(spark, sf_dir).groupBy("level").agg(F.count("*").alias("leaves"), F.sum("n").alias("points"))


def octree_interfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = saved(_octree(spark, sf_dir).select(F.col("level").cast("int").alias("level"), *"ijk"))
    return tree.interfaces(leaves, "ijk").groupBy("level").agg(F.count("*").alias("pairs"))


_OCTREE = """
    WITH p AS (SELECT l_quantity::BIGINT AS i, (5 * round(l_discount * 100) + (l_orderkey * 8 + l_linenumber) % 5)::BIGINT AS j, (7 * round(l_tax * 100) + (l_orderkey * 8 + l_linenumber) % 7)::BIGINT AS k FROM lineitem),
    n AS MATERIALIZED (SELECT level, (i >> (6 - level)) AS i, (j >> (6 - level)) AS j, (k >> (6 - level)) AS k, count(*) AS n FROM p, (SELECT unnest(range(7))::INTEGER AS level) GROUP BY ALL),
    s AS MATERIALIZED (SELECT * FROM n WHERE n > 20 AND level < 6),
    c AS (SELECT level + 1 AS level, i * 2 + q % 2 AS i, j * 2 + q // 2 % 2 AS j, k * 2 + q // 4 AS k FROM s, (SELECT unnest(range(8)) AS q) UNION ALL SELECT 0, 0, 0, 0),
    leaves AS MATERIALIZED (SELECT c.level, c.i, c.j, c.k, coalesce(n.n, 0) AS n FROM c ANTI JOIN s USING (level, i, j, k) LEFT JOIN n USING (level, i, j, k)),
    up AS MATERIALIZED (SELECT level - 1 AS level, i, j, k, i // 2 AS pi, j // 2 AS pj, k // 2 AS pk FROM leaves)
"""

def _band(level: int) -> str:
    side = 8.0 / 2**level
    reach = f"(0.5 * sqrt(3 * {side} * {side}))"
    centres = ", ".join(f"({c} + 0.5) * {side} AS m{x}" for c, x in zip("ijk", "xyz", strict=True))
    outer = " + ".join(f"greatest({x}0 - m{x}, m{x} - {x}1, 0) ** 2" for x in "xyz")
    inner = ", ".join(f"m{x} - {x}0, {x}1 - m{x}" for x in "xyz")
    source = "r0" if not level else f"(SELECT * EXCLUDE (i, j, k, q, mx, my, mz, d, relation, split), 2 * i + q % 2 AS i, 2 * j + q // 2 % 2 AS j, 2 * k + q // 4 AS k FROM c{level - 1}, (SELECT unnest(range(8)) AS q) WHERE split)"
    return f"""
        c{level} AS MATERIALIZED (SELECT *, relation >= 0 AND abs(d) <= 0.25 + {reach} AND {level} < 2 AS split FROM (
            SELECT *, CASE WHEN abs(d) <= {reach} THEN 0 WHEN d < 0 THEN 1 ELSE -1 END AS relation FROM (
                SELECT *, CASE WHEN {outer} > 0 THEN sqrt({outer}) ELSE -least({inner}) END AS d FROM (SELECT *, {centres} FROM {source}))))"""


_BANDS = ",".join(map(_band, range(3)))

def curve_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature edges of the height field in the order of their curves."""
    return features.traced_curves(saved(features.feature_edges(_height_field(spark, sf_dir))))


def seeded_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planar faces of the height field, grown from seeds, with a report of their sizes."""
    facets = _height_field(spark, sf_dir)
    report = features.face_report(facets, features.seeded_faces(facets), small=0.002)
    return report.select("face_id", "face", "facets", F.round("area", 6).alias("area"), F.round("share", 9).alias("share"), "small")


def port_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hulls, least widths and equivalent diameters of the planar faces of the height field."""
    facets = _height_field(spark, sf_dir)
    sizes = ports.port_sizes(facets, features.seeded_faces(facets))
    return sizes.select("face_id", "corners", F.round("width", 6).alias("width"), F.round("diameter", 6).alias("diameter"))


QUERIES = {f.__name__: f for f in (solid_cells, solid_links, flow_sides, points_in_field, mesh_bands, field_distances, planar_faces, seeded_faces, port_sizes, feature_edges, curve_roles, curve_order, mesh_verdicts, octree_leaves, octree_interfaces)}

SQL = {
    "solid_cells": f"SELECT s_suppkey, CASE WHEN {_NEAR_WALL} THEN 1 ELSE 2 END AS cell_type, count(*) AS n FROM ({_WET}) GROUP BY ALL",
    "solid_links": f"""
        WITH c AS MATERIALIZED (SELECT * FROM ({_WET}) WHERE {_NEAR_WALL}), u AS (SELECT unnest([-1, 0, 1]) AS e),
        l AS (SELECT a.e AS ex, b.e AS ey, d.e AS ez FROM u a, u b, u d WHERE abs(a.e) + abs(b.e) + abs(d.e) IN (1, 2)),
        q AS (SELECT s_suppkey, least(CASE ex WHEN 1 THEN x1 - x WHEN -1 THEN x - x0 END, CASE ey WHEN 1 THEN y1 - y WHEN -1 THEN y - y0 END, CASE ez WHEN 1 THEN z1 - z WHEN -1 THEN z - z0 END)::DOUBLE AS q FROM c, l)
        SELECT s_suppkey, count(*) AS n, min(q) AS min_q, max(q) AS max_q, sum(q) AS sum_q FROM q WHERE q <= 1 GROUP BY 1
    """,
    "flow_sides": """
        WITH b AS (SELECT c_custkey, c_custkey // 3 AS mesh, c_custkey % 3 AS m, (c_custkey // 3) % 2 = 0 AS apart, c_custkey % 5 <> 0 AS outward FROM customer),
        n AS (SELECT *, CASE WHEN m = 0 THEN 0 WHEN m = 1 OR apart THEN 1 ELSE 2 END AS level FROM b)
        SELECT c_custkey, mesh, CASE level WHEN 1 THEN 3 * mesh WHEN 2 THEN 3 * mesh + 1 END AS parent, level::BIGINT AS level, true AS active,
               CASE level WHEN 0 THEN 'inside' ELSE 'outside' END AS fluid_side, outward <> (level = 0) AS flip, CASE level WHEN 2 THEN 'nested too deep' END AS problem
        FROM n
    """,
    "mesh_bands": f"""
        WITH b AS ({_BOXES}),
        r0 AS (SELECT b.*, i, j, k FROM b, (SELECT unnest(range(4)) AS i), (SELECT unnest(range(2)) AS j), (SELECT unnest(range(3)) AS k)),
        {_BANDS}
        SELECT s_suppkey, 0 AS level, relation, count(*) AS leaves FROM c0 WHERE NOT split GROUP BY ALL
        UNION ALL SELECT s_suppkey, 1, relation, count(*) FROM c1 WHERE NOT split GROUP BY ALL UNION ALL SELECT s_suppkey, 2, relation, count(*) FROM c2 GROUP BY ALL
    """,
    "field_distances": f"""
        WITH {_FIELD},
        q AS (SELECT p_partkey, 20.5 AS x, p_partkey // 40 + 0.25 AS y, 3.0 AS z FROM part WHERE p_partkey % 40 = 20),
        t AS (SELECT p % 40 AS ax, p // 40 AS ay, h0 AS az, p % 40 + 1 AS bx, p // 40 AS b2, h1 AS bz, p % 40 AS cx, p // 40 + 1 AS cy, h2 AS cz FROM s
              UNION ALL SELECT p % 40 + 1, p // 40, h1, p % 40 + 1, p // 40 + 1, h3, p % 40, p // 40 + 1, h2 FROM s),
        d AS (SELECT p_partkey, [bx - ax, b2 - ay, bz - az]::DOUBLE[3] AS e, [cx - ax, cy - ay, cz - az]::DOUBLE[3] AS f, [x - ax, y - ay, z - az]::DOUBLE[3] AS g FROM q, t WHERE abs(x - ax) <= 6 AND abs(y - ay) <= 6),
        u AS (SELECT *, array_inner_product(e, e) AS ee, array_inner_product(e, f) AS ef, array_inner_product(f, f) AS ff, array_inner_product(g, e) AS ge, array_inner_product(g, f) AS gf, array_inner_product(g, g) AS gg FROM d),
        v AS (SELECT *, (ge * ff - gf * ef) / (ee * ff - ef * ef) AS m, (gf * ee - ge * ef) / (ee * ff - ef * ef) AS n, greatest(0, least(1, ge / ee)) AS s1, greatest(0, least(1, gf / ff)) AS s2, greatest(0, least(1, (gf - ef - ge + ee) / (ff - 2 * ef + ee))) AS s3 FROM u),
        w AS (SELECT p_partkey, CASE WHEN m >= 0 AND n >= 0 AND m + n <= 1 THEN gg - 2 * m * ge - 2 * n * gf + m * m * ee + 2 * m * n * ef + n * n * ff
                     ELSE least(gg - 2 * s1 * ge + s1 * s1 * ee, gg - 2 * s2 * gf + s2 * s2 * ff, gg - 2 * ge + ee - 2 * s3 * (gf - ef - ge + ee) + s3 * s3 * (ff - 2 * ef + ee)) END AS square FROM v)
        SELECT p_partkey, round(sqrt(greatest(min(square), 0)), 9) AS distance FROM w GROUP BY 1
    """,
    "points_in_field": """
        WITH l AS (SELECT max(p_partkey // 40) AS last FROM part),
        h AS MATERIALIZED (SELECT p_partkey AS p, CASE WHEN p_partkey % 40 IN (0, 39) OR p_partkey // 40 <= 1 OR p_partkey // 40 >= last - 1 THEN 0 ELSE p_size // 17 END AS h FROM part, l WHERE p_partkey // 40 >= 1 AND p_partkey // 40 < last),
        s AS (SELECT a.p, a.h + 0.25 * (b.h - a.h) + 0.5 * (c.h - a.h) AS z FROM h a JOIN h b ON b.p = a.p + 1 JOIN h c ON c.p = a.p + 40 JOIN h d ON d.p = a.p + 41 WHERE a.p % 40 < 39)
        SELECT l_linenumber::BIGINT AS line, count(DISTINCT p) AS n, min(p * 8 + l_linenumber) AS first FROM lineitem JOIN s ON l_partkey = p WHERE l_linenumber * 0.25 + 0.125 < z GROUP BY 1
    """,
    "planar_faces": f"{_FACES} SELECT face_id, count(*) AS facets, round(sum(sqrt(1 + gx * gx + gy * gy) / 2), 6) AS area FROM m JOIN f USING (id) GROUP BY 1",
    "seeded_faces": f"""
        {_FACES}, w AS (SELECT sum(sqrt(1 + gx * gx + gy * gy) / 2) AS whole FROM f),
        g AS (SELECT face_id, count(*) AS facets, sum(sqrt(1 + gx * gx + gy * gy) / 2) AS area FROM m JOIN f USING (id) GROUP BY 1)
        SELECT face_id, row_number() OVER (ORDER BY face_id) AS face, facets, round(area, 6) AS area, round(area / whole, 9) AS share, area / whole < 0.002 AS small FROM g, w
    """,
    "port_sizes": f"""
        {_FACES}, g AS MATERIALIZED (SELECT face_id, any_value(1 + gx * gx + gy * gy) AS slope, any_value(gx) AS gx, any_value(gy) AS gy, sum(sqrt(1 + gx * gx + gy * gy) / 2) AS area FROM m JOIN f USING (id) GROUP BY 1),
        v AS MATERIALIZED (SELECT DISTINCT face_id, unnest([p, q, r]) % 40 AS x, unnest([p, q, r]) // 40 AS y FROM m JOIN f USING (id)),
        t AS (SELECT a.face_id, a.x, a.y, b.x - a.x AS ex, b.y - a.y AS ey, (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) AS turn, (b.x - a.x) * (c.x - a.x) + (b.y - a.y) * (c.y - a.y) AS reach
              FROM v a JOIN v b ON a.face_id = b.face_id AND (a.x, a.y) <> (b.x, b.y) JOIN v c ON a.face_id = c.face_id),
        rim AS (SELECT face_id, x, y, ex, ey, max(turn) AS far FROM t GROUP BY ALL HAVING min(turn) >= 0 AND count(*) FILTER (turn = 0 AND (reach < 0 OR reach > ex * ex + ey * ey)) = 0)
        SELECT face_id, count(*) AS corners, round(min(far * sqrt(slope) / sqrt(ex * ex + ey * ey + (gx * ex + gy * ey) ** 2)), 6) AS width, round(2 * sqrt(any_value(area) / pi()), 6) AS diameter
        FROM rim JOIN g USING (face_id) GROUP BY 1
    """,
    "feature_edges": f"""
        {_FACES}, o AS (SELECT lo, hi, coalesce(face_id, id) AS face FROM e LEFT JOIN m USING (id))
        SELECT lo, hi, CASE WHEN count(*) = 1 THEN 'open' WHEN min(face) = max(face) THEN 'flat' ELSE 'feature' END AS kind FROM o GROUP BY lo, hi
    """,
    "curve_roles": f"""
        {_FACES}, o AS (SELECT lo, hi, coalesce(face_id, id) AS face FROM e LEFT JOIN m USING (id)),
        g AS (SELECT lo, hi FROM o GROUP BY lo, hi HAVING count(*) > 1 AND min(face) <> max(face))
        SELECT vertex, count(*) AS degree, CASE count(*) WHEN 1 THEN 'end' WHEN 2 THEN 'pass' ELSE 'junction' END AS role
        FROM (SELECT lo AS vertex FROM g UNION ALL SELECT hi FROM g) GROUP BY vertex
    """,
    "curve_order": f"""
        {_FACES}, o AS (SELECT lo, hi, coalesce(face_id, id) AS face FROM e LEFT JOIN m USING (id)),
        g AS MATERIALIZED (SELECT lo, hi FROM o GROUP BY lo, hi HAVING count(*) > 1 AND min(face) <> max(face)),
        arc AS MATERIALIZED (SELECT lo AS u, hi AS v FROM g UNION ALL SELECT hi, lo FROM g),
        pass AS MATERIALIZED (SELECT u AS x FROM arc GROUP BY u HAVING count(*) = 2),
        step AS MATERIALIZED (SELECT a.u, a.v, b.v AS w FROM arc a JOIN pass ON a.v = x JOIN arc b ON b.u = a.v AND b.v <> a.u),
        walk AS (SELECT u AS su, v AS sv, u, v, 0 AS position FROM arc ANTI JOIN pass ON u = x
                 UNION ALL SELECT su, sv, walk.v, w, position + 1 FROM walk JOIN step ON walk.u = step.u AND walk.v = step.v),
        ends AS MATERIALIZED (SELECT su, sv, max(position) + 1 AS edges, arg_max(v, position) AS ev, arg_max(u, position) AS eu, min((least(u, v), greatest(u, v))) AS name FROM walk GROUP BY su, sv),
        ring AS (SELECT u AS su, v AS sv, u, v, 0 AS position FROM arc ANTI JOIN (SELECT DISTINCT u, v FROM walk) USING (u, v)
                 UNION ALL SELECT su, sv, ring.v, w, position + 1 FROM ring JOIN step ON ring.u = step.u AND ring.v = step.v WHERE ring.v <> su),
        loops AS MATERIALIZED (SELECT su, sv, max(position) + 1 AS edges, arg_max(u, position) AS last, min((least(u, v), greatest(u, v))) AS name, min(u) AS low FROM ring GROUP BY su, sv)
        SELECT least(u, v) AS lo, greatest(u, v) AS hi, name[1] AS curve_lo, name[2] AS curve_hi, false AS closed, position::BIGINT AS position, edges::BIGINT AS edges
        FROM walk JOIN ends USING (su, sv) WHERE (su, sv) < (ev, eu) UNION ALL
        SELECT least(u, v), greatest(u, v), name[1], name[2], true, position::BIGINT, edges::BIGINT FROM ring JOIN loops USING (su, sv) WHERE su = low AND sv < last
    """,
    "mesh_verdicts": """
        WITH v AS (SELECT * FROM (VALUES (0, 12, 8, NULL, NULL), (1, 11, 7, 'open edge', NULL), (2, 12, 8, 'winding', NULL), (3, 13, 9, 'repeated facet', 12), (4, 12, 7, 'coincident corners', 7), (5, 24, 16, 'facets meet', NULL))
                   AS t(v, n, long_sides, problem, place))
        SELECT s_suppkey, n::BIGINT AS n_facets, (CASE WHEN sqrt(3) * (1 + s_suppkey % 15) / ((1 + s_suppkey % 15) ** 2 + 1) < 0.2 THEN long_sides ELSE 0 END + (v = 4)::INTEGER)::BIGINT AS n_poor, 0::BIGINT AS n_oversized,
               problem, place::BIGINT AS place FROM supplier JOIN v ON s_suppkey % 6 = v
    """,
    "octree_leaves": f"{_OCTREE} SELECT level, count(*) AS leaves, sum(n)::BIGINT AS points FROM leaves GROUP BY level",
    "octree_interfaces": f"""
        {_OCTREE}, pairs AS (
            SELECT a.level FROM leaves a JOIN up b ON b.level = a.level AND b.pi = a.i + 1 AND b.pj = a.j AND b.pk = a.k AND b.i % 2 = 0 UNION ALL
            SELECT a.level FROM leaves a JOIN up b ON b.level = a.level AND b.pi = a.i - 1 AND b.pj = a.j AND b.pk = a.k AND b.i % 2 = 1 UNION ALL
            SELECT a.level FROM leaves a JOIN up b ON b.level = a.level AND b.pi = a.i AND b.pj = a.j + 1 AND b.pk = a.k AND b.j % 2 = 0 UNION ALL
            SELECT a.level FROM leaves a JOIN up b ON b.level = a.level AND b.pi = a.i AND b.pj = a.j - 1 AND b.pk = a.k AND b.j % 2 = 1 UNION ALL
            SELECT a.level FROM leaves a JOIN up b ON b.level = a.level AND b.pi = a.i AND b.pj = a.j AND b.pk = a.k + 1 AND b.k % 2 = 0 UNION ALL
            SELECT a.level FROM leaves a JOIN up b ON b.level = a.level AND b.pi = a.i AND b.pj = a.j AND b.pk = a.k - 1 AND b.k % 2 = 1)
        SELECT level, count(*) AS pairs FROM pairs GROUP BY level
    """,
}
