"""Geometry queries: every line item is a point (quantity, discount in percent, tax in percent) in the block of its order.

Blocks of 128 orders lie along x, 64 apart, so that cells grow with the table; shapes stand in every block.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.numbers import morton
from tessera.functions.vectors import box_distance, literal, segment_distance, vector
from tessera.operators import mesh
from tessera.operators.flow import external, internal
from tessera.operators.shapes import Ball, Box, Cylinder, Shape, face_hits, hit_points, wall_links
from tessera.operators.tree import interfaces, refine

BOX = Box((0.0, 0.0, 0.0), (50.0, 10.0, 8.0))
BALL = Ball((25.0, 5.0, 4.0), 13.0)
SLAB = Box((5.0, 0.5, 1.25), (30.0, 7.0, 6.75))
BRICK = Box((20.0, 3.25, 0.5), (45.0, 9.5, 5.0))
_MERGED = {"union": SLAB | BRICK, "intersection": SLAB & BRICK, "difference": SLAB - BRICK, "outside": ~(SLAB | BRICK)}
PIPE = Cylinder(0, (5.0, 4.0), 4.0, 10.0, 40.0)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return items.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
        F.col("l_quantity").alias("x"),
        F.round(F.col("l_discount") * 100).alias("y"),
        F.round(F.col("l_tax") * 100).alias("z"),
        F.floor(F.col("l_orderkey") / 128).alias("block"),
        "l_returnflag",
    )


_POINTS = """
    SELECT l_orderkey * 8 + l_linenumber AS id, l_quantity AS x, round(l_discount * 100) AS y, round(l_tax * 100) AS z, l_orderkey // 128 AS block, l_returnflag FROM lineitem
"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct points of each block as cells of width 1: ``x, y, z, block, cell_id``."""
    number = F.col("x") + 100 * (F.col("y") + 100 * (F.col("z") + 100 * F.col("block")))
    return points(spark, sf_dir).select("x", "y", "z", "block").distinct().withColumn("cell_id", number.cast("long"))


_CELLS = f"SELECT DISTINCT x, y, z, block, (x + 100 * (y + 100 * (z + 100 * block)))::BIGINT AS cell_id FROM ({_POINTS})"


def point_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = vector("x", "y", "z")
    located = points(spark, sf_dir).select("l_returnflag", *(s.location(p).alias(n) for n, s in (("in_box", BOX), ("in_ball", BALL), ("in_pipe", PIPE))))
    return located.groupBy("l_returnflag", "in_box", "in_ball", "in_pipe").agg(F.count("*").alias("n"))


def flow_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where points lie to an internal flow with a ball cut out, moved by one, and to an external flow around two shapes."""
    room = (internal(Box((0.0, 0.0, 0.0), (40.0, 8.0, 6.0))) - internal(Ball((20.0, 4.0, 3.0), 2.5))).translated((1.0, 1.0, 1.0))
    open_box = (-10.0, -10.0, -10.0), (70.0, 30.0, 30.0)
    around = external(Box((5.0, 2.0, 1.0), (15.0, 6.0, 5.0)), *open_box) & external(Ball((30.0, 5.0, 4.0), 3.0), *open_box)
    p = vector("x", "y", "z")
    located = points(spark, sf_dir).select(room.location(p).alias("room"), around.location(p).alias("around"))
    return located.groupBy("room", "around").agg(F.count("*").alias("n"))


def point_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = vector("x", "y", "z")
    box = box_distance(p, literal(10, 2, 2), literal(40, 8, 6))
    line = segment_distance(p, literal(0, 0, 0), literal(50, 10, 8))
    both = points(spark, sf_dir).select("l_returnflag", F.round(box, 6).alias("box"), F.round(line, 6).alias("line"))
    return both.groupBy("l_returnflag").agg(
        F.min("box").alias("min_box"), F.max("box").alias("max_box"), F.max("line").alias("max_line"), F.count_if(F.col("line") < 5).alias("near_line")
    )


def _typed(spark: SparkSession, sf_dir: str, shape: Shape) -> DataFrame:
    p = vector("x", "y", "z")
    return _cells(spark, sf_dir).select("cell_id", shape.cell_type(p, 1.0).alias("cell_type"), shape.faces(p, 1.0).alias("faces"))


def cell_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [_typed(spark, sf_dir, s).select(F.lit(n).alias("shape"), "cell_type") for n, s in (("box", BOX), ("ball", BALL))]
    return kinds[0].unionByName(kinds[1]).groupBy("shape", "cell_type").agg(F.count("*").alias("n"))


def face_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundary records of each face of the box; faces without any stay with 0."""
    faces = spark.range(6).select(F.col("id").cast("int").alias("face"))
    counted = _typed(spark, sf_dir, BOX).filter("cell_type = 1").select(F.explode("faces").alias("face")).groupBy("face").agg(F.count("*").alias("n"))
    return faces.join(counted, "face", "left").select("face", F.coalesce("n", F.lit(0)).alias("n"))


def link_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of lattice links on the ball, by link length."""
    p = vector("x", "y", "z")
    wet = _cells(spark, sf_dir).filter(BALL.level(p) < 0)
    hits = wall_links(wet, BALL, "D3Q19", 3.0, "cell_id")
    long_ = F.when(F.col("link") <= 6, 1).otherwise(2)
    return hits.groupBy(long_.alias("squared_length")).agg(F.count("*").alias("n"), F.round(F.min("q"), 9).alias("min_q"), F.round(F.max("q"), 9).alias("max_q"))


def hit_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, ranges and the bounding box of the points where lattice links meet the ball."""
    wet = _cells(spark, sf_dir).filter(BALL.level(vector("x", "y", "z")) < 0)
    found = face_hits(hit_points(wall_links(wet, BALL, "D3Q19", 3.0, "cell_id"), wet, "D3Q19", 3.0, "cell_id"))
    return found.select("face", "n", *(F.round(c, 6).alias(c) for c in found.columns[2:]))


def boolean_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union, intersection and difference of ball and pipe, by cell."""
    p = vector("x", "y", "z")
    shapes = {"union": BALL | PIPE, "intersection": BALL & PIPE, "difference": BALL - PIPE}
    wet = _cells(spark, sf_dir).select(*((s.level(p) < 0).alias(n) for n, s in shapes.items()))
    return wet.groupBy(*shapes).agg(F.count("*").alias("n"))


def boolean_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells by type and number of faces for the union, intersection and difference of slab and brick and the outside of their union."""
    p = vector("x", "y", "z")
    typed = [_cells(spark, sf_dir).select(F.lit(n).alias("shape"), s.cell_type(p, 1.0).alias("cell_type"), s.faces(p, 1.0).alias("faces")) for n, s in _MERGED.items()]
    members = reduce(DataFrame.unionByName, typed).withColumn("faces", F.array_join("faces", ","))
    return members.groupBy("shape", "cell_type", "faces").agg(F.count("*").alias("n"))


def boolean_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of boundary cells by the face that owns them; faces of the union inside the other part own none."""
    found = [wall_links(_cells(spark, sf_dir), s, "D3Q19", 1.0, "cell_id").withColumn("shape", F.lit(n)) for n, s in _MERGED.items()]
    hits = reduce(DataFrame.unionByName, found)
    return hits.groupBy("shape", "face").agg(F.count("*").alias("n"), F.min("q").alias("min_q"), F.round(F.sum("q"), 6).alias("sum_q"))


def near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    place = vectors.select(F.col("vec_id").alias("id"), *(F.round(F.col("embedding")[i].cast("double") * 1000).alias(c) for i, c in enumerate("xyz")))
    return mesh.close_pairs(place, 20.0)


def welded(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    place = vectors.select(F.col("vec_id").alias("id"), *(F.round(F.col("embedding")[i].cast("double") * 1000).alias(c) for i, c in enumerate("xyz")))
    found = mesh.weld(place, 20.0)
    numbers = mesh.dense_ids(found, "representative", "vertex_id")
    return found.join(numbers, "representative").select("id", "representative", "vertex_id")


_PLACES = "SELECT vec_id AS id, round(embedding[1]::DOUBLE * 1000) AS x, round(embedding[2]::DOUBLE * 1000) AS y, round(embedding[3]::DOUBLE * 1000) AS z FROM embeddings"
_PAIRS = f"""
    SELECT a.id AS a, b.id AS b FROM ({_PLACES}) a JOIN ({_PLACES}) b ON a.id < b.id
    AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 400
"""


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mesh from line items: a corner by part, one by supplier, one by line number."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return items.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("facet_id"), (F.col("l_partkey") % 97).alias("v0"), (100 + F.col("l_suppkey")).alias("v1"), (F.col("l_partkey") % 89 + 1000000).alias("v2")
    )


_INDEXED = "SELECT l_orderkey * 8 + l_linenumber AS facet_id, l_partkey % 97 AS v0, 100 + l_suppkey AS v1, l_partkey % 89 + 1000000 AS v2 FROM lineitem"
_EDGES = f"""
    SELECT facet_id, least(s, t) AS lo, greatest(s, t) AS hi, CASE WHEN s < t THEN 1 ELSE -1 END AS forward FROM (
        SELECT facet_id, v0 AS s, v1 AS t FROM ({_INDEXED}) UNION ALL SELECT facet_id, v1, v2 FROM ({_INDEXED}) UNION ALL SELECT facet_id, v2, v0 FROM ({_INDEXED}))
"""


def edge_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.edge_use(_indexed(spark, sf_dir)).groupBy("verdict").agg(F.count("*").alias("edges"), F.sum("uses").alias("uses"))


def repeated_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.duplicate_facets(_indexed(spark, sf_dir))


def mesh_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mesh.surface_components(_indexed(spark, sf_dir))
    return found.groupBy("component").agg(F.count("*").alias("facets"))


def _facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A triangle at each point, with legs by line number and return flag."""
    leg = (F.col("id") % 8).cast("double")
    width = F.when(F.col("l_returnflag") == "N", 1.0).otherwise(4.0)
    c = F.col
    corners = {"ax": c("x"), "ay": c("y"), "az": c("z"), "bx": c("x") + leg, "by": c("y"), "bz": c("z"), "cx": c("x"), "cy": c("y") + width, "cz": c("z") + 1.0}
    return points(spark, sf_dir).select(c("id").alias("facet_id"), *(e.alias(n) for n, e in corners.items()))


def facet_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.facet_summary(_facets(spark, sf_dir))


def box_facets(table: DataFrame, key: str, low: tuple[Column, ...], high: tuple[Column, ...]) -> DataFrame:
    """Twelve facets ``key, facet_id int`` and corners for each row's box, normals outward."""
    faces = [(0, 2, 1), (1, 2, 3), (4, 5, 6), (5, 7, 6), (0, 1, 4), (1, 5, 4), (2, 6, 3), (3, 6, 7), (0, 4, 2), (2, 4, 6), (1, 3, 5), (3, 7, 5)]
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("facet_id"), *(F.lit(i).alias(v) for v, i in zip("abc", f, strict=True))) for n, f in enumerate(faces))))
    ends = [F.array(lo.cast("double"), hi.cast("double")).alias(x) for x, lo, hi in zip("xyz", low, high, strict=True)]
    corners = [F.col(x)[F.shiftright(f"f.{v}", bit) % 2].alias(v + x) for v in "abc" for bit, x in enumerate("xyz")]
    return table.select(key, *ends, rows.alias("f")).select(key, "f.facet_id", *corners)


def points_in_solids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points strictly inside the boxes spanned by suppliers, each a closed mesh of twelve facets in the block of the supplier's key."""
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", (F.col("s_suppkey") % 20).cast("double").alias("o"))
    c = F.col("o") + 64 * F.col("s_suppkey")
    facets = box_facets(suppliers, "s_suppkey", (c + 0.25, F.lit(1.25), F.lit(0.75)), (c + 9.75, F.lit(6.75), F.lit(5.25)))
    inside = mesh.enclosed(_cells(spark, sf_dir).withColumn("x", F.col("x") + 64 * F.col("block")), facets, "s_suppkey", "cell_id")
    return inside.groupBy("s_suppkey").agg(F.count("*").alias("n"), F.min("cell_id").alias("first"))


def range_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' boxes, each in the block of its key, joined with occupied cells by an equi-join on cell indices."""
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    low = (F.col("s_suppkey") % 40 + 64 * F.col("s_suppkey")).cast("double")
    boxes = suppliers.select("s_suppkey", low.alias("lo_x"), (low + 3).alias("hi_x"), F.lit(2.0).alias("lo_y"), F.lit(4.0).alias("hi_y"), F.lit(1.0).alias("lo_z"), F.lit(3.0).alias("hi_z"))
    cells = _cells(spark, sf_dir).withColumn("x", F.col("x") + 64 * F.col("block")).select(*(F.col(a).cast("long").alias(f"cell_{a}") for a in "xyz"))
    return mesh.cells_of_boxes(boxes, 1.0, "s_suppkey").join(cells, ["cell_x", "cell_y", "cell_z"]).groupBy("s_suppkey").agg(F.count("*").alias("n"))


def morton_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir)
    return cells.select("cell_id", morton([F.col("x"), F.col("y"), F.col("z")], 6).alias("morton"))


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = points(spark, sf_dir).select(F.col("x").cast("long").alias("i"), (F.col("y") * 5 + F.col("id") % 5).cast("long").alias("j"))
    return refine(place, 6, 50)


def tree_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).groupBy("level").agg(F.count("*").alias("leaves"), F.sum("n").alias("points"))


def tree_interfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = _tree(spark, sf_dir).select(F.col("level").cast("int").alias("level"), "i", "j")
    return interfaces(leaves).groupBy("level").agg(F.count("*").alias("pairs"))


_LEAVES = """
    WITH p AS (SELECT l_quantity::BIGINT AS i, (round(l_discount * 100) * 5 + (l_orderkey * 8 + l_linenumber) % 5)::BIGINT AS j FROM lineitem),
    n AS (SELECT level, (i >> (6 - level)) AS i, (j >> (6 - level)) AS j, count(*) AS n FROM p, (SELECT unnest(range(7))::INTEGER AS level) GROUP BY ALL),
    s AS (SELECT * FROM n WHERE n > 50 AND level < 6),
    c AS (SELECT level + 1 AS level, i * 2 + q % 2 AS i, j * 2 + q // 2 AS j FROM s, (SELECT unnest(range(4)) AS q) UNION ALL SELECT 0, 0, 0),
    leaves AS (SELECT c.level, c.i, c.j, coalesce(n.n, 0) AS n FROM c ANTI JOIN s USING (level, i, j) LEFT JOIN n USING (level, i, j))
"""
_BOX_IN = "x > 0 AND x < 50 AND y > 0 AND y < 10 AND z > 0 AND z < 8"
_BALL = "(x - 25) * (x - 25) + (y - 5) * (y - 5) + (z - 4) * (z - 4) - 169"
_PIPE = "greatest((y - 5) * (y - 5) + (z - 4) * (z - 4) - 16, 10 - x, x - 40)"
_BOX = "greatest(-x, x - 50, -y, y - 10, -z, z - 8)"


def _where(level: str) -> str:
    return f"CASE WHEN {level} < 0 THEN 'wet' WHEN {level} = 0 THEN 'surface' ELSE 'dry' END"


def _box_in(a: Box, strict: bool = True) -> str:
    less = "<" if strict else "<="
    return " AND ".join(f"{lo} {less} {x} AND {x} {less} {hi}" for x, lo, hi in zip("xyz", a.low, a.high, strict=True))


def _outside(a: Box) -> str:
    return " OR ".join(f"{x} < {lo} OR {x} > {hi}" for x, lo, hi in zip("xyz", a.low, a.high, strict=True))


def _touched(a: Box) -> list[str]:
    """For each face, whether the cube of reach 1 about a cell meets it."""
    found = []
    for axis, x in enumerate("xyz"):
        others = " AND ".join(f"{y} + 1 >= {a.low[i]} AND {y} - 1 <= {a.high[i]}" for i, y in enumerate("xyz") if i != axis)
        found += [f"({x} - 1 <= {end} AND {x} + 1 >= {end} AND {others})" for end in (a.low[axis], a.high[axis])]
    return found


def _state(a: Box, wet: str) -> str:
    return f"CASE WHEN NOT ({wet}) THEN 0 WHEN {' OR '.join(_touched(a))} THEN 1 ELSE 2 END"


# For each merged shape: the conditions for its two parts to be wet, and whether a cell is the better of the two or the worse.
_PARTS = [("union", _box_in(SLAB), _box_in(BRICK), "greatest"), ("intersection", _box_in(SLAB), _box_in(BRICK), "least"),
          ("difference", _box_in(SLAB), _outside(BRICK), "least"), ("outside", _outside(SLAB), _outside(BRICK), "least")]
_FACES = ", ".join(f"CASE WHEN {part} = 1 AND {t} THEN {n}::VARCHAR END" for n, (part, t) in enumerate([("a", t) for t in _touched(SLAB)] + [("b", t) for t in _touched(BRICK)]))
_STATES = " UNION ALL ".join(
    f"SELECT '{name}' AS shape, *, {merged}(a, b) AS cell_type FROM (SELECT x, y, z, cell_id, {_state(SLAB, first)} AS a, {_state(BRICK, second)} AS b FROM ({_CELLS}))"
    for name, first, second, merged in _PARTS
)
_BOX_SIDES = [(axis, end, box, face) for base, box in ((0, SLAB), (6, BRICK)) for face, axis, end in ((base + 2 * i + s, i, (box.low, box.high)[s][i]) for i in range(3) for s in (0, 1))]
_RAW_HITS = " UNION ALL ".join(
    f"SELECT shape, cell_id, a, b, x, y, z, ex, ey, ez, {face} AS face, ({end} - {'xyz'[axis]}) / e{'xyz'[axis]} AS q, "
    + " AND ".join(f"{y} + (({end} - {'xyz'[axis]}) / e{'xyz'[axis]}) * e{y} BETWEEN {box.low[i]} AND {box.high[i]}" for i, y in enumerate("xyz") if i != axis)
    + f" AS on_face FROM l WHERE e{'xyz'[axis]} <> 0"
    for axis, end, box, face in _BOX_SIDES
)


_NEAR = "(greatest(abs(x - 25) - 1, 0)) ** 2 + (greatest(abs(y - 5) - 1, 0)) ** 2 + (greatest(abs(z - 4) - 1, 0)) ** 2"
_FAR = "(abs(x - 25) + 1) ** 2 + (abs(y - 5) + 1) ** 2 + (abs(z - 4) + 1) ** 2"
_MORTON = " + ".join(f"((({a}::BIGINT >> {b}) & 1) << {3 * b + k})" for k, a in enumerate("xyz") for b in range(6))

QUERIES = {
    f.__name__: f
    for f in (
        point_location, flow_location, point_distances, cell_types, face_members, link_hits, hit_faces, boolean_cells, boolean_types, boolean_links, near_pairs, welded, edge_verdicts, repeated_facets, mesh_components,
        facet_measures, points_in_solids, range_cells, morton_order, tree_leaves, tree_interfaces,
    )
}

SQL = {
    "point_location": f"""
        SELECT l_returnflag, {_where(_BOX)} AS in_box, {_where(_BALL)} AS in_ball, {_where(_PIPE)} AS in_pipe, count(*) AS n FROM ({_POINTS}) GROUP BY ALL
    """,
    "flow_location": f"""
        WITH d AS (SELECT greatest(1 - x, x - 41, 1 - y, y - 9, 1 - z, z - 7) AS box, (x - 21) ** 2 + (y - 5) ** 2 + (z - 4) ** 2 - 6.25 AS hole,
                          greatest(5 - x, x - 15, 2 - y, y - 6, 1 - z, z - 5) AS block, (x - 30) ** 2 + (y - 5) ** 2 + (z - 4) ** 2 - 9 AS ball FROM ({_POINTS}))
        SELECT CASE WHEN greatest(box, -hole) < 0 THEN 'wet' WHEN greatest(box, -hole) = 0 THEN 'surface' ELSE 'dry' END AS room,
               CASE WHEN least(block, ball) > 0 THEN 'wet' WHEN least(block, ball) = 0 THEN 'surface' ELSE 'dry' END AS around, count(*) AS n FROM d GROUP BY ALL
    """,
    "point_distances": f"""
        WITH d AS (SELECT l_returnflag, greatest(10 - x, x - 40) AS dx, greatest(2 - y, y - 8) AS dy, greatest(2 - z, z - 6) AS dz,
                          greatest(0, least(1, (50 * x + 10 * y + 8 * z) / 2664)) AS t, x, y, z FROM ({_POINTS})),
        e AS (SELECT l_returnflag, round(sqrt(greatest(dx, 0) ** 2 + greatest(dy, 0) ** 2 + greatest(dz, 0) ** 2) + least(greatest(dx, dy, dz), 0), 6) AS box,
                     round(sqrt((x - t * 50) ** 2 + (y - t * 10) ** 2 + (z - t * 8) ** 2), 6) AS line FROM d)
        SELECT l_returnflag, min(box) AS min_box, max(box) AS max_box, max(line) AS max_line, count(*) FILTER (WHERE line < 5) AS near_line FROM e GROUP BY 1
    """,
    "cell_types": f"""
        SELECT 'box' AS shape, CASE WHEN NOT ({_BOX_IN}) THEN 0 WHEN x <= 1 OR x >= 49 OR y <= 1 OR y >= 9 OR z <= 1 OR z >= 7 THEN 1 ELSE 2 END AS cell_type, count(*) AS n
        FROM ({_CELLS}) GROUP BY 2 UNION ALL
        SELECT 'ball', CASE WHEN {_BALL} >= 0 THEN 0 WHEN {_NEAR} <= 169 AND {_FAR} >= 169 THEN 1 ELSE 2 END AS cell_type, count(*) FROM ({_CELLS}) GROUP BY 2
    """,
    "face_members": f"""
        WITH c AS (SELECT * FROM ({_CELLS}) WHERE {_BOX_IN})
        SELECT face::INTEGER AS face, n FROM (
            SELECT 0 AS face, count(*) FILTER (WHERE x <= 1) AS n FROM c UNION ALL SELECT 1, count(*) FILTER (WHERE x >= 49) FROM c UNION ALL
            SELECT 2, count(*) FILTER (WHERE y <= 1) FROM c UNION ALL SELECT 3, count(*) FILTER (WHERE y >= 9) FROM c UNION ALL
            SELECT 4, count(*) FILTER (WHERE z <= 1) FROM c UNION ALL SELECT 5, count(*) FILTER (WHERE z >= 7) FROM c)
    """,
    "link_hits": f"""
        WITH c AS (SELECT x - 25 AS x, y - 5 AS y, z - 4 AS z FROM ({_CELLS}) WHERE {_BALL} < 0),
        s AS (SELECT unnest([-3, 0, 3])::DOUBLE AS v),
        l AS (SELECT a.v AS ex, b.v AS ey, d.v AS ez, a.v ** 2 + b.v ** 2 + d.v ** 2 AS ee FROM s a, s b, s d),
        q AS (SELECT (ee / 9)::INTEGER AS squared_length,
                     (-(x * ex + y * ey + z * ez) + sqrt((x * ex + y * ey + z * ez) ** 2 - ee * (x * x + y * y + z * z - 169))) / ee AS q FROM c, l WHERE ee IN (9, 18))
        SELECT squared_length, count(*) AS n, round(min(q), 9) AS min_q, round(max(q), 9) AS max_q FROM q WHERE q <= 1 GROUP BY 1
    """,
    "hit_faces": f"""
        WITH c AS (SELECT DISTINCT x - 25 AS x, y - 5 AS y, z - 4 AS z, cell_id FROM ({_CELLS}) WHERE {_BALL} < 0),
        s AS (SELECT unnest([-3, 0, 3])::DOUBLE AS v),
        l AS (SELECT a.v AS ex, b.v AS ey, d.v AS ez, a.v ** 2 + b.v ** 2 + d.v ** 2 AS ee FROM s a, s b, s d),
        q AS (SELECT *, (-(x * ex + y * ey + z * ez) + sqrt((x * ex + y * ey + z * ez) ** 2 - ee * (x * x + y * y + z * z - 169))) / ee AS q FROM c, l WHERE ee IN (9, 18))
        SELECT 0 AS face, count(*) AS n, round(min(q), 6) AS min_q, round(max(q), 6) AS max_q, round(min(25 + x + q * ex), 6) AS min_x, round(max(25 + x + q * ex), 6) AS max_x,
               round(min(5 + y + q * ey), 6) AS min_y, round(max(5 + y + q * ey), 6) AS max_y, round(min(4 + z + q * ez), 6) AS min_z, round(max(4 + z + q * ez), 6) AS max_z FROM q WHERE q <= 1
    """,
    "boolean_cells": f"""
        SELECT ({_BALL} < 0 OR {_PIPE} < 0) AS "union", ({_BALL} < 0 AND {_PIPE} < 0) AS "intersection", ({_BALL} < 0 AND {_PIPE} > 0) AS "difference", count(*) AS n
        FROM ({_CELLS}) GROUP BY ALL
    """,
    "boolean_types": f"""
        SELECT shape, cell_type, CASE WHEN cell_type = 1 THEN concat_ws(',', {_FACES}) ELSE '' END AS faces, count(*) AS n FROM ({_STATES}) GROUP BY ALL
    """,
    # A union's cell at the boundary of both keeps hits that the other box does not hold strictly inside.
    "boolean_links": f"""
        WITH c AS (SELECT * FROM ({_STATES}) WHERE cell_type = 1), s AS (SELECT unnest([-1, 0, 1])::DOUBLE AS v),
        e AS (SELECT u.v AS ex, v.v AS ey, w.v AS ez FROM s u, s v, s w WHERE u.v ** 2 + v.v ** 2 + w.v ** 2 IN (1, 2)),
        l AS (SELECT * FROM c, e), r AS ({_RAW_HITS}),
        h AS (SELECT *, x + q * ex AS px, y + q * ey AS py, z + q * ez AS pz FROM r WHERE q > 0 AND q <= 1 AND on_face),
        k AS (SELECT * FROM h WHERE CASE WHEN shape = 'union' AND a = 1 AND b = 1 THEN
                NOT (CASE WHEN face < 6 THEN {_box_in(BRICK).replace("x", "px").replace("y", "py").replace("z", "pz")} ELSE {_box_in(SLAB).replace("x", "px").replace("y", "py").replace("z", "pz")} END)
                ELSE CASE WHEN face < 6 THEN a = 1 ELSE b = 1 END END),
        o AS (SELECT shape, cell_id, ex, ey, ez, min({{'q': q, 'face': face}}) AS hit FROM k GROUP BY ALL)
        SELECT shape, hit.face AS face, count(*) AS n, min(hit.q) AS min_q, round(sum(hit.q), 6) AS sum_q FROM o GROUP BY ALL
    """,
    "near_pairs": _PAIRS,
    "welded": f"""
        WITH RECURSIVE e AS ({_PAIRS}), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        r AS (SELECT id, id AS seen FROM ({_PLACES}) UNION SELECT r.id, u.b FROM r JOIN u ON r.seen = u.a),
        m AS (SELECT id, min(seen) AS representative FROM r GROUP BY id)
        SELECT id, representative, dense_rank() OVER (ORDER BY representative) - 1 AS vertex_id FROM m
    """,
    "edge_verdicts": f"""
        SELECT verdict, count(*) AS edges, sum(uses)::BIGINT AS uses FROM (
            SELECT count(*) AS uses, CASE WHEN count(*) = 1 THEN 'open' WHEN count(*) > 2 THEN 'non_manifold' WHEN sum(forward) = 0 THEN 'closed' ELSE 'winding' END AS verdict
            FROM ({_EDGES}) GROUP BY lo, hi) GROUP BY verdict
    """,
    "repeated_facets": f"""
        SELECT v0, v1, v2, n, repeat FROM (
            SELECT least(v0, v1, v2) AS v0, v0 + v1 + v2 - least(v0, v1, v2) - greatest(v0, v1, v2) AS v1, greatest(v0, v1, v2) AS v2, facet_id AS repeat,
                   count(*) OVER (PARTITION BY list_sort([v0, v1, v2])) AS n, row_number() OVER (PARTITION BY list_sort([v0, v1, v2]) ORDER BY facet_id) AS k
            FROM ({_INDEXED})) WHERE k = 2
    """,
    "mesh_components": f"""
        WITH RECURSIVE v AS (SELECT DISTINCT v0 AS p FROM ({_INDEXED})),
        e AS MATERIALIZED (SELECT facet_id, lo || '-' || hi AS edge FROM ({_EDGES})),
        f AS MATERIALIZED (SELECT edge, min(facet_id) AS first FROM e GROUP BY edge),
        l AS MATERIALIZED (SELECT DISTINCT first AS a, facet_id AS b FROM e JOIN f USING (edge)),
        u AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
        r(node, label, round) AS (SELECT a, min(b), 0 FROM u GROUP BY a
            UNION ALL SELECT node, label, round FROM (
                SELECT u.a AS node, min(r.label) AS label, max(r.round) + 1 AS round FROM r JOIN u ON u.b = r.node GROUP BY u.a) WHERE round <= 40)
        SELECT component, count(*) AS facets FROM (SELECT node, min(label) AS component FROM r GROUP BY node) GROUP BY component
    """,
    "facet_measures": f"""
        WITH t AS (SELECT x, y, z, (id % 8)::DOUBLE AS leg, CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 4.0 END AS w FROM ({_POINTS})),
        q AS (SELECT *, leg * sqrt(w * w + 1) AS size, leg * leg + (w * w + 1) + (leg * leg + w * w + 1) AS total FROM t)
        SELECT count(*) AS n_facets, count(*) FILTER (WHERE size = 0) AS n_degenerate, count(*) FILTER (WHERE size > 0 AND 2 * sqrt(3) * size / total < 0.2) AS n_poor,
               min(x) AS min_x, max(x + leg) AS max_x, min(y) AS min_y, max(y + w)::DOUBLE AS max_y, min(z) AS min_z, max(z + 1) AS max_z FROM q
    """,
    "points_in_solids": f"""
        SELECT s_suppkey, count(*) AS n, min(cell_id) AS first FROM supplier JOIN ({_CELLS})
        ON block = s_suppkey AND x > s_suppkey % 20 + 0.25 AND x < s_suppkey % 20 + 9.75 AND y > 1.25 AND y < 6.75 AND z > 0.75 AND z < 5.25 GROUP BY 1
    """,
    "range_cells": f"""
        SELECT s_suppkey, count(*) AS n FROM supplier JOIN ({_CELLS}) ON block = s_suppkey AND x BETWEEN s_suppkey % 40 AND s_suppkey % 40 + 3 AND y BETWEEN 2 AND 4 AND z BETWEEN 1 AND 3 GROUP BY 1
    """,
    "morton_order": f"SELECT cell_id, {_MORTON} AS morton FROM ({_CELLS})",
    "tree_leaves": f"{_LEAVES} SELECT level, count(*) AS leaves, sum(n)::BIGINT AS points FROM leaves GROUP BY level",
    "tree_interfaces": f"""
        {_LEAVES} SELECT a.level, count(*) AS pairs FROM leaves a JOIN leaves b ON b.level = a.level + 1 AND (
            (b.i IN (2 * a.i - 1, 2 * a.i + 2) AND b.j IN (2 * a.j, 2 * a.j + 1)) OR (b.j IN (2 * a.j - 1, 2 * a.j + 2) AND b.i IN (2 * a.i, 2 * a.i + 1))) GROUP BY a.level
    """,
}
