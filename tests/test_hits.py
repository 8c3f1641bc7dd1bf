"""Points where links meet surfaces, their statistics, boxes as lines and hits that do not belong."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import shapes
from tessera.operators.shapes import BOUNDARY, INTERIOR, Box


def test_hit_points_lie_on_the_faces_of_a_box(spark):
    box = Box((0.3, 0.4, 0.2), (5.6, 4.7, 3.9))
    cells = shapes.grid(spark, (0.0, 0.0, 0.0), (6, 5, 4), 1.0).filter("x > 0.3 and y > 0.4 and z > 0.2 and x < 5.6 and y < 4.7 and z < 3.9")
    points = shapes.hit_points(shapes.wall_links(cells, box, "D3Q19", 1.0, "cell_id"), cells, "D3Q19", 1.0, "cell_id")
    rows = points.collect()
    assert rows and len({r.face for r in rows}) == 6
    for r in rows:
        assert min(abs(a - b) for p, lo, hi in zip((r.x, r.y, r.z), (0.3, 0.4, 0.2), (5.6, 4.7, 3.9), strict=True) for a, b in ((p, lo), (p, hi))) < 1e-12
    for r in shapes.face_hits(points).collect():
        own = [p for p in rows if p.face == r.face]
        assert (r.n, r.min_q, r.max_q, r.min_x, r.max_z) == (len(own), min(p.q for p in own), max(p.q for p in own), min(p.x for p in own), max(p.z for p in own))
    assert shapes.face_hits(points.limit(0)).collect() == []


def test_a_box_has_twelve_edges(spark):
    boxes = spark.createDataFrame([(7, 0.0, 1.0, 2.0, 4.0, 5.0, 8.0)], "id long, min_x double, max_x double, min_y double, max_y double, min_z double, max_z double")
    lines = shapes.box_lines(boxes, ["id"]).collect()
    found = {frozenset(((r.ax, r.ay, r.az), (r.bx, r.by, r.bz))) for r in lines}
    corners = [(x, y, z) for x in (0.0, 1.0) for y in (2.0, 4.0) for z in (5.0, 8.0)]
    assert len(lines) == 12 and found == {frozenset((a, b)) for a in corners for b in corners if sum(p != q for p, q in zip(a, b, strict=True)) == 1}


@pytest.mark.parametrize("change, fault", [("cell_id = 0", "no cell"), ("cell_type", "not boundary"), ("x", "centre"), ("q", "range"), (None, None)])
def test_hits_that_do_not_belong(spark, change, fault):
    cells = shapes.grid(spark, (0.0, 0.0, 0.0), (2, 2, 2), 0.5).withColumn("cell_type", F.lit(BOUNDARY))
    hits = spark.createDataFrame([(0, 3, 0.5), (5, 1, 1.0)], "cell_id long, link int, q double")
    first = F.col("cell_id") == 0
    if change == "cell_id = 0":
        cells = cells.filter("cell_id <> 0")
    elif change == "cell_type":
        cells = cells.withColumn("cell_type", F.when(first, INTERIOR).otherwise(F.col("cell_type")))
    elif change == "x":
        cells = cells.withColumn("x", F.when(first, F.col("x") + 1e-12).otherwise(F.col("x")))
    elif change == "q":
        hits = hits.withColumn("q", F.when(~first, F.col("q")))
    expected = [(fault, 0, 3)] if fault else []
    assert [tuple(r) for r in shapes.hit_faults(hits, cells, (0.0, 0.0, 0.0), 0.5, "cell_id").collect()] == expected
