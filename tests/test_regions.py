"""Regions, rules and units against plain recomputation; cell files read back."""

import math
import struct
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import regions
from tessera.sources import cases, units, vtk


def relation(spark, region, low, high):
    row = spark.range(1).select(region.relation(tuple(map(F.lit, low)), tuple(map(F.lit, high))).alias("r")).first()
    return row.r


def test_relations_and_algebra(spark):
    box, ball = regions.BoxRegion((0.0, 0.0, 0.0), (4.0, 4.0, 4.0)), regions.BallRegion((2.0, 2.0, 2.0), 1.0)
    pipe = regions.CylinderRegion(2, (2.0, 2.0), 1.5, 0.0, 4.0)
    inner, edge, beside = ((1.9,) * 3, (2.1,) * 3), ((2.8,) * 3, (3.2,) * 3), ((4.0, 0.0, 0.0), (5.0, 1.0, 1.0))
    assert [relation(spark, box, *b) for b in (inner, edge, beside)] == [1, 1, -1]
    assert [relation(spark, ball, *b) for b in (inner, beside)] == [1, -1]
    assert [relation(spark, box - ball, *b) for b in (inner, beside)] == [-1, -1]
    assert [relation(spark, ~ball | ball, *inner), relation(spark, ball & pipe, *inner)] == [1, 1]
    assert relation(spark, ball, (1.0, 1.9, 1.9), (1.3, 2.1, 2.1)) == 0
    assert relation(spark, regions.BallRegion((F.lit(None).cast("double"), 0.0, 0.0), 1.0), *inner) is None
    with pytest.raises(ValueError, match="no such face"):
        regions.Rule(ball, 1, 0.1, (1,))
    with pytest.raises(ValueError, match="finite"):
        regions.Rule(ball, 1, float("inf"))


def test_bands_lose_no_cell_near_a_chosen_face(spark):
    pipe = regions.CylinderRegion(0, (0.0, 0.0), 1.0, -1.0, 1.0)
    cells = spark.createDataFrame([(i, j, k, None) for i, j, k in product(range(-8, 8), repeat=3)], "i int, j int, k int, note string")
    box = regions.node_box(0, "ijk", (0.0, 0.0, 0.0), 0.25)
    got = {(r.i, r.j, r.k) for r in cells.filter(pipe.near(*box, 0.1, (2,))).collect()}
    wanted, far = set(), set()
    for c in product(range(-8, 8), repeat=3):
        p = np.stack(np.meshgrid(*[np.linspace(x / 4, x / 4 + 0.25, 6) for x in c]), -1).reshape(-1, 3)
        d = np.hypot(p[:, 0] - 1, np.maximum(np.hypot(p[:, 1], p[:, 2]) - 1, 0)).min()
        (wanted if d <= 0.1 else far if d > 0.1 + 0.25 * math.sqrt(3) else set()).add(c)
    assert wanted <= got and not got & far


def test_leaves_tile_the_domain_and_follow_the_rules(spark):
    ball = regions.BallRegion((F.col("cx"), 1.0), F.col("r"))
    roots = spark.createDataFrame([(n, i, j, float(n), None if n == 2 else 0.3) for n in range(3) for i in range(2) for j in range(2)], "id int, i int, j int, cx double, r double")
    rules = [regions.Rule(ball, 3), regions.Rule(~ball, 4, 0.02)]
    fluid = regions.BoxRegion((0.0, 0.0), (2.0, 2.0))
    leaves = regions.refine_by_rules(roots, rules, fluid, "ij", (0.0, 0.0), 1.0).collect()
    for n in range(3):
        own = [r for r in leaves if r.id == n]
        assert sum(4.0**-r.level for r in own) == 4
        assert max(r.level for r in own) == (0 if n == 2 else 4)
    assert all(r.wet for r in leaves)
    dry = regions.refine_by_rules(roots, rules[:1], ~regions.BallRegion((F.col("cx"), 1.0), 0.3), "ij", (0.0, 0.0), 1.0).collect()
    assert {r.wet for r in dry} == {True, False} and all(math.dist(((r.i + 0.5) / 2**r.level, (r.j + 0.5) / 2**r.level), (r.cx, 1.0)) < 0.3 for r in dry if not r.wet)
    for r in leaves:
        if r.r is not None and r.level < 3:
            h = 0.5**r.level
            assert math.dist(((r.i + 0.5) * h, (r.j + 0.5) * h), (r.cx, 1.0)) - r.r > h / math.sqrt(2)
    assert regions.refine_by_rules(roots.limit(0), rules, fluid, "ij", (0.0, 0.0), 1.0).isEmpty()
    assert regions.refine_by_rules(roots, [], fluid, "ij", (0.0, 0.0), 1.0).count() == 12


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("kg/m^3", "kg^1 m^-3"), ("kg m^-1 s^-1", "kg^1 m^-1 s^-1"), ("a/b*c", "a^1 b^-1 c^1"), ("[kg*(m)]^(1/2)", "kg^1/2 m^1/2"), ("a/[b/(c*(d))]", "a^1 b^-1 c^1 d^1"),
        ("{[(m)s^-2]}^[3/2]", "m^3/2 s^-3"), ("m^(1/-2)", "m^-1/2"), ("([m])", None), ("m^", None), ("", None), ("m/", None), ("m*/s", None), ("m^(1/0)", None), ("m^(1/2]", None),
        ("m^2^3", None), ("(m", None), ("m)", None), ("(" * 5000, None), ("m^2 3", None), ("µ", None),
    ],
)
def test_unit_grammar(text, expected):
    found = units.flat_unit(text)
    assert (found and " ".join(f"{s}^{e}" for s, e in found)) == expected


def test_units_of_cases(spark):
    lines = ["a = 4 kPa^(1/2)", "b = 2 m^(99999999999)", "c = 1 (m)(s)", "d = 3", "e = 2 kg*m", "f = 2 s^-1", "g = 1 m^-2/s"]
    rows = cases.parse_cases(cases.case_lines(spark.createDataFrame([(1, "\n".join(lines)), (2, None), (3, "")], "case_id long, text string")))
    got = {r.name: r for r in rows.withColumn("unit", units.si_text(F.col("exponents"))).collect()}
    assert got["a"].value == pytest.approx(4 * math.sqrt(1000)) and got["a"].dims is None
    assert [got[n].kind for n in "abcde"] == ["quantity", "error", "quantity", "quantity", "quantity"]
    assert [got[n].unit for n in "abcdefg"] == ["(kg^1/2)/(m^1/2*s)", None, "(m*s)", "", "(kg*m)", "s^-1", "m^-2*s^-1"]
    assert got["c"].dims == [1, 0, 1, 0]


def test_cell_files(spark, tmp_path):
    spark.dataSource.register(vtk.VtkSource)
    cells = spark.range(10).repartition(3).selectExpr("id * 1D AS x", "0D AS y", "0D AS z", "0.5D AS side", "id % 3 AS kind", "if(id = 4, NULL, id / 2) AS v")
    folder = tmp_path / "cells"
    cells.write.format("vtk").mode("append").option("path", str(folder)).save()
    seen = {}
    for path in folder.iterdir():
        data = path.read_bytes()
        assert path.suffix == ".vtk" and data.startswith(b"# vtk DataFile Version 3.0\n")
        head, rest = data.split(b" double\n", 1)
        n = int(head.split(b"POINTS ")[1]) // 8
        points = np.frombuffer(rest, ">f8", n * 24).reshape(n, 8, 3)
        values = np.frombuffer(data.split(b"SCALARS v double 1\nLOOKUP_TABLE default\n")[1], ">f8", n)
        seen |= {p[0, 0]: (p[6] - p[0], v) for p, v in zip(points, values, strict=True)}
        assert struct.unpack(">i", data.split(b"CELL_TYPES %d\n" % n)[1][:4]) == (12,)
    assert sorted(seen) == list(range(10)) and all((d == 0.5).all() for d, _ in seen.values())
    assert math.isnan(seen[4][1]) and seen[5][1] == 2.5
    with pytest.raises(Exception, match="not numeric"):
        cells.withColumn("s", F.lit("a")).write.format("vtk").mode("append").option("path", str(folder)).save()
