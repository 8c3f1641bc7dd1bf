"""Operators against figures that follow by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import numbers
from tessera.functions.vectors import vector
from tessera.operators import mesh, partition, shapes, sparse, tree
from tessera.plans.scans import sums_before
from tessera.sources import cases, stl

TETRAHEDRON = [((0, 0, 0), (0, 1, 0), (1, 0, 0)), ((0, 0, 0), (1, 0, 0), (0, 0, 1)), ((0, 0, 0), (0, 0, 1), (0, 1, 0)), ((1, 0, 0), (0, 1, 0), (0, 0, 1))]


def facets(spark, triangles, solid=0):
    rows = [(i, solid, *(float(c) for corner in t for c in corner)) for i, t in enumerate(triangles)]
    return spark.createDataFrame(rows, "facet_id long, solid int, " + ", ".join(f"{v}{a} double" for v in "abc" for a in "xyz"))


def test_box_of_six_cells(spark):
    """A box of 6 x 6 x 6 cells has 216 wet cells: 152 at the boundary, 64 inside, and 36 + 36 records at each pair of faces."""
    box = shapes.Box((0, 0, 0), (6, 6, 6))
    p = vector("x", "y", "z")
    cells = shapes.grid(spark, (0, 0, 0), (6, 6, 6), 1.0).select("cell_id", "x", "y", "z", box.cell_type(p, 1.0).alias("t"), box.faces(p, 1.0).alias("faces"))
    assert dict(map(tuple, cells.groupBy("t").count().collect())) == {1: 152, 2: 64}
    assert cells.filter("t = 1").select(F.explode("faces")).count() == 216
    hits = shapes.wall_links(cells, box, "D3Q19", 1.0, "cell_id")
    assert hits.filter("q <= 0 or q > 1").isEmpty()
    # Five of the 18 links leave the box through each wall cell's own face.
    assert hits.filter("cell_id = 14 + 36 * 0").count() == 5
    assert hits.groupBy("cell_id", "link").count().filter("count > 1").isEmpty()


@pytest.mark.parametrize(("model", "links"), [("D2Q9", 9), ("D3Q15", 15), ("D3Q19", 19), ("D3Q27", 27)])
def test_lattices(spark, model, links):
    rows = shapes.lattice(spark, model).collect()
    assert len(rows) == links
    assert math.isclose(sum(r.weight for r in rows), 1)
    assert math.isclose(sum(r.weight * r.ex * r.ex for r in rows), 1 / 3)


def test_round_hits_use_the_nearest_wall(spark):
    p = spark.createDataFrame([(0, 4.5, 0.0, 0.0)], "cell_id long, x double, y double, z double")
    hits = {r.link: r for r in shapes.wall_links(p, shapes.Ball((0, 0, 0), 5), "D3Q15", 1.0, "cell_id").collect()}
    assert sorted(round(r.q, 12) for r in hits.values())[-1] <= 1
    assert any(r.q == 0.5 for r in hits.values())


def test_tetrahedron(spark):
    t = facets(spark, TETRAHEDRON)
    assert math.isclose(mesh.signed_volumes(t, "solid").first().volume, 1 / 6)
    corners = t.select("facet_id", *(F.expr(f"cast({v}x + 2 * {v}y + 4 * {v}z as long)").alias(f"v{i}") for i, v in enumerate("abc")))
    assert {tuple(r) for r in mesh.edge_use(corners).groupBy("verdict").count().collect()} == {("closed", 6)}
    assert mesh.surface_components(corners).filter("component <> 0").isEmpty()
    assert mesh.edge_use(corners.filter("facet_id < 3")).filter("verdict = 'open'").count() == 3
    points = spark.createDataFrame([(1, 0.1, 0.1, 0.1), (2, 0.9, 0.9, 0.9), (3, 0.4, 0.4, 0.4)], "id long, x double, y double, z double")
    assert [r.id for r in mesh.enclosed(points, t, "solid").collect()] == [1]


def test_weld_is_transitive(spark):
    rows = [(5, 0.0), (3, 0.9), (9, 1.8), (1, 5.0)]
    points = spark.createDataFrame([(i, x, 0.0, 0.0) for i, x in rows], "id long, x double, y double, z double")
    assert dict(map(tuple, mesh.weld(points, 1.0).collect())) == {5: 3, 3: 3, 9: 3, 1: 1}


def test_nesting(spark):
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "outer long, inner long")
    assert {tuple(r) for r in mesh.nesting(pairs).collect()} == {(2, 1, 1), (3, 2, 2)}


def test_stl_round_trip(spark, tmp_path):
    corners = np.array(TETRAHEDRON, "<f4")
    records = np.zeros(4, stl._RECORD)
    records["numbers"][:, 3:] = corners.reshape(4, 9)
    (tmp_path / "a.stl").write_bytes(b"\0" * 80 + (4).to_bytes(4, "little") + records.tobytes())
    binary = stl.read_stl(spark, str(tmp_path / "a.stl"))
    blocks = [r.block for r in stl.ascii_lines(binary).orderBy("facet_id").collect()]
    (tmp_path / "b.stl").write_text("solid a\n" + "\n".join(blocks) + "\nendsolid a\n")
    text = stl.read_stl(spark, str(tmp_path / "b.stl"))
    assert sorted(binary.drop("path").collect()) == sorted(text.drop("path").collect())
    for broken in (b"", b"solid x\nfacet\nendsolid", b"solid x\nendsolid x extra words"):
        with pytest.raises(ValueError):
            stl.parse_stl(broken)


def test_tree_balance(spark):
    """One deep corner: after balance, neighbours differ by one level, and leaves still tile the square."""
    points = spark.createDataFrame([(0, 0)] * 5, "i long, j long")
    leaves = tree.refine(points, 4, 2).select("level", "i", "j")
    inner = spark.createDataFrame([(31, 31)] * 5, "i long, j long")
    leaves = tree.balance(tree.refine(inner, 6, 2).select("level", "i", "j"), 6)
    rows = [tuple(r) for r in leaves.collect()]
    assert math.isclose(sum(4.0**-l for l, _, _ in rows), 1)
    boxes = [(i / 2**l, j / 2**l, 1 / 2**l, l) for l, i, j in rows]
    for x, y, w, l in boxes:
        for u, v, s, m in boxes:
            if x <= u + s and u <= x + w and y <= v + s and v <= y + w:
                assert abs(l - m) <= 1


def test_partition_of_a_chain(spark):
    atoms = spark.createDataFrame([(i, i, i + 1, 1.0) for i in range(8)], "atom_id long, lo long, hi long, work double")
    owners = partition.bisected(atoms, 2)
    assert [r.work for r in partition.rank_loads(atoms, owners).orderBy("rank").collect()] == [2.0] * 4
    assert partition.imbalance(partition.rank_loads(atoms, owners)).first().imbalance == 1
    edges = spark.createDataFrame([(i, i + 1) for i in range(7)], "a long, b long")
    assert partition.ghosts(edges, owners).count() == 6
    cuts = partition.legal_cuts(atoms.withColumn("g", F.lit(0)), "g")
    assert [(r.plane, r.below) for r in cuts.orderBy("plane").collect()] == [(i, float(i)) for i in range(1, 8)]


def test_page_rank_with_a_sink(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (1, 3, 1.0), (2, 3, 1.0)], "a long, b long, w double")
    ranks = {r.node: r["rank"] for r in sparse.page_rank(edges, 50).collect()}
    assert math.isclose(sum(ranks.values()), 1)
    assert ranks[3] > ranks[2] > ranks[1]


def test_page_rank_restarts_where_told(spark):
    """A walk from node 5, which has no out-edge, never leaves it; from node 1 it stops once ranks stand still."""
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0), (2, 3, 3.0), (4, 5, 1.0)], "a long, b long, w double")
    home = lambda node: spark.createDataFrame([(node, 1.0)], "node long, share double")
    assert {r.node: r["rank"] for r in sparse.page_rank(edges, 3, restart=home(5)).collect()} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 1}
    ranks = {r.node: r["rank"] for r in sparse.page_rank(edges, 200, restart=home(1), tolerance=1e-5).collect()}
    one, two, three = (ranks[i] for i in (1, 2, 3))
    assert ranks[4] == ranks[5] == 0 and math.isclose(one + two + three, 1)
    assert math.isclose(two, 0.85 * one, rel_tol=1e-3) and math.isclose(three, 0.85 * 0.75 * two, rel_tol=1e-3) and math.isclose(one, 0.15 + 0.85 * (three + two / 4), rel_tol=1e-3)


def test_rational_arithmetic(spark):
    from fractions import Fraction

    pairs = [(1, 2, 1, 3), (-3, 4, 3, 4), (5, 7, 0, 1), (2971215073, 1836311903, 1, 1), (0, 1, -2, 9)]
    table = spark.createDataFrame(pairs, "a long, b long, c long, d long")
    x, y = numbers.rational(F.col("a"), F.col("b")), numbers.rational(F.col("c"), F.col("d"))
    for r, (a, b, c, d) in zip(table.select(numbers.rational_subtract(x, y), numbers.rational_divide(x, y), numbers.rational_negate(x), numbers.rational_at_most(x, y), x).collect(), pairs, strict=True):
        p, q = Fraction(a, b), Fraction(c, d)
        assert Fraction(*r[0]) == p - q and (r[1] is None if q == 0 else Fraction(*r[1]) == p / q) and Fraction(*r[2]) == -p and r[3] == (p <= q) and Fraction(*r[4]) == p


def test_scalings(spark):
    m = spark.createDataFrame([(0, 0, 4.0), (0, 1, 1.0), (1, 1, 2.0)], "row long, col long, val double")
    got = lambda df: {(r.row, r.col): round(r.val, 6) for r in df.collect()}
    assert got(sparse.scale(m, "maxtf")) == {(0, 0): 1.0, (0, 1): 0.625, (1, 1): 1.0}
    assert got(sparse.scale(m, "maxtf2"))[0, 1] == 0.325
    assert got(sparse.scale(m, "sqrt"))[0, 0] == 2.1
    assert got(sparse.scale(m.withColumn("val", -F.col("val")), "pow25"))[0, 0] == round(0.1 - 4**0.25, 6)
    assert got(sparse.scale(m.withColumn("val", -F.col("val")), "log"))[0, 0] == -1
    assert got(sparse.scale(m, "log"))[0, 0] == 3
    assert got(sparse.scale(m, "idf"))[0, 1] == 0
    assert got(sparse.scale(m, "idf2"))[0, 0] == round(4 * math.log(22 / 11), 6)
    assert got(sparse.normalise(m, "row", 1)) == {(0, 0): 0.8, (0, 1): 0.2, (1, 1): 1.0}


def test_rationals_and_names(spark):
    df = spark.createDataFrame([(6, -8, "  Dynamic--Viscosity_ x"), (0, 5, "9lives")], "a long, b long, name string")
    rows = df.select(numbers.rational(F.col("a"), F.col("b")).alias("r"), numbers.normal_name(F.trim("name")).alias("n")).collect()
    assert [tuple(r.r) for r in rows] == [(-3, 4), (0, 1)]
    assert [r.n for r in rows] == ["dynamic_viscosity_x", None]
    half, third = (F.struct(F.lit(1).cast("long").alias("num"), F.lit(d).cast("long").alias("den")) for d in (2, 3))
    assert tuple(spark.range(1).select(numbers.rational_add(half, third).alias("s")).first().s) == (5, 6)


def test_case_file(spark):
    text = "# case\nrho = 1000 kg/m^3\nmu: 1 mPa*s # water\nname = 'a # b'\nperiodic_x = Yes\nl = 3 furlong\nrho = 2\n9x = 1"
    rows = cases.parse_cases(cases.case_lines(spark.createDataFrame([(1, text)], "case_id long, text string")))
    got = {(r.line_no, r["name"]): r for r in rows.collect()}
    assert got[2, "density"].value == 1000 and got[2, "density"].dims == [-3, 1, 0, 0]
    assert math.isclose(got[3, "dynamic_viscosity"].value, 1e-3)
    assert got[4, "name"].word == "a # b" and got[5, "periodic_x"].flag is True
    assert got[6, "l"].kind == "error" and got[8, None].kind == "error"
    assert [tuple(r) for r in cases.duplicates(rows).collect()] == [(1, "density", 7)]


def test_similarity_measures(spark):
    rows = {0: {0: 1.0, 1: 2.0}, 1: {1: 3.0, 2: 1.0}, 2: {3: 5.0}, 3: {0: 2.0, 1: 1.0, 2: 4.0}}
    m = spark.createDataFrame([(r, c, v) for r, e in rows.items() for c, v in e.items()], "row long, col long, val double")
    dot = lambda a, b: sum(v * b.get(c, 0) for c, v in a.items())
    low = lambda a, b: sum(min(v, b.get(c, 0)) for c, v in a.items())
    measures = {
        "dot": dot, "cosine": lambda a, b: dot(a, b) / math.sqrt(dot(a, a) * dot(b, b)), "tanimoto": lambda a, b: dot(a, b) / (dot(a, a) + dot(b, b) - dot(a, b)),
        "jaccard": lambda a, b: len(a.keys() & b.keys()) / len(a.keys() | b.keys()), "min": lambda a, b: low(a, b) / (sum(a.values()) + sum(b.values()) - low(a, b)),
        "amin": lambda a, b: low(a, b) / sum(a.values()),
    }
    for name, f in measures.items():
        got = {(r.row, r.other): r.similarity for r in sparse.similar_rows(m, 5, 0.01, name).collect()}
        assert got == pytest.approx({(a, b): f(rows[a], rows[b]) for a in rows for b in rows if a != b and dot(rows[a], rows[b])}), name


def test_sums_before_and_rankings(spark):
    n = 1000
    table = spark.range(n).selectExpr("id", "id * 7919 % 1009 AS x", "if(id % 10 = 0, NULL, id % 5) AS v")
    got = {r.x: r.s for r in sums_before(table, [F.desc("x")], {"s": F.col("v")}).collect()}
    rows, total = sorted(((i * 7919 % 1009, 0 if i % 10 == 0 else i % 5) for i in range(n)), reverse=True), 0
    for x, v in rows:
        assert got[x] == total
        total += v
    assert sums_before(table.limit(0), ["x"], {"s": F.lit(1)}).isEmpty()
    scored = spark.createDataFrame([(i, s, p) for i, (s, p) in enumerate([(9.0, 1), (8.0, 0), (8.0, 1), (7.0, 1), (5.0, 0), (4.0, None), (3.0, 1)])], "id long, s double, p int")
    assert tuple(sparse.ranking(scored, "s", "p", "id").first()) == (7, 4, pytest.approx(500 / 7), pytest.approx(1 / 3))
    assert tuple(sparse.ranking(scored.limit(0), "s", "p", "id").first()) == (0, 0, None, None)


def test_local_views(spark):
    owners = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (5, 0), (9, 2)], "atom_id long, rank long")
    edges = spark.createDataFrame([(0, 1), (0, 5), (2, 1), (1, 5)], "a long, b long")
    got = partition.local_views(owners, partition.ghosts(edges, owners)).collect()
    expected = {(0, False, 1, 0), (0, False, 5, 1), (0, True, 0, 2), (0, True, 2, 3), (1, False, 0, 0), (1, False, 2, 1), (1, True, 1, 2), (1, True, 5, 3), (2, False, 9, 0)}
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)


def test_similar_sets_of_frequent_columns(spark):
    """Rows that only share columns of more than 20 rows, and groups of more than 20 equal rows, against brute force."""
    r = np.random.default_rng(6)
    sets = {i: {int(c) for c in r.choice(14, r.integers(1, 9), replace=False)} for i in range(90)}
    sets |= {100 + i: {1, 2, 3, 50} for i in range(25)}
    entries = spark.createDataFrame([(i, c, 1.0) for i, s in sets.items() for c in s], "row long, col long, val double")
    for least in (0.1, 0.5):
        expected = set()
        for i, s in sets.items():
            scored = sorted((-len(s & t) / len(s | t), j) for j, t in sets.items() if j != i and len(s & t) >= least * len(s | t))
            expected |= {(i, j, -v, k) for k, (v, j) in enumerate(scored[:3], 1)}
        assert {tuple(x) for x in sparse.similar_sets(entries, 3, least).collect()} == expected
    pruned = sparse.similar_rows(sparse.prune(entries, "col", 2, 20), 3, 0.1, "jaccard")
    assert pruned.filter("row >= 100").isEmpty()
    weights = {i: {c: float(r.integers(1, 5)) if i < 100 else 2.0 for c in s} for i, s in sets.items()}
    entries = spark.createDataFrame([(i, c, v) for i, s in weights.items() for c, v in s.items()], "row long, col long, val double")
    for measure, least in (("min", 0.2), ("min", 0.7), ("amin", 0.3), ("amin", 0.9)):
        expected = set()
        for i, s in weights.items():
            common = {j: sum(min(v, t.get(c, 0.0)) for c, v in s.items()) for j, t in weights.items() if j != i}
            size = lambda j: sum(weights[j].values())
            value = {j: v / (size(i) if measure == "amin" else size(i) + size(j) - v) for j, v in common.items()}
            scored = sorted((-v, j) for j, v in value.items() if v >= least)
            expected |= {(i, j, round(-v, 9), k) for k, (v, j) in enumerate(scored[:3], 1)}
        got = {(x.row, x.other, round(x.similarity, 9), x.rank) for x in sparse.similar_sets(entries, 3, least, measure).collect()}
        assert got == expected


def test_item_sets(spark):
    from itertools import combinations

    r = np.random.default_rng(7)
    baskets = {i: set(map(int, r.choice(8, r.integers(0, 6), replace=False))) for i in range(80)}
    entries = spark.createDataFrame([(i, c) for i, b in baskets.items() for c in list(b) * 2], "row long, col long")
    for least, most, shortest, longest in ((5, None, 1, None), (3, 9, 2, 3), (1000, None, 1, None)):
        count = {c: sum(set(c) <= b for b in baskets.values()) for n in range(1, 9) for c in combinations(range(8), n)}
        want = {(c, n) for c, n in count.items() if least <= n <= (most or n) and shortest <= len(c) <= (longest or 9)}
        assert {(tuple(x["items"]), x.freq) for x in sparse.item_sets(entries, least, most, shortest, longest).collect()} == want
    assert sparse.item_sets(entries.limit(0), 1).isEmpty()


def test_weld_of_equal_and_missing_points(spark):
    from tessera.operators.mesh import weld

    rows = [(i, 1.0, 2.0, 3.0) for i in range(50, 10, -1)] + [(5, 1.5, 2.0, 3.0), (60, 2.0, 2.0, 3.0), (70, 9.0, 9.0, 9.0), (71, None, 2.0, 3.0), (72, None, 2.0, 3.0)]
    found = {r.id: r.representative for r in weld(spark.createDataFrame(rows, "id long, x double, y double, z double"), 0.6).collect()}
    assert found == {i: 5 for i, *_ in rows[:42]} | {70: 70, 71: 71, 72: 72}


def _brute_side(shape, p):
    """-1, 0 or 1 for a point and an expression: (low, high) of a box, or ("or" | "and", a, b), or ("not", box)."""
    if shape[0] in ("or", "and"):
        return (min if shape[0] == "or" else max)(_brute_side(shape[1], p), _brute_side(shape[2], p))
    if shape[0] == "not":
        return -_brute_side(shape[1], p)
    worst = max(max(lo - x, x - hi) for x, lo, hi in zip(p, *shape, strict=True))
    return (worst > 0) - (worst < 0)


def _brute_type(shape, p):
    if shape[0] in ("or", "and"):
        return (max if shape[0] == "or" else min)(_brute_type(shape[1], p), _brute_type(shape[2], p))
    low, high = shape[1] if shape[0] == "not" else shape
    meets = all(x + 1 >= lo and x - 1 <= hi for x, lo, hi in zip(p, low, high, strict=True)) and not all(x - 1 > lo and x + 1 < hi for x, lo, hi in zip(p, low, high, strict=True))
    return 0 if _brute_side(shape, p) >= 0 else 1 if meets else 2


def _brute_end(shape, p, step, planes):
    """Where a link from a boundary cell first leaves: the shape as a whole, if it is a union with the cell at the boundary of both parts, else either part."""
    if _brute_type(shape, p) != 1:
        return None
    merged = shape[0] in ("or", "and")
    if merged and not (shape[0] == "or" and all(_brute_type(s, p) == 1 for s in shape[1:])):
        return min((t for s in shape[1:] if (t := _brute_end(s, p, step, planes)) is not None), default=None)
    stops = sorted({t for axis, plane in planes if step[axis] and 0 < (t := (plane - p[axis]) / step[axis]) <= 1}) + [1.0]
    for t, after in zip(stops, stops[1:]):
        if _brute_side(shape, [x + (t + after) / 2 * d for x, d in zip(p, step, strict=True)]) > 0:
            return t
    return None


def test_links_of_merged_shapes_against_walks(spark):
    """Types, faces and links of unions and differences of boxes, nested ones too, against walks from stop to stop along each link."""
    a, b, c = ((0.0, 0.0, 0.0), (6.0, 6.0, 6.0)), ((3.3, 2.25, 1.4), (9.1, 8.35, 5.2)), ((5.1, 3.15, 2.4), (7.9, 4.65, 9.6))
    planes = [(axis, end) for low, high in (a, b, c) for axis in range(3) for end in (low[axis], high[axis])]
    x, y, z = (shapes.Box(*s) for s in (a, b, c))
    cells = shapes.grid(spark, (-1.0, -1.0, -1.0), (11, 11, 12), 1.0)
    steps = {r.link: (r.ex, r.ey, r.ez) for r in shapes.lattice(spark, "D3Q19").filter("link > 0").collect()}
    p = vector("x", "y", "z")
    hidden = 0
    for shape, expression in (((x | y) | z, ("or", ("or", a, b), c)), (x - (y | z), ("and", a, ("and", ("not", b), ("not", c))))):
        hits = {(r.cell_id, r.link): r for r in shapes.wall_links(cells, shape, "D3Q19", 1.0, "cell_id").collect()}
        for r in cells.select("cell_id", *"xyz", shape.cell_type(p, 1.0).alias("t"), shape.faces(p, 1.0).alias("f")).collect():
            place = (r.x, r.y, r.z)
            assert r.t == _brute_type(expression, place) and (r.t == 1) == bool(r.f)
            for link, step in steps.items():
                end, hit = _brute_end(expression, place, step, planes), hits.pop((r.cell_id, link), None)
                assert (hit and round(hit.q, 9)) == (end and round(end, 9)), (place, step)
                if hit:
                    axis, plane = planes[hit.face]
                    assert math.isclose(place[axis] + hit.q * step[axis], plane, abs_tol=1e-9)
                first = shape.unite and r.t == 1 and any(t for box in (a, b, c) if (t := _brute_end(box, place, step, planes)) and t < (end or 2))
                hidden += bool(first)
        assert not hits
    assert hidden > 20  # links that pass a face inside another part


def test_merged_cells_take_the_better_or_the_worse_part(spark):
    """A cell deep in one box and at a face of the other is interior to the union and boundary of the intersection; a face hidden there is hit by no link."""
    a, b = shapes.Box((0, 0, 0), (10, 10, 10)), shapes.Box((4.5, 4, 4), (9, 9, 9))
    p = vector("x", "y", "z")
    cell = spark.createDataFrame([(1, 5.0, 6.0, 6.0)], "cell_id long, x double, y double, z double")
    types = cell.select(a.cell_type(p, 1.0), b.cell_type(p, 1.0), (a | b).cell_type(p, 1.0), (a & b).cell_type(p, 1.0), (~(a & b)).cell_type(p, 1.0)).first()
    assert tuple(types) == (2, 1, 2, 1, 0)
    assert cell.select((a & b).faces(p, 1.0)).first()[0] == [6]
    assert shapes.wall_links(cell, a | b, "D3Q19", 1.0, "cell_id").isEmpty()
    assert {r.face for r in shapes.wall_links(cell, a & b, "D3Q19", 1.0, "cell_id").collect()} == {6}
    assert shapes.wall_links(cell.limit(0), a | b, "D3Q19", 1.0, "cell_id").isEmpty()
    assert (~~(a - b)).n_faces == 12 and isinstance(~~a, shapes.Box)


def test_rectangle_faces_run_from_the_bottom(spark):
    box = shapes.Box((0.0, 0.0), (10.0, 4.0))
    p = vector("x", "y")
    cells = spark.createDataFrame([(5.0, 0.5), (9.5, 2.0), (5.0, 3.5), (0.5, 2.0), (9.5, 3.5)], "x double, y double")
    assert [r[0] for r in cells.select(box.faces(p, 1.0)).collect()] == [[0], [1], [2], [3], [1, 2]]


def test_both_roots_of_a_ball(spark):
    from tessera.functions.vectors import link_roots

    rows = spark.createDataFrame([(1.0, -1.0, 0.1875), (1.0, 0.0, -0.25), (0.0, 0.0, 1.0), (1.0, 0.0, 1.0), (0.0, 2.0, -1.0)], "a double, b double, c double")
    got = [sorted(v for v in r if v is not None) for r in rows.select(*link_roots(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == [[0.25, 0.75], [0.5], [], [], [0.5]]


def test_cuts_and_bisection_by_ranges(spark):
    """A group with most of the atoms, groups of one, none and equal coordinates, against plain loops."""
    r = np.random.default_rng(4)
    rows = [(i, [None, 1, 1, 1, 1, 2, 3 + i][r.integers(0, 7)], int(lo), int(lo + r.integers(1, 4)), float(r.integers(1, 5))) for i, lo in enumerate(r.integers(0, 400, 600))]
    atoms = spark.createDataFrame(rows + [(9999, 1, None, 3, 1.0)], "atom_id long, g long, lo long, hi long, work double")
    expected = set()
    for g in {row[1] for row in rows}:
        mine = [row for row in rows if row[1] == g]
        for plane in {row[2] for row in mine}:
            below = [row for row in mine if row[2] < plane]
            if below and max(row[3] for row in below) <= plane:
                expected.add((g, plane, sum(row[4] for row in below)))
    found = [tuple(x) for x in partition.legal_cuts(atoms, "g").collect()]
    assert set(found) == expected and len(found) == len(expected)
    ranks = {row[0]: 0 for row in rows}
    for _ in range(3):
        halves = {}
        for rank in set(ranks.values()):
            mine = sorted((row for row in rows if ranks[row[0]] == rank), key=lambda row: row[2])
            for row in mine:
                upto, at = sum(o[4] for o in mine if o[2] <= row[2]), sum(o[4] for o in mine if o[2] == row[2])
                halves[row[0]] = 2 * rank + (upto - at / 2 > sum(o[4] for o in mine) / 2)
        ranks = halves
    assert dict(map(tuple, partition.bisected(atoms, 3).collect())) == ranks
    assert partition.legal_cuts(atoms.limit(0), "g").isEmpty() and partition.bisected(atoms.limit(0), 2).isEmpty()


def test_points_in_surfaces_of_different_sizes(spark):
    from tessera.plans.geometry_queries import box_facets

    sizes = [(i, float(s)) for i, s in enumerate((0.3, 1.0, 7.0, 300.0, 0.0))]
    boxes = spark.createDataFrame(sizes, "solid long, s double")
    facets = box_facets(boxes, "solid", (-F.col("s"),) * 3, (F.col("s"),) * 3)
    points = [(i, v, v, 0.1) for i, v in enumerate((0.0, 0.5, 6.5, 250.0, 400.0))] + [(9, None, 0.0, 0.0)]
    table = spark.createDataFrame(points, "id long, x double, y double, z double")
    got = {tuple(x) for x in mesh.enclosed(table, facets, "solid").collect()}
    assert got == {(i, k) for i, x, _, _ in points[:-1] for k, s in sizes if s > abs(x) and s > 0.1}
    assert mesh.enclosed(table, facets.limit(0), "solid").isEmpty() and mesh.enclosed(table.limit(0), facets, "solid").isEmpty()
    plan = mesh.enclosed(table, facets, "solid")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("shuffled", [True, False])
def test_components_take_few_passes(spark, monkeypatch, shuffled):
    from tessera.plans import components
    from tessera.plans.tables import saved

    tables = []
    monkeypatch.setattr(components, "saved", lambda df: tables.append(1) or saved(df))
    ids = np.random.default_rng(1).permutation(10_000) if shuffled else np.arange(10_000)
    rows = [(int(x), int(y)) for x, y in zip(ids[:-1], ids[1:])] + [(20_000, 20_000), (None, 1), (2, None), (30_002, 30_001), (30_001, 30_002), (30_001, 30_001)]
    found = {r.node: r.component for r in components.connected_components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(10_000)} | {20_000: 20_000, 30_001: 30_001, 30_002: 30_001}
    assert (len(tables) - 2) / 2 <= 15  # two tables for each pass


def test_components_of_random_graphs(spark):
    from tessera.plans.components import connected_components

    r = np.random.default_rng(2)
    for n, m in ((60, 50), (60, 25), (5, 0)):
        rows = [(int(x), int(y)) for x, y in r.integers(0, n, (m, 2))]
        top = {x: x for row in rows for x in row}
        for _ in top:
            for x, y in rows:
                top[x] = top[y] = min(top[x], top[y])
        found = connected_components(spark.createDataFrame(rows, "a long, b long"))
        assert {x.node: x.component for x in found.collect()} == top


def test_parts_become_contiguous(spark):
    """Random labels on a lattice, a far island, and a given labelling in pieces: no part is in two pieces but for what has no way to its core."""
    r = np.random.default_rng(12)
    n = 12
    at = lambda i, j: n * i + j
    edges = [(at(i, j), at(i + di, j + dj), float(r.integers(1, 9))) for i in range(n) for j in range(n) for di, dj in ((0, 1), (1, 0)) if i + di < n and j + dj < n]
    labels = {at(i, j): int(r.integers(0, 5)) for i in range(n) for j in range(n)} | {1000: 0, 1001: 1, 1002: 1}
    edges += [(1000, 1001, 1.0), (1001, 1002, 1.0)]

    def pieces(part):
        top = {x: x for x in part}
        for _ in top:
            for a, b, _ in edges:
                if part[a] == part[b]:
                    top[a] = top[b] = min(top[a], top[b])
        return top

    frame = spark.createDataFrame([(a, b, w) for a, b, w in edges], "a long, b long, w double")
    table = spark.createDataFrame(list(labels.items()), "node long, part int")
    found = {x.node: (x.part, x.component) for x in partition.part_components(frame, table).collect()}
    assert found == {x: (labels[x], top) for x, top in pieces(labels).items()}
    joined = dict(map(tuple, partition.contiguous(frame, table).collect()))
    assert set(joined) == set(labels) and set(joined.values()) == set(range(5))
    tops = {}
    for x, top in pieces(joined).items():
        tops.setdefault(joined[x], set()).add(top)
    assert all(len({t for t in found if t < 1000}) == 1 for found in tops.values())
    assert {x: joined[x] for x in (1000, 1001, 1002)} == {1000: 0, 1001: 1, 1002: 1}
    line = spark.createDataFrame([(i, i + 1, 1.0 + (i == 3)) for i in range(7)], "a long, b long, w double")
    given = spark.createDataFrame([(i, p, 1.0 + (i == 7)) for i, p in enumerate((0, 0, 0, 1, 0, 1, 1, 2))], "node long, part int, work double")
    assert sorted(map(tuple, partition.contiguous(line, given).collect())) == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 1), (5, 1), (6, 1), (7, 2)]
    assert partition.contiguous(frame.limit(0), table.limit(0)).isEmpty()


def test_similar_texts_down_to_a_tenth(spark, tmp_path):
    """Texts with a tenth of their words in common are similar, however often they say them; fewer are not."""
    from tessera import catalog

    texts = {0: "a b c d e f", 1: "f g h i j", 2: "f f f f k l m n", 3: "K l M n; f!", 4: "o p q r s t u v w x y a", 5: None, 6: "", 7: "f"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in catalog.QUERIES["similar_texts"](spark, str(tmp_path)).select("row", "other", "similarity", "rank").collect()]
    assert sorted(got) == [
        (0, 1, 0.1, 2), (0, 2, 0.1, 3), (0, 7, 0.166666667, 1), (1, 2, 0.111111111, 2), (1, 3, 0.111111111, 3), (1, 7, 0.2, 1),
        (2, 1, 0.111111111, 3), (2, 3, 1.0, 1), (2, 7, 0.2, 2), (3, 1, 0.111111111, 3), (3, 2, 1.0, 1), (3, 7, 0.2, 2), (7, 1, 0.2, 1), (7, 2, 0.2, 2), (7, 3, 0.2, 3),
    ]


def test_nearest_sets_of_all_pairs(spark, monkeypatch):
    """Sets in several blocks, many of them equal and some with columns of their own, against brute force; a pair of blocks in small chunks."""
    import pyarrow as pa

    r = np.random.default_rng(9)
    sets = {i: {int(c) for c in r.choice(300, r.integers(1, 40), replace=False) ** 2 // 300} for i in range(600)}
    sets |= {1000 + i: {1, 2, 3, 50} for i in range(150)} | {2000 + i: {1, 2, 3, 5000 + i // 2 * 2} for i in range(9)} | {3000: {7000}, 3001: {7001, 7002}}
    expected = {}
    for least in (0.1, 0.3):
        for i, s in sets.items():
            scored = sorted((-len(s & t) / len(s | t), j) for j, t in sets.items() if j != i and len(s & t) / len(s | t) >= least)
            expected.setdefault(least, set()).update((i, j, -v, k) for k, (v, j) in enumerate(scored[:3], 1))
    entries = spark.createDataFrame([(i, f"c{c}", 1.0) for i, s in sets.items() for c in s] + [(None, "c1", 1.0)], "row long, col string, val double")
    for least, rows in expected.items():
        got = [tuple(x) for x in sparse.nearest_sets(entries, 3, least).collect()]
        assert set(got) == rows and len(got) == len(rows)
    assert sparse.nearest_sets(entries.limit(0), 3, 0.1).isEmpty()

    for name, value in (("ROWS", 8), ("OTHERS", 16), ("COMMON", 5)):
        monkeypatch.setattr(sparse, name, value)
    some = {i: s for i, s in sets.items() if i < 150}
    for blocks in (1, 2):
        table = pa.table({"x": [0] * 150, "y": [blocks - 1] * 150, "block": [i % blocks for i in some], "head": list(some), "n": [len(s) for s in some.values()], "cols": pa.array([sorted(s) for s in some.values()], pa.list_(pa.int32()))})
        rows = set()
        for i, s in some.items():
            scored = sorted((-len(s & t) / len(s | t), j) for j, t in some.items() if j != i and (blocks == 1 or (i - j) % 2) and len(s & t) / len(s | t) >= 0.1)
            rows |= {(i, j, -v) for v, j in scored[:3]}
        got = [tuple(x.values()) for x in sparse._met(table, 3, 0.1).to_pylist()]
        assert set(got) == rows and len(got) == len(rows)
