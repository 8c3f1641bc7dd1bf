"""Closed surfaces, planar faces and octrees against brute force and figures that follow by hand."""

import math
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import features, mesh, nearest, solids, tree

TETRAHEDRON = [((0, 0, 0), (0, 1, 0), (1, 0, 0)), ((0, 0, 0), (1, 0, 0), (0, 0, 1)), ((0, 0, 0), (0, 0, 1), (0, 1, 0)), ((1, 0, 0), (0, 1, 0), (0, 0, 1))]
CUBE = [(0, 2, 1), (1, 2, 3), (4, 5, 6), (5, 7, 6), (0, 1, 4), (1, 5, 4), (2, 6, 3), (3, 6, 7), (0, 4, 2), (2, 4, 6), (1, 3, 5), (3, 7, 5)]
SCHEMA = "facet_id long, solid int, " + ", ".join(f"{v}{a} double" for v in "abc" for a in "xyz")


def facets(spark, triangles, scale=1.0, shift=(0.0, 0.0, 0.0), solid=0):
    rows = [(i, solid, *(scale * float(c) + s for corner in t for c, s in zip(corner, shift, strict=True))) for i, t in enumerate(triangles)]
    return spark.createDataFrame(rows, SCHEMA)


def cube(spark, low, size, solid):
    corners = [tuple(i >> a & 1 for a in range(3)) for i in range(8)]
    return facets(spark, [[corners[i] for i in f] for f in CUBE], size, (low,) * 3, solid)


def test_cells_of_a_tetrahedron(spark):
    t = facets(spark, TETRAHEDRON, 9.3, (0.1, -0.2, 0.05))
    got = {(r.i, r.j, r.k): r.cell_type for r in solids.cell_types(t, 1.0, "solid").collect()}
    expected = {}
    for cell in product(range(-2, 12), repeat=3):
        p = (np.array(cell) + 0.5 - (0.1, -0.2, 0.05)) / 9.3
        if (p > 0).all() and p.sum() < 1:
            # A wall is near if the cube of half-width 1 reaches its plane within the tetrahedron.
            reach = 1 / 9.3
            expected[cell] = 1 if (p - reach <= 0).any() or p.sum() + 3 * reach >= 1 else 2
    assert set(got) == set(expected)
    assert all(got[c] == expected[c] for c in got)


def test_wall_on_centres_is_dry(spark):
    got = solids.wet_cells(cube(spark, 0.5, 3.0, 0), 1.0, "solid").collect()
    assert {(r.i, r.j, r.k) for r in got} == set(product((1, 2), repeat=3))
    assert solids.wet_cells(cube(spark, 0.5, 3.0, 0).limit(0), 1.0, "solid").isEmpty()


def test_link_hits_of_a_cube(spark):
    box = cube(spark, 0.25, 3.0, 0)
    cells = solids.wet_cells(box, 1.0, "solid")
    hits = solids.link_hits(cells, box, "D3Q19", 1.0, "solid").collect()
    links = [e for e in product((-1, 0, 1), repeat=3) if 0 < sum(map(abs, e)) < 3]
    expected = []
    for cell in product(range(3), repeat=3):
        for e in links:
            q = min((3.25 - c - 0.5 if s > 0 else c + 0.25) for c, s in zip(cell, e, strict=True) if s)
            if q <= 1:
                expected.append((*cell, q))
    assert sorted((r.i, r.j, r.k, r.q) for r in hits) == sorted(expected)


def test_flow_sides(spark):
    places = {1: (0.0, 20.0), 2: (1.0, 8.0), 3: (12.0, 4.0), 4: (2.0, 3.0)}
    all_facets = None
    for solid, (low, size) in places.items():
        one = cube(spark, low, size, solid)
        all_facets = one if all_facets is None else all_facets.unionByName(one)
    all_facets = solids.turned(all_facets, F.col("solid") == 2)
    contains = solids.containment(all_facets, "solid")
    assert {tuple(r) for r in contains.collect()} == {(1, 2), (1, 3), (1, 4), (2, 4)}
    volumes = mesh.signed_volumes(all_facets, "solid").withColumn("mesh", F.lit(0))
    assert {r.solid: round(r.volume) for r in volumes.collect()} == {1: 8000, 2: -512, 3: 64, 4: 27}
    inner = {r.solid: (r.parent, r.fluid_side, r.flip, r.problem) for r in solids.flow_sides(volumes, contains, "solid", "mesh", True).collect()}
    assert inner == {1: (None, "inside", False, None), 2: (1, "outside", False, None), 3: (1, "outside", True, None), 4: (2, "outside", True, "nested too deep")}
    outer = {r.solid: (r.active, r.flip) for r in solids.flow_sides(volumes, contains, "solid", "mesh", False).collect()}
    assert outer == {1: (True, True), 2: (False, False), 3: (False, False), 4: (False, False)}
    roots = solids.flow_sides(volumes, contains.limit(0), "solid", "mesh", True)
    assert {r.problem for r in roots.collect()} == {"several roots"}


@pytest.mark.parametrize("cut", [0, 2])
def test_faces_of_a_cube(spark, cut):
    """Six faces of two facets meet in twelve edges; eight corners are junctions, so each edge is a curve. Without one face its four edges are open."""
    numbers = spark.createDataFrame([(i, *f) for i, f in enumerate(CUBE)], "facet_id long, v0 long, v1 long, v2 long")
    box = cube(spark, -1.0, 2.0, 0).join(numbers, "facet_id").filter(F.col("facet_id") >= cut)
    faces = features.face_measures(box).collect()
    assert sorted((r.face_id, r.facets, r.area) for r in faces) == [(i, 2, 4.0) for i in range(cut, 12, 2)]
    edges = features.feature_edges(box)
    kinds = {r.kind: r["count"] for r in edges.groupBy("kind").count().collect()}
    assert kinds == ({"feature": 12, "flat": 6} if not cut else {"feature": 8, "flat": 5, "open": 4})
    roles = {r.role: r["count"] for r in features.curve_ends(edges).groupBy("role").count().collect()}
    assert roles == ({"junction": 8} if not cut else {"junction": 4, "end": 4})
    assert features.feature_curves(edges).select("curve").distinct().count() == kinds["feature"]


def test_curves_join_at_passing_vertices(spark):
    ring = [(1, 2), (2, 3), (3, 4), (1, 4)] + [(10, 11), (11, 12), (11, 13)]
    edges = spark.createDataFrame([(a, b, "feature") for a, b in ring] + [(1, 3, "flat")], "lo long, hi long, kind string")
    sizes = features.feature_curves(edges).groupBy("curve").count().collect()
    assert sorted(r["count"] for r in sizes) == [1, 1, 1, 4]


def test_order_of_curves(spark):
    """A closed and an open curve of 10**4 edges with shuffled vertices, curves between junctions, and two that return to theirs."""
    n = 10_000
    ids = np.random.default_rng(3).permutation(2 * n + 1) + 100
    ring, line = ids[:n].tolist(), ids[n:].tolist()
    closed = [(a, b) for a, b in zip(ring, ring[1:] + ring[:1])]
    opened = [(a, b) for a, b in zip(line, line[1:])]
    others = [(1, 2), (2, 3), (3, 4), (4, 5), (3, 6), (10, 11), (11, 12), (12, 13), (13, 11), (11, 14), (14, 15), (15, 11)]
    rows = [(min(e), max(e), "feature") for e in closed + opened + others] + [(1, 5, "flat")]
    got = {}
    for x in features.traced_curves(spark.createDataFrame(rows, "lo long, hi long, kind string")).collect():
        got.setdefault((x.curve_lo, x.curve_hi, x.closed, x.edges), []).append((x.position, (x.lo, x.hi)))
    found = {k: [e for _, e in sorted(v)] for k, v in got.items()}
    assert all(sorted(p for p, _ in v) == list(range(len(v))) and len(v) == k[3] for k, v in got.items())
    at = ring.index(min(ring))
    turned = ring[at:] + ring[:at]
    if turned[1] > turned[-1]:
        turned = turned[:1] + turned[:0:-1]
    straight = line if line[0] < line[-1] else line[::-1]
    pairs = lambda p: [(min(e), max(e)) for e in zip(p, p[1:])]
    want = [(turned + turned[:1], True), (straight, False), ([1, 2, 3], False), ([3, 4, 5], False), ([3, 6], False), ([10, 11], False), ([11, 12, 13, 11], False), ([11, 14, 15, 11], False)]
    assert found == {(*min(pairs(p)), c, len(p) - 1): pairs(p) for p, c in want}
    assert features.traced_curves(spark.createDataFrame(rows[:0], "lo long, hi long, kind string")).isEmpty()


def test_octree_balance(spark):
    points = spark.createDataFrame([(15, 15, 15)] * 5, "i long, j long, k long")
    leaves = tree.balance(tree.refine(points, 5, 2, "ijk").select("level", *"ijk"), 5, "ijk")
    rows = [tuple(r) for r in leaves.collect()]
    assert math.isclose(sum(8.0 ** -r[0] for r in rows), 1)
    boxes = [(np.array(r[1:]) / 2 ** r[0], 2.0 ** -r[0], r[0]) for r in rows]
    for p, w, l in boxes:
        for q, s, m in boxes:
            if (p <= q + s).all() and (q <= p + w).all():
                assert abs(l - m) <= 1


def ball(n):
    """Facets of a sphere: the six sides of a cube, each of n by n squares, blown up; normals outward."""
    out = []
    for axis, side in product(range(3), (-1, 1)):
        def at(u, v):
            p = np.roll([side, 2 * u / n - 1, 2 * v / n - 1], axis)  # noqa: B023
            return tuple((p / np.linalg.norm(p)).tolist())

        places = [[at(u, v) for v in range(n + 1)] for u in range(n + 1)]
        for u, v in product(range(n), repeat=2):
            a, b, c, d = places[u][v], places[u + 1][v], places[u + 1][v + 1], places[u][v + 1]
            out += [(a, b, c), (a, c, d)] if side > 0 else [(a, c, b), (a, d, c)]
    return out


def test_points_in_a_large_mesh(spark):
    """A sphere of 10**5 facets: each point meets fewer than a hundred of them, and is inside as its distance says."""
    r = np.random.default_rng(1)
    shell = facets(spark, ball(92), 3.0, (0.5, 0.25, -1.0)).cache()
    assert shell.count() > 100_000
    p = np.r_[r.normal(size=(600, 3)), [[0.0, 0.0, 0.0]]]
    p[:600] *= (r.uniform(0, 1.3, 600) / np.linalg.norm(p[:600], axis=1))[:, None]
    distance = np.linalg.norm(p, axis=1)
    rows = [(i, *(3.0 * x + s for x, s in zip(q, (0.5, 0.25, -1.0), strict=True))) for i, q in enumerate(p.tolist()) if not 0.998 < distance[i] < 1.001]
    points = spark.createDataFrame(rows, "id long, x double, y double, z double")
    assert {x.id for x in mesh.enclosed(points, shell, "solid").collect()} == {row[0] for row in rows if distance[row[0]] < 1}
    met = mesh.facets_near(points, shell, "solid", "id").groupBy("id").count()
    assert met.agg(F.max("count")).first()[0] < 100


def plain_distance(p, t):
    a, b, c = (np.array(x, float) for x in t)
    best = min(np.linalg.norm(p - (s + np.clip(np.dot(p - s, e - s) / max(np.dot(e - s, e - s), 1e-300), 0, 1) * (e - s))) for s, e in ((a, b), (b, c), (c, a)))
    n = np.cross(b - a, c - a)
    if n.any():
        foot = p - np.dot(p - a, n) / np.dot(n, n) * n
        if all(np.dot(n, np.cross(e - s, foot - s)) >= 0 for s, e in ((a, b), (b, c), (c, a))):
            best = min(best, np.linalg.norm(p - foot))
    return best


def test_nearest_facets(spark):
    r = np.random.default_rng(4)
    shapes = {1: [[tuple(3 * x for x in q) for q in t] for t in ball(9)], 2: [((0, 0, 0), (1, 0, 0), (0, 1, 0))] * 2, 3: [((5, 5, 5), (5, 5, 5), (6, 5, 5))]}
    table = None
    for solid, triangles in shapes.items():
        one = facets(spark, triangles, solid=solid)
        table = one if table is None else table.unionByName(one)
    places = [(i, [1, 1, 2, 3, 4][i % 5], *(r.normal(size=3) * [1, 3, 30][i % 3]).tolist()) for i in range(200)] + [(900, 1, None, 0.0, 0.0), (901, 2, 0.25, 0.25, 0.0)]
    points = spark.createDataFrame(places, "id long, solid int, x double, y double, z double")
    got = {x.id: x for x in nearest.nearest_facets(points, table, "solid").collect()}
    assert set(got) == {p[0] for p in places if p[1] in shapes and p[2] is not None}
    for i, solid, *p in places:
        if i in got:
            want = [plain_distance(np.array(p), t) for t in shapes[solid]]
            assert abs(got[i].distance - min(want)) < 1e-9 and want[got[i].facet_id] < min(want) + 1e-9
    assert got[901].facet_id == 0 and got[901].distance == 0
    assert nearest.nearest_facets(points, table.limit(0), "solid").isEmpty() and nearest.nearest_facets(points.limit(0), table, "solid").isEmpty()


def test_far_and_near_points_of_a_fine_sphere(spark):
    """A sphere of 7,500 facets: distances are those to a sphere but for what facets cut off."""
    shell = facets(spark, ball(25))
    points = spark.createDataFrame([(i, 0, *map(float, p)) for i, p in enumerate(((50, 3, 1), (2, 2, 2), (0, 0, -1.2), (0.9, 0.1, 0.1)))], "id long, solid int, x double, y double, z double")
    got = {x.id: x.distance for x in nearest.nearest_facets(points, shell, "solid").collect()}
    for i, p in enumerate(((50, 3, 1), (2, 2, 2), (0, 0, -1.2), (0.9, 0.1, 0.1))):
        assert abs(got[i] - abs(np.linalg.norm(p) - 1)) < 8e-3


def test_bands_around_a_mesh(spark):
    shell = facets(spark, SMALL_BALL, 2.5, (4.0, 4.0, 4.0))
    roots = spark.createDataFrame([(0, *c) for c in product(range(4), repeat=3)], "solid int, i int, j int, k int")
    for thickness in (None, 0.2):
        leaves = nearest.refine_by_meshes(roots, shell, "solid", 1, thickness, width=2.0).collect()
        assert math.isclose(sum(8.0 ** -x.level for x in leaves), 64)
        for x in leaves:
            side = 2.0 / 2**x.level
            centre = (np.array((x.i, x.j, x.k)) + 0.5) * side
            d = min(plain_distance(centre, [tuple(2.5 * v + 4 for v in q) for q in t]) for t in SMALL_BALL)
            reach = 0.5 * side * 3**0.5
            inside = np.linalg.norm(centre - 4) < 2.0  # what is neither near nor within is farther out
            assert x.relation == (0 if d <= reach else 1 if inside else -1)
            assert x.level == 1 or not (x.relation >= 0 and (thickness is None or d <= thickness + reach))
    with pytest.raises(ValueError):
        nearest.refine_by_meshes(roots, shell, "solid", 1, -1.0)


SMALL_BALL = ball(2)


def test_wet_points_of_nested_surfaces(spark):
    """A room with a pillar: wet within the room and outside the pillar; outside both for external flow."""
    both = cube(spark, 0.0, 10.0, 1).unionByName(cube(spark, 4.0, 2.0, 2))
    points = spark.createDataFrame([(i, float(v), 5.0, 5.5) for i, v in enumerate((-1, 0, 1, 4, 5, 6, 9, 10, 11))] + [(99, None, 0.0, 0.0)], "id long, x double, y double, z double")
    sides = lambda rows: spark.createDataFrame(rows, "solid int, active boolean, fluid_side string")
    wet = lambda rows: {x.id for x in solids.wet_points(points, both, sides(rows), "solid").collect()}
    assert wet([(1, True, "inside"), (2, True, "outside")]) == {2, 6}
    assert wet([(1, True, "outside"), (2, False, None)]) == {0, 8}
    assert wet([(1, True, "inside"), (2, False, None)]) == {2, 3, 4, 5, 6}
    assert wet([(1, False, None)]) == set()
    assert {(x.id, x.solid) for x in mesh.on_surface(points, both, "solid").collect()} == {(1, 1), (3, 2), (5, 2), (7, 1)}
