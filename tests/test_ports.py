"""Planar faces from seeds, hulls and widths."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import features, ports

COLUMNS = "facet_id long, v0 long, v1 long, v2 long, " + ", ".join(f"{v}{x} double" for v in "abc" for x in "xyz")


def strip(heights, order=None):
    """A strip of squares of two triangles along x at the given heights; facets are numbered by ``order``."""
    corner = [(float(i // 2), float(i % 2), heights[i // 2]) for i in range(2 * len(heights))]
    triangles = [t for i in range(len(heights) - 1) for t in ((2 * i, 2 * i + 2, 2 * i + 1), (2 * i + 2, 2 * i + 3, 2 * i + 1))]
    order = order or range(len(triangles))
    return [(n, *t, *(c for v in t for c in corner[v])) for n, t in zip(order, triangles, strict=True)]


def sequential(rows):
    """Seeds one after the other, each with its own plane."""
    corners = {r[0]: np.array(r[4:]).reshape(3, 3) for r in rows}
    edges = {}
    for r in rows:
        for a, b in ((1, 2), (2, 3), (3, 1)):
            edges.setdefault(frozenset((r[a], r[b])), []).append(r[0])
    near = {r[0]: set() for r in rows}
    for owners in edges.values():
        if len(owners) == 2:
            near[owners[0]].add(owners[1])
            near[owners[1]].add(owners[0])

    def lies(plane, other):
        a, b, c = corners[plane]
        n, longest = np.cross(b - a, c - a), max(map(np.linalg.norm, (b - a, c - a, c - b)))
        return np.linalg.norm(n) > 0 and all(abs(n @ (p - a)) <= np.linalg.norm(n) * features.ROUNDING * longest * np.linalg.norm(p - a) for p in corners[other])

    def flat(a, b):
        return lies(a, b) and lies(b, a)

    face = {}
    for seed in sorted(corners):
        if seed in face or not any(n not in face and flat(seed, n) for n in near[seed]):
            continue
        face[seed], todo = seed, [seed]
        while todo:
            for n in near[todo.pop()]:
                if n not in face and flat(seed, n):
                    face[n] = seed
                    todo.append(n)
    return face


def bent(n, step):
    """Heights whose slope grows by a step a square."""
    return np.cumsum(np.arange(n) * step).tolist()


@pytest.mark.parametrize("step", [0.0, 2e-16, 3e-15, 1e-14, 1e-3])
def test_seeded_faces_equal_the_sequential_rule(spark, step):
    rows = strip(bent(10, step), list(np.random.default_rng(5).permutation(18).tolist()))
    found = dict(map(tuple, features.seeded_faces(spark.createDataFrame(rows, COLUMNS)).collect()))
    assert found == sequential(rows)


def test_a_chain_within_rounding_is_cut(spark):
    """Neighbours lie in one plane, but the ends of the chain do not."""
    rows = strip(bent(10, 1e-14))
    faces = features.seeded_faces(spark.createDataFrame(rows, COLUMNS))
    assert 1 < faces.select("face_id").distinct().count() < 9


def test_single_and_degenerate_facets_have_no_face(spark):
    table = spark.createDataFrame(strip([0.0, 0.0, 1.0, 0.5])[1:4] + [(9, 0, 1, 1, *([0.0] * 9))], COLUMNS)
    assert dict(map(tuple, features.seeded_faces(table).collect())) == {2: 2, 3: 2}
    assert features.seeded_faces(table.limit(0)).collect() == []


def test_report_and_edges(spark):
    table = spark.createDataFrame(strip([0.0, 0.0, 1.0, 1.0]), COLUMNS)
    faces = features.seeded_faces(table)
    report = features.face_report(table, faces, [2], 0.4)
    whole = 2 + 2**0.5
    rows = {r.face_id: (r.original, r.face, r.facets, r.small, round(r.share * whole, 9)) for r in report.collect()}
    assert rows == {0: (1, 1, 2, True, 1.0), 4: (3, 2, 2, True, 1.0)}
    kinds = {(r.lo, r.hi): r.kind for r in features.boundary_edges(table, faces.filter("face_id <> 2")).collect()}
    assert kinds[(2, 3)] == kinds[(4, 5)] == "feature" and kinds[(3, 4)] == "flat" and kinds[(0, 1)] == "open"
    for wrong in ([4], [0]):
        with pytest.raises(ValueError):
            features.face_report(table, faces, wrong)
    with pytest.raises(ValueError):
        features.face_report(table, faces, small=2.0)


def brute(points):
    """Hull corners and least width over all pairs of points."""
    corners, width = set(), np.inf
    for a in points:
        for b in points:
            e = b - a
            if (e == 0).all():
                continue
            turn = e[0] * (points - a)[:, 1] - e[1] * (points - a)[:, 0]
            reach = (points - a) @ e
            if turn.min() >= 0 and not ((turn == 0) & ((reach < 0) | (reach > e @ e))).any():
                corners.add(tuple(a))
                width = min(width, turn.max() / np.hypot(*e))
    return corners, width


def test_hulls_and_widths_equal_brute_force():
    rng = np.random.default_rng(3)
    for n in (3, 4, 7, 30, 60):
        for _ in range(20):
            points = rng.integers(-6, 7, (n, 2)).astype(float)
            corners, width = brute(points)
            if len(corners) < 3:
                continue
            found = ports.hull(points)
            assert set(map(tuple, found)) == corners
            assert ports.least_width(found) == pytest.approx(width)
            halves = np.r_[ports.hull(points[: n // 2]), ports.hull(points[n // 2 :])]
            assert set(map(tuple, ports.hull(halves))) == corners


def test_a_tilted_disc(spark):
    """A fan of 400 facets about a point, tilted: the diameter of its circle, the width of its polygon, one hot face."""
    turn = np.linalg.qr(np.random.default_rng(1).normal(size=(3, 3)))[0]
    angle = 2 * np.pi * np.arange(400) / 400
    rim = np.c_[np.cos(angle), np.sin(angle), np.zeros(400)] @ turn + 50
    rows = [(i, 0, i + 1, (i + 1) % 400 + 1, *([50.0] * 3), *map(float, rim[i]), *map(float, rim[(i + 1) % 400])) for i in range(400)]
    table = spark.createDataFrame(rows, COLUMNS).repartition(7)
    faces = table.select("facet_id", F.lit(0).cast("long").alias("face_id"))
    (found,) = ports.port_sizes(table, faces).collect()
    assert (found.facets, found.corners) == (400, 400)
    assert found.width == pytest.approx(2 * np.cos(np.pi / 400)) and found.diameter == pytest.approx(2, rel=1e-3)
    flat = spark.createDataFrame([(0, 0, 1, 2, *([0.0] * 3), 1.0, 0.0, 0.0, 2.0, 0.0, 0.0)], COLUMNS)
    assert [(r.corners, r.width) for r in ports.port_sizes(flat, flat.select("facet_id", F.lit(0).cast("long").alias("face_id"))).collect()] == [(0, None)]
    assert ports.port_sizes(flat.limit(0), faces).collect() == []
