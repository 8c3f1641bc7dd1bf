"""Flows: sides, algebra, domains, translation and errors."""

from itertools import product

import pytest

from tessera.functions.vectors import vector
from tessera.operators.flow import external, internal
from tessera.operators.shapes import Ball, Box, Cylinder

ROOM, PILLAR = internal(Box((0, 0, 0), (8, 6, 4))), Cylinder(2, (4.0, 3.0), 1.0, 0.0, 4.0)
OPEN = (-4.0, -4.0, -4.0), (12.0, 10.0, 8.0)


def located(spark, flow, points):
    table = spark.createDataFrame([tuple(map(float, p)) for p in points], "x double, y double, z double")
    return [r[0] for r in table.coalesce(1).select(flow.location(vector("x", "y", "z"))).collect()]


def test_sides(spark):
    points = [(4, 3, 2), (1, 1, 1), (0, 1, 1), (9, 1, 1), (5, 3, 2)]
    assert located(spark, ROOM, points) == ["wet", "wet", "surface", "dry", "wet"]
    around = external(Box((0, 0, 0), (8, 6, 4)), *OPEN)
    assert located(spark, around, points) == ["dry", "dry", "surface", "wet", "dry"]
    assert not around.internal and around.domain == OPEN and ROOM.domain == ((0.0, 0.0, 0.0), (8.0, 6.0, 4.0))


def test_algebra(spark):
    points = [(4, 3, 2), (1, 1, 1), (5, 3, 2), (9, 1, 1), (7, 3, 2)]
    pierced = ROOM & external(PILLAR, *OPEN)
    assert pierced.internal and pierced.domain == ROOM.domain and (external(PILLAR, *OPEN) & ROOM).domain == ROOM.domain
    assert located(spark, pierced, points) == ["dry", "wet", "surface", "dry", "wet"]
    assert located(spark, ROOM - internal(PILLAR), points) == ["dry", "wet", "surface", "dry", "wet"]
    more = internal(Ball((9.0, 1.0, 1.0), 1.5))
    joined = ROOM | more
    assert located(spark, joined, points) == ["wet", "wet", "wet", "wet", "wet"] and joined.domain == ((0.0, -0.5, -0.5), (10.5, 6.0, 4.0))
    two = external(PILLAR, *OPEN) & external(Ball((9.0, 1.0, 1.0), 0.5), *OPEN)
    assert two.domain == OPEN and (two.low, two.high) == ((3.0, 0.5, 0.0), (9.5, 4.0, 4.0)) and located(spark, two, points) == ["dry", "wet", "surface", "dry", "wet"]
    assert (ROOM & more).domain == ROOM.domain


def test_translation_and_grids(spark):
    moved = (ROOM - internal(PILLAR)).translated((10, 20, 30))
    assert moved.domain == ((10.0, 20.0, 30.0), (18.0, 26.0, 34.0)) and located(spark, moved, [(14, 23, 32), (11, 21, 31)]) == ["dry", "wet"]
    around = external(Ball((1.0, 1.0, 1.0), 1.0), (-1, -2, -3), (5, 5, 5)).translated()
    assert around.domain == ((0.0, 0.0, 0.0), (6.0, 7.0, 8.0)) and located(spark, around, [(2, 3, 4), (3, 3, 4), (0, 0, 0)]) == ["dry", "surface", "wet"]
    assert ROOM.counts(0.75) == (11, 8, 6) and ROOM.cells(spark, 2.0).count() == 4 * 3 * 2
    wet = ROOM.cells(spark, 1.0).filter(ROOM.location(vector("x", "y", "z")) == "wet")
    assert {(r.i, r.j, r.k) for r in wet.collect()} == set(product(range(8), range(6), range(4)))


@pytest.mark.parametrize("build", [
    lambda: internal(Box((0, 0, 0), (1, 0, 1))), lambda: internal(Ball((0.0, 0.0, 0.0), -1.0)), lambda: internal(Box((0, 0, 0), (1, float("inf"), 1))),
    lambda: external(PILLAR, (0, 0, 0), (1, 1, 1)), lambda: external(PILLAR, (5, 5, 5), (5, 6, 6)),
    lambda: ROOM | external(PILLAR, *OPEN), lambda: ROOM - external(PILLAR, *OPEN), lambda: external(PILLAR, *OPEN) & external(PILLAR, OPEN[0], (20.0, 20.0, 20.0)),
    lambda: ROOM.translated(), lambda: external(PILLAR, *OPEN).translated((0, 0, 0)),
    lambda: ROOM.counts(0.0), lambda: ROOM.counts(float("nan")),
])
def test_errors_before_any_plan(build):
    with pytest.raises(ValueError):
        build()


def test_too_many_cells():
    with pytest.raises(OverflowError):
        ROOM.counts(1e-6)
    with pytest.raises(OverflowError):
        ROOM.counts(1e-300)
    with pytest.raises(TypeError):
        internal(Box((0, 0), (1, 1)) | Box((0, 0), (2, 2)))
