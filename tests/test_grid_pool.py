"""Cell pools, interface blocks and touching leaves against plain loops."""

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import grid_graph, grid_pool, tree

MODEL_SIZES = {"D3Q15": {1, 3}, "D3Q19": {1, 2}, "D3Q27": {1, 2, 3}}


def leaves_of(spark, axes, seed, balanced):
    r = np.random.default_rng(seed)
    places = np.r_[r.integers(0, 16, (40, len(axes))) ** 2 // 15, 8 + r.integers(0, 2, (30, len(axes)))]
    points = spark.createDataFrame([tuple(map(int, row)) for row in places], ", ".join(f"{c} long" for c in axes))
    leaves = tree.refine(points, 4, 4, axes).select("level", *axes)
    return tree.balance(leaves, 4, axes) if balanced else leaves


@pytest.mark.parametrize("axes", ["ij", "ijk"])
def test_roles_pool_and_blocks(spark, axes):
    r = np.random.default_rng(len(axes))
    n = len(axes)
    leaves = sorted(tuple(x) for x in leaves_of(spark, axes, 5, True).collect())
    kind = {x: int(r.integers(0, 3)) for x in leaves}
    out = {x: [None, False, True][r.integers(0, 3)] for x in leaves}
    table = spark.createDataFrame([(*x, kind[x], out[x]) for x in leaves], "level int, " + ", ".join(f"{c} long" for c in axes) + ", cell_type int, away boolean")

    there = set(leaves)
    split = {(x[0] - 1, *(c >> 1 for c in x[1:])) for x in leaves if x[0]}
    step = list(product((-1, 0, 1), repeat=n))
    moved = lambda x, d: (x[0], *(a + b for a, b in zip(x[1:], d, strict=True)))
    coarse = {x for x in leaves if not out[x] and any(moved(x, d) in split for d in step)}
    near = lambda x: {(x[0] - 1, *((a + b) >> 1 for a, b in zip(x[1:], d, strict=True))) for d in product(range(-2, 3), repeat=n)}
    fine = {x for x in leaves if x[0] and near(x) & coarse}
    roles = grid_pool.interface_roles(table, axes, "away").cache()
    assert {tuple(x[: n + 1]): x.role for x in roles.collect()} == {x: (x in fine) + 2 * (x in coarse) for x in leaves}
    assert coarse and fine & coarse

    wet = {x for x in leaves if kind[x]}
    pairs = {(y, x) for x in wet & fine for y in near(x) & coarse & wet}
    kept = {x: (x in {p[1] for p in pairs}) + 2 * (x in {p[0] for p in pairs}) for x in wet}
    bits = lambda c: [(v >> b) & 1 for b in range(8, -1, -1) for v in reversed(c)]
    cells = [(x[0], kept[x], 0 if kind[x] == 2 else 1, bits(x[1:]), 0, x, kind[x], None) for x in wet]
    for x in wet:
        if kept[x] >= 2:
            cells += [(x[0] + 1, 4, 0, bits(x[1:]), q, (x[0] + 1, *(2 * c + (q >> d) % 2 for d, c in enumerate(x[1:]))), None, q) for q in range(2**n)]
    want = [(i, *c[5], c[1], c[6], c[7]) for i, c in enumerate(sorted(cells, key=lambda c: c[:5]))]
    pool = grid_pool.cell_pool(roles, axes).cache()
    assert sorted(map(tuple, pool.collect())) == want

    number = {(c[1 : n + 2], c[-1]): c[0] for c in want}
    blocks = {(number[y, None], number[(y[0] + 1, *(2 * c for c in y[1:])), 0], number[x, None]) for y, x in pairs}
    got = [tuple(x) for x in grid_pool.interface_blocks(pool, axes).collect()]
    assert set(got) == blocks and len(got) == len(blocks)
    sources = {tuple(x) for x in grid_pool.auxiliary_sources(pool, axes).collect()}
    assert sources == {(c[0], number[(c[1] - 1, *(v >> 1 for v in c[2 : n + 2])), None]) for c in want if c[-1] is not None}
    for x in grid_pool.pool_ranges(pool).collect():
        assert [c[0] for c in want if (c[1], c[n + 2], c[n + 3]) == (x.level, x.role, x.cell_type)] == list(range(x.first, x.end))

    records = spark.createDataFrame([(*x, 7) for x in leaves], "level int, " + ", ".join(f"{c} long" for c in axes) + ", face int")
    assert {tuple(x) for x in grid_pool.boundary_cells(records, pool, axes).collect()} == {(7, number[x, None]) for x in wet}
    faults = grid_pool.boundary_faults(spark.createDataFrame([(c[0],) for c in want] + [(10**6,)], "cell_index long"), pool)
    assert {x.cell_index: x.fault for x in faults.collect()} == {10**6: "no such cell"} | {c[0]: "auxiliary cell" if c[-1] is not None else "not a boundary cell" for c in want if c[n + 3] != 1}
    with pytest.raises(Exception, match="no auxiliary cells"):
        grid_pool.interface_blocks(pool.filter("role <> 4"), axes).collect()
    with pytest.raises(Exception, match="no source"):
        grid_pool.auxiliary_sources(pool.filter("role = 4"), axes).collect()
    assert grid_pool.cell_pool(roles.limit(0), axes).isEmpty() and grid_pool.interface_roles(table.limit(0), axes).isEmpty()


@pytest.mark.parametrize(("axes", "balanced"), [("ij", False), ("ijk", False), ("ij", True)])
def test_touching_leaves(spark, axes, balanced):
    table = leaves_of(spark, axes, 6, balanced)
    leaves = sorted(tuple(x) for x in table.collect())
    box = {x: [(c << (4 - x[0]), (c + 1) << (4 - x[0])) for c in x[1:]] for x in leaves}
    want = {}
    for a in leaves:
        for b in leaves:
            if a < b and all(p[0] <= q[1] and q[0] <= p[1] for p, q in zip(box[a], box[b], strict=True)):
                want[frozenset((a, b))] = sum(p[1] == q[0] or q[1] == p[0] for p, q in zip(box[a], box[b], strict=True))
    got = [tuple(x) for x in grid_pool.touching_leaves(table, 4, axes).collect()]
    n = len(axes) + 1
    assert {frozenset((x[:n], x[n : 2 * n])): x[-1] for x in got} == want and len(got) == len(want)
    assert all(x[0] >= x[n] for x in got) and {abs(x[0] - x[n]) for x in got} >= ({0, 1} if balanced else {0, 1, 2})
    assert grid_pool.touching_leaves(table.limit(0), 4, axes).isEmpty()


@pytest.mark.parametrize("model", sorted(MODEL_SIZES))
def test_links_of_lattices_in_space(spark, model):
    """A cube of 3 by 3 by 3 cells, each an atom: its centre meets as many neighbours as the lattice has links."""
    cells = spark.createDataFrame([(2, i, j, k, 2, 0) for i, j, k in product(range(3), repeat=3)], "level int, i long, j long, k long, cell_type int, members int")
    none = tree.interfaces(cells.select("level", *"ijk"), "ijk")
    costs = grid_graph.Costs(link_weight=3.0, link_bytes=5.0)
    got = {(tuple(x.a)[1:], tuple(x.b)[1:]): (x.weight, x.bytes, x.phases) for x in grid_graph.edges(cells, none, 2, "ijk", model, costs).collect()}
    want = {(a, b) for a in product(range(3), repeat=3) for b in product(range(3), repeat=3) if a < b and max(abs(p - q) for p, q in zip(a, b, strict=True)) == 1 and sum((p - q) ** 2 for p, q in zip(a, b, strict=True)) in MODEL_SIZES[model]}
    assert got == {pair: (12.0, 20.0, 4) for pair in want}
    assert sum((1, 1, 1) in pair for pair in want) == int(model[3:]) - 1


def test_costs_of_levels_and_auxiliary_cells(spark):
    rows = [(1, 0, 0, 0, 2, None, 0), (1, 1, 0, 1, 1, None, 3), (2, 2, 0, 4, None, 0, None), (2, 3, 1, 4, None, 3, None), (2, 0, 2, 2, 1, None, None)]
    cells = spark.createDataFrame(rows, "level int, i long, j long, role int, cell_type int, child int, members int")
    pairs = spark.createDataFrame([(1, 1, 0, 0, 2)], "level int, i long, j long, fine_i long, fine_j long")
    costs = grid_graph.Costs(wet=2.0, each_face=0.5, auxiliary=0.25, each_pair=3.0, levels=(1.0, 10.0, 100.0))
    got = {tuple(x.atom): (x.work, x.cells) for x in grid_graph.atoms(cells, pairs, 5, costs=costs).collect()}
    assert got == {(1, 0, 0): (40.0, 1), (1, 1, 0): (3.5 * 20 + 2 * 0.25 * 20 + 1.5 * 20, 3), (2, 0, 2): (2.5 * 400 + 1.5 * 20, 1)}
    owners = spark.createDataFrame([((1, 0, 0), 0), ((1, 1, 0), 1), ((2, 0, 2), 1)], "atom struct<level int, i long, j long>, rank int")
    found = {(x.rank, x.level): (x.work, x.real, x.auxiliary) for x in grid_graph.level_work(cells, owners, 5, costs=costs).collect()}
    assert found == {(0, 1): (40.0, 1, 0), (1, 1): (70.0, 1, 0), (1, 2): (1010.0, 1, 2)}
    with pytest.raises(Exception, match="do not cover"):
        grid_graph.atoms(cells, pairs, 5, costs=grid_graph.Costs(levels=(1.0,))).collect()
    for bad in ({"wet": 0.0}, {"link_bytes": -1.0}, {"levels": (0.0,)}, {"each_pair": float("inf")}):
        with pytest.raises(ValueError):
            grid_graph.Costs(**bad)
