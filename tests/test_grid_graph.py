"""Partition graphs of small grids against plain loops and figures that follow by hand."""

from collections import Counter
from itertools import product

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import grid_graph, tree

CELLS = "level int, i long, j long, cell_type int, members int"
ATOM = "atom struct<level int, i long, j long>, "


def test_square_ring_in_quadrants(spark):
    """An 8 by 8 square with a hole of 4 by 4: every quadrant has work 12, two messages of two links, and half of its cut edges with each side."""
    ring = [(3, x, y) for x in range(8) for y in range(8) if not (2 <= x < 6 and 2 <= y < 6)]
    links = [(a, (3, a[1] + dx, a[2] + dy)) for a in ring for dx, dy in ((1, 0), (0, 1)) if (3, a[1] + dx, a[2] + dy) in ring]
    found = spark.createDataFrame([(a, 1.0) for a in ring], ATOM + "work double")
    between = spark.createDataFrame([(a, b, 1.0, 8.0, 1) for a, b in links], "a struct<level int, i long, j long>, b struct<level int, i long, j long>, weight double, bytes double, phases long")
    owners = spark.createDataFrame([(a, a[1] // 4 + 2 * (a[2] // 4)) for a in ring], ATOM + "rank int")
    rows = grid_graph.rank_costs(found, between, owners, 0.0, 8.0).collect()
    assert [(r.atoms, r.work, r.largest, r.cut, r.peers, r.time) for r in rows] == [(12, 12.0, 1.0, 4.0, 2, 4.0)] * 4  # 16 ends of 8 cut edges
    alone = grid_graph.rank_costs(found, between, owners.withColumn("rank", F.lit(0)), 1.0, 8.0).first()
    assert (alone.work, alone.cut, alone.peers, alone.time) == (48.0, 0.0, 0, 0.0)
    assert grid_graph.rank_costs(found.limit(0), between, owners, 0.0, 8.0).isEmpty()


def test_graph_of_a_tree_against_loops(spark):
    r = np.random.default_rng(8)
    points = spark.createDataFrame([(int(i), int(j)) for i, j in r.integers(0, 32, (220, 2)) ** 2 // 31], "i long, j long")
    leaves = [tuple(x) for x in tree.balance(tree.refine(points, 5, 6).select("level", "i", "j"), 5).collect()]
    rows = [(l, i, j, int(r.integers(0, 3)), [None, 0, 1, 3][r.integers(0, 4)]) for l, i, j in leaves]
    cells = spark.createDataFrame(rows, CELLS)
    wet = {row[:3]: row for row in rows if row[3]}
    pairs = tree.interfaces(cells.filter("cell_type > 0").select("level", "i", "j"))
    for block_level in (0, 2, 3, 9):
        atom = lambda c: (min(c[0], block_level), *(x >> max(c[0] - block_level, 0) for x in c[1:]))  # noqa: E731,B023
        work, count, weight, size, phases = Counter(), Counter(), Counter(), Counter(), Counter()
        met = [(c, (c[0], c[1] + d, c[2] + e), 8.0, 0) for c in wet for d, e in product((-1, 0, 1), repeat=2) if (d, e) > (0, 0)]
        fine = [(l, i, j, 2 * i + d, 2 * j + e) for l, i, j in wet for d, e in ((-1, 0), (-1, 1), (2, 0), (2, 1), (0, -1), (1, -1), (0, 2), (1, 2))]
        couples = [((l, i, j), (l + 1, p, q), 64.0, 32) for l, i, j, p, q in fine if (l + 1, p, q) in wet]
        for c, (level, _, _, kind, members) in wet.items():
            work[atom(c)] += (1 + (max(members or 0, 1) if kind == 1 else 0)) * 2**level
            count[atom(c)] += 1
        for c, other, *_ in couples:
            work[atom(c)] += 2 ** c[0] / 2
            work[atom(other)] += 2 ** c[0] / 2
        for c, other, each, bit in met + couples:
            if other in wet and atom(c) != atom(other):
                key = tuple(sorted((atom(c), atom(other))))
                weight[key] += 2 ** c[0]
                size[key] += each * 2 ** c[0]
                phases[key] |= 1 << (c[0] + bit)
        got = {tuple(x.atom): (x.work, x.cells) for x in grid_graph.atoms(cells, pairs, block_level).collect()}
        assert got == {a: (work[a], count[a]) for a in work}
        edges = {(tuple(x.a), tuple(x.b)): (x.weight, x.bytes, x.phases) for x in grid_graph.edges(cells, pairs, block_level).collect()}
        assert edges == {k: (weight[k], size[k], phases[k]) for k in weight}
    assert any(b for *_, b in couples) and edges
    assert grid_graph.atoms(cells.limit(0), pairs.limit(0), 2).isEmpty() and grid_graph.edges(cells.limit(0), pairs.limit(0), 2).isEmpty()
