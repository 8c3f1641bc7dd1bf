"""Graph formats, duals, matching, contraction and orders."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import sparse
from tessera.sources import graphs


def test_graph_files(spark, tmp_path):
    (tmp_path / "plain.graph").write_text("% a comment\n4 3\n2\n1 3\n2 4\n3\n")
    (tmp_path / "weighted.graph").write_text("3 2 011 2\n7 8 2 5\n7 8 1 5 3 6\n7 8 2 6\n")
    plain = graphs.read_graph(spark, str(tmp_path / "plain.graph"))
    assert sorted((r.a, r.b, r.w) for r in plain.collect()) == [(0, 1, 1), (1, 0, 1), (1, 2, 1), (2, 1, 1), (2, 3, 1), (3, 2, 1)]
    weighted = graphs.read_graph(spark, str(tmp_path / "weighted.graph"))
    assert sorted((r.a, r.b, r.w) for r in weighted.collect()) == [(0, 1, 5), (1, 0, 5), (1, 2, 6), (2, 1, 6)]
    assert graphs.one_sided(weighted).isEmpty()
    assert graphs.one_sided(weighted.filter("a < 2")).count() == 1


def test_graph_files_in_splits(spark, tmp_path):
    """A ring of 3,000 vertices read in splits of 4 kB, with comments between, equals the ring; part files in order are one file."""
    n = 3000
    ring = spark.range(n).select(F.col("id").alias("a"), ((F.col("id") + 1) % n).alias("b"), (F.col("id") % 7 + 1).cast("double").alias("w"))
    both = ring.union(ring.select("b", "a", "w"))
    graphs.write_lines(graphs.graph_lines(both, n), str(tmp_path / "out"))
    parts = [p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))]
    lines = "".join(parts).splitlines()
    (tmp_path / "ring.graph").write_text("".join(f"{x}\n" + "% note\n" * (i % 3) for i, x in enumerate(lines)) + "\n\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "16")
    try:
        assert spark.read.text(str(tmp_path / "ring.graph")).rdd.getNumPartitions() > 5
        found = graphs.read_graph(spark, str(tmp_path / "ring.graph")).drop("path")
        assert sorted(found.collect()) == sorted(both.collect())
        assert graphs.graph_faults(found, n).isEmpty()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    for i, broken in enumerate(("", "% only\n", "\n".join(lines[:-9]), "2 1\n2\n3\n", "2 1\n2\nx\n", "2 2\n2\n1\n", "2 1\n2\n1\n1\n", "a b\n")):
        (tmp_path / f"broken{i}").write_text(broken)
        with pytest.raises(ValueError):
            graphs.read_graph(spark, str(tmp_path / f"broken{i}"))


def test_vertices_and_faults(spark, tmp_path):
    (tmp_path / "g").write_text("3 2 111 2\n9 7 8 2 5\n1 7 8 1 5 3 6\n4 7 9 2 6\n")
    assert sorted((r.a, r.size, r.weights) for r in graphs.read_vertices(spark, str(tmp_path / "g")).collect()) == [(0, 9, [7, 8]), (1, 1, [7, 8]), (2, 4, [7, 9])]
    edges = spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.0), (0, 1, 1.0), (1, 0, 2.0), (2, 1, 1.0), (1, 2, 3.0), (1, 9, 1.0), (9, 1, 1.0)], "a long, b long, w double")
    assert sorted(map(tuple, graphs.graph_faults(edges, 3).collect())) == [("loop", 0, 0, 1), ("one way", 0, 1, 3), ("one way", 1, 2, 2), ("range", 1, 9, 1), ("range", 9, 1, 1), ("repeated", 0, 1, 3)]


def test_row_formats_round_trip(spark, tmp_path):
    entries = spark.createDataFrame([(0, 3, 1.5), (0, 1, 2.0), (2, 1, -2.0)], "row long, col long, val double")
    for i, (header, values, first) in enumerate([(True, True, 1), (False, True, 0), (False, False, 1)]):
        graphs.write_lines(graphs.row_lines(entries, 4, 5, header, values, first).coalesce(1), str(tmp_path / f"m{i}"))
        (tmp_path / f"f{i}").write_text("".join(p.read_text() for p in sorted((tmp_path / f"m{i}").glob("part-*"))))
        back = graphs.read_rows(spark, str(tmp_path / f"f{i}"), header, values, first).drop("path")
        assert sorted(map(tuple, back.collect())) == sorted((r.row, r.col, r.val if values else 1.0) for r in entries.collect())
    for i, broken in enumerate(("1 2 2\n1 5\n", "1 2 1\n3 5\n", "2 2 1\n1 5\n", "1 2 1\nx 5\n", "1 2 1\n1\n")):
        (tmp_path / f"b{i}").write_text(broken)
        with pytest.raises(ValueError):
            graphs.read_rows(spark, str(tmp_path / f"b{i}"))


def test_triples_round_trip(spark, tmp_path):
    entries = spark.createDataFrame([(0, 3, 1.5), (2, 1, -2.0)], "row long, col long, val double")
    graphs.triples(entries).write.text(str(tmp_path / "m"))
    assert sorted(graphs.read_triples(spark, str(tmp_path / "m")).collect()) == sorted(entries.collect())


def test_dual_of_three_triangles(spark):
    elements = spark.createDataFrame([(0, n) for n in (1, 2, 3)] + [(1, n) for n in (2, 3, 4)] + [(2, n) for n in (4, 5, 6)], "element long, node long")
    assert sorted(map(tuple, graphs.mesh_dual(elements).collect())) == [(0, 1, 2), (1, 2, 1)]
    assert graphs.mesh_dual(elements, 2).count() == 1


def test_matching_and_contraction(spark):
    edges = spark.createDataFrame([(0, 1, 5.0), (1, 2, 3.0), (2, 3, 5.0), (3, 0, 1.0)], "a long, b long, w double")
    matched = graphs.heaviest_matches(edges)
    assert sorted(map(tuple, matched.collect())) == [(0, 1), (2, 3)]
    labels = spark.createDataFrame([(0, 0), (1, 0), (2, 2), (3, 2)], "node long, label long")
    assert [tuple(r) for r in graphs.contract(edges, labels).collect()] == [(0, 2, 4.0)]


def test_equal_weights_still_match(spark):
    path = spark.createDataFrame([(i, i + 1, 1.0) for i in range(5)], "a long, b long, w double")
    assert (0, 1) in {tuple(r) for r in graphs.heaviest_matches(path).collect()}


def test_breadth_first_order(spark):
    edges = sparse.symmetric(spark.createDataFrame([(5, 1), (5, 3), (3, 2), (1, 4)], "a long, b long").withColumn("w", F.lit(1.0)))
    order = graphs.ranked_levels(sparse.shortest_paths(edges, 5))
    assert [r.node for r in order.orderBy("position").collect()] == [5, 1, 3, 2, 4]


def test_parts_of_matrices(spark):
    entries = spark.createDataFrame([(r, c, float(10 * r + c)) for r in range(4) for c in range(3) if r != 2], "row long, col long, val double")
    assert sorted(map(tuple, sparse.submatrix(entries, (1, 3), (1, 1)).collect())) == [(0, 0, 11), (2, 0, 31)]
    assert sparse.submatrix(entries).count() == 9
    wanted = spark.createDataFrame([(0, 3), (1, 0), (2, 3), (3, 2)], "position long, row long")
    assert sorted((r.row, r.val) for r in sparse.picked_rows(entries, wanted).filter("col = 1").collect()) == [(0, 31), (1, 1), (2, 31)]
    parts = spark.createDataFrame([(0, 5), (1, 6), (2, 5), (3, 5)], "row long, part long")
    found = {(r.part, r.row, r.whole_row) for r in sparse.part_rows(entries, parts).collect()}
    assert found == {(5, 0, 0), (6, 0, 1), (5, 2, 3)}
    order = sparse.permutation(spark.range(50), 3)
    rows = sorted(map(tuple, order.collect()))
    assert sorted(p for _, p in rows) == list(range(50)) and [p for _, p in rows] != list(range(50))
    assert rows == sorted(map(tuple, sparse.permutation(spark.range(50).repartition(3), 3).collect()))
    some = spark.createDataFrame([(3, 0), (1, 1)], "id long, position long")
    assert sorted(map(tuple, sparse.renumbered(entries, some, "both").collect())) == [(1, 1, 11.0), (0, 1, 31.0)][::-1]
    assert sparse.permutation(spark.range(0), 3).collect() == [] and sparse.part_rows(entries.limit(0), parts).collect() == []


def test_similarity_of_pairs(spark):
    rows = {0: {0: 1.0, 2: 2.0, 5: 3.0}, 1: {2: 1.0, 3: 2.0}, 2: {0: 2.0, 2: 4.0, 5: 6.0}}
    entries = spark.createDataFrame([(r, c, v) for r, cols in rows.items() for c, v in cols.items()], "row long, col long, val double")
    pairs = spark.createDataFrame([(0, 1), (0, 2), (1, 0), (0, 0), (0, 9), (8, 9), (0, 1)], "a long, b long")

    def brute(a, b, measure, whole):
        x, y = rows.get(a, {}), rows.get(b, {})
        end = max(max(x, default=-1), max(y, default=-1)) if whole else min(max(x, default=-1), max(y, default=-1))
        x, y = ({c: v for c, v in z.items() if c <= end} for z in (x, y))
        if measure in ("cosine", "tanimoto"):
            s, p, q = sum(x[c] * y[c] for c in x if c in y), sum(v * v for v in x.values()), sum(v * v for v in y.values())
        else:
            s, p, q = sum(min(x[c], y[c]) for c in x if c in y), sum(x.values()), sum(y.values())
        below = {"cosine": (p * q) ** 0.5, "amin": p}.get(measure, p + q - s)
        return s / below if below > 0 else 0.0

    for measure in ("cosine", "tanimoto", "min", "amin"):
        for whole in (True, False):
            found = {(r.a, r.b): r.similarity for r in sparse.pair_similarity(entries, pairs, measure, whole).collect()}
            assert found == pytest.approx({p: brute(*p, measure, whole) for p in {(0, 1), (0, 2), (1, 0), (0, 0), (0, 9), (8, 9)}})
    with pytest.raises(ValueError):
        sparse.pair_similarity(entries, pairs, "other")


def test_area_up_to_a_number_of_negatives(spark):
    rng = np.random.default_rng(6)
    rows = [(i, float(rng.integers(0, 12)), int(rng.random() < 0.4)) for i in range(80)]

    def brute(limit):
        tp = fp = before = negatives = area = 0
        last = None
        for key, s, p in sorted(rows, key=lambda r: (-r[1], r[0])):
            if fp == limit:
                break
            if s != last:
                area += (tp + before) * (fp - negatives) // 2
                last, before, negatives = s, tp, fp
            tp, fp = tp + p, fp + 1 - p
        area += (tp + before) * (fp - negatives) // 2
        whole = sum(p for *_, p in rows)
        return whole, tp, fp, area / (whole * fp) if tp * fp else 0.0

    table = spark.createDataFrame(rows, "id long, score double, good int")
    for limit in (1, 7, 1000):
        assert tuple(sparse.first_negatives(table, "score", "good", "id", limit).first()) == pytest.approx(brute(limit))
    assert tuple(sparse.first_negatives(table.limit(0), "score", "good", "id", 5).first()) == (0, 0, 0, 0.0)
