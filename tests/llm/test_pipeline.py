"""The pipeline's stages, each judged on its own input."""

import hashlib
from collections import defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import SCHEMA, SMALL, WORD, components, odd_rows, order, passage, repeats

from tessera.plans.tables import saved


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = {"input": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = found[name] = saved(stage(spark, docs, SMALL))
    return found


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def lines_cut(rows, min_sites=10):
    """By brute force: the (id, text, site) rows without the lines that so many sites have."""
    sites, first = defaultdict(set), {}
    for i, text, site in rows:
        for line in (text or "").split("\n"):
            bare = line.strip(" ")
            if bare:
                sites[bare] |= {site} - {None}
                if i is not None:
                    first[bare] = min(first.get(bare, i), i)
    common = {line for line, of in sites.items() if len(of) >= min_sites}
    return [
        (i, None if text is None else "\n".join(x for x in text.split("\n") if x.strip(" ") not in common or (i is not None and i <= first[x.strip(" ")])))
        for i, text, _ in rows
    ]


def test_stages_keep_the_columns(steps):
    columns = steps["input"].columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "substring_dedup", "packing"]
    for name in ("quality_rules", "line_dedup", "near_dedup", "substring_dedup"):
        assert steps[name].columns == columns
        assert all(r.n_chars == len(r.text) for r in steps[name].collect())


def test_quality_rules_keeps_what_the_operator_keeps(steps):
    from tessera.llm.quality import quality

    kept = {r.doc_id for r in quality(steps["input"]).filter("kept").collect()}
    assert {r.doc_id: tuple(r) for r in steps["quality_rules"].collect()} == {r.doc_id: tuple(r) for r in steps["input"].collect() if r.doc_id in kept}


def test_line_dedup_cuts_common_lines(steps):
    before = [(r.doc_id, r.text, r.source) for r in steps["quality_rules"].collect()]
    assert order((r.doc_id, r.text) for r in steps["line_dedup"].collect()) == order(lines_cut(before))


def test_near_dedup_keeps_one_of_each_group(steps):
    before = [(r.doc_id, r.text) for r in steps["line_dedup"].collect()]
    assert sorted(rows(steps["near_dedup"])) == sorted(i for i, _, c in components(before, 5, 80) if i == c)


def test_substring_dedup_cuts_what_repeats(steps):
    before = [(r.doc_id, r.text) for r in steps["near_dedup"].collect()]
    after = rows(steps["substring_dedup"])
    for i, n, removed, _ in repeats(before, 50):
        assert len(after[i].text.split()) == n - removed


def test_packing_holds_every_token(steps):
    packed = steps["packing"]
    assert packed.select("doc_id").distinct().count() == steps["substring_dedup"].count()
    assert packed.filter(F.size("ids") != F.col("length")).isEmpty()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 1024").isEmpty()


def test_run_gives_the_last_stage(spark, steps):
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(corpus_pipeline.run(spark, SMALL).select(key).collect()) == sorted(steps["packing"].select(key).collect())


def test_rows_keep_their_own_texts(spark):
    """Rows without an id, and rows that share one, with different texts: after every stage each has what is left of its own."""
    shared = passage(1, 60)
    own = [passage(60 + k, 30) for k in range(4)]
    texts = [(1, shared), *((i, f"{t} {shared}") for i, t in zip((None, None, 5, 5), own)), (None, None), (5, "")]
    menu = [(10 + i, f"page {i}\nMenu\n{passage(20 + i, 30)}", f"s{i}") for i in range(11)]
    menu += [(None, f"nobody {k}\nMenu\n{passage(40 + k, 30)}", "s1") for k in range(2)] + [(15, "twice\nMenu", "s2"), (10, "first again\nMenu", "s3")]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in texts] + [(i, t, "en", s, None) for i, t, s in menu], "doc_id long, text string, lang string, source string, n_chars long")
    plain = [(r.doc_id, r.text) for r in docs.collect()]

    cut = stage("substring_dedup")(spark, docs, SMALL).collect()
    assert order((r.doc_id, len(WORD.findall(r.text or "")), hashlib.sha256(" ".join(WORD.findall(r.text or "")).encode()).hexdigest()) for r in cut) == order((i, n - gone, sha) for i, n, gone, sha in repeats(plain, 50))
    assert {f"{t} " for t in own} <= {r.text for r in cut}

    lines = stage("line_dedup")(spark, docs, SMALL).collect()
    assert order((r.doc_id, r.text) for r in lines) == order(lines_cut([(r.doc_id, r.text, r.source) for r in docs.collect()]))

    near = stage("near_dedup")(spark, docs, SMALL).collect()
    assert order((r.doc_id, r.text) for r in near) == order(plain)  # no two are near

    long_ = spark.createDataFrame([(None, passage(7, 80), "en"), (None, "short", "en"), (3, "short", "en"), (3, passage(8, 80), "en")], "doc_id long, text string, lang string")
    assert order(r.text for r in stage("quality_rules")(spark, long_, SMALL).collect()) == order([passage(7, 80), passage(8, 80)])


def test_near_dedup_leaves_one_row_of_copies(spark):
    text, other = passage(9, 80), passage(10, 80)
    docs = spark.createDataFrame([(None, text), (None, text), (7, other), (7, other), (8, other), (4, f"{other} z"), (None, None), (None, None), (6, " ")], "doc_id long, text string")
    kept = stage("near_dedup")(spark, docs, SMALL).collect()
    assert order(tuple(r) for r in kept) == order([(None, text), (4, f"{other} z"), (None, None), (None, None), (6, " ")])


def test_odd_rows_pass_through(spark):
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    texts = {r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SMALL)
        assert after.columns == docs.columns, name
        assert after.count() <= docs.count()
        if name in ("quality_rules", "near_dedup"):
            assert {r.text for r in after.collect()} <= texts
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert packed.filter("piece = 0").count() == docs.count()


def test_empty_tables_pass_through(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).isEmpty(), name
