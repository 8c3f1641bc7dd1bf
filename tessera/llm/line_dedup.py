"""Removal of boilerplate lines that spread over many sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._rows import others, whole
from tessera.plans.tables import saved

#: Registers of a sketch, as a power of two; its relative standard error is about 1.04 / sqrt(2**LG_K).
LG_K = 12


def remove_boilerplate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = 10, with_text: bool = True, whole_rows: bool = False
) -> DataFrame:
    """Removes lines that occur on ``min_sites`` or more distinct sites.

    A line is a piece between line feeds, compared without spaces around it; blank lines are
    never boilerplate.  A boilerplate line stays in the document with the smallest id that
    holds it, so that an article which many sites carry survives once; all other documents
    lose it.

    Returns per input row: ``id_col long, n_lines long`` (lines, blank ones included; none
    for a null text), ``n_removed long, kept_sha256 string`` (of the remaining lines joined
    by line feeds) and, if asked for, ``kept_text``.  With ``whole_rows`` also ``row``, a struct
    of all columns of the input row.

    Method: a HyperLogLog sketch of the sites of each line hash merges by aggregation, map
    side first.  Lines whose estimate is clearly over the threshold are boilerplate; lines
    within five standard errors of it, one site at least, get an exact distinct count; the
    rest stay.  Lines travel as two 64-bit hashes, never as text, and the hash of a common
    line is counted before it shuffles.  Only documents that lose lines meet their line
    numbers again.

    Null sites count as no site.  Rows with a null id lose every boilerplate line.  Rows
    that share an id are treated alike, each by its own text.  An empty table gives no rows;
    other columns are carried, if asked for, and otherwise not read.
    """
    text = F.col(text_col).cast("string")
    texts = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        # Rows without an id meet their lost lines by their text, so they do not all meet in one place.
        F.when(F.col(id_col).isNull(), F.xxhash64(text)).otherwise(0).alias("salt"),
        text.alias("text"),
        F.col(site_col).cast("string").alias("site"),
        *([others(docs, text_col)] if whole_rows else []),
    )
    lines = (
        texts.select("doc_id", "salt", "site", F.explode(F.transform(F.split("text", "\n", -1), _hashes)).alias("line"))
        .select("doc_id", "salt", "site", "line.a", "line.b")
        .filter("a is not null")
    )
    boilerplate = _boilerplate(lines, min_sites)
    lost = (
        lines.select("doc_id", "salt", "a", "b").distinct().join(boilerplate, ["a", "b"])
        .filter("doc_id is null or doc_id > first").groupBy("doc_id", "salt").agg(F.collect_list(F.struct("a", "b")).alias("lost"))
    )
    lost = saved(lost.select(F.col("doc_id").alias("lost_id"), F.col("salt").alias("lost_salt"), "lost")).hint("merge")  # it grows with the documents
    split = F.split("text", "\n", -1)
    kept = F.filter(split, lambda line: ~F.array_contains(F.col("lost"), _hashes(line)) | _hashes(line)["a"].isNull())
    joined = texts.drop("site").join(lost, F.col("doc_id").eqNullSafe(F.col("lost_id")) & (F.col("salt") == F.col("lost_salt")), "left")
    n_lines = F.coalesce(F.size(F.when(F.col("text").isNotNull(), split)), F.lit(0))
    kept_lines = F.when(F.col("lost").isNull(), split).otherwise(kept)
    kept_text = F.when(F.col("lost").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    result = joined.select(
        F.col("doc_id").alias(id_col),
        F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(split) - F.size(kept_lines)).cast("long").alias("n_removed"),
        F.sha2(F.coalesce(kept_text, F.lit("")).cast("binary"), 256).alias("kept_sha256"),
        *([kept_text.alias("kept_text")] if with_text else []),
        *([whole(docs, text_col)] if whole_rows else []),
    )
    return result


def _hashes(line: Column) -> Column:
    """Two independent hashes of a line without the spaces around it, null for a blank one."""
    bare = F.trim(line)
    worded = bare != ""
    return F.struct(F.when(worded, F.xxhash64(bare)).alias("a"), F.when(worded, F.xxhash64(F.lit(1), bare)).alias("b"))


def _boilerplate(lines: DataFrame, min_sites: int) -> DataFrame:
    """Hashes of the lines on enough sites, and the smallest id that has each."""
    spread = saved(
        lines.groupBy("a", "b")
        .agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), F.min("doc_id").alias("first"), F.count("*").alias("n"))
        .filter(F.col("n") >= min_sites)
        .select("a", "b", "first", F.hll_sketch_estimate("sketch").alias("sites"))
    )
    margin = max(1.0, 5 * 1.04 / 2 ** (LG_K / 2) * min_sites)
    near = spread.filter(F.col("sites").between(min_sites - margin, min_sites + margin))
    exact = (
        lines.join(near.select("a", "b"), ["a", "b"], "left_semi").groupBy("a", "b", "site").agg(F.lit(1).alias("one"))
        .groupBy("a", "b").agg(F.count("site").alias("exact")).filter(F.col("exact") >= min_sites)
    )
    clear = spread.filter(F.col("sites") > min_sites + margin).select("a", "b", "first")
    return saved(clear.union(near.join(exact, ["a", "b"]).select("a", "b", "first")))
