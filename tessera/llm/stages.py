"""Operators as pipeline stages: documents in, documents out.

Every stage works on rows, not on ids: rows that share an id, or have none, each keep or lose
their own text.  Documents come and go with all their columns, whatever these are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.line_dedup import remove_boilerplate
from tessera.llm.near_dedup import near_duplicates
from tessera.llm.packing import pack_documents
from tessera.llm.quality import quality
from tessera.llm.substring_dedup import remove_repeats
from tessera.llm.vocabularies import vocabulary

#: Bytes of text of a batch of the quality rules, which carry whole rows here.
BATCH_BYTES = 12 << 20


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that the quality rules reject.

    Null, empty and short texts go, as they have fewer than 50 words.  Scores on the edge of a
    band stay.  Repeated rows are judged alike.  An empty table stays empty.
    """
    return quality(docs, whole_rows=True, batch_bytes=BATCH_BYTES).filter("kept").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines that ten sites or more have; n_chars follows the text.

    No row goes.  Null texts stay null.  The smallest id that has such a line keeps it, in all
    rows of that id; rows with a null id lose it.  An empty table stays empty.
    """
    return _with_new_text(remove_boilerplate(docs, whole_rows=True), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies (five-word shingles, similarity of 0.8 or more).

    That is the row with the smallest id, nulls last; of several such rows, as of rows that
    repeat, one stays.  Null, empty and blank texts all stay.  An empty table stays empty.
    """
    return near_duplicates(docs, whole_rows=True).filter("leader").select("row.*")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 words and more that a document with a smaller id has; n_chars follows the text.

    No row goes.  Null texts stay null.  Rows that share an id cut nothing from each other; a
    null id counts as the largest.  An empty table stays empty.
    """
    return _with_new_text(remove_repeats(docs, whole_rows=True), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' token ids into sequences of 1024; returns a row for each piece.

    Null and empty texts are a piece that holds the end token.  Every row is packed, repeated
    ones and those without an id too.  An empty table stays empty.
    """
    return pack_documents(docs, vocabulary("byte_bpe_50k.tiktoken"))


def _with_new_text(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows with ``kept_text`` in place of the text where words or lines were removed."""
    changed = F.col("n_removed") > 0
    new = {"text": F.col("kept_text")} | ({"n_chars": F.char_length("kept_text").cast("long")} if "n_chars" in docs.columns else {})
    return found.select(*(F.when(changed, new[c]).otherwise(F.col(f"row.`{c}`")).alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
