"""Token counts of the sections of documents, from one encoding of the whole text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _words as W
from tessera.llm.packing import encoding, token_ids


def section_tokens(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", separator: str = "\n") -> DataFrame:
    """Counts the tokens of every section of every document.

    A section is a piece of the text that ends with ``separator`` (which belongs to it) or
    with the text.  Returns per section: ``id_col long, section int`` (from 0), ``start
    long, length long`` (code points), ``n_tokens long, n_shared long`` (tokens among them
    that cross a border of sections).

    Method: a document is encoded once, as a whole, so its sections' tokens add up to the
    tokens of the document.  Token spans in bytes follow from the lengths of the tokens, and
    character spans from the starts of code points; a token that holds part of a character
    spans the whole character.  Spans join the sections by interval, within each slice of
    documents.  Rule for tokens over a border: the section with the largest share of the
    span gets the token, the first one on ties.

    A text is held whole, with its ids and spans, and takes time in proportion to its length, also one of
    blanks alone.  The text goes through a byte-level BPE vocabulary; special tokens it spells out count as
    one token.  Null and empty texts have no sections and no rows.  Rows that share an id
    each give their own sections.  An empty table gives no rows; other columns are not read.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, section int, start long, length long, n_tokens long, n_shared long"
    return texts.mapInArrow(lambda batches: _count(batches, ranks_path, separator), schema).withColumnRenamed("doc_id", id_col)


def token_spans(model, texts: list[str | None], data: np.ndarray, text_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last character (exclusive) of all tokens, counted over the texts in a row, and the token ids."""
    ids = [token_ids(model, t or "") for t in texts]
    ids = np.concatenate(ids).astype(np.int64) if ids else np.empty(0, np.int64)
    end = np.cumsum(_lengths(model)[ids])
    start = end - _lengths(model)[ids]
    character = np.cumsum((data & 0xC0) != 0x80)  # of each byte, from 1
    return character[start] - 1, character[end - 1], ids


def _lengths(model) -> np.ndarray:
    if not hasattr(model, "token_lengths"):
        lengths = np.zeros(model.max_token_value + 1, np.int64)
        for i in range(model.max_token_value + 1):
            lengths[i] = len(model.decode_single_token_bytes(i))
        model.token_lengths = lengths
    return model.token_lengths


def share_out(first: np.ndarray, last: np.ndarray, section_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The section of each span by the largest overlap, the first on ties, and whether the span crosses a border.

    ``section_at`` has the start of each section and the end of the last one.
    """
    low = np.searchsorted(section_at, first, "right") - 1
    high = np.searchsorted(section_at, last - 1, "right") - 1
    chosen = low.copy()
    most = np.minimum(last, section_at[low + 1]) - first
    crossing = np.flatnonzero(high > low)
    for step in range(1, int((high - low).max(initial=0)) + 1):
        crossing = crossing[high[crossing] >= low[crossing] + step]
        at = low[crossing] + step
        part = np.minimum(last[crossing], section_at[at + 1]) - section_at[at]
        more = part > most[crossing]
        chosen[crossing[more]], most[crossing[more]] = at[more], part[more]
    return chosen, high > low


def _count(batches: Iterator[pa.RecordBatch], ranks_path: str, separator: str) -> Iterator[pa.RecordBatch]:
    model = encoding(ranks_path)
    for batch in batches:
        for part in W.slices(batch):
            texts = part.column("text").to_pylist()
            first, last, _ = token_spans(model, texts, *W.text_bytes(part.column("text")))
            pieces = [t.split(separator) if t else [] for t in texts]
            width = len(separator)
            sizes = [len(p) + (width if i + 1 < len(ps) else 0) for ps in pieces for i, p in enumerate(ps)]
            numbers = [i for ps in pieces for i in range(len(ps))]
            owner = np.repeat(np.arange(len(texts)), [len(ps) for ps in pieces])
            filled = np.array(sizes, np.int64) > 0  # no section follows a separator that ends the text
            sizes, numbers, owner = np.array(sizes, np.int64)[filled], np.array(numbers, np.int32)[filled], owner[filled]
            at = np.r_[0, np.cumsum(sizes)]
            text_start = np.r_[0, np.cumsum([len(t or "") for t in texts])][owner]
            section, crosses = share_out(first, last, at)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": part.column("doc_id").take(pa.array(owner)),
                    "section": numbers,
                    "start": at[:-1] - text_start,
                    "length": sizes,
                    "n_tokens": np.bincount(section, minlength=len(sizes)).astype(np.int64),
                    "n_shared": np.bincount(section[crosses], minlength=len(sizes)).astype(np.int64),
                }
            )
