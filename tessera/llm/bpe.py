"""BPE encoding and decoding of documents in batched numpy merge rounds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _words as W
from tessera.llm._bpe import word_model


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Encodes whole texts with a word-level BPE vocabulary and decodes the ids again.

    Returns per input row: ``id_col long, n_tokens long, ids_sha256 string`` (of the ids as
    little-endian unsigned 32-bit integers), ``decoded_sha256 string`` (of the decoded text
    in UTF-8) and, if asked for, ``ids array<int>`` and ``decoded string``.

    The vocabulary's words end in a suffix; texts become normal form C and lower case, and
    white space only separates words.  Special tokens that a text spells out get their ids.
    No token is added.  Decoding joins the tokens' own spellings by a space.

    Method: the distinct words of a slice of texts lie in one flat array of symbols.  Each
    round looks up the pairs that changed among the sorted pair keys by binary search and
    merges the lowest-ranked pair of every word.  Rows stay where they are: there is no
    shuffle.  A slice holds a few megabytes of text, or one text.

    Null and empty texts have no tokens and decode to the empty text.  An empty table gives
    no rows; other columns are not read.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return texts.mapInArrow(lambda batches: _encode(batches, model_path, with_ids), schema).withColumnRenamed("doc_id", id_col)


def _encode(batches: Iterator[pa.RecordBatch], model_path: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    model = word_model(model_path)
    for batch in batches:
        for part in W.slices(batch):
            ids, at = model.encode(part.column("text").to_pylist())
            text, text_at = model.decode(ids, at)
            raw, spelled = memoryview(ids.astype("<u4")), memoryview(text)
            spans = list(zip(text_at[:-1], np.maximum(text_at[:-1], text_at[1:] - 1), strict=True))
            columns = {
                "doc_id": part.column("doc_id"),
                "n_tokens": np.diff(at),
                "ids_sha256": pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(spelled[a:b]).hexdigest() for a, b in spans], pa.string()),
            }
            if with_ids:
                columns["ids"] = W.lists(at, pa.array(ids.astype(np.int32)))
                columns["decoded"] = pa.array([bytes(spelled[a:b]).decode() for a, b in spans], pa.string())
            yield pa.RecordBatch.from_pydict(columns)
