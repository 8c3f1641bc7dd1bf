"""Best-fit packing of token sequences, planned on counts of lengths."""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import _words as W
from tessera.plans.tables import saved

#: Split pattern and special token of the byte-level vocabulary (fixed values).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = "<|endoftext|>"
#: White space of that pattern. Its engine gives up on runs of some hundred thousand, so runs of this length are cut by hand.
_SPACE = "\\t-\\r \\x85\\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LONG_RUN = re.compile(f"[{_SPACE}]{{65536,}}")


def pack_documents(
    docs: DataFrame,
    ranks_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 1024,
    end_id: int = 2,
    with_ids: bool = True,
) -> DataFrame:
    """Packs documents into as few sequences of at most ``capacity`` tokens as best fit finds.

    A document is its token ids and then ``end_id``.  Only longer ones are cut, into pieces
    of ``capacity``; the first piece takes what is left over and so may be shorter.  Returns
    per piece: ``id_col long, piece int`` (from 0), ``start long`` (ids of its document
    before it), ``length long``, ``ids_crc32 long`` (unsigned, over little-endian unsigned
    32-bit ids), ``sequence_id long``, ``offset long`` (its place there, gapless from 0) and,
    if asked for, ``ids array<int>``.

    Method: only a histogram of piece lengths, at most ``capacity`` rows, reaches the
    driver.  Best fit by falling length runs on these counts and gives slots: a length, a
    range of ranks, and where they go.  Their number depends on ``capacity`` alone, so the
    plan is broadcast.  A piece finds its slot by its rank within its length; ranks come
    from a running number within each task and a prefix sum of counts over tasks, so no
    length, however common, meets in one task.

    A text is held whole, with its ids, and takes time in proportion to its length, also one of blanks or
    letters alone.  Null and empty texts are one piece that holds ``end_id``.  Ids need not be unique or
    non-null.  An empty table gives no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "part long, local_rank long, doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    pieces = saved(texts.mapInArrow(lambda batches: _pieces(batches, ranks_path, capacity, end_id, with_ids), schema))

    counts = saved(pieces.groupBy("part", "length").agg(F.count("*").alias("n")))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}

    slots = docs.sparkSession.createDataFrame(plan_slots(histogram, capacity), "length long, low long, high long, sequence long, offset long")
    ranked = pieces.join(saved(bases), ["part", "length"]).withColumn("rank", F.col("base") + F.col("local_rank"))
    p, s = ranked.alias("p"), F.broadcast(slots).alias("s")
    placed = p.join(s, (F.col("p.length") == F.col("s.length")) & (F.col("p.rank") >= F.col("s.low")) & (F.col("p.rank") < F.col("s.high")))
    return placed.select(
        F.col("p.doc_id").alias(id_col),
        "p.piece",
        "p.start",
        "p.length",
        "p.ids_crc32",
        (F.col("s.sequence") + F.col("p.rank") - F.col("s.low")).alias("sequence_id"),
        "s.offset",
        *(["p.ids"] if with_ids else []),
    )


def plan_slots(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit over counts: rows (length, low rank, high rank, first sequence, offset).

    Pieces of one length with ranks low <= r < high go to sequences first + r - low at that
    offset.  Open sequences with equal room form runs of consecutive numbers; a step serves
    a whole run at once, so the steps depend on the capacity and not on the counts.
    """
    slots: list[tuple[int, int, int, int, int]] = []
    runs: dict[int, list[tuple[int, int]]] = {}  # room left -> (first sequence, how many)
    opened = 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        rooms = sorted(r for r in runs if r >= length)
        while left:
            if rooms:
                room = rooms[0]
                first, size = runs[room].pop()
                if not runs[room]:
                    del runs[room]
                    rooms.pop(0)
            else:
                room, first, size = capacity, opened, -(-left // (capacity // length))
                opened += size
            each = room // length
            full = min(size, left // each)
            for sequences, fill in ((full, each), (min(1, size - full), left - full * each if full < size else 0)):
                if not sequences:
                    continue
                for k in range(fill):
                    slots.append((length, rank, rank + sequences, first, capacity - room + k * length))
                    rank += sequences
                left -= sequences * fill
                if room - fill * length:
                    runs.setdefault(room - fill * length, []).append((first, sequences))
                first, size = first + sequences, size - sequences
            if size > 0:
                runs.setdefault(room, []).append((first, size))
                break
    return slots


@lru_cache(maxsize=4)
def encoding(ranks_path: str):
    """The byte-level vocabulary of a .tiktoken file of ranks, with its special token after them."""
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})


def token_ids(model, text: str) -> np.ndarray:
    """The ids of a text, whatever it holds.

    The pattern takes a run of white space but for its last character as one piece; what follows takes that one, unless nothing does or the special token.
    """
    found, at = [], 0
    for run in _LONG_RUN.finditer(text):
        end = run.end() - (run.end() < len(text) and not text.startswith(SPECIAL, run.end()))
        found += [model.encode_to_numpy(text[at : run.start()], allowed_special="all"), np.array(model._encode_single_piece(run.group()[: end - run.start()]), np.uint32)]
        at = end
    found.append(model.encode_to_numpy(text[at:], allowed_special="all"))
    return np.concatenate(found).astype(np.uint32)


def _pieces(batches: Iterator[pa.RecordBatch], ranks_path: str, capacity: int, end_id: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    model, part = encoding(ranks_path), TaskContext.get().partitionId()
    seen = np.zeros(capacity + 1, np.int64)
    for batch in batches:
        for some in W.slices(batch):
            rows: list[tuple] = []
            for doc_id, text in zip(some.column("doc_id").to_pylist(), some.column("text").to_pylist(), strict=True):
                ids = np.append(token_ids(model, text or ""), np.uint32(end_id)).astype("<u4")
                head = len(ids) % capacity
                cuts = [0, *range(head or capacity, len(ids) + 1, capacity)] if len(ids) > capacity else [0, len(ids)]
                for piece, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    rows.append((seen[b - a], doc_id, piece, a, b - a, zlib.crc32(ids[a:b]), ids[a:b]))
                    seen[b - a] += 1
            rank, doc, piece, start, length, crc, ids = zip(*rows, strict=True)
            columns = {
                "part": pa.array(np.full(len(rank), part)), "local_rank": pa.array(rank, pa.int64()), "doc_id": pa.array(doc, pa.int64()), "piece": pa.array(piece, pa.int32()),
                "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
            }
            if with_ids:
                columns["ids"] = W.lists(np.r_[0, np.cumsum(length)], pa.array(np.concatenate(ids).astype(np.int32)))
            yield pa.RecordBatch.from_pydict(columns)
