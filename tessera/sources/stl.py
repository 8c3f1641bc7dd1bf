"""Triangle meshes from binary and ASCII STL files, and back to text."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.plans.tables import saved

_COORDINATES = [v + axis for v in "abc" for axis in "xyz"]
FACETS = "path string, facet_id long, " + ", ".join(f"{c} double" for c in _COORDINATES)
_RECORD = np.dtype([("numbers", "<f4", 12), ("attribute", "<u2")])


#: Files over so many bytes are read in ranges of this size.
SPLIT_BYTES = 64 << 20
#: The header of a text file and the words after its facets are looked for in so many bytes at its ends.
MARGIN = 1 << 16


def read_stl(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Facets of all STL files under a path: ``path, facet_id, ax .. cz``; stored normals are not used.

    A file is binary if its length is 84 + 50 n for the count n it states.  Broken files raise:
    missing, empty or without facets, a bad count, non-finite coordinates, unknown words or text after the end.

    Files of up to ``split_bytes`` are read whole by Spark, from any store that it reads.  Larger ones are cut into ranges, a task for each: of a binary file
    whole records, of text the facets that begin in the range, whose numbers follow from the facets counted in earlier ranges.  These read
    their bytes through pyarrow's file systems, so the path has to be one that these know.
    """
    listed = spark.read.format("binaryFile").load(path)
    held = listed.select("path").count()
    if held < len(listed.inputFiles()):  # Spark passes over empty files
        raise ValueError(f"{path}: {len(listed.inputFiles()) - held} STL files are empty")
    small = listed.filter(F.col("length") <= split_bytes).select("path", "content").mapInPandas(_parse_all, FACETS)
    large = [(r.path, r.length) for r in listed.filter(F.col("length") > split_bytes).select("path", "length").collect()]  # a row for each large file
    if not large:
        return small
    ranges = [(file, *part) for file, length in large for part in plan_ranges(_opened(file), length, split_bytes, file)]
    # Each range is its own task; ranges are rows of five numbers, as many as there are splits to read.
    todo = spark.createDataFrame(ranges, "path string, binary boolean, first long, begin long, end long, stop long").repartition(len(ranges))
    found = todo.mapInPandas(_parse_ranges, FACETS + ", begin long")
    if all(r[1] for r in ranges):
        return small.unionByName(found.drop("begin"))
    found = saved(found)
    earlier = Window.partitionBy("path").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    counts = found.filter("facet_id < 0").groupBy("path", "begin").agg(F.count("*").alias("n")).withColumn("_before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    numbered = found.join(counts.drop("n"), ["path", "begin"], "left")
    return small.unionByName(numbered.withColumn("facet_id", F.when(F.col("facet_id") < 0, F.col("_before") - F.col("facet_id") - 1).otherwise(F.col("facet_id"))).drop("begin", "_before"))


Reader = Callable[[int, int], bytes]


def _opened(path: str) -> Reader:
    """Reads bytes by offset and size from a file of a store that pyarrow knows."""
    system, place = (fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")) if path.startswith("file:") else fs.FileSystem.from_uri(path)

    def read(offset: int, size: int) -> bytes:
        with system.open_input_file(place) as file:
            return file.read_at(size, offset)

    return read


def plan_ranges(read: Reader, length: int, split_bytes: int, path: str = "") -> list[tuple[bool, int, int, int, int]]:
    """The ranges of one file: whether it is binary, the number of the first facet (of the range, in a text), the first byte, the one after the last, and where facets end in the file."""
    head = read(0, min(length, MARGIN))
    count = int.from_bytes(head[80:84], "little") if length >= 84 else -1
    if length == 84 + 50 * count:
        step = max(split_bytes // 50, 1)
        return [(True, i, 84 + 50 * i, 84 + 50 * min(i + step, count), length) for i in range(0, count, step)]
    blank = len(head) - len(head.lstrip())
    if not head[blank : blank + 5].lower() == b"solid":
        raise ValueError(f"{path}: neither binary nor ASCII STL")
    begin = head.find(b"\n", blank)
    start = max(length - MARGIN, 0)
    tail = read(start, length - start).lower()
    ends = [m.start(1) for m in re.finditer(rb"(?:^|\s)(endsolid)(?=\s|$)", tail)]
    if begin < 0 or not ends:
        raise ValueError(f"{path}: endsolid is missing")
    if len(tail[ends[0] :].split()) > 2:
        raise ValueError(f"{path}: text after endsolid")
    end = start + ends[0]
    return [(False, i, b, min(b + split_bytes, end), end) for i, b in enumerate(range(begin, end, split_bytes))]


_FACET = re.compile(rb"(?<=\s)facet(?=\s)", re.IGNORECASE)


def parse_range(read: Reader, binary: bool, first: int, begin: int, end: int, stop: int, path: str = "") -> np.ndarray:
    """Corners (n, 3, 3) of the records of a binary range, or of the facets of a text that begin in the range."""
    if binary:
        corners = np.frombuffer(read(begin, end - begin), _RECORD)["numbers"][:, 3:].astype(float).reshape(-1, 3, 3)
    else:
        # The byte before the range tells whether a word begins at its start; the range ends where the next one's first facet begins.
        text, size = read(begin - 1, end - begin + 1), end - begin
        while not (following := _FACET.search(text, size + 1)) and begin - 1 + len(text) < stop:
            text += read(begin - 1 + len(text), min(4096, stop - begin + 1 - len(text)))
        text = text[: following.start()] if following else text
        head = _FACET.search(text)
        if not first and text[1 : head.start() if head else None].strip():
            raise ValueError(f"{path}: facet expected")
        if not first and not head and not following:
            raise ValueError(f"{path}: the file has no facets")
        corners = _corners_of_words(text[head.start() :].decode("ascii", "replace").lower().split(), path) if head else np.empty((0, 3, 3))
    if not np.isfinite(corners).all():
        raise ValueError(f"{path}: a coordinate is not finite")
    return corners


def _parse_ranges(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for row in frame.itertuples(index=False):
            corners = parse_range(_opened(row.path), row.binary, row.first, row.begin, row.end, row.stop, row.path)
            out = pd.DataFrame(corners.reshape(len(corners), 9), columns=_COORDINATES)
            # Facets of a text are numbered within their range here, as -1, -2, ..
            out.insert(0, "facet_id", row.first + np.arange(len(out)) if row.binary else -1 - np.arange(len(out)))
            out.insert(0, "path", row.path)
            out["begin"] = row.begin
            yield out


def _parse_all(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for path, content in zip(frame["path"], frame["content"], strict=True):
            corners = parse_stl(bytes(content), path)
            out = pd.DataFrame(corners.reshape(len(corners), 9), columns=_COORDINATES)
            out.insert(0, "facet_id", np.arange(len(out)))
            out.insert(0, "path", path)
            yield out


def parse_stl(content: bytes, path: str = "") -> np.ndarray:
    """Corners of the facets of one file: an array (n, 3, 3)."""
    count = int.from_bytes(content[80:84], "little") if len(content) >= 84 else -1
    if len(content) == 84 + 50 * count:
        corners = np.frombuffer(content, _RECORD, count, 84)["numbers"][:, 3:].astype(float).reshape(-1, 3, 3)
    else:
        corners = _from_text(content.decode("ascii", "replace"), path)
    if not len(corners):
        raise ValueError(f"{path}: the file has no facets")
    if not np.isfinite(corners).all():
        raise ValueError(f"{path}: a coordinate is not finite")
    return corners


def _from_text(text: str, path: str) -> np.ndarray:
    head, _, body = text.strip().partition("\n")
    if not head.lower().startswith("solid"):
        raise ValueError(f"{path}: neither binary nor ASCII STL")
    words = body.lower().split()
    if "endsolid" not in words:
        raise ValueError(f"{path}: endsolid is missing")
    end = words.index("endsolid")
    if len(words) - end > 2:
        raise ValueError(f"{path}: text after endsolid")
    return _corners_of_words(words[:end], path)


def _corners_of_words(words: list[str], path: str) -> np.ndarray:
    facets = np.array(words, dtype=object)
    if len(facets) % 21:
        raise ValueError(f"{path}: a facet is not complete")
    facets = facets.reshape(-1, 21)
    fixed = {0: "facet", 1: "normal", 5: "outer", 6: "loop", 7: "vertex", 11: "vertex", 15: "vertex", 19: "endloop", 20: "endfacet"}
    for place, word in fixed.items():
        if (facets[:, place] != word).any():
            raise ValueError(f"{path}: {word} expected")
    return facets[:, [8, 9, 10, 12, 13, 14, 16, 17, 18]].astype(float).reshape(-1, 3, 3)


def ascii_lines(facets: DataFrame) -> DataFrame:
    """The facets as blocks of ASCII STL, one row a facet: ``facet_id, block``; normals are written as 0."""
    corner = [F.format_string("vertex %s %s %s", *(F.col(v + axis).cast("string") for axis in "xyz")) for v in "abc"]
    return facets.select("facet_id", F.concat_ws("\n", F.lit("facet normal 0 0 0"), F.lit("outer loop"), *corner, F.lit("endloop"), F.lit("endfacet")).alias("block"))
