"""A sink for visualisation: cells as legacy VTK files, a piece for each stretch of a partition."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Cells of a piece at most; a task holds no more of them at a time.
PIECE_CELLS = 1 << 17
#: Corner offsets of a hexahedron and of a pixel in the file format's order, and the codes of these two and of a vertex (fixed values).
HEXAHEDRON = ((0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1))
PIXEL = ((0, 0, 0), (1, 0, 0), (0, 1, 0), (1, 1, 0))
CODES = {8: 12, 4: 8, 1: 1}


class VtkSource(DataSource):
    """``df.write.format("vtk").mode("append").option("path", folder).save()`` after ``spark.dataSource.register(VtkSource)``.

    Rows need ``x, y, z`` (the low corner) and, unless they are points, ``side``; the option
    ``cell`` is ``hexahedron`` (the default), ``pixel`` (flat squares) or ``vertex``.  Every
    other numeric column becomes a scalar field; further columns are refused.  The folder must be
    mounted at the same place for the driver and all executors.  Files appear under their names
    only when the whole job commits; an attempt that fails leaves none.
    """

    @classmethod
    def name(cls) -> str:
        return "vtk"

    def writer(self, schema: StructType, overwrite: bool) -> VtkWriter:
        cell = self.options.get("cell", "hexahedron")
        corners = {"hexahedron": HEXAHEDRON, "pixel": PIXEL, "vertex": ((0, 0, 0),)}[cell]
        needed = ("x", "y", "z") + (("side",) if cell != "vertex" else ())
        if missing := [c for c in needed if c not in schema.names]:
            raise ValueError(f"cells lack {missing}")
        fields = [f for f in schema.fields if f.name not in needed]
        if other := [f.name for f in fields if f.dataType.typeName() not in ("double", "float", "long", "integer", "short", "byte")]:
            raise ValueError(f"not numeric: {other}")
        if overwrite:
            raise ValueError("write to a new folder, in append mode")
        return VtkWriter(self.options["path"], corners, [f.name for f in fields])


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


class VtkWriter(DataSourceArrowWriter):
    def __init__(self, path: str, corners: tuple[tuple[int, int, int], ...], fields: list[str]) -> None:
        self.path, self.corners, self.fields = path, corners, fields

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        os.makedirs(self.path, exist_ok=True)
        task = TaskContext.get()
        names: list[str] = []
        for piece in _pieces(iterator):
            names.append(f"part-{task.partitionId():05d}-{len(names):05d}-{task.taskAttemptId()}.vtk")
            with open(self._hidden(names[-1]), "wb") as f:
                f.write(cell_file(piece, self.corners, self.fields))
        return _Written(names)

    def _hidden(self, name: str) -> str:
        return os.path.join(self.path, f".{name}.unfinished")

    def commit(self, messages: list[_Written | None]) -> None:
        for name in (n for m in messages if m for n in m.names):
            os.replace(self._hidden(name), os.path.join(self.path, name))

    def abort(self, messages: list[_Written | None]) -> None:
        for name in (n for m in messages if m for n in m.names):
            os.remove(self._hidden(name))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, rows = [], 0
    for batch in batches:
        if rows + batch.num_rows > PIECE_CELLS and held:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
        held.append(batch)
        rows += batch.num_rows
    if rows:
        yield pa.Table.from_batches(held)


def cell_file(cells: pa.Table, corners: tuple[tuple[int, int, int], ...], fields: list[str]) -> bytes:
    """An unstructured grid in the binary form of the legacy format; a null value of a field is not a number."""
    n, k = cells.num_rows, len(corners)
    side = cells.column("side").to_numpy() if k > 1 else np.zeros(n)
    low = np.stack([cells.column(c).to_numpy() for c in "xyz"], 1)
    points = low[:, None, :] + np.array(corners)[None] * side[:, None, None]
    at = np.column_stack([np.full(n, k), np.arange(n * k).reshape(n, k)])
    parts = [f"# vtk DataFile Version 3.0\ncells\nBINARY\nDATASET UNSTRUCTURED_GRID\nPOINTS {n * k} double\n".encode(), points.astype(">f8").tobytes()]
    parts += [f"\nCELLS {n} {n * (k + 1)}\n".encode(), at.astype(">i4").tobytes(), f"\nCELL_TYPES {n}\n".encode(), np.full(n, CODES[k], ">i4").tobytes()]
    parts.append(f"\nCELL_DATA {n}\n".encode())
    for name in fields:
        values = cells.column(name).to_pandas().astype("float64").to_numpy()
        parts += [f"SCALARS {'_'.join(name.split())} double 1\nLOOKUP_TABLE default\n".encode(), values.astype(">f8").tobytes(), b"\n"]
    return b"".join(parts)
