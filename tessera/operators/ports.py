"""Sizes of planar faces, such as the ports of a channel: convex hulls, least widths and equivalent diameters.

Facets have ``facet_id``, vertex numbers ``v0, v1, v2`` and coordinates ``ax .. cz``; faces are ``facet_id, face_id``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.vectors import cross, minus, norm, vector

#: Turns and lengths up to so many units of rounding, times the size of the face, count as none.
ROUNDING = 128 * 2.0**-52


def hull(points: np.ndarray, slack: float = 0.0) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise from the lowest point by x, then y; turns up to ``slack`` count as straight."""
    ordered = np.unique(points, axis=0)
    if len(ordered) < 3:
        return ordered
    sides = []
    for run in (ordered, ordered[::-1]):
        side: list[np.ndarray] = []
        for p in run:
            while len(side) > 1:
                (ux, uy), (vx, vy) = side[-1] - side[-2], p - side[-2]
                if ux * vy - uy * vx > slack:
                    break
                side.pop()
            side.append(p)
        sides.append(side[:-1])
    return np.array(sides[0] + sides[1])


def least_width(corners: np.ndarray) -> float:
    """The least distance of two parallel lines that hold a convex polygon between them, by rotating calipers.

    One of them runs along an edge; the corner farthest from it is where edges turn past its opposite direction, found by bisection
    over the angles of all edges, so n corners take n log n steps.
    """
    along = np.roll(corners, -1, axis=0) - corners
    angles = np.unwrap(np.arctan2(along[:, 1], along[:, 0]))
    far = np.searchsorted(np.r_[angles, angles + 2 * np.pi], angles + np.pi) % len(corners)
    normal = np.c_[-along[:, 1], along[:, 0]] / np.hypot(*along.T)[:, None]
    n = len(corners)
    reach = [((corners[(far + step) % n] - corners) * normal).sum(axis=1) for step in (-1, 0, 1)]  # rounding of angles may miss by one
    return float(np.max(reach, axis=0).min())


def face_planes(facets: DataFrame, faces: DataFrame) -> DataFrame:
    """``face_id, facets, area``, the corner of the smallest number ``ox, oy, oz`` and the unit normal ``nx, ny, nz`` (null if degenerate) of each face; normals sum their facets' by area."""
    a, b, c = (vector(*(f"{p}{x}" for x in "xyz")) for p in "abc")
    normal = cross(minus(b, a), minus(c, a))
    corner = F.least(*(F.struct(F.col(f"v{i}").alias("id"), *(F.col(f"{p}{x}").alias(x) for x in "xyz")) for i, p in enumerate("abc")))
    sums = [F.sum(x).alias(f"s{i}") for i, x in zip("xyz", normal, strict=True)]
    summed = facets.join(faces, "facet_id").groupBy("face_id").agg(F.count("*").alias("facets"), F.sum(norm(normal) / 2).alias("area"), *sums, F.min(corner).alias("o"))
    size = norm(vector("sx", "sy", "sz"))
    return summed.select("face_id", "facets", "area", *(F.col(f"o.{x}").alias(f"o{x}") for x in "xyz"), *(F.when(size > 0, F.col(f"s{x}") / size).alias(f"n{x}") for x in "xyz"))


def in_plane(points: np.ndarray, normals: np.ndarray) -> np.ndarray:
    """Two coordinates of each point in the plane at right angles to its unit normal; the first axis is also at right angles to the axis that the normal leans to least, the first of equals."""
    u = np.cross(normals, np.eye(3)[np.abs(normals).argmin(axis=1)])
    u /= np.linalg.norm(u, axis=1)[:, None]
    v = np.cross(normals, u)
    v /= np.linalg.norm(v, axis=1)[:, None]
    return np.c_[(points * u).sum(axis=1), (points * v).sum(axis=1)]


def _hulls_of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        faces, *numbers = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(7))
        flat = in_plane(np.stack(numbers[:3], axis=1), np.stack(numbers[3:], axis=1))
        order = np.argsort(faces, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(faces[order]) != 0][: len(faces)])
        hulls = [(faces[part[0]], hull(flat[part])) for part in np.split(order, starts[1:]) if len(part)]
        if hulls:
            corners = np.concatenate([h for _, h in hulls])
            yield pa.RecordBatch.from_pydict({"face_id": np.repeat([f for f, _ in hulls], [len(h) for _, h in hulls]), "x": corners[:, 0], "y": corners[:, 1]})


def _measured(table: pa.Table) -> pa.Table:
    points = np.stack([table.column(c).to_numpy() for c in "xy"], axis=1)
    scale = float(np.ptp(points, axis=0).max())
    corners = hull(points, ROUNDING * scale * scale)
    width = least_width(corners) if len(corners) > 2 else None
    return pa.table({"face_id": table.column("face_id").slice(0, 1), "corners": pa.array([len(corners)], pa.int64()), "width": pa.array([width], pa.float64())})


def port_sizes(facets: DataFrame, faces: DataFrame) -> DataFrame:
    """``face_id, facets, area, diameter, corners, width`` of each planar face.

    ``diameter`` is that of a circle of the same area, ``corners`` counts those of the hull of the face's vertices in its plane and ``width`` is the
    hull's least width, null if the face is degenerate.  Vertices are taken relative to one of the face's own.  Faces without facets are left out; repeated
    rows count once in hulls and each time in areas; an empty table gives no rows.

    Hulls merge: every batch gives the hull of what it holds of a face, and only corners of these shuffle, so a face that has most facets
    sends little and its last task holds the hulls of batches, not its vertices.
    """
    planes = face_planes(facets, faces)
    corner = F.inline(F.array(*(F.struct(*(F.col(f"{p}{x}").alias(f"p{x}") for x in "xyz")) for p in "abc")))
    placed = facets.join(faces, "facet_id").select("face_id", corner).join(planes.filter("nx is not null"), "face_id")
    near = placed.select(F.col("face_id").cast("long"), *(F.col(f"p{x}") - F.col(f"o{x}") for x in "xyz"), "nx", "ny", "nz")
    parts = near.mapInArrow(_hulls_of_batches, "face_id long, x double, y double")
    sizes = parts.groupBy("face_id").applyInArrow(_measured, "face_id long, corners long, width double")
    diameter = 2 * F.sqrt(F.col("area") / F.lit(float(np.pi)))
    return planes.join(sizes, "face_id", "left").select("face_id", "facets", "area", diameter.alias("diameter"), F.coalesce("corners", F.lit(0)).cast("long").alias("corners"), "width")
