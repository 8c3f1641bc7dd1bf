"""Shapes with a side of flow: inside a shape or around it within an open box, their algebra, domains, translation and checks.

All rules are checked when a flow is built, before any plan is.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from math import ceil, inf

from pyspark.sql import Column, DataFrame, SparkSession

from tessera.functions.vectors import Vector
from tessera.operators.shapes import Ball, Box, Complement, Cylinder, Merged, Shape, grid

Corner = tuple[float, ...]


@dataclass(frozen=True)
class Flow:
    """``wet`` is the region of the fluid, ``low`` and ``high`` bound the shapes, ``open_box`` the fluid around them; without one the flow is internal."""

    wet: Shape
    low: Corner
    high: Corner
    open_box: tuple[Corner, Corner] | None = None

    @property
    def internal(self) -> bool:
        return self.open_box is None

    @property
    def domain(self) -> tuple[Corner, Corner]:
        """The bounds of an internal flow, the open box of an external one."""
        return self.open_box or (self.low, self.high)

    def location(self, p: Vector) -> Column:
        """Wet, surface or dry."""
        return self.wet.location(p)

    def __or__(self, other: Flow) -> Flow:
        if not (self.internal and other.internal):
            raise ValueError("a union needs two internal flows")
        return Flow(self.wet | other.wet, *_around(self, other))

    def __and__(self, other: Flow) -> Flow:
        if self.internal or other.internal:
            kept = self if self.internal else other  # the domain of the left one, if both are internal
            return Flow(self.wet & other.wet, kept.low, kept.high)
        if self.open_box != other.open_box:
            raise ValueError("an intersection of external flows needs identical open boxes")
        return Flow(self.wet & other.wet, *_around(self, other), self.open_box)

    def __sub__(self, other: Flow) -> Flow:
        if not (self.internal and other.internal):
            raise ValueError("a difference needs two internal flows")
        return Flow(self.wet - other.wet, self.low, self.high)

    def translated(self, target: Sequence[float] | None = None) -> Flow:
        """Moved so that the low corner of an internal flow comes to the target, which it needs, or that of an external flow's open box to 0."""
        if self.internal == (target is None):
            raise ValueError("an internal flow moves to a target" if self.internal else "an external flow takes no target")
        to, start = (target, self.low) if self.internal else ((0.0,) * len(self.low), self.open_box[0])
        by = tuple(float(t) - s for t, s in zip(to, start, strict=True))
        moved = lambda corner: tuple(x + d for x, d in zip(corner, by, strict=True))
        return Flow(_moved(self.wet, by), moved(self.low), moved(self.high), self.open_box and tuple(map(moved, self.open_box)))

    def counts(self, h: float) -> Corner:
        """Cells of width h on each axis of the domain; no valid width or domain, and more cells than 63 bits number, raise."""
        if not 0 < h < inf:
            raise ValueError("the width of cells has to be finite and positive")
        low, high = self.domain
        widths = [b - a for a, b in zip(low, high, strict=True)]
        if not all(-inf < x < inf for x in (*low, *high)) or not all(w > 0 for w in widths):
            raise ValueError("the domain has to be finite and to have positive sides")
        found, cells = tuple(ceil(w / h) if w / h < 2**63 else 2**63 for w in widths), 1
        for n in found:
            cells *= n
        if cells >= 2**63:
            raise OverflowError("the domain has too many cells")
        return found

    def cells(self, spark: SparkSession, h: float) -> DataFrame:
        """The grid over the domain, three axes: see ``shapes.grid``."""
        return grid(spark, self.domain[0], self.counts(h), h)


def internal(shape: Shape) -> Flow:
    """Flow inside a primitive."""
    return Flow(shape, *_checked(*bounds(shape), "dimensions of a shape"))


def external(shape: Shape, open_low: Sequence[float], open_high: Sequence[float]) -> Flow:
    """Flow around a primitive, within an open box that contains it."""
    low, high = _checked(*bounds(shape), "dimensions of a shape")
    box = _checked(tuple(map(float, open_low)), tuple(map(float, open_high)), "dimensions of an open box")
    if not all(a <= x and y <= b for a, b, x, y in zip(*box, low, high, strict=True)):
        raise ValueError("an open box has to contain its shape")
    return Flow(Complement(shape), low, high, box)


def bounds(shape: Shape) -> tuple[Corner, Corner]:
    """The corners around a primitive."""
    if isinstance(shape, Box):
        return tuple(map(float, shape.low)), tuple(map(float, shape.high))
    if isinstance(shape, Ball):
        return tuple(x - shape.radius for x in shape.centre), tuple(x + shape.radius for x in shape.centre)
    if isinstance(shape, Cylinder):
        flat = [(x - shape.radius, x + shape.radius) for x in shape.centre]
        flat.insert(shape.axis, (float(shape.low), float(shape.high)))
        return tuple(a for a, _ in flat), tuple(b for _, b in flat)
    raise TypeError("only primitives have bounds of their own")


def _checked(low: Corner, high: Corner, what: str) -> tuple[Corner, Corner]:
    if not all(-inf < a < b < inf for a, b in zip(low, high, strict=True)):
        raise ValueError(f"{what} have to be finite and positive")
    return low, high


def _around(a: Flow, b: Flow) -> tuple[Corner, Corner]:
    return tuple(map(min, a.low, b.low)), tuple(map(max, a.high, b.high))


def _moved(shape: Shape, by: Corner) -> Shape:
    plus = lambda corner, d: tuple(x + y for x, y in zip(corner, d, strict=True))
    if isinstance(shape, Merged):
        return Merged(_moved(shape.a, by), _moved(shape.b, by), shape.unite)
    if isinstance(shape, Complement):
        return Complement(_moved(shape.a, by))
    if isinstance(shape, Box):
        return Box(plus(shape.low, by), plus(shape.high, by))
    if isinstance(shape, Ball):
        return Ball(plus(shape.centre, by), shape.radius)
    if isinstance(shape, Cylinder):
        flat = tuple(d for i, d in enumerate(by) if i != shape.axis)
        return replace(shape, centre=plus(shape.centre, flat), low=shape.low + by[shape.axis], high=shape.high + by[shape.axis])
    raise TypeError(f"{type(shape).__name__} cannot be moved")
