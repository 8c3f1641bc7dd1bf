"""Primitive shapes, their cell rules and wall links, and Boolean algebra, as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.vectors import Vector, dot, link_roots, literal, minus, norm, vector

DRY, BOUNDARY, INTERIOR = 0, 1, 2


class Shape:
    """A region bounded by faces that are numbered from 0; a merged shape numbers those of its second part after those of its first.

    ``level`` is negative inside, 0 on the surface and positive outside.
    """

    n_faces: int

    def level(self, p: Vector) -> Column:
        raise NotImplementedError

    def parts(self, base: int = 0) -> list[tuple[int, Primitive]]:
        """The primitives, each with the number of its first face."""
        raise NotImplementedError

    def merged_type(self, types: dict[int, Column], base: int = 0) -> Column:
        """A cell's type, given its types for the primitives by the number of their first face."""
        raise NotImplementedError

    def cell_type(self, p: Vector, h: float) -> Column:
        """Dry, boundary or interior for the cell about p with reach h."""
        return self.merged_type({base: part.cell_type(p, h) for base, part in self.parts()})

    def members(self, p: Vector, h: float) -> list[Column]:
        """For each face: whether the cell is a boundary cell of it."""
        raise NotImplementedError

    def crossings(self, p: Vector, e: Vector) -> list[tuple[int, Column]]:
        """Faces with each t in (0, 1] at which p + t e may be on them, null where it is not; hidden ones too."""
        raise NotImplementedError

    def side(self, p: Vector, forced: Callable[[int, int], Column], base: int) -> Column:
        """-1, 0 or 1 for a point inside, on the surface or outside; 0 for a primitive with a forced face of base, base + 1, ..."""
        raise NotImplementedError

    def exposures(self, p: Vector, forced: Callable[[int, int], Column], base: int) -> list[tuple[int, Column]]:
        """For each primitive, the end of its range of faces and whether its faces are exposed at p: every shape that it is part of has p on its surface."""
        raise NotImplementedError

    def first_hit(self, p: Vector, e: Vector, crossed: list[tuple[int, Column]], types: dict[int, Column], base: int = 0) -> Column:
        """The nearest hit as (q, face) of a link from a boundary cell, from all its crossings; ties go to the lower face, null without one."""
        raise NotImplementedError

    def __or__(self, other: Shape) -> Shape:
        return Merged(self, other, unite=True)

    def __and__(self, other: Shape) -> Shape:
        return Merged(self, other, unite=False)

    def __invert__(self) -> Shape:
        return Complement(self)

    def __sub__(self, other: Shape) -> Shape:
        return self & ~other

    def location(self, p: Vector) -> Column:
        return F.when(self.level(p) < 0, "wet").when(self.level(p) == 0, "surface").otherwise("dry")

    def faces(self, p: Vector, h: float) -> Column:
        """Ids of the faces that a boundary cell belongs to; empty for other cells."""
        return F.array_compact(F.array(*(F.when(m, F.lit(i)) for i, m in enumerate(self.members(p, h)))))


def _hits(crossed: list[tuple[int, Column]]) -> list[Column]:
    """Crossings as (q, face), null where there is none; the least of them is the nearest."""
    return [F.when(q.isNotNull(), F.struct(q.alias("q"), F.lit(face).alias("face"))) for face, q in crossed]


def _least(columns: list[Column]) -> Column:
    return F.least(*columns) if len(columns) > 1 else columns[0]


class Primitive(Shape):
    """A shape with its own surface: ``touched`` tells for each face whether the closed box p +- h meets it."""

    def touched(self, p: Vector, h: float) -> list[Column]:
        raise NotImplementedError

    def cell_type(self, p: Vector, h: float) -> Column:
        """Dry unless strictly inside; then boundary if the closed box p +- h meets a face, else interior."""
        meets = reduce(Column.__or__, self.touched(p, h))
        return F.when(self.level(p) >= 0, DRY).when(meets, BOUNDARY).otherwise(INTERIOR)

    def parts(self, base: int = 0) -> list[tuple[int, Primitive]]:
        return [(base, self)]

    def merged_type(self, types: dict[int, Column], base: int = 0) -> Column:
        return types[base]

    def members(self, p: Vector, h: float) -> list[Column]:
        inside = self.level(p) < 0
        return [inside & t for t in self.touched(p, h)]

    def side(self, p: Vector, forced: Callable[[int, int], Column], base: int) -> Column:
        return F.when(forced(base, base + self.n_faces), 0.0).otherwise(F.signum(self.level(p)))

    def exposures(self, p: Vector, forced: Callable[[int, int], Column], base: int) -> list[tuple[int, Column]]:
        return [(base + self.n_faces, F.lit(True))]

    def first_hit(self, p: Vector, e: Vector, crossed: list[tuple[int, Column]], types: dict[int, Column], base: int = 0) -> Column:
        own = [(face, q) for face, q in crossed if base <= face < base + self.n_faces]
        return F.when(types[base] == BOUNDARY, _least(_hits(own)))


@dataclass
class Complement(Primitive):
    """All that is outside a primitive; its faces stay as they are."""

    a: Primitive

    @property
    def n_faces(self) -> int:
        return self.a.n_faces

    def __invert__(self) -> Shape:
        return self.a

    def level(self, p: Vector) -> Column:
        return -self.a.level(p)

    def touched(self, p: Vector, h: float) -> list[Column]:
        return self.a.touched(p, h)

    def crossings(self, p: Vector, e: Vector) -> list[tuple[int, Column]]:
        return self.a.crossings(p, e)


@dataclass
class Merged(Shape):
    """Union or intersection of two shapes on one grid.

    A cell is what the better (union) or worse (intersection) of the two makes of it.  A boundary cell
    belongs to the faces that it belongs to in either.  Its links keep the nearest hit of the two; only
    where a union's cell is at the boundary of both may the nearest hit be hidden inside the other, so
    there it is the nearest one that is on the surface of the whole.
    """

    a: Shape
    b: Shape
    unite: bool

    @property
    def n_faces(self) -> int:
        return self.a.n_faces + self.b.n_faces

    def __invert__(self) -> Shape:
        return Merged(~self.a, ~self.b, not self.unite)

    def level(self, p: Vector) -> Column:
        return (F.least if self.unite else F.greatest)(self.a.level(p), self.b.level(p))

    def parts(self, base: int = 0) -> list[tuple[int, Primitive]]:
        return self.a.parts(base) + self.b.parts(base + self.a.n_faces)

    def merged_type(self, types: dict[int, Column], base: int = 0) -> Column:
        return (F.greatest if self.unite else F.least)(self.a.merged_type(types, base), self.b.merged_type(types, base + self.a.n_faces))

    def members(self, p: Vector, h: float) -> list[Column]:
        here = self.cell_type(p, h) == BOUNDARY
        return [here & m for m in self.a.members(p, h) + self.b.members(p, h)]

    def crossings(self, p: Vector, e: Vector) -> list[tuple[int, Column]]:
        return self.a.crossings(p, e) + [(self.a.n_faces + face, q) for face, q in self.b.crossings(p, e)]

    def side(self, p: Vector, forced: Callable[[int, int], Column], base: int) -> Column:
        sides = self.a.side(p, forced, base), self.b.side(p, forced, base + self.a.n_faces)
        return (F.least if self.unite else F.greatest)(*sides)

    def exposures(self, p: Vector, forced: Callable[[int, int], Column], base: int) -> list[tuple[int, Column]]:
        on = self.side(p, forced, base) == 0
        return [(end, on & shown) for end, shown in self.a.exposures(p, forced, base) + self.b.exposures(p, forced, base + self.a.n_faces)]

    def _first_exposed(self, p: Vector, e: Vector, crossings: list[tuple[int, Column]], base: int) -> Column:
        """Of the crossings of this shape's own faces, the nearest that is on its surface; those at one place count together."""
        crossed = F.array_compact(F.array(*_hits(crossings)))

        def shown(hit: Column) -> Column:
            q, face = hit["q"], hit["face"]
            at = tuple(x + q * y for x, y in zip(p, e, strict=True))
            forced = lambda low, high: F.exists(crossed, lambda other: (other["q"] == q) & (other["face"] >= low) & (other["face"] < high))
            on = F.lit(False)
            for end, exposed in reversed(self.exposures(at, forced, base)):
                on = F.when(face < end, exposed).otherwise(on)
            return (face >= base) & on

        return F.array_min(F.filter(crossed, shown))

    def first_hit(self, p: Vector, e: Vector, crossed: list[tuple[int, Column]], types: dict[int, Column], base: int = 0) -> Column:
        ends = [(self.a, base), (self.b, base + self.a.n_faces)]
        hit = F.least(*(part.first_hit(p, e, crossed, types, at) for part, at in ends))
        if self.unite:
            first, second = (part.merged_type(types, at) == BOUNDARY for part, at in ends)
            hit = F.when(first & second, self._first_exposed(p, e, crossed, base)).otherwise(hit)
        return F.when(self.merged_type(types, base) == BOUNDARY, hit)


@dataclass
class Box(Primitive):
    """An axis-parallel box with the low and high side of each axis in turn as faces, or a rectangle with its bottom, right, top and left."""

    low: tuple[float, ...]
    high: tuple[float, ...]

    @property
    def n_faces(self) -> int:
        return 2 * len(self.low)

    def _sides(self) -> list[tuple[int, float]]:
        """Axis and coordinate of each face."""
        if len(self.low) == 2:
            return [(1, self.low[1]), (0, self.high[0]), (1, self.high[1]), (0, self.low[0])]
        return [(axis, side) for axis in range(len(self.low)) for side in (self.low[axis], self.high[axis])]

    def level(self, p: Vector) -> Column:
        return F.greatest(*(F.greatest(F.lit(lo) - x, x - F.lit(hi)) for x, lo, hi in zip(p, self.low, self.high, strict=True)))

    def touched(self, p: Vector, h: float) -> list[Column]:
        overlaps = [(x + h >= lo) & (x - h <= hi) for x, lo, hi in zip(p, self.low, self.high, strict=True)]
        found = []
        for axis, side in self._sides():
            others = [o for i, o in enumerate(overlaps) if i != axis]
            found.append(reduce(Column.__and__, others, (p[axis] - h <= side) & (p[axis] + h >= side)))
        return found

    def crossings(self, p: Vector, e: Vector) -> list[tuple[int, Column]]:
        found = []
        for face, (axis, side) in enumerate(self._sides()):
            t = F.when(e[axis] != 0, (F.lit(side) - p[axis]) / e[axis])
            on_face = [((p[i] + t * e[i]) >= self.low[i]) & ((p[i] + t * e[i]) <= self.high[i]) for i in range(len(p)) if i != axis]
            found.append((face, F.when(reduce(Column.__and__, on_face, (t > 0) & (t <= 1)), t)))
        return found


@dataclass
class Ball(Primitive):
    """A sphere, or a circle in two dimensions, with one face."""

    centre: tuple[float, ...]
    radius: float
    n_faces = 1

    def level(self, p: Vector) -> Column:
        d = minus(p, literal(*self.centre))
        return dot(d, d) - F.lit(self.radius * self.radius)

    def touched(self, p: Vector, h: float) -> list[Column]:
        near = [F.greatest(F.abs(x - c) - h, F.lit(0.0)) for x, c in zip(p, self.centre, strict=True)]
        far = [F.abs(x - c) + h for x, c in zip(p, self.centre, strict=True)]
        square = self.radius * self.radius
        return [(dot(tuple(near), tuple(near)) <= square) & (dot(tuple(far), tuple(far)) >= square)]

    def crossings(self, p: Vector, e: Vector) -> list[tuple[int, Column]]:
        d = minus(p, literal(*self.centre))
        return [(0, t) for t in link_roots(dot(e, e), 2 * dot(d, e), dot(d, d) - F.lit(self.radius * self.radius))]


@dataclass
class Cylinder(Primitive):
    """A cylinder along an axis. Faces: mantle, low cap, high cap."""

    axis: int
    centre: tuple[float, float]
    radius: float
    low: float
    high: float
    n_faces = 3

    def _split(self, p: Vector) -> tuple[Column, Vector]:
        return p[self.axis], tuple(x for i, x in enumerate(p) if i != self.axis)

    def level(self, p: Vector) -> Column:
        z, flat = self._split(p)
        return F.greatest(Ball(self.centre, self.radius).level(flat), F.lit(self.low) - z, z - F.lit(self.high))

    def touched(self, p: Vector, h: float) -> list[Column]:
        z, flat = self._split(p)
        near = tuple(F.greatest(F.abs(x - c) - h, F.lit(0.0)) for x, c in zip(flat, self.centre, strict=True))
        over = dot(near, near) <= self.radius * self.radius
        mantle = Ball(self.centre, self.radius).touched(flat, h)[0] & (z + h >= self.low) & (z - h <= self.high)
        return [mantle, *(over & (z - h <= side) & (z + h >= side) for side in (self.low, self.high))]

    def crossings(self, p: Vector, e: Vector) -> list[tuple[int, Column]]:
        z, flat = self._split(p)
        ez, along = self._split(e)
        found = []
        for _, q in Ball(self.centre, self.radius).crossings(flat, along):
            at = z + q * ez
            found.append((0, F.when((at >= self.low) & (at <= self.high), q)))
        d = minus(flat, literal(*self.centre))
        for face, end in ((1, self.low), (2, self.high)):
            t = F.when(ez != 0, (F.lit(end) - z) / ez)
            on = tuple(x + t * y for x, y in zip(d, along, strict=True))
            found.append((face, F.when((t > 0) & (t <= 1) & (dot(on, on) <= self.radius * self.radius), t)))
        return found


#: Velocity sets (fixed values): for each model, which squared lengths of {-1, 0, 1}^d it has and their weights.
LATTICES = {
    "D2Q9": (2, {0: 4 / 9, 1: 1 / 9, 2: 1 / 36}),
    "D3Q15": (3, {0: 2 / 9, 1: 1 / 9, 3: 1 / 72}),
    "D3Q19": (3, {0: 1 / 3, 1: 1 / 18, 2: 1 / 36}),
    "D3Q27": (3, {0: 8 / 27, 1: 2 / 27, 2: 1 / 54, 3: 1 / 216}),
}


def _links(model: str) -> list[tuple[int, float, float, float, float]]:
    axes, weights = LATTICES[model]
    steps = [(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in ((-1, 0, 1) if axes == 3 else (0,))]
    links = sorted((s for s in steps if sum(c * c for c in s) in weights), key=lambda s: (sum(c * c for c in s), s))
    return [(i, float(s[0]), float(s[1]), float(s[2]), weights[sum(c * c for c in s)]) for i, s in enumerate(links)]


def lattice(spark: SparkSession, model: str) -> DataFrame:
    """The links of a velocity set: ``link int, ex, ey, ez double, weight double``, rest link first, then by length and direction."""
    return spark.createDataFrame(_links(model), "link int, ex double, ey double, ez double, weight double")


def grid(spark: SparkSession, low: tuple[float, ...], counts: tuple[int, ...], h: float) -> DataFrame:
    """Cells of a uniform grid: ``cell_id long``, ``i, j, k long`` and centres ``x, y, z double``; three axes."""
    nx, ny, nz = counts
    cells = spark.range(nx * ny * nz).withColumnRenamed("id", "cell_id")
    cells = cells.withColumns({"i": F.col("cell_id") % nx, "j": F.floor(F.col("cell_id") / nx) % ny, "k": F.floor(F.col("cell_id") / (nx * ny))})
    return cells.withColumns({c: F.lit(lo) + (F.col(n) + 0.5) * h for c, n, lo in zip("xyz", "ijk", low, strict=True)})


def wall_links(cells: DataFrame, shape: Shape, model: str, h: float, key: str) -> DataFrame:
    """For each boundary cell and link (but the rest link) that hits the shape: ``key, link, face, q``; one owner face each."""
    place = vector("x", "y", "z")
    types = {base: F.col(f"_type_{base}") for base, _ in shape.parts()}
    typed = cells.select(key, *"xyz", *(part.cell_type(place, h).alias(f"_type_{base}") for base, part in shape.parts())).filter(shape.merged_type(types) == BOUNDARY)
    links = F.array(*(F.struct(F.lit(n).alias("link"), *(F.lit(h * x).alias(a) for a, x in zip(("ex", "ey", "ez"), step, strict=True))) for n, *step, _ in _links(model)[1:]))
    # The cells are small against their links: dealt out by their own number of partitions, which adaptive execution leaves alone.
    dealt = typed.repartition(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    spread = dealt.select("*", F.inline(links))
    step = vector("ex", "ey", "ez")
    found = shape.crossings(place, step)
    crossed = spread.select("*", *(q.alias(f"_q{n}") for n, (_, q) in enumerate(found)))
    hit = shape.first_hit(place, step, [(face, F.col(f"_q{n}")) for n, (face, _) in enumerate(found)], types)
    # As the output of a generator the hit is worked out once for each link; a filter on it stays behind it.
    return crossed.select(key, "link", F.explode(F.array(hit)).alias("hit")).filter("hit is not null").select(key, "link", "hit.face", "hit.q")


def hit_points(hits: DataFrame, cells: DataFrame, model: str, h: float, key: str) -> DataFrame:
    """Hits with the point ``x, y, z`` where the link from the centre of its cell meets the surface; hits of unknown cells or links are left out."""
    links = F.broadcast(lattice(cells.sparkSession, model).drop("weight"))  # 27 rows at most
    placed = hits.join(cells.select(key, *"xyz"), key).join(links, "link")
    return placed.select(*hits.columns, *((F.col(c) + F.col("q") * h * F.col(f"e{c}")).alias(c) for c in "xyz"))


def face_hits(points: DataFrame) -> DataFrame:
    """``face, n, min_q, max_q`` and the bounding box ``min_x .. max_z`` of the hit points of each face."""
    box = [f(c).alias(f"{name}_{c}") for c in "xyz" for name, f in (("min", F.min), ("max", F.max))]
    return points.groupBy("face").agg(F.count("*").alias("n"), F.min("q").alias("min_q"), F.max("q").alias("max_q"), *box)


def box_lines(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """The twelve edges of each box ``min_x .. max_z`` as lines: ``edge`` and ends ``ax .. bz``; along x first, then y, then z."""
    edges = []
    for along in range(3):
        for side in range(4):
            ends = []
            for end in ("min", "max"):
                others = iter((side & 1, side >> 1))
                ends.append([F.col(f"{end if axis == along else ('max' if next(others) else 'min')}_{c}") for axis, c in enumerate("xyz")])
            edges.append(F.struct(F.lit(4 * along + side).alias("edge"), *(x.alias(f"{p}{c}") for p, point in zip("ab", ends, strict=True) for c, x in zip("xyz", point, strict=True))))
    return boxes.select(*keys, F.inline(F.array(*edges)))


def hit_faults(hits: DataFrame, cells: DataFrame, low: tuple[float, ...], h: float, key: str) -> DataFrame:
    """``fault, key, link`` of hits that do not belong: their cell is unknown (no cell), is not at the boundary (not boundary), lies elsewhere than its index says (centre), or ``q`` is not in 0 to 1 (range).

    Cells have ``i, j, k``, centres ``x, y, z`` and ``cell_type``.  A hit has the first fault in this order; without faults there are no rows.
    """
    expected = [F.lit(lo) + (F.col(n) + 0.5) * h for n, lo in zip("ijk", low, strict=True)]
    apart = F.lit(False)
    for c, x in zip("xyz", expected, strict=True):
        apart |= ~F.col(c).eqNullSafe(x)
    fault = F.when(F.col("cell_type").isNull(), "no cell").when(F.col("cell_type") != BOUNDARY, "not boundary").when(apart, "centre").when(~F.coalesce(F.col("q").between(0, 1), F.lit(False)), "range")
    return hits.join(cells.select(key, "cell_type", *"ijkxyz"), key, "left").select(fault.alias("fault"), key, "link").filter("fault is not null")


__all__ = ["BOUNDARY", "DRY", "INTERIOR", "Ball", "Box", "Cylinder", "Shape", "box_lines", "face_hits", "grid", "hit_faults", "hit_points", "lattice", "norm", "wall_links"]
