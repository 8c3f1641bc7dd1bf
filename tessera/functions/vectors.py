"""Column expressions for points, vectors and distances. A vector is a tuple of columns."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, ...]


def vector(*names: str) -> Vector:
    return tuple(F.col(n) for n in names)


def literal(*values: float) -> Vector:
    return tuple(F.lit(float(v)) for v in values)


def minus(a: Vector, b: Vector) -> Vector:
    return tuple(x - y for x, y in zip(a, b, strict=True))


def along(a: Vector, b: Vector, t: Column) -> Vector:
    """a + t b."""
    return tuple(x + t * y for x, y in zip(a, b, strict=True))


def dot(a: Vector, b: Vector) -> Column:
    return reduce(add, (x * y for x, y in zip(a, b, strict=True)))


def cross(a: Vector, b: Vector) -> Vector:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < float("inf"))


def copysign(size: Column, sign: Column) -> Column:
    return F.when(sign < 0, -F.abs(size)).otherwise(F.abs(size))


def link_roots(a: Column, b: Column, c: Column) -> list[Column]:
    """Both roots of a t^2 + b t + c, without cancellation; null for a root that is not in (0, 1]."""
    disc = b * b - 4 * a * c
    q = -0.5 * (b + copysign(F.sqrt(disc), b))
    real = (disc >= 0) & ((a != 0) | (b != 0))
    return [F.when(real & (r > 0) & (r <= 1), r) for r in (F.when(a != 0, q / a), F.when(q != 0, c / q))]


def segment_distance(p: Vector, a: Vector, b: Vector) -> Column:
    """Distance of a point to the segment from a to b."""
    ab, ap = minus(b, a), minus(p, a)
    size = dot(ab, ab)
    t = F.when(size == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(ap, ab) / size)))
    return norm(minus(ap, tuple(t * x for x in ab)))


def box_distance(p: Vector, low: Vector, high: Vector) -> Column:
    """Signed distance to an axis-parallel box: negative inside, 0 on the surface."""
    outside = [F.greatest(lo - x, x - hi) for x, lo, hi in zip(p, low, high, strict=True)]
    beyond = [F.greatest(d, F.lit(0.0)) for d in outside]
    return F.sqrt(reduce(add, (d * d for d in beyond))) + F.least(F.greatest(*outside), F.lit(0.0))


def solid_angle(p: Vector, a: Vector, b: Vector, c: Vector) -> Column:
    """The signed solid angle of a triangle seen from p; over a closed surface the sum is 4 pi inside and 0 outside."""
    u, v, w = minus(a, p), minus(b, p), minus(c, p)
    nu, nv, nw = norm(u), norm(v), norm(w)
    top = dot(u, cross(v, w))
    bottom = nu * nv * nw + dot(u, v) * nw + dot(u, w) * nv + dot(v, w) * nu
    return 2 * F.atan2(top, bottom)


def triangle_distance(p: Vector, a: Vector, b: Vector, c: Vector) -> Column:
    """Distance of a point from a triangle: from its plane where the foot is within it, else from its nearest edge."""
    along, across, to = minus(b, a), minus(c, a), minus(p, a)
    first, mixed, second = dot(along, along), dot(along, across), dot(across, across)
    area = first * second - mixed * mixed
    u = F.try_divide(dot(to, along) * second - dot(to, across) * mixed, area)
    v = F.try_divide(dot(to, across) * first - dot(to, along) * mixed, area)
    foot = tuple(t - u * x - v * y for t, x, y in zip(to, along, across, strict=True))
    edges = F.least(*(segment_distance(p, s, t) for s, t in ((a, b), (b, c), (c, a))))
    return F.when((area > 0) & (u >= 0) & (v >= 0) & (u + v <= 1), norm(foot)).otherwise(edges)
