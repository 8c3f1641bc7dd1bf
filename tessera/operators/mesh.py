"""Triangle meshes: measures, checks, welding, components and containment.

Facets: ``facet_id long`` and vertex coordinates ``ax, ay, az, bx, by, bz, cx, cy, cz double``.
Indexed facets: ``facet_id long, v0, v1, v2 long``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.vectors import Vector, cross, dot, minus, norm, vector
from tessera.plans.components import connected_components
from tessera.plans.scans import sums_before
from tessera.plans.tables import saved

#: A facet with a lower quality is called poor, one over so many mean areas oversized.
QUALITY, OVERSIZED = 0.2, 4.0


def _corners() -> tuple[Vector, Vector, Vector]:
    return tuple(vector(*(v + axis for axis in "xyz")) for v in "abc")


def facet_measures(facets: DataFrame) -> DataFrame:
    """Adds ``area``, ``quality`` (4 sqrt(3) area over the sum of squared edges: 1 if equilateral), ``nx, ny, nz`` (unit normal, null if degenerate) and centroid ``gx, gy, gz``."""
    a, b, c = _corners()
    n = cross(minus(b, a), minus(c, a))
    size = norm(n)
    edges = [minus(b, a), minus(c, b), minus(a, c)]
    total = dot(edges[0], edges[0]) + dot(edges[1], edges[1]) + dot(edges[2], edges[2])
    added = {"area": size / 2, "quality": F.when(total > 0, 2 * F.sqrt(F.lit(3.0)) * size / total)}
    added |= {name: F.when(size > 0, x / size) for name, x in zip(("nx", "ny", "nz"), n, strict=True)}
    added |= {name: (x + y + z) / 3 for name, x, y, z in zip(("gx", "gy", "gz"), a, b, c, strict=True)}
    return facets.withColumns(added)


def facet_summary(facets: DataFrame) -> DataFrame:
    """One row: number of facets, degenerate ones, poor ones, and the bounding box."""
    m = facet_measures(facets)
    bounds = [f(f2(*(F.col(v + axis) for v in "abc"))).alias(f"{name}_{axis}") for axis in "xyz" for name, f, f2 in (("min", F.min, F.least), ("max", F.max, F.greatest))]
    return m.agg(
        F.count("*").alias("n_facets"), F.count_if(F.col("area") == 0).alias("n_degenerate"), F.count_if((F.col("area") > 0) & (F.col("quality") < QUALITY)).alias("n_poor"), *bounds
    )


def directed_edges(indexed: DataFrame) -> DataFrame:
    """Three rows a facet: ``facet_id, lo, hi long`` and ``forward`` (1 if the facet runs from lo to hi, else -1)."""
    pairs = [("v0", "v1"), ("v1", "v2"), ("v2", "v0")]
    row = F.explode(
        F.array(*(F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"), F.when(F.col(a) < F.col(b), 1).otherwise(-1).alias("forward")) for a, b in pairs))
    )
    return indexed.select("facet_id", row.alias("edge")).select("facet_id", "edge.*")


def edge_use(indexed: DataFrame) -> DataFrame:
    """For each edge: ``uses``, ``balance`` and ``verdict`` (open, closed, winding, non_manifold)."""
    verdict = F.when(F.col("uses") == 1, "open").when(F.col("uses") > 2, "non_manifold").when(F.col("balance") == 0, "closed").otherwise("winding")
    used = directed_edges(indexed).groupBy("lo", "hi").agg(F.count("*").alias("uses"), F.sum("forward").alias("balance"))
    return used.withColumn("verdict", verdict)


def duplicate_facets(indexed: DataFrame) -> DataFrame:
    """For each set of vertices that several facets share: ``v0, v1, v2`` in order, ``n`` and the second-lowest facet as ``repeat``."""
    key = F.array_sort(F.array("v0", "v1", "v2"))
    ordered = indexed.select("facet_id", key.alias("k"))
    first = ordered.groupBy("k").agg(F.count("*").alias("n"), F.min("facet_id").alias("first")).filter("n > 1")
    second = ordered.join(first, "k").filter("facet_id > first").groupBy("k", "n").agg(F.min("facet_id").alias("repeat"))
    return second.select(*(F.col("k")[i].alias(f"v{i}") for i in range(3)), "n", "repeat")


def close_pairs(points: DataFrame, radius: float, key: str = "id", by: tuple[str, ...] = ()) -> DataFrame:
    """Pairs ``a < b`` of points at most ``radius`` apart and, if asked, equal in the columns ``by``.

    Space is cut into cubes of that width.  One side of the self-join goes to its own cube, the
    other to the 27 around it, so every pair meets in exactly one cube and needs no distinct.
    """
    own = {f"c{axis}": F.floor(F.col(axis) / radius) for axis in "xyz"}
    left = points.select(*by, F.col(key).alias("a"), *(F.col(c).alias(f"a_{c}") for c in "xyz"), *(e.alias(n) for n, e in own.items()))
    around = F.explode(F.expr("transform(sequence(0, 26), i -> named_struct('x', i % 3 - 1, 'y', cast(floor(i / 3) as int) % 3 - 1, 'z', cast(floor(i / 9) as int) - 1))"))
    right = points.select(*by, F.col(key).alias("b"), *(F.col(c).alias(f"b_{c}") for c in "xyz"), around.alias("d"))
    right = right.select(*by, "b", "b_x", "b_y", "b_z", *((F.floor(F.col(f"b_{axis}") / radius) + F.col(f"d.{axis}")).alias(f"c{axis}") for axis in "xyz"))
    gap = minus(vector("a_x", "a_y", "a_z"), vector("b_x", "b_y", "b_z"))
    return left.join(right, [*by, "cx", "cy", "cz"]).filter((F.col("a") < F.col("b")) & (dot(gap, gap) <= radius * radius)).select("a", "b")


def weld(points: DataFrame, radius: float, key: str = "id", by: tuple[str, ...] = ()) -> DataFrame:
    """Joins points within ``radius`` of each other, also in chains: ``key, representative`` (the smallest key); if asked, only such as are equal in the columns ``by``.

    Equal points stand for one, so that many of them make no pairs; a point without a place stays alone.
    """
    place = [*by, "x", "y", "z"]
    places = saved(points.groupBy(place).agg(F.min(key).alias("first")).dropna(subset=place))
    found = connected_components(close_pairs(places.withColumnRenamed("first", key), radius, key, by))
    return (
        points.join(places, place, "left").withColumn("first", F.coalesce("first", key)).join(found, F.col("first") == F.col("node"), "left")
        .select(key, F.coalesce("component", "first").alias("representative"))
    )


def dense_ids(table: DataFrame, column: str, name: str) -> DataFrame:
    """Numbers the distinct values of a column from 0 in their order."""
    return sums_before(table.select(column).distinct(), [column], {name: F.lit(1)})


def surface_components(indexed: DataFrame) -> DataFrame:
    """Facets that share edges, also in chains: ``facet_id, component`` (the smallest facet)."""
    edges = directed_edges(indexed).select("facet_id", "lo", "hi")
    first = edges.groupBy("lo", "hi").agg(F.min("facet_id").alias("first"))
    links = edges.join(first, ["lo", "hi"]).select(F.col("first").alias("a"), F.col("facet_id").alias("b")).distinct()
    return connected_components(links).withColumnRenamed("node", "facet_id")


def signed_volumes(facets: DataFrame, by: str) -> DataFrame:
    """``by, volume`` of closed surfaces: sixths of a . (b x c), about the centre of each one's bounding box."""
    low = [F.least(*(F.col(v + axis) for v in "abc")) for axis in "xyz"]
    high = [F.greatest(*(F.col(v + axis) for v in "abc")) for axis in "xyz"]
    centre = facets.groupBy(by).agg(*(((F.min(lo) + F.max(hi)) / 2).alias(f"m{axis}") for lo, hi, axis in zip(low, high, "xyz", strict=True)))
    m = vector("mx", "my", "mz")
    a, b, c = (minus(v, m) for v in _corners())
    six = dot(a, cross(b, c))
    return facets.join(centre, by).groupBy(by).agg((F.sum(six) / 6).alias("volume"))


def shadow_toggles(corners: tuple[Vector, Vector, Vector], y: Column, z: Column) -> Column:
    """Whether a line along x at (y, z) crosses a facet, as a condition; a line through an edge counts for one of its two facets (half-open rule on z, then y)."""
    toggles = F.lit(0)
    for p, q in zip(corners, corners[1:] + corners[:1], strict=True):
        first = p[2] < q[2]  # an edge is worked out alike for both of its facets
        low, high = ([F.when(first, s).otherwise(t) for s, t in pair] for pair in (zip(p, q, strict=True), zip(q, p, strict=True)))
        at = F.when(high[2] > low[2], low[1] + (z - low[2]) * (high[1] - low[1]) / (high[2] - low[2]))
        toggles = toggles + F.when(((p[2] <= z) != (q[2] <= z)) & (at > y), 1).otherwise(0)
    return toggles % 2 == 1


def enclosed(points: DataFrame, facets: DataFrame, by: str, key: str = "id") -> DataFrame:
    """``key, by`` for each point strictly inside a closed surface, by the parity of crossings of its line along x.

    Points meet the bounding boxes in cells: a box is in the at most eight cells that it meets of the width of the
    power of two at or above its longest side, a point in one cell of each such width that some box has (some dozens
    if sizes differ much).  A point then meets only the facets whose shadow on y and z is near its own line: shadows are
    in at most nine cells of half their own width or more, a power of two, so that a surface of any number of facets gives each
    point a few.  A point on a facet is not inside, a line through an edge counts for one of its two facets.
    Keys have to be unique.  Points without a place are nowhere inside; a flat surface holds nothing.
    """
    return _crossings(points, facets, by, key).filter("crossings % 2 = 1 and on = 0").select(key, by)


def on_surface(points: DataFrame, facets: DataFrame, by: str, key: str = "id") -> DataFrame:
    """``key, by`` for each point exactly on a facet of a surface that is not flat, found as ``enclosed`` does."""
    return _crossings(points, facets, by, key).filter("on > 0").select(key, by)


def facets_near(points: DataFrame, facets: DataFrame, by: str, key: str) -> DataFrame:
    """Points within a surface's box with each of its facets that may be on or ahead of them along x: ``key, by, x, y, z`` and corners."""
    lowest, highest = ({x: f(*(F.col(v + x) for v in "abc")) for x in "xyz"} for f in (F.least, F.greatest))
    exponent = lambda size: F.ceil(F.log2(size)).cast("int")
    shaded = facets.withColumn("_s", exponent(F.greatest(*(highest[x] - lowest[x] for x in "yz"))) - 1).filter("_s is not null")
    extent = shaded.groupBy(by).agg(*(F.min(lowest[x]).alias(f"lo_{x}") for x in "xyz"), *(F.max(highest[x]).alias(f"hi_{x}") for x in "xyz"), F.collect_set("_s").alias("_widths"))
    sides = [F.col(f"hi_{x}") - F.col(f"lo_{x}") for x in "xyz"]
    boxes = saved(extent.filter(F.least(*sides) > 0).withColumn("_size", exponent(F.greatest(*sides))))
    sizes = [r[0] for r in boxes.select("_size").distinct().collect()]  # exponents of doubles: 2,098 at most, whatever the table
    if not sizes:
        return points.select(key, *"xyz").limit(0).crossJoin(facets.select(by, *(v + x for v in "abc" for x in "xyz")).limit(0))
    cell = lambda place, size: F.floor(place / F.pow(F.lit(2.0), F.col(size)))
    for x in "xyz":
        boxes = boxes.withColumn(f"_{x}", F.explode(F.sequence(cell(F.col(f"lo_{x}"), "_size"), cell(F.col(f"hi_{x}"), "_size"))))
    cells = ["_size", "_x", "_y", "_z"]
    placed = points.select(key, *"xyz").dropna(subset=list("xyz")).withColumn("_size", F.explode(F.array(*map(F.lit, sizes)))).withColumns({f"_{x}": cell(F.col(x), "_size") for x in "xyz"})
    within = [(F.col(x) >= F.col(f"lo_{x}")) & (F.col(x) <= F.col(f"hi_{x}")) for x in "xyz"]
    candidates = placed.join(boxes, cells).filter(within[0] & within[1] & within[2]).select(key, *"xyz", by, F.explode("_widths").alias("_s"))
    candidates = candidates.withColumns({"_cy": cell(F.col("y"), "_s"), "_cz": cell(F.col("z"), "_s")})
    for x in "yz":
        shaded = shaded.withColumn(f"_c{x}", F.explode(F.sequence(cell(lowest[x], "_s"), cell(highest[x], "_s"))))
    return candidates.join(shaded.select(by, "_s", "_cy", "_cz", *(v + x for v in "abc" for x in "xyz")), [by, "_s", "_cy", "_cz"]).filter(highest["x"] >= F.col("x"))


def _crossings(points: DataFrame, facets: DataFrame, by: str, key: str) -> DataFrame:
    """``key, by, crossings, on``: facets ahead of a point along x and facets it lies on, for points near some facet."""
    near = facets_near(points, facets, by, key)
    a, b, c = corners = _corners()
    p = vector("x", "y", "z")
    n = cross(minus(b, a), minus(c, a))
    ahead = F.when(n[0] != 0, a[0] - (n[1] * (p[1] - a[1]) + n[2] * (p[2] - a[2])) / n[0]) > p[0]
    on = (dot(n, minus(p, a)) == 0) & (dot(n, n) > 0)
    for s, t in zip(corners, corners[1:] + corners[:1], strict=True):
        on = on & (dot(n, cross(minus(t, s), minus(p, s))) >= 0)
    return near.groupBy(key, by).agg(F.count_if(shadow_toggles(corners, p[1], p[2]) & ahead).alias("crossings"), F.count_if(on).alias("on"))


def nesting(contains: DataFrame) -> DataFrame:
    """From all pairs ``outer, inner`` of nested surfaces: ``inner, parent, level``; the direct parent has no surface between."""
    a, b, c = contains.alias("a"), contains.alias("b"), contains.alias("c")
    between = b.join(c, F.col("b.inner") == F.col("c.outer")).select(F.col("b.outer").alias("outer"), F.col("c.inner").alias("inner")).distinct()
    level = contains.groupBy("inner").agg(F.count("*").alias("level"))
    return a.join(between, ["outer", "inner"], "left_anti").join(level, "inner").select("inner", F.col("outer").alias("parent"), "level")


def cells_of_boxes(boxes: DataFrame, h: float, key: str, axes: str = "xyz") -> DataFrame:
    """Range join helper: every cell (index on each axis) that a box ``lo_x .. hi_x, ...`` meets, ready for an equi-join."""
    out = boxes
    for axis in axes:
        cells: Column = F.sequence(F.floor(F.col(f"lo_{axis}") / h), F.floor(F.col(f"hi_{axis}") / h))
        out = out.withColumn(f"cell_{axis}", F.explode(cells))
    return out.select(key, *(f"cell_{axis}" for axis in axes))
