"""Planar faces of a mesh and the edges between them.

Facets have ``facet_id``, vertex numbers ``v0, v1, v2`` and coordinates ``ax .. cz``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.vectors import cross, dot, minus, norm, vector
from tessera.operators.mesh import directed_edges, facet_measures
from tessera.plans.components import connected_components
from tessera.plans.scans import sums_before
from tessera.plans.tables import freed, saved

#: Distances up to so many units of rounding, times the size of the two facets, count as none.
ROUNDING = 64 * 2.0**-52


def _beyond(plane: str, other: str) -> Column:
    """The largest distance of the corners of one facet from the plane of another; null if that one is degenerate."""
    a, b, c = (vector(*(f"{plane}_{v}{x}" for x in "xyz")) for v in "abc")
    n = cross(minus(b, a), minus(c, a))
    size = norm(n)
    far = F.greatest(*(F.abs(dot(n, minus(vector(*(f"{other}_{v}{x}" for x in "xyz")), a))) for v in "abc"))
    return F.when(size > 0, far / size)


def planar_links(facets: DataFrame) -> DataFrame:
    """Pairs ``a < b`` of facets that share an edge with no third facet and lie in one plane, each judged by the other."""
    edges = directed_edges(facets).groupBy("lo", "hi").agg(F.min("facet_id").alias("a"), F.max("facet_id").alias("b"), F.count("*").alias("uses"))
    pairs = edges.filter("uses = 2 and a < b").select("a", "b").distinct()
    numbers = [f"{v}{x}" for v in "abc" for x in "xyz"]
    for side in "ab":
        pairs = pairs.join(facets.select(F.col("facet_id").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in numbers)), side)
    scale = F.greatest(*(F.abs(F.col(f"{side}_{c}")) for side in "ab" for c in numbers), F.lit(1e-300))
    return pairs.filter((_beyond("a", "b") <= ROUNDING * scale) & (_beyond("b", "a") <= ROUNDING * scale)).select("a", "b")


def planar_faces(facets: DataFrame) -> DataFrame:
    """``facet_id, face_id``: facets in one plane that edges connect, two at least; the face is named after its smallest facet."""
    return connected_components(planar_links(facets)).select(F.col("node").alias("facet_id"), F.col("component").alias("face_id"))


#: Seeds meet each other's facets only through edges that bend by less than this share of their facets' longest edges.
BEND = 1e-6


def _on_plane(plane: str, other: str, share: float) -> Column:
    """Whether the corners of one facet lie in the plane of another, up to a share of its longest edge times their distance from its first corner."""
    a, b, c = (vector(*(f"{plane}_{v}{x}" for x in "xyz")) for v in "abc")
    n = cross(minus(b, a), minus(c, a))
    longest = F.greatest(norm(minus(b, a)), norm(minus(c, a)), norm(minus(c, b)))
    within = F.lit(True)
    for v in "abc":
        q = minus(vector(*(f"{other}_{v}{x}" for x in "xyz")), a)
        within &= F.abs(dot(n, q)) <= norm(n) * share * longest * norm(q)
    return (norm(n) > 0) & within


def _pair_of(facets: DataFrame, pairs: DataFrame, first: str, second: str) -> DataFrame:
    """Pairs with the corners of both facets, named after their columns."""
    for side in (first, second):
        pairs = pairs.join(facets.select(F.col("facet_id").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in (f"{v}{x}" for v in "abc" for x in "xyz"))), side)
    return pairs


def seeded_faces(facets: DataFrame) -> DataFrame:
    """``facet_id, face_id``: planar faces that grow from their smallest facet and keep its plane; ``face_id`` is that seed.

    Seeds come in ascending order.  A facet is one if it is still free and has a free neighbour such that each lies in the plane of the other;
    it takes all free facets that it reaches over facets that share its plane in this way.  So a chain of facets that bends within rounding is cut
    where it leaves the seed's plane.  Degenerate facets and those without such a neighbour belong to no face.  Neighbours share an edge
    with no third facet.

    Method: rounds.  Edges that bend by no more than a millionth split the free facets into groups, and what one group does
    does not touch another.  Each round the smallest possible seed of every group grows: its plane joins the facets of its group, and of those that
    share it the ones connected with the seed are taken.  Groups without a seed are left out of later rounds.  A flat face takes
    one round and a group that bends as many as it has faces.  A group that grows past the edges counted (a seed thinner than about one part in 10**7 of its
    distance) would be cut there.
    """
    numbers = [f"{v}{x}" for v in "abc" for x in "xyz"]
    edges = directed_edges(facets).groupBy("lo", "hi").agg(F.min("facet_id").alias("a"), F.max("facet_id").alias("b"), F.count("*").alias("uses"))
    pairs = _pair_of(facets, edges.filter("uses = 2 and a < b").select("a", "b").distinct(), "a", "b")
    loose = _on_plane("a", "b", BEND) & _on_plane("b", "a", BEND)
    links = saved(pairs.filter(loose).select("a", "b", (_on_plane("a", "b", ROUNDING) & _on_plane("b", "a", ROUNDING)).alias("flat")))
    planes = saved(facets.select("facet_id", *numbers).join(links.select(F.explode(F.array("a", "b")).alias("facet_id")).distinct(), "facet_id", "left_semi"))
    faces: DataFrame | None = None
    while not links.filter("flat").isEmpty():
        groups = connected_components(links)
        seeds = links.filter("flat").join(groups, F.col("a") == F.col("node")).groupBy("component").agg(F.min("a").alias("seed"))
        members = groups.join(seeds, "component").select(F.col("node").alias("facet"), "seed")  # groups without a seed end here
        flat = saved(_pair_of(planes, members, "seed", "facet").filter((F.col("seed") == F.col("facet")) | (_on_plane("seed", "facet", ROUNDING) & _on_plane("facet", "seed", ROUNDING))).select("seed", "facet"))
        inside = links.select("a", "b").join(flat.select(F.col("facet").alias("a"), "seed"), "a").join(flat.select(F.col("facet").alias("b")), "b", "left_semi")
        parts = connected_components(inside)
        ours = parts.select(F.col("node").alias("seed"), "component").join(flat.select("seed").distinct(), "seed", "left_semi")
        taken = saved(parts.join(ours, "component").select(F.col("node").alias("facet_id"), F.col("seed").alias("face_id")))
        left = links.join(members.select(F.col("facet").alias("a")), "a", "left_semi")
        for side in "ab":
            left = left.join(taken.select(F.col("facet_id").alias(side)), side, "left_anti")
        left = saved(left.select("a", "b", "flat"))
        freed(links, groups, flat, parts)
        links, faces = left, taken if faces is None else faces.union(taken)
    freed(links)
    return faces if faces is not None else facets.select(F.col("facet_id").cast("long").alias("facet_id"), F.col("facet_id").cast("long").alias("face_id")).limit(0)


def face_report(facets: DataFrame, faces: DataFrame, excluded: list[int] | None = None, small: float = 0.01) -> DataFrame:
    """``face_id, original, face, facets, area, share, small`` of each face, numbered from 1 by seed; ``original`` counts excluded faces too, ``face`` does not.

    ``small``: faces of less than this share of the whole area, to look at before they are kept.  An excluded number that no face has, and a share outside 0 to 1, raise.
    """
    excluded = sorted(set(excluded or []))
    if not 0 <= small <= 1:
        raise ValueError("the share of small faces has to lie in 0 to 1")
    sized = facet_measures(facets).select("facet_id", "area").join(faces, "facet_id", "left")
    by_face = saved(sized.groupBy("face_id").agg(F.count("*").alias("facets"), F.sum("area").alias("area")))
    whole = by_face.agg(F.sum("area").alias("whole"))
    found = sums_before(by_face.filter("face_id is not null"), ["face_id"], {"original": F.lit(1)}).withColumn("original", F.col("original") + 1)
    if excluded and found.filter(F.col("original").isin(excluded)).count() < len(excluded):
        raise ValueError("an excluded face does not exist")
    kept = sums_before(found.filter(~F.col("original").isin(excluded)), ["face_id"], {"face": F.lit(1)}).withColumn("face", F.col("face") + 1)
    share = F.when(F.col("whole") > 0, F.col("area") / F.col("whole")).otherwise(0.0)
    return kept.crossJoin(F.broadcast(whole)).select("face_id", "original", "face", "facets", "area", share.alias("share"), ((F.col("whole") > 0) & (share < small)).alias("small"))  # one row


def boundary_edges(facets: DataFrame, faces: DataFrame) -> DataFrame:
    """``lo, hi, kind``: as ``feature_edges``, for given faces; facets of none count as one face together, so edges between two of them are flat."""
    owned = directed_edges(facets).join(faces, "facet_id", "left").withColumn("face_id", F.coalesce("face_id", F.lit(-1)))
    used = owned.groupBy("lo", "hi").agg(F.count("*").alias("uses"), F.min("face_id").alias("low"), F.max("face_id").alias("high"))
    return used.select("lo", "hi", F.when(F.col("uses") == 1, "open").when(F.col("low") == F.col("high"), "flat").otherwise("feature").alias("kind"))


def face_measures(facets: DataFrame) -> DataFrame:
    """``face_id, facets, area`` of each planar face."""
    measured = facet_measures(facets).select("facet_id", "area")
    return measured.join(planar_faces(facets), "facet_id").groupBy("face_id").agg(F.count("*").alias("facets"), F.sum("area").alias("area"))


def feature_edges(facets: DataFrame) -> DataFrame:
    """``lo, hi, kind``: edges that are open, inside a planar face (flat) or where faces or single facets meet (feature)."""
    faces = saved(planar_faces(facets))
    owned = directed_edges(facets).join(faces, "facet_id", "left").withColumn("face_id", F.coalesce("face_id", "facet_id"))
    used = owned.groupBy("lo", "hi").agg(F.count("*").alias("uses"), F.min("face_id").alias("low"), F.max("face_id").alias("high"))
    kind = F.when(F.col("uses") == 1, "open").when(F.col("low") == F.col("high"), "flat").otherwise("feature")
    return used.select("lo", "hi", kind.alias("kind"))


def curve_ends(edges: DataFrame) -> DataFrame:
    """``vertex, degree, role`` of the vertices of feature edges: end (one edge), pass (two) or junction; curves run between ends and junctions."""
    ends = edges.filter("kind = 'feature'").select(F.explode(F.array("lo", "hi")).alias("vertex")).groupBy("vertex").agg(F.count("*").alias("degree"))
    return ends.withColumn("role", F.when(F.col("degree") == 1, "end").when(F.col("degree") == 2, "pass").otherwise("junction"))


def feature_curves(edges: DataFrame) -> DataFrame:
    """``lo, hi, curve``: feature edges that meet at passing vertices, also in chains; ``curve`` is the smallest number of its edges."""
    features = saved(edges.filter("kind = 'feature'").select("lo", "hi", F.xxhash64("lo", "hi").alias("edge")))
    at = features.select("edge", F.explode(F.array("lo", "hi")).alias("vertex")).join(curve_ends(edges).filter("role = 'pass'"), "vertex")
    links = at.groupBy("vertex").agg(F.min("edge").alias("a"), F.max("edge").alias("b")).select("a", "b")
    found = connected_components(links)
    return features.join(found, F.col("edge") == F.col("node"), "left").select("lo", "hi", F.coalesce("component", "edge").alias("curve"))


def traced_curves(edges: DataFrame) -> DataFrame:
    """Feature edges in the order of their curves: ``lo, hi, curve_lo, curve_hi, closed, position, edges``.

    Curves are cut at ends and junctions and are known by the smallest of their edges.  An open curve runs from its smaller end vertex,
    and if both are one junction, by its smaller neighbour there; a closed one starts at its smallest vertex towards the smaller of both neighbours.
    Positions count from 0.

    Method: list ranking.  Each edge is two arcs, and an arc is followed by the one that goes on from a passing vertex; closed
    curves are opened at their smallest vertex.  Every round an arc takes over the successor of its successor and
    adds up the steps, so a curve of n edges takes log2(n) rounds, in which no curve meets in one task.
    """
    curves = saved(feature_curves(edges))
    roles = curve_ends(edges).filter("role = 'pass'").select("vertex", F.lit(True).alias("passing"))
    arcs = curves.select("curve", "lo", "hi", F.inline(F.array(F.struct(F.col("lo").alias("u"), F.col("hi").alias("v")), F.struct(F.col("hi").alias("u"), F.col("lo").alias("v")))))
    arcs = saved(arcs.join(roles, F.col("v") == F.col("vertex"), "left").drop("vertex").withColumn("passing", F.coalesce("passing", F.lit(False))))
    about = arcs.groupBy("curve").agg(F.bool_and("passing").alias("closed"), F.min("v").alias("first"), F.min(F.struct("lo", "hi")).alias("name"))
    known = saved(arcs.join(about, "curve").withColumn("on", F.col("passing") & ~(F.col("closed") & (F.col("v") == F.col("first")))))
    after = known.select("curve", F.col("u").alias("v"), F.col("v").alias("w"))
    following = known.filter("on").join(after, ["curve", "v"]).filter("w <> u").select("u", "v", F.col("w"))
    ranked = known.join(following, ["u", "v"], "left").select(
        "curve", "name", "closed", "lo", "hi", "u", "v", F.when(F.col("w").isNotNull(), F.struct(F.col("v").alias("u"), F.col("w").alias("v"))).alias("next"), F.lit(1).cast("long").alias("steps"), F.struct("v", "u").alias("end")
    )
    ranked = saved(ranked)
    while not ranked.filter("next is not null").isEmpty():
        far = ranked.select(F.struct("u", "v").alias("next"), F.col("next").alias("_next"), F.col("steps").alias("_steps"), F.col("end").alias("_end"))
        joined = ranked.join(far, "next", "left")
        ended = F.col("next").isNull()
        doubled = saved(joined.select("curve", "name", "closed", "lo", "hi", "u", "v", F.col("_next").alias("next"), F.when(ended, F.col("steps")).otherwise(F.col("steps") + F.col("_steps")).alias("steps"), F.when(ended, F.col("end")).otherwise(F.col("_end")).alias("end")))
        freed(ranked)
        ranked = doubled
    # Of both directions the one with the larger end starts at the smaller one.
    chains = ranked.groupBy("curve").agg(F.max("end").alias("end"), F.max("steps").alias("edges"))
    return ranked.join(chains, ["curve", "end"]).select("lo", "hi", F.col("name.lo").alias("curve_lo"), F.col("name.hi").alias("curve_hi"), "closed", (F.col("edges") - F.col("steps")).alias("position"), "edges")
