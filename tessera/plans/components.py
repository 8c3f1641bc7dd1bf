"""Connected components by rewiring edges to the smallest node they know of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.tables import freed, saved


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Labels each node of an undirected edge table with the smallest node it reaches.

    Returns ``node long, component long``.  Edges run from a larger to a smaller node.  A pass links all larger
    neighbours of each node to the smallest node it knows, then does so with its smaller neighbours, until only stars
    about the smallest nodes are left: some log2(n) passes even for a path of n nodes, in whatever order their
    numbers are, and two or three for stars.  Edges never grow in number beyond one for each of them and each node.
    Both sides of each join come from written tables, so adaptive execution can split a node
    that holds a large share of the edges; minima combine before they shuffle; tables of earlier passes are
    deleted.  Edges with a null end are left out; self-loops keep a node as it is; an empty table gives no rows.
    """
    whole = edges.select(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y")).dropna()
    start = saved(whole.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    links, before = start.filter("u > v"), None
    while True:
        both = links.select(F.col("u").alias("at"), F.col("v").alias("to")).union(links.select("v", "u"))
        lowest = both.groupBy("at").agg(F.least("at", F.min("to")).alias("low"))
        large = saved(links.join(lowest.withColumnRenamed("at", "v"), "v").select("u", F.col("low").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("low"))
        rewired = large.join(least, "u").filter("v > low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        after = saved(rewired.union(least).distinct())
        freed(large)
        state = after.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", F.lit(7), "u"))).first()
        if before is not None:
            freed(links)
        links = after
        if state == before:
            break
        before = state
    stars = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    alone = start.select(F.explode(F.array("u", "v")).alias("node")).distinct().select("node", F.col("node").alias("component"))
    found = saved(stars.union(alone).groupBy("node").agg(F.min("component").alias("component")))
    freed(links, start)
    return found
