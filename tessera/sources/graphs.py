"""Text formats of graphs and sparse matrices.

A graph file has a header ``vertices edges [format [constraints]]`` and a line of neighbours for each
vertex, counted from 1; lines that start with ``%`` are comments. The last three digits of the format
say whether vertices have sizes, vertices have weights, and edges have weights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.plans.scans import sums_before
from tessera.plans.tables import saved


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, line_no, line`` of all files under a path, lines counted from 0 without comments, which start with ``%``.

    Files are read in splits.  Lines of a split are numbered by their order in it, after the count of lines in earlier splits of the file, so no task
    holds more than a split.  Missing files raise, and so do files without a line.
    """
    table = spark.read.option("lineSep", "\n").text(path)
    place = table.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    lines = saved(place.filter(~F.coalesce(F.ltrim("line").startswith("%"), F.lit(False))))
    counts = saved(lines.groupBy("path", "block").agg(F.count("*").alias("n")))  # a row for each split
    files = len(table.inputFiles())
    if counts.select("path").distinct().count() < files:
        raise ValueError(f"{path}: a file of {files} has no lines")
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("path", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("path", "block").orderBy("at")) - 1
    return lines.join(bases, ["path", "block"]).select("path", (F.col("before") + within).alias("line_no"), "line")


def _graph_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Headers ``path, vertices, edges, kind, constraints`` (a row for each file) and vertex lines ``path, a, fields``."""
    fields = saved(numbered_lines(spark, path).select("path", "line_no", F.filter(F.split(F.trim("line"), r"\s+"), lambda x: x != "").alias("fields")))
    head = fields.filter("line_no = 0").select(
        "path", F.get("fields", F.lit(0)).try_cast("long").alias("vertices"), F.get("fields", F.lit(1)).try_cast("long").alias("edges"),
        F.lpad(F.coalesce(F.get("fields", F.lit(2)), F.lit("0")), 3, "0").alias("kind"), F.coalesce(F.get("fields", F.lit(3)).cast("int"), F.lit(1)).alias("constraints"),
    )
    lines = fields.filter("line_no > 0").select("path", F.col("line_no").alias("a"), "fields")
    lengths = lines.groupBy("path").agg(F.max("a").alias("lines"), F.max(F.when(F.size("fields") > 0, F.col("a"))).alias("used"))
    found = head.join(lengths, "path", "left").filter(F.col("vertices").isNull() | F.col("edges").isNull() | (F.coalesce("lines", F.lit(0)) < F.col("vertices")) | (F.coalesce("used", F.lit(0)) > F.col("vertices"))).first()
    if found is not None:
        raise ValueError(f"{found.path}: the header states {found.vertices} vertices, but the file has {found.lines} lines of them")
    return head, lines


def _after_weights(head: DataFrame, lines: DataFrame) -> DataFrame:
    """Vertex lines with what their header says: ``skip`` fields of the vertex, then ``width`` fields for each neighbour."""
    skip = F.substring("kind", 1, 1).cast("int") + F.substring("kind", 2, 1).cast("int") * F.col("constraints")
    return lines.join(head, "path").withColumns({"skip": skip, "width": 1 + F.substring("kind", 3, 1).cast("int")}).filter(F.col("a") <= F.col("vertices"))


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """Edges ``path, a, b long, w double`` of all graph files under a path, vertices from 0, each edge in both directions as in the file.

    Files are read in splits.  They raise if they are missing or empty, if the header has no two numbers, if lines of vertices are missing (a file cut
    short) or follow after the last, and if neighbours are not numbers of vertices or their count is not twice that of the edges.
    """
    head, lines = _graph_lines(spark, path)
    rest = _after_weights(head, lines).select("path", "a", "vertices", "width", F.slice("fields", F.col("skip") + 1, F.greatest(F.size("fields") - F.col("skip"), F.lit(0))).alias("rest"))
    items = rest.select("path", "a", "vertices", "width", "rest", F.posexplode("rest").alias("pos", "item")).filter("pos % width = 0")
    weight = F.when(F.col("width") == 2, F.get("rest", F.col("pos") + 1).try_cast("double")).otherwise(1.0)
    edges = saved(items.select("path", (F.col("a") - 1).alias("a"), (F.col("item").try_cast("long") - 1).alias("b"), weight.alias("w"), "vertices"))
    wrong = F.count_if(F.col("b").isNull() | F.col("w").isNull() | ~F.col("b").between(F.lit(0), F.col("vertices") - 1))
    counted = head.join(edges.groupBy("path").agg(F.count("*").alias("n"), wrong.alias("wrong")), "path", "left")
    found = counted.filter((F.coalesce("n", F.lit(0)) != 2 * F.col("edges")) | (F.col("wrong") > 0)).first()
    if found is not None:
        raise ValueError(f"{found.path}: {found.n} neighbours for {found.edges} edges, {found.wrong} of them wrong")
    return edges.drop("vertices")


def read_vertices(spark: SparkSession, path: str) -> DataFrame:
    """``path, a long, size double, weights array<double>`` of all vertices of graph files; without sizes or weights in the file they are 1."""
    head, lines = _graph_lines(spark, path)
    sized = F.substring("kind", 1, 1).cast("int")
    weighted = F.substring("kind", 2, 1) == "1"
    size = F.when(sized == 1, F.get("fields", F.lit(0)).cast("double")).otherwise(1.0)
    weights = F.when(weighted, F.slice("fields", sized + 1, F.col("constraints")).cast("array<double>")).otherwise(F.array_repeat(F.lit(1.0), F.col("constraints")))
    return _after_weights(head, lines).select("path", (F.col("a") - 1).alias("a"), size.alias("size"), weights.alias("weights"))


def graph_lines(edges: DataFrame, vertices: int) -> DataFrame:
    """``line_no, line`` of a graph file with edge weights: a header, then the neighbours of each vertex in order.  Edges go both ways, ``a, b, w``; the format has a vertex's neighbours on one line."""
    near = edges.groupBy(F.col("a").alias("v")).agg(F.array_sort(F.collect_list(F.struct("b", "w"))).alias("near"))
    every = edges.sparkSession.range(vertices).join(near, F.col("id") == F.col("v"), "left")
    items = F.transform(F.coalesce("near", F.array().cast("array<struct<b:bigint,w:double>>")), lambda x: F.concat_ws(" ", (x.b + 1).cast("string"), x.w.cast("string")))
    body = every.select((F.col("id") + 1).alias("line_no"), F.array_join(items, " ").alias("line"))
    head = edges.agg(F.concat_ws(" ", F.lit(str(vertices)), F.floor(F.count("*") / 2).cast("string"), F.lit("001")).alias("line")).select(F.lit(0).cast("long").alias("line_no"), "line")
    return head.union(body)


def read_rows(spark: SparkSession, path: str, header: bool = True, values: bool = True, first: int = 1) -> DataFrame:
    """Entries ``path, row, col long, val double`` of matrices with a line for each row: columns, counted from ``first``, and their values.

    With a header ``rows columns entries`` the counts have to agree.  Without values each entry is 1.
    """
    lines = numbered_lines(spark, path).select("path", F.col("line_no").alias("row"), F.filter(F.split(F.trim("line"), r"\s+"), lambda x: x != "").alias("fields"))
    lines = saved(lines)
    step = 2 if values else 1
    body = lines.filter("row > 0").withColumn("row", F.col("row") - 1) if header else lines
    items = body.select("path", "row", "fields", F.posexplode("fields").alias("pos", "item")).filter(F.col("pos") % step == 0)
    value = F.get("fields", F.col("pos") + 1).try_cast("double") if values else F.lit(1.0)
    entries = saved(items.select("path", "row", (F.col("item").try_cast("long") - first).alias("col"), value.alias("val")))
    bad = entries.filter("col is null or col < 0 or val is null").first()
    if bad is not None:
        raise ValueError(f"{bad.path}: row {bad.row} has a wrong entry")
    if header:
        head = lines.filter("row = 0").select("path", *(F.get("fields", F.lit(i)).try_cast("long").alias(n) for i, n in enumerate(("rows", "cols", "entries"))))
        seen = entries.groupBy("path").agg(F.count("*").alias("n"), F.max("col").alias("top"))
        held = body.groupBy("path").agg(F.max(F.when(F.size("fields") > 0, F.col("row") + 1)).alias("used"), F.max(F.col("row") + 1).alias("lines"))
        found = head.join(seen, "path", "left").join(held, "path", "left").filter(
            F.col("entries").isNull() | (F.coalesce("n", F.lit(0)) != F.col("entries")) | (F.col("top") >= F.col("cols")) | (F.coalesce("used", F.lit(0)) > F.col("rows")) | (F.coalesce("lines", F.lit(0)) < F.col("rows"))
        ).first()
        if found is not None:
            raise ValueError(f"{found.path}: the header does not agree with {found.n} entries in {found.lines} rows")
    return entries


def row_lines(entries: DataFrame, rows: int, cols: int, header: bool = True, values: bool = True, first: int = 1) -> DataFrame:
    """``line_no, line`` of the format that ``read_rows`` reads; a row's columns are in order on one line."""
    held = entries.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("col", "val"))).alias("items"))
    every = entries.sparkSession.range(rows).join(held, F.col("id") == F.col("row"), "left")
    text = F.transform(F.coalesce("items", F.array().cast("array<struct<col:bigint,val:double>>")), lambda x: F.concat_ws(" ", (x.col + first).cast("string"), *([x.val.cast("string")] if values else [])))
    body = every.select((F.col("id") + int(header)).alias("line_no"), F.array_join(text, " ").alias("line"))
    if not header:
        return body
    head = entries.agg(F.concat_ws(" ", F.lit(str(rows)), F.lit(str(cols)), F.count("*").cast("string")).alias("line"))
    return head.select(F.lit(0).cast("long").alias("line_no"), "line").union(body)


def write_lines(lines: DataFrame, path: str) -> None:
    """Writes ``line_no, line`` as text in part files that follow the order of lines."""
    lines.repartitionByRange("line_no").sortWithinPartitions("line_no").select("line").write.text(path)


def graph_faults(edges: DataFrame, vertices: int) -> DataFrame:
    """``fault, a, b, n`` of edges that a graph must not have: loops, vertices out of range, repeated edges, and edges without one back of the same weight."""
    loops = edges.filter("a = b").groupBy("a", "b").agg(F.count("*").alias("n")).withColumn("fault", F.lit("loop"))
    outside = edges.filter(~F.col("a").between(0, vertices - 1) | ~F.col("b").between(0, vertices - 1)).groupBy("a", "b").agg(F.count("*").alias("n")).withColumn("fault", F.lit("range"))
    known = edges.filter("a <> b").groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(
        *(F.count_if(way).alias(f"n{i}") for i, way in enumerate((F.col("a") < F.col("b"), F.col("a") > F.col("b")))),
        *(F.sum(F.when(way, F.col("w"))).alias(f"w{i}") for i, way in enumerate((F.col("a") < F.col("b"), F.col("a") > F.col("b")))),
    )
    repeated = known.filter("n0 > 1 or n1 > 1").select(F.col("lo").alias("a"), F.col("hi").alias("b"), (F.col("n0") + F.col("n1")).alias("n"), F.lit("repeated").alias("fault"))
    alone = known.filter("n0 <> n1 or not (w0 <=> w1)").select(F.col("lo").alias("a"), F.col("hi").alias("b"), (F.col("n0") + F.col("n1")).alias("n"), F.lit("one way").alias("fault"))
    return loops.unionByName(outside).unionByName(repeated).unionByName(alone).select("fault", "a", "b", "n")


def one_sided(edges: DataFrame) -> DataFrame:
    """Edges whose counterpart in the other direction is missing or has another weight."""
    back = edges.select("path", F.col("b").alias("a"), F.col("a").alias("b"), "w")
    return edges.join(back, ["path", "a", "b", "w"], "left_anti")


def triples(entries: DataFrame) -> DataFrame:
    """Matrix entries as lines ``row col value``."""
    return entries.select(F.concat_ws(" ", F.col("row").cast("string"), F.col("col").cast("string"), F.col("val").cast("string")).alias("value"))


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """Entries ``row, col long, val double`` from lines ``row col value``; a line without a value counts 1."""
    fields = spark.read.text(path).filter("trim(value) <> ''").select(F.split(F.trim("value"), r"\s+").alias("f"))
    return fields.select(F.col("f")[0].cast("long").alias("row"), F.col("f")[1].cast("long").alias("col"), F.coalesce(F.get("f", F.lit(2)).cast("double"), F.lit(1.0)).alias("val"))


def mesh_dual(elements: DataFrame, common: int = 1) -> DataFrame:
    """Pairs ``a < b`` of elements that share at least so many nodes, with their number ``n``.

    Elements: ``element, node long``. They meet through their nodes, as an element has few of them and
    a node belongs to few elements.
    """
    x, y = elements.distinct().alias("x"), elements.distinct().alias("y")
    pairs = x.join(y, (F.col("x.node") == F.col("y.node")) & (F.col("x.element") < F.col("y.element")))
    return pairs.groupBy(F.col("x.element").alias("a"), F.col("y.element").alias("b")).agg(F.count("*").alias("n")).filter(F.col("n") >= common)


def heaviest_matches(edges: DataFrame) -> DataFrame:
    """One round of matching for coarsening: pairs ``a < b`` that are each other's heaviest neighbour, ties to the smaller vertex."""
    both = edges.select("a", "b", "w").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).filter("a <> b")
    best = both.groupBy("a").agg(F.max(F.struct("w", (-F.least("a", "b")).alias("low"), (-F.greatest("a", "b")).alias("high"), F.col("b").alias("b"))).alias("m"))
    best = best.select("a", F.col("m.b").alias("b"))
    return best.join(best.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"]).filter("a < b")


def contract(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The graph of merged vertices: edges between labels with summed weights. Labels: ``node, label``."""
    a = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
    b = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    joined = edges.join(a, "a").join(b, "b").filter("la <> lb")
    return joined.groupBy(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).agg(F.sum("w").alias("w"))


def ranked_levels(distances: DataFrame) -> DataFrame:
    """Breadth-first order: ``node, position`` by hops and number, from 0."""
    return sums_before(distances.select("hops", "node"), ["hops", "node"], {"position": F.lit(1)}).select("node", "position")
