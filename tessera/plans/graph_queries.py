"""Graph, partition, sparse-matrix and case queries over the business tables and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import bags, partition, sparse
from tessera.plans.components import connected_components
from tessera.plans.tables import saved
from tessera.sources import cases, graphs, rules


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def orders_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of customers (even nodes) and suppliers (odd nodes) of one nation and balance class."""
    customers, suppliers = _read(spark, sf_dir, "customer"), _read(spark, sf_dir, "supplier")
    c = customers.select((F.col("c_custkey") * 2).alias("node"), F.col("c_nationkey").alias("nation"), F.floor(F.col("c_acctbal") / 1000).alias("level"))
    s = suppliers.select((F.col("s_suppkey") * 2 + 1).alias("node"), F.col("s_nationkey").alias("nation"), F.floor(F.col("s_acctbal") / 1000).alias("level"))
    # A link to the smallest node of a class stands for those to all of the other kind: a row for each node.
    both = c.unionByName(s)
    classes = both.groupBy("nation", "level").agg(F.min("node").alias("first"), F.count_if(F.col("node") % 2 == 0).alias("buyers"), F.count_if(F.col("node") % 2 == 1).alias("sellers"))
    return connected_components(both.join(classes.filter("buyers > 0 and sellers > 0"), ["nation", "level"]).select(F.col("node").alias("a"), F.col("first").alias("b")))


def _trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A contact for each line item between the nations of customer and supplier; the level follows the line number."""
    items, orders = _read(spark, sf_dir, "lineitem"), _read(spark, sf_dir, "orders")
    joined = (
        items.join(orders, items["l_orderkey"] == orders["o_orderkey"])
        .join(_read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(_read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    )
    return joined.select(F.col("c_nationkey").cast("long").alias("a"), F.col("s_nationkey").cast("long").alias("b"), (F.col("l_linenumber") % 4).cast("int").alias("level"))


_TRADE = """
    SELECT c_nationkey::BIGINT AS a, s_nationkey::BIGINT AS b, (l_linenumber % 4)::INTEGER AS level
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
"""


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between nations with their traffic and the time of their messages."""
    edges = partition.edge_totals(_trade(spark, sf_dir), [], 8.0)
    return edges.withColumn("time", partition.message_time(F.col("phases"), F.col("bytes"), 2.0, 64.0))


_TRADE_EDGES = f"""
    WITH n AS (SELECT least(a, b) AS lo, greatest(a, b) AS hi, level, count(*) AS n FROM ({_TRADE}) WHERE a <> b GROUP BY ALL)
    SELECT lo, hi, sum(n)::BIGINT AS contacts, sum(n * 2.0 ** level)::DOUBLE AS weight, sum(8 * n * 2.0 ** level)::DOUBLE AS bytes, bit_or((1 << level)::BIGINT) AS phases,
           (sum(DISTINCT 2 ** level) * 2 + sum(8 * n * 2.0 ** level) / 64)::DOUBLE AS time FROM n GROUP BY lo, hi
"""


def _atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders of one month as an atom over the range of their days, with their number as work."""
    orders = _read(spark, sf_dir, "orders")
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("long")
    month = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    return (
        orders.groupBy("o_custkey", month.alias("month"))
        .agg(F.min(day).alias("lo"), (F.max(day) + 1).alias("hi"), F.count("*").cast("double").alias("work"))
        .select((F.col("o_custkey") * 100000 + F.col("month")).alias("atom_id"), "lo", "hi", "work", "o_custkey")
    )


_ATOMS = """
    SELECT o_custkey * 100000 + year(o_orderdate) * 12 + month(o_orderdate) AS atom_id, min(date_diff('day', DATE '1990-01-01', o_orderdate::DATE)) AS lo,
           max(date_diff('day', DATE '1990-01-01', o_orderdate::DATE)) + 1 AS hi, count(*)::DOUBLE AS work, o_custkey FROM orders GROUP BY 1, o_custkey
"""


def legal_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days at which no customer of a nation is between the first and last order of a month."""
    customers = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return partition.legal_cuts(_atoms(spark, sf_dir).join(customers, "o_custkey"), "c_nationkey")


def rank_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads and boxes of eight ranks that share the atoms by key."""
    atoms = _atoms(spark, sf_dir)
    return partition.rank_loads(atoms, atoms.select("atom_id", (F.col("atom_id") % 8).alias("rank")))


def load_imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    loads = rank_loads(spark, sf_dir)
    return partition.imbalance(loads).withColumn("imbalance", F.round("imbalance", 9))


def bisection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners of the atoms after two weighted bisections."""
    return partition.bisected(_atoms(spark, sf_dir), 2)


_HALF = """
    SELECT atom_id, lo, work, rank * 2 + (CASE WHEN upto - w / 2 > total / 2 THEN 1 ELSE 0 END) AS rank FROM (
        SELECT a.*, c.upto, c.w, c.total FROM {0} a JOIN (
            SELECT rank, lo, w, sum(w) OVER (PARTITION BY rank ORDER BY lo) AS upto, sum(w) OVER (PARTITION BY rank) AS total
            FROM (SELECT rank, lo, sum(work) AS w FROM {0} GROUP BY rank, lo)) c USING (rank, lo))
"""


def _customer_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("atom_id"), (F.col("c_custkey") % 8).alias("rank"))


def rank_ghosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that ranks need from each other along a star for each supplier: from its smallest customer to its others, not between those."""
    items, orders = _read(spark, sf_dir, "lineitem"), _read(spark, sf_dir, "orders")
    bought = items.join(orders, items["l_orderkey"] == orders["o_orderkey"]).select("l_suppkey", F.col("o_custkey").alias("c")).distinct()
    first = bought.groupBy("l_suppkey").agg(F.min("c").alias("a"))
    edges = bought.join(first, "l_suppkey").filter("a < c").select("a", F.col("c").alias("b")).distinct()
    return partition.ghosts(edges, _customer_ranks(spark, sf_dir))


def local_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers under which the eight ranks hold their own customers and those of others."""
    return partition.local_views(_customer_ranks(spark, sf_dir), rank_ghosts(spark, sf_dir))


_GHOSTS = """
    WITH l AS (SELECT DISTINCT l_suppkey, o_custkey AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    e AS (SELECT DISTINCT f.a, l.c AS b FROM l JOIN (SELECT l_suppkey, min(c) AS a FROM l GROUP BY 1) f USING (l_suppkey) WHERE f.a < l.c AND f.a % 8 <> l.c % 8)
    SELECT a % 8 AS rank, b % 8 AS peer, b AS atom_id FROM e UNION SELECT b % 8, a % 8, a FROM e
"""


def _flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trade(spark, sf_dir).filter("a <> b").groupBy("a", "b").agg(F.count("*").cast("double").alias("w"))


_FLOW = f"SELECT a, b, count(*)::DOUBLE AS w FROM ({_TRADE}) WHERE a <> b GROUP BY a, b"


def nation_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse.page_rank(_flow(spark, sf_dir), 5).withColumn("rank", F.round("rank", 9))


def _market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers (even nodes) and suppliers (odd ones) in both directions, weighted by their line items."""
    items, orders = _read(spark, sf_dir, "lineitem"), _read(spark, sf_dir, "orders")
    sold = items.join(orders, items["l_orderkey"] == orders["o_orderkey"]).groupBy((F.col("o_custkey") * 2).alias("a"), (F.col("l_suppkey") * 2 + 1).alias("b")).agg(F.count("*").cast("double").alias("w"))
    return saved(sold.unionByName(sold.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")))


_MARKET = """
    market AS MATERIALIZED (SELECT o_custkey * 2 AS a, l_suppkey * 2 + 1 AS b, count(*)::DOUBLE AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
    e AS MATERIALIZED (SELECT a, b, w FROM market UNION ALL SELECT b, a, w FROM market)
"""


def market_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PageRank of customers and suppliers for a walk that restarts at the suppliers of nation 0, or of all nations if it has none."""
    suppliers = _read(spark, sf_dir, "supplier")
    chosen = suppliers.filter("s_nationkey = 0")
    count = chosen.count()
    chosen, count = (chosen, count) if count else (suppliers, suppliers.count())
    home = chosen.select((F.col("s_suppkey") * 2 + 1).alias("node"), F.lit(1.0 / max(count, 1)).alias("share"))
    return sparse.page_rank(_market(spark, sf_dir), 4, restart=home).withColumn("rank", F.round("rank", 9))


def part_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of nations: customers and suppliers of a nation that trade with each other."""
    customers = _read(spark, sf_dir, "customer").select((F.col("c_custkey") * 2).alias("node"), F.col("c_nationkey").alias("part"))
    suppliers = _read(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 2 + 1).alias("node"), F.col("s_nationkey").alias("part"))
    return partition.part_components(_market(spark, sf_dir).filter("a < b"), customers.unionByName(suppliers))


def market_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortest paths from supplier 1 over customers and suppliers, an edge costing 12 over its line items, rounded up."""
    cost = _market(spark, sf_dir).withColumn("w", F.ceil(12 / F.col("w")).cast("double"))
    return sparse.shortest_paths(cost, 3)


def nation_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations that are each other's largest trading partners."""
    return graphs.heaviest_matches(partition.edge_totals(_trade(spark, sf_dir), [], 8.0).select(F.col("lo").alias("a"), F.col("hi").alias("b"), F.col("contacts").alias("w")))


def order_dual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that share two parts or more."""
    items = _read(spark, sf_dir, "lineitem")
    return graphs.mesh_dual(items.select(F.col("l_orderkey").alias("element"), F.col("l_partkey").alias("node")), 2)


def nation_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortest paths from nation 0, an edge costing 1000 over its trade, rounded up."""
    cost = _flow(spark, sf_dir).withColumn("w", F.ceil(1000 / F.col("w")).cast("double"))
    return sparse.shortest_paths(cost, 0)


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the words of all documents as matrix entries: row doc_id, col the word. Written once, as callers read them more than once."""
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1))
    return saved(_read(spark, sf_dir, "documents").select(F.col("doc_id").alias("row"), word.alias("col")).groupBy("row", "col").agg(F.count("*").cast("double").alias("val")))


_WORDS = "SELECT doc_id AS row, col, count(*)::DOUBLE AS val FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS col FROM documents) GROUP BY ALL"


def pruned_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = sparse.prune(_words(spark, sf_dir), "col", 2, 20)
    return kept.groupBy("row").agg(F.count("*").alias("n"), F.sum("val").alias("total"))


def weighted_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Norms of the rows after scaling by inverse document frequency."""
    return sparse.norms(sparse.scale(_words(spark, sf_dir), "idf"), "row").select("row", "n", F.round("norm", 6).alias("norm"))


def top_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse.top_entries(_words(spark, sf_dir), "row", 5, 20.0).select("row", "col", "val")


def heavy_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse.heaviest(_words(spark, sf_dir), "row", 0.5).groupBy("row").agg(F.count("*").alias("n"), F.min("val").alias("least"))


def marked_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse.above_mean(_words(spark, sf_dir), "row", 4.0).groupBy("row").agg(F.count("*").alias("n"), F.sum("val").alias("total"))


def _similar(spark: SparkSession, sf_dir: str, least: float, measure: str = "jaccard", every: bool = False) -> DataFrame:
    """The three most similar documents of each by their words."""
    documents = _read(spark, sf_dir, "documents")
    found = bags.similar_bags(bags.word_bags(documents, "doc_id", "text"), documents.count(), 3, least, measure, every)
    return found.withColumn("similarity", F.round("similarity", 9))


def similar_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most similar documents by the sets of all their words, of those with half of them in common."""
    return _similar(spark, sf_dir, 0.5)


def similar_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most similar documents by all their words, however many documents have them, of those with a tenth in common."""
    return _similar(spark, sf_dir, 0.1, every=True)


def similar_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most similar documents by the counts of all their words."""
    return _similar(spark, sf_dir, 0.6, "min")


def score_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the length of a text tells good documents from bad ones."""
    scored = _read(spark, sf_dir, "documents").join(_read(spark, sf_dir, "labels"), "doc_id")
    return sparse.roc(scored, "n_chars", "quality").withColumn("area", F.round("area", 9))


def alike_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three documents that hold most of a document's words, counted as often as it has them, however frequent they are."""
    return _similar(spark, sf_dir, 0.8, "amin")


def dampened_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of the rows after scaling by dampened inverse document frequency."""
    return sparse.norms(sparse.scale(_words(spark, sf_dir), "idf2"), "row").select("row", "n", F.round("total", 6).alias("total"))


def length_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well a list of the longest texts first holds the good ones."""
    scored = _read(spark, sf_dir, "documents").join(_read(spark, sf_dir, "labels"), "doc_id")
    found = sparse.ranking(scored, "n_chars", "quality", "doc_id")
    return found.withColumns({c: F.round(c, 9) for c in ("accuracy", "median_false")})


def first_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many good texts a list of the longest texts first holds before its hundredth bad one."""
    scored = _read(spark, sf_dir, "documents").join(_read(spark, sf_dir, "labels"), "doc_id")
    return sparse.first_negatives(scored, "n_chars", "quality", "doc_id", 100).withColumn("area", F.round("area", 9))


def _parts_bought(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities that customers bought of parts, as matrix entries."""
    items = _read(spark, sf_dir, "lineitem").join(_read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return saved(items.groupBy(F.col("o_custkey").alias("row"), F.col("l_partkey").alias("col")).agg(F.sum(F.col("l_quantity").cast("double")).alias("val")))


_BOUGHT = "SELECT o_custkey AS row, l_partkey AS col, sum(l_quantity::DOUBLE) AS val FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2"


def nation_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix of what customers buy, cut into one for each nation with rows numbered within it; its size and a sum over its places."""
    parts = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row"), F.col("c_nationkey").cast("long").alias("part"))
    cut = sparse.part_rows(_parts_bought(spark, sf_dir), parts)
    return cut.groupBy("part").agg(F.count("*").alias("entries"), F.max("row").alias("last_row"), F.sum(F.col("row") * F.col("val")).cast("long").alias("places"))


def shuffled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of what customers buy, under their places in a random order of all customers."""
    order = sparse.permutation(_read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), 7)
    return sparse.norms(sparse.renumbered(_parts_bought(spark, sf_dir), order), "row").select("row", "n", "total")


def _pair_query(measure: str, whole: bool):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """How alike each customer and the next one buy."""
        pairs = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 1).alias("b"))
        found = sparse.pair_similarity(_parts_bought(spark, sf_dir), pairs, measure, whole)
        return found.withColumn("similarity", F.round("similarity", 9))

    return run


def _pair_sql(measure: str, whole: bool) -> str:
    size, common = ("val * val", "x.val * y.val") if measure in ("cosine", "tanimoto") else ("val", "least(x.val, y.val)")
    cut = "" if whole else " AND e.col <= l.last"
    divisor = {"cosine": "sqrt(sa * sb)", "amin": "sa"}.get(measure, "sa + sb - coalesce(c, 0)")
    return f"""
        WITH e AS MATERIALIZED ({_BOUGHT}), m AS (SELECT row, max(col) AS last FROM e GROUP BY row),
        l AS MATERIALIZED (SELECT c_custkey AS a, c_custkey + 1 AS b, CASE WHEN p.last IS NULL OR q.last IS NULL THEN NULL ELSE least(p.last, q.last) END AS last FROM customer LEFT JOIN m p ON p.row = c_custkey LEFT JOIN m q ON q.row = c_custkey + 1),
        p AS (SELECT a, sum({size}) AS sa FROM l JOIN e ON e.row = a{cut} GROUP BY a), q AS (SELECT a, sum({size}) AS sb FROM l JOIN e ON e.row = b{cut} GROUP BY a),
        x AS (SELECT a, sum({common}) AS c FROM l JOIN e x ON x.row = a JOIN e y ON y.row = b AND x.col = y.col GROUP BY a),
        j AS (SELECT l.a, l.b, c, coalesce(sa, 0) AS sa, coalesce(sb, 0) AS sb FROM l LEFT JOIN p USING (a) LEFT JOIN q USING (a) LEFT JOIN x USING (a))
        SELECT a, b, round(coalesce(CASE WHEN {divisor} > 0 THEN coalesce(c, 0) / ({divisor}) END, 0), 9) AS similarity FROM j
    """


#: Queries of pairs by measure, and whether all columns count.
_PAIRS = {"cosine_pairs": ("cosine", True), "tanimoto_pairs": ("tanimoto", True), "least_pairs": ("min", True), "held_pairs": ("amin", False)}


def item_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of two and three parts that at least two orders have together."""
    parts = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("col"))
    return sparse.item_sets(parts, 2, None, 2, 3).select(F.array_join("items", ",").alias("items"), "freq")


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and type."""
    hour = F.window("ts", "1 hour")
    return _read(spark, sf_dir, "events").groupBy(hour.alias("w"), "event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users")).select(F.col("w.start").alias("hour"), "event_type", "n", "users")


def case_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case files written from parts, parsed again: values in SI units."""
    part = _read(spark, sf_dir, "part")
    text = F.concat_ws(
        "\n",
        F.lit("# a comment"),
        F.concat(F.lit("Dynamic-Viscosity = "), F.col("p_size").cast("string"), F.lit(" mPa*s")),
        F.concat(F.lit("rho: "), (1000 + F.col("p_size")).cast("string"), F.lit(" kg/m^3")),
        F.concat(F.lit("characteristic length = "), F.col("p_size").cast("string"), F.lit(" cm   # along x")),
        F.when(F.col("p_partkey") % 2 == 0, F.lit("periodic_x = on")),
        F.concat(F.lit("case name = '"), F.col("p_brand"), F.lit("'")),
        F.when(F.col("p_partkey") % 5 == 0, F.lit("wall = 3 furlong")),
    )
    parsed = cases.parse_cases(cases.case_lines(part.select(F.col("p_partkey").alias("case_id"), text.alias("text"))))
    return parsed.select("case_id", "line_no", "name", "kind", F.round("value", 9).alias("value"), F.array_join("dims", ",").alias("dims"), "flag", "word")


def case_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases from orders, completed by the rules: derived values and the number of warnings of viscosity and of the range of Mach number and relaxation time; ``case_verdicts`` has all."""
    orders = _read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    stated = {
        "density": F.lit(1000.0), "dynamic_viscosity": (1 + k % 5).cast("double") / 1000, "kinematic_viscosity": F.when(k % 3 == 0, 1e-6), "reynolds_number": (100 + k % 50).cast("double"),
        "characteristic_length": F.lit(0.1), "grid_spacing": F.lit(0.005), "relaxation_time": F.when(k % 2 == 0, 0.6 + (k % 20) / 10), "mach_number": F.lit(0.05), "physical_time": F.lit(10.0),
    }
    case = orders.select(k.alias("case_id"), *((stated.get(c, F.lit(None)).cast("double")).alias(c) for c in rules.CASE_COLUMNS))
    done = rules.complete(case)
    return done.select(
        "case_id", F.round("characteristic_velocity", 9).alias("velocity"), F.round("relaxation_time", 9).alias("tau"), F.round("mach_number", 9).alias("mach"),
        F.round("time_step", 9).alias("time_step"), F.size(F.filter("warnings", lambda w: w.rlike("^kinematic|above|below"))).alias("n_warnings"), F.size("missing").alias("n_missing"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        orders_components, trade_edges, legal_cuts, rank_loads, load_imbalance, bisection, rank_ghosts, local_views, nation_rank, market_rank, part_components, market_paths, nation_matches, order_dual, nation_paths, pruned_words, weighted_words, top_words,
        heavy_words, marked_words, similar_documents, similar_texts, similar_counts, alike_documents, dampened_words, length_ranking, score_area, first_negatives, nation_matrices, shuffled_rows, item_sets, event_windows, case_values, case_rules,
    )
} | {name: _pair_query(*how) for name, how in _PAIRS.items()}


def _page_rank_sql(rounds: int) -> str:
    steps = [
        f"WITH e AS MATERIALIZED ({_FLOW}), n AS MATERIALIZED (SELECT a AS node FROM e UNION SELECT b FROM e), o AS MATERIALIZED (SELECT a, sum(w) AS s FROM e GROUP BY a)",
        "r0 AS (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM n) AS rank FROM n)",
    ]
    for i in range(rounds):
        steps.append(f"""r{i + 1} AS MATERIALIZED (
            SELECT n.node, (0.15 + 0.85 * coalesce((SELECT sum(rank) FROM r{i} WHERE node NOT IN (SELECT a FROM o)), 0)) / (SELECT count(*) FROM n) + 0.85 * coalesce(m.s, 0) AS rank
            FROM n LEFT JOIN (SELECT e.b, sum(r.rank * e.w / o.s) AS s FROM e JOIN o ON e.a = o.a JOIN r{i} r ON r.node = e.a GROUP BY e.b) m ON n.node = m.b)""")
    return ", ".join(steps) + f" SELECT node, round(rank, 9) AS rank FROM r{rounds}"


def _paths_sql(edges: str, start: int, rounds: int) -> str:
    steps = [edges, f"p0 AS (SELECT {start}::BIGINT AS node, 0.0::DOUBLE AS distance, 0::BIGINT AS hops)"]
    for i in range(rounds):
        steps.append(f"""p{i + 1} AS MATERIALIZED (SELECT node, distance, hops FROM (
            SELECT *, row_number() OVER (PARTITION BY node ORDER BY distance, hops) AS k FROM (
                SELECT * FROM p{i} UNION ALL SELECT e.b, p.distance + e.w, p.hops + 1 FROM p{i} p JOIN e ON e.a = p.node)) WHERE k = 1)""")
    return ", ".join(steps) + f" SELECT * FROM p{rounds}"


def _market_rank_sql(rounds: int) -> str:
    steps = [
        f"WITH {_MARKET}, o AS MATERIALIZED (SELECT a, sum(w) AS s FROM e GROUP BY a)",
        "c AS (SELECT s_suppkey * 2 + 1 AS node FROM supplier WHERE s_nationkey = 0 OR NOT EXISTS (SELECT * FROM supplier WHERE s_nationkey = 0))",
        "n AS MATERIALIZED (SELECT node, sum(share) AS share FROM (SELECT a AS node, 0 AS share FROM e UNION ALL SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM c) FROM c) GROUP BY node)",
        "r0 AS (SELECT node, share AS rank FROM n)",
    ]
    for i in range(rounds):
        steps.append(f"""r{i + 1} AS MATERIALIZED (
            SELECT n.node, (0.15 + 0.85 * coalesce((SELECT sum(rank) FROM r{i} WHERE node NOT IN (SELECT a FROM o)), 0)) * n.share + 0.85 * coalesce(m.s, 0) AS rank
            FROM n LEFT JOIN (SELECT e.b, sum(r.rank * e.w / o.s) AS s FROM e JOIN o ON e.a = o.a JOIN r{i} r ON r.node = e.a GROUP BY e.b) m ON n.node = m.b)""")
    return ", ".join(steps) + f" SELECT node, round(rank, 9) AS rank FROM r{rounds}"


_RARE = f"SELECT * FROM w WHERE col IN (SELECT col FROM w GROUP BY col HAVING count(*) BETWEEN 2 AND 20)"

SQL = {
    "orders_components": """
        WITH RECURSIVE e AS (
            SELECT c_custkey * 2 AS a, s_suppkey * 2 + 1 AS b FROM customer JOIN supplier
            ON c_nationkey = s_nationkey AND floor(c_acctbal / 1000) = floor(s_acctbal / 1000)
        ), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        reach AS (SELECT a AS node, a AS seen FROM u UNION SELECT r.node, u.b FROM reach r JOIN u ON r.seen = u.a)
        SELECT node, min(seen) AS component FROM reach GROUP BY node
    """,
    "trade_edges": _TRADE_EDGES,
    "legal_cuts": f"""
        SELECT c_nationkey, plane, below FROM (
            SELECT c_nationkey, max(hi) OVER w AS top, lead(lo) OVER (PARTITION BY c_nationkey ORDER BY lo, atom_id) AS plane, sum(work) OVER w AS below
            FROM ({_ATOMS}) JOIN customer ON o_custkey = c_custkey WINDOW w AS (PARTITION BY c_nationkey ORDER BY lo, atom_id ROWS UNBOUNDED PRECEDING)) WHERE top <= plane
    """,
    "rank_loads": f"SELECT atom_id % 8 AS rank, count(*) AS atoms, sum(work) AS work, min(lo) AS lo, max(hi) AS hi, max(work) AS largest FROM ({_ATOMS}) GROUP BY 1",
    "load_imbalance": f"""
        SELECT count(*) AS ranks, sum(work) AS total, max(work) AS most, round(max(work) / avg(work), 9) AS imbalance
        FROM (SELECT atom_id % 8 AS rank, sum(work) AS work FROM ({_ATOMS}) GROUP BY 1)
    """,
    "bisection": f"""
        WITH a0 AS MATERIALIZED (SELECT atom_id, lo, work, 0::BIGINT AS rank FROM ({_ATOMS})), a1 AS MATERIALIZED ({_HALF.format("a0")}), a2 AS ({_HALF.format("a1")})
        SELECT atom_id, rank::BIGINT AS rank FROM a2
    """,
    "rank_ghosts": _GHOSTS,
    "local_views": f"""
        SELECT rank, ghost, atom_id, row_number() OVER (PARTITION BY rank ORDER BY ghost, atom_id) - 1 AS local FROM (
            SELECT c_custkey % 8 AS rank, false AS ghost, c_custkey AS atom_id FROM customer UNION SELECT rank, true, atom_id FROM ({_GHOSTS}))
    """,
    "nation_rank": _page_rank_sql(5),
    "nation_matches": f"""
        WITH e AS (SELECT least(a, b) AS lo, greatest(a, b) AS hi, count(*) AS w FROM ({_TRADE}) WHERE a <> b GROUP BY ALL),
        s AS (SELECT lo AS a, hi AS b, w, lo, hi FROM e UNION ALL SELECT hi, lo, w, lo, hi FROM e),
        m AS (SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY w DESC, lo, hi) AS k FROM s) WHERE k = 1)
        SELECT x.a, x.b FROM m x JOIN m y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b
    """,
    "order_dual": """
        WITH i AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem)
        SELECT x.o AS a, y.o AS b, count(*) AS n FROM i x JOIN i y ON x.p = y.p AND x.o < y.o GROUP BY 1, 2 HAVING count(*) >= 2
    """,
    "nation_paths": _paths_sql(f"WITH e AS MATERIALIZED (SELECT a, b, ceil(1000 / w) AS w FROM ({_FLOW}))", 0, 10),
    "market_rank": _market_rank_sql(4),
    "part_components": f"""
        WITH RECURSIVE {_MARKET},
        n AS (SELECT c_custkey * 2 AS node, c_nationkey AS part FROM customer UNION ALL SELECT s_suppkey * 2 + 1, s_nationkey FROM supplier),
        i AS MATERIALIZED (SELECT e.a, e.b FROM e JOIN n x ON e.a = x.node JOIN n y ON e.b = y.node WHERE x.part = y.part),
        r AS (SELECT a AS node, b AS seen FROM i UNION SELECT r.node, i.b FROM r JOIN i ON r.seen = i.a)
        SELECT n.node, n.part, coalesce(least(min(seen), n.node), n.node) AS component FROM n LEFT JOIN r ON n.node = r.node GROUP BY n.node, n.part
    """,
    "market_paths": _paths_sql(f"WITH {_MARKET.replace('SELECT a, b, w FROM market UNION ALL SELECT b, a, w', 'SELECT a, b, ceil(12 / w) AS w FROM market UNION ALL SELECT b, a, ceil(12 / w)')}", 3, 12),
    "pruned_words": f"WITH w AS MATERIALIZED ({_WORDS}) SELECT row, count(*) AS n, sum(val) AS total FROM ({_RARE}) GROUP BY row",
    "weighted_words": f"""
        WITH w AS MATERIALIZED ({_WORDS}), d AS (SELECT col, ln((SELECT count(DISTINCT row) FROM w) / count(*)) AS f FROM w GROUP BY col)
        SELECT row, count(*) AS n, round(sqrt(sum((val * f) ** 2)), 6) AS norm FROM w JOIN d USING (col) GROUP BY row
    """,
    "top_words": f"SELECT row, col, val FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY val DESC, col) AS k FROM ({_WORDS})) WHERE k <= 5 OR val >= 20",
    "heavy_words": f"""
        SELECT row, count(*) AS n, min(val) AS least FROM (
            SELECT row, val, coalesce(sum(val * val) OVER (PARTITION BY row ORDER BY val DESC, col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                   sum(val * val) OVER (PARTITION BY row) AS total FROM ({_WORDS})) WHERE before < 0.5 * total GROUP BY row
    """,
    "marked_words": f"""
        SELECT row, count(*) AS n, sum(val) AS total FROM (SELECT row, val, avg(val) OVER (PARTITION BY row) AS mean FROM ({_WORDS})) WHERE val > 4 * mean GROUP BY row
    """,
    "similar_documents": f"""
        WITH r AS MATERIALIZED ({_WORDS}), n AS (SELECT row, count(*) AS n FROM r GROUP BY row),
        c AS (SELECT x.row AS row, y.row AS other, count(*) AS c FROM r x JOIN r y ON x.col = y.col AND x.row <> y.row GROUP BY 1, 2),
        s AS (SELECT c.row, c.other, c.c / (a.n + b.n - c.c) AS similarity FROM c JOIN n a ON c.row = a.row JOIN n b ON c.other = b.row)
        SELECT row, other, round(similarity, 9) AS similarity, rank FROM (
            SELECT *, row_number() OVER (PARTITION BY row ORDER BY similarity DESC, other)::INTEGER AS rank FROM s WHERE similarity >= 0.5) WHERE rank <= 3
    """,
    "similar_texts": f"""
        WITH r AS MATERIALIZED ({_WORDS}), n AS (SELECT row, count(*) AS n FROM r GROUP BY row),
        c AS (SELECT x.row AS row, y.row AS other, count(*) AS c FROM r x JOIN r y ON x.col = y.col AND x.row <> y.row GROUP BY 1, 2),
        s AS (SELECT c.row, c.other, c.c / (a.n + b.n - c.c) AS similarity FROM c JOIN n a ON c.row = a.row JOIN n b ON c.other = b.row)
        SELECT row, other, round(similarity, 9) AS similarity, rank FROM (
            SELECT *, row_number() OVER (PARTITION BY row ORDER BY similarity DESC, other)::INTEGER AS rank FROM s WHERE similarity >= 0.1) WHERE rank <= 3
    """,
    "similar_counts": f"""
        WITH r AS MATERIALIZED ({_WORDS}), n AS (SELECT row, sum(val) AS n FROM r GROUP BY row),
        c AS (SELECT x.row AS row, y.row AS other, sum(least(x.val, y.val)) AS c FROM r x JOIN r y ON x.col = y.col AND x.row <> y.row GROUP BY 1, 2),
        s AS (SELECT c.row, c.other, c.c / (a.n + b.n - c.c) AS similarity FROM c JOIN n a ON c.row = a.row JOIN n b ON c.other = b.row)
        SELECT row, other, round(similarity, 9) AS similarity, rank FROM (
            SELECT *, row_number() OVER (PARTITION BY row ORDER BY similarity DESC, other)::INTEGER AS rank FROM s WHERE similarity >= 0.6) WHERE rank <= 3
    """,
    "alike_documents": f"""
        WITH r AS MATERIALIZED ({_WORDS}), n AS (SELECT row, sum(val) AS n FROM r GROUP BY row),
        c AS (SELECT x.row AS row, y.row AS other, sum(least(x.val, y.val)) AS c FROM r x JOIN r y ON x.col = y.col AND x.row <> y.row GROUP BY 1, 2),
        s AS (SELECT c.row, c.other, c.c / n.n AS similarity FROM c JOIN n ON c.row = n.row)
        SELECT row, other, round(similarity, 9) AS similarity, rank FROM (
            SELECT *, row_number() OVER (PARTITION BY row ORDER BY similarity DESC, other)::INTEGER AS rank FROM s WHERE similarity >= 0.8) WHERE rank <= 3
    """,
    "dampened_words": f"""
        WITH w AS MATERIALIZED ({_WORDS}), h AS (SELECT col, count(*) AS h FROM w GROUP BY col),
        a AS (SELECT count(DISTINCT row) AS rows, greatest(10, floor(0.5 * count(*) / count(DISTINCT col))) AS f FROM w)
        SELECT row, count(*) AS n, round(sum(val * ln((rows + 2 * f) / (f + h))), 6) AS total FROM w JOIN h USING (col), a GROUP BY row
    """,
    "length_ranking": """
        WITH s AS (SELECT d.doc_id, n_chars, coalesce(quality, 0) AS p FROM documents d JOIN labels l USING (doc_id)),
        t AS (SELECT *, sum(p) OVER o AS tp, sum(1 - p) OVER o AS fp, count(*) OVER () AS n, sum(p) OVER () AS pos FROM s WINDOW o AS (ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING))
        SELECT any_value(n) AS n, any_value(pos)::BIGINT AS positives, round(max((tp + n - pos - fp) * 100.0::DOUBLE / n), 9) AS accuracy,
               round(max(fp) FILTER (WHERE p = 1 AND tp = (pos + 1) // 2) / any_value(n - pos)::DOUBLE, 9) AS median_false FROM t
    """,
    "first_negatives": """
        WITH s AS (SELECT d.doc_id, n_chars, coalesce(quality, 0) AS p FROM documents d JOIN labels l USING (doc_id)),
        t AS (SELECT *, coalesce(sum(1 - p) OVER (ORDER BY n_chars DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fp, sum(p) OVER () AS pos FROM s),
        l AS (SELECT n_chars, any_value(pos) AS pos, sum(p) AS p, sum(1 - p) AS q FROM t WHERE fp < 100 GROUP BY n_chars),
        c AS (SELECT *, coalesce(sum(p) OVER (ORDER BY n_chars DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l)
        SELECT any_value(pos)::BIGINT AS positives, sum(p)::BIGINT AS tp, sum(q)::BIGINT AS fp, round(CASE WHEN sum(p) * sum(q) > 0 THEN sum((2 * before + p) * q // 2)::DOUBLE / (any_value(pos) * sum(q))::DOUBLE ELSE 0 END, 9) AS area FROM c
    """,
    "nation_matrices": f"""
        WITH r AS (SELECT c_custkey AS row, c_nationkey::BIGINT AS part, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS place FROM customer)
        SELECT part, count(*) AS entries, max(place) AS last_row, sum(place * val)::BIGINT AS places FROM ({_BOUGHT}) JOIN r USING (row) GROUP BY part
    """,
    "shuffled_rows": f"""
        WITH r AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY md5('7:' || c_custkey), c_custkey) - 1 AS row FROM customer)
        SELECT r.row, count(*) AS n, sum(val) AS total FROM ({_BOUGHT}) e JOIN r ON e.row = r.id GROUP BY r.row
    """,
    **{name: _pair_sql(*how) for name, how in _PAIRS.items()},
    "score_area": """
        WITH d AS (SELECT n_chars AS s, quality AS q FROM documents JOIN labels USING (doc_id)),
        l AS (SELECT s, sum(q) AS p, count(*) - sum(q) AS m FROM d GROUP BY s),
        c AS (SELECT *, coalesce(sum(m) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM l)
        SELECT sum(p + m)::BIGINT AS n, sum(p)::BIGINT AS positives, round(sum(p * (below + m / 2)) / (sum(p) * sum(m)), 9) AS area FROM c
    """,
    "item_sets": """
        WITH i AS MATERIALIZED (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem),
        t AS MATERIALIZED (SELECT a.o, a.p AS x, b.p AS y FROM i a JOIN i b ON a.o = b.o AND a.p < b.p)
        SELECT x || ',' || y AS items, count(*) AS freq FROM t GROUP BY x, y HAVING count(*) >= 2 UNION ALL
        SELECT x || ',' || y || ',' || p, count(*) FROM t JOIN i ON t.o = i.o AND i.p > y GROUP BY x, y, p HAVING count(*) >= 2
    """,
    "event_windows": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2",
    "case_values": """
        SELECT p_partkey AS case_id, 2 AS line_no, 'dynamic_viscosity' AS name, 'quantity' AS kind, round(p_size / 1000, 9) AS value, '-1,1,-1,0' AS dims, NULL::BOOLEAN AS flag, NULL AS word FROM part
        UNION ALL SELECT p_partkey, 3, 'density', 'quantity', 1000.0 + p_size, '-3,1,0,0', NULL, NULL FROM part
        UNION ALL SELECT p_partkey, 4, 'characteristic_length', 'quantity', round(p_size / 100, 9), '1,0,0,0', NULL, NULL FROM part
        UNION ALL SELECT p_partkey, 5, 'periodic_x', 'bool', NULL, NULL, true, NULL FROM part WHERE p_partkey % 2 = 0
        UNION ALL SELECT p_partkey, 5 + (p_partkey % 2 = 0)::INTEGER, 'case_name', 'string', NULL, NULL, NULL, p_brand FROM part
        UNION ALL SELECT p_partkey, 6 + (p_partkey % 2 = 0)::INTEGER, 'wall', 'error', NULL, NULL, NULL, NULL FROM part WHERE p_partkey % 5 = 0
    """,
    "case_rules": """
        WITH c AS (SELECT o_orderkey AS k, (1 + o_orderkey % 5) / 1e6 AS nu, (100 + o_orderkey % 50)::DOUBLE AS re, 20.0::DOUBLE AS cells FROM orders),
        t AS (SELECT *, re * nu / 0.1 AS u, CASE WHEN k % 2 = 0 THEN 0.6 + (k % 20) / 10 ELSE 0.5 + 3 * (0.05 / sqrt(3) * cells / re) END AS tau FROM c),
        v AS (SELECT *, re * ((tau - 0.5) / 3) / cells AS ul FROM t)
        SELECT k AS case_id, round(u, 9) AS velocity, round(tau, 9) AS tau, round(ul * sqrt(3), 9) AS mach, round(0.005 * ul / u, 9) AS time_step,
               ((k % 3 = 0)::INTEGER + (ul * sqrt(3) > 0.1)::INTEGER + (tau < 0.55)::INTEGER + (tau > 2)::INTEGER) AS n_warnings, 0 AS n_missing FROM v
    """,
}
