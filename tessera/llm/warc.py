"""Resolution of not-modified revisit records of web archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.tables import saved

#: Headers that a 304 answer may bring up to date in the stored response (fixed values, RFC 9110 and 9111).
UPDATABLE = ("age", "cache-control", "date", "etag", "expires", "last-modified", "vary", "warning")
#: Time buckets into which the captures of a URL are split.
BUCKETS = 64


def canonical_url(url: Column) -> Column:
    """A URL for comparison: lower-case scheme and host, http for https, no ``www.``, default port, fragment or slash at the end; query parameters in order.

    Null for null.  Text that is not a URL only loses its fragment and final slash.
    """
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    start = F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1)
    rest = F.substr(bare, F.length(start) + 1)
    site = F.regexp_replace(F.lower(start), "^https://", "http://")
    site = F.regexp_replace(F.regexp_replace(site, r"^(http://)www\.", "$1"), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    ordered = F.array_join(F.array_sort(F.split(query, "&")), "&")
    return F.concat(site, path, F.when(query != "", F.concat(F.lit("?"), ordered)).otherwise(""))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Finds the full response that each not-modified revisit stands for, and merges their headers.

    ``records``: ``record_id long, record_type string`` ("response" or "revisit"), ``url
    string, date timestamp, etag string, last_modified string, headers map<string,string>``
    (lower-case names) and ``payload_sha256 string``.

    Returns per revisit: ``record_id, response_id long`` (null if there is none), ``status
    string``, ``headers map<string,string>`` and ``payload_sha256 string``.  The response is
    the latest one of the same canonical URL with an earlier date, the smallest id on ties.
    Status ``resolved``: its validators agree, that is the revisit's ETag (weak marks aside)
    equals the response's or, where one side has none, its Last-Modified does; without any
    validator to compare it is ``unvalidated`` and resolved too.  ``mismatch``: they differ;
    response_id says which response, headers and payload stay the revisit's own.
    ``missing``: no earlier response.  Merged headers are the response's, with the revisit's
    values of those that a 304 answer may update.

    Method: an as-of join over distinct (URL, date) points.  Quantiles of the dates cut time
    into at most 64 buckets; points are ordered within a URL and bucket, and the last
    response of each bucket carries over to the later ones, so the captures of one URL
    spread over tasks.  Records that share URL and date count as one point.  Headers join by
    response id only after the point is settled; payloads never move.

    Null URLs and null dates have no earlier response.  Null headers count as none.  Every
    revisit row has one result row, repeated ones too; of responses that share id, URL and
    date the one with the smallest validators and payload counts.  Empty tables give no rows;
    other columns are not read.
    """
    keyed = records.select(
        "record_id", "record_type", canonical_url(F.col("url")).alias("url"), "date", "etag", "last_modified", "headers", "payload_sha256"
    )
    edges = records.agg(F.percentile_approx(F.unix_micros(F.col("date").cast("timestamp")), [i / BUCKETS for i in range(1, BUCKETS)])).first()[0] or []
    moment = F.unix_micros(F.col("date").cast("timestamp"))
    bucket = F.size(F.filter(F.array(*map(F.lit, sorted(set(edges)))), lambda e: e < moment)) if edges else F.lit(0)

    points = saved(
        keyed.filter("url is not null and date is not null")
        .groupBy("url", "date")
        .agg(F.min(F.when(F.col("record_type") == "response", F.col("record_id"))).alias("response_id"), F.max(F.col("record_type") == "revisit").alias("asked"))
        .withColumn("bucket", bucket)
    )
    response = F.when(F.col("response_id").isNotNull(), F.struct("response_id", F.col("date").alias("response_date")))
    last = Window.partitionBy("url").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = saved(
        points.groupBy("url", "bucket").agg(F.max_by(response, F.when(F.col("response_id").isNotNull(), F.col("date"))).alias("final"))
        .withColumn("before", F.last("final", ignorenulls=True).over(last))
    )
    inside = Window.partitionBy("url", "bucket").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    settled = points.withColumn("here", F.last(response, ignorenulls=True).over(inside)).filter("asked")
    found = F.coalesce("here", "before")
    earlier = saved(settled.join(carried, ["url", "bucket"]).select("url", "date", found["response_id"].alias("response_id"), found["response_date"].alias("response_date")).filter("response_id is not null"))

    def salted(missing: Column) -> Column:
        """Rows without a partner spread by their own id, so they do not all meet in one place."""
        return F.when(missing, F.xxhash64("record_id")).otherwise(0).alias("salt")

    asked = keyed.filter("record_type = 'revisit'").withColumn("salt", salted(F.col("url").isNull() | F.col("date").isNull()))
    revisits = asked.join(earlier.withColumn("salt", F.lit(0).cast("long")), ["url", "date", "salt"], "left").withColumn("salt", salted(F.col("response_id").isNull()))
    stored = F.struct(F.col("etag").alias("r_etag"), F.col("last_modified").alias("r_modified"), F.col("headers").alias("r_headers"), F.col("payload_sha256").alias("r_payload"))
    responses = (
        keyed.filter("record_type = 'response'")
        .groupBy(F.col("record_id").alias("response_id"), "url", F.col("date").alias("response_date"), F.lit(0).cast("long").alias("salt"))
        .agg(F.min_by(stored, F.struct("etag", "last_modified", "payload_sha256")).alias("stored"))
        .select("response_id", "url", "response_date", "salt", "stored.*")
    )
    both = revisits.join(responses, ["response_id", "url", "response_date", "salt"], "left")
    strong = [F.regexp_replace(F.col(c), "^W/", "") for c in ("etag", "r_etag")]
    agrees = F.coalesce(strong[0] == strong[1], F.col("last_modified") == F.col("r_modified"))
    status = (
        F.when(F.col("response_id").isNull(), "missing").when(agrees.isNull(), "unvalidated").when(agrees, "resolved").otherwise("mismatch")
    )
    nothing = F.create_map().cast("map<string,string>")
    own, stored = F.coalesce("headers", nothing), F.coalesce("r_headers", nothing)
    updates = F.map_filter(own, lambda name, _: name.isin(*UPDATABLE))
    merged = F.map_concat(F.map_filter(stored, lambda name, _: ~F.map_contains_key(updates, name)), updates)
    usable = F.col("status").isin("resolved", "unvalidated")
    return both.withColumn("status", status).select(
        "record_id",
        "response_id",
        "status",
        F.when(usable, merged).otherwise(own).alias("headers"),
        F.when(usable, F.col("r_payload")).otherwise(F.col("payload_sha256")).alias("payload_sha256"),
    )


def page_captures(pages: DataFrame) -> DataFrame:
    """Archive records of the crawled pages: of each page a full response and a not-modified revisit.

    The pages of a host are successive captures of its four parts, so a part has a response
    for every fourth page of the host and a host with many pages has many to choose from.
    Page n is captured in minute n and revisited 10 + n % 50 minutes later, or, every eleventh,
    30 minutes before.  Validators come from the page; every seventh revisit has another ETag
    and every fifth has none.
    """
    n = F.col("page_id")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    minute = F.expr("make_dt_interval(0, 0, cast(page_id as int), 0)")
    part = F.concat(F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1), F.lit("/part"), (n % 4).cast("string"))
    etag = F.concat(F.lit('"'), F.substring(F.sha2(F.col("html").cast("binary"), 256), 1, 16), F.lit('"'))
    day = F.concat(F.lit("day "), (n % 28).cast("string"))
    response = pages.select(
        (2 * n).alias("record_id"),
        F.lit("response").alias("record_type"),
        part.alias("url"),
        (start + minute).alias("date"),
        etag.alias("etag"),
        day.alias("last_modified"),
        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("etag"), etag, F.lit("age"), F.lit("0")).alias("headers"),
        F.sha2(F.col("html").cast("binary"), 256).alias("payload_sha256"),
    )
    seen = F.when(n % 7 == 0, F.lit('"changed"')).when(n % 5 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("W/"), etag))
    revisit = pages.select(
        (2 * n + 1).alias("record_id"),
        F.lit("revisit").alias("record_type"),
        F.concat(F.regexp_replace(part, "^http://", "https://"), F.lit("/#again")).alias("url"),
        (start + minute + F.expr("make_dt_interval(0, 0, cast(if(page_id % 11 = 0, -30, 10 + page_id % 50) as int), 0)")).alias("date"),
        seen.alias("etag"),
        day.alias("last_modified"),
        F.create_map(F.lit("age"), (n % 50).cast("string"), F.lit("content-length"), F.lit("0")).alias("headers"),
        F.lit(None).cast("string").alias("payload_sha256"),
    )
    return response.unionByName(revisit)
