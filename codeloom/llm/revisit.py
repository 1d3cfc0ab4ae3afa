"""Resolution of WARC revisit records of the profile server-not-modified.

A revisit finds, by canonical URL, the latest full response captured before it: an
as-of join. Order is (ts, record_id), and only what comes earlier counts. Its
validators are then checked: an entity tag, where both records have one, must agree
by weak comparison; if either has none, the Last-Modified dates must agree where
both have one; with neither in common there is no evidence. A resolved revisit takes
the response's headers with the revisit's own put over them, as far as a 304 may
carry them (PERMITTED); all others stay the response's.

status is ``resolved``, ``mismatch`` (a validator differs), ``unverified`` (no
validator in common) or ``no_response``. Headers are merged for resolved revisits
only; names are compared without case.

The as-of join runs in two steps, so that no URL meets in one task: times are cut at
quantiles; the latest response is sought within (URL, time range), and what a range
hands on is the last response of the ranges before it. Null URLs are one URL that
nothing resolves on; null times come first; repeated records are each resolved.
Other columns of the input are not read, whatever their names. Empty tables give
empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 64
#: Header fields that a 304 response may carry for its stored response (RFC 9110, 15.4.5), and Date.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary", "last-modified")
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"
_FULL = ("record_id", "etag", "last_modified", "headers", "digest")


def canonical_url(url: Column) -> Column:
    """Scheme-less URL: host in lower case without ``www.`` and default port, no fragment, no tracking parameters, the others sorted, no slash at the end."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    rest = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, r"^[^/?]*", 0)), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    params = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(F.lit("")))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, r"^W/", "")


def _lowered(headers: Column) -> Column:
    """Names in lower case; of names that then agree the last one stands."""
    return F.aggregate(F.map_entries(headers), F.expr("CAST(map() AS MAP<STRING,STRING>)"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != F.lower(e["key"])), F.create_map(F.lower(e["key"]), e["value"])))


def resolve(captures: DataFrame) -> DataFrame:
    """captures: record_id long, url, ts long, full boolean (a full response; else a revisit), etag, last_modified, headers map<string,string>, digest.

    Gives for each revisit record_id, canonical_url, ts, response_id, response_digest, status, headers.
    """
    rows = captures.select("record_id", canonical_url(F.col("url")).alias("canonical_url"), "ts", F.coalesce("full", F.lit(False)).alias("full"), "etag", "last_modified", "headers", "digest")
    cuts = rows.agg(F.percentile_approx("ts", [n / RANGES for n in range(1, RANGES)], 10_000)).first()[0] or []
    within = F.lit(0)
    for cut in sorted(set(cuts)):
        within = within + F.when(F.col("ts") > cut, 1).otherwise(0)
    response = F.when(F.col("full") & F.col("canonical_url").isNotNull(), F.struct(*_FULL))
    placed = rows.withColumn("range", within).withColumn("response", response)
    # what each range hands on: its last response, then the last of the ranges before
    last = placed.filter("response IS NOT NULL").groupBy("canonical_url", "range").agg(F.max_by("response", F.struct("ts", "record_id")).alias("handed"))
    seen = placed.select("canonical_url", "range").distinct().join(last, ["canonical_url", "range"], "left")
    carried = seen.withColumn("carried", F.last("handed", ignorenulls=True).over(Window.partitionBy("canonical_url").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))).select("canonical_url", "range", "carried")
    inside = Window.partitionBy("canonical_url", "range").orderBy(F.col("ts").asc_nulls_first(), "record_id", F.col("full").desc()).rowsBetween(Window.unboundedPreceding, -1)
    near = placed.withColumn("own", F.last("response", ignorenulls=True).over(inside)).filter("NOT full")
    found = near.join(carried, near["canonical_url"].eqNullSafe(carried["canonical_url"]) & (near["range"] == carried["range"]), "left").select(near["*"], F.coalesce("own", "carried").alias("of"))
    tags = F.col("etag").isNotNull() & F.col("of.etag").isNotNull()
    dates = F.col("last_modified").isNotNull() & F.col("of.last_modified").isNotNull()
    agree = F.when(tags, _weak(F.col("etag")) == _weak(F.col("of.etag"))).when(dates, F.col("last_modified") == F.col("of.last_modified"))
    status = F.when(F.col("of").isNull(), "no_response").when(agree.isNull(), "unverified").when(agree, "resolved").otherwise("mismatch")
    own, stored = _lowered(F.coalesce("headers", F.expr("CAST(map() AS MAP<STRING,STRING>)"))), _lowered(F.coalesce("of.headers", F.expr("CAST(map() AS MAP<STRING,STRING>)")))
    permitted = F.map_filter(own, lambda k, _: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(stored, lambda k, _: ~F.array_contains(F.map_keys(permitted), k)), permitted)
    return found.withColumn("status", status).select("record_id", "canonical_url", "ts", F.col("of.record_id").alias("response_id"), F.col("of.digest").alias("response_digest"), "status", F.when(F.col("status") == "resolved", merged).alias("headers"))


def captures_of(pages: DataFrame) -> DataFrame:
    """Pages as captures: each page is a full response at an even time, with its digest as entity tag, and a later
    304 of the same address, which quotes that tag. Where another page of the same canonical URL came between, the tag
    no longer agrees."""
    digest = F.sha2(F.coalesce("html", F.lit("")), 256)
    day = F.concat(F.lit("day "), F.col("page_id").cast("string"))
    base = pages.select("page_id", "url", digest.alias("digest"), day.alias("day"))
    as_map = lambda *kv: F.create_map(*[x if not isinstance(x, str) else F.lit(x) for x in kv])
    full = base.select(
        (F.col("page_id") * 2).alias("record_id"), "url", (F.col("page_id") * 2).alias("ts"), F.lit(True).alias("full"), F.col("digest").alias("etag"), F.col("day").alias("last_modified"),
        as_map("ETag", F.col("digest"), "Last-Modified", F.col("day"), "Content-Type", "text/html", "Cache-Control", "max-age=60").alias("headers"), "digest",
    )
    later = base.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), "url", (F.col("page_id") * 2 + LATER).alias("ts"), F.lit(False).alias("full"), F.concat(F.lit("W/"), "digest").alias("etag"), F.lit(None).cast("string").alias("last_modified"),
        as_map("ETag", F.concat(F.lit("W/"), "digest"), "Content-Type", "text/plain", "Cache-Control", "no-cache").alias("headers"), F.lit(None).cast("string").alias("digest"),
    )
    return full.unionByName(later)


#: How much later than its page a 304 is; odd, so that no response has the same time.
LATER = 2001
