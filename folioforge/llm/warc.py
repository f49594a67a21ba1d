"""Resolution of not-modified revisits: an as-of join to the latest earlier full response of the same URL.

A revisit that says "not modified" has no body; its page is that of the last full response captured before it
under the same canonical URL, provided that no validator contradicts. Captures are laid out once in order of (URL,
time, record), cut into ranges of even size, so that a URL with any number of captures spreads over ranges. Inside
a range a window carries the last response on; what a range inherits comes from one row per URL and range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, table

#: Fields that a 304 may update in the stored response (RFC 9111 section 3.2 lets all but these change).
KEPT_HEADERS = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade")
#: Query parameters that name a visit, not a page.
TRACKING = "utm_[a-z_]*|ref|gclid|fbclid|sessionid"
ROWS_PER_RANGE = 200_000


def canonical_url(url: Column) -> Column:
    """Scheme, www. and fragment dropped, host in lower case without a default port, tracking parameters and an
    ending slash dropped, other parameters in order. Null stays null."""
    rest = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, "^[^/?]*", 0)), "^www\\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.filter(F.array_sort(F.split(F.regexp_extract(rest, "\\?(.*)$", 1), "&")), lambda p: ~F.regexp_like(p, F.lit(f"^(?:(?:{TRACKING})(?:=.*)?)?$")))
    return F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(""))


def merge_headers(stored: Column, fresh: Column) -> Column:
    """Maps of lower-case names: `fresh` replaces what a 304 may update, the rest stays as stored."""
    allowed = F.map_filter(F.coalesce(fresh, F.expr("map()").cast("map<string,string>")), lambda k, v: ~k.isin(*KEPT_HEADERS) & v.isNotNull())
    base = F.map_filter(F.coalesce(stored, F.expr("map()").cast("map<string,string>")), lambda k, v: ~F.map_contains_key(allowed, k))
    return F.map_concat(base, allowed)


def resolve_revisits(records: DataFrame, *, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Every record with what it shows.

    `records`: record_id long, warc_type string, url string, captured (orderable), status int, headers map<string,
    string> (lower-case names), digest string (of the body; in a revisit the digest it refers to, or null).
    Out: record_id, warc_type, canonical_url, resolution, resolved_id, resolved_digest, merged_headers.

    resolution: "full" (a response stands for itself), "resolved", "mismatch" (etag, else last-modified, or the digest
    contradicts that of the response: nothing is taken over), "unresolved" (no earlier full response, or no URL or
    time), "other" (neither response nor revisit). A full response is of warc_type response with status 200. Weak and
    strong etags compare by value. Of captures at one time those of smaller record_id (null first), then of smaller digest,
    are earlier. Other columns are ignored.
    """
    cols = ("record_id", "warc_type", "canonical_url", "captured", "status", "headers", "digest")
    rows = records.withColumn("canonical_url", canonical_url(F.col("url"))).select(*cols)
    n = rows.count()
    parts = max(1, -(-n // rows_per_range), min(rows.sparkSession.sparkContext.defaultParallelism, -(-n // 1000)))
    order = ("canonical_url", "captured", "record_id", "digest")
    laid = materialize(rows.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "captures")
    full = (F.col("warc_type") == "response") & (F.col("status") == 200) & F.col("canonical_url").isNotNull() & F.col("captured").isNotNull()
    own = F.when(full, F.struct(F.col("record_id").alias("id"), F.col("digest").alias("digest"), F.col("headers").alias("headers")))
    laid = laid.withColumn("_own", own)
    last = materialize(laid.where("_own IS NOT NULL").groupBy("canonical_url", "_range").agg(F.max_by("_own", F.struct("captured", "record_id", "digest")).alias("_last")), "tails")
    spans = laid.select("canonical_url", "_range").distinct().join(last, ["canonical_url", "_range"], "left")
    before = Window.partitionBy("canonical_url").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    inherited = spans.withColumn("_inherited", F.last("_last", True).over(before)).where("_inherited IS NOT NULL").select("canonical_url", "_range", "_inherited")
    inside = Window.partitionBy("canonical_url", "_range").orderBy("captured", "record_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    rows = laid.withColumn("_seen", F.last("_own", True).over(inside)).join(inherited, ["canonical_url", "_range"], "left").withColumn("_hit", F.coalesce("_seen", "_inherited"))

    def validator(headers: str, name: str) -> Column:
        return F.regexp_replace(F.element_at(headers, name), '^W/|"', "")

    def differs(name: str) -> Column:
        return validator("headers", name) != validator("_hit.headers", name)

    etag = differs("etag")
    clash = F.coalesce(etag, differs("last-modified"), F.lit(False)) | F.coalesce(F.col("digest") != F.col("_hit.digest"), F.lit(False))
    kind = (
        F.when(F.col("_own").isNotNull(), "full")
        .when(F.col("warc_type") != F.lit("revisit"), "other")
        .when(F.col("warc_type").isNull(), "other")
        .when(F.col("_hit").isNull() | F.col("captured").isNull(), "unresolved")
        .when(clash, "mismatch")
        .otherwise("resolved")
    )
    rows = rows.withColumn("resolution", kind)
    taken = F.col("resolution") == "resolved"
    return rows.select(
        "record_id", "warc_type", "canonical_url", "resolution",
        F.when(taken, F.col("_hit.id")).when(F.col("resolution") == "full", F.col("record_id")).alias("resolved_id"),
        F.when(taken, F.col("_hit.digest")).when(F.col("resolution") == "full", F.col("digest")).alias("resolved_digest"),
        F.when(taken, merge_headers(F.col("_hit.headers"), F.col("headers"))).otherwise(F.col("headers")).alias("merged_headers"),
    )


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """The `pages` table seen as WARC records: a crawl in order of page_id that visits each host's pages again.

    The table has no captures of its own, so these rules make some, all from the first 8 hex digits of the MD5 of the id:
    the captured URL is the page's without the number that ends its path, query and fragment kept; every third page is a
    revisit that says not-modified and brings the etag of the section, a changed one, a modification date or nothing, and
    at times the digest of another body; one in eleven responses is a 404, and one in four has a date and no etag.
    """
    turn = F.conv(F.substring(F.md5(F.col("page_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    revisit = turn % 3 == 0
    url = F.regexp_replace("url", "/[0-9]+(?:\\.html)?(?=$|[?#])", "/")
    section = F.md5(F.regexp_replace(url, "[?#].*$", ""))
    etag = F.when(~revisit & (turn % 4 != 0), F.concat(F.lit('"'), section, F.lit('"'))).when(revisit & (turn % 2 == 0), F.concat(F.lit('W/"'), section, F.lit('"'))).when(revisit & (turn % 5 == 0), F.lit('"changed"'))
    modified = F.when(~revisit | (turn % 2 == 1), F.concat(F.lit("day "), F.when(turn % 13 == 0, "2").otherwise("1")))
    size = F.when(revisit, F.lit("0")).otherwise(F.length("html").cast("string"))
    some = F.map_filter(F.create_map(F.lit("etag"), etag, F.lit("last-modified"), modified, F.lit("date"), F.col("page_id").cast("string"), F.lit("content-length"), size), lambda k, v: v.isNotNull())
    return pages.select(
        F.col("page_id").alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("warc_type"), url.alias("url"), F.col("page_id").alias("captured"),
        F.when(revisit, 304).when(turn % 11 == 0, 404).otherwise(200).alias("status"), some.alias("headers"), F.when(~revisit | (turn % 17 == 0), F.md5("html")).alias("digest"),
    )


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve_revisits(captures_of_pages(table(spark, sf_dir, "pages")))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("merged_headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return out.select(F.col("record_id").alias("page_id"), "warc_type", "canonical_url", "resolution", "resolved_id", "resolved_digest", shown.alias("headers"))


OP3_SQL = rf"""
WITH p AS (SELECT page_id, html, regexp_replace(url, '/[0-9]+(?:\.html)?($|[?#])', '/\1') AS url, CAST('0x' || substr(md5(CAST(page_id AS VARCHAR)), 1, 8) AS BIGINT) AS turn FROM pages),
q AS (SELECT *, turn % 3 = 0 AS revisit, md5(regexp_replace(url, '[?#].*$', '')) AS section, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM p),
c AS (SELECT *, list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda x: NOT regexp_full_match(x, '(?:(?:{TRACKING})(?:=.*)?)?'))) AS params FROM q),
v AS (
  SELECT page_id, turn, revisit, md5(html) AS body, length(html) AS size, NOT revisit AND turn % 11 <> 0 AS good,
    regexp_replace(lower(regexp_extract(rest, '^[^/?]*')), '^www\.|:(80|443)$', '', 'g') || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '')
      || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS canonical_url,
    CASE WHEN NOT revisit OR turn % 17 = 0 THEN md5(html) END AS digest,
    CASE WHEN NOT revisit AND turn % 4 <> 0 THEN '"' || section || '"' WHEN revisit AND turn % 2 = 0 THEN 'W/"' || section || '"' WHEN revisit AND turn % 5 = 0 THEN '"changed"' END AS etag,
    CASE WHEN NOT revisit OR turn % 2 = 1 THEN CASE WHEN turn % 13 = 0 THEN 'day 2' ELSE 'day 1' END END AS modified FROM c
), j AS (
  SELECT v.*, f.page_id AS fid, f.digest AS fdigest, f.etag AS fetag, f.modified AS fmodified, f.size AS fsize
  FROM v ASOF LEFT JOIN (SELECT * FROM v WHERE good) f ON v.canonical_url = f.canonical_url AND v.page_id > f.page_id
), k AS (
  SELECT *, CASE WHEN good THEN 'full' WHEN NOT revisit THEN 'other' WHEN fid IS NULL THEN 'unresolved'
    WHEN coalesce(replace(replace(etag, 'W/', ''), '"', '') <> replace(fetag, '"', ''), modified <> fmodified, false) OR coalesce(digest <> fdigest, false) THEN 'mismatch' ELSE 'resolved' END AS resolution FROM j
)
SELECT page_id, CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS warc_type, canonical_url, resolution,
  CASE resolution WHEN 'resolved' THEN fid WHEN 'full' THEN page_id END AS resolved_id,
  CASE resolution WHEN 'resolved' THEN fdigest WHEN 'full' THEN digest END AS resolved_digest,
  'content-length=' || CASE WHEN resolution = 'resolved' THEN fsize WHEN revisit THEN 0 ELSE size END || ';date=' || page_id
    || coalesce(';etag=' || CASE WHEN resolution = 'resolved' THEN coalesce(etag, fetag) ELSE etag END, '')
    || coalesce(';last-modified=' || CASE WHEN resolution = 'resolved' THEN coalesce(modified, fmodified) ELSE modified END, '') AS headers
FROM k
"""
