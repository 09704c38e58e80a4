"""Not-modified revisits of web captures, resolved by an as-of join, in DataFrame functions only.

A revisit record says that a page had not changed, and carries no body.  The latest earlier full response of the same
canonical URL is its candidate, and validators are then checked: if both sides have an entity tag they must agree (weak tags by
their value), else if both have a modification date they must be equal; a revisit without a validator is taken at its word.
Headers come from the full response; those that a not-modified response may update (FRESH, in any case of letters) come from the
revisit if it has them.

The join runs in two levels: records are dealt to ranges of (URL, time) of about one size and ordered within them, and what a
range passes on is ordered within the URL.  So a URL with very many captures, even of one second, is spread over ranges.  Bodies
never move: records name the page that holds one.

Captures are derived from ``pages`` (CAPTURES gives the rule as SQL): every page is fetched once; and, at later hours given by
its id, again, some of these being revisits with a matching or a stale validator.

Defined results: a null url has a null canonical URL and resolves to nothing, like a null ts; a revisit before any response, or
whose validator does not match, has a null target and status ``unresolved``; a kind other than revisit, null included, keeps its
headers; where one side has no headers (null) a resolved revisit has those of the other; a response of the same second counts as
earlier, and ties among responses go to the larger record id; repeated rows each get a row; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

#: Headers that a not-modified response may update, in lower case, and query parameters without meaning.
FRESH = ["cache-control", "content-location", "date", "etag", "expires", "vary"]
TRACKING = r"(utm_[a-z]+|gclid|fbclid|sessionid)"


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no default port, fragment, tracking parameter or index page, sorted parameters."""
    u = F.regexp_replace(F.trim(url), r"#.*$", "")
    head = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1))
    head = F.regexp_replace(F.regexp_replace(head, r"^(http://[^/]*):80$", "$1"), r"^(https://[^/]*):443$", "$1")
    tail = F.substring(u, F.char_length(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1)) + 1, F.char_length(u))
    path = F.regexp_replace(F.regexp_extract(tail, r"^([^?]*)", 1), r"/(index\.html?)?$", "")
    query = F.array_join(
        F.array_sort(F.filter(F.split(F.regexp_extract(tail, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(f"^{TRACKING}="))), "&"
    )
    return F.when(url.isNotNull(), F.concat(head, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def _etag(e: Column) -> Column:
    return F.regexp_replace(e, r"^W/", "")


def resolve(records: DataFrame) -> DataFrame:
    """``records``: record_id, page_id, url, ts (seconds), kind (response or revisit), etag, modified, headers (map).
    A row per record: record_id, page_id, canonical, ts, kind, status, target_id, target_page, headers (map)."""
    r = records.select("record_id", "page_id", canonical_url(F.col("url")).alias("canonical"), "ts", "kind", "etag", "modified", "headers")
    r = r.withColumn("_late", F.when(F.col("kind") == "response", 0).otherwise(1))
    # Records without a URL or time have no target and take no part in the join.
    placed = F.col("canonical").isNotNull() & F.col("ts").isNotNull()
    # Ranges of (URL, time) are of one size whatever the number of captures of a URL; the written table fixes their numbers.
    dealt = r.where(placed).repartitionByRange("canonical", "ts", "_late", "record_id").withColumn("_range", F.spark_partition_id())
    dealt = materialise(dealt, "captures")
    full = F.when(F.col("_late") == 0, F.struct("ts", "record_id", "page_id", "etag", "modified", "headers"))
    # What the ranges before a range leave of its URL: one row per URL and range.
    latest = dealt.groupBy("_range", "canonical").agg(F.max_by(full, F.when(F.col("_late") == 0, F.struct("ts", "record_id"))).alias("_latest"))
    by_url = Window.partitionBy("canonical").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = latest.withColumn("_before", F.last("_latest", ignorenulls=True).over(by_url)).where(F.col("_before").isNotNull()).select("_range", "canonical", "_before")
    inside = Window.partitionBy("_range", "canonical").orderBy("ts", "_late", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    joined = dealt.withColumn("_here", F.last(full, ignorenulls=True).over(inside)).join(before, ["_range", "canonical"], "left")
    columns = [c for c in r.columns if c != "_late"]
    t = F.coalesce("_here", "_before")
    r = joined.select(*columns, t.alias("_t")).unionByName(r.where(~placed).select(*columns), allowMissingColumns=True)
    t = F.col("_t")
    agrees = (
        F.when(F.col("etag").isNotNull() & t["etag"].isNotNull(), _etag(F.col("etag")) == _etag(t["etag"]))
        .when(F.col("modified").isNotNull() & t["modified"].isNotNull(), F.col("modified") == t["modified"])
        .otherwise(F.lit(True))
    )
    revisit = F.coalesce(F.col("kind") == "revisit", F.lit(False))
    found = revisit & t.isNotNull() & agrees
    # Names are the same in either case; each stays as its own side writes it.
    fresh = F.map_filter("headers", lambda k, v: F.lower(k).isin(FRESH))
    named = F.transform(F.map_keys(fresh), lambda k: F.lower(k))
    kept = F.map_filter(t["headers"], lambda k, v: ~F.array_contains(named, F.lower(k)))
    # Without headers on one side those of the other stand.
    merged = F.when(t["headers"].isNull(), fresh).when(F.col("headers").isNull(), t["headers"]).otherwise(F.map_concat(kept, fresh))
    return r.select(
        "record_id",
        "page_id",
        "canonical",
        "ts",
        "kind",
        F.when(~revisit, "response").when(found, "resolved").otherwise("unresolved").alias("status"),
        F.when(found, t["record_id"]).alias("target_id"),
        F.when(found, t["page_id"]).alias("target_page"),
        F.when(found, merged).otherwise(F.col("headers")).alias("headers"),
    )


#: Captures of a page, in SQL that both engines read: k numbers the fetches of a page.
CAPTURES = """
SELECT page_id * 4 + k AS record_id, page_id, url,
  page_id % 97 * 86400 + k * 7200 * (1 + page_id % 20) + page_id % 3600 AS ts,
  CASE WHEN k = 0 OR k = 3 AND page_id % 5 = 0 THEN 'response' ELSE 'revisit' END AS kind,
  CASE WHEN page_id % 7 = 0 THEN NULL WHEN k = 2 AND page_id % 11 = 0 THEN concat('"stale', page_id, '"')
       WHEN k = 1 AND page_id % 2 = 0 THEN concat('W/"v', page_id, '"') ELSE concat('"v', page_id, '"') END AS etag,
  CASE WHEN page_id % 3 = 0 THEN NULL ELSE page_id % 1000 END AS modified
FROM fetched WHERE k = 0 OR page_id % (k + 1) = 0
"""


def captures(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """The capture records of ``pages``."""
    fetched = pages.select("page_id", "url", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    rows = spark.sql(CAPTURES.replace("fetched", "{fetched}"), fetched=fetched)
    date = F.concat(F.lit("t"), F.col("ts").cast("string"))
    header = F.when(
        F.col("kind") == "response",
        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("date"), date, F.lit("server"), F.concat(F.lit("s"), (F.col("page_id") % 9).cast("string"))),
    ).otherwise(F.create_map(F.lit("date"), date, F.lit("server"), F.lit("edge")))
    return rows.withColumn("headers", header)


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = resolve(captures(spark, table(spark, sf_dir, "pages")))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return done.withColumn("headers", text)


ORACLE_SQL = f"""
WITH fetched AS (SELECT page_id, url, unnest([0, 1, 2, 3]) AS k FROM pages), c AS ({CAPTURES}),
u AS (SELECT *, regexp_replace(trim(url), '#.*$', '') AS u0 FROM c),
h AS (SELECT *, regexp_extract(u0, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1) AS h0 FROM u),
p AS (SELECT *, substr(u0, length(h0) + 1) AS tail,
        regexp_replace(regexp_replace(lower(h0), '^(http://[^/]*):80$', '\\1'), '^(https://[^/]*):443$', '\\1') AS head FROM h),
q AS (SELECT *, array_to_string(list_sort(list_filter(string_split(regexp_extract(tail, '\\?(.*)$', 1), '&'),
        lambda x: x <> '' AND NOT regexp_matches(x, '^{TRACKING}='))), '&') AS query FROM p),
r AS (SELECT record_id, page_id, ts, kind, etag, modified,
        CASE WHEN url IS NOT NULL THEN head || regexp_replace(regexp_extract(tail, '^([^?]*)', 1), '/(index\\.html?)?$', '')
          || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS canonical FROM q),
s AS (SELECT r.*, t.record_id AS t_id, t.page_id AS t_page, t.etag AS t_etag, t.modified AS t_modified, t.ts AS t_ts,
        row_number() OVER (PARTITION BY r.record_id ORDER BY t.ts DESC NULLS LAST, t.record_id DESC) AS n
      FROM r LEFT JOIN r t ON r.kind = 'revisit' AND t.kind = 'response' AND r.canonical = t.canonical AND t.ts <= r.ts),
f AS (SELECT *, kind = 'revisit' AND t_id IS NOT NULL AND CASE
        WHEN etag IS NOT NULL AND t_etag IS NOT NULL THEN regexp_replace(etag, '^W/', '') = regexp_replace(t_etag, '^W/', '')
        WHEN modified IS NOT NULL AND t_modified IS NOT NULL THEN modified = t_modified ELSE true END AS found FROM s WHERE n = 1)
SELECT record_id, page_id, canonical, ts, kind, CASE WHEN kind = 'response' THEN 'response' WHEN found THEN 'resolved' ELSE 'unresolved' END AS status,
  CASE WHEN found THEN t_id END AS target_id, CASE WHEN found THEN t_page END AS target_page,
  CASE WHEN kind = 'response' THEN 'content-type=text/html;date=t' || ts || ';server=s' || page_id % 9
       WHEN found THEN 'content-type=text/html;date=t' || ts || ';server=s' || t_page % 9
       ELSE 'date=t' || ts || ';server=edge' END AS headers
FROM f
"""
