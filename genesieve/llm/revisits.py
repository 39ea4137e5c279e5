r"""Not-modified revisits of web captures, resolved by an as-of join on canonical URLs.

Each revisit meets the latest full response of its canonical URL that was captured
earlier, checks that its validators still name that response, and yields the response's
headers with those a not-modified answer may replace.

The as-of join cuts each URL's captures into time buckets, whose bounds are quantiles of the
captures' times.  Inside a bucket a window finds
the latest full response; where the bucket has none yet, it is carried from the last
bucket that had one, over a table with one row per URL and bucket.  So a URL with a third
of all captures is spread over as many tasks as it has buckets.

Edge cases: captures at the same time go by record id; a null time or id comes first; a
revisit with a null URL, or without an earlier full response, is ``no_original``; a
validator that either side lacks is not compared, and without any common one the revisit
is ``unverified``; repeated rows resolve alike.  No revisits in, no rows out.  Only the
named columns are read; the URL is cleaned, never shortened.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import parts_for, written

BUCKET_ROWS = 50_000
BUCKETS = 5_000  # at most, so that the quantiles stay a small sketch
# Headers that describe the stored body, which a not-modified answer may not replace.
KEPT = ("content-encoding", "content-length", "content-range", "content-type", "transfer-encoding")


def _unescaped(text: Column) -> Column:
    """Percent-escapes of unreserved characters as these; others with upper-case digits."""
    def piece(part: Column, i: Column) -> Column:
        code = F.upper(F.substring(part, 1, 2))
        char = F.chr(F.conv(code, 16, 10).cast("int"))
        rest = part.substr(F.lit(3), F.length(part))
        plain = F.when(char.rlike("^[A-Za-z0-9._~-]$"), char).otherwise(F.concat(F.lit("%"), code))
        return F.when(i == 0, part).when(code.rlike("^[0-9A-F]{2}$"), F.concat(plain, rest)).otherwise(F.concat(F.lit("%"), part))

    return F.when(text.contains("%"), F.array_join(F.transform(F.split(text, "%", -1), piece), "")).otherwise(text)


def _without_dots(path: Column) -> Column:
    """``.`` goes, ``..`` takes the segment before it along."""
    def step(kept: Column, segment: Column) -> Column:
        return (
            F.when(segment == ".", kept)
            .when(segment == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(1))))
            .otherwise(F.concat(kept, F.array(segment)))
        )

    left = F.array_join(F.aggregate(F.split(path, "/", -1), F.array().cast("array<string>"), step), "/")
    return F.when(path.rlike(r"/\.\.?(/|$)"), left).otherwise(path)


def canonical(url: Column) -> Column:
    """Host, path and parameters of a URL in one spelling.

    Scheme, user, ``www.`` or ``m.``, default port, fragment, tracking parameters and slashes
    behind the path are removed, unreserved characters unescaped, dot segments resolved,
    parameters sorted, repeated ones by value.
    """
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z]+://)?([^/?#]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"^(www|m)\.", "")
    rest = F.regexp_replace(F.regexp_replace(url, r"^(?:[A-Za-z]+://)?[^/?#]*", ""), r"#[\s\S]*$", "")
    rest = _unescaped(rest)
    path = F.regexp_replace(_without_dots(F.regexp_extract(rest, r"^([^?]*)", 1)), r"/+$", "")
    given = F.split(F.regexp_extract(rest, r"^[^?]*\?([\s\S]*)$", 1), "&", -1)
    sent = F.array_sort(F.filter(given, lambda p: (p != "") & ~p.rlike("^(utm_[a-z]+|ref)=")))
    query = F.when(F.size(sent) > 0, F.concat(F.lit("?"), F.array_join(sent, "&"))).otherwise("")
    return F.concat(F.regexp_replace(host, r":(80|443)$", ""), path, query)


def _agree(mine: Column, theirs: Column) -> Column:
    return F.when(mine.isNotNull() & theirs.isNotNull(), mine == theirs)


def resolve(captures: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``record_id, url, original_id, outcome, headers`` of every revisit.

    ``captures``: record_id, url, captured (long), status, etag, last_modified, headers (map of
    lower-case names).  Status 200 is a full response and 304 a revisit; others are left out.
    Weak and strong forms of an entity tag compare alike.
    """
    tag = F.regexp_replace("etag", "^W/", "")
    rows = captures.where("status IN (200, 304)").select(
        "record_id", canonical(F.col("url")).alias("url"), "captured", (F.col("status") == 200).alias("full"),
        F.struct(F.col("record_id").alias("id"), tag.alias("etag"), "last_modified", "headers").alias("own"),
    )
    rows = written(rows, "captures")
    buckets = min(parts_for(rows.count(), bucket_rows), BUCKETS)
    cuts = [i / buckets for i in range(1, buckets)]
    timed = rows.withColumn("at", F.col("captured").cast("double"))
    bounds = sorted(set(timed.approxQuantile("at", cuts, 0.2 / buckets))) if cuts else []
    if bounds:
        binner = Bucketizer(splits=[float("-inf"), *bounds, float("inf")], inputCol="at", outputCol="place", handleInvalid="keep")
        timed = binner.transform(timed.withColumn("at", F.coalesce("at", F.lit(float("-inf")))))
    else:
        timed = timed.withColumn("place", F.lit(0.0))
    rows = timed.select(*rows.columns, F.col("place").cast("int").alias("bucket"))
    full = F.when(F.col("full"), F.col("own"))
    earlier = Window.partitionBy("url", "bucket").orderBy(F.col("captured").asc_nulls_first(), F.col("record_id").asc_nulls_first(), "full")
    inside = rows.where("url IS NOT NULL").withColumn("near", F.last(full, ignorenulls=True).over(earlier.rowsBetween(Window.unboundedPreceding, -1)))
    # rows without a URL meet no other, so they stay out of the window
    nowhere = rows.where("url IS NULL AND NOT full").withColumn("near", F.lit(None).cast(rows.schema["own"].dataType))
    asked = inside.where("NOT full").unionByName(nowhere)

    last = F.max_by("own", F.when(F.col("full"), F.struct("captured", "record_id")))
    ends = rows.where("url IS NOT NULL").groupBy("url", "bucket").agg(last.alias("last"))
    before = Window.partitionBy("url").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("url", "bucket", F.last("last", ignorenulls=True).over(before).alias("carried"))
    found = asked.join(carried, ["url", "bucket"], "left").withColumn(
        "original", F.when(F.col("url").isNotNull(), F.coalesce("near", "carried"))
    )
    same = [_agree(F.col(f"own.{v}"), F.col(f"original.{v}")) for v in ("etag", "last_modified")]
    checked = F.coalesce(*same)  # an entity tag decides where both have one
    outcome = (
        F.when(F.col("original").isNull(), "no_original").when(checked, "resolved")
        .when(~checked, "changed").otherwise("unverified")
    )
    fresh = F.map_filter("own.headers", lambda k, v: ~k.isin(*KEPT) & v.isNotNull())
    stored = F.map_filter("original.headers", lambda k, v: ~F.array_contains(F.coalesce(F.map_keys(fresh), F.array().cast("array<string>")), k))
    empty = F.create_map().cast("map<string,string>")
    merged = F.map_concat(F.coalesce(stored, empty), F.coalesce(fresh, empty))
    return found.withColumn("outcome", outcome).select(
        "record_id", "url", F.col("original.id").alias("original_id"), "outcome",
        F.when(F.col("outcome") == "resolved", merged).alias("headers"),
    )


# Two captures for each page, in SQL that Spark and DuckDB both run: the page as a full
# response, and a later revisit that is fresh, weakly tagged, dated only, stale, or bare.
CAPTURES = """
SELECT 2 * page_id AS record_id, url, 3 * page_id AS captured, 200 AS status, md5(html) AS etag,
  'd' || CAST(page_id AS VARCHAR(20)) AS last_modified, CAST(length(html) AS VARCHAR(20)) AS size,
  'max-age=60' AS cache, 'text/html' AS kind
FROM {pages}
UNION ALL
SELECT 2 * page_id + 1, url, 3 * page_id + 1 + page_id % 7 * 1000, 304,
  CASE WHEN page_id % 5 = 0 THEN md5(html) WHEN page_id % 5 = 1 THEN 'W/' || md5(html)
    WHEN page_id % 5 = 3 THEN md5(url) END,
  CASE WHEN page_id % 5 IN (2, 3) THEN 'd' || CAST(page_id AS VARCHAR(20)) END, '0',
  CASE WHEN page_id % 2 = 0 THEN 'max-age=300' END, 'text/plain'
FROM {pages}
"""


def captures(pages: DataFrame) -> DataFrame:
    rows = pages.sparkSession.sql(CAPTURES, pages=pages)
    headers = F.map_from_arrays(
        F.array(*[F.lit(h) for h in ("cache-control", "content-length", "content-type", "etag")]),
        F.array("cache", "size", "kind", "etag"),
    )
    return rows.select("record_id", "url", "captured", "status", "etag", "last_modified", headers.alias("headers"))


def digest(resolved: DataFrame) -> DataFrame:
    headers = F.array_join(F.transform(
        F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))
    ), "|")
    return resolved.select("record_id", "url", "original_id", "outcome", headers.alias("headers"))


SQL = r"""
WITH cut AS (
  SELECT * RENAME (url AS given), regexp_replace(regexp_replace(regexp_replace(lower(
      regexp_extract(url, '^(?:[A-Za-z]+://)?([^/?#]*)', 1)), '^.*@', ''), '^(www|m)\.', ''), ':(80|443)$', '') AS host,
    string_split(regexp_replace(regexp_replace(url, '^(?:[A-Za-z]+://)?[^/?#]*', ''), '#[\s\S]*$', ''), '%') AS escaped
  FROM (""" + CAPTURES.format(pages="pages") + r""")),
plain AS (
  SELECT *, escaped[1] || array_to_string(list_transform(escaped[2:], lambda p:
      CASE WHEN NOT regexp_matches(p, '^[0-9A-Fa-f]{2}') THEN '%' || p
      WHEN regexp_matches(chr(CAST(greatest(0, 16 * strpos('0123456789ABCDEF', upper(p[1])) + strpos('0123456789ABCDEF', upper(p[2])) - 17) AS INT)), '^[A-Za-z0-9._~-]$')
      THEN chr(CAST(greatest(0, 16 * strpos('0123456789ABCDEF', upper(p[1])) + strpos('0123456789ABCDEF', upper(p[2])) - 17) AS INT)) || p[3:]
      ELSE '%' || upper(p[1:2]) || p[3:] END), '') AS rest
  FROM cut),
parts AS (
  SELECT *, regexp_replace(array_to_string(list_reduce(
      list_transform(string_split(regexp_extract(rest, '^([^?]*)', 1), '/'), lambda s: [s]), lambda kept, s:
      CASE WHEN s[1] = '.' THEN kept WHEN s[1] = '..' THEN kept[1:greatest(len(kept) - 1, 1)] ELSE list_concat(kept, s) END), '/'), '/+$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(rest, '^[^?]*\?([\s\S]*)$', 1), '&'),
      lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref)='))) AS sent
  FROM plain),
c AS (
  SELECT record_id, captured, status, regexp_replace(etag, '^W/', '') AS tag, etag, last_modified, size, cache, kind,
    host || path || CASE WHEN len(sent) > 0 THEN '?' || array_to_string(sent, '&') ELSE '' END AS url
  FROM parts),
w AS (
  SELECT *, CASE WHEN url IS NOT NULL THEN last_value(CASE WHEN status = 200 THEN record_id END IGNORE NULLS) OVER (
    PARTITION BY url ORDER BY captured, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS original_id
  FROM c),
r AS (
  SELECT w.*, CASE WHEN o.record_id IS NULL THEN 'no_original'
      WHEN coalesce(w.tag = o.tag, w.last_modified = o.last_modified) THEN 'resolved'
      WHEN coalesce(w.tag = o.tag, w.last_modified = o.last_modified) IS NULL THEN 'unverified'
      ELSE 'changed' END AS outcome,
    o.size AS o_size, o.kind AS o_kind, coalesce(w.cache, o.cache) AS o_cache, coalesce(w.etag, o.etag) AS o_etag
  FROM w LEFT JOIN c o ON o.record_id = w.original_id
  WHERE w.status = 304)
SELECT record_id, url, original_id, outcome,
  CASE WHEN outcome = 'resolved' THEN 'cache-control=' || o_cache || '|content-length=' || o_size
    || '|content-type=' || o_kind || '|etag=' || o_etag END AS headers
FROM r
"""
