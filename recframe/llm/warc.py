"""Resolving not-modified revisits of web captures.

Records are captures of URLs: full responses, and revisits for which the server said that nothing had changed. A
revisit is joined as of its time with the latest earlier full response of the same canonical URL. The response
answers for it if their validators agree: the entity tags where the revisit has one (weak comparison), else the dates
of last modification, else the payload digests. The resolved record has the response's headers, of which those that a
not-modified answer may bring up to date are replaced by the revisit's.

Records are dealt in ranges of (URL, time), so the captures of one hot URL lie in several partitions; each partition
hands on the last response of its last URL, one row for each partition. Within a partition the response is the last
one before, by a window over (partition, URL).

Defined results: records with a null URL or time, or a kind other than the two, are left out; of two captures at the
same time the smaller record_id is the earlier; a response doesn't answer for a revisit of the same time and a smaller
id; null headers count as none; repeated rows are resolved one by one; other columns are ignored; an empty table gives
an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Headers that a not-modified answer may bring up to date (RFC 9110, 15.4.5), in lower case.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "vary"]
FIELDS = ["record_id", "etag", "last_modified", "digest", "headers"]


def canonical(url: Column) -> Column:
    """A URL without scheme, user, www prefix, default port, fragment, tracking parameters and closing slashes; the host in
    lower case, the other parameters sorted."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    path = F.regexp_replace(bare, r"\?.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(path, r"^([^/]*)", 1)), r"^.*@", ""), r":(80|443)$", "")
    host = F.regexp_replace(host, r"^www\.", "")
    rest = F.regexp_replace(F.regexp_extract(path, r"^[^/]*(.*)$", 1), r"/+$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike("^(utm_[^=]*|sessionid|sid|phpsessid)(=|$)")))
    return F.concat(host, rest, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(""))


def _plain(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), r"^W/", "")


def merged_headers(stored_headers: Column, fresh: Column) -> Column:
    """The stored response's headers, those that may change replaced by the revisit's; names are in lower case."""
    permitted = F.map_filter(fresh, lambda k, _: k.isin(*PERMITTED))
    kept = F.map_filter(stored_headers, lambda k, _: ~F.array_contains(F.map_keys(permitted), k))
    return F.map_concat(kept, permitted)


def _lowered(headers: Column) -> Column:
    empty = F.create_map().cast("map<string,string>")
    entries = F.array_sort(F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))
    last = F.filter(entries, lambda e, i: (i == F.size(entries) - 1) | (e["key"] != F.coalesce(F.get(entries, i + 1)["key"], F.lit(""))))
    return F.coalesce(F.map_from_entries(last), empty)


def resolve(records: DataFrame) -> DataFrame:
    """Revisits of ``records`` (record_id, url, ts, kind, etag, last_modified, digest, headers map): record_id, url_key,
    ts, status (resolved, mismatch, unknown), response_id (where resolved) and headers (merged; where resolved)."""
    usable = records.filter(F.col("kind").isin("response", "revisit") & F.col("url").isNotNull() & F.col("ts").isNotNull())
    usable = usable.select(canonical(F.col("url")).alias("url_key"), "ts", "kind", *[F.col(c) if c != "headers" else _lowered(F.col(c)).alias(c) for c in FIELDS])
    ranged = stored(usable.repartitionByRange("url_key", "ts", "record_id").withColumn("part", F.spark_partition_id()), "captures")
    response = F.when(F.col("kind") == "response", F.struct("ts", *FIELDS))
    # What each partition hands on: its last URL, and that URL's last response in it. One row for each partition.
    last_url = ranged.groupBy("part").agg(F.min("url_key").alias("first_key"), F.max("url_key").alias("url_key"))
    edge = ranged.join(F.broadcast(last_url.select("part", "url_key")), ["part", "url_key"]).filter("kind = 'response'").groupBy("part", "url_key").agg(F.max(F.struct("ts", "record_id", "etag", "last_modified", "digest")).alias("r"), F.max_by("headers", F.struct("ts", "record_id")).alias("h"))
    hand = edge.select("url_key", (F.col("part") + 1).alias("after"), F.struct(F.col("r.ts"), F.col("r.record_id"), F.col("r.etag"), F.col("r.last_modified"), F.col("r.digest"), F.col("h").alias("headers")).alias("carried"))
    first = last_url.select(F.col("part"), F.col("first_key").alias("url_key"))
    # the latest partition before that holds a response of this partition's first URL
    carried = first.join(hand, "url_key").filter("after <= part").groupBy("part", "url_key").agg(F.max_by("carried", "after").alias("carried"))
    before = Window.partitionBy("part", "url_key").orderBy("ts", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = ranged.withColumn("found", F.last(response, ignorenulls=True).over(before)).filter("kind = 'revisit'")
    seen = seen.join(F.broadcast(carried), ["part", "url_key"], "left").withColumn("found", F.coalesce("found", "carried"))
    agrees = (
        F.when(F.col("etag").isNotNull(), _plain(F.col("etag")) == _plain(F.col("found.etag")))
        .when(F.col("last_modified").isNotNull(), F.col("last_modified") == F.col("found.last_modified"))
        .otherwise(F.col("digest") == F.col("found.digest"))
    )
    status = F.when(F.col("found").isNull(), "unknown").when(F.coalesce(agrees, F.lit(False)), "resolved").otherwise("mismatch")
    seen = seen.withColumn("status", status)
    good = F.col("status") == "resolved"
    return seen.select("record_id", "url_key", "ts", "status", F.when(good, F.col("found.record_id")).alias("response_id"), F.when(good, merged_headers(F.col("found.headers"), F.col("headers"))).alias("headers"))


def captures(pages: DataFrame, later: int = 1000) -> DataFrame:
    """Capture records of a table of pages: of each page a full response at twice its number, a revisit just before it
    and one ``later`` pages after it; both revisits say that the page is as it was then."""
    tag = F.md5(F.col("html"))
    made = F.array(
        F.struct(F.lit(0).alias("n"), F.lit("response").alias("kind"), (2 * F.col("page_id")).alias("ts")),
        F.struct(F.lit(1).alias("n"), F.lit("revisit").alias("kind"), (2 * F.col("page_id") - 1).alias("ts")),
        F.struct(F.lit(2).alias("n"), F.lit("revisit").alias("kind"), (2 * (F.col("page_id") + later) + 1).alias("ts")),
    )
    rows = pages.filter("page_id is not null").select("page_id", "url", tag.alias("tag"), F.length("html").alias("size"), F.explode(made).alias("m"))
    response = F.col("m.n") == 0
    headers = F.when(
        response,
        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.col("size").cast("string"), F.lit("ETag"), F.col("tag"), F.lit("Date"), F.col("m.ts").cast("string")),
    ).otherwise(F.create_map(F.lit("Date"), F.col("m.ts").cast("string"), F.lit("ETag"), F.concat(F.lit("W/"), F.col("tag")), F.lit("Content-Length"), F.lit("0")))
    return rows.select((3 * F.col("page_id") + F.col("m.n")).alias("record_id"), "url", F.col("m.ts").alias("ts"), F.col("m.kind").alias("kind"), F.when(response, F.col("tag")).otherwise(F.concat(F.lit("W/"), F.col("tag"))).alias("etag"), F.lit(None).cast("string").alias("last_modified"), F.col("tag").alias("digest"), headers.alias("headers"))


def resolved_pages(pages: DataFrame, later: int = 1000) -> DataFrame:
    out = resolve(captures(pages, later))
    return out.select("record_id", "url_key", "ts", "status", "response_id", F.col("headers")["content-length"].alias("content_length"), F.col("headers")["date"].alias("date"), F.col("headers")["etag"].alias("etag"))


#: The same in DuckDB: the response of a revisit is the last by (ts, record_id) before it.
SQL = r"""
WITH p AS (SELECT page_id, url, md5(html) AS tag, length(html) AS size, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM pages WHERE page_id IS NOT NULL),
q AS (SELECT *, regexp_replace(bare, '\?.*$', '') AS path,
  list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|sessionid|sid|phpsessid)(=|$)'))) AS params FROM p),
k AS (SELECT page_id, tag, size, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(path, '^([^/]*)', 1)), '^.*@', ''), ':(80|443)$', ''), '^www\.', '')
  || regexp_replace(regexp_extract(path, '^[^/]*(.*)$', 1), '/+$', '') || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS url_key FROM q),
r AS (SELECT 3 * page_id AS record_id, url_key, 2 * page_id AS ts, tag, size FROM k),
v AS (SELECT 3 * page_id + 1 AS record_id, url_key, 2 * page_id - 1 AS ts, tag FROM k UNION ALL SELECT 3 * page_id + 2, url_key, 2 * (page_id + 1000) + 1, tag FROM k),
j AS (SELECT v.record_id, v.url_key, v.ts, v.tag, arg_max(r.record_id, (r.ts, r.record_id)) AS rid FROM v LEFT JOIN r ON v.url_key = r.url_key AND (r.ts < v.ts OR (r.ts = v.ts AND r.record_id < v.record_id)) GROUP BY ALL)
SELECT j.record_id, j.url_key, j.ts, CASE WHEN rid IS NULL THEN 'unknown' WHEN r.tag = j.tag THEN 'resolved' ELSE 'mismatch' END AS status,
  CASE WHEN r.tag = j.tag THEN rid END AS response_id, CASE WHEN r.tag = j.tag THEN CAST(r.size AS VARCHAR) END AS content_length,
  CASE WHEN r.tag = j.tag THEN CAST(j.ts AS VARCHAR) END AS date, CASE WHEN r.tag = j.tag THEN 'W/' || j.tag END AS etag
FROM j LEFT JOIN r ON j.rid = r.record_id
"""
