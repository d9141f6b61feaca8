"""WARC records, and resolution of not-modified revisits.

A revisit (a 304 answer) has no body. It belongs to the latest earlier full response
(status 200) of its canonical URL: an as-of join. Its validators must agree with that
response's: entity tags by weak comparison if both have one, else the Last-Modified
dates. If they do, the response's headers are updated by those the revisit may change:
all but hop-by-hop fields, fields its Connection header names, and the content's own
length, type, encoding and range.

The as-of join is one range sort by (canonical URL, time, id) and a running "last full
response" inside each range partition. What a partition's first URL carries in from
earlier partitions is worked out from one edge row of each partition, so a URL with any
share of all records is spread over tasks and nothing is joined.

Defined results: one row per revisit, also if unresolved; outcome "resolved",
"unverified" (no common validator; merged all the same), "mismatch" or "missing" (no
earlier full response; also for null or empty URLs); earlier means a smaller (captured,
record_id), null times first; repeated rows stay; header names are compared in lower
case, null headers count as none; empty table, empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import default_parallelism, map_rows, materialize

#: Header fields a revisit never changes (hop-by-hop, and those that describe the stored body).
KEPT_FIELDS = ["connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade"]
#: Query parameters that only track visitors.
TRACKING = r"^(utm_[^=]*|gclid|fbclid|ref|sessionid|sid)(=|$)"
_URL = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)(\?[^#]*)?"


def canonical_url(url: Column) -> Column:
    """Host without case, "www.", user and default port; path without closing slashes; sorted query without tracking; no scheme, no fragment."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, _URL, 1)), r"^[^@]*@|:80$|:443$", "")
    host = F.regexp_replace(host, r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(url, _URL, 2), "/+$", "")
    query = F.array_join(F.array_sort(F.filter(F.split(F.substring(F.regexp_extract(url, _URL, 3), 2, 1 << 30), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    whole = F.concat(host, F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(host == "", url).otherwise(whole)


def merged_headers(stored: Column, new: Column) -> Column:
    """``stored`` updated by what ``new`` may change; keys in lower case in both."""
    named = F.transform(F.split(F.lower(F.coalesce(new["connection"], F.lit(""))), ","), lambda x: F.trim(x))
    allowed = F.map_filter(new, lambda k, v: ~k.isin(KEPT_FIELDS) & ~F.array_contains(named, k))
    return F.map_concat(F.map_filter(stored, lambda k, v: ~F.array_contains(F.map_keys(allowed), k)), allowed)


def _lower_keys(headers: Column) -> Column:
    """One entry per name in lower case, the last one given."""
    entries = F.coalesce(F.map_entries(headers), F.array().cast("array<struct<key:string,value:string>>"))
    low = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    return F.aggregate(low, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: k != e["key"]), F.create_map(e["key"], e["value"])))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """From (record_id, url, captured, kind, status, headers, digest): record_id, canonical_url, source_id, outcome, headers, digest of every revisit.

    ``kind`` is "response" or "revisit"; ``digest`` names the payload, which stays with the source record.
    """
    spark = records.sparkSession
    url = canonical_url(F.col("url"))
    full = (F.col("kind") == "response") & (F.col("status") == 200) & F.col("canonical_url").isNotNull() & (F.col("canonical_url") != "")
    base = records.select("record_id", url.alias("canonical_url"), "captured", "kind", "status", _lower_keys(F.col("headers")).alias("headers"), "digest")
    base = base.where((F.col("kind") == "revisit") | full).withColumn("source", F.when(full, F.struct(F.col("record_id").alias("id"), "headers", "digest")))
    keys = ["canonical_url", "captured", "record_id"]
    base = base.select(*keys, "kind", "headers", "source")
    laid = materialize(base.repartitionByRange(default_parallelism(spark), *keys).withColumn("part", F.spark_partition_id()))
    # the last URL of each partition and its last full response there; the first URL decides what is carried in
    last_url = laid.groupBy("part").agg(F.min("canonical_url").alias("first_url"), F.max("canonical_url").alias("last_url"))
    ends = laid.where("source IS NOT NULL").groupBy("part", "canonical_url").agg(F.max_by("source", F.struct("captured", "record_id")).alias("source"))
    edges = last_url.join(ends.withColumnRenamed("canonical_url", "last_url"), ["part", "last_url"], "left").select("part", "first_url", "last_url", "source").orderBy("part").collect()
    carried, held = [], (None, None)
    for e in edges:
        carried.append((e.part, held[0], held[1]))
        if e["source"] is not None:
            held = (e.last_url, e["source"])
        elif e.last_url != held[0]:
            held = (e.last_url, None)
    schema = f"part int, carried_url string, carried {laid.schema['source'].dataType.simpleString()}"
    into = spark.createDataFrame(carried, schema)  # a row per partition
    w = Window.partitionBy("part", "canonical_url").orderBy("captured", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = laid.withColumn("found", F.last("source", ignorenulls=True).over(w)).where("kind = 'revisit'").join(F.broadcast(into), "part")
    seen = seen.withColumn("found", F.coalesce("found", F.when(F.col("carried_url") == F.col("canonical_url"), F.col("carried"))))
    weak = lambda c: F.regexp_replace(c["etag"], "^W/", "")
    mine, theirs = F.col("headers"), F.col("found.headers")
    agree = F.coalesce(weak(mine) == weak(theirs), mine["last-modified"] == theirs["last-modified"])
    outcome = F.when(F.col("found").isNull(), "missing").when(agree.isNull(), "unverified").when(agree, "resolved").otherwise("mismatch")
    good = F.col("outcome").isin("resolved", "unverified")
    return seen.withColumn("outcome", outcome).select(
        "record_id", "canonical_url", F.when(good, F.col("found.id")).alias("source_id"), "outcome",
        F.when(good, merged_headers(theirs, mine)).alias("headers"), F.when(good, F.col("found.digest")).alias("digest"),
    )


def header_lines(headers: Column) -> Column:
    """name: value lines in the order of names."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")


def record(raw: bytes) -> dict | None:
    """A record from its bytes, the version line first; None for what names no type.

    ``whole`` is false where fewer bytes are there than Content-Length says; one that is missing or no number leaves the body as it is.
    """
    top, _, body = raw.partition(b"\r\n\r\n")
    head = _fields(top)
    if "warc-type" not in head:
        return None
    size = head.get("content-length", "")
    size = int(size) if size.isascii() and size.isdigit() else len(body)
    whole, body = len(body) >= size, body[:size]
    http, payload, status = {}, body, None
    if head.get("content-type", "").startswith("application/http"):
        lines, _, payload = body.partition(b"\r\n\r\n")
        first = lines.split(b"\r\n", 1)[0].split()
        status = int(first[1]) if len(first) > 1 and first[1].isdigit() and len(first[1]) < 5 else None
        http = _fields(lines)
    return {"record_id": head.get("warc-record-id"), "url": head.get("warc-target-uri"), "captured": head.get("warc-date"), "kind": head["warc-type"], "status": status, "headers": http, "digest": head.get("warc-payload-digest"), "payload": payload, "whole": whole}


def _fields(block: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in block.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            out[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    return out


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files under ``path``, plain or, with names in .gz, of gzip members.

    Spark's text reader cuts files at the mark before a version line, so a task holds a record, never a file; plain files are split.
    A payload that holds such a mark itself is cut there (``whole`` tells); a file that ends or breaks early gives what comes before.
    """
    names = ("record_id", "url", "captured", "kind", "status", "headers", "digest", "payload", "whole")

    def run(b: dict) -> dict:
        rows = [r for r in map(record, b["raw"]) if r]
        return {k: [list(r[k].items()) if k == "headers" else r[k] for r in rows] for k in names}

    cut = spark.read.option("lineSep", "\r\n\r\nWARC/1.").option("ignoreCorruptFiles", True).text(path)
    return map_rows(cut.select(F.col("value").cast("binary").alias("raw")), run, "record_id string, url string, captured string, kind string, status int, headers map<string,string>, digest string, payload binary, whole boolean")


def page_records(pages: DataFrame) -> DataFrame:
    """Two records of each page: a full response at time page_id and a revisit later.

    Every 11th revisit has another entity tag; every 13th is 2,000,000,000 earlier, before any response.
    """
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    size = F.octet_length(F.coalesce("html", F.lit(""))).cast("string")
    text = lambda *kv: F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in kv])
    response = pages.select((F.col("page_id") * 2).alias("record_id"), "url", F.col("page_id").alias("captured"), F.lit("response").alias("kind"), F.lit(200).alias("status"), text("Content-Type", "text/html", "Content-Length", size, "ETag", tag, "Cache-Control", "max-age=60").alias("headers"), F.md5(F.coalesce("html", F.lit(""))).alias("digest"))
    other = F.when(F.col("page_id") % 11 == 0, F.lit('"other"')).otherwise(F.concat(F.lit("W/"), tag))
    when = F.when(F.col("page_id") % 13 == 0, F.col("page_id") - 2_000_000_000).otherwise(F.col("page_id"))
    revisit = pages.select((F.col("page_id") * 2 + 1).alias("record_id"), "url", when.alias("captured"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"), text("ETag", other, "Content-Length", "0", "Cache-Control", "max-age=600", "Connection", "close, X-Trace", "X-Trace", "1", "Date", F.col("page_id").cast("string")).alias("headers"), F.lit(None).cast("string").alias("digest"))
    return response.unionByName(revisit)


ORACLE = r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, md5(coalesce(html, '')) AS digest,
             regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^[^@]*@|:80$|:443$', '', 'g'), '^www\.', '') AS host,
             regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS path,
             array_to_string(list_sort(list_filter(string_split(substr(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*[^?#]*(\?[^#]*)?', 1), 2), '&'),
               lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|gclid|fbclid|ref|sessionid|sid)(=|$)'))), '&') AS query FROM pages),
c AS (SELECT *, CASE WHEN host = '' THEN url ELSE host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN query = '' THEN '' ELSE '?' || query END END AS canonical_url FROM p),
r AS (SELECT 2 * page_id + 1 AS record_id, canonical_url, CASE WHEN page_id % 13 = 0 THEN page_id - 2000000000 ELSE page_id END AS captured,
             CASE WHEN page_id % 11 = 0 THEN '"other"' ELSE '"' || digest || '"' END AS etag, page_id FROM c),
j AS (SELECT r.record_id, r.canonical_url, r.etag, r.page_id, s.page_id AS source, s.digest, strlen(s.html) AS size,
             row_number() OVER (PARTITION BY r.record_id ORDER BY s.page_id DESC) AS nth
      FROM r LEFT JOIN c s ON s.canonical_url = r.canonical_url AND s.canonical_url <> '' AND (s.page_id < r.captured OR (s.page_id = r.captured AND 2 * s.page_id < r.record_id))),
o AS (SELECT *, CASE WHEN source IS NULL THEN 'missing' WHEN etag = '"' || digest || '"' THEN 'resolved' ELSE 'mismatch' END AS outcome FROM j WHERE nth = 1)
SELECT record_id, canonical_url, CASE WHEN outcome = 'resolved' THEN 2 * source END AS source_id, outcome,
       CASE WHEN outcome = 'resolved' THEN 'cache-control: max-age=600' || chr(10) || 'content-length: ' || size || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || page_id || chr(10) || 'etag: W/' || etag END AS headers,
       CASE WHEN outcome = 'resolved' THEN digest END AS digest
FROM o
"""
