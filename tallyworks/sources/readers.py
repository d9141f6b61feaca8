"""Reading documents, manifests, alias tables, fact maps, cached answers, logs and exports."""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators.ranges import carried
from ..operators.tables import keep_first
from ..registry import TABLES, conform, empty
from .files import current_path, exists

PROVENANCE = "url string, fetched_at string, http_status int, sha256 string, n_bytes bigint"
CACHE = "label string, model string, created_at string, key_inputs struct<system:string,prompt:string,schema:string,max_tokens:bigint>, usage struct<input_tokens:bigint,output_tokens:bigint>, output string"


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """Name, change time and size of files as one text: another one means that something was written. "none" if nothing is there."""
    parts = []
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
        parts += [f"{f.getPath()}:{f.getModificationTime()}:{f.getLen()}" for f in found or []]
    return "|".join(sorted(parts)) or "none"


def watch(spark: SparkSession, paths: list[str], act: Callable[[], object], seconds: float = 3.0, turns: int | None = None) -> int:
    """Calls ``act`` at once and whenever the files have changed; returns how often. ``turns`` bounds the looks, else it goes on."""
    seen, called = None, 0
    for turn in itertools.count():
        if turns is not None and turn >= turns:
            return called
        now = fingerprint(spark, paths)
        if now != seen:
            seen, called = now, called + 1
            act()
        time.sleep(seconds)
    return called


def manifest_entry(manifest: DataFrame, announcement_id: str) -> DataFrame:
    """The manifest's row of an id, or none."""
    return manifest.where(F.col("announcement_id") == announcement_id).limit(1)


def poll_feed(spark: SparkSession, path: str) -> tuple[DataFrame, str | None, str]:
    """Article ids of a saved feed, its build date, and "ok" or what is wrong with it; a bad feed has no ids."""
    try:
        whole = whole_files(spark, path)
        stamp = whole.select(F.regexp_extract("value", r"(?s)<lastBuildDate>\s*(.*?)\s*</lastBuildDate>", 1)).first()
        return feed_ids(whole), (stamp and stamp[0]) or None, "ok"
    except Exception as e:  # noqa: BLE001  a feed that can't be read mustn't stop a refresh
        return spark.createDataFrame([], "announcement_id string"), None, f"error: {str(e)[:120]}"


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """path, value, sha256 and n_bytes of each file; bytes that are no UTF-8 become replacement characters. Spark leaves empty files out."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("value"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("n_bytes"))


def load_table(spark: SparkSession, table: str, folders: list[str]) -> tuple[DataFrame, str]:
    """The table from the first folder that has it as Parquet or CSV, in contract form, and "found", "missing" or "error: ..."."""
    for folder in folders:
        for kind in ("parquet", "csv"):
            path = f"{folder}/{table}.{kind}"
            if not exists(spark, path):
                continue
            try:
                df = spark.read.parquet(path) if kind == "parquet" else spark.read.option("header", True).csv(path)
                return conform(df, table), "found"
            except Exception as e:  # noqa: BLE001  a broken export is shown as such, not raised
                return empty(spark, table), f"error: {str(e)[:200]}"
    return empty(spark, table), "missing"


def export_views(spark: SparkSession, folder: str) -> list[str]:
    """Every table found in ``folder`` as a temporary view."""
    names = [t for t in TABLES if exists(spark, f"{folder}/{t}.parquet")]
    for t in names:
        spark.read.parquet(f"{folder}/{t}.parquet").createOrReplaceTempView(t)
    return names


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest rows with their provenance flattened; a missing file is an empty manifest, a row without id an error."""
    schema = f"announcement_id string, announced_date string, title string, url string, body_chars bigint, provenance struct<{', '.join(f'{a}:{b}' for a, b in (x.split() for x in PROVENANCE.split(', ')))}>"
    if not exists(spark, path):
        return spark.createDataFrame([], schema).select("*", "provenance.fetched_at")
    return spark.read.schema(schema).option("multiLine", True).json(path)


def manifest_rows(manifest: DataFrame, known: DataFrame) -> DataFrame:
    """Announcement rows of a manifest; the status a document has already stays, a new one is pending."""
    checked = F.when(F.col("announcement_id").isNull(), F.raise_error(F.lit("manifest row without announcement_id")).cast("string")).otherwise(F.col("announcement_id"))
    flat = manifest.select(checked.alias("announcement_id"), "announced_date", "title", F.coalesce("url", "provenance.url").alias("url"), "provenance.fetched_at", "provenance.http_status", "provenance.sha256", "provenance.n_bytes", "body_chars")
    status = known.select("announcement_id", F.col("extraction_status").alias("was"))
    return conform(flat.join(status, "announcement_id", "left").withColumn("extraction_status", F.coalesce("was", F.lit("pending"))), "announcements")


def collect_pages(listings: DataFrame) -> DataFrame:
    """Stubs of several listing pages (page, html): the first page that shows an id wins, latest date first."""
    from .html import parse_listing

    return keep_first(parse_listing(listings), ["announcement_id"], ["page", "position"]).orderBy(F.col("announced_date").desc_nulls_last(), F.desc("announcement_id"))


def feed_ids(feed: DataFrame, value: str = "value") -> DataFrame:
    """Distinct article ids in a feed's text."""
    return feed.select(F.explode(F.regexp_extract_all(value, F.lit(r"/Article/(\d+)"), 1)).alias("announcement_id")).distinct()


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """(row, ticker, company, aliases) of an alias table; ``row`` orders it as the file does."""
    df = spark.read.option("header", True).schema("ticker string, company string, aliases string").csv(path)
    return df.select(F.monotonically_increasing_id().alias("row"), "ticker", "company", "aliases")


def read_fact_map(spark: SparkSession, path: str) -> DataFrame:
    """Entries (name, record, confidence, raw_variants) of a JSON object by name, or of ``write_fact_map``'s lines; missing or corrupt is empty."""
    schema = "name string, record string, confidence double, raw_variants array<string>"
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    if (now := current_path(spark, path)) != path:
        return spark.read.schema("key string, record string, confidence double, raw_variants array<string>").json(now).withColumnRenamed("key", "name")
    whole = whole_files(spark, path).select(F.when(F.try_parse_json("value").isNotNull(), F.from_json("value", "map<string,string>")).alias("m"))
    return whole.select(F.explode("m").alias("name", "record")).select("name", "record", F.get_json_object("record", "$.confidence").try_cast("double").alias("confidence"), F.from_json(F.get_json_object("record", "$.raw_variants"), "array<string>").alias("raw_variants"))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Cached answers by key; unreadable files are skipped."""
    raw = whole_files(spark, path).where(F.try_parse_json("value").isNotNull())
    key = F.regexp_extract("path", r"([^/]+)\.json$", 1)
    return raw.select(key.alias("cache_key"), F.from_json("value", CACHE).alias("r")).select("cache_key", "r.*")


def answered(requests: DataFrame, cache: DataFrame, live: bool = False) -> DataFrame:
    """Requests with their cached answers; without a live oracle a missing answer is an error when it is read."""
    j = requests.join(cache.select("cache_key", "output"), "cache_key", "left")
    if live:
        return j
    return j.withColumn("output", F.when(F.col("output").isNull(), F.raise_error(F.concat(F.lit("no cached answer for "), F.col("cache_key"))).cast("string")).otherwise(F.col("output")))


def misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    return requests.join(cache.select("cache_key"), "cache_key", "left_anti")


def cache_stats(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count("*").alias("entries"), F.coalesce(F.sum("usage.input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("usage.output_tokens"), F.lit(0)).alias("output_tokens"))


def cache_usage(cache: DataFrame) -> DataFrame:
    return cache.groupBy("model").agg(F.count("*").alias("calls"), F.sum("usage.input_tokens").alias("input_tokens"), F.sum("usage.output_tokens").alias("output_tokens"))


def transcript_turns(lines: DataFrame) -> DataFrame:
    """Turns of a JSONL transcript (position, value): bad lines and synthetic turns dropped, the first of each message, the nearest name before it."""
    schema = "type string, name string, message struct<id:string,model:string,usage:struct<input_tokens:bigint,output_tokens:bigint,cache_read_input_tokens:bigint>>"
    parsed = lines.where(F.try_parse_json("value").isNotNull()).select("position", F.from_json("value", schema).alias("r"))
    named = carried(parsed, F.col("r.name"), [], ["position"], "name")
    turns = named.where(F.col("r.message.usage").isNotNull() & ~F.coalesce(F.col("r.message.model") == "<synthetic>", F.lit(False)))
    return keep_first(turns.withColumn("id", F.col("r.message.id")), ["id"], ["position"]).select("id", "position", "name", F.col("r.message.model").alias("model"), F.col("r.message.usage.input_tokens").alias("input_tokens"), F.col("r.message.usage.output_tokens").alias("output_tokens"), F.coalesce("r.message.usage.cache_read_input_tokens", F.lit(0)).alias("cache_read"))


def document_text(*columns: str) -> Column:
    """The first of several columns that isn't blank."""
    return F.coalesce(*[text.clean(F.col(c)) for c in columns])


def first_path(spark: SparkSession, candidates: list[str]) -> str | None:
    return next((p for p in candidates if exists(spark, p)), None)
