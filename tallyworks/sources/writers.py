"""Logs, fact maps, caches and transcripts; the keyed tables are in ``store``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from .files import exists, with_retry, write_versioned
from .store import CSV_TABLES, Conflict, Store

__all__ = ["CSV_TABLES", "Conflict", "Store", "append_log", "transcript_markdown", "write_cache", "write_fact_map"]

LOG_HEADER = "# Activity log"


def append_log(spark: SparkSession, folder: str, who: str, lines: list[str], kind: str = "post") -> None:
    """Lines of an activity log: `time who` and the text, "spawn" and "done" marked; a new log begins with its header."""
    if not exists(spark, folder):
        spark.createDataFrame([(LOG_HEADER,)], "line string").coalesce(1).write.mode("append").text(folder)
    mark = {"spawn": "started: ", "done": "finished: "}.get(kind, "")
    rows = spark.createDataFrame([(mark + x,) for x in lines], "line string").coalesce(1)
    stamped = rows.select(F.concat(F.lit("`"), F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"), F.lit(f" {who}` "), "line"))
    with_retry(lambda: stamped.write.mode("append").text(folder))


def write_fact_map(records: DataFrame, path: str) -> None:
    """Name and record, sorted, as JSON lines in a new folder; then the pointer moves to it, so no reader finds nothing."""
    write_versioned(records.orderBy("key"), path)


def write_cache(answers: DataFrame, path: str) -> None:
    answers.write.mode("append").parquet(path)


def transcript_markdown(turns: DataFrame) -> DataFrame:
    """One scrubbed Markdown block per turn."""
    return turns.select("position", F.concat(F.lit("**"), F.coalesce("name", F.lit("?")), F.lit("**\n\n"), text.scrub(F.col("text"))).alias("block"))
