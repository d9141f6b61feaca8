"""Twelve checks of the tables, their findings in order of severity, and what is thought to be their cause."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, values
from .events import is_change

SEVERITIES = ["critical", "high", "medium", "low"]
# Check, stage, severity.
CHECKS = {
    "FETCH_NON_200": ("acquisition", "critical"),
    "FETCH_EMPTY_BODY": ("acquisition", "critical"),
    "FETCH_NOT_EXTRACTED": ("acquisition", "high"),
    "FETCH_NO_AWARDS": ("acquisition", "high"),
    "EXTRACT_NO_AMOUNT": ("extraction", "high"),
    "EXTRACT_NO_CONTRACT_NUMBER": ("extraction", "medium"),
    "EXTRACT_MOD_NO_BASE": ("extraction", "high"),
    "EXTRACT_UNMAPPED_BRANCH": ("extraction", "medium"),
    "EXTRACT_IMPLAUSIBLE_AMOUNT": ("extraction", "critical"),
    "EXTRACT_LOW_CONFIDENCE": ("extraction", "low"),
    "RESOLVE_TICKER_COLLISION": ("extraction", "critical"),
    "EXTRACT_THIN_DOCUMENT": ("extraction", "medium"),
}


def _or(c: Column | str, other: str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(other))


def _blank(c: str) -> Column:
    return F.col(c).isNull() | (F.col(c) == "")


def documents_without_awards(announcements: DataFrame, awards: DataFrame) -> DataFrame:
    long = announcements.where("extraction_status = 'extracted' AND body_chars > 2000")
    return long.join(awards, "announcement_id", "left_anti").select("announcement_id", F.lit("extracted, 0 awards").alias("detail")).distinct()


def thin_documents(announcements: DataFrame, awards: DataFrame) -> DataFrame:
    n = awards.groupBy("announcement_id").agg(F.count("award_uid").alias("n"))
    j = announcements.where("body_chars > 12000").groupBy("announcement_id").agg(F.max("body_chars").alias("body_chars")).join(n, "announcement_id").where("n < 4")
    return j.select("announcement_id", F.concat(F.lit("awards="), F.col("n").cast("string"), F.lit(" body_chars="), F.col("body_chars").cast("string")).alias("detail"))


def ticker_collisions(entities: DataFrame) -> DataFrame:
    """Names of a ticker whose parents differ in their first word."""
    claimed = entities.where("ticker IS NOT NULL AND ticker <> '' AND parent_company IS NOT NULL").groupBy("ticker").agg(F.countDistinct(text.first_word(F.col("parent_company"))).alias("n")).where("n > 1")
    return entities.join(claimed, "ticker", "left_semi").select("contractor_raw", F.concat("ticker", F.lit(" -> "), "parent_company").alias("detail"))


def run_checks(announcements: DataFrame, awards: DataFrame, entities: DataFrame) -> DataFrame:
    """code, stage, severity, item_key, detail of every finding."""
    a, w = announcements, awards
    found = {
        "FETCH_NON_200": a.where("http_status IS NULL OR http_status <> 200").select("announcement_id", F.concat(F.lit("http "), _or("http_status", "null"))),
        "FETCH_EMPTY_BODY": a.where("body_chars IS NULL OR body_chars < 200").select("announcement_id", F.concat(F.lit("body_chars="), _or("body_chars", "null"))),
        "FETCH_NOT_EXTRACTED": a.where("extraction_status IS NULL OR extraction_status NOT IN ('extracted', 'pending')").select("announcement_id", "extraction_status"),
        "FETCH_NO_AWARDS": documents_without_awards(a, w),
        "EXTRACT_NO_AMOUNT": w.where("amount_usd IS NULL").select("award_uid", _or("contractor_raw", "?")),
        "EXTRACT_NO_CONTRACT_NUMBER": w.where(_blank("contract_number") & (F.col("action_type") != "multi_award_pool")).select("award_uid", _or("contractor_raw", "?")),
        "EXTRACT_MOD_NO_BASE": w.where(is_change(F.col("action_type")) & _blank("base_contract_number")).select("award_uid", _or("modification_number", "(no mod number)")),
        "EXTRACT_UNMAPPED_BRANCH": w.where("service_branch = 'OTHER' AND extraction_notes IS NOT NULL AND extraction_notes <> ''").select("award_uid", _or("extraction_notes", "(no note)")),
        "EXTRACT_IMPLAUSIBLE_AMOUNT": w.where("amount_usd > 500000000000 OR amount_usd < 0").select("award_uid", F.col("amount_usd").cast("string")),
        "EXTRACT_LOW_CONFIDENCE": w.where(F.col("extraction_confidence") < values.LOW_CONFIDENCE).select("award_uid", F.col("extraction_confidence").cast("string")),
        "RESOLVE_TICKER_COLLISION": ticker_collisions(entities),
        "EXTRACT_THIN_DOCUMENT": thin_documents(a, w),
    }
    rows = [df.toDF("item_key", "detail").select(F.lit(code).alias("code"), F.lit(CHECKS[code][0]).alias("stage"), F.lit(CHECKS[code][1]).alias("severity"), "item_key", "detail") for code, df in found.items()]
    return reduce(DataFrame.unionByName, rows)


def findings(checked: DataFrame, min_rows: int = 3, sample: int = 5) -> DataFrame:
    """Checks that fired at least ``min_rows`` times, most severe and most frequent first, with the first few items."""
    counts = checked.groupBy("code", "stage", "severity").agg(F.count("*").alias("n")).where(F.col("n") >= min_rows)
    # the limit on the rank applies in every task before rows are sent, so a code's window holds few of them
    nth = F.row_number().over(Window.partitionBy("code").orderBy("item_key", "detail"))
    first = checked.select("code", "item_key", "detail").withColumn("nth", nth).where(F.col("nth") <= sample)
    few = first.groupBy("code").agg(F.array_sort(F.collect_list("item_key")).alias("sample"))
    got = counts.join(few, "code")
    return got.orderBy(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")), F.desc("n"), "code")


def merge_causes(found: DataFrame, answers: DataFrame) -> DataFrame:
    """The last answer for each code that was found; unsure ones, gaps in the schema and changed sources go to review."""
    last = answers.groupBy("code").agg(F.max_by(F.struct("cause", "confidence"), "position").alias("a"))
    j = found.join(last, "code", "left")
    return j.select("code", F.col("a.cause").alias("cause"), F.col("a.confidence").alias("confidence"), (values.needs_escalation(F.col("a.confidence")) | F.coalesce(F.col("a.cause").isin("schema_gap", "source_changed"), F.lit(False))).alias("review"))


def from_payloads(answers: DataFrame) -> DataFrame:
    """code, cause, confidence, position of answers (batch, payload with ``diagnoses``), as ``merge_causes`` takes them."""
    items = values.exploded(answers.select("batch", "payload"), "diagnoses", ["code", "cause", "confidence"])
    return items.select("code", "cause", F.col("confidence").try_cast("double").alias("confidence"), F.struct("batch", "pos").alias("position"))


def report(found: DataFrame) -> str:
    """Findings as Markdown; one row per check at most."""
    lines = ["# Findings", "", "| check | severity | rows | examples |", "|---|---|---|---|"]
    lines += [f"| {r.code} | {r.severity} | {r.n} | {', '.join(r['sample'])} |" for r in found.limit(len(CHECKS)).collect()]
    return "\n".join(lines) + "\n"
