"""The table contract: ordered columns, keys, what a model fills, closed value lists."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

# The tables' columns and types, in order. "!" marks a model-filled column that may not be null, "?" one that may.
_COLUMNS = {
    "announcements": "announcement_id string, announced_date date, title string, url string, fetched_at timestamp, http_status int, sha256 string, n_bytes bigint, body_chars bigint, extraction_status string",
    "awards": (
        "award_uid string, announcement_id string, announced_date date, service_branch string?, contractor_raw string!, contractor_city string!, contractor_state string!, amount_usd bigint?, action_type string!, "
        "contract_number string?, base_contract_number string?, modification_number string?, cumulative_face_value_usd bigint?, pricing_type string?, is_idiq boolean?, is_multi_award boolean?, work_description string!, "
        "place_of_performance string!, completion_date string?, contracting_activity string!, bids_solicited int?, bids_received int?, small_business boolean?, extraction_confidence double!, extraction_notes string?, "
        "extracted_at timestamp, extractor_model string, llm_cache_key string, skills_version string, contract_uid string, is_creating_event boolean, duplicate_of string"
    ),
    "contracts": (
        "contract_uid string, contract_number string, contractor_raw string, ticker string, service_branch string, work_description string, contracting_activity string, first_event_date date, last_event_date date, "
        "n_events int, n_modifications int, initial_value_usd bigint, total_actioned_usd bigint, ceiling_usd bigint, history_complete boolean, built_at timestamp"
    ),
    "entities": "contractor_raw string, normalized_name string!, ticker string?, parent_company string?, relationship string!, is_public boolean!, confidence double!, reasoning string!, resolved_at timestamp, resolver_model string, llm_cache_key string, skills_version string",
    "materiality": "award_uid string, score int!, tier string!, rationale string!, drivers json!, scored_at timestamp, scorer_model string, llm_cache_key string, skills_version string",
    "changes": "change_id string, detected_at timestamp, change_type string, announcement_id string, award_uid string, ticker string, prev_value string, new_value string, materiality_score int",
    "agent_runs": (
        "run_id string, tick_id string, agent string, item_key string, model string, escalated boolean, cache_hit boolean, input_tokens bigint, output_tokens bigint, cost_usd double, confidence double, outcome string, error string, "
        "skills_version string, started_at timestamp, duration_ms bigint"
    ),
    "review_queue": "review_id string, flagged_at timestamp, agent string, item_key string, reason string, confidence double, payload json, resolved boolean",
}
# Closed value lists.
ACTION_TYPES = ["new_award", "modification", "option_exercise", "multi_award_pool"]
BRANCHES = ["ARMY", "NAVY", "AIR FORCE", "DEFENSE LOGISTICS AGENCY", "SPACE FORCE", "MARINE CORPS", "DEFENSE", "MISSILE DEFENSE AGENCY", "OTHER"]
RELATIONSHIPS = ["direct", "subsidiary", "joint_venture", "private", "unknown"]
TIERS = ["alert", "notable", "routine"]
CHANGE_KINDS = ["new_announcement", "new_award", "modification_on_tracked", "amount_changed", "rescored"]
_ENUMS = {("awards", "service_branch"): BRANCHES, ("awards", "action_type"): ACTION_TYPES, ("entities", "relationship"): RELATIONSHIPS, ("materiality", "tier"): TIERS}


_TYPES = {"string": StringType(), "bigint": LongType(), "int": IntegerType(), "double": DoubleType(), "boolean": BooleanType(), "date": DateType(), "timestamp": TimestampType()}


def _schema(table: str) -> StructType:
    fields = []
    for part in _COLUMNS[table].split(", "):
        name, kind = part.split(" ")
        meta = {"model": kind[-1] in "!?", "nullable": kind[-1] == "?", "json": kind.startswith("json")}
        if (table, name) in _ENUMS:
            meta["enum"] = _ENUMS[table, name]
        base = "string" if meta["json"] else kind.rstrip("!?")
        fields.append(StructField(name, _TYPES[base], True, meta))
    return StructType(fields)


TABLES: dict[str, StructType] = {t: _schema(t) for t in _COLUMNS}
#: Tables of the engine itself, beside the contract: answers by content address, and items that an oracle failed on.
SIDE_TABLES: dict[str, StructType] = {
    t: StructType([StructField(n, _TYPES[k]) for n, k in (c.split() for c in names.split(", "))])
    for t, names in {
        "answers": "cache_key string, model string, label string, output string, input_tokens bigint, output_tokens bigint, created_at timestamp",
        "quarantine": "item_id string, tick_id string, agent string, item_key string, error string, flagged_at timestamp",
        "document_states": "announcement_id string, state string, attempts int, changed_at timestamp",
    }.items()
}
KEYS: dict[str, str] = {t: s.fields[0].name for t, s in TABLES.items()}


def schema_of(table: str) -> StructType:
    return TABLES[table] if table in TABLES else SIDE_TABLES[table]


def columns(table: str) -> list[str]:
    return schema_of(table).fieldNames()


def primary_key(table: str) -> str:
    return KEYS[table]


def model_fields(table: str) -> list[str]:
    """Columns a model fills; the rest are derived."""
    return [f.name for f in TABLES[table] if f.metadata["model"]]


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table])


def conform(df: DataFrame, table: str, *keep: str) -> DataFrame:
    """Contract columns in contract order, then ``keep``; bad values and missing columns become null, others go."""
    have = set(df.columns)

    def one(f: StructField) -> Column:
        if f.name not in have:
            return F.lit(None).cast(f.dataType).alias(f.name)
        c = F.col(f.name)
        kind = f.dataType.simpleString()
        return (c.cast("string") if kind == "string" else c.try_cast(kind)).alias(f.name)

    return df.select([*map(one, schema_of(table)), *keep])


def ddl(table: str) -> str:
    body = ", ".join(f"{f.name} {f.dataType.simpleString().upper()}" for f in TABLES[table])
    return f"CREATE TABLE IF NOT EXISTS {table} ({body}) USING parquet"


def all_ddl() -> list[str]:
    return [ddl(t) for t in TABLES]


def missing_columns(df: DataFrame, table: str) -> list[str]:
    return [c for c in columns(table) if c not in df.columns]


def require(df: DataFrame, needed: list[str]) -> None:
    if gone := [c for c in needed if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(gone)}")


def table_for(names: list[str]) -> str | None:
    """The first table whose key is among ``names`` and whose columns hold them all."""
    return next((t for t in TABLES if KEYS[t] in names and set(names) <= set(columns(t))), None)


def json_schema(table: str) -> dict:
    """Strict object schema of what a model fills."""
    kinds = {"string": "string", "bigint": "integer", "int": "integer", "double": "number", "boolean": "boolean"}
    props: dict = {}
    for f in TABLES[table]:
        if not f.metadata["model"]:
            continue
        one: dict = {"type": "array", "items": {"type": "string"}} if f.metadata["json"] else {"type": kinds[f.dataType.simpleString()]}
        if "enum" in f.metadata:
            one["enum"] = list(f.metadata["enum"])
        props[f.name] = {"anyOf": [one, {"type": "null"}]} if f.metadata["nullable"] and "enum" in one else {**one, "type": [one["type"], "null"]} if f.metadata["nullable"] else one
    return {"type": "object", "properties": props, "required": list(props), "additionalProperties": False}


def json_schema_text(table: str) -> str:
    return json.dumps(json_schema(table), sort_keys=True)


def extraction_schema() -> dict:
    """Schema of one document's answer: its awards in order, and a note on the whole."""
    props = {"awards": {"type": "array", "items": json_schema("awards")}, "document_notes": {"type": ["string", "null"]}}
    return {"type": "object", "properties": props, "required": list(props), "additionalProperties": False}
