"""Award events: from model answers to rows, duplicates, creating events, contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys, text, values
from ..registry import ACTION_TYPES, BRANCHES, TABLES, columns, conform, model_fields

CHANGES = ["modification", "option_exercise"]
_ANSWERS = "array<struct<" + ",".join(f"{n}:string" for n in model_fields("awards")) + ">>"


def is_change(action: Column) -> Column:
    return action.isin(CHANGES)


def repair(rows: DataFrame) -> DataFrame:
    """Rules that are exact: star, pool, missing base, confidence, closed lists. ``repairs`` lists what was changed."""
    raw, action, branch = F.col("contractor_raw"), F.col("action_type"), F.col("service_branch")
    who = F.coalesce(raw, F.lit("?"))
    starred = raw.contains("*")
    pool = action == "multi_award_pool"
    bad_action = ~F.coalesce(action.isin(ACTION_TYPES), F.lit(False))
    bad_branch = branch.isNotNull() & ~branch.isin(BRANCHES)
    no_base = is_change(action) & (F.coalesce(F.col("base_contract_number"), F.lit("")) == "")
    said = lambda cond, *parts: F.when(F.coalesce(cond, F.lit(False)), F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts]))
    repairs = F.array_compact(
        F.array(
            said(starred & ~F.coalesce(F.col("small_business"), F.lit(False)), "small_business=True from asterisk in ", who),
            said(pool & ~F.coalesce(F.col("is_multi_award"), F.lit(False)), "is_multi_award=True implied by action_type for ", who),
            said(no_base, action, " names no base contract for ", who),
            said(F.col("extraction_confidence").isNull(), "missing extraction_confidence for ", who),
            said(bad_action, "action_type not in enum for ", who),
            said(bad_branch, "service_branch not in enum for ", who),
        )
    )
    confidence = F.coalesce(values.clamp(F.col("extraction_confidence"), 0.0, 1.0), F.lit(0.5))
    notes = F.col("extraction_notes")
    notes = F.when(bad_action, text.join_notes(notes, F.concat(F.lit("model returned action_type="), F.coalesce(action, F.lit("None"))))).otherwise(notes)
    notes = F.when(bad_branch, text.join_notes(notes, F.concat(F.lit("header "), branch))).otherwise(notes)
    return rows.withColumns({
        "repairs": repairs,
        "small_business": F.when(starred, True).otherwise(F.col("small_business")),
        "is_multi_award": F.when(pool, True).otherwise(F.col("is_multi_award")),
        "extraction_confidence": F.when(bad_action, F.least(confidence, F.lit(0.5))).otherwise(confidence),
        "extraction_notes": notes,
        "action_type": F.when(bad_action, "new_award").otherwise(action),
        "service_branch": F.when(bad_branch, "OTHER").otherwise(branch),
    })


def coerce_answer(name: str, c: Column) -> Column:
    kind = TABLES["awards"][name].dataType.simpleString()
    if kind in ("bigint", "int"):
        return values.model_int(c).cast(kind)
    if kind == "boolean":
        return values.model_bool(c)
    return c.try_cast("double") if kind == "double" else text.clean(c)


def postprocess(answers: DataFrame) -> DataFrame:
    """Award rows of answers (announcement_id, announced_date, payload JSON with ``awards``, model, cache_key, skills_version, extracted_at).

    Rows without a name are dropped; a second row of one id in a document is keyed by its place.
    """
    items = F.from_json(F.get_json_object("payload", "$.awards"), _ANSWERS)
    flat = answers.select("announcement_id", "announced_date", "model", "cache_key", "skills_version", "extracted_at", F.posexplode(items).alias("ordinal", "a"))
    typed = flat.select("announcement_id", "announced_date", F.col("model").alias("extractor_model"), F.col("cache_key").alias("llm_cache_key"), "skills_version", "extracted_at", "ordinal", *[coerce_answer(n, F.col("a")[n]).alias(n) for n in model_fields("awards")])
    rows = repair(typed).where("contractor_raw IS NOT NULL")
    first = keys.award_uid(F.col("announcement_id"), F.col("contract_number"), F.col("contractor_raw"), F.col("ordinal"))
    by_place = keys.award_uid(F.col("announcement_id"), F.lit(""), F.col("contractor_raw"), F.col("place"))
    w = Window.partitionBy("announcement_id", "award_uid").orderBy("ordinal")
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy("announcement_id").orderBy("ordinal")) - 1).withColumn("award_uid", first)
    return conform(placed.withColumn("nth", F.row_number().over(w)).withColumn("award_uid", F.when(F.col("nth") > 1, by_place).otherwise(F.col("award_uid"))), "awards")


def stamp(awards: DataFrame) -> DataFrame:
    return awards.withColumn("contract_uid", keys.contract_uid(F.col("contract_number"), F.col("base_contract_number")))


def _apart(counts: Column) -> Column:
    """One more key of a window: null for rows that count, a hash of the id for the rest, which would else meet in one task."""
    return F.when(~counts, F.xxhash64("award_uid"))


def mark_duplicates(awards: DataFrame) -> DataFrame:
    """duplicate_of: the smallest id among rows of one contract, name, action, modification and amount (a null amount equals a null); null for that row itself.

    Rows without contract, name or action are never duplicates. One window on the key; no self-join.
    """
    able = F.col("contract_uid").isNotNull() & F.col("contractor_raw").isNotNull() & F.col("action_type").isNotNull()
    same = Window.partitionBy("contract_uid", "contractor_raw", "action_type", F.coalesce("modification_number", F.lit("")), "amount_usd", _apart(able))
    least = F.min("award_uid").over(same)
    return awards.withColumn("duplicate_of", F.when(able & (F.col("award_uid") != least), least))


def mark_creating(awards: DataFrame) -> DataFrame:
    """is_creating_event: the earliest row of a contract, by date (null last) and id, that is no duplicate."""
    live = F.col("contract_uid").isNotNull() & F.col("duplicate_of").isNull()
    w = Window.partitionBy("contract_uid", live, _apart(live)).orderBy(F.col("announced_date").asc_nulls_last(), "award_uid")
    return awards.withColumn("is_creating_event", live & (F.row_number().over(w) == 1))


def prepare(awards: DataFrame) -> DataFrame:
    return mark_creating(mark_duplicates(stamp(awards)))


def build_contracts(awards: DataFrame, entities: DataFrame) -> DataFrame:
    """One row per contract from its rows that aren't duplicates: a single aggregation with the creating row picked by ``min_by``."""
    tickers = entities.groupBy("contractor_raw").agg(F.first("ticker").alias("ticker"))  # contractor_raw is the key; guards against repeats
    live = awards.where("contract_uid IS NOT NULL AND duplicate_of IS NULL")
    first = F.struct(F.coalesce("announced_date", F.lit("9999-12-31").cast("date")), "award_uid")
    creator = F.min_by(F.struct("contractor_raw", "contract_number", "base_contract_number", "service_branch", "work_description", "contracting_activity", "action_type", "amount_usd"), first)
    changed = is_change(F.col("action_type"))
    got = live.groupBy("contract_uid").agg(
        creator.alias("c"), F.min("announced_date").alias("first_event_date"), F.max("announced_date").alias("last_event_date"), F.count("*").cast("int").alias("n_events"),
        F.sum(F.when(changed, 1).otherwise(0)).cast("int").alias("n_modifications"), F.sum("amount_usd").alias("total_actioned_usd"), F.max("cumulative_face_value_usd").alias("ceiling_usd"),
    )
    opened = is_change(F.col("c.action_type"))
    rows = got.select(
        "contract_uid", F.coalesce(F.nullif(F.col("c.base_contract_number"), F.lit("")), F.col("c.contract_number")).alias("contract_number"), "c.contractor_raw", "c.service_branch", "c.work_description", "c.contracting_activity",
        "first_event_date", "last_event_date", "n_events", "n_modifications", F.when(opened, None).otherwise(F.col("c.amount_usd")).alias("initial_value_usd"), "total_actioned_usd", "ceiling_usd", (~opened).alias("history_complete"),
    )
    return conform(rows.join(tickers, "contractor_raw", "left"), "contracts")


def contract_counts(awards: DataFrame) -> DataFrame:
    return awards.agg(F.count("*").alias("events"), F.count("duplicate_of").alias("duplicates"), F.count_if(F.col("contract_uid").isNull()).alias("unattached"), F.countDistinct("contract_uid").alias("contracts"))


def linked_modifications(awards: DataFrame, contracts: DataFrame) -> DataFrame:
    """Modifications and options of contracts with an earlier event, with what is to be said of them."""
    mods = awards.where(F.col("duplicate_of").isNull() & ~F.col("is_creating_event") & is_change(F.col("action_type")))
    held = contracts.select("contract_uid", F.col("contract_number").alias("number"), "n_events", "first_event_date", "total_actioned_usd", "history_complete")
    j = mods.join(held, "contract_uid")
    was = F.concat(F.coalesce("number", F.lit("None")), F.lit(" · "), (F.col("n_events") - 1).cast("string"), F.lit(" prior event(s) since "), F.coalesce(F.col("first_event_date").cast("string"), F.lit("None")), F.when(~F.coalesce("history_complete", F.lit(False)), " · opens before our window").otherwise(""))
    more = F.when(F.col("cumulative_face_value_usd").isNotNull(), F.concat(F.lit(", cumulative "), values.usd(F.col("cumulative_face_value_usd")))).when(F.col("total_actioned_usd").isNotNull(), F.concat(F.lit(", "), values.usd(F.col("total_actioned_usd")), F.lit(" actioned to date"))).otherwise("")
    return j.select("award_uid", "announcement_id", "contractor_raw", was.alias("prev_value"), F.concat(values.usd(F.col("amount_usd")), F.lit(" this action"), more).alias("new_value"))


def timeline(awards: DataFrame) -> DataFrame:
    """Rows of each contract in order, with the running total of what was actioned."""
    live = awards.where("contract_uid IS NOT NULL AND duplicate_of IS NULL")
    w = Window.partitionBy("contract_uid").orderBy(F.col("announced_date").asc_nulls_last(), "award_uid").rowsBetween(Window.unboundedPreceding, 0)
    return live.select("contract_uid", "award_uid", "announced_date", "amount_usd", F.sum(F.coalesce("amount_usd", F.lit(0))).over(w).alias("running_total"), text.event_kind(F.col("is_creating_event"), F.col("action_type")).alias("kind"))


def divide_pools(awards: DataFrame) -> DataFrame:
    """The wrong rule on purpose: a pool's shared ceiling divided among its rows. For negative controls."""
    n = F.count("*").over(Window.partitionBy("announcement_id", "action_type", "amount_usd"))
    return awards.withColumn("amount_usd", F.when(F.col("action_type") == "multi_award_pool", F.floor(F.col("amount_usd") / n)).otherwise(F.col("amount_usd")).cast("bigint"))


def cumulate_pools(awards: DataFrame) -> DataFrame:
    """The wrong rule on purpose: the ceiling also stated as a cumulative value."""
    return awards.withColumn("cumulative_face_value_usd", F.when(F.col("action_type") == "multi_award_pool", F.col("amount_usd")).otherwise(F.col("cumulative_face_value_usd")))


def collapse_pools(awards: DataFrame) -> DataFrame:
    """The wrong rule on purpose: one row of a pool stays."""
    w = Window.partitionBy("announcement_id", "action_type", "amount_usd").orderBy("award_uid")
    return awards.withColumn("__n", F.row_number().over(w)).where((F.col("action_type") != "multi_award_pool") | (F.col("__n") == 1)).drop("__n")


def least_confidence(awards: DataFrame) -> DataFrame:
    """Per document: rows, smallest confidence, rows below the limit or without one."""
    low = F.col("extraction_confidence").isNull() | (F.col("extraction_confidence") < values.LOW_CONFIDENCE)
    return awards.groupBy("announcement_id").agg(F.count("*").alias("n"), F.min("extraction_confidence").alias("least"), F.count_if(low).alias("n_low"))


assert set(CHANGES) <= set(ACTION_TYPES) and "repairs" not in columns("awards")
