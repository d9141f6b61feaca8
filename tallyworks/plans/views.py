"""The named read queries: queues, feeds, tabs and dialogs. Each takes tables and gives one DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text, values
from ..operators.tables import any_of, keep_first, running_total


def rows_of(spark: SparkSession, statement: str, parameters: list | None = None) -> DataFrame:
    """A statement's rows; each ``?`` in it stands for the next parameter, which is bound, not spliced in."""
    return spark.sql(statement, args=parameters) if parameters else spark.sql(statement)


def pending_announcements(announcements: DataFrame) -> DataFrame:
    return announcements.where("extraction_status = 'pending'").orderBy(F.col("announced_date").desc_nulls_last(), F.desc("announcement_id"))


def awards_for_ticker(awards: DataFrame, entities: DataFrame, materiality: DataFrame, ticker: str) -> DataFrame:
    held = entities.where(F.col("ticker") == ticker).select("contractor_raw", "ticker", "parent_company")
    scored = materiality.select("award_uid", "score", "tier")
    return awards.join(held, "contractor_raw").join(scored, "award_uid", "left").orderBy(F.col("amount_usd").desc_nulls_last(), F.col("announced_date").desc_nulls_last(), "award_uid")


def recent_changes(changes: DataFrame, n: int = 50) -> DataFrame:
    return changes.orderBy(F.col("detected_at").desc_nulls_last(), F.col("materiality_score").desc_nulls_last(), "change_id").limit(n)


def unresolved_contractors(awards: DataFrame, entities: DataFrame) -> DataFrame:
    """Names without an entity: rows, total, latest date."""
    left = awards.where("contractor_raw IS NOT NULL").join(entities.select("contractor_raw"), "contractor_raw", "left_anti")
    got = left.groupBy("contractor_raw").agg(F.count("*").alias("n_awards"), F.sum("amount_usd").alias("total_usd"), F.max("announced_date").alias("last_seen"))
    return got.orderBy(F.desc("n_awards"), F.col("total_usd").desc_nulls_last(), "contractor_raw")


def review_queue(queue: DataFrame, include_resolved: bool = False) -> DataFrame:
    """Least sure first, those without confidence before; resolved ones only on demand."""
    rows = queue if include_resolved else queue.where("resolved IS NOT TRUE")
    return rows.orderBy(F.col("confidence").asc_nulls_first(), F.col("flagged_at").desc_nulls_last(), "review_id")


def top_awards(awards: DataFrame, materiality: DataFrame, n: int = 20, tier: str | None = None) -> DataFrame:
    scored = materiality.where(F.col("tier") == tier) if tier else materiality
    j = scored.select("award_uid", "score", "tier").join(awards.select("award_uid", "contractor_raw", "amount_usd"), "award_uid")
    return j.orderBy(F.desc("score"), F.col("amount_usd").desc_nulls_last(), "award_uid").limit(n)


def unscored(awards: DataFrame, materiality: DataFrame) -> DataFrame:
    return awards.join(materiality.select("award_uid"), "award_uid", "left_anti").orderBy(F.col("amount_usd").desc_nulls_last(), "award_uid")


def enrich(awards: DataFrame, entities: DataFrame, materiality: DataFrame, announcements: DataFrame) -> DataFrame:
    """Every event with its entity, score and document, at most one of each, prefixed; with company, kind, tier rank."""
    pre = lambda df, p, key: df.select(*[F.col(c) if c == key else F.col(c).alias(f"{p}_{c}") for c in df.columns])
    e = pre(keep_first(entities, ["contractor_raw"], [F.desc("confidence"), "normalized_name"]), "ent", "contractor_raw")
    m = pre(keep_first(materiality, ["award_uid"], [F.desc("score"), "tier"]), "mat", "award_uid")
    a = pre(keep_first(announcements.drop("announced_date"), ["announcement_id"], ["title"]), "ann", "announcement_id")
    j = awards.join(e, "contractor_raw", "left").join(m, "award_uid", "left").join(a, "announcement_id", "left")
    rank = F.when(F.col("mat_tier") == "alert", 0).when(F.col("mat_tier") == "notable", 1).when(F.col("mat_tier") == "routine", 2).otherwise(3)
    kind = text.event_kind(F.col("is_creating_event"), F.col("action_type"))
    return j.withColumns({"company": text.company_or_raw(F.col("ent_parent_company"), F.col("contractor_raw")), "kind": kind, "tier_rank": rank})


def events_tab(enriched: DataFrame, tiers: list[str] | None = None, branches: list[str] | None = None, kinds: list[str] | None = None) -> DataFrame:
    """Events that are no duplicates, filtered by lists of which an empty one lets all through."""
    rows = enriched.where(F.col("duplicate_of").isNull() & any_of("mat_tier", tiers or []) & any_of("service_branch", branches or []) & any_of("kind", kinds or []))
    return rows.orderBy(F.col("mat_score").desc_nulls_last(), F.col("announced_date").desc_nulls_last(), "award_uid").select("award_uid", "announced_date", "kind", "company", "amount_usd", "mat_score", "mat_tier")


def events_kpis(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("events"), F.countDistinct("company").alias("companies"), F.count_if(F.col("mat_tier") == "alert").alias("alerts"), F.sum("amount_usd").alias("total_usd"))


def contracts_tab(contracts: DataFrame, entities: DataFrame, several: bool = False, public: bool = False, partial: bool = False) -> DataFrame:
    parent = keep_first(entities, ["contractor_raw"], [F.desc("confidence"), "normalized_name"]).select("contractor_raw", "parent_company")
    rows = contracts.join(parent, "contractor_raw", "left").withColumn("company", text.company_or_raw(F.col("parent_company"), F.col("contractor_raw")))
    if several:
        rows = rows.where("n_events > 1")
    if public:
        rows = rows.where(text.clean(F.col("ticker")).isNotNull())
    if partial:
        rows = rows.where(F.col("history_complete") == F.lit(False))
    return rows.orderBy(F.col("total_actioned_usd").desc_nulls_last(), F.desc("n_events"), "contract_uid").select("contract_uid", "company", "ticker", "n_events", "total_actioned_usd", "history_complete")


def contracts_kpis(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("contracts"), F.count_if(F.col("n_events") > 1).alias("several"), F.countDistinct("company").alias("companies"), F.sum("total_actioned_usd").alias("total_usd"))


def tickers(entities: DataFrame) -> DataFrame:
    return entities.select(text.clean(F.col("ticker")).alias("ticker")).where("ticker IS NOT NULL").distinct().orderBy("ticker")


def monthly(rows: DataFrame) -> DataFrame:
    """Month, total (0 where nothing is known) and number of events."""
    return rows.where("announced_date IS NOT NULL").groupBy(values.month(F.col("announced_date")).alias("month")).agg(F.coalesce(F.sum("amount_usd"), F.lit(0)).alias("total_usd"), F.count("*").alias("events")).orderBy("month")


def company_counts(awards: DataFrame) -> DataFrame:
    """Events per printed name, blank names under a dash."""
    return awards.groupBy(text.text_or_dash(F.col("contractor_raw")).alias("contractor")).agg(F.count("*").alias("events")).orderBy(F.desc("events"), "contractor")


def company_kpis(rows: DataFrame) -> DataFrame:
    return rows.groupBy("ent_ticker").agg(F.sum("amount_usd").alias("total_usd"), F.count("*").alias("events"), F.max("mat_score").alias("top_score"), F.count_if(F.col("mat_tier") == "alert").alias("alerts"), F.min("announced_date").alias("first_seen"))


def review_kpis(queue: DataFrame) -> DataFrame:
    done = F.coalesce("resolved", F.lit(False))
    return queue.agg(F.sum(F.when(done, 0).otherwise(1)).alias("open"), F.sum(F.when(done, 1).otherwise(0)).alias("resolved"), F.round(F.avg("confidence"), 6).alias("confidence"))


def review_tab(queue: DataFrame) -> DataFrame:
    rows = queue.where(~F.coalesce("resolved", F.lit(False)))
    return rows.orderBy(F.col("confidence").asc_nulls_first(), "review_id").select("review_id", "agent", "confidence", F.map_keys(values.as_object(F.col("payload"))).alias("fields"))


def ticker_dialog(prepared: DataFrame, entities: DataFrame, contracts: DataFrame, ticker: str) -> DataFrame:
    """A ticker's contracts: those with an event of one of its names."""
    names = entities.where(F.col("ticker") == ticker).select("contractor_raw")
    uids = prepared.where("duplicate_of IS NULL AND contract_uid IS NOT NULL").join(names, "contractor_raw", "left_semi").select("contract_uid").distinct()
    return contracts.join(uids, "contract_uid", "left_semi").orderBy(F.col("total_actioned_usd").desc_nulls_last(), F.desc("n_events"), "contract_uid")


def ticker_kpis(prepared: DataFrame, entities: DataFrame) -> DataFrame:
    """Per ticker: events, contracts, names in order, total."""
    held = entities.where(text.clean(F.col("ticker")).isNotNull()).select("contractor_raw", "ticker")
    j = prepared.where("duplicate_of IS NULL").join(held, "contractor_raw")
    return j.groupBy("ticker").agg(F.count("*").alias("events"), F.countDistinct("contract_uid").alias("contracts"), F.array_join(F.array_sort(F.collect_set("contractor_raw")), "; ").alias("units"), F.sum("amount_usd").alias("total_usd"))


def contract_dialog(prepared: DataFrame, contract_uid: Column | str) -> DataFrame:
    """A contract's events in order with the running total."""
    rows = prepared.where((F.col("contract_uid") == contract_uid) & F.col("duplicate_of").isNull())
    return rows.withColumn("running_total", running_total(F.col("amount_usd"), ["contract_uid"], [F.col("announced_date").asc_nulls_last(), "award_uid"])).orderBy(F.col("announced_date").asc_nulls_last(), "award_uid")


def award_detail(enriched: DataFrame, award_uid: str) -> DataFrame:
    return enriched.where(F.col("award_uid") == award_uid).orderBy("award_uid").limit(1)


def provenance(enriched: DataFrame) -> DataFrame:
    """Three steps for each award, from extraction over resolution to scoring, with their confidence."""
    steps = F.array(
        F.struct(F.lit(1).alias("step"), F.lit("extract").alias("stage"), F.col("announcement_id").alias("source"), F.col("extraction_confidence").alias("confidence")),
        F.struct(F.lit(2).alias("step"), F.lit("resolve").alias("stage"), F.col("contractor_raw").alias("source"), F.col("ent_confidence").alias("confidence")),
        F.struct(F.lit(3).alias("step"), F.lit("score").alias("stage"), F.col("mat_tier").alias("source"), (F.col("mat_score") / 100).alias("confidence")),
    )
    return enriched.select("award_uid", F.inline(steps))


def latest(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")
