"""From printed names to companies: alias table, exact and longest-prefix matches, variants, planning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text, values
from ..registry import RELATIONSHIPS, TABLES, conform
from .tables import keep_first

#: Alias and price tables up to this many bytes are broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 16 << 20


def _small(df: DataFrame) -> DataFrame:
    """A broadcast hint only where the plan's own estimate proves the size."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(df) if int(str(size)) <= BROADCAST_BYTES else df


def alias_index(companies: DataFrame) -> DataFrame:
    """key, alias, ticker, company, company_level, n_tokens from (row, ticker, company, aliases): the company's name and each ";"-separated alias; the earliest row owns a key."""
    rows = companies.select("row", F.upper(F.trim("ticker")).alias("ticker"), F.trim("company").alias("company"), F.coalesce("aliases", F.lit("")).alias("aliases")).where("ticker <> '' AND company <> ''")
    names = F.concat(F.array("company"), F.filter(F.transform(F.split("aliases", ";"), lambda a: F.trim(a)), lambda a: a != ""))
    flat = rows.select("row", "ticker", "company", F.posexplode(names).alias("place", "alias")).withColumn("key", text.normalize_name(F.col("alias"))).where("key <> ''")
    own = text.normalize_name(F.col("company"))
    level = (F.col("key") == own) | own.startswith(F.concat(F.col("key"), F.lit(" ")))
    return keep_first(flat, ["key"], ["row", "place"]).select("key", "alias", "ticker", "company", level.alias("company_level"), F.size(F.split("key", " ")).alias("n_tokens"))


def match_aliases(names: DataFrame, aliases: DataFrame, raw: str = "contractor_raw") -> DataFrame:
    """Distinct names with the alias they equal, or else the longest of two or more words they begin with; joint ventures match nothing.

    A name's own word prefixes are joined to the alias keys, so no name is held against every alias.
    """
    keyed = names.select(F.col(raw).alias("raw")).where(F.col("raw").isNotNull()).distinct().withColumn("key", text.normalize_name(F.col("raw")))
    words = F.split("key", " ")
    able = (F.col("key") != "") & ~text.is_joint_venture(F.col("raw"))
    prefixes = keyed.where(able).select("raw", "key", F.explode(F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, 1, n), " "))).alias("prefix"))
    hits = prefixes.join(_small(aliases.withColumnRenamed("key", "alias_key")), F.col("prefix") == F.col("alias_key")).where("prefix = key OR n_tokens >= 2")
    best = hits.groupBy("raw").agg(F.max_by(F.struct("alias", "alias_key", "ticker", "company", "company_level"), F.struct(F.col("prefix") == F.col("key"), "n_tokens", F.length("alias_key"))).alias("hit"))
    method = F.when(F.col("hit.alias_key") == F.col("key"), "alias_exact").when(F.col("hit").isNotNull(), "alias_prefix")
    return keyed.join(best, "raw", "left").select("raw", "key", F.col("hit.alias").alias("alias"), F.col("hit.ticker").alias("ticker"), F.col("hit.company").alias("company"), F.col("hit.company_level").alias("company_level"), method.alias("method"))


def alias_records(matched: DataFrame) -> DataFrame:
    """Entity rows of the names an alias decided."""
    exact = F.col("method") == "alias_exact"
    return conform(
        matched.where("method IS NOT NULL").select(
            F.col("raw").alias("contractor_raw"), F.when(exact, F.col("alias")).otherwise(text.display_name(F.col("raw"))).alias("normalized_name"), "ticker", F.col("company").alias("parent_company"),
            F.when(F.col("company_level") & exact, "direct").otherwise("subsidiary").alias("relationship"), F.lit(True).alias("is_public"), F.when(exact, 0.99).otherwise(0.94).alias("confidence"),
            F.concat(F.lit("Deterministic "), F.when(exact, "exact alias match on ").otherwise("alias prefix match on "), F.col("alias")).alias("reasoning"), F.lit("deterministic").alias("resolver_model"),
        ),
        "entities",
    )


def variants(names: DataFrame, raw: str = "contractor_raw") -> DataFrame:
    """Per normalized name: its printed spellings in order of length and text, their number, the longest as representative."""
    keyed = names.select(F.col(raw).alias("raw")).where(F.col("raw").isNotNull()).distinct().withColumn("key", text.normalize_name(F.col("raw"))).where("key <> ''")
    shown = text.display_name(F.col("raw"))
    return keyed.groupBy("key").agg(F.array_sort(F.collect_set("raw")).alias("spellings"), F.count("*").alias("n"), F.max_by("raw", F.struct(F.length(shown), F.col("raw"))).alias("representative"))


def plan(names: DataFrame, fact_map: DataFrame, aliases: DataFrame) -> DataFrame:
    """Per normalized name how it gets resolved: "map", "alias_exact", "alias_prefix" or "queue", and its representative."""
    groups = variants(names)
    matched = match_aliases(groups.select(F.col("representative").alias("contractor_raw")), aliases).select(F.col("raw").alias("representative"), "method")
    known = fact_map.select("key").distinct().withColumn("known", F.lit(True))
    return groups.join(known, "key", "left").join(matched, "representative", "left").select("key", "representative", "n", F.when(F.col("known"), "map").otherwise(F.coalesce("method", F.lit("queue"))).alias("method"))


def fan_out(records: DataFrame, names: DataFrame) -> DataFrame:
    """A company's record for each of its printed spellings; each row keeps its own."""
    keyed = names.select("contractor_raw").where(F.col("contractor_raw").isNotNull()).distinct().withColumn("key", text.normalize_name(F.col("contractor_raw")))
    by_key = keep_first(records.withColumn("key", text.normalize_name(F.col("contractor_raw"))), ["key"], [F.desc("confidence"), "contractor_raw"]).drop("contractor_raw")
    return conform(keyed.join(by_key, "key"), "entities")


def load_fact_map(entries: DataFrame) -> DataFrame:
    """key, record, raw_variants from (name, record, confidence, raw_variants): names normalized again, the surest record of a key, all its variants."""
    keyed = entries.withColumn("key", text.normalize_name(F.col("name"))).where("key <> ''")
    merged = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("raw_variants", F.array().cast("array<string>"))))))
    return keyed.groupBy("key").agg(F.max_by("record", F.struct(F.coalesce("confidence", F.lit(-1.0)), "record")).alias("record"), F.max("confidence").alias("confidence"), merged.alias("raw_variants"))


def known_records(names: DataFrame, fact_map: DataFrame) -> DataFrame:
    """Entity rows of printed names (contractor_raw) whose normalized name the fact map holds."""
    keyed = names.select("contractor_raw").where("contractor_raw IS NOT NULL").distinct().withColumn("key", text.normalize_name(F.col("contractor_raw")))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in TABLES["entities"] if f.name != "contractor_raw")
    found = keyed.join(fact_map.select("key", F.from_json("record", kinds).alias("r")), "key")
    return conform(found.select("contractor_raw", "r.*"), "entities")


def coerce(answers: DataFrame) -> DataFrame:
    """Entity rows of model answers (contractor_raw and text columns): closed list, confidence in range, contradictions capped at 0.5 and noted."""
    ticker = F.upper(text.clean(F.col("ticker")))
    known = F.coalesce(F.col("relationship").isin(RELATIONSHIPS), F.lit(False))
    relation = F.when(known, F.col("relationship")).otherwise("unknown")
    public = F.coalesce(values.model_bool(F.col("is_public")), ticker.isNotNull())
    given = F.col("confidence").try_cast("double")
    private = ticker.isNotNull() & (relation == "private")
    bare = public & ticker.isNull()
    sure = values.clamp(F.coalesce(given, F.lit(0.3)), 0.0, 1.0)
    notes = F.concat_ws("; ", F.when(~known, F.concat(F.lit("relationship "), F.coalesce("relationship", F.lit("None")), F.lit(" not in enum, coerced to unknown"))), F.when(given.isNull(), "no usable confidence returned"), F.when(private, "ticker given with relationship=private"), F.when(bare, "is_public with no ticker"))
    reason = F.coalesce(text.clean(F.col("reasoning")), F.lit("no reasoning returned"))
    return conform(
        answers.select(
            "contractor_raw", F.coalesce(text.clean(F.col("normalized_name")), text.display_name(F.col("contractor_raw"))).alias("normalized_name"), ticker.alias("ticker"), F.nullif("parent_company", F.lit("")).alias("parent_company"), relation.alias("relationship"),
            (public | ticker.isNotNull()).alias("is_public"), F.bround(F.when(private | bare, F.least(sure, F.lit(0.5))).otherwise(sure), 3).alias("confidence"), F.when(notes == "", reason).otherwise(F.concat(reason, F.lit(" [validator: "), notes, F.lit("]"))).alias("reasoning"),
        ),
        "entities",
    )


def from_payloads(answers: DataFrame, asked: DataFrame) -> DataFrame:
    """Entity rows of batched answers (batch, payload with ``entities``) to the names asked (batch, pos, name)."""
    fields = ["normalized_name", "ticker", "parent_company", "relationship", "is_public", "confidence", "reasoning"]
    items = values.exploded(answers.select("batch", "payload"), "entities", fields)
    placed = align(items.select("batch", "pos", "normalized_name", F.struct(*fields).alias("item")), asked)
    return coerce(placed.select(F.col("name").alias("contractor_raw"), "item.*"))


def problems(entities: DataFrame) -> DataFrame:
    """contractor_raw and what is wrong with its row; rows without fault are left out."""
    said = lambda cond, what: F.when(F.coalesce(cond, F.lit(False)), F.lit(what))
    found = F.array_compact(F.array(
        said(~F.col("relationship").isin(RELATIONSHIPS), "relationship outside list"), said((F.col("confidence") < 0) | (F.col("confidence") > 1) | F.col("confidence").isNull(), "confidence outside 0..1"),
        said(F.col("ticker").isNotNull() & ~F.col("is_public"), "ticker of a private company"), said(text.clean(F.col("normalized_name")).isNull(), "no name"),
    ))
    return entities.select("contractor_raw", found.alias("problems")).where(F.size("problems") > 0)


def to_persist(records: DataFrame, existing: DataFrame, review: DataFrame, refresh: bool = False) -> DataFrame:
    """One record per company, neither placeholders nor cases under review, and no known company unless refreshed."""
    keyed = records.withColumn("key", text.normalize_name(F.col("contractor_raw"))).where("key <> '' AND confidence > 0")
    blocked = review.select(text.normalize_name(F.col("item_key")).alias("key")).distinct()
    kept = keep_first(keyed, ["key"], [F.desc("confidence"), "contractor_raw"]).join(blocked, "key", "left_anti")
    return kept if refresh else kept.join(existing.select("key").distinct(), "key", "left_anti")


def align(answers: DataFrame, asked: DataFrame) -> DataFrame:
    """(batch, pos, name, item): answers to names, by place where a batch has as many as asked, else by normalized name, then what is left in order."""
    sizes = asked.groupBy("batch").agg(F.count("*").alias("n")).join(answers.groupBy("batch").agg(F.count("*").alias("m")), "batch", "left")
    a = asked.select("batch", "pos", "name", text.normalize_name(F.col("name")).alias("key")).join(sizes, "batch")
    b = answers.select("batch", F.col("pos").alias("at"), "item", text.normalize_name(F.coalesce("normalized_name", F.lit(""))).alias("key"))
    same = a.where("n = m").join(b.drop("key"), (a.batch == b.batch) & (F.col("pos") == F.col("at"))).select(a.batch, "pos", "name", "item")
    odd = a.where("n <> m")
    first_name = keep_first(odd, ["batch", "key"], [F.desc("pos")])
    first_item = keep_first(b, ["batch", "key"], ["at"])
    by_name = first_name.join(first_item, ["batch", "key"]).select("batch", "pos", "name", "item", "at")
    rank = lambda df, c: df.withColumn("k", F.row_number().over(Window.partitionBy("batch").orderBy(c)))
    left = rank(odd.select("batch", "pos", "name").join(by_name.select("batch", "pos"), ["batch", "pos"], "left_anti"), "pos")
    spare = rank(b.join(by_name.select("batch", "at"), ["batch", "at"], "left_anti"), "at").select("batch", "k", "item")
    rest = left.join(spare, ["batch", "k"]).select("batch", "pos", "name", "item")
    return same.unionByName(by_name.drop("at")).unionByName(rest)


def coverage(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """By method: distinct names and how often they occur."""
    counts = names.groupBy("contractor_raw").agg(F.count("*").alias("mentions"))
    return counts.join(match_aliases(names, aliases).select(F.col("raw").alias("contractor_raw"), "method"), "contractor_raw").groupBy(F.coalesce("method", F.lit("unmatched")).alias("method")).agg(F.count("*").alias("names"), F.sum("mentions").alias("mentions"))


def coverage_by_ticker(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """Per ticker the companies an alias decides, exactly or by prefix, counted by normalized name."""
    found = match_aliases(names, aliases).where("method IS NOT NULL")
    return found.groupBy("ticker").agg(F.countDistinct("key").alias("companies"), F.countDistinct(F.when(F.col("method") == "alias_exact", F.col("key"))).alias("exact"))


def plan_stats(names: DataFrame, planned: DataFrame, size: int = 25) -> DataFrame:
    """One row of a plan: spellings, companies, spellings collapsed, companies by tier, and batches of the rest."""
    n = names.where(F.col("contractor_raw").isNotNull()).agg(F.countDistinct("contractor_raw").alias("distinct_raw"))
    is_ = lambda m: F.count_if(F.col("method") == m)
    got = planned.agg(F.count("*").alias("distinct_normalized"), is_("map").alias("tier0_map"), is_("alias_exact").alias("tier1_exact"), is_("alias_prefix").alias("tier1_prefix"), is_("queue").alias("tier2_queued"))
    return n.join(F.broadcast(got)).withColumn("duplicate_variants", F.col("distinct_raw") - F.col("distinct_normalized")).withColumn("tier2_batches", values.calls(F.col("tier2_queued"), size))


def known_public(awards: DataFrame, given: DataFrame, fact_map: DataFrame, aliases: DataFrame) -> DataFrame:
    """award_uid, is_public, source: what the given entities say of the award's name, else the fact map, else the alias table; null where none does."""
    named = awards.select("award_uid", "contractor_raw").withColumn("key", text.normalize_name(F.col("contractor_raw")))
    first = given.groupBy("contractor_raw").agg(F.max("is_public").alias("g"))
    second = fact_map.groupBy("key").agg(F.max(F.get_json_object("record", "$.is_public").try_cast("boolean")).alias("m"))
    third = match_aliases(awards, aliases).where("method IS NOT NULL").select(F.col("raw").alias("contractor_raw"), F.lit(True).alias("a"))
    j = named.join(first, "contractor_raw", "left").join(second, "key", "left").join(third, "contractor_raw", "left")
    return j.select("award_uid", F.coalesce("g", "m", "a").alias("is_public"), F.when(F.col("g").isNotNull(), "entities").when(F.col("m").isNotNull(), "map").when(F.col("a"), "alias").alias("source"))


def placeholder(spark: SparkSession, raw: Column) -> Column:
    """An honest non-answer: unknown, confidence 0."""
    return F.struct(raw.alias("contractor_raw"), text.display_name(raw).alias("normalized_name"), F.lit("unknown").alias("relationship"), F.lit(0.0).alias("confidence"))
