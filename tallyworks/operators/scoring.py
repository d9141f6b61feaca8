"""Materiality: context, prefilter, batches, answers, escalation."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys, text, values
from ..registry import TIERS, conform
from .ranges import cumulative


def context(awards: DataFrame) -> DataFrame:
    """Per award: percentile of its amount (share strictly below, half to even), its contractor's rows and total.

    Counts below an amount come from a histogram of distinct amounts, whose running sum is small beside the table.
    """
    amounts = awards.where("amount_usd IS NOT NULL").groupBy("amount_usd").agg(F.count("*").alias("n"))
    ordered = cumulative(amounts, "amount_usd", "n")
    pct = F.bround(100.0 * F.col("below") / F.col("total"), 0).cast("int")
    by_name = awards.groupBy(F.trim(F.coalesce("contractor_raw", F.lit(""))).alias("name")).agg(F.count("*").alias("contractor_awards_in_window"), F.sum(F.coalesce("amount_usd", F.lit(0))).alias("contractor_total_usd"))
    rows = awards.select("award_uid", "amount_usd", F.trim(F.coalesce("contractor_raw", F.lit(""))).alias("name"))
    return rows.join(ordered.select("amount_usd", pct.alias("amount_percentile")), "amount_usd", "left").join(by_name, "name").select("award_uid", "amount_percentile", "contractor_awards_in_window", "contractor_total_usd")


def prefilter(awards: DataFrame, entities: DataFrame) -> DataFrame:
    """Awards with the rule that shows them routine, its score and rationale; a null rule leaves the award to a model.

    First that fits: unknown amount or a listed company, none; resolved private, set-aside, any, each below its floor.
    """
    known = entities.groupBy("contractor_raw").agg(F.max("ticker").alias("ticker"), F.max(F.struct("confidence", "relationship", "is_public")).alias("e"))
    j = awards.join(known, "contractor_raw", "left")
    amount = F.col("amount_usd")
    private = F.coalesce((F.col("e.relationship") == "private") & ~F.col("e.is_public") & (F.col("e.confidence") >= values.LOW_CONFIDENCE), F.lit(False))
    rule = F.when(amount.isNull() | F.coalesce("ticker", F.lit("")).__ne__(""), None)
    for name, cond in (("resolved_private", private), ("small_business_setaside", F.coalesce("small_business", F.lit(False))), ("sub_floor_unlisted", F.lit(True))):
        rule = rule.when(cond & (amount < values.FLOORS[name]), name)
    ceiling = F.create_map(*[x for k, v in values.FLOORS.items() for x in (F.lit(k), F.lit(v))])[F.col("rule")]
    score = F.when(F.col("rule").isNotNull(), values.routine_score(amount, ceiling))
    drivers = F.when(F.col("rule").isNotNull(), F.array(F.concat(F.lit("prefilter:"), F.col("rule")), F.lit("unlisted_contractor"), F.lit("below_size_floor")))
    return j.withColumn("rule", rule).select("award_uid", "amount_usd", "rule", score.alias("score"), F.when(F.col("rule").isNotNull(), values.tier_for(score)).alias("tier"), drivers.alias("drivers"))


def fact_lines(awards: DataFrame, context: DataFrame) -> DataFrame:
    """One line of facts per award for a prompt."""
    yes = lambda c, s: F.when(F.coalesce(c, F.lit(False)), F.lit(s))
    line = text.fact_line(
        F.coalesce("contractor_raw", F.lit("?")), F.concat(F.lit("amount "), values.usd_fact(F.col("amount_usd"))), F.concat(F.lit("action "), F.col("action_type")), yes(F.col("small_business"), "small business set-aside"), yes(F.col("is_multi_award"), "multi-award"),
        F.when(F.col("amount_percentile").isNotNull(), F.concat(F.lit("percentile "), F.col("amount_percentile").cast("string"))), F.concat(F.col("contractor_awards_in_window").cast("string"), F.lit(" award(s) in window")), text.truncate(text.clean(F.col("work_description")), 400),
    )
    return awards.join(context, "award_uid").select("award_uid", line.alias("line"))


def prompts(lines: DataFrame, batches: DataFrame) -> DataFrame:
    """Numbered lines of each batch, in the order of ids; batches are of bounded size."""
    got = batches.join(lines, "award_uid").groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("award_uid", "line"))).alias("items"))
    return got.select("batch", F.size("items").alias("n"), text.numbered(F.transform("items", lambda i: i["line"])).alias("prompt"))


def content_batches(ids: DataFrame, key: str = "award_uid", size: int = 20, share: float = 0.7, per_segment: int = 50_000) -> DataFrame:
    """``key`` and its batch: ids in order, cut at ``size``, or from share * size on where an id's hash says so. A new id changes the batches from its own up to where the cuts meet again: none or a few, 11 of 50 in one trial.

    The fold's only state is the length of the open batch, one of ``size`` values. Ranges of ids report where each state
    leads and how many cuts it makes; the driver chains these few rows and every range is then cut from its own state.
    The ranges' bounds are ids picked by hash, at most about 1000.
    """
    low = max(2, int(size * share))
    rows = ids.select(F.col(key).cast("string").alias(key)).where(F.col(key).isNotNull()).distinct()
    n = rows.count()
    wanted = max(1, min(1000, n // per_segment))
    marks = sorted(r[0] for r in rows.where(F.pmod(F.xxhash64(key), F.lit(max(1, n // wanted))) == 0).collect()) if wanted > 1 else []
    cut = keys.hash_boundary(F.col(key), size)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [bisect.bisect_right(marks, k) for k in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.int64())], names=[key, "cut", "segment"])

    placed = rows.select(key, cut.alias("cut")).mapInArrow(place, f"{key} string, cut boolean, segment long")

    def step(length: int, at_cut: bool) -> tuple[int, int]:
        return (0, 1) if length + 1 >= size or (length + 1 >= low and at_cut) else (length + 1, 0)

    def report(group: pa.Table) -> pa.Table:
        cuts = group.sort_by(key).column("cut").to_pylist()
        ends, made = [], []
        for length in range(size):
            total = 0
            for c in cuts:
                length, one = step(length, c)
                total += one
            ends.append(length)
            made.append(total)
        return pa.table({"segment": pa.array([group.column("segment")[0].as_py()] * size), "begin": pa.array(range(size), pa.int64()), "finish": pa.array(ends, pa.int64()), "made": pa.array(made, pa.int64())})

    leads = {(r.segment, r.begin): (r.finish, r.made) for r in placed.groupBy("segment").applyInArrow(report, "segment long, begin long, finish long, made long").collect()}
    entry, length, batch = {}, 0, 0
    for segment in sorted({k for k, _ in leads}):
        entry[segment] = (length, batch)
        length, made = leads[segment, length]
        batch += made

    def fold(group: pa.Table) -> pa.Table:
        group = group.sort_by(key)
        length, batch = entry[group.column("segment")[0].as_py()]
        out = []
        for c in group.column("cut").to_pylist():
            out.append(batch)
            length, made = step(length, c)
            batch += made
        return pa.table({key: group.column(key), "batch": pa.array(out, pa.int64())})

    return placed.groupBy("segment").applyInArrow(fold, f"{key} string, batch long")


def fixed_batches(names: DataFrame, key: str, size: int = 25) -> DataFrame:
    """Batches of ``size`` in case-blind order."""
    rows = names.select(key).distinct().withColumn("folded", text.casefold(F.col(key)))
    at = cumulative(rows.withColumn("sort", F.struct("folded", key)).withColumn("n", F.lit(1)), "sort", "n")
    return at.select(key, F.floor(F.col("below") / size).cast("long").alias("batch"))


def align(answers: DataFrame, asked: DataFrame) -> DataFrame:
    """Answers by place: (batch, pos, award_uid, score); what was not answered is null, surplus answers go."""
    return asked.join(answers, ["batch", "pos"], "left")


def coerce(answers: DataFrame) -> DataFrame:
    """Scores of answers (award_uid, score, tier, rationale, drivers JSON, confidence as text): 0 to 100, the band decides the tier, a wrong tier caps confidence at 0.6, no score is 0 at 0.3."""
    given = values.model_int(F.col("score"))
    score = F.coalesce(values.clamp(given, 0, 100).cast("int"), F.lit(0))
    tier = values.tier_for(score)
    sure = values.clamp(F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.5)), 0.0, 1.0)
    sure = F.when(given.isNull(), F.lit(0.3)).when(~F.coalesce(F.col("tier") == tier, F.lit(False)), F.least(sure, F.lit(0.6))).otherwise(sure)
    rationale = F.coalesce(text.truncate(text.clean(F.col("rationale")), 600), F.lit("no rationale returned"))
    return answers.select("award_uid", score.alias("score"), tier.alias("tier"), rationale.alias("rationale"), F.to_json(text.tags(values.as_list(F.col("drivers")))).alias("drivers"), sure.alias("confidence"))


def from_payloads(answers: DataFrame, asked: DataFrame) -> DataFrame:
    """Scores of batched answers (batch, payload with ``scores``) to the awards asked (batch, pos, award_uid)."""
    items = values.exploded(answers.select("batch", "payload"), "scores", ["score", "tier", "rationale", "drivers", "confidence"])
    return coerce(align(items, asked))


def escalate(rows: DataFrame, second: DataFrame, key: str, pending: Column | None = None) -> DataFrame:
    """``rows`` with the second answer where the first is unsure; still unsure rows are flagged for review; pending rows are neither."""
    hold = F.lit(False) if pending is None else F.coalesce(pending, F.lit(False))
    unsure = values.needs_escalation(F.col("confidence")) & ~hold
    other = second.select(key, *[F.col(c).alias(f"__{c}") for c in rows.columns if c != key], F.lit(True).alias("__hit"))
    j = rows.withColumn("__unsure", unsure).withColumn("__hold", hold).join(other, key, "left")
    take = F.col("__unsure") & F.coalesce("__hit", F.lit(False))
    got = j.select(key, *[F.when(take, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in rows.columns if c != key], F.col("__unsure").alias("escalated"), "__hold")
    return got.withColumn("review", values.needs_escalation(F.col("confidence")) & ~F.col("__hold")).drop("__hold")


def score_stats(awards: DataFrame, filtered: DataFrame, rows: DataFrame, size: int = 20) -> DataFrame:
    """One row: awards, those a rule decided and their share, the model's queue, its batches, calls saved against one per award, rows by tier."""
    n = awards.agg(F.count("*").alias("awards"))
    rules = filtered.agg(F.count("rule").alias("prefiltered"), F.count_if(F.col("rule").isNull()).alias("model_queue"))
    tiers = rows.agg(*[F.count_if(F.col("tier") == t).alias(t) for t in TIERS])
    batches = values.calls(F.col("model_queue"), size)
    return n.join(F.broadcast(rules)).join(F.broadcast(tiers)).select(  # a row each
        "awards", "prefiltered", F.coalesce(F.round(F.col("prefiltered") / F.nullif("awards", F.lit(0)), 4), F.lit(0.0)).alias("prefilter_share"), "model_queue", batches.alias("batches"), (F.col("awards") - batches).alias("calls_saved"), *TIERS
    )


def review_rows(rows: DataFrame, agent: str, key: str, reason: Column) -> DataFrame:
    """Queue rows for what needs a person."""
    item = F.col(key).cast("string")
    return conform(rows.select(keys.uid(F.lit(agent), item, reason).alias("review_id"), F.lit(agent).alias("agent"), item.alias("item_key"), reason.alias("reason"), F.col("confidence").cast("double").alias("confidence"), F.to_json(F.struct(*rows.columns)).alias("payload"), F.lit(False).alias("resolved")), "review_queue")


def problems(rows: DataFrame) -> DataFrame:
    """Materiality rows against the contract: award_uid and what is wrong."""
    said = lambda cond, what: F.when(F.coalesce(cond, F.lit(True)), F.lit(what))
    found = F.array_compact(F.array(
        said(F.col("score").isNull() | (F.col("score") < 0) | (F.col("score") > 100), "score outside 0..100"), said(~F.col("tier").isin(TIERS), "tier outside list"), said(F.col("tier") != values.tier_for(F.col("score")), "tier does not band score"),
        said(text.clean(F.col("rationale")).isNull(), "rationale is empty"), said(~(F.trim("drivers").startswith("[") & F.try_parse_json("drivers").isNotNull()), "drivers is not a list"),
    ))
    return rows.select("award_uid", found.alias("problems")).where(F.size("problems") > 0)


def token_share(runs: DataFrame, total: str, batch: list[str]) -> DataFrame:
    """Every row's even share of its batch's tokens; the remainder is dropped."""
    n = F.count("*").over(Window.partitionBy(*batch))
    return runs.withColumn("share", F.floor(F.col(total) / n).cast("long"))


def ask(prompts: DataFrame, answer: object, schema: str, batch_size: int = 20) -> DataFrame:
    """Runs an injected pure function ``answer(list[dict]) -> list[dict]`` over Arrow batches."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for k in range(0, len(rows), batch_size):
                yield pa.RecordBatch.from_pylist(answer(rows[k : k + batch_size]), schema=arrow)

    return prompts.mapInArrow(run, schema)
