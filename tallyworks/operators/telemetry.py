"""Runs, tokens, cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys, values
from ..registry import conform
from .ranges import medians


def by_agent(runs: DataFrame) -> DataFrame:
    return runs.groupBy("agent").agg(
        F.count("*").alias("runs"), F.count_if("cache_hit").alias("hits"), F.count_if("escalated").alias("escalations"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.round(F.sum("cost_usd"), 6).alias("cost_usd"), F.round(F.avg("confidence"), 6).alias("confidence"), F.round(F.avg(flag("cache_hit")), 6).alias("hit_rate"),
    )


def by_model(runs: DataFrame) -> DataFrame:
    return runs.groupBy("model").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


def spent(runs: DataFrame, rates: dict = values.RATES) -> DataFrame:
    """Calls, tokens and list-price dollars by model and, last, in total: what replaying from a cache saves."""
    cost = values.price(F.col("model"), F.col("input_tokens"), F.col("output_tokens"), rates)
    per = runs.where("model IS NOT NULL").withColumn("usd", cost).rollup("model").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.sum(F.col("usd").cast("decimal(28,6)")).cast("double"), 4).alias("cost_usd"))
    return per.withColumn("model", F.coalesce("model", F.lit("total")))


def by_outcome(runs: DataFrame) -> DataFrame:
    return runs.groupBy(F.coalesce("outcome", F.lit("—")).alias("outcome")).agg(F.count("*").alias("n"))


def flag(c: str) -> Column:
    """A boolean as 0 or 1, null as 0."""
    return F.coalesce(F.col(c), F.lit(False)).cast("int")


def totals(runs: DataFrame) -> DataFrame:
    """One row: runs, live calls, hit and escalation rate, failures, cost."""
    return runs.agg(F.count("*").alias("runs"), F.sum(1 - flag("cache_hit")).alias("live"), F.round(F.avg(flag("cache_hit")), 6).alias("hit_rate"), F.round(F.avg(flag("escalated")), 6).alias("escalation_rate"), F.count_if(F.col("outcome") == "failed").alias("failed"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"))


def recent(runs: DataFrame, n: int = 300) -> DataFrame:
    return runs.orderBy(F.col("started_at").desc_nulls_last(), "run_id").limit(n)


def spikes(turns: DataFrame, key: str, size: str, n: int = 8) -> DataFrame:
    """The ``n`` largest turns above three medians and the median plus 2000."""
    median = medians(turns, [], size, "m")
    j = turns.join(F.broadcast(median)).where(F.col(size) > F.greatest(3 * F.col("m"), F.col("m") + 2000))
    return j.orderBy(F.desc(size), key).select(key, size).limit(n)


def reuse(turns: DataFrame) -> DataFrame:
    """Share of read tokens among all that went in."""
    read, fresh = F.sum("cache_read"), F.sum("input_tokens")
    return turns.agg(F.round(read / F.nullif(read + fresh, F.lit(0)), 6).alias("reuse"))


def record(results: DataFrame, tick: str, agent: str, used_in: int, used_out: int, live_calls: int) -> DataFrame:
    """Run rows of a dispatch's results (item_key, model, confidence): even token shares; without live calls no tokens and a cache hit."""
    n = max(1, results.count())
    share = lambda x: F.lit(x // n if live_calls else 0).cast("long")
    rows = results.withColumns({"input_tokens": share(used_in), "output_tokens": share(used_out)})
    return conform(rows.select(keys.uid(F.lit(tick), F.lit(agent), F.col("item_key")).alias("run_id"), F.lit(tick).alias("tick_id"), F.lit(agent).alias("agent"), "item_key", "model", F.lit(False).alias("escalated"), F.lit(live_calls == 0).alias("cache_hit"), "input_tokens", "output_tokens", values.price(F.col("model"), F.col("input_tokens"), F.col("output_tokens")).alias("cost_usd"), "confidence", F.lit("ok").alias("outcome")), "agent_runs")


def projected_cost(items: DataFrame, chars: str, model: Column, rates: dict = values.RATES) -> DataFrame:
    """Calls, tokens and dollars expected of a queue, by model and in total."""
    tin, tout = values.estimated_tokens(F.col(chars))
    each = items.select(model.alias("model"), tin.alias("tin"), tout.alias("tout"))
    per = each.rollup("model").agg(F.count("*").alias("calls"), F.sum("tin").alias("input_tokens"), F.sum("tout").alias("output_tokens"), F.sum(values.price(F.col("model"), F.col("tin"), F.col("tout"), rates).cast("decimal(28,6)")).cast("double").alias("cost_usd"))
    return per.withColumn("model", F.coalesce("model", F.lit("total")))


def confidence_column(names: list[str]) -> str | None:
    """The first column that reports a confidence."""
    return next((n for n in names if n == "confidence" or n.endswith("_confidence")), None)


def model_column(names: list[str]) -> str | None:
    return next((n for n in names if n == "model" or n.endswith("_model")), None)
