"""What changed between two refreshes: new ids, moved values, linked modifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys, values
from ..registry import conform
from .events import linked_modifications
from .tables import new_ids, spread


def snapshot(awards: DataFrame, materiality: DataFrame) -> DataFrame:
    """award_uid with amount, score and tier as they stand."""
    return awards.select("award_uid", "amount_usd", F.lit(True).alias("has_award")).join(materiality.select("award_uid", "score", "tier", F.lit(True).alias("has_score")), "award_uid", "full")


def _row(kind: str, change_id: Column, **cols: Column) -> list[Column]:
    return [change_id.alias("change_id"), F.lit(kind).alias("change_type"), *[c.alias(k) for k, c in cols.items()]]


def new_announcements(before: DataFrame, after: DataFrame) -> DataFrame:
    ids = new_ids(before, after, "announcement_id")
    return ids.select(*_row("new_announcement", keys.uid(F.lit("new_announcement"), F.col("announcement_id")), announcement_id=F.col("announcement_id")))


def about(awards: DataFrame, entities: DataFrame, materiality: DataFrame) -> DataFrame:
    """award_uid, announcement_id, ticker, score."""
    tickers = entities.groupBy("contractor_raw").agg(F.first("ticker").alias("ticker"))
    return awards.select("award_uid", "announcement_id", "contractor_raw").join(tickers, "contractor_raw", "left").join(spread(materiality.select("award_uid", F.col("score").alias("materiality_score")), "award_uid"), "award_uid", "left").drop("contractor_raw")


def new_awards(before: DataFrame, awards: DataFrame) -> DataFrame:
    ids = new_ids(before, awards, "award_uid")
    return ids.select(*_row("new_award", keys.uid(F.lit("new_award"), F.col("award_uid")), award_uid=F.col("award_uid")))


def tracked_modifications(awards: DataFrame, contracts: DataFrame) -> DataFrame:
    linked = linked_modifications(awards, contracts)
    return linked.select(*_row("modification_on_tracked", keys.uid(F.lit("modification_on_tracked"), F.col("award_uid")), award_uid=F.col("award_uid"), prev_value=F.col("prev_value"), new_value=F.col("new_value")))


def amount_changes(before: DataFrame, awards: DataFrame) -> DataFrame:
    """Known awards whose amount is another one now; a lost amount is no change."""
    old = spread(before.select("award_uid", F.col("amount_usd").alias("old")), "award_uid")
    moved = awards.select("award_uid", F.col("amount_usd").alias("new")).join(old, "award_uid").where(F.col("new").isNotNull() & ~F.col("new").eqNullSafe(F.col("old")))
    return moved.select(*_row("amount_changed", keys.uid(F.lit("amount_changed"), F.col("award_uid"), F.col("old"), F.col("new")), award_uid=F.col("award_uid"), prev_value=values.usd(F.col("old")), new_value=values.usd(F.col("new"))))


def rescored(before: DataFrame, materiality: DataFrame) -> DataFrame:
    """Scored awards whose score or tier is another one now."""
    old = spread(before.select("award_uid", F.col("score").alias("s0"), F.col("tier").alias("t0")), "award_uid")
    moved = materiality.select("award_uid", F.col("score").alias("s1"), F.col("tier").alias("t1")).join(old, "award_uid").where(~F.col("s0").eqNullSafe(F.col("s1")) | ~F.col("t0").eqNullSafe(F.col("t1")))
    said = lambda s, t: F.concat(F.coalesce(F.col(s).cast("string"), F.lit("None")), F.lit(" ("), F.coalesce(t, F.lit("None")), F.lit(")"))
    return moved.select(*_row("rescored", keys.uid(F.lit("rescored"), F.col("award_uid"), F.col("s0"), F.col("s1")), award_uid=F.col("award_uid"), prev_value=said("s0", "t0"), new_value=said("s1", "t1")))


def of_awards(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """The four kinds that name an award, without what ``about`` says of it."""
    out = new_awards(before["awards"], after["awards"])
    for part in (
        tracked_modifications(after["awards"], after["contracts"]),
        amount_changes(before["awards"], after["awards"]),
        rescored(before["materiality"], after["materiality"]),
    ):
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def detect_changes(before: dict[str, DataFrame], after: dict[str, DataFrame], facts: DataFrame | None = None) -> DataFrame:
    """All five kinds between two sets of the tables announcements, awards, contracts, entities, materiality (contracts and entities of ``after`` only).

    The sets may hold just the rows that differ; then ``facts`` are those of ``about`` for their awards.
    """
    facts = facts if facts is not None else about(after["awards"], after["entities"], after["materiality"])
    found = of_awards(before, after).join(facts, "award_uid", "left")
    return conform(new_announcements(before["announcements"], after["announcements"]), "changes").unionByName(conform(found, "changes"))


def by_kind(changes: DataFrame) -> DataFrame:
    """How many changes there are of each kind."""
    return changes.groupBy("change_type").agg(F.count("*").alias("n"))


def histogram(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """``by_kind`` of ``detect_changes``, which needs no facts; award_uid is the key of awards and scores."""
    return by_kind(of_awards(before, after).select("change_type").unionByName(new_announcements(before["announcements"], after["announcements"]).select("change_type")))


def survey(known: DataFrame, manifest: DataFrame, feed: DataFrame) -> DataFrame:
    """Ids to fetch or load: in the feed but not the manifest, in the manifest but not known."""
    key = "announcement_id"
    return new_ids(known, manifest, key).select(key, F.lit("unloaded").alias("state")).unionByName(new_ids(manifest, feed, key).select(key, F.lit("unfetched").alias("state")))
