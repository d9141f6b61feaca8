from tallyworks.operators import changes, tables
from tallyworks.plans import catalog

from .conftest import SF

AWARDS = "award_uid string, announcement_id string, contractor_raw string, amount_usd long, contract_uid string, duplicate_of string, is_creating_event boolean, action_type string, cumulative_face_value_usd long"
CONTRACTS = "contract_uid string, contract_number string, n_events int, first_event_date date, total_actioned_usd long, history_complete boolean"


def _sides(spark):
    docs = lambda *ids: spark.createDataFrame([(i,) for i in ids], "announcement_id string")
    rows = [("a1", "d1", "Acme", 5, "c1", None, True, "new_award", None), ("a2", "d1", "Acme", 7, "c1", None, False, "modification", None), ("a3", "d2", None, None, None, None, False, None, None)]
    award = lambda rows: spark.createDataFrame(rows, AWARDS)
    score = lambda *rows: spark.createDataFrame(list(rows), "award_uid string, score int, tier string")
    after = {"announcements": docs("d1", "d2", None), "awards": award(rows), "contracts": spark.createDataFrame([("c1", "W1", 2, None, 12, True)], CONTRACTS), "entities": spark.createDataFrame([("Acme", "A")], "contractor_raw string, ticker string"), "materiality": score(("a1", 9, "alert"), ("a2", 3, None))}
    before = {"announcements": docs("d1", None), "awards": award([("a1", "d1", "Acme", 4, "c1", None, True, "new_award", None)]), "materiality": score(("a1", 9, None), ("a2", 3, None))}
    return before, after


def test_feed_has_facts_and_the_histogram_its_counts(spark):
    before, after = _sides(spark)
    feed = changes.detect_changes(before, after)
    got = {(r.change_type, r.award_uid or r.announcement_id, r.announcement_id, r.ticker, r.materiality_score, r.prev_value) for r in feed.collect()}
    assert got == {
        ("new_announcement", "d2", "d2", None, None, None), ("new_award", "a2", "d1", "A", 3, None), ("new_award", "a3", "d2", None, None, None), ("amount_changed", "a1", "d1", "A", 9, "$4"),
        ("rescored", "a1", "d1", "A", 9, "9 (None)"), ("modification_on_tracked", "a2", "d1", "A", 3, "W1 · 1 prior event(s) since None"),
    }
    assert sorted(map(tuple, changes.histogram(before, after).collect())) == sorted(map(tuple, changes.by_kind(feed).collect()))


def test_histogram_joins_no_facts(spark):
    """An award's id is looked up by the three kinds that compare it, not once more for what is said of it."""
    plan = catalog.queries()["change_histogram"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Join" in line and "award_uid" in line for line in plan.split("\n")) == 3


def test_joins_on_ids_keep_all_partitions(spark):
    """Merged by bytes, a task's share of short rows grew with the table."""
    before, after = _sides(spark)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = [tables.new_ids(before["awards"], after["awards"], "award_uid"), changes.amount_changes(before["awards"], after["awards"]), changes.rescored(before["materiality"], after["materiality"])]
        assert [df.rdd.getNumPartitions() for df in found] == [int(spark.conf.get("spark.sql.shuffle.partitions"))] * 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
