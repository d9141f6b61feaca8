"""Running sums, carried values and values by rank, against windows and sorted lists."""

import math
import random
import statistics

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyworks.operators import events, quality, ranges
from tallyworks.sources import readers


def plan_of(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("n, partitions", [(0, 4), (1, 4), (37, 1), (200, 7), (30, 40)])
def test_carried_values_equal_the_window(spark, n, partitions):
    rng = random.Random(n)
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(rng.choice(["a", "a", "a", "b", "c", None]), k if k % 9 else None, rng.choice([None, None, None, f"v{k}"])) for k in range(n)]
        df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "row int, g string, pos int, v string")
        for keys in ([], ["g"]):
            order = ["pos", "row"]
            want = df.withColumn("last", F.last("v", True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
            got = ranges.carried(df, F.col("v"), keys, order, "last")
            assert sorted(got.select("row", "last").collect()) == sorted(want.select("row", "last").collect())
            assert "SinglePartition" not in plan_of(got)
        numbered = df.select("row", F.lit(3).alias("n"))
        assert sorted(ranges.cumulative(numbered, "row", "n").collect()) == [(k, 3, 3 * k, 3 * n) for k in range(n)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_transcripts_are_scanned_without_a_single_task(spark):
    lines = spark.createDataFrame([(k, '{"name": "Ann"}' if k == 1 else f'{{"message": {{"id": "m{k}", "usage": {{"input_tokens": {k}}}}}}}') for k in range(50)], "position int, value string")
    got = readers.transcript_turns(lines)
    assert {r.id: r.name for r in got.collect()} == {f"m{k}": "Ann" if k > 1 else None for k in range(50) if k != 1}
    assert "SinglePartition" not in plan_of(got)


@pytest.mark.parametrize("kind", ["long", "double", "ties", "wide", "int"])
def test_values_by_rank(spark, kind):
    rng = random.Random(kind)
    make = {"long": lambda: rng.randrange(-10**6, 10**6), "double": lambda: rng.expovariate(1) ** 9 * rng.choice([1, -1]), "ties": lambda: rng.choice([5, 5, 5, 7]), "wide": lambda: rng.choice([-(2**63), 2**63 - 1, 2**62, 2**62 + 1, 0]), "int": lambda: rng.randrange(99)}[kind]
    rows = [(rng.choice(["a", "b", None]), make() if rng.random() < 0.9 else None) for _ in range(400)] + [("one", make()), ("none", None), ("two", make()), ("two", make())]
    df = spark.createDataFrame(rows, f"g string, v {'double' if kind == 'double' else 'int' if kind == 'int' else 'long'}")
    values = {}
    for g, v in rows:
        values.setdefault(g, []).extend([] if v is None else [v])
    assert {r.g: r.m for r in ranges.upper_medians(df, ["g"], "v", "m").collect()} == {g: sorted(v)[len(v) // 2] if v else None for g, v in values.items()}
    if kind != "wide":
        got = {r.g: r.m for r in ranges.medians(df, ["g"], "v", "m").collect()}
        assert got.keys() == {g for g, v in values.items() if v} and all(math.isclose(got[g], statistics.median(values[g])) for g in got)
        whole = [x for v in values.values() for x in v]
        assert math.isclose(ranges.medians(df, [], "v", "m").first().m, statistics.median(whole))
    few = ranges.by_rank(df, [], "v", lambda n: [F.lit(0), n - 1, F.floor(n * 0.9)]).orderBy("which").collect()
    whole = sorted(x for v in values.values() for x in v)
    assert [r.v for r in few] == [whole[0], whole[-1], whole[int(len(whole) * 0.9)]]


def test_rows_without_a_contract_spread(spark):
    awards = spark.createDataFrame([(f"a{k}", None, "Acme", None, "new_award", None, 5, None) for k in range(200)], "award_uid string, announced_date date, contractor_raw string, contract_number string, action_type string, modification_number string, amount_usd long, base_contract_number string")
    got = events.prepare(awards)
    assert got.where("is_creating_event OR duplicate_of IS NOT NULL").count() == 0
    assert got.select(F.spark_partition_id()).distinct().count() > 1 or "hashpartitioning(contract_uid" in plan_of(got) and "xxhash64" in plan_of(got)


def test_findings_limit_ranks_before_the_shuffle(spark):
    checked = spark.createDataFrame([("A", "s", "error", f"k{k:03}", "d") for k in range(100)] + [("B", "s", "warn", "x", "d")], "code string, stage string, severity string, item_key string, detail string")
    got = quality.findings(checked, min_rows=2)
    assert [(r.code, r.n, r["sample"]) for r in got.collect()] == [("A", 100, [f"k{k:03}" for k in range(5)])]
    assert "WindowGroupLimit" in plan_of(got)
