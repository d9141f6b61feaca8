"""Orders too large for one task: running sums and carried values over range partitions, and values by rank.

The partitions are written once, so every later look sees the same ones; a row or two of each reach
the driver, which chains them. Values by rank come from histograms that narrow in passes, so no group's
values ever meet in one buffer.
"""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

PART, BINS = "__part", 1024


def settled(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder of ``spark.checkpoint.dir``; one of our own only in local mode where that is unset."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and context.getCheckpointDir() is None:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir("file://" + os.path.join(tempfile.gettempdir(), "tallyworks-checkpoints"))
    return df.checkpoint()


def laid_out(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` in range partitions by ``order``, ascending, with PART."""
    return settled(df.repartitionByRange(*order).withColumn(PART, F.spark_partition_id()))


def _equal(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in names])


def cumulative(df: DataFrame, key: str, n: str) -> DataFrame:
    """Adds ``below``, the sum of ``n`` over smaller keys, and ``total``, over all. Keys should be distinct."""
    rows = laid_out(df, [key])
    sizes = rows.groupBy(PART).agg(F.sum(n).cast("long").alias("size")).orderBy(PART).collect()  # a row each partition
    before, base = 0, []
    for r in sizes:
        base.append((r[PART], before))
        before += r["size"] or 0
    held = df.sparkSession.createDataFrame(base, StructType([StructField(PART, IntegerType()), StructField("__base", LongType())]))
    upto = F.sum(n).over(Window.partitionBy(PART).orderBy(key)).cast("long")
    out = rows.withColumn("__upto", upto).join(F.broadcast(held), PART)
    return out.withColumns({"below": F.col("__base") + F.col("__upto") - F.col(n), "total": F.lit(before).cast("long")}).drop(PART, "__upto", "__base")


def carried(df: DataFrame, value: Column, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Adds ``name``: the latest ``value`` that isn't null up to the row, among rows of its keys in ``order`` (nulls first; total within a key).

    A key's rows may span any number of partitions: each is scanned by itself, and what its last key carries goes to the next.
    """
    rows = laid_out(df.withColumn("__value", value), [*keys, *order])
    local = F.last("__value", ignorenulls=True).over(Window.partitionBy(PART, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__local", local)
    group = F.struct(F.lit(0).alias("__one"), *keys)
    ends = rows.groupBy(PART, *keys).agg(F.max_by(F.struct(F.col("__local").alias("v")), F.struct(*order)).alias("end"))
    edges = ends.groupBy(PART).agg(F.min(group).alias("low"), F.max(group).alias("high"), F.max_by("end", group).alias("end")).orderBy(PART).collect()
    carry, at, held = [], None, None  # the key that the partitions so far end in, and its value
    for r in edges:
        if at is not None and at == r.low and held is not None:
            carry.append((r[PART], *r.low[1:], held))
        held = r.end.v if r.end.v is not None else held if at == r.low == r.high else None
        at = r.high
    schema = StructType([StructField(PART, IntegerType()), *[StructField(k, rows.schema[k].dataType) for k in keys], StructField("__carry", rows.schema["__value"].dataType)])
    given = F.broadcast(df.sparkSession.createDataFrame(carry, schema))
    both = rows.join(given, _equal(rows, given, [PART, *keys]), "left")
    return both.select(*[rows[c] for c in df.columns if c != name], F.coalesce(rows["__local"], given["__carry"]).alias(name))


def by_rank(df: DataFrame, groups: list[str], value: str, ranks: Callable[[Column], list[Column]]) -> DataFrame:
    """groups, which, value: of each group's finite values in order those at the ranks (from 0) that ``ranks`` makes of their number.

    A pass counts, for each open rank, the values in BINS equal parts of the interval it must lie in, and goes on with one part;
    the ends of an interval are values, so each pass drops some, and a few passes leave one.
    """
    plain = df.where(F.col(value).isNotNull()).select(*groups, F.lit(0).alias("__one"), F.col(value).alias("__v"))
    names = [*groups, "__one"]
    state = plain.groupBy(*names).agg(F.count("*").alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
    state = settled(state.select(*names, F.posexplode(F.array(*[r.cast("long") for r in ranks(F.col("n"))])).alias("which", "k"), "lo", "hi"))
    half = lambda c: F.col(c).cast("double") / 2  # noqa: E731  whole differences may overflow
    while not (open_ranks := state.where("lo < hi")).isEmpty():
        both = plain.join(open_ranks.withColumnsRenamed({c: f"__{c}" for c in groups}), reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in groups], plain["__one"] == open_ranks["__one"]))
        both = both.where("__v BETWEEN lo AND hi")
        wide = half("hi") > half("lo")
        at = F.when(wide, F.floor((half("__v") - half("lo")) / (half("hi") - half("lo")) * BINS)).otherwise(F.col("__v") - F.col("lo"))
        cells = both.groupBy(*groups, "which", "k", F.least(at.cast("long"), F.lit(BINS - 1)).alias("bin")).agg(F.count("*").alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
        upto = F.sum("n").over(Window.partitionBy(*groups, "which").orderBy("bin"))
        found = cells.withColumn("upto", upto).where("upto > k AND upto - n <= k")
        state = settled(state.where("NOT lo < hi").unionByName(found.select(*groups, F.lit(0).alias("__one"), "which", (F.col("k") - F.col("upto") + F.col("n")).alias("k"), "lo", "hi")))
    return state.select(*groups, "which", F.col("lo").alias(value))


def medians(df: DataFrame, groups: list[str], value: str, name: str) -> DataFrame:
    """The mean of the two middle values of each group, or the middle one."""
    got = by_rank(df, groups, value, lambda n: [F.floor((n - 1) / 2), F.floor(n / 2)])
    return got.groupBy(*groups).agg(F.avg(value).alias(name))


def upper_medians(df: DataFrame, groups: list[str], value: str, name: str) -> DataFrame:
    """Element n div 2 of each group's sorted values, from 0; null of a group without any."""
    got = by_rank(df, groups, value, lambda n: [F.floor(n / 2)]).select(*[F.col(c).alias(f"__{c}") for c in groups], F.col(value).alias(name))
    every = df.select(*groups).distinct()
    return every.join(got, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in groups]), "left").select(*groups, name)
