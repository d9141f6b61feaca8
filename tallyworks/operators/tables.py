"""General operators on keyed tables: first and last rows, upsert, queues, top rows, set differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key; ``order`` should be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def upsert(target: DataFrame, rows: DataFrame, key: str, position: str) -> DataFrame:
    """``target`` with ``rows`` in place of those of equal key; of rows that repeat a key the last by ``position`` wins, a null key is an error."""
    checked = rows.withColumn(key, F.when(F.col(key).isNull(), F.raise_error(F.lit(f"null {key}")).cast(rows.schema[key].dataType)).otherwise(F.col(key)))
    last = keep_first(checked, [key], [F.col(position).desc()]).drop(position)
    return target.join(last, key, "left_anti").unionByName(last, allowMissingColumns=True)


def set_values(df: DataFrame, patch: DataFrame, key: str, column: str) -> DataFrame:
    """``column`` from ``patch`` where it has the key."""
    new = patch.select(key, F.col(column).alias("__new"), F.lit(True).alias("__hit"))
    return df.join(new, key, "left").withColumn(column, F.when(F.col("__hit"), F.col("__new")).otherwise(F.col(column))).select(df.columns)


def not_in(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    return df.join(other.select(*on).distinct(), on, "left_anti")


def missing_or_stale(df: DataFrame, known: DataFrame, key: str, stale: Column) -> DataFrame:
    """Distinct keys of ``df`` that ``known`` lacks or holds in a stale row."""
    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    fresh = known.where(~F.coalesce(stale, F.lit(True))).select(key).distinct()
    return keys.join(fresh, key, "left_anti")


def top(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def new_ids(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Ids, as text, of ``after`` that ``before`` lacks."""
    text = lambda df: df.select(F.col(key).cast("string").alias(key)).where(F.col(key).isNotNull())
    return text(after).join(spread(text(before), key), key, "left_anti").distinct()


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` by the hash of ``key`` in all of ``spark.sql.shuffle.partitions``, for a join on it.

    Adaptive execution merges partitions by their compressed bytes; of short rows it would put millions into one task's sorts.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def last_seen(value: Column, partition: list[str], order: list[str]) -> Column:
    """The latest value that isn't null up to the row."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def running_total(value: Column, partition: list[str], order: list[Column | str]) -> Column:
    return F.sum(F.coalesce(value, F.lit(0))).over(Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def upper_median(value: Column) -> Column:
    """Element n div 2 of the sorted values, from 0; for bounded groups."""
    values = F.array_sort(F.collect_list(value))
    return F.element_at(values, (F.size(values) / 2).cast("int") + 1)


def tail(df: DataFrame, text: str, order: str, n: int) -> DataFrame:
    """The last ``n`` lines that begin with a backtick."""
    return df.where(F.col(text).startswith("`")).orderBy(F.col(order).desc()).limit(n)


def any_of(column: str, values: list) -> Column:
    """Membership; an empty list lets all rows through."""
    return F.col(column).isin(values) if values else F.lit(True)
