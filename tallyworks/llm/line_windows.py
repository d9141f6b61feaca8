"""Line dedup over overlapping windows of three lines.

A text is split at newlines. Every window of three consecutive lines with at least one
word is hashed (128 bits); its first occurrence anywhere, by (doc_id, place), stays and
every later one is covered; lines in any covered window go, and what is left is joined
by newlines again. Windows are judged on the input. A window that occurs a great many
times is pre-aggregated to its first place before the shuffle, and joined back by a
join whose hot keys Spark may split.

Defined results: null text stays null and has no lines; texts of fewer than three lines
lose nothing; blank-only windows don't count; a text that loses all its lines becomes
empty; rows with equal doc_id and text count as one place, those with one doc_id and
other texts come in the order of their digests, null doc_ids first; empty table, empty
result. All other columns of the input stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, packed, unpacked

WIDTH = 3


def _lines() -> Column:
    return F.split(F.coalesce("text", F.lit("")), "\n", -1)


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def windows(docs: DataFrame) -> DataFrame:
    """hash, place (doc_id, digest of the text, first line) of every window with a word."""
    split = docs.select("doc_id", _digest(F.coalesce("text", F.lit(""))).alias("digest"), _lines().alias("lines"))
    n = F.size("lines")
    at = F.when(n >= WIDTH, F.sequence(F.lit(0), n - WIDTH)).otherwise(F.array().cast("array<int>"))
    joined = split.select("doc_id", "digest", F.transform(at, lambda i: F.array_join(F.slice("lines", i + 1, WIDTH), "\n")).alias("joined"))
    rows = joined.select("doc_id", "digest", F.posexplode("joined").alias("line", "window")).where(F.col("window").rlike(r"[^\x20\x09-\x0D]"))
    return rows.select(_digest(F.col("window")).alias("hash"), F.struct("doc_id", "digest", "line").alias("place"))


def covered(docs: DataFrame) -> DataFrame:
    """doc_id, digest, starts: the first lines, in order, of the windows of a document that occurred before."""
    all_windows = materialize(windows(docs))  # hashes and places only; read twice
    first = all_windows.groupBy("hash").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first <> last").drop("last")
    later = all_windows.join(first, "hash").where("place > first")
    return later.groupBy(F.col("place.doc_id").alias("doc_id"), F.col("place.digest").alias("digest")).agg(F.array_sort(F.collect_set("place.line")).alias("starts"))


def remove_repeats(docs: DataFrame, counts: bool = True) -> DataFrame:
    """``docs`` with the repeated lines gone from ``text``, and with ``counts`` n_lines and n_removed, in place of columns of those names."""
    hits = covered(docs).select(F.col("doc_id").alias("id"), F.col("digest").alias("hit"), "starts")
    own = packed(docs, "doc_id", "text").withColumn("digest", _digest(F.coalesce("text", F.lit(""))))
    both = own.join(hits, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("hit")), "left")
    cut = both.withColumn("lines", _lines())
    # what lies between the covered runs, as slices: in all as long as the text has lines
    begins = F.concat(F.array(F.lit(0)), F.transform("starts", lambda s: s + WIDTH))
    gaps = F.arrays_zip(begins.alias("a"), F.concat("starts", F.array(F.size("lines"))).alias("b"))
    left = F.flatten(F.transform(gaps, lambda g: F.slice("lines", g["a"] + 1, F.greatest(g["b"] - g["a"], F.lit(0)))))
    cut = cut.withColumn("left", F.when(F.col("starts").isNotNull(), left))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long")
    n_removed = F.when(F.col("starts").isNull(), 0).otherwise(F.size("lines") - F.size("left")).cast("long")
    out = cut.select("doc_id", F.when(F.col("starts").isNull(), F.col("text")).otherwise(F.array_join("left", "\n")).alias("text"), "rest", n_lines.alias("n_lines"), n_removed.alias("n_removed"))
    added = ["n_lines", "n_removed"] if counts else []
    return out.select(*unpacked(out, [c for c in docs.columns if c not in added], "doc_id", "text"), *added)


ORACLE = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
w AS (SELECT doc_id, CAST(unnest(range(len(lines) - 2)) AS BIGINT) AS line, lines FROM d WHERE len(lines) >= 3),
k AS (SELECT doc_id, line, array_to_string(lines[line + 1:line + 3], chr(10)) AS win FROM w),
r AS (SELECT doc_id, line, row_number() OVER (PARTITION BY win ORDER BY doc_id, line) AS nth FROM k
      WHERE regexp_matches(win, '[^\\x20\\x09-\\x0D]')),
lost AS (SELECT DISTINCT doc_id, unnest([line, line + 1, line + 2]) AS line FROM r WHERE nth > 1),
u AS (SELECT doc_id, generate_subscripts(lines, 1) - 1 AS line, unnest(lines) AS body FROM d),
t AS (SELECT u.doc_id, coalesce(string_agg(u.body, chr(10) ORDER BY u.line) FILTER (WHERE lost.line IS NULL), '') AS kept,
             count(*) AS n_lines, count(lost.line) AS n_removed
      FROM u LEFT JOIN lost ON u.doc_id = lost.doc_id AND u.line = lost.line GROUP BY u.doc_id)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed, kept AS text FROM t
"""
