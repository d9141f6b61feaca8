"""Connected components by alternating large-star and small-star on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node move to the smallest of its neighbourhood."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of those."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node with an edge: root is the smallest node of its component.

    ``edges`` has columns a, b of one ordered type. A pass is written to the shared folder, so a lost executor costs a pass
    at most; passes number about the logarithm of the longest path.
    """
    at = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        now = at.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if tuple(now) == before or not now.n:
            break
        before = tuple(now)
        after = materialize(_small_star(_large_star(at).distinct()).distinct())
        drop_scratch(at)
        at = after
    return at.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(at.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def grown(comp: DataFrame, links: DataFrame) -> DataFrame:
    """``comp`` (node, root) after more links: only roots that links meet are worked out anew."""
    ends = links.select("a", "b")
    for end in ("a", "b"):
        ends = ends.join(comp.select(F.col("node").alias(end), F.col("root").alias(f"r{end}")), end, "left")
    more = materialize(components(ends.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))))
    moved = comp.join(more.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return moved.unionByName(more.join(comp.select("node"), "node", "left_anti"))
