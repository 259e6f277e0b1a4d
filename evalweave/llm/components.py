"""Connected components by alternating large-star and small-star steps.

Each step is a minimum per node, combined on the map side, and a join; hub nodes are
split by adaptive execution, since minima are written before they are joined. Every
round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.llm.common import discard, stage


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame, most_rounds: int = 100) -> tuple[DataFrame, str]:
    """(node, label) of each node of ``edges`` (a, b) that isn't the smallest of its component, and where it lies."""
    spark = edges.sparkSession
    now, path = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    mark = _mark(now)
    for _ in range(most_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low, low_path = stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-low")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large, large_path = stage(large, "cc")
        least, least_path = stage(large.groupBy("u").agg(F.min("v").alias("m")), "cc-low")
        near = large.join(least, "u")
        small = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        new, new_path = stage(small, "cc")
        new_mark = _mark(new)
        discard(spark, path, low_path, large_path, least_path)
        now, path = new, new_path
        if new_mark == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label")), path
        mark = new_mark
    raise RuntimeError("components did not settle")


def joined(labels: DataFrame, links: DataFrame) -> tuple[DataFrame, str]:
    """The labels of :func:`connected_components` after further links (a, b), and where they lie.

    Components are contracted to their labels first, so the cost follows the new links.
    """
    names = [labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}")) for x in "ab"]
    between = links.join(names[0], "a", "left").join(names[1], "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    found, path = connected_components(between)
    over = found.select(F.col("node").alias("label"), F.col("label").alias("new"))
    # a label that gets another one becomes a node like those that it named
    out, out_path = stage(labels.join(over, "label", "left").select("node", F.coalesce("new", "label").alias("label")).unionByName(found), "cc-labels")
    discard(labels.sparkSession, path)
    return out, out_path
