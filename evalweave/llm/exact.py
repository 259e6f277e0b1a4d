"""Exact duplicates by distributed MSD radix partitioning.

Documents are split by successive runs of bytes of their normalised text. A group ends
when it has one member or when its members have no bytes left; what is left in one
group at its end has equal bytes, so no digest decides equality. Each level is one
aggregation, counted on the map side before the shuffle, and one join whose left side
adaptive execution splits where a group is hot. Digits widen geometrically, so a text
of n bytes takes about log8(n / 64) levels, and rows leave as soon as they are alone.

Edge cases: a null text counts as empty and empty texts are equal to each other; rows
without doc_id are returned as groups of their own; rows that repeat a doc_id are
told apart by their text and each is returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalweave.llm.common import discard, near_slots, packed, stage, texts_of, without

_END = 2**31 - 1


def normalised(text: Column) -> Column:
    """The text without characters of ``[\\x20\\x09-\\x0D]``."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")


def _split(active: DataFrame, width: int) -> tuple[DataFrame, str]:
    """One level: rows by their next ``width`` bytes; ``gid`` is null where a row is alone. And a scratch table."""
    rest = F.col("rest")
    # substring of a binary column counts bytes
    keyed = active.select("doc_id", "tag", "n_cp", "sha", F.col("gid").alias("was"), F.substring(rest, 1, width).alias("digit"), (F.length(rest) <= width).alias("ended"), F.expr(f"substring(rest, {width + 1}, {_END})").alias("tail"))
    key = ["was", "digit", "ended"]
    # written first: then both sides of the join are plain exchanges, whose hot partitions adaptive execution splits;
    # merged at any size, as the groups grow with the input
    groups, path = stage(keyed.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "tag")).alias("gid")).where("n > 1").drop("n"), "radix-groups")
    joined = keyed.join(groups.hint("merge"), key, "left")
    alone = F.col("gid").isNull()
    done = alone | F.col("ended")
    return joined.select("doc_id", "tag", "n_cp", "sha", "gid", done.alias("done"), F.when(~done, F.col("tail")).alias("rest")), path


def exact_duplicates(docs: DataFrame, first_width: int = 64, factor: int = 8) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row.

    Of equal normalised texts the row with the most code points, then the smallest
    doc_id stays.
    """
    base = texts_of(docs)
    norm = normalised(F.col("text"))
    facts = base.select("doc_id", F.length("text").cast("long").alias("n_cp"), norm.alias("norm"))
    facts = facts.select("doc_id", "n_cp", F.sha2("norm", 256).alias("sha"), F.xxhash64("norm").alias("tag"), F.col("norm").cast("binary").alias("rest"))
    whole = F.struct(F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("tag"))
    active = facts.where("doc_id IS NOT NULL").withColumn("gid", whole)
    done, width, used = [], first_width, []
    while True:
        split, groups_path = _split(active, width)
        level, path = stage(split, "radix")
        used += [groups_path, path]
        done.append(level.where("done").drop("done", "rest"))
        active = level.where("NOT done").drop("done")
        if active.isEmpty():
            break
        width *= factor
    ended = done[0]
    for part in done[1:]:
        ended = ended.unionByName(part)
    alone = ended.where("gid IS NULL").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    grouped = ended.where("gid IS NOT NULL")
    best, best_path = stage(grouped.groupBy("gid").agg(F.count("*").alias("group_size"), F.expr("max_by(doc_id, struct(n_cp, -doc_id))").alias("keep_id")), "radix-kept")
    members = grouped.join(best.hint("merge"), "gid").select("doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))
    nameless = facts.where("doc_id IS NULL").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    out, _ = stage(alone.unionByName(members).unionByName(nameless), "exact")
    discard(docs.sparkSession, best_path, *used)
    return out


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one for each text, with all their columns; rows without doc_id stay.

    Of rows that share doc_id and normalised text the one with the most code points stays,
    then the first text.
    """
    found = exact_duplicates(docs)
    per_id = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_and("kept").alias("kept"))
    per_id, _ = stage(per_id.where("n > 1 OR NOT kept"), "copies")
    clear = without(docs, per_id)
    # a doc_id of several rows: each row is judged by its own text
    rows, _ = near_slots(packed(docs), per_id.where("n > 1"), ["doc_id"])
    rows = rows.withColumns({"sha": F.sha2(normalised(F.coalesce("text", F.lit(""))), 256), "n_cp": F.coalesce(F.length("text"), F.lit(0))})
    stay = found.where("kept").select("doc_id", F.col("text_sha256").alias("sha")).distinct()
    several = per_id.where("n > 1").select("doc_id").join(stay, "doc_id").hint("merge")
    first = Window.partitionBy("doc_id", "sha").orderBy(F.col("n_cp").desc(), F.col("text"))
    several = rows.join(several, ["doc_id", "sha"], "left_semi").withColumn("place", F.row_number().over(first)).where("place = 1")
    return clear.unionByName(several.select("row.*"))
