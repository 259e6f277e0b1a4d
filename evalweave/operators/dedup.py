"""Keyed merging, deduplication and set comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_one(rows: DataFrame, key: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key in the order given; descending orders keep the last."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def identity(key: Column, *fallback: Column) -> Column:
    """The key, else the fallbacks; rows with none are told apart by a running id."""
    return F.coalesce(key.cast("string"), *(f.cast("string") for f in fallback), F.concat(F.lit("row-"), F.monotonically_increasing_id().cast("string")))


def union_all(*sources: DataFrame) -> DataFrame:
    """Rows of all sources under one schema; missing columns are null."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def set_counts(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys in both, only in the first, only in the second, in one full join."""
    x = a.select(key).distinct().withColumn("__a", F.lit(True))
    y = b.select(key).distinct().withColumn("__b", F.lit(True))
    j = x.join(y, key, "full")
    return j.agg(F.count_if(F.col("__a") & F.col("__b")).alias("common"), F.count_if(F.col("__b").isNull()).alias("a_only"), F.count_if(F.col("__a").isNull()).alias("b_only"))


def completeness(expected: DataFrame, merged: DataFrame, group: str, key: str) -> DataFrame:
    """expected and merged counts by group, missing keys, and whether the group is complete."""
    want = expected.select(group, key).distinct()
    have = merged.select(group, key).distinct().withColumn("__in", F.lit(1))
    j = want.join(have, [group, key], "left")
    return j.groupBy(group).agg(F.count("*").alias("expected"), F.count("__in").alias("merged"), F.count_if(F.col("__in").isNull()).alias("missing")).withColumn("complete", F.col("missing") == 0)


def changes(old: DataFrame, new: DataFrame, key: str, values: list[str]) -> DataFrame:
    """added, removed, changed or same for each key, and the next version of each row."""
    a = old.select(key, "version", F.struct(*values).alias("__old"))
    b = new.select(key, F.struct(*values).alias("__new"))
    j = a.join(b, key, "full")
    kind = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(F.col("__old").eqNullSafe(F.col("__new")), "same").otherwise("changed")
    return j.select(key, kind.alias("change"), (F.coalesce("version", F.lit(0)) + kind.isin("added", "changed").cast("int")).alias("version"))


def replicate(rows: DataFrame, n: int) -> DataFrame:
    """Each row ``n`` times, numbered from 1."""
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(n))))


def upsert(table: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """The table with incoming rows in place of, or beside, its own."""
    return table.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming)


def delete(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return table.join(ids.select(key).distinct(), key, "left_anti")


def merge_lists(rows: DataFrame, key: str, order: str, values: str) -> DataFrame:
    """The arrays of each key joined in order."""
    return rows.groupBy(key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, values))), lambda x: x[values])).alias(values))


def merge_registry(rows: DataFrame, name: str, seen: str, traits: str) -> DataFrame:
    """Objects of one name, whatever its case: first seen, and all traits once, sorted."""
    return rows.groupBy(F.lower(name).alias(name)).agg(F.min(seen).alias(seen), F.array_sort(F.array_distinct(F.flatten(F.collect_list(traits)))).alias(traits))


def merge_new(table: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """The table and those incoming rows whose key it doesn't have yet."""
    return table.unionByName(incoming.join(table.select(key).distinct(), key, "left_anti"))
