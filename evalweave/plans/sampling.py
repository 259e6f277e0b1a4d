"""Queries over repeatable sampling, splitting and ordering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalweave.functions.semantics import spread
from evalweave.operators import ranking
from evalweave.plans.registry import query, table
from evalweave.sources import readers

_H = "md5('0:' || doc_id::VARCHAR)"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")


@query(f"SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY {_H}) <= 25")
def w06_group_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.capped(_docs(spark, sf_dir), ["lang"], [ranking.hash_order("doc_id")], 25).select("doc_id", "lang")


@query(f"SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY {_H}) <= round_even(count(*) OVER (PARTITION BY lang) * 0.3::DOUBLE, 0) AS picked FROM documents")
def w07_exact_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.exact_fraction(_docs(spark, sf_dir), "lang", [ranking.hash_order("doc_id")], 0.3).select("doc_id", "picked")


@query("SELECT doc_id, 1 - coalesce(a, 0.5) AS difficulty, row_number() OVER (ORDER BY 1 - coalesce(a, 0.5), doc_id) AS place FROM documents LEFT JOIN (SELECT source, avg(quality) AS a FROM documents JOIN labels USING (doc_id) GROUP BY 1) USING (source)")
def w08_m12_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    share = docs.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("source").agg(F.avg("quality").alias("a"))
    rows = docs.join(share, "source", "left").select("doc_id", (1 - F.coalesce("a", F.lit(0.5))).alias("difficulty"))
    return ranking.numbered(rows, ["difficulty", "doc_id"], "place").withColumn("place", F.col("place") + 1)


@query("SELECT event_id, least(3, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // greatest(1, count(*) OVER (PARTITION BY user_id) // 4))::INT AS part FROM events")
def w22_equal_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id")
    rows = table(spark, sf_dir, "events").withColumns({"at": F.row_number().over(w.orderBy("event_id")) - 1, "n": F.count("*").over(w)})
    return rows.select("event_id", ranking.equal_parts(F.col("at"), F.col("n"), 4).alias("part"))


@query(f"SELECT doc_id, CASE WHEN n <= 20 THEN 'test' WHEN n <= 70 THEN 'train' ELSE 'val' END AS split FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY {_H}) AS n FROM documents)")
def x01_split_by_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.split_counts(_docs(spark, sf_dir), "lang", [ranking.hash_order("doc_id")], 20, 50).select("doc_id", "split")


@query(f"SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {_H}) <= greatest(1, floor(count(*) OVER () * 0.05)) THEN 'val' ELSE 'train' END AS split FROM documents")
def x02_split_by_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.split_fraction(_docs(spark, sf_dir), "doc_id", 0.05).select("doc_id", "split")


@query(f"""
WITH p AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_H}) - 1 AS n, count(*) OVER (PARTITION BY lang) // 10 AS f, dense_rank() OVER (ORDER BY lang) - 1 AS s FROM documents)
SELECT doc_id, (n // 10) * (SELECT count(DISTINCT lang) FROM documents) + s AS block, n % 10 AS slot FROM p WHERE n // 10 < f
""")
def x03_block_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.block_interleaved(_docs(spark, sf_dir), "lang", [ranking.hash_order("doc_id")], 10).select("doc_id", "block", "slot")


@query("SELECT doc_id FROM documents ORDER BY md5('7:' || doc_id::VARCHAR) LIMIT 50")
def x04_random_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).orderBy(ranking.hash_order("doc_id", 7)).limit(50).select("doc_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 10")
def x05_first_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left_semi")
    return ranking.capped(rows, ["lang"], [F.col("doc_id")], 10).select("doc_id", "lang")


@query("SELECT conv_id, turn, CASE WHEN substr(md5('0:' || conv_id::VARCHAR), 1, 1) < '2' THEN 'val' ELSE 'train' END AS split FROM conversations")
def x06_split_before_unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = table(spark, sf_dir, "conversations").select("conv_id").distinct().withColumn("split", F.when(F.substring(ranking.hash_order("conv_id"), 1, 1) < "2", "val").otherwise("train"))
    return table(spark, sf_dir, "conversations").join(groups, "conv_id").select("conv_id", "turn", "split")


@query("SELECT p_partkey, p_brand, row_number() OVER (ORDER BY p_brand, p_partkey) AS place FROM (SELECT * FROM part WHERE p_size >= 10 QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) <= 5)")
def x08_playlist_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranking.capped(table(spark, sf_dir, "part").where("p_size >= 10"), ["p_brand"], [F.col("p_partkey")], 5)
    return ranking.numbered(rows.select("p_partkey", "p_brand"), ["p_brand", "p_partkey"], "place").withColumn("place", F.col("place") + 1)


@query("SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= CASE event_type WHEN 'click' THEN 5 WHEN 'view' THEN 3 ELSE 1 END")
def s12_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.by_quota(table(spark, sf_dir, "events").select("event_type", "event_id"), "event_type", [F.col("event_id")], {"click": 5, "view": 3}, 1)


@query("""
SELECT doc_id, p % 7 = 2 AS strided, p // greatest(1, ceil(n / 7.0)::BIGINT) = 2 AS contiguous, p >= 2 * (n // 7) + least(2, n % 7) AND p < 2 * (n // 7) + least(2, n % 7) + n // 7 + (2 < n % 7)::INT AS balanced
FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p, count(*) OVER () AS n FROM documents)
""")
def s14_st6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    rows = ranking.numbered(docs, ["doc_id"], "p").crossJoin(F.broadcast(docs.agg(F.count("*").alias("n"))))
    return rows.select("doc_id", *(readers.shard(F.col("p"), F.col("n"), 2, 7, k).alias(k) for k in ("strided", "contiguous", "balanced")))


@query("SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 20 OFFSET 40")
def s15_w20_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_name").orderBy("p_name", "p_partkey").offset(40).limit(20)


@query("SELECT p_partkey, list_distinct(list_transform(range(8), lambda i: round_even(i * (p_size - 1) / 7.0::DOUBLE, 0)::INT)) AS x FROM part".replace("list_distinct(", "list_sort(list_distinct(").replace("::INT)) AS", "::INT))) AS"))
def f09_linspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", spread(F.col("p_size"), 8).alias("x"))


@query("SELECT p_partkey, list_sort(list_distinct(list_transform(range(8), lambda i: floor(i * (p_size - 1) / 7.0::DOUBLE)::INT + 1))) AS x FROM part")
def t19_t20_linspace_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", spread(F.col("p_size"), 8, "down", 1).alias("x"))


@query("SELECT user_id, bool_or(value > 100) AS succeeded, CASE WHEN bool_or(value > 100) THEN min(event_id) FILTER (value > 100) ELSE max(event_id) END AS event_id FROM events GROUP BY 1")
def st3_retry_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("ok", F.col("value") > 100)
    return ranking.first_success(rows, "user_id", "event_id", "ok", "value").select("user_id", "succeeded", "event_id")
