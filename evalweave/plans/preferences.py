"""Queries that build preference pairs: benchmark texts are chosen answers, documents rejected ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.operators import metrics, pairs, ranking
from evalweave.plans.evaluation import JUDGED, judged
from evalweave.plans.joining import DONORS
from evalweave.plans.registry import query, table
from evalweave.plans.texts import DECLINES, KEYS, LCS, PLAIN


@query("""
SELECT item_id, array_to_string((list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))[1 : 4 + ascii(substr(md5('0:' || item_id::VARCHAR), 1, 1)) % 9], ' ') AS rejected FROM benchmark
""")
def x07_truncated_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", pairs.truncated(F.col("text"), "item_id").alias("rejected"))


@query("""
SELECT doc_id, (list_filter(list_transform(list_sort(list_transform(range(4), lambda i: {h: md5('wrong|' || doc_id::VARCHAR || '|' || i::VARCHAR), i: i})), lambda x: ['a', 'b', 'c', 'd'][x.i + 1]), lambda x: x <> ['a', 'b', 'c', 'd'][1 + doc_id % 4]))[1] AS rejected FROM documents
""")
def x07_wrong_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    choices = F.array(*map(F.lit, "abcd"))
    right = F.element_at(choices, (1 + F.col("doc_id") % 4).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", pairs.wrong_choice(choices, right, "doc_id").alias("rejected"))


@query("SELECT doc_id, min(source) AS rejected FROM documents JOIN labels USING (doc_id) WHERE quality = 0 GROUP BY 1")
def x07_own_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    said = docs.join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", F.col("source").alias("prediction"), (F.col("quality") == 1).alias("correct"))
    return pairs.with_predictions(docs.select("doc_id"), said, "doc_id").select("doc_id", "rejected")


@query(f"SELECT doc_id, donor_source AS rejected FROM {DONORS}")
def x07_donated_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.col("source").alias("answer"))
    return pairs.with_donors(rows, "doc_id", "source", "answer").select("doc_id", "rejected")


_DROPPED = "(SELECT b.item_id, b.text AS chosen, CASE b.item_id % 4 WHEN 0 THEN b.text WHEN 1 THEN 'I cannot see the video' WHEN 2 THEN 'too short' ELSE a.text END AS t FROM benchmark b JOIN benchmark a ON a.item_id + 1 = b.item_id)"


@query(f"""
WITH RECURSIVE {LCS.format(a='t', b='chosen', rows=_DROPPED)},
k AS (SELECT p.*, rouge, {KEYS.format(t='chosen')} AS keys, {KEYS.format(t='t')} AS others FROM {_DROPPED} p JOIN l USING (item_id))
SELECT drop_reason, count(*) AS n FROM (SELECT CASE WHEN lower(trim(chosen)) = lower(trim(t)) THEN 'same' WHEN t = '' OR regexp_matches({PLAIN}, {DECLINES}) THEN 'abstains' WHEN len(regexp_extract_all(t, '[A-Za-z0-9]+')) < 5 THEN 'short' WHEN rouge > 0.7 THEN 'alike'
 WHEN len(keys) >= 3 AND len(list_intersect(keys, others)) >= 0.85 * len(keys) THEN 'keys' END AS drop_reason FROM k) GROUP BY 1
""")
def p12_screened_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("chosen"))
    other = b.select((F.col("item_id") + 1).alias("item_id"), F.col("chosen").alias("rejected"))
    told = F.expr("CASE item_id % 4 WHEN 0 THEN chosen WHEN 1 THEN 'I cannot see the video' WHEN 2 THEN 'too short' ELSE rejected END")
    return pairs.screened(b.join(other, "item_id").withColumn("rejected", told)).groupBy("drop_reason").agg(F.count("*").alias("n"))


@query(f"""
WITH p AS (SELECT doc_id, lang, CASE WHEN doc_id % 5 <> 0 THEN n_chars / 1000.0::DOUBLE END AS margin, md5('0:' || doc_id::VARCHAR) AS h FROM documents),
k AS (SELECT * FROM p WHERE coalesce(margin, -1e9) <= 6 QUALIFY row_number() OVER (PARTITION BY lang ORDER BY h) <= 40),
s AS (SELECT doc_id, lang, CASE WHEN row_number() OVER (ORDER BY h) <= greatest(1, floor(count(*) OVER () * 0.1)) THEN 'val' ELSE 'train' END AS split FROM k),
a AS (SELECT lang, avg(verdict::INT) AS share FROM {JUDGED} GROUP BY lang)
SELECT doc_id, split, 1 - coalesce(share, 0.5) AS difficulty, row_number() OVER (ORDER BY 1 - coalesce(share, 0.5), doc_id) - 1 AS place FROM s LEFT JOIN a USING (lang)
""")
def pairs_assembled_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 5 != 0, F.col("n_chars") / 1000).alias("margin"))
    made = pairs.assembled(docs, "doc_id", "lang", "margin", 6.0, 40, 0.1)
    shares = judged(spark, sf_dir).groupBy("lang").agg(F.avg(F.col("verdict").cast("double")).alias("share"))
    return pairs.curriculum(made, shares, ["lang"], "doc_id").select("doc_id", "split", "difficulty", "place")


@query(f"""
SELECT source, lang, acc, row_number() OVER (PARTITION BY lang ORDER BY acc DESC NULLS LAST, source) AS rank
FROM (SELECT source, lang, count(*) FILTER (verdict) * 100.0::DOUBLE / nullif(count(verdict), 0) AS acc FROM {JUDGED} GROUP BY ALL) QUALIFY rank <= 3
""")
def t6_t7_leaders_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    cells = metrics.judged_accuracy(judged(spark, sf_dir), ["source", "lang"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("acc").desc_nulls_last(), "source")).cast("long")
    return cells.withColumn("rank", place).where("rank <= 3").select("source", "lang", "acc", "rank")


@query("SELECT doc_id, md5('0:' || doc_id::VARCHAR) AS h FROM documents")
def t17_hash_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", ranking.hash_order("doc_id").alias("h"))
