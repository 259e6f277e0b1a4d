"""Queries over keyed merging, deduplication and versioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalweave.functions.semantics import first_nonempty
from evalweave.operators import dedup
from evalweave.plans.registry import query, table
from evalweave.sources import writers


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) = 1")
def w02_t3_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.keep_one(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), [F.col("l_orderkey")], [F.col("l_linenumber"), F.col("l_partkey")])


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC) = 1")
def w02_t4_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.keep_one(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), [F.col("l_orderkey")], [F.col("l_linenumber").desc(), F.col("l_partkey").desc()])


@query("SELECT doc_id, source, trim(left(text, 20)) AS head FROM documents QUALIFY row_number() OVER (PARTITION BY source, trim(left(text, 20)) ORDER BY doc_id) = 1")
def t5_u02_normalised_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.trim(F.substring("text", 1, 20)).alias("head"))
    return dedup.keep_one(rows, [F.col("source"), F.col("head")], [F.col("doc_id")])


@query("SELECT doc_id AS id, lang, NULL::VARCHAR AS role FROM documents UNION ALL SELECT conv_id, NULL, role FROM conversations")
def u01_union_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")
    return dedup.union_all(docs, table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), "role"))


@query("""
SELECT l_returnflag, count(*) AS expected, count(b.k) AS merged, count(*) FILTER (b.k IS NULL) AS missing, count(*) FILTER (b.k IS NULL) = 0 AS complete
FROM (SELECT DISTINCT l_returnflag, l_orderkey AS k FROM lineitem) a LEFT JOIN (SELECT DISTINCT l_returnflag, l_orderkey AS k FROM lineitem WHERE l_linenumber <= 2) b USING (l_returnflag, k) GROUP BY 1
""")
def u04_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return dedup.completeness(rows, rows.where("l_linenumber <= 2"), "l_returnflag", "l_orderkey")


@query("SELECT region.*, copy FROM region, (SELECT unnest([1, 2, 3])::INT AS copy)")
def u06_replicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.replicate(table(spark, sf_dir, "region"), 3)


@query("""
SELECT coalesce(a.k, b.k) AS p_partkey, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.p_size = b.p_size THEN 'same' ELSE 'changed' END AS change,
 (CASE WHEN a.k IS NULL THEN 1 WHEN b.k IS NULL THEN 1 WHEN a.p_size = b.p_size THEN 1 ELSE 2 END)::INT AS version
FROM (SELECT p_partkey AS k, p_size FROM part WHERE p_partkey % 5 <> 0) a FULL JOIN (SELECT p_partkey AS k, CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 5 <> 1) b ON a.k = b.k
""")
def u08_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    old = part.where("p_partkey % 5 <> 0").select("p_partkey", "p_size", F.lit(1).alias("version"))
    new = part.where("p_partkey % 5 <> 1").selectExpr("p_partkey", "CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size END AS p_size")
    return dedup.changes(old, new, "p_partkey", ["p_size"])


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 0 ELSE s_acctbal END AS s_acctbal FROM supplier WHERE s_suppkey % 10 <> 3")
def k10_k11_upsert_and_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    fresh = rows.where("s_suppkey % 2 = 0").withColumn("s_acctbal", F.lit(0.0))
    return dedup.delete(dedup.upsert(rows, fresh, "s_suppkey"), rows.where("s_suppkey % 10 = 3"), "s_suppkey")


@query("SELECT n_regionkey, list_sort(list(n_name)) AS names FROM nation GROUP BY 1")
def k02_keyed_regroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = writers.keyed(table(spark, sf_dir, "nation"), "n_regionkey", ["n_name"], ["n_name"])
    return rows.select("n_regionkey", F.col("items.n_name").alias("names"))


@query("SELECT doc_id, 'unlabelled' AS reason FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def k09_drop_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return writers.drop_manifest(docs, docs.join(table(spark, sf_dir, "labels"), "doc_id", "left_semi"), "doc_id", "unlabelled")


@query("SELECT user_id, flatten(list([event_type, 'x'] ORDER BY event_id)) AS tags FROM events GROUP BY 1")
def a36_merge_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.array("event_type", F.lit("x")).alias("tags"))
    return dedup.merge_lists(rows, "user_id", "event_id", "tags")


@query("SELECT lower(event_type) AS event_type, min(event_id) AS event_id, list_sort(list_distinct(list(user_id % 5))) AS traits FROM events GROUP BY 1")
def a35_merge_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type")).alias("event_type"), "event_id", F.array(F.col("user_id") % 5).alias("traits"))
    return dedup.merge_registry(rows, "event_type", "event_id", "traits")


@query("SELECT conv_id, string_agg(role, ' | ' ORDER BY f) AS roles FROM (SELECT conv_id, role, min(turn) AS f FROM conversations GROUP BY ALL) GROUP BY 1")
def w03_ordered_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda t: t["role"])
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.array_distinct(turns), " | ").alias("roles"))


@query("SELECT user_id, max_by(event_id, (value, event_id)) AS event_id, max(value) AS value FROM events GROUP BY 1".replace("max_by(event_id, (value, event_id))", "(list(event_id ORDER BY value DESC, event_id DESC))[1]"))
def w04_argmax_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("value", "event_id")).alias("event_id"), F.max("value").alias("value"))


@query("SELECT user_id, s[1] - s[2] AS margin FROM (SELECT user_id, list_reverse_sort(list(value)) AS s FROM events GROUP BY 1)")
def w05_top_two_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = table(spark, sf_dir, "events").withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("value").desc(), "event_id"))).where("n <= 2")
    return top.groupBy("user_id").agg((F.max(F.when(F.col("n") == 1, F.col("value"))) - F.max(F.when(F.col("n") == 2, F.col("value")))).alias("margin"))


@query("SELECT user_id, event_type, (list(event_id ORDER BY ts DESC, event_id DESC))[1] AS last FROM events GROUP BY ALL")
def w16_last_of_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("last"))


@query("SELECT doc_id, source || '_' || lang || '_' || lpad(row_number() OVER (PARTITION BY source, lang ORDER BY doc_id)::VARCHAR, 5, '0') AS id FROM documents")
def w17_running_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("source", "lang").orderBy("doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("_", "source", "lang", F.lpad(n.cast("string"), 5, "0")).alias("id"))


@query("SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END, ''), source) AS name FROM documents")
def t1_p03_first_nonempty(spark: SparkSession, sf_dir: str) -> DataFrame:
    lang = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", first_nonempty(lang, F.col("source")).alias("name"))


@query("SELECT user_id, list_transform(list_sort(list_distinct(list(event_id % 40))), lambda x: 'frame_' || x::VARCHAR) AS frames FROM events GROUP BY 1")
def w21_sorted_by_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalweave.functions.arrays import sorted_by_suffix

    rows = table(spark, sf_dir, "events").select("user_id", F.concat(F.lit("frame_"), (F.col("event_id") % 40).cast("string")).alias("frame"))
    return rows.groupBy("user_id").agg(sorted_by_suffix(F.collect_list("frame")).alias("frames"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'kept' ELSE 'new' END AS origin FROM supplier")
def u07_skip_if_there(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select("s_suppkey")
    there = rows.where("s_suppkey % 3 = 0").withColumn("origin", F.lit("kept"))
    return dedup.merge_new(there, rows.withColumn("origin", F.lit("new")), "s_suppkey")


@query("SELECT '| r_regionkey | r_name |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || r_regionkey::VARCHAR || ' | ' || r_name || ' |', chr(10) ORDER BY r_regionkey) AS report FROM region")
def k06_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = writers.markdown(table(spark, sf_dir, "region").select("r_regionkey", "r_name").orderBy("r_regionkey"))
    return spark.createDataFrame([(told,)], "report string")
