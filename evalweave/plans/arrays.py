"""Queries over nested values, conversations and JSON in texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.functions import arrays, text
from evalweave.operators import filters
from evalweave.plans.registry import query, table


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("turns"))


@query("SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k FROM events")
def p01_projection_with_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k").cast("bigint"), F.lit(-1).cast("bigint")).alias("k"))


@query("SELECT c_custkey, c_name FROM customer")
def p02_key_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name")


@query('SELECT o_orderkey AS "o.key", o_orderstatus AS "o.state.status", o_totalprice AS "o.state.price" FROM orders')
def p04_flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = F.struct(F.col("o_orderkey").alias("key"), F.struct(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price")).alias("state")).alias("o")
    return filters.flattened(table(spark, sf_dir, "orders").select(nested))


@query("SELECT conv_id, count(*) AS turns FROM conversations GROUP BY 1")
def n01_exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("conv_id", F.explode("turns")).groupBy("conv_id").agg(F.count("*").alias("turns"))


@query("""
SELECT a.conv_id, a.text AS question, b.text AS answer FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p FROM conversations) a JOIN (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p FROM conversations) b
 ON a.conv_id = b.conv_id AND a.p % 2 = 0 AND b.p = a.p + 1 WHERE a.role = 'user' AND b.role = 'assistant'
""")
def n02_turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("conv_id", F.explode(arrays.turn_pairs(F.col("turns"))).alias("p")).select("conv_id", "p.question", "p.answer")


@query("SELECT conv_id, (list(text ORDER BY turn) FILTER (role = 'assistant'))[1] AS first FROM conversations GROUP BY 1")
def n03_first_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("conv_id", arrays.first_turn(F.col("turns"), "assistant").alias("first"))


@query("SELECT item_id, 'human' AS a, 'Q: ' || left(text, 30) AS q, 'gpt' AS b, right(text, 30) AS r FROM benchmark")
def n04_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = arrays.chat(F.substring("text", 1, 30), F.right("text", F.lit(30)), "Q: ")
    return table(spark, sf_dir, "benchmark").select("item_id", c[0]["from"].alias("a"), c[0]["value"].alias("q"), c[1]["from"].alias("b"), c[1]["value"].alias("r"))


@query("SELECT conv_id, array_to_string(list_filter([CASE WHEN count(*) > 4 THEN 'long' END, 'turns ' || count(*)::VARCHAR, CASE WHEN bool_or(role = 'system') THEN 'system' END], lambda x: x IS NOT NULL), '; ') AS told FROM conversations GROUP BY 1")
def n05_conditional_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size("turns")
    parts = F.array(F.when(n > 4, "long"), F.concat(F.lit("turns "), n.cast("string")), F.when(F.exists("turns", lambda t: t["role"] == "system"), "system"))
    return _turns(spark, sf_dir).select("conv_id", F.array_join(F.array_compact(parts), "; ").alias("told"))


@query("SELECT event_id, CASE WHEN value > 50 AND event_id % 2 = 0 THEN 50.0::DOUBLE END AS s, (value > 50 AND event_id % 2 = 0)::INT AS n FROM events")
def n06_n07_p08_valid_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = F.struct(F.when(F.col("event_id") % 2 == 0, 50.0).alias("start"), F.col("value").alias("end"))
    good = arrays.valid_segments(F.array(seg))
    return table(spark, sf_dir, "events").select("event_id", F.get(good, F.lit(0))["start"].alias("s"), F.size(good).alias("n"))


@query("SELECT event_id, CASE event_id % 5 WHEN 4 THEN NULL ELSE (props::JSON ->> '$.k')::BIGINT END AS k FROM events")
def n08_json_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.expr("CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN '```json\\n' || props || '\\n```' WHEN 2 THEN 'The answer is ' || props || ' as asked' WHEN 3 THEN '  ' || props ELSE '{broken: ' END")
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(arrays.json_object(told), "$.k").cast("bigint").alias("k"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN [1, 3] WHEN 1 THEN [2] WHEN 2 THEN [] ELSE [1, 2, 3] END AS ids FROM events")
def n09_selected_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.expr("""CASE event_id % 4 WHEN 0 THEN '{"frame_ids": [3, 1, 1, 9]}' WHEN 1 THEN '["2", "x", 7]' WHEN 2 THEN '{"frame_ids": []}' ELSE 'nothing' END""")
    return table(spark, sf_dir, "events").select("event_id", arrays.selected_ids(told, F.array(F.lit(1), F.lit(2), F.lit(3))).alias("ids"))


@query("SELECT event_id, ['YES', 'NO', 'YES', 'ERROR', 'NO', 'YES'][1 + event_id % 6] AS verdict FROM events")
def n10_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.expr("""element_at(array('{"verdict": true}', '{"verdict": "false"}', '{"verdict": 1}', '{"reason": "none"}', 'so "verdict": false,', '"Verdict" : TRUE'), cast(1 + event_id % 6 AS int))""")
    return table(spark, sf_dir, "events").select("event_id", arrays.verdict(told).alias("verdict"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN (event_id % 60)::DOUBLE END AS s, CASE WHEN event_id % 2 = 0 THEN (event_id % 60 + 5)::DOUBLE END AS e FROM events")
def n11_intervals_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.expr("CASE WHEN event_id % 2 = 0 THEN 'from ' || (event_id % 60) || ' to ' || (event_id % 60 + 5) || ' s' ELSE 'never' END")
    x = F.get(arrays.paired_intervals(told), F.lit(0))
    return table(spark, sf_dir, "events").select("event_id", x["start"].alias("s"), x["end"].alias("e"))


@query("SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k FROM events")
def n12_two_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.concat(F.lit('{"result": '), F.col("props"), F.lit("}")))
    v = F.try_parse_json(told)
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.try_variant_get(v, "$.k", "bigint"), F.try_variant_get(v, "$.result.k", "bigint")).alias("k"))


@query("SELECT doc_id, list_transform(list_sort(list_transform(range(4), lambda i: {h: md5('5|' || doc_id::VARCHAR || '|' || i::VARCHAR), i: i::INT})), lambda x: x.i) AS shown, 2 AS back FROM documents")
def n13_permuted_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = arrays.permutation(F.lit(4), F.lit(5), F.col("doc_id"))
    back = arrays.original_index(F.array_position(order, 2).cast("int") - 1, order)
    return table(spark, sf_dir, "documents").select("doc_id", order.alias("shown"), back.alias("back"))


@query("""SELECT n_nationkey, '[{"name":"' || n_name || '","key":' || n_regionkey::VARCHAR || '}]' AS packed FROM nation""")
def n14_objects_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", F.to_json(F.array(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("key")))).alias("packed"))


@query("SELECT p_partkey, CASE WHEN contains(lower(p_type), 'steel') THEN 'metal' WHEN contains(lower(p_type), 'brass') THEN 'metal' WHEN contains(lower(p_name), '1') THEN 'one' ELSE 'other' END AS kind FROM part")
def n15_keyword_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_type = arrays.by_keyword(F.col("p_type"), {"steel": "metal", "brass": "metal"}, "")
    return table(spark, sf_dir, "part").select("p_partkey", F.when(by_type != "", by_type).otherwise(arrays.by_keyword(F.col("p_name"), {"1": "one"})).alias("kind"))


@query("SELECT item_id, left(text, 10) AS question, ['one', 'two', 'three', ''] AS choices FROM benchmark")
def s10_f11_choices_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, listed = text.options(F.concat(F.substring("text", 1, 10), F.lit(" (A) one (B) two (C) three")))
    return table(spark, sf_dir, "benchmark").select("item_id", F.when(F.length(F.rtrim(F.substring("text", 1, 10))) < 10, F.substring("text", 1, 10)).otherwise(asked).alias("question"), listed.alias("choices"))
