"""Queries over paired tests, losses and closed-form scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.functions import stats, vectors
from evalweave.operators import metrics
from evalweave.plans.evaluation import JUDGED, judged
from evalweave.plans.registry import query, table


@query(f"""
WITH c AS (SELECT lang, count(*) FILTER (verdict AND NOT toxic) AS b, count(*) FILTER (NOT verdict AND toxic) AS c, count(*) AS n, count(*) FILTER (verdict) AS k FROM {JUDGED} WHERE verdict IS NOT NULL GROUP BY lang)
SELECT lang, round(coalesce(pow(greatest(abs(b - c) - 1, 0), 2) / nullif(b + c, 0), 0), 6) AS chi2, round(coalesce((b - c) / sqrt(nullif(b + c, 0)), 0), 6) AS z,
 round(greatest(0, (k / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n)), 6) AS low,
 round(least(1, (k / n + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n)), 6) AS high FROM c
""")
def a23_m08_mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(spark, sf_dir).where("verdict IS NOT NULL")
    c = rows.groupBy("lang").agg(F.count_if(F.col("verdict") & ~F.col("toxic")).alias("b"), F.count_if(~F.col("verdict") & F.col("toxic")).alias("c"), F.count("*").alias("n"), F.count_if("verdict").alias("k"))
    w = stats.wilson(F.col("k"), F.col("n"))
    return c.select("lang", F.round(stats.chi_square(F.col("b"), F.col("c")), 6).alias("chi2"), F.round(stats.z_value(F.col("b"), F.col("c")), 6).alias("z"), F.round(w["low"], 6).alias("low"), F.round(w["high"], 6).alias("high"))


@query("""
SELECT p_partkey, round(1e-12 + CASE WHEN n = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(k, n - k) + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + n * ln(0.5))))) END, 9) AS p
FROM (SELECT p_partkey, p_size::DOUBLE AS n, (p_partkey % (p_size + 1))::BIGINT AS k FROM part)
""".replace("range(0, least(k, n - k) + 1)", "range(0, least(k, n::BIGINT - k) + 1)"))
def m09_exact_binomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(stats.exact_binomial(F.col("p_partkey") % (n + 1), n) + 1e-12, 9).alias("p"))


@query("""
SELECT l_orderkey, l_linenumber, round(greatest(-0.1 * x, 0) + ln(1 + exp(-abs(0.1 * x))), 6) AS sigmoid, round(greatest(0, 1 - 0.1 * x), 6) AS hinge, round(pow(x - 5, 2), 6) AS ipo
FROM (SELECT l_orderkey, l_linenumber, (l_quantity - l_linenumber) - (l_quantity / 2 - 7) AS x FROM lineitem)
""")
def m05_preference_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    args = (F.col("l_quantity"), F.col("l_linenumber").cast("double"), F.col("l_quantity") / 2, F.lit(7.0))
    return rows.select("l_orderkey", "l_linenumber", *(F.round(stats.preference_loss(*args, kind=k), 6).alias(k) for k in ("sigmoid", "hinge", "ipo")))


@query("""
SELECT user_id, round(least(100, greatest(0, ln(sum(exp((v - m) / 10))) + m / 10 - p / 10)), 6) AS loss FROM (SELECT user_id, value AS v, max(value) OVER (PARTITION BY user_id) AS m, first_value(value) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) GROUP BY user_id, m, p
""")
def m04_info_nce(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by("value", "event_id").alias("p"), F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("v"))
    negatives = F.slice(F.transform("v", lambda x: x["value"]), F.lit(2), F.greatest(F.size("v") - 1, F.lit(0)))
    return rows.select("user_id", F.round(stats.info_nce(F.col("p"), negatives, 10.0), 6).alias("loss"))


@query("SELECT l_orderkey, l_linenumber, l_quantity - l_tax AS margin, round(l_quantity / greatest(1, l_linenumber) - l_tax / greatest(1, l_linenumber - 3), 9) AS per_token FROM lineitem")
def m06_reference_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    margin, per = stats.reference_margin(F.col("l_quantity"), F.col("l_tax"), F.col("l_linenumber"), F.col("l_linenumber") - 3)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", margin.alias("margin"), F.round(per, 9).alias("per_token"))


@query("SELECT event_id, round(-pow(1 - p, 2) * ln(p), 9) AS focal FROM (SELECT event_id, (1 + event_id % 99) / 100.0::DOUBLE AS p FROM events)")
def m07_focal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.round(stats.focal((1 + F.col("event_id") % 99) / 100), 9).alias("focal"))


@query("SELECT doc_id, 8 * 258 + length(text) // 4 AS tokens, 8 * 258 + length(text) // 4 <= 4096 AS fits FROM documents")
def m10_token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, fits = stats.token_budget(F.lit(8), 258, F.col("text"), most=4096)
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("tokens"), fits.alias("fits"))


@query("""
SELECT a.vec_id, round(list_sum(list_transform(range(1, 65), lambda i: abs(a.v[i] - b.v[i]))) / 64, 6) AS mad, len(list_filter(range(1, 64), lambda i: (a.v[i + 1] > a.v[i]) <> (b.v[i + 1] > b.v[i]))) AS dhash
FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) a JOIN (SELECT vec_id + 1 AS vec_id, embedding::DOUBLE[] AS v FROM embeddings) b USING (vec_id)
""")
def m11_change_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    rows = e.join(e.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    return rows.select("vec_id", F.round(vectors.mean_abs_difference(F.col("embedding"), F.col("b")), 6).alias("mad"), vectors.hamming(F.col("embedding"), F.col("b")).alias("dhash"))


@query()
def m11_flow_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    rows = e.join(e.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    return rows.select("vec_id", F.round(vectors.flow(F.col("embedding"), F.col("b")), 6).alias("flow"))


@query(f"SELECT lang, count(*) FILTER (verdict) AS correct, count(verdict) AS judged, count(*) - count(verdict) AS pending, count(*) FILTER (verdict) * 100.0::DOUBLE / nullif(count(verdict), 0) AS acc FROM {JUDGED} WHERE lang IS NOT NULL GROUP BY lang")
def a01_a03_judged_without_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.judged_accuracy(judged(spark, sf_dir).where("lang IS NOT NULL"), ["lang"])


@query("SELECT lang, coalesce(count(*) FILTER (verdict) / nullif(count(verdict) * 0, 0), 0)::DOUBLE AS zero, s[1 + len(s) // 2] AS upper FROM (SELECT lang, verdict, list_sort(list(n_chars) OVER (PARTITION BY lang)) AS s FROM " + JUDGED + ") GROUP BY lang, s")
def t8_t11_zero_and_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalweave.functions.semantics import divide_or

    rows = judged(spark, sf_dir).groupBy("lang").agg(F.count_if("verdict").alias("k"), F.count("verdict").alias("n"), F.count("*").alias("m"))
    mid = judged(spark, sf_dir).groupBy("lang", "n_chars").agg(F.count("*").alias("c"))
    from pyspark.sql import Window

    w = Window.partitionBy("lang")
    upper = mid.withColumns({"upto": F.sum("c").over(w.orderBy("n_chars")), "all": F.sum("c").over(w)}).where("upto > floor(all / 2)").groupBy("lang").agg(F.min("n_chars").alias("upper"))
    return rows.join(upper, "lang").select("lang", divide_or(F.col("k"), F.col("n") * 0, 0.0).alias("zero"), "upper")
