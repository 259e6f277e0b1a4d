"""Queries over judged answers: documents are answers, source is the run, labels.quality the verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.functions.semantics import divide_or, half_even
from evalweave.operators import filters, metrics
from evalweave.plans.registry import query, table


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with a nullable verdict."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    verdicts = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("verdict"), (F.col("toxic") == 1).alias("toxic"))
    return docs.join(verdicts, "doc_id", "left")


JUDGED = "(SELECT d.doc_id, source, lang, n_chars, quality = 1 AS verdict, toxic = 1 AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)) j"


@query(f"""
SELECT *, row_number() OVER (ORDER BY acc DESC NULLS LAST, source) AS rank FROM (
  SELECT source, count(*) FILTER (verdict) AS correct, count(verdict) AS judged, count(*) - count(verdict) AS pending,
         count(*) FILTER (verdict) * 100.0::DOUBLE / nullif(count(verdict), 0) AS acc
  FROM {JUDGED} GROUP BY source)
""")
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.leaderboard(judged(spark, sf_dir), "source")


@query(f"""
SELECT lang, count(*) FILTER (verdict) AS correct, count(verdict) AS judged, count(*) - count(verdict) AS pending,
       count(*) FILTER (verdict) * 100.0::DOUBLE / nullif(count(verdict), 0) AS acc FROM {JUDGED} GROUP BY lang
""")
def a02_grouped_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.judged_accuracy(judged(spark, sf_dir), ["lang"])


@query(f"""
SELECT source, lang, coalesce(f, c, 0.5) AS share FROM
 (SELECT source, lang, avg(verdict::INT) AS f FROM {JUDGED} GROUP BY ALL) JOIN (SELECT lang, avg(verdict::INT) AS c FROM {JUDGED} GROUP BY ALL) USING (lang)
""")
def a04_accuracy_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.with_fallback(judged(spark, sf_dir), ["lang", "source"], ["lang"])


@query(f"""
SELECT label, count(*) FILTER (verdict) AS correct, count(verdict) AS judged, count(*) - count(verdict) AS pending,
       count(*) FILTER (verdict) * 100.0::DOUBLE / nullif(count(verdict), 0) AS acc
FROM (SELECT verdict, unnest(CASE WHEN n_chars < 500 THEN ['unknown'] WHEN n_chars > 5000 THEN [lang, 'long'] ELSE [lang] END) AS label FROM {JUDGED}) GROUP BY label
""")
def a05_multi_label_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(spark, sf_dir)
    labels = F.when(F.col("n_chars") < 500, F.array().cast("array<string>")).when(F.col("n_chars") > 5000, F.array("lang", F.lit("long"))).otherwise(F.array("lang"))
    return metrics.labelled_accuracy(rows, labels)


_LETTERS = "(SELECT substr('ABCDE', 1 + doc_id % 6, 1) AS answer, substr('ABCDE', 1 + (doc_id * 7) % 6, 1) AS truth FROM documents)"


def _letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.expr("substr('ABCDE', cast(1 + doc_id % 6 AS int), 1)").alias("answer"), F.expr("substr('ABCDE', cast(1 + (doc_id * 7) % 6 AS int), 1)").alias("truth"))


def _letters_sql(keep: str) -> str:
    return f"SELECT count(*) AS n, count(*) FILTER (answer = truth) AS correct, count(*) FILTER (answer = truth) * 100.0::DOUBLE / count(*) AS acc FROM {_LETTERS} WHERE {keep}"


@query(_letters_sql("true"))
def a06_mcq_empty_wrong(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.mcq_accuracy(_letters(spark, sf_dir), "answer", "truth")


@query(_letters_sql("answer <> ''"))
def a06_mcq_empty_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.mcq_accuracy(_letters(spark, sf_dir), "answer", "truth", "skipped")


@query(_letters_sql("truth <> ''"))
def a06_mcq_truth_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.mcq_accuracy(_letters(spark, sf_dir), "answer", "truth", "truth")


@query(f"""
SELECT source, {", ".join(f"count(*) FILTER (verdict AND lang = '{x}') * 100.0::DOUBLE / nullif(count(verdict) FILTER (lang = '{x}'), 0) AS {x}" for x in ("en", "fr", "de", "es"))}
FROM {JUDGED} GROUP BY source
""")
def a07_cross_tab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.cross_tab(judged(spark, sf_dir), "source", "lang", ["en", "fr", "de", "es"])


@query(f"""
WITH c AS (SELECT lang, n_chars > 1000 AS long, source, count(*) FILTER (verdict) * 100.0::DOUBLE / count(verdict) AS acc FROM {JUDGED} GROUP BY ALL HAVING count(verdict) > 0),
r AS (SELECT source, row_number() OVER (ORDER BY acc DESC NULLS LAST, source) AS rank FROM (SELECT source, count(*) FILTER (verdict) * 100.0::DOUBLE / nullif(count(verdict), 0) AS acc FROM {JUDGED} GROUP BY source))
SELECT lang, long, source AS best, acc FROM c JOIN r USING (source) QUALIFY row_number() OVER (PARTITION BY lang, long ORDER BY acc DESC, rank) = 1
""")
def a08_best_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.best_cells(judged(spark, sf_dir).withColumn("long", F.col("n_chars") > 1000), "source", "lang", "long")


@query("""
SELECT l_returnflag, count(*) AS n, round(avg(nullif(l_quantity, 1)), 6) AS l_quantity, round(avg(nullif(l_linenumber, 1)), 6) AS l_linenumber FROM lineitem GROUP BY ALL
""")
def a09_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.means(table(spark, sf_dir, "lineitem"), ["l_returnflag"], ["l_quantity", "l_linenumber"], missing=1)
    return out.withColumns({c: F.round(c, 6) for c in ("l_quantity", "l_linenumber")})


@query("""
SELECT coalesce(l_shipmode, '__overall__') AS l_shipmode, n, quantity FROM (
 SELECT l_linestatus AS l_shipmode, count(*) AS n, round(avg(l_quantity), 6) AS quantity FROM lineitem GROUP BY ROLLUP (l_linestatus))
""")
def a10_means_with_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("l_shipmode"), "l_quantity")
    return metrics.with_overall(rows, "l_shipmode", [F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("quantity")])


@query(f"""
SELECT coalesce(lang, '__overall__') AS lang, correct, judged, pending FROM (
 SELECT lang, count(*) FILTER (verdict) AS correct, count(verdict) AS judged, count(*) - count(verdict) AS pending FROM {JUDGED} GROUP BY ROLLUP (lang))
""")
def a11_overall_and_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.with_overall(judged(spark, sf_dir), "lang", metrics.judged_counts(F.col("verdict")))


@query(f"""
SELECT CASE grouping_id(source, lang) WHEN 1 THEN 'source' WHEN 2 THEN 'lang' ELSE 'all' END AS dimension, CASE grouping_id(source, lang) WHEN 1 THEN source WHEN 2 THEN lang END AS value,
 count(*) FILTER (verdict) AS correct, count(verdict) AS judged FROM {JUDGED} GROUP BY GROUPING SETS ((source), (lang), ())
""")
def a12_parallel_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.grouped_separately(judged(spark, sf_dir), ["source", "lang"], metrics.judged_counts(F.col("verdict"))[:2])


@query("""
SELECT lang, count(*) AS n, round(avg(length(text)), 6) AS chars, round(avg(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))), 6) AS words, count(DISTINCT source) AS sources FROM documents GROUP BY lang
""")
def a13_corpus_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalweave.functions.semantics import words

    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg(F.length("text")), 6).alias("chars"), F.round(F.avg(F.size(words(F.col("text")))), 6).alias("words"), F.countDistinct("source").alias("sources"))


@query("SELECT count(DISTINCT user_id) AS users, count(*) * 1.0::DOUBLE / count(DISTINCT user_id) AS per_user FROM events")
def a14_distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").agg(F.countDistinct("user_id").alias("users"), (F.count("*") / F.countDistinct("user_id")).alias("per_user"))


@query("SELECT event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY event_type ORDER BY n DESC, first LIMIT 3")
def a15_top_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.top_frequencies(table(spark, sf_dir, "events"), "event_type", "event_id", 3)


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, quantile_cont(value, 0.5) AS median, round(stddev_samp(value), 6) AS std, min(value) AS low, max(value) AS high FROM events GROUP BY event_type")
def a16_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.summary(table(spark, sf_dir, "events"), ["event_type"], "value").withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query("""
WITH e AS (SELECT min(value) AS lo, greatest((max(value) - min(value)) / 20, 1e-6 / 20) AS w FROM events)
SELECT least(19, floor((value - lo) / w)::INT) AS bin, count(*) AS n, repeat('#', (count(*) * 40 / max(count(*)) OVER ())::INT) AS bar FROM events, e GROUP BY ALL
""".replace("(count(*) * 40 / max(count(*)) OVER ())::INT", "floor(count(*) * 40 / max(count(*)) OVER ())::INT"))
def a17_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalweave.sources.writers import bars

    rows = metrics.histogram(table(spark, sf_dir, "events"), "value", 20)
    peak = rows.agg(F.max("n").alias("peak"))
    return rows.crossJoin(F.broadcast(peak)).select("bin", "n", bars(F.col("n"), F.col("peak")).alias("bar"))


@query("SELECT event_type, avg((value > 0)::INT) AS over_0, avg((value > 50)::INT) AS over_1, avg((value > 100)::INT) AS over_2 FROM events GROUP BY event_type")
def a18_threshold_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.threshold_shares(table(spark, sf_dir, "events"), ["event_type"], "value", [0, 50, 100])


@query("""
SELECT event_type, s[1 + least(len(s) - 1, floor(len(s) * 10 / 100)::INT)] AS p10, s[1 + least(len(s) - 1, floor(len(s) * 50 / 100)::INT)] AS p50, s[1 + least(len(s) - 1, floor(len(s) * 100 / 100)::INT)] AS p100
FROM (SELECT event_type, list_sort(list(value)) AS s FROM events GROUP BY event_type)
""")
def a19_index_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.index_percentiles(table(spark, sf_dir, "events"), ["event_type"], "value", [10, 50, 100])


@query("""
SELECT lang, len(s) AS n, round(list_avg(s), 6) AS mean, s[1 + len(s) // 2] AS med, s[1 + least(len(s) - 1, floor(len(s) * 90 / 100)::INT)] AS p90, s[len(s)] AS max
FROM (SELECT lang, list_sort(list(n_chars)) AS s FROM documents GROUP BY lang)
""")
def a20_length_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    places = metrics.index_percentiles(docs, ["lang"], "n_chars", [50, 90]).select("lang", F.col("p50").alias("med"), "p90")
    return docs.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean"), F.max("n_chars").alias("max")).join(places, "lang")


_RULES = [("short", "n_chars < 400"), ("foreign", "lang <> 'en'"), ("poor", "quality = 0")]


@query("""
SELECT source, count(*) AS total, count(*) FILTER (r IS NULL) AS kept, count(*) FILTER (r IS NULL) * 100.0::DOUBLE / count(*) AS kept_pct,
 count(*) FILTER (r = 'short') AS short, count(*) FILTER (r = 'foreign') AS "foreign", count(*) FILTER (r = 'poor') AS poor
FROM (SELECT source, CASE WHEN n_chars < 400 THEN 'short' WHEN lang <> 'en' THEN 'foreign' WHEN quality = 0 THEN 'poor' END AS r FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY source
""")
def p12_a21_drop_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return filters.funnel_counts(filters.funnel(rows, [(n, F.expr(c)) for n, c in _RULES]), "source", [n for n, _ in _RULES])


@query(f"""
SELECT lang, count(*) FILTER (verdict AND toxic) AS "both", count(*) FILTER (verdict AND NOT toxic) AS a_only, count(*) FILTER (NOT verdict AND toxic) AS b_only, count(*) FILTER (NOT verdict AND NOT toxic) AS neither
FROM {JUDGED} WHERE verdict IS NOT NULL AND toxic IS NOT NULL GROUP BY lang
""")
def a22_contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.contingency(judged(spark, sf_dir), ["lang"], "verdict", "toxic")


@query(f"SELECT substr('ABCDE', x, 1) AS letter, avg((answer = substr('ABCDE', x, 1))::INT) - avg((truth = substr('ABCDE', x, 1))::INT) AS bias FROM {_LETTERS}, (SELECT unnest([1, 2, 3, 4, 5]) AS x) GROUP BY x")
def a25_prediction_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = _letters(spark, sf_dir)
    one = letters.agg(*(((F.avg((F.col("answer") == x).cast("double")) - F.avg((F.col("truth") == x).cast("double"))).alias(x)) for x in "ABCDE"))
    return one.unpivot([], list("ABCDE"), "letter", "bias")


@query("""
SELECT count(*) AS n, count(*) FILTER (quality = 1) AS correct FROM documents JOIN labels USING (doc_id) WHERE regexp_matches(text, '(?i)\\bthe (and|of)\\b')
""")
def a26_regex_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").where(F.col("text").rlike(r"(?i)\bthe (and|of)\b"))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("correct"))


@query("""
SELECT event_type, round(avg(r), 6) AS mean, avg((r >= 4)::INT) AS at_least_4, avg((r = 5)::INT) AS is_5, count(*) FILTER (r > s) AS win, count(*) FILTER (r = s) AS tie, count(*) FILTER (r < s) AS loss
FROM (SELECT event_type, 1 + event_id % 5 AS r, 1 + (event_id // 5) % 5 AS s FROM events) GROUP BY event_type
""")
def a27_human_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").selectExpr("event_type", "1 + event_id % 5 AS r", "1 + (event_id div 5) % 5 AS s")
    r, s = F.col("r"), F.col("s")
    return rows.groupBy("event_type").agg(F.round(F.avg(r), 6).alias("mean"), F.avg((r >= 4).cast("double")).alias("at_least_4"), F.avg((r == 5).cast("double")).alias("is_5"), F.count_if(r > s).alias("win"), F.count_if(r == s).alias("tie"), F.count_if(r < s).alias("loss"))


@query(f"""
WITH s AS (SELECT source, count(*) FILTER (verdict) * 100.0::DOUBLE / nullif(count(verdict), 0) AS acc FROM {JUDGED} GROUP BY source)
SELECT source, acc, acc - (SELECT acc FROM s WHERE source = 'src0') AS delta FROM s
""")
def a28_delta_against_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = metrics.judged_accuracy(judged(spark, sf_dir), ["source"]).select("source", "acc")
    return metrics.against_baseline(scores, "source", "acc", "src0")


@query(f"SELECT lang, round(avg(n_chars) FILTER (verdict), 6) AS right, round(avg(n_chars) FILTER (NOT verdict), 6) AS wrong FROM {JUDGED} GROUP BY lang".replace("AS right", 'AS "right"'))
def a29_means_by_correctness(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("verdict")
    return judged(spark, sf_dir).groupBy("lang").agg(F.round(F.avg(F.when(v, F.col("n_chars"))), 6).alias("right"), F.round(F.avg(F.when(~v, F.col("n_chars"))), 6).alias("wrong"))


@query("SELECT event_type, count(*) AS n FROM events WHERE value < 0.3 * (SELECT avg(value) FROM events) GROUP BY event_type")
def a30_relative_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    cut = events.agg((0.3 * F.avg("value")).alias("cut"))
    return events.crossJoin(F.broadcast(cut)).where("value < cut").groupBy("event_type").agg(F.count("*").alias("n"))


@query("""
SELECT l_returnflag, sum(n)::BIGINT AS n, max(elapsed) AS elapsed, round(sum(n) / max(elapsed), 6) AS rate FROM (SELECT l_returnflag, l_linenumber, count(*) AS n, sum(l_quantity) AS elapsed FROM lineitem GROUP BY ALL) GROUP BY l_returnflag
""")
def a31_shard_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("elapsed"))
    return shards.groupBy("l_returnflag").agg(F.sum("n").alias("n"), F.max("elapsed").alias("elapsed"), F.round(F.sum("n") / F.max("elapsed"), 6).alias("rate"))


@query("""
SELECT label, n, round(w / sum(w) OVER () * count(*) OVER (), 9) AS weight FROM (SELECT label, count(*) AS n, (1 - 0.999::DOUBLE) / (1 - pow(0.999::DOUBLE, count(*))) AS w FROM embeddings GROUP BY label)
""")
def a32_balanced_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.balanced_weights(table(spark, sf_dir, "embeddings"), "label").withColumn("weight", F.round("weight", 9))


@query("""
SELECT kind, count(*) AS n, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS pct FROM (
 SELECT CASE WHEN trim(text) = '' THEN 'empty' WHEN regexp_matches(trim(text), '^[A-E]$') THEN 'letter' WHEN contains(text, 'Final Answer') THEN 'final' WHEN regexp_matches(text, '\\([A-E]\\)') THEN 'parenthesised' ELSE 'other' END AS kind FROM conversations) GROUP BY kind
""")
def a38_answer_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    t = F.col("text")
    kind = F.when(F.trim(t) == "", "empty").when(F.trim(t).rlike("^[A-E]$"), "letter").when(F.contains(t, F.lit("Final Answer")), "final").when(t.rlike(r"\([A-E]\)"), "parenthesised").otherwise("other")
    counts = table(spark, sf_dir, "conversations").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(1))))


@query("""
SELECT count(*) AS rows, sum(len(list_filter(m, lambda x: contains(x, 'th')))) ::BIGINT AS failures, count(*) FILTER (len(list_filter(m, lambda x: contains(x, 'th'))) > 0) AS rows_with_any
FROM (SELECT conv_id, list(text) AS m FROM conversations GROUP BY conv_id)
""")
def a39_failure_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list("text").alias("m"))
    bad = F.size(F.filter("m", lambda x: F.contains(x, F.lit("th"))))
    return rows.agg(F.count("*").alias("rows"), F.sum(bad).alias("failures"), F.count_if(bad > 0).alias("rows_with_any"))


@query("SELECT source, quantile_cont(n_chars, 0.5) AS median, count(*) AS n FROM documents WHERE n_chars > 0 GROUP BY source HAVING count(*) >= 10")
def a40_median_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where("n_chars > 0").groupBy("source")
    return rows.agg(F.percentile("n_chars", F.lit(0.5)).alias("median"), F.count("*").alias("n")).where("n >= 10")


@query("""
SELECT lang, a, b, tie, a * 100.0::DOUBLE / nullif(a + b, 0) AS a_share, CASE WHEN a * 100.0 / nullif(a + b, 0) >= 70 THEN 'strong' WHEN a * 100.0 / nullif(a + b, 0) >= 55 THEN 'some' ELSE 'none' END AS band FROM (
 SELECT lang, count(*) FILTER (w = 1) AS a, count(*) FILTER (w = 2) AS b, count(*) FILTER (w = 0) AS tie FROM (
  SELECT lang, CASE WHEN n_chars % 7 = 0 THEN 0 WHEN flip THEN 3 - (1 + n_chars % 2) ELSE 1 + n_chars % 2 END AS w FROM (SELECT lang, n_chars, substr(md5('0:' || doc_id::VARCHAR), 1, 1) IN ('0','1','2','3','4','5','6','7') AS flip FROM documents)) GROUP BY lang)
""")
def a41_blinded_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalweave.operators.ranking import hash_order

    flip = F.substring(hash_order("doc_id"), 1, 1) < "8"
    said = 1 + F.col("n_chars") % 2
    won = F.when(F.col("n_chars") % 7 == 0, 0).when(flip, 3 - said).otherwise(said)
    rows = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count_if(won == 1).alias("a"), F.count_if(won == 2).alias("b"), F.count_if(won == 0).alias("tie"))
    share = divide_or(F.col("a") * 100.0, F.col("a") + F.col("b"))
    return rows.withColumn("a_share", share).withColumn("band", F.when(share >= 70, "strong").when(share >= 55, "some").otherwise("none"))


@query("SELECT event_id, CASE WHEN value <= 10 THEN 'low' WHEN value <= 50 THEN 'mid' ELSE 'high' END AS band, CASE WHEN value / 100 > 1.5 AND value / 50 > 1.5 THEN 'high' WHEN value / 100 > 0.4 THEN 'medium' ELSE 'low' END AS tier FROM events")
def p14_p16_ladders(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", filters.ladder(v, [(10, "low"), (50, "mid")], "high").alias("band"), filters.confidence(v / 100, v / 50).alias("tier"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 200000 AND o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT'")
def p05_filter_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"o_totalprice": {"ge": 1000, "lt": 200000}, "o_orderstatus": {"eq": "F"}, "o_orderpriority": {"ne": "1-URGENT"}}
    return table(spark, sf_dir, "orders").where(filters.condition(rules)).select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey FROM part WHERE NOT contains(p_name, '7') AND NOT contains(p_brand, '7') AND NOT contains(p_type, '7') AND NOT contains(p_size::VARCHAR, '7') AND NOT contains(p_partkey::VARCHAR, '7')")
def p06_blocklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.without_named(table(spark, sf_dir, "part").drop("p_retailprice"), ["7"]).select("p_partkey")


@query("""
SELECT v, kept, count(*) AS n FROM (SELECT coalesce(CASE quality WHEN 1 THEN 'NO' WHEN 0 THEN 'YES' END, 'MISSING') AS v, coalesce(quality, 1) = 1 AS kept FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY ALL
""")
def p11_verdict_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    kept, v = filters.verdict_policy(F.when(F.col("quality") == 1, "NO").when(F.col("quality") == 0, "YES"))
    return rows.groupBy(v.alias("v"), kept.alias("kept")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, round_even(n_chars / 8.0::DOUBLE, 0) AS half, trunc(n_chars / 7.0)::BIGINT AS whole, try_cast(source AS DOUBLE) AS bad FROM documents")
def t9_t10_p19_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").select("doc_id", half_even(n / 8).alias("half"), F.expr("cast(n_chars / 7 AS bigint)").alias("whole"), filters.number_or_null(F.col("source")).alias("bad"))


@query("""
SELECT mode, valid, reason, count(*) AS n FROM (
 SELECT mode, reason, reason IN ('distinct', 'bridges time', 'no transcript', 'passed') AS valid FROM (SELECT mode, CASE WHEN mode = 'priority' AND q = 1 THEN 'distinct' WHEN mode = 'priority' THEN 'too generic' WHEN t = 1 THEN 'known beforehand' WHEN mode = 'time' AND q = 1 THEN 'bridges time' WHEN mode = 'time' THEN 'no temporal synthesis'
  WHEN d % 10 = 0 THEN 'no transcript' WHEN mode = 'audio' AND q = 0 THEN 'not in transcript' WHEN mode = 'visual' AND q = 1 THEN 'found in transcript' ELSE 'passed' END AS reason
  FROM (SELECT doc_id AS d, ['audio', 'visual', 'time', 'priority'][1 + doc_id % 4] AS mode, quality AS q, toxic AS t FROM labels))) GROUP BY ALL
""")
def p17_question_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.element_at(F.array(*map(F.lit, ("audio", "visual", "time", "priority"))), (1 + F.col("doc_id") % 4).cast("int"))
    yes = F.when(F.col("quality") == 1, "YES").otherwise("no")
    ok, reason = filters.question_validity(mode, F.when(F.col("toxic") == 1, "YES"), yes, yes, F.when(F.col("quality") == 1, "DIFFERENT"), F.col("doc_id") % 10 != 0)
    return table(spark, sf_dir, "labels").groupBy(mode.alias("mode"), ok.alias("valid"), reason.alias("reason")).agg(F.count("*").alias("n"))
