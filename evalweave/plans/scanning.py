"""Queries that write a table in one layout and scan it back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.plans.registry import query, table
from evalweave.sources import readers, sheets, writers
from evalweave.sources.scratch import folder as _folder
from evalweave.streaming import jobs


@query("SELECT n_nationkey, n_name FROM nation")
def s01_k01_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "lines")
    writers.json_lines(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), path)
    return readers.json_any(spark, path, "n_nationkey int, n_name string")


@query("SELECT n_nationkey, n_name FROM nation")
def s01_s03_json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "array")
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    writers.json_arrays(rows.where("n_nationkey < 12"), path)
    writers.json_arrays(rows.where("n_nationkey >= 12"), path, mode="append")
    return readers.json_any(spark, path, "n_nationkey int, n_name string")


@query("SELECT n_nationkey, n_name FROM nation")
def s02_permissive_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "broken")
    good = table(spark, sf_dir, "nation").select(F.to_json(F.struct("n_nationkey", "n_name")).alias("value"))
    good.union(good.limit(3).select(F.concat(F.lit('{"n_nationkey": '), F.lit("oops")))).write.text(path)
    return readers.json_lines(spark, path, "n_nationkey int, n_name string").where("n_nationkey IS NOT NULL")


@query("SELECT r_name AS region, row_number() OVER (PARTITION BY r_name ORDER BY n_name) - 1 AS place, n_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def s04_keyed_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "keyed")
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    writers.keyed_json(rows, "r_name", ["n_name"], ["n_name"]).repartition("r_name").write.partitionBy("r_name").text(path)
    return readers.keyed_document(spark, path, "struct<n_name:string>", "region").withColumn("place", F.col("place").cast("long"))


@query("SELECT doc_id, lang AS model, source AS experiment FROM documents WHERE lang <> 'fr'")
def s05_s06_tree_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "tree")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("model"), F.col("source").alias("experiment"))
    writers.partitioned(rows.repartition("model", "experiment"), path, ["model", "experiment"])
    found = readers.matching_files(spark, path, "*.json", "doc_id long", ("model=fr",), lines=True)
    named = readers.path_parts(found, ["model", "experiment"])
    return named.select("doc_id", F.substring_index("model", "=", -1).alias("model"), F.substring_index("experiment", "=", -1).alias("experiment"))


@query("SELECT c_custkey::VARCHAR AS c_custkey, c_name FROM customer")
def s07_k04_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "csv")
    writers.separated(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), path)
    return readers.separated(spark, path)


@query("SELECT p_partkey::VARCHAR AS p_partkey, p_name FROM part")
def s08_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "tsv")
    writers.separated(table(spark, sf_dir, "part").select("p_partkey", "p_name"), path, "\t")
    return readers.separated(spark, path, "\t")


@query("SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_nationkey::VARCHAR AS c_nationkey FROM customer")
def s08_k05_workbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "sheet") + "/report.xlsx"
    sheets.write_sheet(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"), path, "Customers", most=1_000_000)
    return sheets.read_sheets(spark, path)


@query("SELECT item_id::VARCHAR AS uid, trim(left(text, 8)) AS question, ['x', 'y', '', ''] AS answer_choices, 'A' AS ground_truth FROM benchmark")
def s11_eval_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.concat(F.substring("text", 1, 8), F.lit("(A) x (B) y")).alias("question"), F.lit("A").alias("answer"))
    return readers.eval_items(raw).withColumn("question", F.substring_index(F.col("question"), "(A)", 1))


@query("SELECT vec_id, label FROM embeddings")
def s13_document_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "store")
    rows = table(spark, sf_dir, "embeddings")
    writers.replace_atomically(rows, path)
    return spark.read.parquet(path).select("vec_id", "label")


@query("SELECT s_suppkey, s_name FROM supplier")
def k08_atomic_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "swap")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    writers.replace_atomically(rows.limit(1), path)
    writers.replace_atomically(rows, path)
    return spark.read.parquet(path)


@query("SELECT n_regionkey, n_name FROM nation")
def k03_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "parts")
    writers.partitioned(table(spark, sf_dir, "nation").select("n_regionkey", "n_name"), path, ["n_regionkey"])
    return spark.read.json(path).select(F.col("n_regionkey").cast("int").alias("n_regionkey"), "n_name")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of four files."""
    path = _folder(spark, "feed")
    events = table(spark, sf_dir, "events")
    events.withColumn("ts", F.col("ts").cast("timestamp")).repartitionByRange(4, "event_id").sortWithinPartitions("event_id").write.parquet(path)
    return jobs.read_changes(spark, path, spark.read.parquet(path).schema)


@query("SELECT event_id, event_type FROM events WHERE value > 50")
def st1_checkpointed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, mark = _folder(spark, "out"), _folder(spark, "mark")
    jobs.run_once(_stream(spark, sf_dir).where("value > 50").select("event_id", "event_type"), out, mark)
    return spark.read.parquet(out)


@query("SELECT event_id, value * 2 AS twice FROM events WHERE event_id % 10 <> 7")
def st2_st7_resumed_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, bad, stream = _folder(spark, "out"), _folder(spark, "bad"), _stream(spark, sf_dir)

    def work(rows: DataFrame) -> DataFrame:
        return rows.select("event_id", (F.col("value") * 2).alias("twice"), F.when(F.col("event_id") % 10 == 7, "refused").alias("error"))

    # two runs over the same feed, each with a checkpoint of its own: the second finds all done
    for _ in range(2):
        jobs.resume(stream, "event_id", out, _folder(spark, "mark"), work, bad)
    return spark.read.parquet(out)


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 0".replace("count(*) AS n", "least(20, count(*)) AS n"))
def st4_quota_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _folder(spark, "out")
    jobs.run_once(jobs.quota(_stream(spark, sf_dir).select("event_type", "event_id"), "event_type", "event_id", 20), out, _folder(spark, "mark"))
    return spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def st5_windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return jobs.windowed_counts(rows, "ts", "event_type", "1 hour").select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT event_id, value * 2 AS twice, event_id // 100 AS save FROM events")
def st5_saved_every_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, mark, stream = _folder(spark, "out"), _folder(spark, "mark"), _stream(spark, sf_dir)
    jobs.save_every(stream, "event_id", 100, out, mark, lambda rows: rows.select("event_id", (F.col("value") * 2).alias("twice")))
    return spark.read.parquet(out).select("event_id", "twice", F.col("save").cast("long").alias("save"))
