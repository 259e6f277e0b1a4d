"""Queries over joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.operators import dedup, joins
from evalweave.plans.registry import query, table


@query("SELECT n_name, coalesce(r_name, '') AS r_name, coalesce(s, []) AS suppliers FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_name <> 'ASIA' LEFT JOIN (SELECT s_nationkey, list_sort(list(s_suppkey)) AS s FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey")
def j01_left_with_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = table(spark, sf_dir, "region").where("r_name <> 'ASIA'")
    sup = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list("s_suppkey")).alias("s"))
    rows = table(spark, sf_dir, "nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey"), "left").join(sup, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return rows.select("n_name", F.coalesce("r_name", F.lit("")).alias("r_name"), F.coalesce("s", F.array().cast("array<bigint>")).alias("suppliers"))


@query("""
WITH a AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE doc_id % 3 = 0 GROUP BY 1),
b AS (SELECT source, lang, min(quality) AS quality FROM documents JOIN labels USING (doc_id) WHERE doc_id % 3 = 0 GROUP BY ALL)
SELECT d.doc_id, coalesce(a.quality, b.quality) AS quality FROM documents d LEFT JOIN a USING (doc_id) LEFT JOIN b ON d.source = b.source AND d.lang = b.lang
""")
def j02_fallback_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    known = docs.join(table(spark, sf_dir, "labels").where("doc_id % 3 = 0"), "doc_id")
    return joins.fallback_join(docs, known, "doc_id", ["source", "lang"], ["quality"]).select("doc_id", "quality")


@query("SELECT count(*) FILTER (quality IS NOT NULL) AS attached, count(*) FILTER (quality IS NULL) AS missed FROM documents LEFT JOIN labels USING (doc_id)")
def j03_attach_and_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, missed = joins.attach(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")
    return found.agg(F.count("quality").alias("attached")).crossJoin(missed.agg(F.count("*").alias("missed")))


@query("SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id) WHERE doc_id NOT IN (SELECT item_id FROM benchmark)")
def j04_j08_inner_and_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    bench = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"))
    return rows.join(bench, "doc_id", "left_anti").select("doc_id", "lang", "quality")


_RUNS = "(SELECT doc_id, quality AS a FROM labels WHERE doc_id % 3 <> 0) x FULL JOIN (SELECT doc_id, toxic AS b FROM labels WHERE doc_id % 3 <> 1) y USING (doc_id)"


@query(f"SELECT doc_id, a, b, CASE WHEN x.doc_id IS NOT NULL AND y.doc_id IS NOT NULL THEN 'both' WHEN x.doc_id IS NOT NULL THEN 'a_only' ELSE 'b_only' END AS side FROM {_RUNS}".replace("SELECT doc_id, a, b", "SELECT coalesce(x.doc_id, y.doc_id) AS doc_id, a, b", 1))
def j05_paired_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    a = labels.where("doc_id % 3 <> 0").select("doc_id", F.col("quality").alias("v"))
    b = labels.where("doc_id % 3 <> 1").select("doc_id", F.col("toxic").alias("v"))
    return joins.paired(a, b, "doc_id", "v")


@query("SELECT conv_id, i - 1 AS place, u[i] AS asked, a[i] AS answered FROM (SELECT conv_id, list(text ORDER BY turn) FILTER (role = 'user') AS u, list(text ORDER BY turn) FILTER (role = 'assistant') AS a FROM conversations GROUP BY 1), LATERAL (SELECT unnest(range(1, 1 + least(len(u), coalesce(len(a), 0)))) AS i)")
def j06_positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    conv = table(spark, sf_dir, "conversations")
    place = (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).cast("long")
    asked = conv.where("role = 'user'").select("conv_id", place.alias("place"), F.col("text").alias("asked"))
    answered = conv.where("role = 'assistant'").select("conv_id", place.alias("place"), F.col("text").alias("answered"))
    return asked.join(answered, ["conv_id", "place"])


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j07_unfinished(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def j09_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(keys, "o_custkey", "left_semi").select("o_orderkey")


_SEG = "(SELECT event_id, user_id, epoch_us(ts) / 1e6 AS s, epoch_us(ts) / 1e6 + value AS e FROM events)"


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    return table(spark, sf_dir, "events").select("event_id", "user_id", at.alias("s"), (at + F.col("value")).alias("e"))


@query(f"SELECT a.event_id, b.event_id AS other FROM {_SEG} a JOIN {_SEG} b ON a.user_id = b.user_id AND a.s < b.e AND b.s < a.e AND a.event_id < b.event_id")
def j10_range_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _segments(spark, sf_dir)
    b = a.select("user_id", F.col("event_id").alias("other"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    return joins.range_join(a, b, ["user_id"], ("s", "e"), ("s2", "e2"), 600.0).where("event_id < other").select("event_id", "other")


@query(f"SELECT a.event_id, b.event_id AS other FROM {_SEG} a JOIN {_SEG} b ON a.user_id = b.user_id AND a.s <= b.e AND b.s <= a.e AND a.event_id <> b.event_id")
def j13_j14_closed_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _segments(spark, sf_dir)
    b = a.select("user_id", F.col("event_id").alias("other"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    return joins.range_join(a, b, ["user_id"], ("s", "e"), ("s2", "e2"), 600.0, closed=True).where("event_id <> other").select("event_id", "other")


@query(f"""
WITH s AS (SELECT * FROM {_SEG} WHERE event_id % 3 = 0), w AS (SELECT * FROM {_SEG} WHERE event_id % 50 = 1),
o AS (SELECT w.event_id AS wanted, s.event_id AS seg FROM w JOIN s USING (user_id) WHERE w.s < s.e AND s.s < w.e),
n AS (SELECT w.event_id AS wanted, s.event_id AS seg FROM w JOIN s USING (user_id) WHERE w.event_id NOT IN (SELECT wanted FROM o) QUALIFY row_number() OVER (PARTITION BY w.event_id ORDER BY abs((w.s + w.e) / 2 - (s.s + s.e) / 2), s.event_id) = 1)
SELECT * FROM o UNION ALL SELECT * FROM n
""")
def j11_nearest_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _segments(spark, sf_dir)
    segs = rows.where("event_id % 3 = 0").select("user_id", F.col("event_id").alias("seg"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    wanted = rows.where("event_id % 50 = 1").withColumnRenamed("event_id", "wanted")
    hit = joins.range_join(wanted, segs, ["user_id"], ("s", "e"), ("s2", "e2"), 600.0)
    return joins.nearest_fallback(hit, wanted, segs, ["user_id"], "wanted", (F.col("s") + F.col("e")) / 2, (F.col("s2") + F.col("e2")) / 2, "seg").select("wanted", "seg")


@query(f"SELECT p.event_id, list_sort(list_distinct(list(b.event_id))) AS inside FROM (SELECT * FROM {_SEG} WHERE event_id % 7 = 0) p JOIN {_SEG} b ON p.user_id = b.user_id AND p.s > b.s AND p.s < b.e GROUP BY p.event_id")
def j12_point_in_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _segments(spark, sf_dir)
    points = rows.where("event_id % 7 = 0").select("event_id", "user_id", F.col("s").alias("at"))
    hit = joins.point_join(points, rows.withColumnRenamed("event_id", "other"), ["user_id"], "at", ("s", "e"), 600.0, closed=False)
    return hit.groupBy("event_id").agg(F.array_sort(F.collect_set("other")).alias("inside"))


@query(f"SELECT b.event_id, list_sort(list(p.event_id)) AS frames FROM {_SEG} b JOIN {_SEG} p ON p.user_id = b.user_id AND floor(p.s) >= b.s AND floor(p.s) <= b.e GROUP BY b.event_id")
def j21_frames_of_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _segments(spark, sf_dir)
    points = rows.select(F.col("event_id").alias("frame"), "user_id", F.floor("s").cast("double").alias("at"))
    hit = joins.point_join(points, rows, ["user_id"], "at", ("s", "e"), 600.0)
    return hit.groupBy("event_id").agg(F.array_sort(F.collect_list("frame")).alias("frames"))


@query("""
WITH i AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, value FROM events)
SELECT DISTINCT a.event_id FROM i a JOIN i b ON a.user_id = b.user_id AND a.n BETWEEN b.n - 2 AND b.n + 2 AND b.value > 200
""")
def j15_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    items = table(spark, sf_dir, "events").withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return joins.neighbours(items.where("value > 200"), items, ["user_id"], "n", 2).select("event_id")


@query("""
WITH e AS (SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem), s AS (SELECT DISTINCT src FROM e WHERE src % 50 = 0)
SELECT DISTINCT a.src AS seed, b.src AS node FROM e a JOIN s ON a.src = s.src JOIN e b ON a.dst = b.dst WHERE b.src NOT IN (SELECT src FROM s)
""")
def j16_two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    return joins.two_hop(edges, edges.where("src % 50 = 0"))


#: Each document and the next one, round the ring of hashes, of another source.
DONORS = """(
WITH o AS (SELECT doc_id, source, row_number() OVER (ORDER BY left(md5(doc_id::VARCHAR), 15), doc_id) AS i FROM documents),
s AS (SELECT *, CASE WHEN lag(source) OVER (ORDER BY i) IS DISTINCT FROM source THEN i END AS start FROM o),
n AS (SELECT *, min(start) OVER (ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM s)
SELECT n.doc_id, d.doc_id AS donor, d.source AS donor_source FROM n LEFT JOIN o d ON d.i = coalesce(n.next, CASE WHEN n.source <> (SELECT source FROM o WHERE i = 1) THEN 1 ELSE (SELECT min(start) FROM s WHERE start > 1) END)
)"""


@query(f"SELECT doc_id, donor, donor_source FROM {DONORS}")
def j17_donors_of_other_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    donors = joins.ring_donors(docs, "doc_id", "source", 16)
    of = docs.select(F.col("doc_id").alias("donor"), F.col("source").alias("donor_source"))
    return donors.join(of, "donor", "left").select("doc_id", "donor", "donor_source")


@query("SELECT o_orderkey, coalesce(o_orderpriority, 'none') AS priority, c_mktsegment AS segment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def j18_j19_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.select("o_orderkey", F.coalesce("o_orderpriority", F.lit("none")).alias("priority"), F.col("c_mktsegment").alias("segment"))


@query("SELECT a.event_id, count(*) AS negatives FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id // 64 = b.event_id // 64 AND a.event_id <> b.event_id GROUP BY 1")
def j20_batch_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").selectExpr("event_id", "user_id", "event_id div 64 AS batch")
    other = rows.select(F.col("event_id").alias("other"), "user_id", "batch")
    return rows.join(other, ["user_id", "batch"]).where("event_id <> other").groupBy("event_id").agg(F.count("*").alias("negatives"))


@query("""
WITH v AS (SELECT user_id, min(s) AS s0, max(e) - min(s) AS d FROM {seg} GROUP BY 1), w AS (SELECT user_id, i, s0 + i * d / 8 AS ws, s0 + (i + 1) * d / 8 AS we FROM v, range(8) r(i)),
g AS (SELECT user_id, s, e FROM {seg} WHERE event_id % 400 = 3), o AS (SELECT DISTINCT w.user_id, w.i FROM w JOIN g ON w.user_id = g.user_id AND w.ws < g.e AND g.s < w.we)
SELECT user_id, i FROM o UNION ALL SELECT user_id, i FROM w WHERE i < 2 AND user_id NOT IN (SELECT user_id FROM o)
""".replace("{seg}", _SEG))
def j22_oracle_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _segments(spark, sf_dir)
    span = rows.groupBy("user_id").agg(F.min("s").alias("s0"), (F.max("e") - F.min("s")).alias("d"))
    win = span.select("user_id", "s0", "d", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("i")).selectExpr("user_id", "i", "s0 + i * d / 8 AS ws", "s0 + (i + 1) * d / 8 AS we")
    truth = rows.where("event_id % 400 = 3").select("user_id", "s", "e")
    hit = joins.range_join(win, truth, ["user_id"], ("ws", "we"), ("s", "e"), 36000.0).select("user_id", "i").distinct()
    rest = win.where("i < 2").join(hit.select("user_id").distinct(), "user_id", "left_anti").select("user_id", "i")
    return hit.unionByName(rest)


@query(f"SELECT count(*) FILTER (x.doc_id IS NOT NULL AND y.doc_id IS NOT NULL) AS common, count(*) FILTER (y.doc_id IS NULL) AS a_only, count(*) FILTER (x.doc_id IS NULL) AS b_only FROM {_RUNS}")
def u03_set_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return dedup.set_counts(labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 <> 1"), "doc_id")
