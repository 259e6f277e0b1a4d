"""Queries over clock texts, intervals, cues and change points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalweave.functions import times
from evalweave.operators import ranking
from evalweave.plans.registry import query, table
from evalweave.sources.readers import cues


@query("""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN h * 3600 + m * 60 + s WHEN 1 THEN m * 60 + s WHEN 2 THEN s ELSE 0 END AS seconds FROM (SELECT event_id, (event_id // 7 % 5)::DOUBLE AS h, (event_id // 11 % 60)::DOUBLE AS m, (event_id % 60 + 0.25)::DOUBLE AS s FROM events)
""")
def d01_clock_to_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("""CASE event_id % 4 WHEN 0 THEN format_string('%02d:%02d:%02d,250', event_id div 7 % 5, event_id div 11 % 60, event_id % 60)
        WHEN 1 THEN format_string('%02d:%02d.25', event_id div 11 % 60, event_id % 60) WHEN 2 THEN format_string('%d.25', event_id % 60) ELSE 'later' END""")
    return table(spark, sf_dir, "events").select("event_id", times.seconds(text, 0.0).alias("seconds"))


@query("""
SELECT event_id, printf('%02d:%02d', w // 60, w % 60) AS ms, printf('%02d:%02d:%02d', w // 3600, w % 3600 // 60, w % 60) AS hms, printf('%02d:%02d:%02d,%03d', w // 3600, w % 3600 // 60, w % 60, floor((value % 1) * 1000)::BIGINT) AS srt
FROM (SELECT event_id, value, floor(value)::BIGINT AS w FROM events)
""")
def d02_seconds_to_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", *(times.clock(v, s).alias(s) for s in ("ms", "hms", "srt")))


@query("SELECT event_id, epoch_us(ts) / 1e6 - epoch_us(min(ts) OVER (PARTITION BY user_id)) / 1e6 AS at FROM events")
def d04_d05_rebase(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    first = F.unix_micros(F.min("ts").over(Window.partitionBy("user_id")).cast("timestamp")) / F.lit(1e6)
    return table(spark, sf_dir, "events").select("event_id", (at - first).alias("at"))


_S = "(SELECT user_id, event_id, epoch_us(ts) / 1e6 AS s, epoch_us(ts) / 1e6 + value * 60 AS e FROM events)"


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    return table(spark, sf_dir, "events").select("user_id", "event_id", at.alias("s"), (at + F.col("value") * 60).alias("e"))


def _islands(keep: str) -> str:
    return f"""SELECT user_id, min(s) AS s, max(e) AS e FROM (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM (
      SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM {_S} WHERE {keep})) GROUP BY user_id, g"""


@query(f"SELECT user_id, s, e FROM ({_islands('true')})")
def d06_d16_merged_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.islands(_segments(spark, sf_dir), "user_id", "s", "e")


@query(f"""
WITH a AS ({_islands('event_id % 2 = 0')}), b AS ({_islands('event_id % 2 = 1')}),
i AS (SELECT a.user_id, sum(greatest(0, least(a.e, b.e) - greatest(a.s, b.s))) AS i FROM a JOIN b USING (user_id) GROUP BY 1), u AS (SELECT user_id, sum(e - s) AS t FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1)
SELECT user_id, round(coalesce(i, 0) / (t - coalesce(i, 0)), 6) AS iou FROM u LEFT JOIN i USING (user_id)
""")
def d07_set_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _segments(spark, sf_dir).withColumnsRenamed({"s": "start", "e": "end"})
    return ranking.set_iou(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), "user_id", 43_200.0).select("user_id", F.round("iou", 6).alias("iou"))


@query("""
WITH x AS (SELECT event_id, greatest(0, least(e, f) - greatest(s, t)) / (greatest(e, f) - least(s, t)) AS iou, event_id % 3 = 0 AS ok FROM (SELECT event_id, 0 AS s, value AS e, value / 4 AS t, value / 4 + 50 AS f FROM events WHERE value > 0) WHERE true),
y AS (SELECT event_id, CASE WHEN e < t OR f < s THEN 0 ELSE greatest(0, least(e, f) - greatest(s, t)) / (e - s + f - t - greatest(0, least(e, f) - greatest(s, t))) END AS iou, event_id % 3 = 0 AS ok FROM (SELECT event_id, 0 AS s, value AS e, value / 4 AS t, value / 4 + 50 AS f FROM events WHERE value > 0))
SELECT t AS threshold, avg((iou >= t)::INT) AS recall, avg((iou >= t AND ok)::INT) AS accuracy FROM y, (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5])::DOUBLE AS t) GROUP BY t
""")
def a24_iou_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("value > 0")
    v = F.col("value")
    score = times.iou(F.array(times.segment(F.lit(0.0), v)), F.array(times.segment(v / 4, v / 4 + 50)))
    flat = rows.select(score.alias("iou"), (F.col("event_id") % 3 == 0).alias("ok"), F.explode(F.array(*(F.lit(t) for t in (0.1, 0.2, 0.3, 0.4, 0.5)))).alias("threshold"))
    hit = F.col("iou") >= F.col("threshold")
    return flat.groupBy("threshold").agg(F.avg(hit.cast("double")).alias("recall"), F.avg((hit & F.col("ok")).cast("double")).alias("accuracy"))


@query("SELECT event_id, value > 10 AND 5 < 20 + value AS strict, value >= 10 AS closed FROM events")
def d08_t16_overlap_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, seg = F.col("value"), F.array(times.segment(F.lit(10.0), F.lit(20.0)))
    return table(spark, sf_dir, "events").select("event_id", times.overlaps(F.lit(5.0), v, seg).alias("strict"), times.overlaps(F.lit(5.0), v, seg, closed=True).alias("closed"))


@query("SELECT user_id, min(s) AS first, max(e) AS last FROM " + _S + " GROUP BY 1")
def a33_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir).groupBy("user_id").agg(F.min("s").alias("first"), F.max("e").alias("last"))


@query("SELECT event_id, CASE WHEN greatest(value, 80) > least(value, 80) AND least(100, greatest(value, 80)) > greatest(0, least(value, 80)) THEN greatest(0, least(value, 80.0)) END AS low, CASE WHEN least(100, greatest(value, 80)) > greatest(0, least(value, 80)) THEN least(100, greatest(value, 80.0)) END AS high FROM events")
def d09_sanitised_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = times.sanitised(F.col("value"), F.lit(80.0), F.lit(100.0))
    return table(spark, sf_dir, "events").select("event_id", s["start"].alias("low"), s["end"].alias("high"))


@query("""
SELECT span, count(*) AS n, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS pct FROM (SELECT least(15, greatest(a, floor((value * 3 - 0.001) / 20)::INT)) - a + 1 AS span FROM (SELECT value, least(15, greatest(0, floor(value / 20)::INT)) AS a FROM events)) GROUP BY span
""")
def a37_d10_slot_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, last = times.index_span(F.col("value"), F.col("value") * 3, F.lit(20.0), F.lit(16))
    counts = table(spark, sf_dir, "events").groupBy((last - first + 1).alias("span")).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(1))))


@query("SELECT event_id, i * value / 6 AS s, (i + 1) * value / 6 AS e FROM events, range(6) r(i)")
def d11_equal_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.explode(times.windows(F.col("value"), 6)).alias("x"))
    return rows.select("event_id", F.col("x.start").alias("s"), F.col("x.end").alias("e"))


@query("SELECT event_id, i * 25.0::DOUBLE AS s, least(value, (i + 1) * 25.0::DOUBLE) AS e FROM events, LATERAL (SELECT unnest(range(greatest(1, ceil(value / 25)::BIGINT))) AS i)")
def d12_split_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    segs = times.split_long(F.array(times.segment(F.lit(0.0), F.col("value"))), 25.0)
    return table(spark, sf_dir, "events").select("event_id", F.explode(segs).alias("x")).select("event_id", F.col("x.start").alias("s"), F.col("x.end").alias("e"))


_SHIFTED = """
WITH v AS (SELECT event_id, value AS b, value + 20 AS e, 300.0::DOUBLE AS d, 20.0::DOUBLE AS z FROM events),
m AS (SELECT *, unnest([{k: 1, f: e + 30, t: e + 30 + z}, {k: 2, f: b - 30 - z, t: b - 30}, CASE WHEN e + 30 + z > d THEN {k: 3, f: (e + 30) % d, t: (e + 30) % d + z} END,
  CASE WHEN b - 30 - z < 0 THEN {k: 4, f: greatest(0, d + b - 30 - z), t: d + b - 30} END,
  {k: 5, f: greatest(0, ((b + e) / 2 + d / 2) % d - z / 2), t: CASE WHEN ((b + e) / 2 + d / 2) % d < z / 2 THEN z ELSE ((b + e) / 2 + d / 2) % d + z / 2 END}]) AS c FROM v),
w AS (SELECT event_id, b, e, d, c.k AS k, CASE WHEN c.k = 5 AND c.t > d THEN greatest(0, d - z) ELSE c.f END AS f, CASE WHEN c.k = 5 AND c.t > d THEN d ELSE c.t END AS t FROM m WHERE c IS NOT NULL),
x AS (SELECT event_id, b, e, k, greatest(0, f) AS f, least(d, t) AS t FROM w)
SELECT event_id, k, f, t FROM x WHERE t - f >= 1 AND NOT (f < e AND t > b)
"""


@query(f"""
WITH RECURSIVE c AS (SELECT event_id, f, t, row_number() OVER (PARTITION BY event_id ORDER BY k) AS i FROM ({_SHIFTED})),
r AS (SELECT event_id, 0::BIGINT AS i, []::STRUCT(f DOUBLE, t DOUBLE)[] AS taken FROM events UNION ALL
 SELECT c.event_id, c.i, CASE WHEN len(taken) < 2 AND len(list_filter(taken, lambda x: c.f < x.t AND c.t > x.f)) = 0 THEN list_append(taken, {{f: c.f, t: c.t}}) ELSE taken END FROM r JOIN c ON c.event_id = r.event_id AND c.i = r.i + 1),
l AS (SELECT event_id, max_by(taken, i) AS taken FROM r GROUP BY 1)
SELECT event_id, place, round(taken[place + 1].f, 6) AS s, round(taken[place + 1].t, 6) AS e FROM l, LATERAL (SELECT unnest(range(len(taken))) AS place)
""")
def d13_d14_shifted_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = F.array(times.segment(F.col("value"), F.col("value") + 20))
    made = times.disjoint(times.shifted(truth, F.lit(300.0), 30.0, far=True), truth, 2)
    rows = table(spark, sf_dir, "events").select("event_id", F.posexplode(made).alias("place", "x"))
    return rows.select("event_id", F.col("place").cast("long").alias("place"), F.round("x.start", 6).alias("s"), F.round("x.end", 6).alias("e"))


@query("SELECT event_id, list_distinct([floor((i + 0.5) * value / n)::BIGINT FOR i IN range(n)]) AS frames FROM (SELECT event_id, value, 8 AS n FROM events WHERE value > 0)".replace("list_distinct([floor((i + 0.5) * value / n)::BIGINT FOR i IN range(n)])", "list_sort(list_distinct(list_transform(range(8), lambda i: floor((i + 0.5) * value / 8)::BIGINT)))"))
def d15_clue_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("value > 0")
    return rows.select("event_id", F.array_sort(times.clue_frames(F.array(times.segment(F.lit(0.0), F.col("value"))), 8)).alias("frames"))


@query("SELECT event_id FROM (SELECT event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS NULL OR abs(value - p) > 50")
def w09_change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").withColumn("p", before).where("p IS NULL OR abs(value - p) > 50").select("event_id")


@query("""
WITH m AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS a, count(*) OVER (PARTITION BY user_id) AS n FROM events), k AS (SELECT *, sum((a = 0 OR value > 150)::INT) OVER (PARTITION BY user_id) AS k FROM m)
SELECT event_id FROM k WHERE CASE WHEN k < least(40, n) THEN list_contains(list_transform(range(40), lambda i: round_even(i * (n - 1) / 39.0::DOUBLE, 0)), a) ELSE a = 0 OR value > 150 END
""")
def w10_least_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.kept_changes(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value", 150.0, 40).select("event_id")


@query("""
WITH RECURSIVE p AS (SELECT DISTINCT user_id, epoch_us(ts) / 1e6 AS s FROM events), n AS (SELECT user_id, s, min(s) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 3600 FOLLOWING AND UNBOUNDED FOLLOWING) AS t FROM p),
r AS (SELECT user_id, min(s) AS s FROM p GROUP BY 1 UNION ALL SELECT n.user_id, n.t FROM r JOIN n ON n.user_id = r.user_id AND n.s = r.s WHERE n.t IS NOT NULL)
SELECT user_id, s AS kept FROM r
""")
def w11_greedy_gap_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.gap_merged(_segments(spark, sf_dir), "user_id", "s", 3600.0)


@query("""
WITH RECURSIVE o AS (SELECT user_id, event_id::DOUBLE AS s, event_id + value AS e, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
r AS (SELECT user_id, i, s AS f, e AS t, e - s < 30 AS held FROM o WHERE i = 1 UNION ALL
 SELECT o.user_id, o.i, CASE WHEN r.held THEN r.f ELSE o.s END, o.e, NOT r.held AND o.e - o.s < 30 FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1)
SELECT user_id, f AS start, t AS "end" FROM r QUALIFY NOT held OR i = max(i) OVER (PARTITION BY user_id)
""")
def w13_short_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_id").cast("double").alias("s"), (F.col("event_id") + F.col("value")).alias("e"))
    return ranking.short_merged(rows, "user_id", "s", "e", 30.0)


@query("""
WITH g AS (SELECT user_id, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f, s AS t FROM (SELECT user_id, epoch_us(ts) / 1e6 AS s, epoch_us(ts) / 1e6 + value AS e FROM events))
SELECT user_id, f + i * 5000.0::DOUBLE AS s, least(t, f + (i + 1) * 5000.0::DOUBLE) AS e FROM g, LATERAL (SELECT unnest(range(ceil((t - f) / 5000)::BIGINT)) AS i) WHERE f < t
""")
def w14_filled_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    rows = table(spark, sf_dir, "events").select("user_id", at.alias("s"), (at + F.col("value")).alias("e"))
    return ranking.filled_gaps(rows, "user_id", "s", "e", 5000.0)


@query("SELECT event_id, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 - epoch_us(ts) / 1e6 AS gap FROM events")
def w15_gap_to_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").select("event_id", (F.unix_micros(after.cast("timestamp")) / F.lit(1e6) - F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("gap"))


@query("""
SELECT conv_id, t - 1 AS place, ((t - 1) * 10)::DOUBLE AS start, ((t - 1) * 10)::DOUBLE + 5.5 AS "end", trim(regexp_replace(x, '\\s+', ' ', 'g')) AS text FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS t, text AS x FROM conversations)
""")
def s09_subtitles(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    rows = table(spark, sf_dir, "conversations").withColumn("t", n)
    body = F.regexp_replace("text", r"\s+", " ")
    block = F.concat_ws("\n", (F.col("t") + 1).cast("string"), F.concat(times.clock(F.col("t") * 10.0, "srt"), F.lit(" --> "), times.clock(F.col("t") * 10.0 + 5.5, "srt")), body)
    files = rows.select("conv_id", "t", block.alias("block")).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "block"))), lambda x: x["block"]), "\n\n").alias("srt"))
    return files.select("conv_id", F.posexplode(cues(F.col("srt"))).alias("place", "cue")).select("conv_id", F.col("place").cast("long").alias("place"), "cue.*")


@query("SELECT user_id, string_agg(event_type, ' ' ORDER BY ts, event_id)[1:40] AS text FROM events WHERE value >= 20 AND value <= 60 GROUP BY 1")
def f26_joined_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("value >= 20 AND value <= 60").groupBy("user_id")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"]), " ")
    return rows.agg(F.substring(joined, 1, 40).alias("text"))
