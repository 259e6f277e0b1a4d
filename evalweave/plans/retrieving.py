"""Queries over vectors, search and frame selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalweave.functions import vectors
from evalweave.operators import joins, ranking, retrieval, selection
from evalweave.plans import plugins
from evalweave.plans.registry import query, table

_V = "(SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"
_QUERY = [((i * 37) % 64 - 32) / 64 for i in range(64)]
_Q = "[" + ", ".join(f"{x!r}::DOUBLE" for x in _QUERY) + "]"


def _l2(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, 65), lambda i: pow({a}[i] - {b}[i], 2)))"


def _cos(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"


@query(f"SELECT vec_id, round({_cos('v', _Q)}, 6) AS cosine, round({_l2('v', _Q)}, 6) AS l2sq FROM {_V}")
def m01_m02_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, e = F.array(*map(F.lit, _QUERY)), F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.cosine(e, q), 6).alias("cosine"), F.round(vectors.squared_l2(e, q), 6).alias("l2sq"))


@query(f"SELECT vec_id, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first FROM {_V}")
def m03_unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.unit(F.col("embedding"))[0], 6).alias("first"))


@query(f"SELECT * FROM (SELECT vec_id, label, round({_l2('v', _Q)}, 6) AS score FROM {_V} ORDER BY {_l2('v', _Q)}, vec_id LIMIT 40) WHERE label >= 3 AND label < 7")
def r01_t14_search_then_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = retrieval.search(table(spark, sf_dir, "embeddings"), _QUERY, 40, {"label": {"ge": 3, "lt": 7}})
    return rows.select("vec_id", "label", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id, label, round({_cos('v', _Q)}, 6) AS score FROM {_V} WHERE label >= 3 AND label < 7 ORDER BY {_cos('v', _Q)} DESC, vec_id LIMIT 40")
def r02_t15_filter_then_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = retrieval.search(table(spark, sf_dir, "embeddings"), _QUERY, 40, {"label": {"ge": 3, "lt": 7}}, "cosine", "pre")
    return rows.select("vec_id", "label", F.round("score", 6).alias("score"))


@query(f"""
SELECT q.vec_id AS query, d.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_l2('d.v', 'q.v')}, d.vec_id) AS place FROM {_V} q, {_V} d WHERE q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id QUALIFY place <= 5
""")
def w18_r07_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return retrieval.nearest(e, e.where("vec_id % 50 = 0"), 5).select("query", "vec_id", "place")


@query("""
SELECT e.user_id, e.event_id FROM (SELECT user_id, event_id, value, epoch_us(ts) / 1e6 AS s FROM events) e JOIN (SELECT user_id, min(epoch_us(ts) / 1e6) AS t FROM events GROUP BY 1) u USING (user_id) WHERE s <= t + 50000 AND s + value >= t + 100 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 3
""")
def r03_context_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "value", at.alias("s"), (at + F.col("value")).alias("e"))
    wanted = rows.groupBy("user_id").agg((F.min("s") + 100).alias("from"), (F.min("s") + 50000).alias("to"))
    hit = joins.range_join(wanted, rows, ["user_id"], ("from", "to"), ("s", "e"), 20000.0, closed=True)
    return ranking.capped(hit, ["user_id"], [F.col("value").desc(), F.col("event_id")], 3).select("user_id", "event_id")


@query("""
SELECT item_id, round(len(list_intersect(['the', 'and', 'of', 'to'], list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)))) / 4.0::DOUBLE, 6) AS score FROM benchmark WHERE item_id >= 5 ORDER BY score DESC, item_id LIMIT 10
""")
def r02_text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = retrieval.hybrid(table(spark, sf_dir, "benchmark"), "The and of to", k=10, mode="text", rules={"item_id": {"ge": 5}}, key="item_id")
    return rows.select("item_id", F.round("score", 6).alias("score"))


@query(f"SELECT list_sort(list(vec_id)) AS frames FROM (SELECT vec_id FROM {_V} WHERE label = 4 ORDER BY {_l2('v', _Q)}, vec_id LIMIT 5)")
def r04_frame_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "embeddings").withColumn("frame", F.concat_ws("_", F.lit("video"), F.col("label").cast("string"), F.col("vec_id").cast("string")))
    rows = retrieval.search(named, _QUERY, 5, {"label": {"eq": 4}}, mode="pre")
    number = F.substring_index("frame", "_", -1).cast("bigint")
    return rows.agg(F.array_sort(F.collect_list(number)).alias("frames"))


@query("SELECT item_id, left(text, 30) AS summary FROM benchmark WHERE item_id >= 10 ORDER BY item_id LIMIT 3")
def r05_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalweave.operators.filters import condition

    return table(spark, sf_dir, "benchmark").where(condition({"item_id": {"ge": 10}})).orderBy("item_id").limit(3).select("item_id", F.substring("text", 1, 30).alias("summary"))


@query(f"""
WITH s AS (SELECT vec_id, label, v, row_number() OVER (ORDER BY {_l2('v', _Q)}, vec_id) AS rank FROM {_V} QUALIFY rank <= 5),
c AS (SELECT s.vec_id AS seed, s.rank, d.vec_id AS node, {_cos('d.v', 's.v')} AS score FROM s JOIN {_V} d USING (label) WHERE d.vec_id NOT IN (SELECT vec_id FROM s)),
o AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY node ORDER BY rank, score DESC, seed) = 1)
SELECT seed, node, row_number() OVER (PARTITION BY seed ORDER BY score DESC, node) AS place FROM o QUALIFY place <= 3
""")
def r06_w19_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    seeds = retrieval.search(e, _QUERY, 5).withColumn("rank", F.row_number().over(Window.orderBy("score", "vec_id")))
    edges = e.select(F.col("vec_id").alias("src"), F.col("label").alias("dst"))
    pairs = joins.two_hop(edges, seeds.select(F.col("vec_id").alias("src")))
    scored = pairs.join(seeds.select(F.col("vec_id").alias("seed"), "rank", F.col("embedding").alias("a")), "seed").join(e.select(F.col("vec_id").alias("node"), F.col("embedding").alias("b")), "node")
    return retrieval.assign_once(scored.withColumn("score", vectors.cosine(F.col("b"), F.col("a"))), "seed", "node", "rank", "score", 3).select("seed", "node", "place")


@query("""
WITH m AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS a, count(*) OVER (PARTITION BY user_id) AS n FROM events),
p AS (SELECT * FROM m WHERE n <= 32 OR list_contains(list_transform(range(32), lambda i: round_even(i * (n - 1) / 31.0::DOUBLE, 0)), a)), k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 6)
SELECT user_id, list_sort(list(event_id)) AS ids FROM k GROUP BY 1
""")
def r08_frame_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.frame_selection(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value", 32, 6)


@query("SELECT p_partkey, list_sort(list_distinct(list_concat([0, 1], list_transform(range(4), lambda i: round_even(i * (p_size + 2) / 3.0::DOUBLE, 0)::INT)))) AS ids FROM part")
def r09_u05_context_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", retrieval.context_ids(F.array(F.lit(0), F.lit(1)), F.col("p_size") + 3, 6, 4).alias("ids"))


@query("""
WITH p AS (SELECT *, least(3, a // greatest(1, n // 4)) AS x, least(15, a // greatest(1, n // 16)) AS y FROM (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS a, count(*) OVER (PARTITION BY user_id) AS n FROM events)),
b AS (SELECT user_id, x FROM (SELECT user_id, x, max(value) AS m FROM p GROUP BY user_id, x) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY m DESC, x) <= 2), q AS (SELECT p.* FROM p SEMI JOIN b USING (user_id, x)),
c AS (SELECT user_id, y FROM (SELECT user_id, y, max(value) AS m FROM q GROUP BY user_id, y) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY m DESC, y) <= 2) SELECT user_id, event_id, value FROM q SEMI JOIN c USING (user_id, y)
""")
def r10_hierarchical_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return retrieval.hierarchical(frames, "user_id", "event_id", "value", [4, 16], 2)


@query("""
WITH s AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), b AS (SELECT user_id, n FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, n) <= 2)
SELECT DISTINCT s.user_id, s.event_id FROM s JOIN b ON s.user_id = b.user_id AND abs(s.n - b.n) <= 1
""")
def r11_scene_zoom(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "value").withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    best = ranking.capped(rows, ["user_id"], [F.col("value").desc(), F.col("n")], 2)
    return joins.neighbours(best, rows, ["user_id"], "n", 1).select("user_id", "event_id")


@query("SELECT label, i - 1 AS place, round(avg(v[i]), 6) AS mean FROM " + _V + ", range(1, 65) r(i) GROUP BY ALL")
def a34_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("place", "x"))
    return rows.groupBy("label", F.col("place").cast("long").alias("place")).agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


@query("""
WITH RECURSIVE o AS (SELECT label, vec_id * 5.0::DOUBLE AS s, vec_id * 5.0::DOUBLE + 4 AS e, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM embeddings),
r AS (SELECT label, i, 0::BIGINT AS chunk, s AS first, s, e, v AS total FROM o WHERE i = 1 UNION ALL
 SELECT label, i, CASE WHEN cut THEN chunk + 1 ELSE chunk END, CASE WHEN cut THEN s ELSE first END, s, e, CASE WHEN cut THEN v ELSE list_transform(range(1, 65), lambda j: total[j] + v[j]) END FROM (
  SELECT o.label, o.i, r.chunk, r.first, o.s, o.e, o.v, r.total, list_dot_product(r.total, o.v) / (sqrt(list_dot_product(r.total, r.total)) * sqrt(list_dot_product(o.v, o.v))) < 0.3 OR o.e - r.first > 600 AS cut FROM r JOIN o ON o.label = r.label AND o.i = r.i + 1))
SELECT label, chunk, min(s) AS start, max(e) AS "end", count(*) AS n FROM r GROUP BY label, chunk
""")
def w12_semantic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("label", (F.col("vec_id") * 5.0).alias("start"), (F.col("vec_id") * 5.0 + 4).alias("end"), "embedding")
    return ranking.semantic_chunks(e, "label", "start", "end", "embedding", 0.3, 600.0)


_WORDS_OF = "array_to_string(list_filter(string_split_regex(regexp_replace(lower({t}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+'), lambda w: w <> ''), ' ')"


@query(f"SELECT item_id, length(said)::VARCHAR AS length, contains({_WORDS_OF.format(t='said')}, {_WORDS_OF.format(t='truth')}) AS verdict FROM (SELECT item_id, text AS truth, CASE WHEN item_id % 2 = 0 THEN 'It says: ' || text || ' So it is.' ELSE 'Nothing that I saw.' END AS said FROM benchmark)")
def ud1_ud5_plugged_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("It says: "), "text", F.lit(" So it is."))).otherwise("Nothing that I saw.")
    rows = table(spark, sf_dir, "benchmark").withColumns({"truth": F.col("text"), "said": said})
    out = plugins.predict(rows, lambda part: part["said"].str.len().astype(str), "length")
    return out.select("item_id", "length", plugins.get("judge", "overlap")(F.lit(""), F.col("truth"), F.col("said")).alias("verdict"))


_FRAMES = "(SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS a, count(*) OVER (PARTITION BY user_id) AS n FROM events)"


def _frames(spark: SparkSession, sf_dir: str) -> selection.Frames:
    return selection.Frames(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value")


def _even(rows: str, k: int, by: str = "user_id") -> str:
    """The rows at ``k`` even steps of each group, as SQL."""
    placed = f"SELECT * EXCLUDE (a, n), row_number() OVER (PARTITION BY {by} ORDER BY event_id) - 1 AS a, count(*) OVER (PARTITION BY {by}) AS n FROM ({rows})"
    return f"SELECT * FROM ({placed}) WHERE n <= {k} OR list_contains(list_transform(range({k}), lambda i: round_even(i * (n - 1) / {k - 1}.0::DOUBLE, 0)), a)"


def _best(rows: str, q: int, by: str = "user_id") -> str:
    return f"SELECT * FROM ({rows}) QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY value DESC, event_id) <= {q}"


_SCENES = f"(SELECT *, least(15, a // greatest(1, n // 16)) AS scene FROM {_FRAMES})"
_TURNS = f"""SELECT * EXCLUDE (r, z, l), CASE WHEN l >= 12 AND n - l * z < z // 2 THEN least(r, l - 1) ELSE r END AS turn FROM (SELECT *, a // z AS r, ceil(n / z::DOUBLE)::BIGINT - 1 AS l FROM (SELECT *, greatest(1, n // 12) AS z FROM {_FRAMES}))"""
_MODES = {
    "clip": _best(_even(f"FROM {_FRAMES}", 512), 3),
    "scene_zoom": f"SELECT s.* FROM {_SCENES} s SEMI JOIN (SELECT user_id, scene FROM (SELECT user_id, scene, max(value) AS m FROM {_SCENES} GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY m DESC, scene) <= 3) t USING (user_id, scene)",
    "time_router": f"SELECT s.* FROM {_SCENES} s SEMI JOIN (SELECT c.user_id, c.scene FROM {_SCENES} c JOIN ({_best(f'FROM {_FRAMES}', 3)}) b ON c.user_id = b.user_id AND abs(c.a - b.a) <= 2) t USING (user_id, scene)",
    "vlm_prune": _best(_even(f"FROM {_FRAMES}", 64), 3),
    "vlm": _best(_even(_TURNS, 16, "user_id, turn"), 3, "user_id, turn"),
    "none": f"FROM {_FRAMES}",
}


@query(" UNION ALL ".join(f"SELECT '{m}' AS mode, user_id, event_id FROM ({sql})" for m, sql in _MODES.items()))
def ud4_selection_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _frames(spark, sf_dir)
    parts = [selection.select(m, frames, 3).select(F.lit(m).alias("mode"), "user_id", "event_id") for m in _MODES]
    return reduce(DataFrame.unionByName, parts)


def _context(selected: str, k: int, u: int) -> str:
    """At most k - u even ones of the selected, and u even ones of all."""
    return f"SELECT user_id, event_id FROM ({_even(selected, k - u)}) UNION SELECT user_id, event_id FROM ({_even(f'FROM {_FRAMES}', u)})"


@query(_context(_best(_even(f"FROM {_FRAMES}", 24), 9), 12, 4))
def r10_single_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _frames(spark, sf_dir)
    return selection.context(selection.single_step(frames, 24, 9), frames, 12, 4)


@query(_context(f"SELECT * EXCLUDE (part) FROM ({_best(_even(f'SELECT *, least(3, a // greatest(1, n // 4)) AS part FROM {_FRAMES}', 8, 'user_id, part'), 4, 'user_id, part')})", 12, 4))
def r10_dynamic_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _frames(spark, sf_dir)
    return selection.context(selection.dynamic_segment(frames, 4, 8, 4), frames, 12, 4)


_FIX = f"s0 AS ({_best(_even(f'FROM {_FRAMES}', 24), 3)})" + "".join(
    f", s{i} AS ({_best(_even(f'SELECT f.* FROM {_FRAMES} f SEMI JOIN (SELECT g.user_id, g.a FROM {_FRAMES} g JOIN s{i - 1} USING (user_id, event_id)) c ON f.user_id = c.user_id AND abs(f.a - c.a) <= 5', 24), 3)})" for i in range(1, 5)
)


@query(f"WITH {_FIX} {_context('FROM s4', 12, 4)}")
def r10_neighbourhoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _frames(spark, sf_dir)
    return selection.context(selection.neighbourhoods(frames, 24, 3, 5, 5), frames, 12, 4)


@query()
def r07_cell_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return retrieval.CellIndex(e, 16).nearest(e.where("vec_id % 50 = 0"), 5, probes=12).select("query", "vec_id", "place")


@query(f"""
WITH d AS (SELECT vec_id, b.text, v FROM {_V} JOIN benchmark b ON b.item_id = vec_id), s AS (SELECT vec_id, (len(list_intersect(['the', 'and', 'of', 'to'], list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)))) / 4.0::DOUBLE + {_cos('v', _Q)}) / 2 AS score FROM d)
SELECT vec_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, vec_id LIMIT 10
""")
def r02_semantic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id"), "text")
    rows = retrieval.hybrid(table(spark, sf_dir, "embeddings").join(items, "vec_id"), "The and of to", _QUERY, k=10, mode="semantic")
    return rows.select("vec_id", F.round("score", 6).alias("score"))


@query(f"""
WITH p AS (SELECT a.vec_id, a.v AS x, b.v AS y FROM {_V} a JOIN {_V} b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(list_avg(list_transform(range(1, 65), lambda i: abs(x[i] - y[i]))), 6) AS mad, list_sum(list_transform(range(1, 64), lambda i: ((x[i + 1] > x[i]) <> (y[i + 1] > y[i]))::INT))::INT AS dhash FROM p
""")
def ud2_ud3_named_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("after"))
    pair = (F.col("embedding"), F.col("after"))
    return e.join(after, "vec_id").select("vec_id", F.round(plugins.get("change", "mad")(*pair), 6).alias("mad"), plugins.get("change", "dhash")(*pair).alias("dhash"))
