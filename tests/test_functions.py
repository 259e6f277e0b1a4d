"""Hand-made cases and properties of the functions."""

import math
import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from evalweave.functions import arrays, semantics, stats, text, times, vectors
from evalweave.operators import dedup, filters, joins, metrics, ranking, retrieval
from evalweave.plans import plugins
from evalweave.sources import readers, writers
from evalweave.streaming import jobs


def one(spark, *columns):
    """The values of expressions without input."""
    row = spark.range(1).select(*columns).first()
    return row[0] if len(columns) == 1 else tuple(row)


@pytest.mark.parametrize(
    ("expected", "answer"),
    [
        (True, "I cannot see the video, so I am unable to determine the color of the slide."),
        (True, "The transcript does not mention any specific formula."),
        (True, "Without the video I can't tell what is on the screen."),
        (True, "Not enough information to answer this question."),
        (True, "The speaker doesn't say what the value is."),
        (True, "Based on the transcript alone, I cannot determine the specific element shown."),
        (False, "The slide shows BW = 0.35 / t_r as the rule-of-thumb."),
        (False, "Around 12:34 the speaker introduces the diagram and labels the three forces acting on the block."),
        (False, "It is a tunnel diode used as a fast trigger element."),
        (True, ""),
        (True, "The speaker doesn’t   say."),
    ],
)
def test_abstention(spark, expected, answer):
    assert one(spark, text.abstains(F.lit(answer))) is expected
    assert (one(spark, text.abstention(F.lit(answer))) is not None) is expected


def test_semantics(spark):
    s = F.lit("")
    assert one(spark, semantics.first_nonempty(s, F.lit(None).cast("string"), F.lit("x"))) == "x"
    assert one(spark, semantics.divide_or(F.lit(1), F.lit(0)), semantics.divide_or(F.lit(1), F.lit(0), 0.0), semantics.divide_or(F.lit(1), F.lit(4))) == (None, 0.0, 0.25)
    assert one(spark, *(semantics.half_even(F.lit(x)) for x in (0.5, 1.5, 2.5))) == (0.0, 2.0, 2.0)
    assert one(spark, semantics.truncated(F.lit(-1.7))) == -1
    assert one(spark, semantics.words(F.lit("  a  b\n"))) == ["a", "b"]
    assert one(spark, semantics.words(F.lit(" "))) == []
    v = F.array(*(F.lit(x) for x in (4, 1, 3, 2)))
    assert one(spark, semantics.upper_median(v), semantics.index_percentile(v, 50), semantics.index_percentile(v, 100)) == (3, 3, 4)


@pytest.mark.parametrize(("n", "k"), [(10, 5), (1, 3), (7, 7), (100, 8), (5, 1), (3, 9)])
def test_spread(spark, n, k):
    want = sorted(set(np.round(np.linspace(0, n - 1, k)).astype(int).tolist()))
    assert one(spark, semantics.spread(n, k)) == want
    assert one(spark, semantics.spread(n, k, "down")) == sorted(set(np.linspace(0, n - 1, k, dtype=int).tolist()))


def _lcs(a, b):
    rows = [[0] * (len(b) + 1)]
    for x in a:
        now = [0]
        for j, y in enumerate(b):
            now.append(rows[-1][j] + 1 if x == y else max(rows[-1][j + 1], now[j]))
        rows.append(now)
    return rows[-1][-1]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from("abc"), max_size=9), st.lists(st.sampled_from("abc"), max_size=9))
def test_lcs(spark, a, b):
    x, y = (F.array(*map(F.lit, v)).cast("array<string>") for v in (a, b))
    assert one(spark, text.lcs_length(x, y)) == _lcs(a, b)


def test_rouge_and_bleu(spark):
    assert one(spark, text.rouge_l(F.lit("the cat sat"), F.lit("the cat sat"))) == 1.0
    assert one(spark, text.rouge_l(F.lit(""), F.lit("x"))) == 0.0
    assert one(spark, text.rouge_l(F.lit("a b c d"), F.lit("a c"))) == pytest.approx(2 * 0.5 * 1 / 1.5)
    assert one(spark, text.bleu(F.lit("a b c d e"), F.lit("a b c d e"))) == pytest.approx(1.0)
    assert one(spark, text.bleu(F.lit("x y"), F.lit("a b"))) == 0.0
    assert one(spark, text.rouge_n(F.lit("a b c"), F.lit("a b d"), 2)) == pytest.approx(0.5)


def test_sequence_ratio_is_difflib(spark):
    rng = random.Random(0)
    pairs = [("".join(rng.choice("abc ") for _ in range(rng.randint(0, 30))), "".join(rng.choice("abc ") for _ in range(rng.randint(0, 30)))) for _ in range(40)]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", text.sequence_ratio("a", "b").alias("r")).collect()
    assert all(r.r == SequenceMatcher(None, r.a, r.b).ratio() for r in rows)


def test_letters(spark):
    choices = F.array(*map(F.lit, ["3", "red car", "car", "33"]))
    cases = {"ANSWER: A no, ANSWER: (c)": "C", "B it is": "B", "so (D).": "D", "the option is e": "E", "it shows the red car": "B", "in 1633 or so": "", "": "", "look At": "A"}
    for told, want in cases.items():
        assert one(spark, text.committed_letter(F.lit(told), choices)) == want, told
    assert one(spark, text.final_letter(F.lit("first (B), Final Answer: c"))) == "C"
    assert one(spark, text.answer_letter(F.lit(" "))) == ""


def test_entities(spark):
    ref, pred = F.lit("Red car, 1,200 yen at 12:30"), F.lit("a red car for 1200 yen")
    assert set(one(spark, text.key_entities(ref))) >= {"1,200 yen", "1,200", "12:30", "red", "Red"}
    assert one(spark, text.numbers_match(ref, pred)) is False
    assert one(spark, text.colours_match(ref, pred)) is True
    assert one(spark, text.details_match(F.lit("nothing"), pred)) is None
    assert one(spark, text.entity_recall(F.lit("nothing"), pred)) is None
    assert one(spark, text.entity_matches(F.lit("1,200"), F.array(F.lit("1200.0")))) is True
    assert one(spark, text.structural_similarity(ref, ref)) == 1.0
    assert one(spark, text.plain_number(F.lit("1.2500")), text.plain_number(F.lit("-3.0")), text.plain_number(F.lit("N/A"))) == ("1.25", "-3", "n/a")


def test_text_odds(spark):
    assert one(spark, text.without_block(F.lit("a[T]x[/T]b[T]y[/T]"), "[T]", "[/T]")) == "ab[T]y[/T]"
    assert one(spark, text.sentence_cut(F.lit("One two three. Four five six"), 5)) == "One two three."
    assert one(spark, text.filled("{a}-{b}!", a=F.lit(1), b=F.lit(None))) == "1-!"
    assert one(spark, text.uuid5(F.lit("python.org"), "6ba7b810-9dad-11d1-80b4-00c04fd430c8")) == "886313e1-3b8a-5372-9b90-0c9aee199e5d"
    assert one(spark, text.keys_covered(F.lit("Alice met Bob in 1999"), F.lit("In 1999 Bob and Alice"))) is True
    assert one(spark, text.keys_covered(F.lit("Alice met Bob"), F.lit("Alice met Bob"))) is False
    asked, listed = text.options(F.lit("What? (A) one (B) two"))
    assert one(spark, asked, listed) == ("What?", ["one", "two", "", ""])
    assert one(spark, text.file_name(F.lit(" My - Title: 1! "))) == "my_title_1"


segs = st.lists(st.tuples(st.integers(0, 40), st.integers(1, 12)), max_size=6)


def _segments(made):
    return F.array(*(times.segment(F.lit(float(s)), F.lit(float(s + n))) for s, n in made)).cast(times.SEGMENTS)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(segs, segs)
def test_iou(spark, a, b):
    x, y = ({p for s, n in v for p in range(s, s + n)} for v in (a, b))
    got, back = one(spark, times.iou(_segments(a), _segments(b)), times.iou(_segments(b), _segments(a)))
    assert got == pytest.approx(len(x & y) / len(x | y) if x | y else 0.0)
    assert got == pytest.approx(back)


def test_times(spark):
    assert one(spark, *(times.seconds(F.lit(x)) for x in ("01:02:03,5", "2:03", "7.25", "x:1"))) == (3723.5, 123.0, 7.25, None)
    assert one(spark, times.seconds(F.lit("bad"), 0.0)) == 0.0
    assert one(spark, *(times.clock(F.lit(3723.5), s) for s in ("hms", "srt"))) == ("01:02:03", "01:02:03,500")
    assert one(spark, times.sanitised(F.lit(90.0), F.lit(-5.0), F.lit(60.0)))["end"] == 60.0
    assert one(spark, times.sanitised(F.lit(70.0), F.lit(80.0), F.lit(60.0))) is None
    assert [tuple(x) for x in one(spark, times.split_long(_segments([(0, 12), (20, 3)]), 5.0))] == [(0, 5), (5, 10), (10, 12), (20, 23)]
    assert one(spark, times.gap_merged(F.array(*(F.lit(x) for x in (0.0, 1.0, 2.5, 3.0, 9.0))), 2.0)) == [0.0, 2.5, 9.0]
    assert [tuple(x) for x in one(spark, times.short_merged(_segments([(0, 10), (10, 50), (60, 40), (100, 5)]), 30.0))] == [(0, 60), (60, 100), (100, 105)]
    made = one(spark, times.shifted(_segments([(50, 10)]), F.lit(200.0), 30.0, far=True))
    assert all(0 <= s < e <= 200 and (e <= 50 or s >= 60) for s, e in made)
    assert (90.0, 100.0) in [tuple(x) for x in made]
    taken = one(spark, times.disjoint(_segments([(0, 5), (3, 5), (10, 2), (20, 1)]), _segments([(10, 1)]), 2))
    assert [tuple(x) for x in taken] == [(0, 5), (20, 21)]
    assert len(one(spark, times.clue_frames(_segments([(0, 10), (50, 1)]), 8))) >= 2


def test_stats(spark):
    b, c = F.lit(10), F.lit(25)
    assert one(spark, stats.chi_square(b, c)) == pytest.approx(14**2 / 35)
    assert one(spark, stats.z_value(b, c)) == pytest.approx(-15 / 35**0.5)
    assert one(spark, stats.exact_binomial(F.lit(1), F.lit(6))) == pytest.approx(0.21875)
    assert one(spark, stats.exact_binomial(F.lit(3), F.lit(6))) == 1.0
    assert one(spark, stats.exact_binomial(F.lit(0), F.lit(0))) == 1.0
    low, high = one(spark, stats.wilson(F.lit(8), F.lit(10)))
    assert (round(low, 4), round(high, 4)) == (0.4902, 0.9433)
    assert one(spark, stats.stars(F.lit(0.004))) == "**"
    args = [F.lit(x) for x in (-1.0, -3.0, -1.5, -2.0)]
    assert one(spark, stats.preference_loss(*args)) == pytest.approx(np.log1p(np.exp(-0.15)))
    assert one(spark, stats.preference_loss(*args, kind="hinge"), stats.preference_loss(*args, kind="ipo")) == pytest.approx((0.85, (1.5 - 5) ** 2))
    assert one(spark, stats.info_nce(F.lit(0.0), F.array(F.lit(0.0)), 1.0)) == pytest.approx(np.log(2))


def test_vectors(spark):
    a, b, z = (F.array(*(F.lit(float(x)) for x in v)) for v in ((3, 4), (4, 3), (0, 0)))
    assert one(spark, vectors.cosine(a, b), vectors.cosine(a, z), vectors.squared_l2(a, b)) == (pytest.approx(0.96), None, 2.0)
    assert one(spark, vectors.unit(a)) == [0.6, 0.8]
    assert one(spark, vectors.squared_l2(a, F.array(F.lit(1.0)))) is None
    assert one(spark, vectors.chi_square_distance(a, a), vectors.hamming(a, b)) == (0.0, 1)


def test_json(spark):
    cases = {'{"a": 1}': True, '```json\n{"a": 1}\n```': True, 'so {"a": 1} it is': True, "none": False, "{oops": False}
    for told, good in cases.items():
        assert (one(spark, arrays.json_object(F.lit(told))) is not None) is good
    allowed = F.array(*(F.lit(x) for x in (3, 1, 2)))
    assert one(spark, arrays.selected_ids(F.lit("broken"), allowed)) == [1, 2, 3]
    assert one(spark, arrays.selected_ids(F.lit('{"frame_ids": ["2", 9, 2]}'), allowed)) == [2]
    order = one(spark, arrays.permutation(F.lit(5), F.lit("seed")))
    assert sorted(order) == [0, 1, 2, 3, 4]
    assert [[x.start, x.end] for x in one(spark, arrays.paired_intervals(F.lit("1 to 2.5 and 7")))] == [[1.0, 2.5]]


def test_merging(spark):
    a = spark.createDataFrame([(1, "x", 0), (1, "y", 1), (2, "z", 0)], "k int, v string, o int")
    first = dedup.keep_one(a, [F.col("k")], [F.col("o")])
    assert {(r.k, r.v) for r in first.collect()} == {(1, "x"), (2, "z")}
    again = dedup.keep_one(dedup.union_all(first, first), [F.col("k")], [F.col("o")])
    assert again.exceptAll(first).count() == 0
    last = dedup.keep_one(a, [F.col("k")], [F.col("o").desc()])
    assert {(r.k, r.v) for r in last.collect()} == {(1, "y"), (2, "z")}
    loose = spark.createDataFrame([(None, None), (None, None), ("q", None)], "id string, question string")
    assert loose.select(dedup.identity(F.col("id"), F.col("question")).alias("i")).distinct().count() == 3
    assert dedup.completeness(a, a.where("o = 0"), "k", "v").where("complete").count() == 1


@pytest.mark.parametrize("closed", [False, True])
def test_range_join_is_theta_join(spark, closed):
    rng = random.Random(5)
    a = [(i % 3, i, s, s + rng.choice([0.0, 1.0, 7.5, 30.0])) for i, s in enumerate(float(rng.randint(0, 60)) for _ in range(60))]
    b = [(i % 3, i, s, s + rng.choice([0.0, 2.0, 12.0])) for i, s in enumerate(float(rng.randint(0, 60)) for _ in range(60))]
    x, y = spark.createDataFrame(a, "g int, i int, s double, e double"), spark.createDataFrame(b, "g int, j int, t double, f double")
    got = sorted((r.i, r.j) for r in joins.range_join(x, y, ["g"], ("s", "e"), ("t", "f"), 5.0, closed).collect())
    meet = (lambda s, e, t, f: s <= f and t <= e) if closed else (lambda s, e, t, f: s < f and t < e)
    assert got == sorted((i, j) for g, i, s, e in a for h, j, t, f in b if g == h and meet(s, e, t, f))


def test_donors(spark):
    rows = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(40)], "id long, g string")
    groups = {r.id: r.g for r in rows.collect()}
    for buckets in (1, 8, 4096):
        donors = joins.ring_donors(rows, "id", "g", buckets).collect()
        assert len(donors) == 40
        assert all(groups[r.donor] != groups[r.id] for r in donors)
    alone = joins.ring_donors(rows.where("g = 'a'"), "id", "g").collect()
    assert all(r.donor is None for r in alone)


def test_filters(spark):
    rows = spark.createDataFrame([(1, None), (2, 5), (3, 9)], "k int, v int")
    assert [r.k for r in rows.where(filters.condition({"v": {"ge": 5, "lt": 9}})).collect()] == [2]
    with pytest.raises(ValueError, match="unknown"):
        filters.condition({"v": {"like": 1}})
    counted = filters.funnel(rows, [("null", F.col("v").isNull()), ("big", F.col("v") > 4)])
    assert [r.drop_reason for r in counted.orderBy("k").collect()] == ["null", "big", "big"]
    total = filters.funnel_counts(counted, "k", ["null", "big"]).agg(F.sum("total"), F.sum("kept") + F.sum("null") + F.sum("big")).first()
    assert total[0] == total[1]


def test_metrics(spark):
    rows = spark.createDataFrame([("a", True), ("a", None), ("b", False), ("c", None)], "m string, verdict boolean")
    board = metrics.leaderboard(rows, "m").orderBy("rank").collect()
    assert [(r.m, r.acc, r["rank"]) for r in board] == [("a", 100.0, 1), ("b", 0.0, 2), ("c", None, 3)]
    values = spark.createDataFrame([(float(x),) for x in (1, 2, 2, 3, 10)], "v double")
    assert metrics.index_percentiles(values, [], "v", [10, 50, 100]).first()[:] == (1.0, 2.0, 10.0)
    assert sum(r.n for r in metrics.histogram(values, "v", 3).collect()) == 5
    assert sum(r.weight for r in metrics.balanced_weights(rows, "m").collect()) == pytest.approx(3)


def test_splits(spark):
    rows = spark.range(100).withColumn("g", F.col("id") % 4)
    order = [ranking.hash_order("id")]
    parts = {r.split: r["count"] for r in ranking.split_counts(rows, "g", order, 3, 10).groupBy("split").count().collect()}
    assert parts == {"test": 12, "train": 40, "val": 48}
    assert ranking.split_fraction(rows, "id", 0.07).where("split = 'val'").count() == 7
    assert ranking.split_fraction(rows.limit(3), "id", 0.07).where("split = 'val'").count() == 1
    picked = ranking.exact_fraction(rows, "g", order, 0.3).where("picked").groupBy("g").count().collect()
    assert {r["count"] for r in picked} == {8}  # round(7.5) is 8
    dealt = ranking.block_interleaved(rows, "g", order, 10).collect()
    assert len(dealt) == 80
    assert all(len({r.g for r in dealt if r.block == b}) == 1 for b in range(8))
    assert list(ranking.quota_stream(iter([("a", 1), ("b", 2), ("a", 3), ("b", 4), ("c", 5)]), {"a": 1, "b": 2})) == [("a", 1), ("b", 2), ("b", 4)]


def test_numbered(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), "id")
    assert all(r.place == r.k for r in ranking.numbered(rows, ["k"], "place", 7).collect())
    assert ranking.numbered(rows.limit(0), ["k"], "place").count() == 0


@pytest.mark.parametrize("parts", [8, 64])
def test_numbered_beyond_the_range_sample(spark, parts):
    """Range bounds are drawn from a sample: on many rows each evaluation would draw others."""
    n = 3_000_000 if parts == 64 else 300_000
    rows = spark.range(0, n, 1, 16).select((F.col("id") * 7919 % n).alias("k"))
    placed = ranking.numbered(rows, ["k"], "place", parts)
    for _ in range(2):
        assert placed.where("place <> k").count() == 0
    assert placed.select("place").distinct().count() == n


def test_numbered_by_group(spark):
    rows = spark.range(100_000).select(F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 == 7, None).otherwise((F.col("id") % 3).cast("string")).alias("g"), (F.col("id") * 7919 % 100_000).alias("k"))
    placed = ranking.numbered(rows, ["k"], "place", 16, by=["g"])
    want = F.row_number().over(Window.partitionBy("g").orderBy("k")) - 1
    assert placed.count() == 100_000
    assert placed.withColumn("want", want).where("place <> want").count() == 0


def test_folds_along_groups(spark):
    """Gap merging and short clusters against the array functions, with one hot group."""
    import random

    rng = random.Random(5)
    points = [("hot", rng.uniform(0, 5000)) for _ in range(3000)] + [(f"g{i % 7}", rng.uniform(0, 200)) for i in range(60)] + [("one", None)]
    rows = spark.createDataFrame(points, "g string, p double")
    got = sorted((r.g, r.kept) for r in ranking.gap_merged(rows, "g", "p", 2.5).collect())
    want = []
    for g in {g for g, _ in points}:
        last = None
        for p in sorted(x for k, x in points if k == g and x is not None):
            if last is None or p - last >= 2.5:
                want.append((g, p))
                last = p
    assert got == sorted(want)
    segs = [("hot", float(i * 50), i * 50 + rng.choice([5.0, 10.0, 40.0])) for i in range(500)] + [("few", 0.0, 1.0)]
    got = sorted((r.g, r.start, r.end) for r in ranking.short_merged(spark.createDataFrame(segs, "g string, s double, e double"), "g", "s", "e", 30.0).collect())
    want = []
    for g in ("hot", "few"):
        held = None
        for _, s, e in sorted(x for x in segs if x[0] == g):
            if held is not None:
                want.append((g, held[0], e))
                held = None
            elif e - s < 30:
                held = (s, e)
            else:
                want.append((g, s, e))
        if held:
            want.append((g, *held))
    assert got == sorted(want)


def test_islands_and_their_iou(spark):
    import random

    rng = random.Random(9)
    make = lambda n: [("u", s := rng.uniform(0, 300), s + rng.uniform(0, 20)) for _ in range(n)]
    a, b = make(40), make(30)
    frames = [spark.createDataFrame(x, "g string, start double, end double") for x in (a, b)]
    merged = one(spark, times.merged(F.array(*(times.segment(F.lit(s), F.lit(e)) for _, s, e in a))))
    assert sorted((r.start, r.end) for r in ranking.islands(frames[0], "g", "start", "end").collect()) == [(x.start, x.end) for x in merged]
    want = one(spark, times.iou(*(F.array(*(times.segment(F.lit(s), F.lit(e)) for _, s, e in x)) for x in (a, b))))
    assert ranking.set_iou(*frames, "g", 37.0).first().iou == pytest.approx(want)


def test_failed_keys_are_written_once(spark, tmp_path):
    spark.range(40).withColumn("v", F.col("id") * 2).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = lambda: jobs.read_changes(spark, str(tmp_path / "in"), "id long, v long")
    work = lambda rows: rows.select("id", "v", F.when(F.col("id") % 4 == 0, "bad").alias("error"))
    for i in range(3):
        jobs.resume(stream(), "id", str(tmp_path / "out"), str(tmp_path / f"mark{i}"), work, str(tmp_path / "failed"))
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "failed")).collect()) == list(range(0, 40, 4))
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [i for i in range(40) if i % 4]


def test_large_tables_as_markdown(spark):
    from evalweave.sources import writers

    rows = spark.range(3).select("id", F.when(F.col("id") > 0, "x").alias("s"))
    assert writers.markdown(rows.orderBy("id")).splitlines()[2:] == ["| 0 | — |", "| 1 | x |", "| 2 | x |"]
    assert sorted(r.line for r in writers.markdown_lines(rows).collect()) == ["| 0 | — |", "| 1 | x |", "| 2 | x |"]
    with pytest.raises(ValueError, match="over 2 rows"):
        writers.markdown(rows, most=2)


def test_chunks_match_a_loop(spark):
    rng = np.random.default_rng(2)
    made = [(g, float(i), float(i + 1), rng.normal(size=4).tolist()) for g in range(3) for i in range(40)] + [(0, 99.0, 100.0, None)]
    rows = spark.createDataFrame(made, "g int, s double, e double, v array<double>")
    want = []
    for g in range(3):
        held, first, last, n = [], 0.0, 0.0, 0
        for _, s, e, v in (r for r in made if r[0] == g and r[3]):
            if held:
                c = np.mean(held, axis=0)
                if c @ v / np.linalg.norm(c) / np.linalg.norm(v) < 0.1 or e - first > 9:
                    want.append((g, n, first, last, len(held)))
                    held, n = [], n + 1
            first = first if held else s
            held, last = [*held, v], e
        want.append((g, n, first, last, len(held)))
    assert sorted(tuple(r) for r in ranking.semantic_chunks(rows, "g", "s", "e", "v", 0.1, 9.0).collect()) == want


def test_search_modes(spark):
    docs = spark.createDataFrame([(i, i % 2, [float(i), 0.0]) for i in range(10)], "vec_id int, label int, embedding array<double>")
    rules = {"label": {"eq": 1}}
    assert [r.vec_id for r in retrieval.search(docs, [0.0, 0.0], 4, rules).orderBy("score").collect()] == [1, 3]
    assert [r.vec_id for r in retrieval.search(docs, [0.0, 0.0], 4, rules, mode="pre").orderBy("score").collect()] == [1, 3, 5, 7]


def test_files(spark, tmp_path):
    path = str(tmp_path / "one.json")
    (tmp_path / "one.json").write_text('  [{"a": 1}, {"a": 2}]')
    assert readers.json_any(spark, path).count() == 2
    (tmp_path / "lines.json").write_text('{"a": 1}\n\nbad\n{"a": 3}\n')
    assert sorted(r.a for r in readers.json_any(spark, str(tmp_path / "lines.json"), "a int").collect() if r.a is not None) == [1, 3]
    (tmp_path / "keyed.json").write_text('{"v1": [{"q": "x"}, {"q": "y"}], "v2": []}')
    assert [(r.video, r.place, r.q) for r in readers.keyed_document(spark, str(tmp_path / "keyed.json"), "struct<q:string>").collect()] == [("v1", 0, "x"), ("v1", 1, "y")]
    (tmp_path / "a.srt").write_text("1\n00:00:01,500 --> 00:00:02.000\nHello\nthere\n\n00:01:00,000 --> 00:01:01,000\nBye\n")
    assert [(r.start, r.end, r.text) for r in readers.subtitles(spark, str(tmp_path / "a.srt")).collect()] == [(1.5, 2.0, "Hello there"), (60.0, 61.0, "Bye")]
    target = str(tmp_path / "table")
    for n in (3, 5):
        writers.replace_atomically(spark.range(n), target)
    assert spark.read.parquet(target).count() == 5
    assert writers.markdown(spark.range(1).select("id", F.lit(None).alias("x"))) == "| id | x |\n|---|---|\n| 0 | — |"


def test_streams(spark, tmp_path):
    feed = str(tmp_path / "feed")
    spark.range(20).withColumn("c", F.col("id") % 2).repartition(2).write.parquet(feed)
    stream = jobs.read_changes(spark, feed, spark.read.parquet(feed).schema)
    out, bad = str(tmp_path / "out"), str(tmp_path / "bad")
    for run in range(2):
        jobs.resume(stream, "id", out, str(tmp_path / f"mark{run}"), lambda d: d.withColumn("error", F.when(F.col("id") == 3, "no")), bad)
    assert spark.read.parquet(out).count() == 19
    jobs.run_once(jobs.quota(stream, "c", "id", 4), str(tmp_path / "q"), str(tmp_path / "qm"))
    assert spark.read.parquet(str(tmp_path / "q")).groupBy("c").count().where("count = 4").count() == 2


def test_plugins(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, t string")

    def fails(part):
        raise RuntimeError("no model")

    assert {r.error for r in plugins.predict(rows, fails).collect()} == {"RuntimeError('no model')"}
    assert {r.prediction for r in plugins.predict(rows, lambda p: p["t"] * 2).collect()} == {"aa", "bb"}
    with pytest.raises(KeyError, match="no judge provider"):
        plugins.get("judge", "none")
    verdicts = rows.select(plugins.get("judge", "overlap")(F.lit("q"), F.col("t"), F.when(F.col("k") == 1, "a")).alias("v")).collect()
    assert {r.v for r in verdicts} == {True, None}


def test_pairs(spark):
    from evalweave.operators import pairs

    rows = spark.createDataFrame([(1, "It is a red car on the road", "It is a red car on the road"), (2, "a b c d e f", "I cannot see the video"), (3, "a b c d e f", "no"), (4, "one two three four five six", "one two three four five ten"), (5, "Alice met Bob in 1999 there", "In 1999 Bob and Alice had never been seen"), (6, "one two three four", "quite another answer to the question")], "k int, chosen string, rejected string")
    got = {r.k: r.drop_reason for r in pairs.screened(rows).collect()}
    assert got == {1: "same", 2: "abstains", 3: "short", 4: "alike", 5: "keys", 6: None}
    many = spark.range(200).select("id", (F.col("id") % 3).alias("axis"), F.lit(None).cast("double").alias("margin"))
    made = pairs.assembled(many.unionByName(many), "id", "axis", "margin", 1.0, 20, 0.1)
    assert made.count() == 60
    assert made.where("split = 'val'").count() == 6


def test_hybrid_modes(spark):
    docs = spark.createDataFrame([(1, "red car", [1.0, 0.0]), (2, "blue car", [0.0, 1.0]), (3, "", [0.0, 0.0])], "vec_id int, text string, embedding array<double>")
    order = lambda **k: [r.vec_id for r in retrieval.hybrid(docs, **k).collect()]
    assert order(words="blue car", mode="text") == [2, 1, 3]
    assert order(query=[1.0, 0.1], mode="vector")[0] == 1
    assert order(words="car", query=[0.0, 1.0], mode="semantic")[0] == 2
    with pytest.raises(ValueError, match="unknown mode"):
        retrieval.hybrid(docs, mode="other")


def test_cell_index_recall(spark):
    """Every row is indexed; recall against brute force is over 0.9, and 1 if all cells are looked into."""
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    asked = e.where("vec_id % 50 = 0")
    want = {(r.query, r.vec_id) for r in retrieval.nearest(e, asked, 5).collect()}
    index = retrieval.CellIndex(e, 16)
    assert index.rows.count() == e.count()
    got = {(r.query, r.vec_id) for r in index.nearest(asked, 5, probes=12).collect()}
    assert len(got & want) >= 0.9 * len(want)
    assert {(r.query, r.vec_id) for r in index.nearest(asked, 5, probes=16).collect()} == want


def test_nearest_in_lots(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    asked = e.where("vec_id % 50 = 0")
    rows = lambda most: sorted((r.query, r.vec_id, r.place) for r in retrieval.nearest(e, asked, 3, most=most).collect())
    assert rows(3) == rows(4096)


def test_unknown_selection_mode(spark):
    from evalweave.operators import selection

    with pytest.raises(ValueError, match="unknown selection mode"):
        selection.select("other", selection.Frames(spark.range(1), "id", "id", "id"), 1)


def test_stems():
    """Porter's own examples, step by step, and the exceptions."""
    from evalweave.functions.stemming import stem

    pairs = "caresses caress ponies poni ties tie cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi relational relat conditional condit rational ration valenci valenc digitizer digit conformabli conform radicalli radic vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope formaliti formal sensitiviti sensit triplicate triplic formative form formalize formal electriciti electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin adjustable adjust defensible defens irritant irrit replacement replac adoption adopt communism commun activate activ effective effect probate probat rate rate cease ceas controll control roll roll dying die news news skies sky is is".split()
    assert {a: stem(a) for a in pairs[::2]} == dict(zip(pairs[::2], pairs[1::2], strict=True))


def test_flow_of_a_shifted_image(spark):
    from evalweave.functions.vectors import flow_magnitude

    y, x = np.mgrid[0:48, 0:48]
    wave = lambda dx, dy: 100 + 50 * np.sin((x - dx) / 4) * np.cos((y - dy) / 5)
    assert flow_magnitude(wave(0, 0), wave(0, 0)) == 0
    for dx, dy in ((0.5, 0), (0, 0.4), (0.3, -0.4)):
        assert flow_magnitude(wave(0, 0), wave(dx, dy)) == pytest.approx(math.hypot(dx, dy), rel=0.15)
    flat = [float(v) for v in wave(0, 0).ravel()]
    near = [float(v) for v in wave(0.5, 0).ravel()]
    row = spark.createDataFrame([(flat, near, flat[:5])], "a array<double>, b array<double>, c array<double>").select(vectors.flow("a", "b"), vectors.flow("a", "c")).first()
    assert row[0] == pytest.approx(flow_magnitude(wave(0, 0), wave(0.5, 0)))
    assert row[1] is None


def test_workbooks(spark, tmp_path):
    import zipfile

    from evalweave.sources import sheets

    rows = spark.createDataFrame([(1, "a<b & c", 1.5, None), (2, "  two\nlines", -0.25, True), (3, "日本", None, False)], "n int, `odd name` string, x double, ok boolean")
    path = str(tmp_path / "r.xlsx")
    sheets.write_sheet(rows, path, "Näme & co")
    got = sorted(sheets.read_sheets(spark, path).collect())
    assert [tuple(r) for r in got] == [("1", "a<b & c", "1.5", None), ("2", "  two\nlines", "-0.25", "True"), ("3", "日本", None, "False")]
    with zipfile.ZipFile(path) as z:
        assert "<b/>" in z.read("xl/styles.xml").decode()
        assert 'state="frozen"' in z.read("xl/worksheets/sheet1.xml").decode()
    with pytest.raises(ValueError, match="for reports"):
        sheets.write_sheet(rows, path, most=2)
    assert [sheets.column_number(f"{sheets.column_name(i)}7") for i in (0, 25, 26, 701, 702)] == [0, 25, 26, 701, 702]
    # texts that another program keeps apart from the sheet
    main = sheets._MAIN
    with zipfile.ZipFile(tmp_path / "s.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>k</t></si><si><r><t>o</t></r><r><t>ne</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="C2"><v>7</v></c></row></sheetData></worksheet>')
    assert sheets.cells((tmp_path / "s.xlsx").read_bytes()) == [["k", None, "one"], [None, None, "7"]]
