"""The ten operators against brute force, on a table with nulls, blanks, ties, copies, long texts and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evalweave.llm import exact, langid, media, neardup, packing, pieces, quality, simple8b, substring, toxicity

LONG = 30_000


def _rows():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)] + ["it's", "é́t", "Ünder", "x,y.", "日本語", "12:30"]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, passage = prose(300), prose(70)
    near = base.split()
    near[10], near[200] = "changed", "words"
    rows = [
        (1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "one"), (6, "o n e"), (7, "two words"), (8, "Two  WORDS"), (9, "<|endoftext|> and <s>"), (10, "日本語 テキスト　 12 ñ\n\n  end "),
        (11, base), (12, base), (13, base.replace(" ", "\n")), (14, " ".join(near)), (15, prose(40) + " " + passage + " " + prose(30)), (16, passage), (17, prose(20) + " " + passage), (18, "loop " * 200), (19, "loop " * 260),
        (20, prose(LONG // 5)), (21, "x" * LONG), (22, "x" * LONG), (23, "\x00\x1c odd \x85 bytes ﻿"), (24, "12 34 56"),
    ]
    rows += [(100 + i, prose(rng.randint(1, 400))) for i in range(60)]
    return rows


ROWS = _rows()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else "fr", "src", len(t or ""), 7, "k", 0.5) for i, t in ROWS]
    # columns that operators use themselves
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n int, key string, score double").repartition(5)


@pytest.fixture(scope="module")
def nothing(spark, docs):
    return spark.createDataFrame([], docs.schema)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 3 and 1, int(i % 7 == 0)) for i, _ in ROWS], "doc_id long, quality int, toxic int")


def twice(docs):
    """Each row two times, and two rows without doc_id."""
    loose = docs.where("doc_id IN (4, 11)").withColumn("doc_id", F.lit(None).cast("long"))
    return docs.unionByName(docs).unionByName(loose)


def by_id(rows):
    return {r.doc_id: r for r in rows.collect()}


def test_exact(docs, nothing):
    got = by_id(exact.exact_duplicates(docs, first_width=4, factor=8))
    norm = {i: re.sub(r"[\x20\x09-\x0d]+", "", t or "") for i, t in ROWS}
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[norm[i]].append((-len(t or ""), i))
    assert len(got) == len(ROWS)
    for i, _ in ROWS:
        g = groups[norm[i]]
        keep = min(g)[1]
        assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (keep, len(g), keep == i, hashlib.sha256(norm[i].encode()).hexdigest())
    assert exact.exact_duplicates(nothing).count() == 0
    both = exact.exact_duplicates(twice(docs)).collect()
    assert len(both) == 2 * len(ROWS) + 2
    assert all(r.group_size == 1 and r.kept for r in both if r.doc_id is None)
    assert all(r.group_size == 2 * got[r.doc_id].group_size and r.keep_id == got[r.doc_id].keep_id for r in both if r.doc_id is not None)
    kept = exact.drop_copies(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i in got if got[i].kept}


def _near(words, percent):
    sets = {}
    for i, t in ROWS:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                label[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("words", "percent", "bands", "rows"), [(3, 85, 32, 6), (5, 80, 38, 5)])
def test_near(docs, words, percent, bands, rows):
    got = by_id(neardup.near_duplicates(docs, words, percent, bands, rows))
    want = _near(words, percent)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_near_edges(docs, nothing):
    assert neardup.near_duplicates(nothing).count() == 0
    rows = neardup.near_duplicates(twice(docs.where("doc_id < 20"))).collect()
    assert sum(r.doc_id is None for r in rows) == 2
    assert all(r.kept and r.component_id is None for r in rows if r.doc_id is None)
    want = _near(5, 80)
    assert all(r.component_id == want[r.doc_id][1] for r in rows if r.doc_id is not None)
    assert neardup.drop_near_copies(docs).columns == docs.columns


def test_near_links_across_stars(spark):
    """A chain whose ends are unlike still is one component, and unlike texts in one bucket stay apart."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(200)]
    rows, now = [], list(words)
    for i in range(25):
        rows.append((i, " ".join(now), "en", "s", 1))
        now[rng.randrange(200)] = f"n{i}"
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.component_id for r in neardup.near_duplicates(docs, 3, 85, 32, 6).collect()} == {0}


def test_components_joined_by_further_links(spark):
    from evalweave.llm.components import connected_components, joined

    rng = random.Random(11)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    frame = lambda e: spark.createDataFrame(e, "a long, b long")
    labels, _ = connected_components(frame(edges[:100]))
    for part in (edges[100:101], edges[101:200], [], edges[200:]):
        labels, _ = joined(labels, frame(part))
    want, _ = connected_components(frame(edges))
    assert sorted(map(tuple, labels.collect())) == sorted(map(tuple, want.collect()))


def test_odd_sketch_bound():
    rng = np.random.default_rng(4)
    limit = lambda n: eval(neardup.odd_limit(repr(n), 0.85), {"exp": np.exp, "sqrt": np.sqrt, "power": pow, "least": min, "greatest": max})  # noqa: E731, S307
    for n in (20, 300, 5000):
        for _ in range(60):
            x = rng.integers(1, 2**63, n, dtype=np.uint64)
            same = int(np.ceil(0.85 * n))
            cut = same + int(rng.integers(0, n - same + 1))
            a, b = np.unique(x[:cut]), np.unique(np.concatenate([x[:same], x[cut:]]))
            odd = int(np.bitwise_count(neardup.odd_sketch(a) ^ neardup.odd_sketch(b)).sum())
            assert odd <= limit(float(len(a) + len(b)))
        far = np.unique(rng.integers(1, 2**63, n, dtype=np.uint64))
        if n > 20:
            assert int(np.bitwise_count(neardup.odd_sketch(a) ^ neardup.odd_sketch(far)).sum()) > limit(float(len(a) + len(far)))


def _substring(window):
    first, out = {}, {}
    for i, t in ROWS:
        w = (t or "").encode().split()
        for p in range(len(w) - window + 1):
            first.setdefault(tuple(w[p : p + window]), i)
    for i, t in ROWS:
        w = (t or "").encode().split()
        keep = [True] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < i:
                keep[p : p + window] = [False] * window
        out[i] = (len(w), len(w) - sum(keep), hashlib.sha256(b" ".join(x for x, k in zip(w, keep, strict=True) if k)).hexdigest())
    return out


@pytest.mark.parametrize("batches", [1, 3])
def test_substring(docs, batches):
    got = by_id(substring.substring_digests(docs, 50, batches))
    assert {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in got.items()} == _substring(50)


def test_log_is_reopened_and_compacted(spark, docs, tmp_path):
    """Batch after batch against a log that lies on disk; each time it is opened anew, at another number of partitions."""
    log, found, before = str(tmp_path / "log"), {}, spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for i, (low, high) in enumerate(((0, 11), (11, 16), (16, 40), (40, 1000))):
            spark.conf.set("spark.sql.shuffle.partitions", 4 + i % 2)
            new = docs.where((F.col("doc_id") > low) & (F.col("doc_id") <= high))
            rows = substring.substring_digests(new, 50, 1, 1, log=log, history=docs.where(F.col("doc_id") <= low)).collect()
            found |= {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows}
            assert len([p for p in (tmp_path / "log").iterdir() if p.name.startswith("run_")]) == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found == _substring(50)
    assert len(list((tmp_path / "log").glob("manifest-*"))) == 1
    with pytest.raises(ValueError, match="isn't above"):
        substring.substring_digests(docs, log=log)


def test_runs_are_merged_where_they_lie(spark, docs, tmp_path):
    log = str(tmp_path / "log")
    for low, high in ((0, 15), (15, 1000)):
        substring.substring_digests(docs.where((F.col("doc_id") > low) & (F.col("doc_id") <= high)), 50, 1, 4, log=log, history=docs.where(F.col("doc_id") <= low)).count()
    index = substring.FingerprintIndex(spark, log)
    one, two = index.state["runs"]
    for kind, (_, key) in substring._TABLES.items():
        got = index.merged(one, two, kind)
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        both = [r for run in (one, two) for r in spark.read.parquet(f"{log}/{run}/{kind}").collect()]
        want = {}
        for r in both:
            want.setdefault(tuple(r[k] for k in key), []).append(r)
        rows = got.collect()
        assert len(rows) == len(want) < len(both)
        for r in rows:
            of = want[tuple(r[k] for k in key)]
            if kind == "contexts":
                assert (r.doc_id, r.last) == (min(x.doc_id for x in of), max(x["last"] for x in of))
                assert r["at"] == min(of, key=lambda x: x.doc_id)["at"]
            else:
                assert tuple(r)[1:] == tuple((min if c in ("a1", "a2", "lo") else max)(x[c] for x in of) for c in ("a1", "z1", "a2", "z2", "lo", "hi"))
    index.compact()
    assert len(index.state["runs"]) == 1
    index.close()


def test_substring_edges(docs, nothing):
    assert substring.substring_digests(nothing).count() == 0
    loose = docs.where("doc_id = 12").withColumn("doc_id", F.lit(None).cast("long"))
    rows = substring.substring_digests(docs.unionByName(loose)).collect()
    assert [r.n_removed for r in rows if r.doc_id is None] == [0]
    assert {r.doc_id: r.n_removed for r in rows if r.doc_id is not None} == {i: n for i, (_, n, _) in _substring(50).items()}
    cut = substring.drop_passages(docs)
    assert cut.columns == docs.columns
    new = by_id(cut)
    assert len(new) == len(ROWS)
    for i, t in ROWS:
        n, removed, sha = _substring(50)[i]
        assert new[i].text == t if not removed else hashlib.sha256(new[i].text.encode()).hexdigest() == sha
        assert not removed or new[i].n_chars == len(new[i].text)


def _ids(name, end):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    return {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, end], "<u4") for i, t in ROWS}


def test_simple8b_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 239, 240, 241, 1024, 1025, 5000):
        for high in (1, 2, 9, 50_000, 2**21, 2**60, 2**64 - 1):
            ids = rng.integers(0, high, n, dtype=np.uint64, endpoint=True)
            ids[rng.random(n) < 0.4] = 0
            words, sizes, at, escaped = simple8b.encode(ids)
            assert (simple8b.decode(words, sizes, n, at, escaped) == ids).all()
            assert len(sizes) == -(-n // simple8b.BLOCK)


def test_token_file(spark, docs, nothing):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got, files = simple8b.token_file(docs, path)
    got, want, at = by_id(got), _ids("byte_bpe_50k.json", 0), 0
    assert len(got) == len(ROWS)
    for i in sorted(want):
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(want[i]), zlib.crc32(want[i].tobytes()))
        at += len(want[i])
    back = {r.doc_id: np.frombuffer(r.ids, "<u8") for r in simple8b.read_ids(spark, files).collect()}
    assert all((back[i] == want[i]).all() for i in want)
    assert simple8b.token_file(nothing, path)[0].count() == 0
    rows = simple8b.token_file(twice(docs), path)[0].collect()
    assert len(rows) == 2 * len(ROWS) + 2
    assert sorted(r.start for r in rows) == list(np.cumsum([0, *(r.n_tokens for r in sorted(rows, key=lambda r: r.start))])[:-1])


@pytest.mark.parametrize("size", [64, 4096])
def test_packing(docs, size):
    want = _ids("word_bpe_49k.json", 2)
    rows = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), size).collect()
    of, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        of[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(of) == set(want)
    for i, parts in of.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at
            assert r.ids_crc32 == zlib.crc32(want[i][at : at + r.length].tobytes())
            assert r.doc_tokens == len(want[i])
            at += r.length
        assert at == len(want[i])
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == size or at & (at - 1) == 0  # no padding at all


def test_packing_edges(spark, docs, nothing):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert packing.pack(nothing, path).count() == 0
    rows = packing.pack(twice(docs), path).collect()
    assert sum(r.length for r in rows) == 2 * sum(map(len, _ids("word_bpe_49k.json", 2).values())) + sum(r.doc_tokens for r in rows if r.doc_id is None and r.start == 0)
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    some = docs.where("doc_id IN (4, 7, 11)")
    placed = packing.pack(some, path)
    ids = packing.sequences(placed, some, path).collect()
    assert sorted(x for r in ids for x in r.ids) == sorted(x for i in (4, 7, 11) for x in _ids("word_bpe_49k.json", 2)[i].tolist())


def test_planner_fills_closest():
    total, used = packing.closest_fill({3: 2, 5: 1, 7: 9}, [3, 5, 7], 16)
    assert total == 15
    assert sum(k * v for k, v in used.items()) == 15
    assert packing.closest_fill({3: 2}, [3], 2) == (0, {})
    assert packing.closest_fill({2: 5, 9: 1}, [2, 9], 11) == (11, {9: 1, 2: 1})


def test_pieces(docs, nothing):
    path = public_tokenizers.path("piece_bpe_32k.model")
    import sentencepiece

    reference = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = by_id(pieces.digests(docs, path))
    for i, t in ROWS:
        ids = np.array(reference.encode(t or ""), "<u4")
        assert (rows[i].n_tokens, rows[i].ids_crc32, rows[i].parity, rows[i].units_round_trip) == (len(ids), zlib.crc32(ids.tobytes()), True, True)
    encoded = pieces.encode(docs, path)
    back = by_id(pieces.decode(encoded, path))
    assert all(back[i].text == (t or "") for i, t in ROWS)
    assert pieces.digests(nothing, path).count() == 0


def test_unigram_models_too():
    """The library's unigram core is built from scores; a model with three words picks the likelier split."""
    model = pieces.PieceModel([("<unk>", 0.0, 2), ("▁a", -1.0, 1), ("b", -1.0, 1), ("▁ab", -1.5, 1)], pieces.UNIGRAM, False, b"", True, False, True)
    tokenizer = pieces.build(model)
    assert tokenizer.encode("ab a").ids == [3, 1]
    assert tokenizer.decode([3, 1], skip_special_tokens=False) == "ab a"


def test_language(spark, docs, nothing):
    rng = random.Random(1)
    kinds = {"aa": "abcde", "bb": "defgh", "cc": "абвгд"}
    rows = [(i, " ".join("".join(rng.choice(kinds[k]) for _ in range(5)) for _ in range(30)), k, "s", 1) for i, k in enumerate(list(kinds) * 40)]
    made = spark.createDataFrame([*rows, (1000, None, "aa", "s", 1), (1001, "12 !?", "bb", "s", 1), (1002, "", None, "s", 0), (1003, "ABCDE eabcd", None, "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    got = by_id(langid.identify(made))
    assert all(got[i].lang_pred == k for i, _, k, *_ in rows)
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "aa"]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert langid.identify(nothing).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(twice(docs)).count() == 2 * len(ROWS) + 2


def test_ranks_and_distances():
    codes, counts = langid.gram_counts("Ab b!")
    by = dict(zip(codes.tolist(), counts.tolist(), strict=True))
    a, b, s = ord("a"), ord("b"), 1
    assert by == {a: 1, b: 2, s << 21 | a: 1, a << 21 | b: 1, b << 21 | s: 2, s << 21 | b: 1, s << 42 | a << 21 | b: 1, a << 42 | b << 21 | s: 1, s << 42 | b << 21 | s: 1}
    assert langid.ranked(codes, counts, 2).tolist() == [b, b << 21 | s]


def _segments(scores, gap):
    """Ruzzo and Tompa by recursion: the best segment, then the same on either side."""
    if not scores:
        return []
    best, at = 0.0, None
    for i in range(len(scores)):
        for j in range(i, len(scores)):
            s = sum(scores[i : j + 1])
            if s > best + 1e-12:
                best, at = s, (i, j)
    if at is None:
        return []
    i, j = at
    return [*_segments(scores[:i], gap), (i, j, best), *((a + j + 1, b + j + 1, s) for a, b, s in _segments(scores[j + 1 :], gap))]


def test_segments_match_recursion():
    rng = random.Random(2)
    for _ in range(200):
        scores = [rng.choice([-1.5, -1.0, -0.25, -0.25, -0.25, 0.7, 2.3]) for _ in range(rng.randint(1, 25))]
        known = [(i, s) for i, s in enumerate(scores) if s != -0.25]
        got = toxicity.segments(np.array([i for i, _ in known]), np.array([s for _, s in known]), 0.25)
        assert [(a, b, round(s, 6)) for a, b, s in got] == [(a, b, round(s, 6)) for a, b, s in _segments(scores, 0.25)]


def test_segments_take_linear_time():
    """Sums that fall, rise, or fall and rise: each word is looked at a few times, however many candidates there are."""
    import time

    took = []
    for n in (20_000, 200_000):
        start = time.process_time()
        for scores in ([1.0, -1.5] * n, [1.0, -0.5] * n, [1.0, -1.5] * n + [1.0, -0.5] * n):
            toxicity.segments(np.arange(len(scores)), np.array(scores), 0.1)
        took.append(time.process_time() - start)
    assert took[1] < 40 * took[0]


def test_toxicity(spark, docs, nothing, labels):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijk") for _ in range(5)) for _ in range(200)]
    rows, marks = [], []
    for i in range(800):
        text = [rng.choice(words) for _ in range(60)]
        if i % 5 == 0:
            for _ in range(5):
                text[rng.randrange(60)] = rng.choice(["insultus", "insultor", "vileness"])
        rows.append((i, " ".join(text), "en", "s", 1))
        marks.append((i, 1, int(i % 5 == 0)))
    made = spark.createDataFrame([*rows, (9000, None, "en", "s", 0), (9001, "", "en", "s", 0), (9002, "..", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    marked = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    found = by_id(toxicity.score_documents(made, marked))
    held = [i for i in range(800) if found[i].held_out]
    assert len(held) > 100
    assert all(found[i].predicted == int(i % 5 == 0) for i in held)
    assert all(found[i].predicted == 0 and found[i].score == found[9000].score for i in (9000, 9001, 9002))
    assert all(found[i].passages for i in held if i % 5 == 0)
    clean = toxicity.drop_toxic(made, marked)
    assert clean.columns == made.columns
    assert {r.doc_id for r in clean.collect()} == {i for i, r in found.items() if not r.predicted}
    assert toxicity.score_documents(nothing, labels).count() == 0
    assert {r.predicted for r in toxicity.score_documents(docs, labels.withColumn("toxic", F.lit(0))).collect()} == {0}
    assert toxicity.score_documents(twice(docs), labels.unionByName(labels)).count() == 2 * len(ROWS) + 2


def test_quality(spark, docs, nothing, labels):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghijk") for _ in range(5)) for _ in range(300)]
    rows, marks = [], []
    for i in range(800):
        text = [rng.choice(words) for _ in range(rng.randint(20, 90))]
        if i % 4 == 0:
            text = [w.upper() + "!!" for w in text] if i % 8 else [w + " | " for w in text]
        rows.append((i, " ".join(text), "en", "s", 1))
        marks.append((i, int(i % 4 != 0), 0))
    made = spark.createDataFrame([*rows, (9000, None, "en", "s", 0), (9001, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    found = by_id(quality.score_documents(made, spark.createDataFrame(marks, "doc_id long, quality int, toxic int")))
    held = [i for i in range(800) if found[i].held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items())
    assert np.mean([found[i].predicted == int(i % 4 != 0) for i in held]) > 0.98
    assert found[9000].score == found[9001].score
    assert quality.score_documents(nothing, labels).count() == 0
    assert {r.predicted for r in quality.score_documents(docs, labels.withColumn("quality", F.lit(1))).collect()} == {1}
    assert quality.score_documents(twice(docs), labels).count() == 2 * len(ROWS) + 2


def test_rules_compile_to_columns(spark):
    rng = np.random.default_rng(1)
    x = rng.random((600, len(quality.STATISTICS)))
    y = ((x[:, 2] > 0.5) & (x[:, 5] <= 0.4)).astype(float)
    model = quality.learn(x, y)
    assert 0 < len(model.rules) < 200
    rows = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{s} double" for s in quality.STATISTICS))
    got = np.array([r.score for r in rows.select(model.column().alias("score")).collect()])
    direct = 1 / (1 + np.exp(-(model.intercept + sum(w * r.holds(x) for r, w in zip(model.rules, model.weights, strict=True)))))
    assert np.allclose(got, direct)
    assert ((got > 0.5) == (y > 0.5)).mean() > 0.97


def test_media(docs, nothing):
    got = by_id(media.text_media(docs)[0])
    for i, t in ROWS:
        raw = (t or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0")
        stored = b"P5\n64 %d\n255\n" % (len(payload) // 64) + payload
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert got[4].feature == got[5].feature != got[11].feature
    assert media.text_media(nothing)[0].count() == 0
    assert media.text_media(twice(docs))[0].count() == 2 * len(ROWS) + 2


def test_formats_and_resizing(spark):
    import io

    rng = np.random.default_rng(5)
    grey, rgb = rng.integers(0, 256, (13, 21), dtype=np.uint8), rng.integers(0, 256, (7, 5, 3), dtype=np.uint8)
    for image, write in ((grey, media.encode_pgm), (rgb, media.encode_ppm), (grey, media.encode_bmp), (rgb, media.encode_bmp)):
        assert (media.decode(write(image)) == image).all()
    assert (media.decode(b"P1\n# note\n3 2\n1 0 1\n0 1 0") == [[0, 255, 0], [255, 0, 255]]).all()
    assert (media.decode(b"P2 2 1 3 0 3") == [[0, 255]]).all()
    assert (media.decode(b"P3 1 1 255 1 2 3") == [[[1, 2, 3]]]).all()
    assert (media.decode(b"P4 3 1\n\xa0") == [[0, 255, 0]]).all()
    assert (media.decode(b"P5 2 1 65535\n\x00\x00\xff\xff") == [[0, 255]]).all()
    small = media.area_resize(grey[:12, :20], 3, 4)
    assert np.allclose(small, grey[:12, :20].reshape(3, 4, 4, 5).mean(axis=(1, 3)))
    assert np.isclose(media.area_resize(grey, 8, 9).mean(), grey.mean())
    assert (np.load(io.BytesIO(media.npy_tile(np.full((64, 64), 9)))) == 9).all()
    rows = spark.createDataFrame([(1, media.encode_bmp(grey)), (2, b"P5 9"), (3, None), (4, b"GIF")], "doc_id long, media binary")
    out = by_id(media.tiles(rows))
    assert (out[1].height, out[1].width, out[1].error) == (13, 21, None)
    assert all(out[i].tile is None and out[i].error for i in (2, 3, 4))
