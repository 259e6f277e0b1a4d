"""Queries without SQL do their job on every row and on whole texts, by brute force."""

import math
import re
from collections import Counter
from difflib import SequenceMatcher

import pytest

from evalweave.functions import text
from evalweave.plans import registry

SF = "/root/testdata/sf0.001"


def _digits(t):
    return [text.NUMBER_WORDS.get(w, w) for w in re.sub(r"[^\w\s]", " ", t.lower()).split()]


def _choice_score(told, choice):
    p, c = _digits(told), _digits(choice)
    content = set(c) - set(text.STOP_WORDS)
    recall = len(content & set(p)) / len(content) if content else len(set(c) & set(p)) / max(1, len(set(c)))
    p, c = " ".join(p), " ".join(c)
    return 3 * (c in p) + 2 * recall + 0.5 * SequenceMatcher(None, p, c).ratio()


def test_choice_scores_of_all_events(spark):
    told = ["I cannot see the video.", "The slide shows BW = 0.35", "Not enough information to answer", "The speaker doesn’t say what it is", "", "Around 12:34 the speaker labels 3 forces", "It is not possible to tell", "sorry, I don't have it"]
    choices = ["the slide shows BW", "three forces", "nothing at all"]
    events = [r.event_id for r in spark.read.parquet(f"{SF}/events.parquet").select("event_id").collect()]
    assert max(events) >= 400
    got = {(r.event_id, r.place): r.score for r in registry.queries()["f07_f08_choice_scores"](spark, SF).collect()}
    assert got == pytest.approx({(i, k): _choice_score(told[i % 8], c) for i in events for k, c in enumerate(choices)}, abs=1e-6)


def test_grounding_of_all_events(spark):
    entities = [{"12", "12:30", "3", "3 kg", "30", "Red", "red"}, {"1,200", "Paris"}, set()]
    events = [r.event_id for r in spark.read.parquet(f"{SF}/events.parquet").select("event_id").collect()]
    assert max(events) >= 300
    got = {r.event_id: r for r in registry.queries()["f20_f21_grounding"](spark, SF).collect()}
    assert set(got) == set(events)
    for i in events:
        a, b = i % 3, i // 3 % 3
        assert got[i].recall == (None if a == 2 else float(a == b) if entities[a] else None)
        assert got[i].details == (None if a == 2 else a == b)
        assert (got[i].structure == 1.0) == (a == b)


HEAD = " ".join(f"w{i}" for i in range(70))  # over 200 characters
TEXTS = [HEAD + " alpha beta gamma", HEAD + " delta beta Gamma rho", "Short one with Paris 12 and 30", HEAD + " " + " ".join(f"x{i}" for i in range(90)), HEAD + " alpha", "Short one with Paris 12 and 30 more", HEAD + " alpha", HEAD + " " + " ".join(f"y{i}" for i in range(90))]


@pytest.fixture
def benchmark(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def _tokens(t):
    return [w.lower() for w in re.findall("[A-Za-z0-9]+", t)]


def _rouge_l(a, b):
    a, b = _tokens(a), _tokens(b)
    before = [0] * (len(b) + 1)
    for x in a:
        now = [0]
        for j, y in enumerate(b):
            now.append(before[j] + 1 if x == y else max(before[j + 1], now[j]))
        before = now
    return 2 * before[-1] / (len(a) + len(b))


def _shared(p, r, n):
    p, r = (Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (p, r))
    return sum((p & r).values()), sum(p.values()), sum(r.values())


def _bleu(hyp, ref, n):
    p, r = hyp.lower().split(), ref.lower().split()
    if not p or not _shared(p, r, 1)[0]:
        return 0.0
    logs = [math.log((s or 0.1) / max(1, k)) for s, k, _ in (_shared(p, r, i) for i in range(1, n + 1))]
    return min(1.0, math.exp(1 - len(r) / len(p))) * math.exp(sum(logs) / n)


def test_rouge_l_of_whole_texts(spark, benchmark):
    got = {r.item_id: r.rouge for r in registry.queries()["f04_rouge_l"](spark, benchmark).collect()}
    assert got == pytest.approx({i: _rouge_l(TEXTS[i - 1] + " end", TEXTS[i]) for i in range(1, len(TEXTS))}, abs=1e-6)


def test_bleu_and_rouge_of_whole_texts(spark, benchmark):
    got = {r.item_id: r for r in registry.queries()["f23_bleu_and_rouge"](spark, benchmark).collect()}
    assert sorted(got) == list(range(len(TEXTS)))
    for i, ref in enumerate(TEXTS):
        hyp = TEXTS[i - 1] if i else ""
        for n in (1, 2, 3, 4):
            assert got[i][f"bleu_{n}"] == pytest.approx(_bleu(hyp, ref, n), abs=1e-6)
        for n in (1, 2):
            s, p, r = _shared(_tokens(hyp), _tokens(ref), n)
            assert got[i][f"rouge_{n}"] == pytest.approx(2 * s / (p + r), abs=1e-6)


def _keys(t):
    return set(re.findall(r"\b\d+(?:\.\d+)?(?:e-?\d+)?\b", t)) | {w.lower() for w in re.findall(r"\b[A-Z][A-Za-z0-9]{2,}\b", t)}


def _reason(i):
    chosen, rejected = TEXTS[i], [TEXTS[i], "I cannot see the video", "too short", TEXTS[i - 1]][i % 4]
    if chosen.lower() == rejected.lower():
        return "same"
    if i % 4 == 1:
        return "abstains"
    if len(_tokens(rejected)) < 5:
        return "short"
    if _rouge_l(rejected, chosen) > 0.7:
        return "alike"
    keys = _keys(chosen)
    return "keys" if len(keys) >= 3 and len(keys & _keys(rejected)) >= 0.85 * len(keys) else None


def test_pairs_are_screened_on_whole_texts(spark, benchmark):
    got = {r.drop_reason: r.n for r in registry.queries()["p12_screened_pairs"](spark, benchmark).collect()}
    assert got == Counter(_reason(i) for i in range(1, len(TEXTS)))
    assert got[None] == 2  # items 3 and 7: item 7's first 200 characters are those of item 6


def test_stemmed_rouge_of_whole_texts(spark, tmp_path):
    from evalweave.functions.stemming import stem

    texts = ["The cats were running quickly through relational gardens " + HEAD, "A cat runs through the relation of a garden " + HEAD + " and hopes", "hopeful cats ran", ""]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.item_id: r for r in registry.queries()["f23_stemmed_rouge"](spark, str(tmp_path)).collect()}

    def tokens(t):
        return [stem(w) if len(w) > 3 else w for w in _tokens(t)]

    for i, ref in enumerate(texts):
        hyp, want = tokens(texts[i - 1] if i else ""), tokens(ref)
        for n in (1, 2):
            s, p, r = _shared(hyp, want, n)
            assert got[i][f"rouge_{n}"] == pytest.approx(2 * s / (p + r) if p + r else 0, abs=1e-6)
        common = _rouge_l(" ".join(hyp), " ".join(want)) if hyp or want else 0
        assert got[i].rouge_l == pytest.approx(common, abs=1e-6)
