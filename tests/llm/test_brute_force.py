"""Models and features against slow, plain versions of themselves."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from evalweave.llm import common, langid, media, quality, toxicity

MOST = 40


def _grams(text):
    """N-grams as tuples of code points, 1 for a space."""
    line = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
    points = [1 if c == " " else ord(c) for c in line] if line.strip() else []
    out = Counter((p,) for p in points if p != 1)
    out.update(zip(points, points[1:], strict=False))
    out.update(t for t in zip(points, points[1:], points[2:], strict=False) if t[1] != 1)
    return out


def _ranked(counts):
    code = lambda g: sum(p << 21 * (len(g) - 1 - i) for i, p in enumerate(g))
    return sorted(counts, key=lambda g: (-counts[g], code(g)))[:MOST]


def test_out_of_place_distances(spark):
    rng = random.Random(2)
    kinds = {"aa": "abcdeé", "bb": "defghß", "cc": "абвгд"}
    texts = [(i, " ".join("".join(rng.choice(kinds[k]) for _ in range(rng.randint(1, 6))) for _ in range(25)) + rng.choice([".", " 12!", "\n", "  Ab"]), k) for i, k in enumerate(list(kinds) * 12)]
    docs = spark.createDataFrame([*texts, (900, "de", None), (901, "x y z", None), (902, "...", None)], "doc_id long, text string, lang string")
    learned = defaultdict(Counter)
    for i, t, k in texts:
        if zlib.crc32(str(i).encode()) % 4 != 2:
            learned[k] += _grams(t)
    profiles = {k: {g: r for r, g in enumerate(_ranked(c))} for k, c in learned.items()}
    for r in langid.identify(docs, most=MOST).collect():
        text = next((t for i, t, _ in texts if i == r.doc_id), {900: "de", 901: "x y z", 902: "..."}.get(r.doc_id))
        top = _ranked(_grams(text))
        if not top:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        far = {k: sum(abs(p[g] - i) if g in p else MOST for i, g in enumerate(top)) / len(top) / MOST for k, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        near = {k: math.exp(-40 * (x - far[best])) for k, x in far.items()}
        assert r.lang_pred == best
        assert r.score == pytest.approx(near[best] / sum(near.values()))


def _terms(word):
    raw = word.encode()
    return [("w", word), *((str(j), raw[:j]) for j in toxicity.STEMS if len(raw) > j)]


def _hash(term):
    kind, value = term
    raw = value.encode() if kind == "w" else value
    row = next(toxicity.hashed_terms([raw.decode("utf-8") if kind == "w" else raw.decode("latin-1") + "zz"]))[0]
    return int(row[0] if kind == "w" else row[1 + toxicity.STEMS.index(int(kind))])


def test_log_odds_and_calibration(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghijk") for _ in range(rng.randint(3, 10))) for _ in range(150)]
    rows = []
    for i in range(300):
        text = [rng.choice(words) for _ in range(40)]
        if i % 4 == 0:
            for _ in range(6):
                text[rng.randrange(40)] = rng.choice(["insultus", "insultor", "vile", "vileness"])
        elif i % 12 == 1:
            text[rng.randrange(40)] = rng.choice(["insultus", "insultor", "vile", "vileness"])
        rows.append((" ".join(text), int(i % 4 == 0)))
    model = toxicity.learn(spark.createDataFrame(rows, "text string, y int"))
    n, d = (defaultdict(lambda: [0, 0]) for _ in range(2))
    for text, y in rows:
        seen = Counter(t for w in text.split() for t in _terms(w))
        for t, c in seen.items():
            n[t][y] += c
            d[t][y] += 1
    prior, size = 0.05, [sum(x[y] for x in n.values()) for y in (0, 1)]
    docs = [sum(y == k for _, y in rows) for k in (0, 1)]

    def odds(c, all_):
        a, whole = prior * sum(c), prior * sum(all_)
        x = math.log((c[1] + a) / (all_[1] + whole - c[1] - a)) - math.log((c[0] + a) / (all_[0] + whole - c[0] - a))
        return x, x / math.sqrt(1 / (c[1] + a) + 1 / (c[0] + a))

    want = {}
    for t in n:
        (x, z), (_, zd) = odds(n[t], size), odds(d[t], docs)
        if abs(z) >= 4 and abs(zd) >= 2 and z * zd > 0:
            want[_hash(t)] = (x, z, n[t][0])
    assert any(x > 0 for x, _, _ in want.values())
    assert model.terms.tolist() == sorted(want)
    assert model.scores.tolist() == pytest.approx([want[t][0] for t in sorted(want)])
    assert model.z.tolist() == pytest.approx([want[t][1] for t in sorted(want)])
    # lambda is the root of the extreme value law's equation, K the likeliest one of the clean texts
    chance = [want[t][2] / size[0] for t in sorted(want)]
    total = sum(c * math.exp(model.scale * want[t][0]) for c, t in zip(chance, sorted(want), strict=True)) + (1 - sum(chance)) * math.exp(-model.scale * model.gap)
    assert total == pytest.approx(1, abs=1e-6)
    best = []
    for text, _ in (r for r in rows if r[1] == 0):
        scores = []
        for w in text.split():
            known = [want[_hash(t)] for t in _terms(w) if _hash(t) in want]
            scores.append(max(known, key=lambda k: abs(k[1]))[0] if known else -model.gap)
        top = max((sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=0)
        best.append(model.scale * top - math.log(len(scores)) if top > 0 else None)
    k = len(best) / sum(math.exp(-max(x, -30.0) if x is not None else 0) for x in best)
    # a text without segment counts as one at 0
    assert model.log_k == pytest.approx(math.log(k), abs=1e-6)


def test_logistic_is_at_its_optimum():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    y = (rng.random(300) < 1 / (1 + np.exp(-(x @ [1.0, -2.0, 0.3] - 0.5)))).astype(float)
    w = toxicity._logistic(x, y)
    one = np.column_stack([np.ones(300), x])
    slope = one.T @ (1 / (1 + np.exp(-one @ w)) - y) + np.array([1e-6, 1, 1, 1]) * w
    assert np.abs(slope).max() < 1e-6


def test_lasso_is_at_its_optimum():
    """The conditions of Karush, Kuhn and Tucker: a kept weight's slope is the penalty, any other's is below it."""
    rng = np.random.default_rng(3)
    z = (rng.random((500, 12)) < 0.4).astype(float)
    y = (rng.random(500) < 1 / (1 + np.exp(-(3 * z[:, 0] - 2 * z[:, 4] - 0.5)))).astype(float)
    penalty = 0.02
    b, w = quality.lasso_logistic(z, y, penalty, steps=4000)
    mean, spread = z.mean(axis=0), np.maximum(z.std(axis=0), 0.05)
    p = 1 / (1 + np.exp(-(b + z @ w)))
    slope = ((z - mean) / spread).T @ (p - y) / len(y)
    kept = w != 0
    assert kept[[0, 4]].all()
    assert not kept.all()
    assert np.allclose(slope[kept], -penalty * np.sign(w[kept]), atol=1e-4)
    assert (np.abs(slope[~kept]) <= penalty + 1e-4).all()
    assert abs((p - y).mean()) < 1e-4


def test_first_split_is_the_best_one():
    rng = np.random.default_rng(5)
    x = rng.random((200, 4))
    r, h = rng.normal(size=200), rng.random(200) + 0.1
    bins = [np.unique(np.quantile(c, np.linspace(0.02, 0.98, 33))) for c in x.T]
    codes = np.column_stack([np.searchsorted(b, c, side="left") for b, c in zip(bins, x.T, strict=True)])
    rules, leaves = set(), []
    quality._grow(bins, codes, r, h, np.arange(200), 1, (), leaves, rules, 5)
    best, at = 0.0, None
    for i, edges in enumerate(bins):
        for e in edges:
            low = x[:, i] <= e
            if min(low.sum(), (~low).sum()) >= 5:
                gain = r[low].sum() ** 2 / (h[low].sum() + 1) + r[~low].sum() ** 2 / (h[~low].sum() + 1) - r.sum() ** 2 / (h.sum() + 1)
                if gain > best:
                    best, at = gain, (i, float(e))
    assert {(p[0], p[2]) for rule in rules for p in rule.parts} == {at}
    assert {p[1] for rule in rules for p in rule.parts} == {False, True}
    assert sorted(v for _, v in leaves) == pytest.approx(sorted(r[m].sum() / (h[m].sum() + 1) for m in (x[:, at[0]] <= at[1], x[:, at[0]] > at[1])))


def _means(grey, height, width):
    cover = lambda n, k: np.array([[max(0.0, min((i + 1) * n / k, j + 1) - max(i * n / k, j)) for j in range(n)] for i in range(k)])
    return cover(grey.shape[0], height) @ grey @ cover(grey.shape[1], width).T * (height * width / grey.size)


def test_media_features(spark):
    rng = random.Random(4)
    texts = [None, "", "one", "a" * 64, "x y " * 100, "".join(rng.choice("abc déf\n") for _ in range(3000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found, path, tiles = media.text_media(docs)
    kept = {r.doc_id: r for r in spark.read.parquet(tiles).collect()}
    assert spark.read.parquet(path).count() == len(texts)
    for r in found.collect():
        raw = (texts[r.doc_id] or "").encode()
        grey = np.frombuffer(raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0"), np.uint8).reshape(-1, 64).astype(float)
        small = np.round(_means(grey, 8, 9), 6)
        bits = "".join("1" if small[i, j + 1] > small[i, j] else "0" for i in range(8) for j in range(8))
        tile = np.rint(np.round(_means(grey, 32, 32), 9)).astype(np.uint8)
        dhash, crc = r.feature.split(":")
        assert dhash == f"{int(bits, 2):016x}" == kept[r.doc_id].dhash
        stored = np.load(__import__("io").BytesIO(kept[r.doc_id].tile))
        assert crc == f"{zlib.crc32(stored.tobytes()):08x}"
        assert np.abs(stored.astype(int) - tile.astype(int)).max() <= 1  # a mean right between two samples may fall either way
        assert (stored == tile).mean() > 0.99


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Conf:
        def get(self, name, default):
            return default

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.scratch_root(Session())
