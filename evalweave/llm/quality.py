"""Text quality by a sparse rule ensemble.

Statistics of each text are columns. Small trees, boosted on them, are taken apart: the
path to every node is a conjunction of comparisons, a rule. A lasso logistic regression
over all rules keeps a few; those are compiled into one Spark column expression.

Edge cases: null and empty texts have all statistics 0 and are scored like any other;
without labelled texts of both kinds every score is the share of label 1; rows that
repeat a doc_id are each scored; a doc_id whose labels differ teaches nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.llm.common import crc_fold, discard, hashed_words, texts_of
from evalweave.llm.toxicity import training_rows
from evalweave.llm.units import forget

STATISTICS = ["log_words", "word_length", "upper", "digits", "stops", "signs", "pipes", "bangs", "wide", "line_length", "line_repeats", "distinct", "top_word", "sign_words", "pair_repeats", "run"]
_GROUPS = np.zeros((256, 7))
for _i, _chars in enumerate([b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:", b"#$%&*+<=>@^_{}~\\/[]()", b"|", b"!?"]):
    _GROUPS[list(_chars), _i] = 1
_GROUPS[0x80:, 6] = 1
_ENDS = np.zeros(256, bool)
_ENDS[list(b"#$%&*+<=>@^_{}~\\/|!")] = True


def statistics(text: str | None, words: np.ndarray) -> list[float]:
    """The statistics of one text; ``words`` are its hashed words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw or not len(words):
        return [0.0] * len(STATISTICS)
    buf = np.frombuffer(raw, np.uint8)
    share = np.bincount(buf, minlength=256) @ _GROUPS / len(buf)
    _, counts = np.unique(words, return_counts=True)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    tails = np.flatnonzero((buf[1:] <= 0x20) & _ENDS[buf[:-1]])
    with np.errstate(over="ignore"):
        pairs = words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]  # a statistic: chance equals do no harm
    same = np.flatnonzero(np.diff(buf) != 0)
    longest = int(np.diff(np.concatenate([[-1], same, [len(buf) - 1]])).max())
    return [math.log1p(len(words)), len(buf) / len(words), *share.tolist(), math.log1p(len(words) / max(1, len(lines))), 1 - len(set(lines)) / max(1, len(lines)), len(counts) / len(words), float(counts.max()) / len(words), len(tails) / len(words), 1 - len(np.unique(pairs)) / max(1, len(pairs)), math.log1p(longest)]


def measured(texts: DataFrame, *more: str) -> DataFrame:
    """The statistics of each text as columns, after the columns named."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in parts:
            strings = batch.column(0).to_pylist()
            rows = np.array([statistics(t, h[0]) for t, h in zip(strings, hashed_words([t or "" for t in strings], lower=True), strict=True)]).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(c) for c in rows.T)], [*more, *STATISTICS])

    kinds = {f.name: f.dataType.simpleString() for f in texts.schema}
    return texts.select("text", *more).mapInArrow(run, ", ".join([*(f"{m} {kinds[m]}" for m in more), *(f"{s} double" for s in STATISTICS)]))


class Rule(NamedTuple):
    """All of its comparisons (statistic, above, threshold) hold."""

    parts: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for i, above, t in self.parts:
            out &= (x[:, i] > t) == above
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for i, above, t in self.parts:
            c = F.col(STATISTICS[i])
            out = out & (c > F.lit(t) if above else c <= F.lit(t))
        return out


def _grow(bins: list[np.ndarray], codes: np.ndarray, r: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, path: tuple, leaves: list, rules: set, least: int) -> None:
    """A regression tree on gradients; every node below the root leaves its path as a rule."""
    g, w = r[rows].sum(), h[rows].sum()
    best = (1e-9, None)
    if depth and len(rows) >= 2 * least:
        for i, edges in enumerate(bins):
            if not len(edges):
                continue
            c = codes[rows, i]
            gs = np.cumsum(np.bincount(c, r[rows], len(edges) + 1))[:-1]
            ws = np.cumsum(np.bincount(c, h[rows], len(edges) + 1))[:-1]
            ns = np.cumsum(np.bincount(c, minlength=len(edges) + 1))[:-1]
            gain = gs**2 / (ws + 1) + (g - gs) ** 2 / (w - ws + 1) - g**2 / (w + 1)
            gain[(ns < least) | (len(rows) - ns < least)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (i, k))
    if best[1] is None:
        leaves.append((rows, g / (w + 1)))
        return
    i, k = best[1]
    above = codes[rows, i] > k
    for side in (False, True):
        further = (*path, (i, side, float(bins[i][k])))
        rules.add(Rule(tuple(sorted(further))))
        _grow(bins, codes, r, h, rows[above == side], depth - 1, further, leaves, rules, least)


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, seed: int = 5) -> list[Rule]:
    """Rules of boosted trees, each grown on a random half of the rows."""
    rng = np.random.Generator(np.random.PCG64(seed))
    bins = [np.unique(np.quantile(c, np.linspace(0.02, 0.98, 33))) for c in x.T]
    bins = [b[b < c.max()] for b, c in zip(bins, x.T, strict=True)]
    codes = np.column_stack([np.searchsorted(b, c, side="left") for b, c in zip(bins, x.T, strict=True)])
    f, rules = np.full(len(y), 0.0), set()
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        rows = np.sort(rng.permutation(len(y))[: max(2, len(y) // 2)])
        leaves: list = []
        grown: set = set()
        _grow(bins, codes, y - p, p * (1 - p), rows, depth, (), leaves, grown, max(5, len(y) // 500))
        if not grown:
            break
        rules |= grown
        step = np.zeros(len(y))
        for rows_, value in leaves:
            step[rows_] = value
        # rows outside the half follow the tree through its rules' splits
        out = np.setdiff1d(np.arange(len(y)), rows)
        if len(out) and leaves:
            near = np.zeros(len(out))
            for part, value in _leaf_rules(bins, codes, leaves, grown):
                near[part.holds(x[out])] = value
            step[out] = near
        f += rate * step
    return sorted(rules)


def _leaf_rules(bins: list, codes: np.ndarray, leaves: list, grown: set) -> Iterator[tuple[Rule, float]]:
    """Of the grown rules those that are leaves: no other extends them."""
    longer = {r.parts[:i] + r.parts[i + 1 :] for r in grown for i in range(len(r.parts))}
    ends = [r for r in grown if r.parts not in longer]
    for r in ends:
        inside = np.ones(len(codes), bool)
        for i, above, t in r.parts:
            inside &= (codes[:, i] > np.searchsorted(bins[i], t)) == above
        for rows_, value in leaves:
            if len(rows_) and inside[rows_].all():
                yield r, value
                break


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and sparse weights by accelerated proximal gradient."""
    n, k = z.shape
    mean, spread = z.mean(axis=0), np.maximum(z.std(axis=0), 0.05)
    s = (z - mean) / spread
    w, b = np.zeros(k), math.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9))
    look, look_b, t = w, b, 1.0
    size = 4.0 / max(1.0, float(np.linalg.norm(s, 2) ** 2) / n + 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(look_b + s @ look, -30, 30)))
        g = (p - y) / n
        v = look - size * (s.T @ g)
        new = np.sign(v) * np.maximum(np.abs(v) - size * penalty, 0)
        new_b = look_b - size * g.sum()
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        look = new + (t - 1) / t_new * (new - w)
        look_b = new_b + (t - 1) / t_new * (new_b - b)
        w, b, t = new, new_b, t_new
    return float(b - (w * mean / spread).sum()), w / spread


class Ensemble(NamedTuple):
    intercept: float
    rules: list[Rule]
    weights: list[float]

    def column(self) -> Column:
        """The score, 0 to 1, over the statistics' columns."""
        total = F.lit(self.intercept)
        for r, w in zip(self.rules, self.weights, strict=True):
            total = total + F.when(r.column(), F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def learn(x: np.ndarray, y: np.ndarray, penalty: float = 0.002) -> Ensemble:
    share = float(y.mean()) if len(y) else 0.0
    if not 0 < share < 1:
        return Ensemble(-30.0 if share == 0 else 30.0, [], [])
    rules = tree_rules(x, y)
    z = np.column_stack([r.holds(x) for r in rules]).astype(float) if rules else np.zeros((len(y), 0))
    if not rules:
        return Ensemble(math.log(share / (1 - share)), [], [])
    b, w = lasso_logistic(z, y, penalty)
    kept = [i for i in range(len(rules)) if w[i]]
    return Ensemble(b, [rules[i] for i in kept], [float(w[i]) for i in kept])


def score_documents(docs: DataFrame, labels: DataFrame, fold: int = 5, held: int = 0, threshold: float = 0.3, most: int = 20_000) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; fitted on about ``most`` labelled rows."""
    out = crc_fold(fold) == held
    training, path = training_rows(docs, labels, "quality", out, most)
    rows = measured(training, "y").toPandas()
    discard(docs.sparkSession, path)
    rows = rows.sort_values([*STATISTICS, "y"])  # so that a fit can be repeated
    model = learn(rows[STATISTICS].to_numpy(float), rows["y"].to_numpy(float))
    found = measured(texts_of(docs), "doc_id").withColumn("score", model.column())
    return found.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *STATISTICS)
