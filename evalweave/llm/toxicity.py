"""Toxicity by maximum-scoring segments.

Words are lower-cased runs of letters and digits. A term, which is a word or a word's
beginning, has its log-odds in toxic against clean training texts under a Dirichlet
prior shaped like the whole training vocabulary. A word scores like the one of its
terms with the clearest z-score; words without a clear term score a small negative
constant. One linear scan of a text finds all its maximal scoring segments.
Under the clean texts' word frequencies the best segment of m words follows an extreme
value law, which turns each segment's score into a bit-like excess
x = lambda * score - log(K * m); K is fitted to the clean training texts. A logistic
curve over the best excess, the summed excess of all significant segments and their
share of the text's words makes the score of the text.

Edge cases: null, empty and wordless texts have no segment and get the curve's value at
zero; without labelled texts of both kinds every score is the share of toxic ones, or 0;
rows that repeat a doc_id are each scored; a doc_id whose labels differ teaches nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.llm.common import FIRST_BYTES, batches, crc_fold, discard, first_words, mix, only, run_hashes, runs, stage, texts_of, windows_hash
from evalweave.llm.units import forget
from evalweave.runtime import ship

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
STEMS = (4, 5, 6, 7, 8)


def hashed_terms(texts: list[str | None]) -> Iterator[np.ndarray]:
    """For each text a row of hashes a word: of the word, then of its beginnings of 4 to 8 bytes, 0 where the word is no longer than that."""
    for _, part in batches(texts, [t or "" for t in texts]):
        raw = [t.lower().encode("utf-8", "surrogatepass") for t in part]
        buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        starts, sizes = runs(_WORD[buf])
        hashes = np.zeros((len(starts), 1 + len(STEMS)), np.uint64)
        if len(starts):
            hashes[:, 0] = run_hashes(buf, starts, sizes)[0]
            begin = first_words(buf, starts, sizes)[0]
            for i, j in enumerate(STEMS):
                hashes[:, 1 + i] = np.where(sizes > j, mix(begin & FIRST_BYTES[j], j), np.uint64(0))
        at = 0
        for cut in np.searchsorted(starts, np.cumsum([len(r) + 1 for r in raw])):
            yield hashes[at:cut]
            at = cut


def segments(places: np.ndarray, scores: np.ndarray, gap: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last place, score), in one pass of linear time.

    ``places`` and ``scores`` are the words that score other than ``-gap``; positive ones
    begin candidates, each merged leftwards while that raises its score. A candidate knows
    the nearest one before it that begins lower, so a search passes over those between;
    where none begins lower, all candidates so far are final.
    """
    done: list[tuple] = []
    out: list[tuple] = []  # first, last, sum before, sum after, nearest candidate that begins lower
    total, at = 0.0, 0
    for place, score in zip(places.tolist(), scores.tolist(), strict=True):
        total -= gap * (place - at)
        at = place + 1
        before, total = total, total + score
        if score <= 0:
            continue
        first, j = place, len(out) - 1
        while True:
            while j >= 0 and out[j][2] >= before:
                j = out[j][4]
            if j < 0:
                done += out
                out = [(first, place, before, total, -1)]
                break
            if out[j][3] >= total:
                out.append((first, place, before, total, j))
                break
            first, _, before, _, lower = out[j]
            del out[j:]
            j = lower
    return [(a, b, y - x) for a, b, x, y, _ in done + out]


class Model(NamedTuple):
    """Sorted hashes of words and beginnings with their scores and z, and the constants of the calibration."""

    terms: np.ndarray
    scores: np.ndarray
    z: np.ndarray
    gap: float
    scale: float  # lambda of the extreme value law
    log_k: float
    weights: np.ndarray

    def sieve(self) -> np.ndarray:
        """Which values of the low 20 bits any term has."""
        out = np.zeros(1 << 20, bool)
        out[(self.terms & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        return out

    def found(self, words: np.ndarray, sieve: np.ndarray) -> list[tuple[int, int, float]]:
        """Segments (first, last word, excess) of a text. Of a word and its beginnings, the one with the clearest z counts."""
        if not len(self.terms) or not len(words):
            return []
        row, col = np.nonzero(sieve[(words & np.uint64((1 << 20) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.terms, words[row, col]), len(self.terms) - 1)
        real = self.terms[at] == words[row, col]
        row, at = row[real], at[real]
        if not len(row):
            return []
        order = np.lexsort((-np.abs(self.z[at]), row))
        row, at = row[order], at[order]
        one = np.concatenate([[True], row[1:] != row[:-1]])
        row, scores = row[one], self.scores[at[one]]
        if not (scores > 0).any():
            return []
        level = self.log_k + math.log(len(words))
        return [(a, b, self.scale * s - level) for a, b, s in segments(row, scores, self.gap)]

    @staticmethod
    def features(found: list[tuple[int, int, float]], n: int) -> list[float]:
        """Best excess (0 at least -8), summed significant excess, their share of the words."""
        if not found:
            return [0.0, 0.0, 0.0]
        strong = [(a, b, x) for a, b, x in found if x > 0]
        return [min(max(max(x for *_, x in found) + 8.0, 0.0), 60.0) / 8, math.log1p(sum(x for *_, x in strong)), min(1.0, sum(b - a + 1 for a, b, _ in strong) / n)]

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + features @ self.weights[1:], -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights, the intercept first, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    keep = np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _lambda(scores: np.ndarray, chance: np.ndarray) -> float:
    """The positive root of sum(chance * exp(lambda * score)) = 1."""
    if not (scores > 0).any() or (scores * chance).sum() >= 0:
        return 1.0
    low, high = 0.0, 1.0
    value = lambda x: (chance * np.exp(np.minimum(x * scores, 500))).sum()
    while value(high) < 1 and high < 1e3:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 1 else (low, mid)
    return low or high


def learn(labelled: DataFrame, prior: float = 0.05, least_z: float = 4.0, gap: float = 0.05) -> Model:
    """A model from staged (text, y).

    Of texts with an equal least hash of three-word windows, for either of two hashes, one
    is counted: families of copies would make all their words look toxic or clean. Counts
    are summed before the shuffle; a term needs a clear z-score over words and a fair one
    over texts. All such terms reach the driver, at most those of the labelled texts,
    which the caller bounds.
    """

    def sign(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in parts:
            least = []
            for words in hashed_terms(batch.column(0).to_pylist()):
                w = windows_hash(words[:, 0], min(3, max(1, len(words))))
                least.append((int(w.min()), int(mix(w, 9).min())) if len(w) else (0, 0))
            a, b = np.array(least, np.uint64).reshape(-1, 2).view(np.int64).T
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.ascontiguousarray(a)), pa.array(np.ascontiguousarray(b))], ["text", "y", "a", "b"])

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in parts:
            y = batch.column(1).to_pylist()
            terms, sums = [], []
            for kind, words in zip(y, hashed_terms(batch.column(0).to_pylist()), strict=True):
                t, n = np.unique(words, return_counts=True)
                one = np.ones(len(t), np.int64)
                terms.append(t)
                sums.append(np.stack([n * kind, n * (1 - kind), one * kind, one * (1 - kind)]))
            if terms:
                t, which = np.unique(np.concatenate(terms), return_inverse=True)
                c = [np.bincount(which, x, len(t)).astype(np.int64) for x in np.concatenate(sums, axis=1)]
                yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), *map(pa.array, c)], ["term", "n1", "n0", "d1", "d0"])

    rows = labelled.select("text", "y")
    kinds = dict(rows.groupBy("y").count().collect())
    share = kinds.get(1, 0) / max(1, sum(kinds.values()))
    flat = np.array([math.log(max(share, 1e-13) / max(1 - share, 1e-13)), 0, 0, 0])
    if len(kinds) < 2:
        return Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), gap, 1.0, 0.0, flat)
    # of equal hashes always the same text, so that a fit can be repeated
    signed = rows.mapInArrow(sign, "text string, y int, a long, b long").groupBy("y", "a").agg(F.min(F.struct("b", "text")).alias("r"))
    single, single_path = stage(signed.groupBy("y", "r.b").agg(F.min("r.text").alias("text")).select("text", "y"), "single")
    counts, counts_path = stage(single.mapInArrow(count, "term long, n1 long, n0 long, d1 long, d0 long").where("term <> 0").groupBy("term").agg(*(F.sum(c).alias(c) for c in ("n1", "n0", "d1", "d0"))), "terms")
    texts = {r.y: r[1] for r in single.groupBy("y").count().collect()}

    def odds(one: str, none: str, all1: float, all0: float) -> tuple[F.Column, F.Column]:
        size = prior * (all1 + all0)  # the prior weighs as much as this many counts
        a = (F.col(one) + F.col(none)) * prior
        x = F.log((F.col(one) + a) / (all1 + size - F.col(one) - a)) - F.log((F.col(none) + a) / (all0 + size - F.col(none) - a))
        return x, x / F.sqrt(1 / (F.col(one) + a) + 1 / (F.col(none) + a))

    t1, t0 = (float(x or 0) for x in counts.agg(F.sum("n1"), F.sum("n0")).first())
    score_, z = odds("n1", "n0", t1, t0)
    _, z_texts = odds("d1", "d0", float(texts.get(1, 0)), float(texts.get(0, 0)))
    clear = (F.abs("z") >= least_z) & (F.abs("zd") >= least_z / 2) & (F.signum("z") == F.signum("zd"))
    found = counts.select("term", "n0", score_.alias("score"), z.alias("z"), z_texts.alias("zd")).where(clear).collect()
    found.sort(key=lambda r: r.term & (2**64 - 1))
    terms = np.array([r.term for r in found], np.int64).view(np.uint64)
    scores = np.array([r.score for r in found], float)
    chance = np.array([r.n0 for r in found], float) / max(t0, 1)
    scale = _lambda(np.append(scores, -gap), np.append(chance, max(0.0, 1 - chance.sum())))
    draft = Model(terms, scores, np.array([r.z for r in found], float), gap, scale, 0.0, flat)

    # P(no excess above x) = exp(-K exp(-x)): the likeliest K is n / sum(exp(-x)) over clean texts, those without segment counting as x = 0
    best = single.mapInArrow(lambda parts: _best(parts, draft), "y int, x double")
    clean = best.where("y = 0").agg(F.count("*"), F.sum(F.exp(-F.greatest(F.coalesce("x", F.lit(0.0)), F.lit(-30.0))))).first()
    fitted = draft._replace(log_k=math.log(max(clean[0], 1) / max(clean[1] or 1.0, 1e-9)))
    sample = single.mapInArrow(lambda parts: _features(parts, fitted), "y int, f array<double>").collect()
    discard(labelled.sparkSession, single_path, counts_path)
    sample.sort(key=lambda r: (r.y, r.f))  # so that a fit can be repeated
    return fitted._replace(weights=_logistic(np.array([r.f for r in sample]), np.array([r.y for r in sample], float)))


def _best(parts: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    sieve = model.sieve()
    for batch in parts:
        best = [max((x for *_, x in model.found(t, sieve)), default=None) for t in hashed_terms(batch.column(0).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(best, pa.float64())], ["y", "x"])


def _features(parts: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    sieve = model.sieve()
    for batch in parts:
        rows = [model.features(model.found(t, sieve), len(t)) for t in hashed_terms(batch.column(0).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(rows, pa.list_(pa.float64()))], ["y", "f"])


def score(texts: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and the significant passages (first and last word, excess) of each text."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("excess", pa.float64())]))
        sieve = model.sieve()
        for batch in parts:
            f, spans = [], []
            for words in hashed_terms(batch.column(1).to_pylist()):
                found = model.found(words, sieve)
                f.append(model.features(found, len(words)))
                spans.append([{"first": a, "last": b, "excess": x} for a, b, x in found if x > 0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(np.array(f).reshape(-1, 3)), pa.float64()), pa.array(spans, kind)], ["doc_id", "score", "passages"])

    return texts.mapInArrow(run, "doc_id long, score double, passages array<struct<first:long,last:long,excess:double>>")


def training_rows(docs: DataFrame, labels: DataFrame, label: str, held: F.Column, most: int) -> tuple[DataFrame, str]:
    """(text, y) of about ``most`` labelled rows that aren't held out, drawn by a hash of the doc_id, and where they are staged.

    A doc_id whose rows of ``labels`` say both 0 and 1 is left out.
    """
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull()).where(~held)
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("top")).where("y = top").drop("top")
    known, path = stage(known, "labels")
    n = known.count()
    rate = min(1.0, most / max(n, 1))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < rate * (1 << 30))
    out, out_path = stage(only(texts_of(docs), known).join(known, "doc_id").select("text", "y"), "training")
    discard(spark, path)
    return out, out_path


def drop_toxic(docs: DataFrame, labels: DataFrame, fold: int = 4, held: int = 2, threshold: float = 0.3, most: int = 20_000) -> DataFrame:
    """The rows of ``docs`` under the threshold, with all their columns; nothing is shuffled but the training sample."""
    ship(docs.sparkSession)
    training, path = training_rows(docs, labels, "toxic", crc_fold(fold) == held, most)
    model = learn(training)
    discard(docs.sparkSession, path)
    sieves: list[np.ndarray] = []  # made once in each worker

    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        forget()
        if not sieves:
            sieves.append(model.sieve())
        f = [model.features(model.found(t, sieves[0]), len(t)) for t in hashed_terms(texts.to_pylist())]
        return pa.array(model.score(np.array(f).reshape(-1, 3)) < threshold)

    return docs.where(clean(F.col("text").cast("string")))


def score_documents(docs: DataFrame, labels: DataFrame, fold: int = 4, held: int = 2, threshold: float = 0.3, most: int = 20_000) -> DataFrame:
    """doc_id, held_out, score, predicted, passages of every row; fitted on about ``most`` labelled rows."""
    out = crc_fold(fold) == held
    training, path = training_rows(docs, labels, "toxic", out, most)
    model = learn(training)
    discard(docs.sparkSession, path)
    found = score(texts_of(docs), model)
    return found.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "passages")
