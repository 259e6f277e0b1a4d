"""Language by rank-order n-gram profiles (out-of-place distance).

A text is lower-cased; whatever isn't a letter parts words. Its n-grams of one to three
characters, a space standing before and after each word, are ranked by frequency, ties
by code point. A language's profile ranks the same over its training texts. The
distance of a text from a language sums, over the text's most frequent n-grams, how far
each lies from its place in the profile, or the profile's length if it isn't there.

Edge cases: a null text, or one without letters, is ``und`` with score 0; equal
distances go to the language that sorts first; without any labelled text all is
``und``; rows that repeat a doc_id are each predicted.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalweave.llm.common import crc_fold, texts_of
from evalweave.llm.units import forget

_SPACE = 1
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _letters[0]


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the n-grams of a text; 21 bits a character, so no two n-grams share a code."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    points = np.where(_letter_table()[points], points, _SPACE)
    points = np.concatenate([[_SPACE], points, [_SPACE]])
    points = points[np.concatenate([[True], (points[1:] != _SPACE) | (points[:-1] != _SPACE)])]
    letter = points != _SPACE
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs = points[:-1] << 21 | points[1:]
    triples = (points[:-2] << 42 | points[1:-1] << 21 | points[2:])[letter[1:-1]]
    return np.unique(np.concatenate([points[letter], pairs, triples]), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The most frequent codes, in order; ties by code."""
    if len(codes) > most:
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        some = counts >= least
        codes, counts = codes[some], counts[some]
    return codes[np.lexsort((codes, -counts))][:most]


class Profiles(NamedTuple):
    """Languages in order; sorted codes; the rank of each code in each language, or ``most``."""

    languages: list[str]
    codes: np.ndarray
    ranks: np.ndarray
    most: int

    def distances(self, text: str) -> np.ndarray | None:
        """Mean out-of-place distance from each language, 0 to 1."""
        top = ranked(*gram_counts(text), self.most)
        if not len(top) or not self.languages:
            return None
        at = np.minimum(np.searchsorted(self.codes, top), len(self.codes) - 1)
        there = np.where((self.codes[at] == top)[:, None], self.ranks[at], self.most)
        out = np.where(there == self.most, self.most, np.abs(there - np.arange(len(top))[:, None]))
        return out.mean(axis=0) / self.most

    def predict(self, text: str | None, sharpness: float = 40.0) -> tuple[str, float]:
        far = None if text is None else self.distances(text)
        if far is None:
            return "und", 0.0
        near = np.exp(-sharpness * (far - far.min()))
        best = int(far.argmin())
        return self.languages[best], float(near[best] / near.sum())


def learn(labelled: DataFrame, most: int = 300, per_language: int = 3000) -> Profiles:
    """Profiles from (doc_id, text, lang), of about ``per_language`` texts for each language.

    The sample is drawn by a hash of doc_id and text, so that copies are drawn apart, at a rate set by each language's count, so
    its size is bounded and nothing is sorted; only profiles come to the driver.
    """
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select(F.xxhash64("doc_id", "text").alias("draw"), "text", F.col("lang").cast("string").alias("lang"))
    rates = [(r.lang, min(1.0, per_language / r.n)) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()]
    if not rates:
        return Profiles([], np.zeros(1, np.int64), np.zeros((1, 0), np.int64), most)
    rate = labelled.sparkSession.createDataFrame(rates, "lang string, rate double")
    sample = rows.join(F.broadcast(rate), "lang").where(F.pmod("draw", F.lit(1 << 30)) < F.col("rate") * (1 << 30)).select("lang", "text")

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in parts:
            by: dict[str, list] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(gram_counts(text))
            for lang, found in by.items():
                codes, which = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
                n = np.bincount(which, np.concatenate([k for _, k in found]), len(codes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n)], ["lang", "code", "n"])

    total = sample.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "code")) - 1
    top = total.withColumn("rank", place).where(F.col("rank") < most).collect()
    languages = sorted({r.lang for r in top})
    codes = np.unique(np.array([r.code for r in top], np.int64)) if top else np.zeros(1, np.int64)
    ranks = np.full((len(codes), len(languages)), most, np.int64)
    for r in top:
        ranks[np.searchsorted(codes, r.code), languages.index(r.lang)] = r["rank"]
    return Profiles(languages, codes, ranks, most)


def predict(texts: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, lang_pred and score of each (doc_id, text)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in parts:
            found = [profiles.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return texts.mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, fold: int = 4, held: int = 2, most: int = 300, per_language: int = 3000) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; held-out rows teach nothing."""
    out = crc_fold(fold) == held
    texts = texts_of(docs, keep_null=True)
    train = docs.where(~out).select("doc_id", F.col("text").cast("string").alias("text"), "lang")
    found = predict(texts, learn(train, most, per_language))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")
