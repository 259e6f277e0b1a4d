"""MinHash near duplicates with odd sketches.

1. One Arrow pass turns each text into MinHash samples of its shingles, which 64 bits
   mixed from the 128-bit hashes of their words tell apart. Bands of samples give bucket
   keys. Samples of one further permutation are folded into an odd sketch, a bitmap in
   which each sample flips one bit. The population count of the XOR of two sketches
   estimates how many samples differ, most precisely at high similarity.
2. Documents with one and the same shingle set form a class, named by its smallest id:
   a digest of the sorted set finds them, and each full set is compared with that of the
   class's smallest id.
3. Buckets link their members to a centre (a star, never all pairs). Sketches reject
   links far under the threshold; the rest is confirmed on the full shingle sets.
4. Components of confirmed links tell which buckets still hold members of different
   components; those get other centres, round by round, while that clearly lowers the number of
   pairs left across components. Then each of these
   pairs is compared once, by size and sketch inside the join's condition, and
   confirmed likewise. A link that the bands find is lost only if its sketches differ by
   seven standard deviations more than expected at the threshold, and a group of near
   copies costs some stars and not its square.

Edge cases: lower-casing is ASCII only; a text with fewer words than a shingle is one
shingle; null, empty and blank texts have none and are linked with nothing; rows
without doc_id are linked with nothing and have no component_id; rows that repeat a
doc_id are one node with the links of either.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.llm.common import discard, mix, only, stage, texts_of, windows_hash, without, word_batches
from evalweave.llm.components import connected_components, joined
from evalweave.llm.units import forget

BINS = 4096  # samples of a sketch
BITS = 2048  # of a sketch


def shingle_sets_of(texts: list[str], n: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of runs of ``n`` words; of the whole if there are fewer."""

    def hashes(words: np.ndarray, n: int) -> np.ndarray:
        return mix(windows_hash(words[0], n) ^ mix(windows_hash(words[1], n), 17))

    for words, cuts in word_batches(texts, lower=True):
        all_ = hashes(words, n)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b - a >= n:
                yield np.unique(all_[a : b - n + 1])
            else:
                yield hashes(words[:, a:b], b - a) if b > a else np.zeros(0, np.uint64)


class MinHasher:
    """``bands`` bands of ``rows`` samples each."""

    def __init__(self, bands: int, rows: int, seed: int = 7):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.bands, self.rows, k = bands, rows, bands * rows
        self.a = (rng.integers(0, 2**31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
        self.b = rng.integers(0, 2**32, k, dtype=np.uint32)[:, None]

    def samples(self, shingles: np.ndarray, block: int = 2048) -> np.ndarray:
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        least = None
        for at in range(0, len(x), block):
            m = (self.a * x[None, at : at + block] + self.b).min(axis=1)
            least = m if least is None else np.minimum(least, m)
        return least

    def keys(self, samples: np.ndarray) -> np.ndarray:
        """Bucket keys of rows of samples; the band's number is part of its key."""
        s = samples.reshape(len(samples), self.bands, self.rows).astype(np.uint64)
        out = np.broadcast_to(np.arange(self.bands, dtype=np.uint64), s.shape[:2])
        for j in range(self.rows):
            out = mix(out + s[:, :, j], j)
        return out


def odd_sketch(shingles: np.ndarray) -> np.ndarray:
    """Parity bitmap of MinHash samples by one permutation: the least shingle of each of ``BINS`` bins flips a bit."""
    least = np.zeros(BINS, np.uint64)
    least[(shingles & np.uint64(BINS - 1)).astype(np.int64)[::-1]] = shingles[::-1]  # sorted, so the least is written last
    at = (mix(least[least != 0], 99) % np.uint64(BITS)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=BITS) & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def odd_limit(n: str, threshold: float, sigmas: float = 7.0) -> str:
    """SQL for the most set bits of the XOR of two sketches at the threshold; ``n`` is the sum of both sets' sizes.

    Of the union's bins each differs with chance 1 - J, all but exactly so where bins
    hold one shingle. A bin that differs flips one bit, or two if both sets are in it;
    bits flipped twice vanish. The spread of all three is allowed for.
    """
    t, k = threshold, float(BINS)
    union = f"({n} / {1 + t})"
    bins = f"({k} * (1 - exp(-{union} / {k})))"
    differ = f"({bins} * {1 - t})"
    lone = f"exp(-{n} / {2 * k})"
    spread = f"sqrt(power(2 - {lone}, 2) * {bins} * {t * (1 - t)} * (1 - {bins} / {union} + 0.001) + {differ} * {lone} * (1 - {lone}))"
    flips = f"({differ} * (2 - {lone}) + {sigmas} * {spread} + 1)"
    parity = f"({BITS / 4} * (1 - exp(-4 * {flips} / {BITS})) - {flips} * exp(-4 * {flips} / {BITS}))"
    return f"least({flips}, {BITS / 2} * (1 - exp(-2 * {flips} / {BITS})) + {sigmas} * sqrt(greatest({parity}, 0)))"


def _lists(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(rows).view(np.int64).ravel()))


def signatures(texts: DataFrame, words: int, hasher: MinHasher) -> DataFrame:
    """doc_id, n, digest (d1, d2), bands and sketch of each text; empty sets have no bands."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for part in parts:
            n, digest, mins, sketches, some = [], [], [], [], []
            for i, s in enumerate(shingle_sets_of(part.column(1).to_pylist(), words)):
                n.append(len(s))
                digest.append(_digest(s))
                if len(s):
                    some.append(i)
                    mins.append(hasher.samples(s))
                    sketches.append(odd_sketch(s))
            d = np.array(digest, np.int64).reshape(-1, 2)
            keys = np.zeros((len(n), hasher.bands), np.uint64)
            odd = np.zeros((len(n), BITS // 64), np.uint64)
            if some:
                keys[some], odd[some] = hasher.keys(np.stack(mins)), np.stack(sketches)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()), _lists(keys), _lists(odd)], ["doc_id", "n", "d1", "d2", "bands", "sketch"])

    return texts.mapInArrow(run, "doc_id long, n long, d1 long, d2 long, bands array<long>, sketch array<long>")


def _digest(shingles: np.ndarray) -> np.ndarray:
    """128 bits of a sorted set."""
    return np.frombuffer(hashlib.blake2b(shingles.astype("<u8").tobytes(), digest_size=16).digest(), "<i8")


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """doc_id, digest (d1, d2) and the whole shingle set of each text."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for part in parts:
            ids, sets, size = [], [], 0
            for i, s in zip(part.column(0).to_pylist(), shingle_sets_of(part.column(1).to_pylist(), words), strict=True):
                ids.append(i)
                sets.append(s)
                size += len(s)
                if size > 1 << 20:
                    yield _set_batch(ids, sets)
                    ids, sets, size = [], [], 0
            if ids:
                yield _set_batch(ids, sets)

    return texts.mapInArrow(run, "doc_id long, d1 long, d2 long, shingles array<long>")


def _set_batch(ids: list, sets: list) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
    values = np.concatenate(sets).astype(np.uint64).view(np.int64)
    d = np.stack([_digest(s) for s in sets])
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["doc_id", "d1", "d2", "shingles"])


def _alike(a: str, b: str, percent: int) -> Column:
    """May two nodes reach the threshold, by their sizes and sketches?"""
    odd = " + ".join(f"bit_count({a}.sketch[{i}] ^ {b}.sketch[{i}])" for i in range(BITS // 64))
    return F.expr(f"100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n) AND {odd} <= {odd_limit(f'double({a}.n + {b}.n)', percent / 100)}")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 38, rows: int = 5, star_rounds: int = 8) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (doc_id = component_id) of every row.

    Documents are linked where 100 * intersection >= percent * union of their shingle
    sets. All bands miss a pair right at 0.8 with chance (1 - 0.8^5)^38 = 3e-7; 32 bands
    of 6 miss one at 0.85 with 3e-7.
    """
    spark = docs.sparkSession
    hasher = MinHasher(bands, rows)
    texts = texts_of(docs)
    sig, sig_path = stage(signatures(texts, words, hasher), "sig")
    full = sig.where("doc_id IS NOT NULL AND n > 0")
    digest = ["n", "d1", "d2"]
    classes = full.groupBy(*digest).agg(F.min("doc_id").alias("rep"))
    classes, classes_path = stage(classes, "classes")
    members, members_path = stage(full.select("doc_id", *digest).join(classes, digest), "members")
    reps, reps_path = stage(full.join(members.where("doc_id = rep").select("doc_id", *digest).distinct(), ["doc_id", *digest], "left_semi").dropDuplicates(["doc_id", *digest]), "reps")

    keyed = reps.select("doc_id", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").drop("high")
    shared, shared_path = stage(shared, "shared")
    hot, hot_path = stage(keyed.join(shared, "key"), "buckets")
    nodes = hot.select("doc_id").distinct()
    copies = members.where("doc_id <> rep")
    wanted = nodes.union(copies.select("doc_id")).union(copies.select("rep"))
    sets, sets_path = stage(shingle_sets(only(texts, wanted).dropDuplicates(["doc_id", "text"]), words), "sets")
    one, other = sets.withColumnRenamed("shingles", "own"), sets.select(F.col("doc_id").alias("rep"), "d1", "d2", F.col("shingles").alias("first"))
    if not copies.select("doc_id", "d1", "d2", "rep").join(one, ["doc_id", "d1", "d2"]).join(other.hint("merge"), ["rep", "d1", "d2"]).where("own <> first").isEmpty():
        raise RuntimeError("two shingle sets share a digest")
    node, node_path = stage(reps.join(nodes, "doc_id", "left_semi").select("doc_id", "n", "sketch", "bands"), "nodes")

    def sketched(pairs: DataFrame) -> DataFrame:
        x, y = node.alias("x"), node.alias("y")
        return pairs.join(x, F.col("a") == F.col("x.doc_id")).join(y, F.col("b") == F.col("y.doc_id")).where(_alike("x", "y", percent)).select("a", "b")

    def confirmed(pairs: DataFrame) -> DataFrame:
        a, b = (sets.select(F.col("doc_id").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
        both = F.size(F.array_intersect("sa", "sb"))
        hit = pairs.join(a, "a").join(b, "b").select("a", "b", both.alias("x"), (F.size("sa") + F.size("sb") - both).alias("y"))
        return hit.where(F.col("x") * 100 >= F.col("y") * percent).select("a", "b")

    few = node.count()
    low, used = hot.where("doc_id <> low").select(F.col("doc_id").alias("a"), F.col("low").alias("b")).distinct(), []
    links, path = stage(confirmed(sketched(low)), "links")
    labels, label_path = connected_components(links)
    used += [path, label_path]
    before = None
    for turn in range(star_rounds + 1):
        # buckets that still hold several components
        named, path = stage(hot.select("key", "doc_id").join(labels, F.col("doc_id") == F.col("node"), "left").select("key", "doc_id", F.coalesce("label", "doc_id").alias("label")), "named")
        sizes = named.groupBy("key", "label").agg(F.count("*").alias("m"), F.expr(f"max_by(doc_id, xxhash64(doc_id, key, {turn}))").alias("hub"))
        open_ = sizes.groupBy("key").agg(F.expr("(sum(m) * sum(m) - sum(m * m)) / 2").alias("pairs"), F.max(F.expr(f"struct({'m' if turn % 2 == 0 else '1'} AS m, xxhash64(hub, key, {turn}) AS h, hub, label)")).alias("top")).where("pairs > 0")
        open_, open_path = stage(open_.select("key", "pairs", F.col("top.hub").alias("hub"), F.col("top.label").alias("hub_label")), "open")
        buckets, bucket_path = stage(named.join(open_, "key"), "open-buckets")
        used += [path, open_path, bucket_path]
        across = open_.agg(F.sum("pairs")).first()[0]
        if not across:
            break
        last = turn == star_rounds or across <= 4 * few or (before is not None and across > 0.7 * before)
        before = across
        if last:
            slim = buckets.select("key", "label", "doc_id").join(node, "doc_id")
            x, y = slim.alias("x"), slim.alias("y")
            # each pair in the first bucket that it shares
            here = F.expr("get(filter(x.bands, (v, i) -> v = y.bands[i]), 0) = x.key")
            pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.label") < F.col("y.label")) & _alike("x", "y", percent) & here).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct()
        else:
            pairs = sketched(buckets.where("label <> hub_label").select(F.col("doc_id").alias("a"), F.col("hub").alias("b")).distinct())
        found, path = stage(confirmed(pairs), "links")
        labels, label_path = joined(labels, found)
        used += [path, label_path]
        if last:
            break
    names = labels.select(F.col("node").alias("rep"), "label")
    linked = members.select("doc_id", F.col("n").alias("n_shingles"), "rep").join(names, "rep", "left").select("doc_id", "n_shingles", F.coalesce("label", "rep").alias("component_id"))
    lone = sig.where("doc_id IS NULL OR n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    out, _ = stage(linked.unionByName(lone).select("*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")), "neardup")
    discard(spark, sig_path, classes_path, members_path, shared_path, reps_path, hot_path, sets_path, node_path, *used)
    return out


def drop_near_copies(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, one for each group, with all their columns."""
    found = near_duplicates(docs, words, percent)
    return without(docs, found.where("NOT kept"))
