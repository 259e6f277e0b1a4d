"""Packing by minimum bin slack.

Documents become pieces: whole windows first, then what is left. The pieces' lengths
are counted; that histogram has at most ``size`` rows whatever the corpus, so the plan
is made on the driver. To fill a window, the longest piece left goes in, and a bitset
subset-sum dynamic programme over the remaining multiset of lengths finds the fill
closest to capacity; backtracking gives the count of each length. A fill is repeated as
often as the counts allow, so the plan grows with the number of lengths and not of
pieces. Where no fill is exact, one further piece is cut to close the gap, and the last
tokens fill windows whose sizes are powers of two, so no padding is left.

The plan names pieces by length and rank. Ranks come from one range-partitioned sort
of (length, doc_id, start) rows: a hot length spreads over many tasks. Only documents
with a cut piece are encoded again for the checksums of their parts; such a document is
known by its doc_id and the SHA-256 of its text.

Edge cases: a null text is empty and has the end id alone; rows without doc_id are
packed too; of rows that repeat a doc_id each is packed, with its own text's checksums;
an empty table gives no piece.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right, insort
from collections import defaultdict, deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.llm.common import batches, discard, near_slots, stage, texts_of
from evalweave.llm.units import encoder

_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sha binary"
_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sha"]


class Run(NamedTuple):
    """Equal-length remainders of the pieces of ``length`` with ranks first <= rank < last."""

    length: int
    first: int
    last: int
    skip: int


class Slot(NamedTuple):
    """Part [skip, skip + size) of a run's pieces: piece number j goes to window base + (number + j) // per."""

    length: int
    first: int
    last: int
    skip: int
    size: int
    number: int
    per: int
    base: int
    offset: int


def closest_fill(counts: dict[int, int], lengths: list[int], capacity: int) -> tuple[int, dict[int, int]]:
    """The multiset of ``lengths`` (ascending) whose sum is the largest up to ``capacity``, longest lengths first."""
    reach, mask, target, steps = 1, (2 << capacity) - 1, 1 << capacity, []
    for i in range(bisect_right(lengths, capacity) - 1, -1, -1):
        length = lengths[i]
        left, k = min(counts[length], capacity // length), 1
        while left and not reach & target:
            take = min(k, left)
            more = reach | (reach << (length * take)) & mask
            if more != reach:
                steps.append((length, take, reach))
                reach = more
            left, k = left - take, k * 2
        if reach & target:
            break
    total = at = reach.bit_length() - 1
    used: dict[int, int] = defaultdict(int)
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            used[length] += take
            at -= length * take
    return total, dict(used)


class Planner:
    """Fills windows from a histogram of lengths."""

    def __init__(self, histogram: dict[int, int], size: int):
        self.size = size
        self.runs: dict[int, deque[Run]] = defaultdict(deque)
        self.counts: dict[int, int] = {}
        self.lengths: list[int] = []
        self.slots: list[Slot] = []
        self.windows = 0
        self.left = sum(k * v for k, v in histogram.items())
        for length, n in histogram.items():
            self._give(length, [Run(length, 0, n, 0)])

    def _give(self, length: int, runs: list[Run]) -> None:
        if length not in self.counts:
            self.counts[length] = 0
            insort(self.lengths, length)
        self.runs[length] += runs
        self.counts[length] += sum(r.last - r.first for r in runs)

    def _take(self, length: int, n: int) -> list[Run]:
        out, queue = [], self.runs[length]
        self.counts[length] -= n
        while n:
            run = queue.popleft()
            some = min(n, run.last - run.first)
            out.append(run._replace(last=run.first + some))
            if some < run.last - run.first:
                queue.appendleft(run._replace(first=run.first + some))
            n -= some
        if not self.counts[length]:
            del self.counts[length]
            self.lengths.remove(length)
        return out

    def _put(self, runs: list[Run], size: int, per: int, offset: int) -> None:
        number = 0
        for r in runs:
            self.slots.append(Slot(r.length, r.first, r.last, r.skip, size, number, per, self.windows, offset))
            number += r.last - r.first

    def fill(self, capacity: int, most: int) -> None:
        """Fill up to ``most`` windows of ``capacity`` in one and the same way."""
        used: dict[int, int] = {}
        at = bisect_right(self.lengths, capacity)
        total = 0
        if at:
            top = self.lengths[at - 1]
            self.counts[top] -= 1
            total, used = closest_fill(self.counts, self.lengths, capacity - top)
            self.counts[top] += 1
            used[top] = used.get(top, 0) + 1
            total += top
        slack, cut = capacity - total, None
        if slack:
            # what is left unused is longer than the gap, else it would be in
            cut = next(x for x in self.lengths[bisect_right(self.lengths, slack) :] if self.counts[x] > used.get(x, 0))
        needs = {x: n + (x == cut) for x, n in used.items()} | ({cut: 1} if cut and cut not in used else {})
        times = min([most, *(self.counts[x] // n for x, n in needs.items())])
        offset = 0
        for length, n in sorted(used.items(), reverse=True):
            self._put(self._take(length, n * times), length, n, offset)
            offset += n * length
        if cut:
            runs = self._take(cut, times)
            self._put(runs, slack, 1, offset)
            self._give(cut - slack, [r._replace(skip=r.skip + slack) for r in runs])
        self.windows += times
        self.left -= times * capacity

    def plan(self) -> list[Slot]:
        while self.left >= self.size:
            self.fill(self.size, self.left // self.size)
        while self.left:
            self.fill(1 << (self.left.bit_length() - 1), 1)
        return self.slots


def pieces_of(docs: DataFrame, tokenizer: str, size: int, end_id: int) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sha (of the text) of whole windows and remainders."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], "<u4")
        for batch in parts:
            rows: list[tuple] = []
            for some, texts in batches(batch.column(0).to_pylist(), batch.column(1).to_pylist(), 1 << 22):
                for doc_id, text, ids in zip(some, texts, enc.encode(texts), strict=True):
                    ids = np.append(ids, end).astype("<u4")
                    sha = hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()
                    rows += [(doc_id, at, min(size, len(ids) - at), zlib.crc32(ids[at : at + size].tobytes()), len(ids), sha) for at in range(0, len(ids), size)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.binary())], _NAMES)

    return texts_of(docs).mapInArrow(run, _PIECE)


def _ranked(pieces: DataFrame) -> DataFrame:
    """Pieces in order of (length, doc_id, start) with their part and their place among equal lengths of that part."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), defaultdict(int)
        for batch in parts:
            length = batch.column(2).to_numpy()
            place = np.zeros(len(length), np.int64)
            for x in np.unique(length):  # sorted, so each length is one run
                a, b = np.searchsorted(length, [x, x + 1])
                place[a:b] = seen[int(x)] + np.arange(b - a)
                seen[int(x)] += int(b - a)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(length), part, np.int32)), pa.array(place)], [*batch.schema.names, "part", "place"])

    ordered = pieces.repartitionByRange("length", "doc_id", "start").sortWithinPartitions("length", "doc_id", "start", "sha")
    return ordered.mapInArrow(run, f"{_PIECE}, part int, place long")


def pack(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 2) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    pieces, pieces_path = stage(pieces_of(docs, tokenizer, size, end_id), "pieces")
    ranked, ranked_path = stage(_ranked(pieces), "ranked")
    discard(spark, pieces_path)
    # a row for each part and length: sorted by length, so at most parts + lengths rows
    groups = sorted((r.length, r.part, r.n) for r in ranked.groupBy("length", "part").agg(F.count("*").alias("n")).collect())
    histogram: dict[int, int] = defaultdict(int)
    before: dict[tuple[int, int], int] = {}
    for length, part, n in groups:
        before[part, length] = histogram[length]
        histogram[length] += n
    slots: dict[int, list[Slot]] = defaultdict(list)
    for slot in Planner(dict(histogram), size).plan():
        slots[slot.length].append(slot)

    def place(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            length, part, at = (batch.column(c).to_numpy() for c in ("length", "part", "place"))
            rows, out = [], []
            for x, p in {*zip(length.tolist(), part.tolist(), strict=True)}:
                mine = np.flatnonzero((length == x) & (part == p))
                rank = at[mine] + before[p, x]
                order = np.argsort(rank)
                mine, rank = mine[order], rank[order]
                for s in slots[x]:
                    a, b = np.searchsorted(rank, [s.first, s.last])
                    if a < b:
                        j = rank[a:b] - s.first + s.number
                        rows.append(mine[a:b])
                        out.append(np.stack([np.full(b - a, s.skip), np.full(b - a, s.size), s.base + j // s.per, s.offset + j % s.per * s.size]))
            if rows:
                row, (skip, n, window, offset) = np.concatenate(rows), np.concatenate(out, axis=1)
                t = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([t.column("doc_id"), pa.array(t.column("start").to_numpy() + skip), pa.array(n), t.column("ids_crc32"), t.column("doc_tokens"), t.column("sha"), pa.array(window), pa.array(offset), pa.array(n != t.column("length").to_numpy())], [*_NAMES, "sequence_id", "offset", "cut"])

    placed, _ = stage(ranked.mapInArrow(place, f"{_PIECE}, sequence_id long, offset long, cut boolean"), "placed")
    discard(spark, ranked_path)
    # rows with one doc_id and one text have their cuts listed together
    cuts = placed.where("cut").groupBy("doc_id", "sha").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("cuts"))
    cuts, cuts_path = stage(cuts, "cuts")
    texts = texts_of(docs).withColumn("sha", F.unhex(F.sha2("text", 256)))
    near, _ = near_slots(texts, cuts, ["sha"])
    wanted = cuts.select(F.col("doc_id").alias("of"), F.col("sha").alias("of_sha"), "cuts").hint("merge")
    again = near.join(wanted, (F.col("sha") == F.col("of_sha")) & F.col("doc_id").eqNullSafe(F.col("of"))).select("doc_id", "text", "cuts")

    def recount(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], "<u4")
        for batch in parts:
            rows: list[tuple] = []
            for doc_id, text, pieces_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.append(enc.encode([text])[0], end).astype("<u4")
                rows += [(doc_id, c["start"], c["length"], zlib.crc32(ids[c["start"] : c["start"] + c["length"]].tobytes()), len(ids), c["sequence_id"], c["offset"]) for c in pieces_]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 7)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    kept = placed.where("NOT cut").drop("cut", "sha")
    # equal rows give each of their pieces once more
    counted, _ = stage(again.mapInArrow(recount, kept.schema).dropDuplicates(["sequence_id", "offset"]), "recounted")
    discard(spark, cuts_path)
    return kept.unionByName(counted)


def sequences(pieces: DataFrame, docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """sequence_id and the ids of each packed sequence, in order."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], np.uint32)
        for batch in parts:
            ids = [np.append(x, end) for x in enc.encode(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "ids"])

    ids = texts_of(docs).mapInArrow(run, "doc_id long, ids array<long>")
    parts = pieces.join(ids, "doc_id").select("sequence_id", "offset", F.slice("ids", F.col("start").cast("int") + 1, F.col("length").cast("int")).alias("ids"))
    return parts.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
