"""Token ids in Simple-8b words.

A word of 64 bits holds a selector in its top 4 bits and, in the other 60, as many ids
as fit at one width. Ids are cut into blocks of 1,024; each block begins on a word of
its own, whose offset is stored, so blocks decode independently and vectorised. An id
of more than 60 bits is an escape: it stands as 0 in the words and its position and
value are listed beside them.

The file format is a Parquet table of segments, in ascending doc_id order: part and
seq (their order), before (ids of the part before this segment), doc_ids, lengths,
words, block_words (words of each block) and escapes. A segment holds whole documents.

Edge cases: a null text is empty and so one end id; rows without doc_id come first;
rows that repeat a doc_id follow each other, ordered by a hash of their text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.llm.common import batches, scratch_path, texts_of
from evalweave.llm.units import encoder

# Simple-8b's fixed table: bits of an id, ids in a word, by selector.
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
COUNT = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BLOCK = 1024
SEGMENT = 1 << 19
_LIMITS = np.array([1 << int(b) for b in BITS[2:]], np.uint64)  # ids below it fit
_TABLED = np.uint64(1 << 20)
_NEED = (np.searchsorted(_LIMITS, np.arange(1 << 20), side="right") + 2).astype(np.int8)
_NEED[0] = 0
SCHEMA = "part int, seq int, before long, doc_ids array<long>, lengths array<long>, words binary, block_words array<int>, escape_at array<long>, escape_value array<decimal(20,0)>"


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, words of each block, positions of escapes, escaped ids."""
    ids = ids.astype(np.uint64)
    escape_at = np.flatnonzero(ids >> np.uint64(60))
    escaped = ids[escape_at]
    if len(escape_at):
        ids = ids.copy()
        ids[escape_at] = 0
    n = -(-len(ids) // BLOCK)
    words, sizes = [], []
    for at in range(0, n, 512):
        part = ids[at * BLOCK : (at + 512) * BLOCK]
        lanes = -(-len(part) // BLOCK)
        grid = np.zeros((lanes, BLOCK + int(COUNT[0])), np.uint64)
        flat = np.zeros(lanes * BLOCK, np.uint64)
        flat[: len(part)] = part
        grid[:, :BLOCK] = flat.reshape(lanes, BLOCK)
        length = np.minimum(BLOCK, len(part) - np.arange(lanes) * BLOCK)
        w, s = _encode_lanes(grid, length)
        words.append(w)
        sizes.append(s)
    return (np.concatenate(words) if words else np.zeros(0, np.uint64), np.concatenate(sizes) if sizes else np.zeros(0, np.int64), escape_at, escaped)


def _encode_lanes(grid: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All blocks at once: each takes the densest word that fits its next ids, until all are at their ends."""
    lanes, wide = grid.shape
    low = grid < _TABLED
    need = _NEED[np.where(low, grid, 0)]  # least selector that holds an id
    if not low.all():
        need[~low] = np.searchsorted(_LIMITS, grid[~low], side="right") + 2
    need = need.ravel()
    row, at = np.arange(lanes), np.zeros(lanes, np.int64)
    lane, place, chosen = [], [], []
    while len(row):
        base = row * wide + at
        pick = np.full(len(row), len(BITS) - 1)
        open_, most, taken = np.arange(len(row)), need[base], 1
        for s in range(len(BITS) - 2, -1, -1):
            here = base[open_]
            for j in range(taken, int(COUNT[s])):
                most = np.maximum(most, need[here + j])
            taken = int(COUNT[s])
            fits = most <= (s if s > 1 else 0)
            open_, most = open_[fits], most[fits]
            if not len(open_):
                break
            pick[open_] = s
        lane.append(row)
        place.append(at)
        chosen.append(pick)
        at = at + COUNT[pick]
        more = at < length[row]
        row, at = row[more], at[more]
    lane_of = np.concatenate(lane)
    order = np.argsort(lane_of.astype(np.uint16), kind="stable")
    lane_of, selector = lane_of[order], np.concatenate(chosen)[order]
    base = lane_of * wide + np.concatenate(place)[order]
    flat = grid.ravel()
    out = selector.astype(np.uint64) << np.uint64(60)
    for s in range(2, len(BITS)):
        mine = np.flatnonzero(selector == s)
        if len(mine):
            word, here = out[mine], base[mine]
            for j in range(int(COUNT[s])):
                word |= flat[here + j] << np.uint64(int(BITS[s]) * j)
            out[mine] = word
    return out, np.bincount(lane_of, minlength=lanes)


def decode(words: np.ndarray, block_words: np.ndarray, n: int, escape_at: np.ndarray, escaped: np.ndarray) -> np.ndarray:
    """The ``n`` ids; every selector is unpacked at once, each block on its own."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    count = COUNT[selector]
    block = np.repeat(np.arange(len(block_words)), block_words)
    first = np.concatenate([[0], np.cumsum(block_words)])[:-1].astype(np.int64)
    ends = np.cumsum(count)
    place = ends - count
    place = place - place[first][block] if len(words) else place
    out = np.zeros((len(block_words), BLOCK + int(COUNT[0])), np.uint64)
    for s in range(2, len(BITS)):
        mine = np.flatnonzero(selector == s)
        mask = np.uint64((1 << int(BITS[s])) - 1)
        for j in range(int(COUNT[s]) if len(mine) else 0):
            out[block[mine], place[mine] + j] = (words[mine] >> np.uint64(int(BITS[s]) * j)) & mask
    ids = np.ascontiguousarray(out[:, :BLOCK]).ravel()[:n]
    ids[escape_at] = escaped
    return ids


def _segment(part: int, seq: int, before: int, doc_ids: list, arrays: list[np.ndarray]) -> pa.RecordBatch:
    from decimal import Decimal

    words, sizes, at, escaped = encode(np.concatenate(arrays))
    kind = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("before", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("words", pa.binary()), ("block_words", pa.list_(pa.int32())), ("escape_at", pa.list_(pa.int64())), ("escape_value", pa.list_(pa.decimal128(20, 0)))])
    row = {"part": part, "seq": seq, "before": before, "doc_ids": doc_ids, "lengths": [len(a) for a in arrays], "words": words.astype("<u8").tobytes(), "block_words": sizes.tolist(), "escape_at": at.tolist(), "escape_value": [Decimal(int(v)) for v in escaped]}
    return pa.RecordBatch.from_pylist([row], schema=kind)


def write_ids(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0) -> None:
    """Encode every text, append ``end_id`` and write segments under ``path`` in ascending doc_id order."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], np.uint32)
        seq, before, held, ids, arrays = 0, 0, 0, [], []
        for batch in parts:
            for some, texts in batches(batch.column(0).to_pylist(), batch.column(1).to_pylist(), 1 << 22):
                for doc_id, raw in zip(some, enc.encode(texts), strict=True):
                    ids.append(doc_id)
                    arrays.append(np.append(raw, end))
                    held += len(arrays[-1])
                    if held >= SEGMENT:
                        yield _segment(part, seq, before, ids, arrays)
                        seq, before, held, ids, arrays = seq + 1, before + held, 0, [], []
        if ids:
            yield _segment(part, seq, before, ids, arrays)

    ordered = texts_of(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(run, SCHEMA).write.option("compression", "zstd").parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian unsigned 64-bit) of each document, from the files."""
    return _read(spark, path, "doc_id long, start long, n_tokens long, ids binary", lambda ids: {"ids": [i.astype("<u8").tobytes() for i in ids]})


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of little-endian unsigned 32-bit ids), from the files."""
    return _read(spark, path, "doc_id long, start long, n_tokens long, ids_crc32 long", lambda ids: {"ids_crc32": [zlib.crc32(i.astype("<u4").tobytes()) for i in ids]})


def _read(spark: SparkSession, path: str, schema: str, of) -> DataFrame:
    segments = spark.read.schema(SCHEMA).parquet(path)
    total = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    # a row for each part of the files: as many as there were write tasks
    parts = sorted(segments.groupBy("part").agg(F.sum(total)).collect())
    start = dict(zip((p for p, _ in parts), np.concatenate([[0], np.cumsum([n for _, n in parts])]).tolist(), strict=False))

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            for row in range(batch.num_rows):
                r = {k: batch.column(k)[row].as_py() for k in batch.schema.names}
                n = sum(r["lengths"])
                ids = decode(np.frombuffer(r["words"], "<u8"), np.array(r["block_words"], np.int64), n, np.array(r["escape_at"], np.int64), np.array([int(v) for v in r["escape_value"]], np.uint64))
                cut = np.cumsum([0, *r["lengths"]])
                first = start[r["part"]] + r["before"]
                out = {"doc_id": pa.array(r["doc_ids"], pa.int64()), "start": pa.array(cut[:-1] + first), "n_tokens": pa.array(r["lengths"], pa.int64())}
                out |= {k: pa.array(v) for k, v in of([ids[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]).items()}
                yield pa.RecordBatch.from_pydict(out)

    return segments.mapInArrow(run, schema)


def token_file(docs: DataFrame, tokenizer: str, end_id: int = 0, path: str | None = None) -> tuple[DataFrame, str]:
    """Write the ids of all documents and read their digests back; returns them and the files' place."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "ids")
    write_ids(docs, tokenizer, path, end_id)
    return read_digests(spark, path), path
