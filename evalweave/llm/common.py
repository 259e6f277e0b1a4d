"""What the operators share: input columns, scratch tables and word hashes.

Words are told apart by 128 bits. Of words of up to 16 bytes, those of equal length never
share these bits, since they are a permutation of the word's own bytes; longer words
have a BLAKE2b digest. Runs of words are hashed over both halves, pair by pair, each
step mixed, so that no arrangement of words cancels out.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.runtime import ship

_own_root: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own_root:
        _own_root.append("file://" + tempfile.mkdtemp(prefix="evalweave-"))
    return _own_root[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: lineage ends here, lost executors lose nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that nothing lazily planned still reads."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def texts_of(docs: DataFrame, keep_null: bool = False) -> DataFrame:
    """``doc_id`` and ``text`` alone, so that no other column can clash; a null text is empty unless kept."""
    ship(docs.sparkSession)
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (text if keep_null else F.coalesce(text, F.lit(""))).alias("text"))


def crc_fold(mod: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the decimal doc_id, modulo ``mod``; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % mod


def batches(ids: list, texts: list, most: int = 1 << 20) -> Iterator[tuple[list, list]]:
    """Runs of rows of about ``most`` characters; a longer text is a run of its own."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= most:
            yield ids[at : i + 1], texts[at : i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield ids[at:], texts[at:]


def packed(rows: DataFrame) -> DataFrame:
    """``row``, the whole input row, ``doc_id`` and ``text``: no name of the input can clash with those of an operator."""
    names = [F.col(f"`{c.replace('`', '``')}`") for c in rows.columns]
    return rows.select(F.struct(*names).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _slot(slots: int, *keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")


def near_slots(rows: DataFrame, keys: DataFrame, on: list[str], slots: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """Rows whose keys may be, and rows whose keys can't be, among ``keys``.

    The distinct hash slots of the keys are broadcast, at most ``slots`` of them whatever
    the corpus; nothing is shuffled.
    """
    wanted = F.broadcast(keys.select(_slot(slots, *on).alias("__slot")).distinct())
    keyed = rows.withColumn("__slot", _slot(slots, *on))
    return keyed.join(wanted, "__slot", "left_semi").drop("__slot"), keyed.join(wanted, "__slot", "left_anti").drop("__slot")


def without(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id isn't in ``ids``, rows without doc_id among them; a broadcast of hash slots settles most where they are."""
    ids = ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    unclear, clear = near_slots(packed(rows).select("row", "doc_id"), ids, ["doc_id"])
    return clear.unionByName(unclear.join(ids.hint("merge"), "doc_id", "left_anti")).select("row.*")


def only(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of a table with operator's own columns whose doc_id is in ``ids``.

    Hash slots drop most others before the shuffle; the ids grow with the corpus and are merged.
    """
    near, _ = near_slots(texts, ids, ["doc_id"])
    return near.join(ids.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")


# Words are runs of bytes other than these six.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Keeps the first 0 to 8 bytes of a little-endian number.
FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply), as in splitmix64; a permutation for every seed."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def runs(solid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of true begin, and their sizes; the last element is false."""
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(solid[:-1] & ~solid[1:]) + 1 - starts


def first_words(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first eight bytes of each run, and the next eight, as numbers; bytes beyond the run are 0."""
    padded = np.concatenate([buf, np.zeros(16, np.uint8)])
    eight = np.ndarray(len(buf) + 9, "<u8", padded, strides=(1,))
    return eight[starts] & FIRST_BYTES[np.minimum(sizes, 8)], eight[starts + 8] & FIRST_BYTES[np.clip(sizes - 8, 0, 8)]


def run_hashes(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """128 bits, as two rows of 64, of each run of bytes."""
    if not len(starts):
        return np.zeros((2, 0), np.uint64)
    a, b = first_words(buf, starts, sizes)
    with np.errstate(over="ignore"):
        size = mix(sizes.astype(np.uint64), 7)
        for turn in range(2):  # four rounds of a Feistel network
            a ^= mix(b + size, 2 * turn)
            b ^= mix(a + size, 2 * turn + 1)
    out = np.stack([a, b])
    for i in np.flatnonzero(sizes > 16).tolist():
        out[:, i] = np.frombuffer(hashlib.blake2b(buf[starts[i] : starts[i] + sizes[i]].tobytes(), digest_size=16).digest(), "<u8")
    return out


def word_batches(texts: list[str], lower: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes (two rows) of all words of some texts in a row, and where each text's words begin and the last one's end.

    Memory follows the longest text.
    """
    for _, part in batches(texts, texts):
        raw = [t.encode("utf-8", "surrogatepass") for t in part]
        joined = b"\n".join(raw) + b"\n"
        if lower:
            joined = joined.lower()
        buf = np.frombuffer(joined, np.uint8)
        starts, sizes = runs(~SPACE[buf])
        ends = np.cumsum([len(r) + 1 for r in raw])
        yield run_hashes(buf, starts, sizes), np.concatenate([[0], np.searchsorted(starts, ends)])


def hashed_words(texts: list[str], lower: bool = False) -> Iterator[np.ndarray]:
    """For each text the hashes of its words, in order, as two rows."""
    for hashes, cuts in word_batches(texts, lower):
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield hashes[:, a:b]


def _joined(x: np.ndarray, y: np.ndarray, step: int) -> np.ndarray:
    """Hash of one run of words followed by another."""
    with np.errstate(over="ignore"):
        return mix((x * _ODD) ^ (y << np.uint64(32) | y >> np.uint64(32)), step)


def doubled(words: np.ndarray, step: int) -> np.ndarray:
    """From hashes of runs of 2 ** step words those of twice as many."""
    n = 1 << step
    return _joined(words[:-n], words[n:], step) if len(words) > n else words[:0]


def windows_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words from one row of hashes; empty if there are fewer."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out, total, level, step = None, 0, words, 0
    while n >> step:
        if n >> step & 1:
            total += 1 << step
            many = len(words) - total + 1
            # larger runs come first in a window
            out = level if out is None else _joined(level[:many], out[1 << step :][:many], 64 + step)
        level, step = doubled(level, step), step + 1
    return out


def spans_hash(words: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hash of each span of words: of the two longest runs of 2 ** k words that begin and end it, which cover it."""
    out = np.zeros(len(first), np.uint64)
    size = np.frexp(length.astype(float))[1] - 1
    level = words
    for k in range(int(size.max(initial=-1)) + 1):
        mine = np.flatnonzero(size == k)
        if len(mine):
            out[mine] = mix(_joined(level[first[mine]], level[first[mine] + length[mine] - (1 << k)], 128 + k) ^ mix(length[mine].astype(np.uint64), 5))
        level = doubled(level, k)
    return out
