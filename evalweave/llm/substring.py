"""Repeated passages by a log-structured fingerprint index.

The fingerprint of a window of ``window`` words is the least hash of its shorter grams,
so windows with equal words have equal fingerprints, and neighbouring windows mostly
share one. Each stretch of windows with one fingerprint is an entry: the fingerprint, a
128-bit hash of the words of the whole stretch (its context), and where it lies.

The index is a log of immutable sorted runs in a folder that outlives a session. A run
is two bucketed tables: the contexts, each with its smallest document and a place there,
dealt by the whole key, so that a hot passage with many contexts fills no bucket; and
one row for each fingerprint that tells whether it has several contexts. A new batch of
documents is dealt into the same buckets and merge-joined with every run; what the log
holds does not move:

* a context that an earlier document has too settles all its windows at once;
* for a fingerprint with several contexts, one document of each is read again, and the
  128-bit hashes of its windows are compared: this verifies every partial overlap. Only
  those rows of the log leave their buckets.

Then the batch becomes a run. While there are more than ``fanout`` runs, the two smallest
are merged into one, bucket by bucket, again without a shuffle. Copies and shared passages meet as one entry each, so hot passages are aggregated before any
shuffle, and joins on hot keys have plain exchanges that adaptive execution splits.

Edge cases: null, empty and short texts have no window and lose nothing; rows without
doc_id are neither compared nor cut; rows that repeat a doc_id are one document, none a
source for the other; stretches found in one are cut at their places from each one's
own text.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalweave.llm.common import discard, near_slots, only, packed, scratch_path, spans_hash, stage, texts_of, windows_hash, without, word_batches
from evalweave.llm.units import forget

GRAM = 16
_KEY = ["fp", "c1", "c2", "n"]
_ENTRY = "array<struct<at:int,n:int,fp:long,c1:long,c2:long>>"
_TABLES = {"contexts": ("fp BIGINT, c1 BIGINT, c2 BIGINT, n INT, at INT, doc_id BIGINT, last BIGINT", _KEY), "prints": ("fp BIGINT, a1 BIGINT, z1 BIGINT, a2 BIGINT, z2 BIGINT, lo BIGINT, hi BIGINT", ["fp"])}


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\x20\x09-\x0D]+``."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each ``width`` neighbours, by doubling."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def entries(words: np.ndarray, cuts: np.ndarray, window: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Text's number, at, n, fp, c1, c2 of each stretch of windows with one fingerprint, of texts in a row.

    ``words`` are two rows of hashes; ``cuts`` tells where each text's words begin and the last one's end.
    """
    gram = min(gram, window)
    if words.shape[1] < window:
        return (np.zeros(0, np.int64),) * 6
    text = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    least = _sliding_min(windows_hash(words[0], gram), window - gram + 1)
    text = np.where(text[: len(least)] == text[window - 1 :], text[: len(least)], -1)  # else the window leaves its text
    begins = text >= 0
    begins[1:] &= (text[1:] != text[:-1]) | (least[1:] != least[:-1])
    at = np.flatnonzero(begins)
    of = text[at]
    n = np.minimum(np.append(at[1:], len(least)), cuts[of + 1] - window + 1) - at
    length = n + window - 1
    return of, at - cuts[of], n, least[at].view(np.int64), *(spans_hash(row, at, length).view(np.int64) for row in words)


def fingerprints(texts: DataFrame, window: int) -> DataFrame:
    """doc_id, n_words, sha256 of the words joined by spaces, and the entries of each text."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in parts:
            texts_, done = batch.column(1).to_pylist(), 0
            for words, cuts in word_batches(texts_):
                some = len(cuts) - 1
                sha = [hashlib.sha256(b" ".join(words_of(t))).hexdigest() for t in texts_[done : done + some]]
                of, at, n, fp, c1, c2 = entries(words, cuts, window)
                rows = pa.StructArray.from_arrays([pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(fp), pa.array(c1), pa.array(c2)], ["at", "n", "fp", "c1", "c2"])
                sizes = np.searchsorted(of, np.arange(some + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, some), pa.array(np.diff(cuts).astype(np.int64)), pa.array(sha, pa.string()), pa.ListArray.from_arrays(pa.array(sizes), rows)], ["doc_id", "n_words", "sha", "entries"])
                done += some

    return texts.mapInArrow(run, f"doc_id long, n_words long, sha string, entries {_ENTRY}")


def _spans(column: pa.ListArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """at and n of each row's list of structs, as arrays."""
    cuts = column.offsets.to_numpy()
    at, n = (column.values.field(i).to_numpy() for i in (0, 1))
    return [(at[x:y], n[x:y]) for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def _covered(spans: tuple[np.ndarray, np.ndarray], size: int, more: int = 0) -> np.ndarray:
    """Which of ``size`` places lie in a span, each ``more`` longer; a shorter text of the same doc_id may end before one."""
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, np.minimum(spans[0], size), 1)
    np.add.at(edge, np.minimum(spans[0] + spans[1] + more, size), -1)
    return np.cumsum(edge[:-1]) > 0


def _windows(texts: DataFrame, window: int) -> DataFrame:
    """doc_id, at, w1, w2 of every window that lies in a listed stretch, or has the same words as one that does."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in parts:
            spans, done = _spans(batch.column(2)), 0
            ids = batch.column(0).to_pylist()
            for words, cuts in word_batches(batch.column(1).to_pylist()):
                w1, w2 = windows_hash(words[0], window), windows_hash(words[1], window)
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    most = max(b - a - window + 1, 0)
                    h = w1[a : a + most]
                    at = np.flatnonzero(np.isin(h, h[_covered(spans[done], most)]))
                    if len(at):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), ids[done], np.int64)), pa.array(at.astype(np.int32)), pa.array(h[at].view(np.int64)), pa.array(w2[a + at].view(np.int64))], ["doc_id", "at", "w1", "w2"])
                    done += 1

    return texts.mapInArrow(run, "doc_id long, at int, w1 long, w2 long")


class FingerprintIndex:
    """The log at ``path``: opened if one is there, else begun.

    A manifest names the runs, the number of buckets and the largest doc_id. It is
    written anew under the next number after each change, once all files are there, and
    the old one then goes: a job that fails leaves the log as it was.
    """

    def __init__(self, spark: SparkSession, path: str, window: int = 50, fanout: int = 4):
        self.spark, self.path, self.fanout = spark, path.rstrip("/"), fanout
        self.scratch: list[str] = []
        self.marks: list[str] = []
        self.tables: dict[str, str] = {}
        old = self._manifests()
        if old:
            with_ = json.loads(self._read(old[-1]))
            if with_["window"] != window:
                raise ValueError(f"this log is of windows of {with_['window']} words")
            self.state = with_
        else:
            self.state = {"number": 0, "window": window, "buckets": int(spark.conf.get("spark.sql.shuffle.partitions")), "last": None, "runs": {}}

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _manifests(self) -> list[str]:
        fs = self._fs()
        there = fs.listStatus(self._at("")) if fs.exists(self._at("")) else []
        return sorted(n for n in (f.getPath().getName() for f in there) if n.startswith("manifest-") and n.endswith(".json"))

    def _read(self, name: str) -> str:
        return self.spark.read.text(f"{self.path}/{name}", wholetext=True).first()[0]

    def _commit(self, runs: dict[str, int], last: int | None) -> None:
        old = self._manifests()
        self.state = {**self.state, "number": self.state["number"] + 1, "last": last, "runs": runs}
        name, fs = f"manifest-{self.state['number']:08d}.json", self._fs()
        out = fs.create(self._at(f"_{name}"), True)
        out.write(bytearray(json.dumps(self.state).encode()))
        out.close()
        fs.rename(self._at(f"_{name}"), self._at(name))
        for gone in old:
            fs.delete(self._at(gone), False)

    def table(self, run: str, kind: str) -> DataFrame:
        """One of a run's two tables, with its buckets."""
        name = f"{run}_{kind}"
        if name not in self.tables:
            columns, key = _TABLES[kind]
            self.tables[name] = f"{name}_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {self.tables[name]} ({columns}) USING parquet CLUSTERED BY ({', '.join(key)}) SORTED BY ({', '.join(key)}) INTO {self.state['buckets']} BUCKETS LOCATION '{self.path}/{run}/{kind}'")
        return self.spark.table(self.tables[name])

    def runs(self, kind: str) -> list[DataFrame]:
        return [self.table(r, kind) for r in self.state["runs"]]

    def _write(self, run: str, kind: str, rows: DataFrame, placed: bool = False) -> DataFrame:
        """Rows grouped by the table's key, into its buckets; ``placed``: they come from buckets."""
        key, buckets, name = _TABLES[kind][1], self.state["buckets"], f"{run}_{kind}"
        if not placed and int(self.spark.conf.get("spark.sql.shuffle.partitions")) != buckets:
            rows = rows.repartition(buckets, *key)  # else the grouping has dealt them just so
        self.tables[name] = f"{name}_{uuid.uuid4().hex}"
        rows.write.format("parquet").option("compression", "zstd").option("path", f"{self.path}/{run}/{kind}").bucketBy(buckets, *key).sortBy(*key).saveAsTable(self.tables[name])
        return self.table(run, kind)

    def _stage(self, df: DataFrame, name: str) -> DataFrame:
        out, path = stage(df, name)
        self.scratch.append(path)
        return out

    def close(self, log: bool = False) -> None:
        """Delete scratch tables, and the log too if asked; names of tables leave the session, their files stay."""
        for name in self.tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        discard(self.spark, *self.scratch, *self.marks, *([self.path] if log else []))
        self.scratch, self.marks, self.tables = [], [], {}

    def _forget(self, run: str) -> None:
        for kind in _TABLES:
            if name := self.tables.pop(f"{run}_{kind}", None):
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        discard(self.spark, f"{self.path}/{run}")

    def merged(self, one: str, two: str, kind: str) -> DataFrame:
        """Two runs' rows by key: a merge join in place. (Spark 4.1 groups a union of bucketed tables wrongly, so none is made.)"""
        columns, key = [c.split()[0] for c in _TABLES[kind][0].split(", ")], _TABLES[kind][1]
        values = [c for c in columns if c not in key]
        a, b = (self.table(run, kind).select(*key, *(F.col(c).alias(f"{side}{c}") for c in values)) for side, run in (("a_", one), ("b_", two)))
        low = {"a1", "a2", "lo", "doc_id"}
        out = {c: (F.least if c in low else F.greatest)(f"a_{c}", f"b_{c}") for c in values}
        if "at" in out:
            out["at"] = F.when(F.col("b_doc_id").isNull() | (F.col("a_doc_id") <= F.col("b_doc_id")), F.col("a_at")).otherwise(F.col("b_at"))
        return a.join(b.hint("merge"), key, "full").select(*key, *(c.alias(n) for n, c in out.items())).select(*columns)

    def compact(self) -> None:
        """Merge the two smallest runs; they go once the new one is written and the manifest names it."""
        one, two = sorted(self.state["runs"], key=self.state["runs"].get)[:2]
        run = f"run_{uuid.uuid4().hex}"
        for kind in _TABLES:
            self._write(run, kind, self.merged(one, two, kind), placed=True)
        left = {r: n for r, n in self.state["runs"].items() if r not in (one, two)}
        self._commit(left | {run: self.table(run, "contexts").count()}, self.state["last"])
        for r in (one, two):
            self._forget(r)

    def add_batch(self, batch: DataFrame, texts: DataFrame) -> DataFrame:
        """Stretches (doc_id, at, n) of the batch's windows that a smaller doc_id has too; then the batch joins the log.

        ``batch`` are entries (doc_id, at, n, fp, c1, c2), all with larger doc_ids than what
        the log holds; ``texts`` are the documents of the batch and of the log.
        """
        window, run = self.state["window"], f"run_{uuid.uuid4().hex}"
        own = batch.groupBy(*_KEY).agg(F.min_by("at", "doc_id").alias("at"), F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last"))
        own = self._write(run, "contexts", own)
        lowest, highest, size = own.agg(F.min("doc_id"), F.max("last"), F.count("*")).first()
        if lowest is None:
            self._forget(run)
            return self.spark.createDataFrame([], "doc_id long, at int, n int")
        if self.state["last"] is not None and lowest <= self.state["last"]:
            self._forget(run)
            raise ValueError(f"doc_id {lowest} isn't above the log's last, {self.state['last']}")
        # merge joins within buckets: neither side moves
        met = own
        for i, past in enumerate(self.runs("contexts")):
            met = met.join(past.select(*_KEY, F.col("doc_id").alias(f"p{i}")).hint("merge"), _KEY, "left")
        past = [F.col(f"p{i}") for i in range(len(self.state["runs"]))]
        known = met.select(*_KEY, "at", "doc_id", "last", (F.least("doc_id", *past) if past else F.col("doc_id")).alias("first"))
        known = self._stage(known, "fp-known")
        shared = known.where("first < last").select(*_KEY, "first")
        whole = batch.join(shared.hint("merge"), _KEY).where("doc_id > first").select("doc_id", "at", "n")

        prints = own.withColumns({"a1": F.col("c1"), "z1": F.col("c1"), "a2": F.col("c2"), "z2": F.col("c2"), "lo": F.col("doc_id"), "hi": F.col("doc_id")}).groupBy("fp").agg(*_bounds())
        both = self._write(run, "prints", prints)
        for older in self.runs("prints"):
            other = older.select("fp", *(F.col(c).alias(f"_{c}") for c in ("a1", "z1", "a2", "z2", "lo", "hi")))
            both = both.join(other.hint("merge"), "fp", "left").select("fp", *(F.least(c, f"_{c}").alias(c) if c in ("a1", "a2", "lo") else F.greatest(c, f"_{c}").alias(c) for c in ("a1", "z1", "a2", "z2", "lo", "hi")))
        several = self._stage(both.where("(a1 < z1 OR a2 < z2) AND lo < hi").select("fp"), "fp-several")
        # a context that the log has too is read where the log has it
        sources = [known.where("first = doc_id"), *(self.spark.read.schema(_TABLES["contexts"][0]).parquet(f"{self.path}/{r}/contexts") for r in self.state["runs"])]
        open_ = reduce(DataFrame.unionByName, [near_slots(s.select(*_KEY, "doc_id", "at"), several, ["fp"])[0] for s in sources])
        # written, so that adaptive execution may split a fingerprint with many contexts; then dealt by the whole key
        open_ = self._stage(open_.join(several.hint("merge"), "fp"), "fp-contexts")
        open_ = open_.groupBy(*_KEY).agg(F.min_by("at", "doc_id").alias("at"), F.min("doc_id").alias("doc_id"))
        open_ = open_.groupBy("doc_id").agg(F.collect_list(F.struct("at", "n")).alias("spans"))
        open_ = self._stage(open_, "fp-open")
        read = only(texts, open_).join(open_.hint("merge"), "doc_id").select("doc_id", "text", "spans")
        windows = self._stage(_windows(read, window), "windows")
        first = self._stage(windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last"), "windows-first")
        part = windows.join(first.hint("merge"), ["w1", "w2"]).where("doc_id > first").select("doc_id", "at", F.lit(1).alias("n"))
        # marks of documents already in the log were given with their own batch
        marks, path = stage(whole.unionByName(part.where(F.col("doc_id") >= F.lit(lowest))), "marks")
        discard(self.spark, *self.scratch)
        self.scratch = []
        self.marks.append(path)
        self._commit(self.state["runs"] | {run: size}, highest)
        while len(self.state["runs"]) > self.fanout:
            self.compact()
        return marks


def _bounds() -> list[Column]:
    return [*(F.min(c).alias(c) for c in ("a1", "a2", "lo")), *(F.max(c).alias(c) for c in ("z1", "z2", "hi"))]


def _kept(text: str | None, marks: tuple[np.ndarray, np.ndarray], window: int) -> tuple[list[bytes], int]:
    """The words outside of marked windows, and the number of all words."""
    words = words_of(text)
    return [words[i] for i in np.flatnonzero(~_covered(marks, len(words), window - 1)).tolist()], len(words)


def _cut(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, n_words, n_removed, kept text of documents with marks."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in parts:
            out: dict[str, list] = {"doc_id": batch.column(0).to_pylist(), "n_words": [], "n_removed": [], "kept": []}
            for text, marks in zip(batch.column(1).to_pylist(), _spans(batch.column(2)), strict=True):
                keep, n = _kept(text, marks, window)
                out["n_words"].append(n)
                out["n_removed"].append(n - len(keep))
                out["kept"].append(b" ".join(keep).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_pydict(out, pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())]))

    return docs.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def _joined_marks(marks: DataFrame) -> DataFrame:
    """(doc_id, marks): each document's stretches, those that touch joined, so that a repeated passage is one; one shuffle, by doc_id."""
    w = Window.partitionBy("doc_id").orderBy("at", "n")
    before = F.max(F.col("at") + F.col("n")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = marks.withColumn("new", F.coalesce(F.col("at") > before, F.lit(True)).cast("int"))
    numbered = fresh.withColumn("part", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = numbered.groupBy("doc_id", "part").agg(F.min("at").alias("at"), F.max(F.col("at") + F.col("n")).alias("end"))
    return parts.groupBy("doc_id").agg(F.collect_list(F.struct("at", (F.col("end") - F.col("at")).alias("n"))).alias("marks"))


def _marked(docs: DataFrame, window: int, batches: int, fanout: int, log: str | None, history: DataFrame | None) -> tuple[DataFrame, DataFrame, str]:
    """(doc_id, marks) of documents with a marked window; the facts of every row, and where these are staged."""
    spark = docs.sparkSession
    texts = texts_of(docs)
    cuts = sorted({int(c) for c in texts.select("doc_id").where("doc_id IS NOT NULL").approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01)}) if batches > 1 else []
    number = F.when(F.col("doc_id").isNull(), -1)
    for i, c in enumerate(cuts):
        number = number.when(F.col("doc_id") <= c, i)
    facts_path = scratch_path(spark, "fingerprints")
    fingerprints(texts, window).withColumn("batch", number.otherwise(len(cuts)).cast("int")).write.option("compression", "zstd").partitionBy("batch").parquet(facts_path)
    facts = spark.read.schema(f"doc_id long, n_words long, sha string, entries {_ENTRY}, batch int").parquet(facts_path)
    index, marks = FingerprintIndex(spark, log or scratch_path(spark, "log"), window, fanout), None
    known = texts if history is None else texts.unionByName(texts_of(history))
    for i in range(len(cuts) + 1):
        upto = F.lit(True) if i == len(cuts) else F.col("doc_id") <= cuts[i]
        found = index.add_batch(facts.where(F.col("batch") == i).select("doc_id", F.inline("entries")), known.where(upto))
        marks = found if marks is None else marks.unionByName(found)
    spans, _ = stage(_joined_marks(marks), "marked")
    index.close(log=log is None)
    return spans, facts, facts_path


def repeated_passages(docs: DataFrame, window: int = 50, batches: int = 4, fanout: int = 2, log: str | None = None, history: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What stays of documents that lose words, and the facts of all.

    Returns (doc_id, n_words, n_removed, kept text) of documents with a marked window, and
    (doc_id, n_words, sha256 of all words) of every row. With ``log``, a folder that all
    machines share, the index stays there, and a later call with larger doc_ids is held
    against it; ``history`` are the documents that the log has seen.
    """
    spans, facts, facts_path = _marked(docs, window, batches, fanout, log, history)
    cut = _cut(only(texts_of(docs), spans).join(spans.hint("merge"), "doc_id").select("doc_id", "text", "marks"), window)
    cut, _ = stage(cut, "cut")
    rest, _ = stage(facts.select("doc_id", "n_words", "sha"), "facts")
    discard(docs.sparkSession, facts_path)
    return cut, rest


def substring_digests(docs: DataFrame, window: int = 50, batches: int = 4, fanout: int = 2, log: str | None = None, history: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    cut, facts = repeated_passages(docs, window, batches, fanout, log, history)
    cut = cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    rest = facts.join(cut.select("doc_id").distinct(), "doc_id", "left_anti")
    return cut.unionByName(rest.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256")))


def drop_passages(docs: DataFrame, window: int = 50, batches: int = 4, fanout: int = 2, log: str | None = None, history: DataFrame | None = None) -> DataFrame:
    """All rows of ``docs`` with all their columns; texts that lose words are their kept words joined by spaces.

    A column n_chars follows the new texts.
    """
    spans, _, facts_path = _marked(docs, window, batches, fanout, log, history)
    discard(docs.sparkSession, facts_path)

    @F.arrow_udf("string")
    def cut(texts: pa.Array, marks: pa.Array) -> pa.Array:
        out = []
        for text, some in zip(texts.to_pylist(), _spans(marks), strict=True):
            keep, n = _kept(text, some, window)
            out.append(text if len(keep) == n else b" ".join(keep).decode("utf-8", "surrogatepass"))
        return pa.array(out, pa.string())

    # each row's own text is cut: rows that share a doc_id may differ in it
    changed = only(packed(docs), spans).join(spans.hint("merge"), "doc_id").withColumn("kept", cut("text", "marks"))
    row = F.col("row").withField("text", F.col("kept"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        row = row.withField("n_chars", F.when(F.col("kept").eqNullSafe(F.col("text")), F.col("row.n_chars")).otherwise(F.length("kept").cast(kind)))
    return without(docs, spans).unionByName(changed.select(row.alias("row")).select("row.*"))
