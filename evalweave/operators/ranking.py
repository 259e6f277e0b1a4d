"""Caps, splits, chunks and folds over ordered rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalweave.sources.scratch import staged


def hash_order(key: str, seed: int = 0) -> Column:
    """A repeatable shuffle: rows by a salted hash of their key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def numbered(rows: DataFrame, order: list[str | Column], name: str, parts: int | None = None, by: list[str] | None = None) -> DataFrame:
    """Adds the place, from 0, of each row in one order over all rows, or over those of equal ``by``.

    Rows are dealt to ranges of (by, order) and written with their range's number: sampled
    bounds differ from run to run, so what is counted must be what is numbered. Then they
    are numbered within each range, and what lies before it is added: a table with a row
    for each range and group in it. A hot group spreads over many ranges. ``order`` should
    tell all rows apart.
    """
    by, keys = by or [], [f"__g{i}" for i in range(len(by or []))]
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    spread_ = [*(F.col(b) for b in by), *order]
    dealt = rows.repartitionByRange(parts, *spread_) if parts else rows.repartitionByRange(*spread_)
    dealt = staged(dealt.withColumn("__p", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("__p", *(F.col(b).alias(k) for b, k in zip(by, keys, strict=True))).agg(F.count("*").alias("__c"))
    counts = staged(counts, "range-counts")
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(F.col("__p").alias("__q"), *keys, F.coalesce(F.sum("__c").over(earlier), F.lit(0)).alias("__before"))
    same = F.col("__p") == F.col("__q")
    for b, k in zip(by, keys, strict=True):
        same = same & F.col(b).eqNullSafe(F.col(k))
    place = F.row_number().over(Window.partitionBy("__p", *by).orderBy(*order)) - 1
    return dealt.withColumn("__n", place).join(before, same).withColumn(name, (F.col("__before") + F.col("__n")).cast("long")).select(*rows.columns, name)


def capped(rows: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each group; the optimiser cuts groups before the shuffle."""
    return rows.withColumn("__capped", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__capped") <= most).drop("__capped")


def exact_fraction(rows: DataFrame, by: str, order: list[Column], fraction: float) -> DataFrame:
    """Marks the first round(n * fraction) rows of each group, halves to even."""
    counts = staged(rows.groupBy(by).agg(F.rint(F.count("*") * fraction).alias("__most")), "group-counts")
    placed = numbered(rows, order, "__place", by=[by]).withColumnRenamed(by, "__by")
    out = placed.join(counts, F.col("__by").eqNullSafe(F.col(by)))
    return out.withColumn("picked", F.col("__place") < F.col("__most")).select(*rows.columns, "picked")


def split_counts(rows: DataFrame, by: str, order: list[Column], test: int, train: int) -> DataFrame:
    """``split`` by group: the first ``test`` rows, the next ``train`` rows, the rest is validation."""
    n = F.col("__place")
    return numbered(rows, order, "__place", by=[by]).withColumn("split", F.when(n < test, "test").when(n < test + train, "train").otherwise("val")).drop("__place")


def split_fraction(rows: DataFrame, key: str, fraction: float, seed: int = 0) -> DataFrame:
    """``split``: max(1, int(n * fraction)) rows, first in hash order, are validation; disjoint from training.

    The hashes alone are numbered, to find the threshold; then it is one comparison a row.
    """
    k = max(1, int(rows.count() * fraction))
    h = hash_order(key, seed)
    edge = numbered(rows.select(h.alias("h")), ["h"], "place").where(F.col("place") == k - 1).select(F.col("h").alias("__edge"))
    return rows.join(F.broadcast(edge), how="cross").withColumn("split", F.when(h <= F.col("__edge"), "val").otherwise("train")).drop("__edge")


def equal_parts(place: Column, total: Column, parts: int) -> Column:
    """Part of a place counted from 0: parts of equal whole size, what is over goes to the last."""
    size = F.greatest(F.lit(1), F.floor(total / parts))
    return F.least(F.lit(parts - 1), F.floor(place / size)).cast("int")


def block_interleaved(rows: DataFrame, source: str, order: list[Column], size: int) -> DataFrame:
    """``block`` and ``slot`` that deal the sources in turn, ``size`` rows a block; a source's last partial block goes.

    Sources are few: their names and counts are a small table.
    """
    sources = rows.select(source).distinct().withColumn("__s", F.row_number().over(Window.orderBy(source)) - 1)
    counts = rows.groupBy(source).agg(F.floor(F.count("*") / size).alias("__full"))
    width = sources.count()
    placed = numbered(rows, order, "__n", by=[source]).join(F.broadcast(sources), source).join(F.broadcast(counts), source).where(F.floor(F.col("__n") / size) < F.col("__full"))
    return placed.withColumns({"block": (F.floor(F.col("__n") / size) * width + F.col("__s")).cast("long"), "slot": (F.col("__n") % size).cast("long")}).drop("__n", "__s", "__full")


def first_success(attempts: DataFrame, key: str, attempt: str, ok: str, value: str) -> DataFrame:
    """The value of the first good attempt, else of the last one, and whether it was good."""
    good = F.min_by(F.struct(attempt, value), F.when(F.col(ok), F.col(attempt)))
    last = F.max_by(F.struct(attempt, value), F.col(attempt))
    out = attempts.groupBy(key).agg(F.bool_or(ok).alias("succeeded"), good.alias("g"), last.alias("l"))
    used = F.when(F.col("succeeded"), F.col("g")).otherwise(F.col("l"))
    return out.select(key, "succeeded", used[attempt].alias(attempt), used[value].alias(value))


def kept_changes(rows: DataFrame, by: str, order: str, score: str, threshold: float, least: int) -> DataFrame:
    """The first row of each group and those whose change score passes; with under ``least`` of them, ``least`` evenly spaced rows instead."""
    w = Window.partitionBy(by)
    n, at = F.count("*").over(w), F.row_number().over(w.orderBy(order)) - 1
    marked = rows.withColumns({"__n": n, "__at": at}).withColumn("__hit", (F.col("__at") == 0) | (F.col(score) > threshold))
    marked = marked.withColumn("__kept", F.sum(F.col("__hit").cast("int")).over(w))
    few = F.col("__kept") < F.least(F.lit(least), F.col("__n"))
    step = (F.col("__n") - 1) / max(1, least - 1)
    even = F.exists(F.sequence(F.lit(0), F.lit(least - 1)), lambda i: F.rint(i * step) == F.col("__at"))
    return marked.where(F.when(few, even).otherwise(F.col("__hit"))).drop("__n", "__at", "__hit", "__kept")


def filled_gaps(rows: DataFrame, by: str, start: str, end: str, longest: float) -> DataFrame:
    """The intervals that lie between consecutive rows of a group, cut every ``longest``."""
    before = F.max(end).over(Window.partitionBy(by).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1))
    gaps = rows.withColumn("__from", before).where(F.col("__from") < F.col(start))
    n = F.ceil((F.col(start) - F.col("__from")) / longest).cast("int")
    return gaps.select(by, F.col("__from").alias("f"), F.col(start).alias("t"), F.explode(F.sequence(F.lit(0), n - 1)).alias("i")).select(by, (F.col("f") + F.col("i") * longest).alias(start), F.least(F.col("t"), F.col("f") + (F.col("i") + 1) * longest).alias(end))


def islands(rows: DataFrame, by: str, start: str, end: str) -> DataFrame:
    """(by, start, end): the intervals of a group, those that overlap or touch joined. Windows keep a running end, never a group's rows."""
    w = Window.partitionBy(by).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = rows.select(by, start, end).withColumn("__new", F.coalesce(F.col(start) > before, F.lit(True)).cast("int"))
    numbered_ = fresh.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered_.groupBy(by, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def set_iou(a: DataFrame, b: DataFrame, by: str, width: float) -> DataFrame:
    """(by, iou) of two sets of intervals (by, start, end) a group: shared over covered length, 0 if nothing is covered.

    The islands of both sets meet in buckets of ``width``.
    """
    from evalweave.operators.joins import range_join

    a, b = islands(a, by, "start", "end"), islands(b, by, "start", "end")
    a, b = staged(a, "islands"), staged(b, "islands")
    other = b.select(by, F.col("start").alias("__t"), F.col("end").alias("__f"))
    meet = range_join(a, other, [by], ("start", "end"), ("__t", "__f"), width)
    shared = meet.groupBy(by).agg(F.sum(F.least("end", "__f") - F.greatest("start", "__t")).alias("__shared"))
    total = a.unionByName(b).groupBy(by).agg(F.sum(F.col("end") - F.col("start")).alias("__total"))
    both, x = total.join(shared, by, "left"), F.coalesce("__shared", F.lit(0.0))
    return both.select(by, F.coalesce(F.try_divide(x, F.col("__total") - x), F.lit(0.0)).alias("iou"))


def streamed(rows: DataFrame, by: list[str], order: list[str], schema: str, begin: Callable[[], object], step: Callable[[object, dict], tuple[object, list[tuple]]], end: Callable[[object], list[tuple]]) -> DataFrame:
    """A fold along each group in order, whose output rows are (by …, what ``step`` and ``end`` give).

    Groups are dealt and sorted by Spark, which spills; the worker holds one batch and one
    state, so a group of any length fits.
    """
    from evalweave.runtime import ship

    ship(rows.sparkSession)
    dealt = rows.repartition(*by).sortWithinPartitions(*by, *order)
    columns = rows.columns

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, first = None, None, True
        kinds = None
        for batch in parts:
            out: list[tuple] = []
            for row in batch.to_pylist():
                now = tuple(row[b] for b in by)
                if first or now != key:
                    if not first:
                        out += [(*key, *x) for x in end(state)]
                    key, state, first = now, begin(), False
                state, made = step(state, {c: row[c] for c in columns})
                out += [(*key, *x) for x in made]
            kinds = [batch.schema.field(b).type for b in by]
            yield _batch(out, kinds)
        if not first:
            yield _batch([(*key, *x) for x in end(state)], kinds)

    names = [*by, *(c.split()[0] for c in schema.split(", "))]
    arrow = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}
    more = [arrow[c.split()[1]] for c in schema.split(", ")]

    def _batch(out: list[tuple], kinds: list) -> pa.RecordBatch:
        columns_ = list(zip(*out, strict=True)) if out else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns_, [*kinds, *more], strict=True)], names)

    types = ", ".join(f"`{b}` {rows.schema[b].dataType.simpleString()}" for b in by)
    return dealt.mapInArrow(run, f"{types}, {schema}")


def gap_merged(rows: DataFrame, by: str, point: str, least: float) -> DataFrame:
    """(by, kept): a group's points in order, each at least ``least`` after the one kept before it.

    A point with no other less than ``least`` before it is kept whatever came before, so
    a group falls into stretches at such points; each is folded on its own.
    """
    w = Window.partitionBy(by).orderBy(point)
    fresh = F.coalesce(F.col(point) - F.lag(point).over(w) >= least, F.lit(True)).cast("int")
    cut = rows.select(by, F.col(point).cast("double").alias(point)).where(F.col(point).isNotNull()).withColumn("__s", fresh)
    cut = cut.withColumn("__s", F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, 0)))

    def step(last: float | None, row: dict) -> tuple[float, list[tuple]]:
        p = row[point]
        return (p, [(p,)]) if last is None or p - last >= least else (last, [])

    return streamed(cut, [by, "__s"], [point], "kept double", lambda: None, step, lambda _: []).select(by, "kept")


def short_merged(rows: DataFrame, by: str, start: str, end: str, least: float) -> DataFrame:
    """(by, start, end): segments in order; one shorter than ``least`` is joined with the next, and the pair is passed over.

    A long segment never waits for another, so pairs are counted from the last long one:
    in each stretch that ends with one, every odd short segment is joined with the next.
    """
    w = Window.partitionBy(by).orderBy(start, end)
    long = (F.col(end) - F.col(start) >= least).cast("int")
    stretch = F.coalesce(F.sum(long).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.select(by, start, end).withColumn("__s", stretch)
    place = F.row_number().over(Window.partitionBy(by, "__s").orderBy(start, end)) - 1
    pairs = placed.withColumn("__pair", F.floor(place / 2))
    # the later segment's end counts, as it would when they are joined one after the other
    return pairs.groupBy(by, "__s", "__pair").agg(F.min(start).alias("start"), F.max_by(end, F.struct(start, end)).alias("end")).drop("__s", "__pair")


def semantic_chunks(rows: DataFrame, by: str, start: str, end: str, vector: str, similarity: float, longest: float) -> DataFrame:
    """Chunks of consecutive rows: (by, chunk, start, end, n).

    A row begins a new chunk if its cosine to the mean of the chunk so far is under
    ``similarity`` or the chunk would outlast ``longest``. Rows without a vector are left
    out. The state that runs along a group is one sum of vectors.
    """

    def step(state: tuple, row: dict) -> tuple[tuple, list[tuple]]:
        total, n, first, last, chunk = state
        s, e, v = row[start], row[end], np.asarray(row[vector], float)
        out = []
        if n:
            near = float(total @ v) / max(float(np.linalg.norm(total) * np.linalg.norm(v)), 1e-300)
            if near < similarity or e - first > longest:
                out.append((chunk, first, last, n))
                n, chunk = 0, chunk + 1
        if not n:
            total, first = np.zeros_like(v), s
        return (total + v, n + 1, first, e, chunk), out

    some = rows.where(F.col(vector).isNotNull()).select(by, start, end, vector)
    return streamed(some, [by], [start, end], "chunk long, start double, end double, n long", lambda: (None, 0, 0.0, 0.0, 0), step, lambda s: [(s[4], s[2], s[3], s[1])])


def quota_stream(rows: Iterator[tuple], quota: dict) -> Iterator[tuple]:
    """Rows (category, …) as they come until each category's quota is full."""
    left = dict(quota)
    for row in rows:
        if left.get(row[0], 0) > 0:
            left[row[0]] -= 1
            yield row
        if not any(left.values()):
            return
