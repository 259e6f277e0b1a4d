"""Joins that one equality doesn't express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fallback_join(rows: DataFrame, table: DataFrame, first: str, second: list[str], values: list[str]) -> DataFrame:
    """Values by the first key, else by the second keys; one row stays one row: of equal keys the least values count.

    The optimiser broadcasts either side of the table where its size allows.
    """
    packed = F.min(F.struct(*values))
    a = table.groupBy(first).agg(packed.alias("__a"))
    b = table.groupBy(*(F.col(c).alias(f"__{c}") for c in second)).agg(packed.alias("__b"))
    cond = None
    for c in second:
        one = F.col(c) == F.col(f"__{c}")
        cond = one if cond is None else cond & one
    out = rows.join(a, first, "left").join(b, cond, "left")
    got = F.coalesce("__a", "__b")
    return out.select(*rows.columns, *(got[v].alias(v) for v in values))


def attach(rows: DataFrame, table: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows with the table's values, keys that the table lacks)."""
    return rows.join(table, key, "left"), rows.join(table, key, "left_anti").select(key).distinct()


def paired(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Both runs' values by key, with where each key is from."""
    x = a.select(key, F.col(value).alias("a"), F.lit(True).alias("__a"))
    y = b.select(key, F.col(value).alias("b"), F.lit(True).alias("__b"))
    side = F.when(F.col("__a") & F.col("__b"), "both").when(F.col("__a"), "a_only").otherwise("b_only")
    return x.join(y, key, "full").select(key, "a", "b", side.alias("side"))


def _bucketed(rows: DataFrame, start: str, end: str, width: float, as_: str) -> DataFrame:
    low, high = F.floor(F.col(start) / width), F.floor(F.col(end) / width)
    return rows.withColumn(as_, F.explode(F.sequence(low, F.greatest(low, high))))


def range_join(a: DataFrame, b: DataFrame, on: list[str], a_range: tuple[str, str], b_range: tuple[str, str], width: float, closed: bool = False) -> DataFrame:
    """Rows of equal ``on`` whose ranges overlap; ``closed``: a common point is enough.

    Both sides are dealt to buckets of ``width``, so this is an equality join and never a
    nested loop; each pair comes out in the first bucket that it shares. Column names of
    the two sides must differ but for ``on``.
    """
    x = _bucketed(a, *a_range, width, "__bucket")
    y = _bucketed(b, *b_range, width, "__bucket")
    (s, e), (t, f) = a_range, b_range
    meet = (F.col(s) <= F.col(f)) & (F.col(t) <= F.col(e)) if closed else (F.col(s) < F.col(f)) & (F.col(t) < F.col(e))
    first = F.col("__bucket") == F.floor(F.greatest(F.col(s), F.col(t)) / width)
    return x.join(y, [*on, "__bucket"]).where(meet & first).drop("__bucket")


def point_join(points: DataFrame, b: DataFrame, on: list[str], at: str, b_range: tuple[str, str], width: float, closed: bool = True) -> DataFrame:
    """Rows of equal ``on`` whose range holds the point."""
    x = points.withColumn("__bucket", F.floor(F.col(at) / width))
    y = _bucketed(b, *b_range, width, "__bucket")
    t, f = F.col(b_range[0]), F.col(b_range[1])
    inside = (F.col(at) >= t) & (F.col(at) <= f) if closed else (F.col(at) > t) & (F.col(at) < f)
    return x.join(y, [*on, "__bucket"]).where(inside).drop("__bucket")


def nearest_fallback(overlap: DataFrame, wanted: DataFrame, segments: DataFrame, on: list[str], key: str, wanted_mid: Column, segment_mid: Column, segment: str) -> DataFrame:
    """(on, key, segment): the overlapping segments, and for ranges without one the segment with the nearest middle; ties go to the smaller segment."""
    alone = wanted.join(overlap.select(*on, key).distinct(), [*on, key], "left_anti")
    near = alone.withColumn("__mid", wanted_mid).join(segments.withColumn("__smid", segment_mid), on)
    best = near.groupBy(*on, key).agg(F.min(F.struct(F.abs(F.col("__mid") - F.col("__smid")).alias("d"), F.col(segment).alias("s")))["s"].alias(segment))
    return overlap.select(*on, key, segment).unionByName(best)


def neighbours(chosen: DataFrame, items: DataFrame, on: list[str], index: str, hops: int) -> DataFrame:
    """The items up to ``hops`` places from a chosen one."""
    near = chosen.select(*on, F.explode(F.sequence(F.col(index) - hops, F.col(index) + hops)).alias(index)).distinct()
    return items.join(near, [*on, index], "left_semi")


def two_hop(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, node): nodes that share an attribute with a seed and aren't seeds; edges are (src, dst), src the node."""
    a = edges.join(seeds.select(F.col("src")).distinct(), "src", "left_semi").select(F.col("src").alias("seed"), "dst").distinct()
    b = edges.select(F.col("src").alias("node"), "dst").distinct()
    return a.join(b, "dst").select("seed", "node").distinct().join(seeds.select(F.col("src").alias("node")).distinct(), "node", "left_anti")


def ring_donors(rows: DataFrame, key: str, group: str, buckets: int | None = None) -> DataFrame:
    """A donor of another group for each row: (key, donor), null if there is one group only.

    Rows go round a ring ordered by a hash of 60 bits; a row's donor is the next one that
    isn't of its group. A bucket is an arc of the ring of about 100,000 rows, and a window;
    its last rows look into the following buckets through their first rows of two different
    groups: at most 2^16 buckets, so that this table has a bound.
    """
    from pyspark.sql import Window

    if buckets is None:
        buckets = 1 << min(16, (rows.count() // 100_000).bit_length())
    hashed = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 15), 16, 10).cast("long")
    h = rows.select(key, group, hashed.alias("__h")).withColumn("__b", F.floor(F.col("__h") / F.lit((1 << 60) // buckets)).cast("int"))
    w = Window.partitionBy("__b").orderBy("__h", key)
    # the first row of the next run of another group: its start is where the group changes
    marked = h.withColumn("__prev", F.lag(group).over(w)).withColumn("__start", F.when(F.col("__prev").isNull() | (F.col("__prev") != F.col(group)), F.col(key)))
    ahead = w.rowsBetween(1, Window.unboundedFollowing)
    inside = marked.withColumn("__donor", F.first("__start", ignorenulls=True).over(ahead))
    firsts = h.groupBy("__b", group).agg(F.min(F.struct("__h", F.col(key).alias("k"))).alias("f"))
    two = firsts.withColumn("__n", F.row_number().over(Window.partitionBy("__b").orderBy("f"))).where("__n <= 2").select("__b", F.col(group).alias("g"), F.col("f.k").alias("k"), "__n").collect()
    by_bucket: dict[int, list] = {}
    for r in sorted(two, key=lambda r: (r["__b"], r["__n"])):
        by_bucket.setdefault(r["__b"], []).append((r.g, r.k))
    order = sorted(by_bucket)
    rows_out = []
    for i, b in enumerate(order):
        found: list = []
        for j in range(1, len(order) + 1):
            for g, k in by_bucket[order[(i + j) % len(order)]]:
                if not found or found[0][0] != g:
                    found.append((g, k))
            if len(found) > 1:
                break
        rows_out.append((b, found[0][0], found[0][1], found[1][0] if len(found) > 1 else None, found[1][1] if len(found) > 1 else None))
    spark = rows.sparkSession
    kg, kk = rows.schema[group].dataType.simpleString(), rows.schema[key].dataType.simpleString()
    nxt = spark.createDataFrame(rows_out, f"__b int, g1 {kg}, k1 {kk}, g2 {kg}, k2 {kk}")
    out = inside.join(F.broadcast(nxt), "__b", "left")
    beyond = F.when(F.col("g1") != F.col(group), F.col("k1")).otherwise(F.when(F.col("g2") != F.col(group), F.col("k2")))
    return out.select(key, F.coalesce("__donor", beyond).alias("donor"))
