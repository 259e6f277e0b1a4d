"""Judged accuracy and its tables. A null verdict means not judged and counts on neither side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalweave.functions.stats import effective_weight


def accuracy(correct: Column, judged: Column) -> Column:
    """correct / judged in percent; null where nothing was judged."""
    return F.try_divide(correct * F.lit(100.0), judged)


def judged_counts(verdict: Column) -> list[Column]:
    return [F.count_if(verdict).alias("correct"), F.count(verdict).alias("judged"), (F.count("*") - F.count(verdict)).alias("pending")]


def judged_accuracy(rows: DataFrame, by: list[str], verdict: str = "verdict") -> DataFrame:
    """correct, judged, pending and acc for each group."""
    out = rows.groupBy(*by).agg(*judged_counts(F.col(verdict)))
    return out.withColumn("acc", accuracy(F.col("correct"), F.col("judged")))


def leaderboard(rows: DataFrame, model: str, verdict: str = "verdict") -> DataFrame:
    """Models by accuracy, unjudged ones last, ties by name; rank is a running number.

    The window sees one row a model, not one a judged answer.
    """
    acc = judged_accuracy(rows, [model], verdict)
    return acc.withColumn("rank", F.row_number().over(Window.orderBy(F.col("acc").desc_nulls_last(), F.col(model))).cast("long"))


def labelled_accuracy(rows: DataFrame, labels: Column, verdict: str = "verdict") -> DataFrame:
    """Accuracy by label where a row has several: it counts once for each, or under ``unknown``."""
    given = F.when(F.size(labels) > 0, labels).otherwise(F.array(F.lit("unknown")))
    return judged_accuracy(rows.select(verdict, F.explode(given).alias("label")), ["label"], verdict)


def mcq_accuracy(rows: DataFrame, answer: str, truth: str, empty: str = "wrong") -> DataFrame:
    """n, correct and acc of letters; ``empty`` answers are "wrong" or are "skipped"; so are empty truths under "truth"."""
    a, t = F.col(answer), F.col(truth)
    if empty == "skipped":
        rows = rows.where(F.coalesce(a, F.lit("")) != "")
    if empty == "truth":
        rows = rows.where(F.coalesce(t, F.lit("")) != "")
    right = F.count_if(F.coalesce(a == t, F.lit(False)))
    return rows.agg(F.count("*").alias("n"), right.alias("correct")).withColumn("acc", accuracy(F.col("correct"), F.col("n")))


def cross_tab(rows: DataFrame, by: str, axis: str, values: list[str], verdict: str = "verdict") -> DataFrame:
    """Accuracy of each (by, axis) as a row a ``by`` and a column a value, in the order given."""
    return rows.groupBy(by).pivot(axis, values).agg(accuracy(F.count_if(F.col(verdict)), F.count(verdict)))


def best_cells(rows: DataFrame, model: str, axis: str, category: str, verdict: str = "verdict") -> DataFrame:
    """The best model of each (axis, category); ties go to the model that ranks first overall."""
    ranks = leaderboard(rows, model, verdict).select(model, "rank")
    cells = judged_accuracy(rows, [axis, category, model], verdict).where("judged > 0").join(ranks, model)
    top = cells.groupBy(axis, category).agg(F.max_by(F.struct(model, "acc"), F.struct("acc", -F.col("rank"))).alias("top"))
    return top.select(axis, category, F.col(f"top.{model}").alias("best"), F.col("top.acc").alias("acc"))


def means(rows: DataFrame, by: list[str], metrics: list[str], missing: float = -1) -> DataFrame:
    """Number of rows and the mean of each metric; ``missing`` counts as null."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *(F.avg(F.nullif(F.col(m), F.lit(missing))).alias(m) for m in metrics))


def with_overall(rows: DataFrame, by: str, aggregates: list[Column], overall: str = "__overall__") -> DataFrame:
    """The aggregates for each group and for all, in one pass."""
    out = rows.rollup(by).agg(F.grouping(by).alias("__all"), *aggregates)
    return out.withColumn(by, F.when(F.col("__all") == 1, overall).otherwise(F.col(by))).drop("__all")


def grouped_separately(rows: DataFrame, keys: list[str], aggregates: list[Column]) -> DataFrame:
    """One group-by for each key and one for all, in one pass: columns ``dimension`` and ``value`` tell which."""
    sets = [[F.col(k)] for k in keys] + [[]]
    out = rows.groupingSets(sets, *keys).agg(F.grouping_id().alias("__id"), *aggregates)
    n = len(keys)
    bit = {k: 2**n - 1 - 2 ** (n - 1 - i) for i, k in enumerate(keys)}
    which = reduce(lambda c, k: c.when(F.col("__id") == bit[k], k), keys[1:], F.when(F.col("__id") == bit[keys[0]], keys[0])).otherwise("all")
    value = reduce(lambda c, k: c.when(F.col("__id") == bit[k], F.col(k).cast("string")), keys[1:], F.when(F.col("__id") == bit[keys[0]], F.col(keys[0]).cast("string")))
    return out.withColumns({"dimension": which, "value": value}).drop("__id", *keys)


def with_fallback(rows: DataFrame, fine: list[str], coarse: list[str], verdict: str = "verdict", default: float = 0.5) -> DataFrame:
    """Share of positive verdicts by ``fine`` keys, else by ``coarse`` ones, else ``default``."""
    share = F.avg(F.col(verdict).cast("double"))
    a = rows.groupBy(*fine).agg(share.alias("__fine"))
    b = rows.groupBy(*coarse).agg(share.alias("__coarse"))
    return a.join(b, coarse, "left").select(*fine, F.coalesce("__fine", "__coarse", F.lit(default)).alias("share"))


def top_frequencies(rows: DataFrame, value: str, order: str, n: int) -> DataFrame:
    """The ``n`` most frequent values; ties by first appearance."""
    return rows.groupBy(value).agg(F.count("*").alias("n"), F.min(order).alias("first")).orderBy(F.desc("n"), "first", value).limit(n)


def summary(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, median, sample deviation, least and largest value."""
    v = F.col(value)
    return rows.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.percentile(v, F.lit(0.5)).alias("median"), F.stddev_samp(v).alias("std"), F.min(v).alias("low"), F.max(v).alias("high"))


def histogram(rows: DataFrame, value: str, bins: int) -> DataFrame:
    """bin and n over the whole range in equal widths, the last bin closed; the range is one broadcast row."""
    edge = rows.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).select("lo", F.greatest((F.col("hi") - F.col("lo")) / bins, F.lit(1e-6) / bins).alias("w"))
    at = F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) / F.col("w")).cast("int"))
    return rows.where(F.col(value).isNotNull()).crossJoin(F.broadcast(edge)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def index_percentiles(rows: DataFrame, by: list[str], value: str, percents: list[int]) -> DataFrame:
    """sorted[min(n - 1, int(n * p / 100))] of each group.

    Values are counted first and only counts are accumulated, so no group of rows is
    ever held in one place; a group costs its distinct values.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("m"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    placed = counts.withColumns({"upto": F.sum("m").over(w.orderBy(value)), "n": F.sum("m").over(w)})
    picks = [F.min(F.when(F.col("upto") > F.least(F.col("n") - 1, F.floor(F.col("n") * p / 100)), F.col(value))).alias(f"p{p}") for p in percents]
    return placed.groupBy(*by).agg(*picks)


def threshold_shares(rows: DataFrame, by: list[str], value: str, thresholds: list[float]) -> DataFrame:
    """Share of values over each threshold."""
    return rows.groupBy(*by).agg(*(F.avg((F.col(value) > t).cast("double")).alias(f"over_{i}") for i, t in enumerate(thresholds)))


def balanced_weights(rows: DataFrame, label: str, beta: float = 0.999) -> DataFrame:
    """Class-balanced weights, scaled to sum up to the number of classes."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n")).withColumn("raw", effective_weight(F.col("n"), beta))
    w = Window.partitionBy(F.lit(1))
    return counts.select(label, "n", (F.col("raw") / F.sum("raw").over(w) * F.count("*").over(w)).alias("weight"))


def against_baseline(scores: DataFrame, key: str, value: str, baseline: str) -> DataFrame:
    """Each row's difference from the baseline row, which is one broadcast row."""
    base = scores.where(F.col(key) == baseline).select(F.col(value).alias("__base")).limit(1)
    return scores.join(F.broadcast(base), F.lit(True), "left").select(key, value, (F.col(value) - F.col("__base")).alias("delta"))


def contingency(rows: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """both, a_only, b_only, neither of two verdicts on common rows."""
    x, y = F.col(a), F.col(b)
    rows = rows.where(x.isNotNull() & y.isNotNull())
    return rows.groupBy(*by).agg(F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("a_only"), F.count_if(~x & y).alias("b_only"), F.count_if(~x & ~y).alias("neither"))
