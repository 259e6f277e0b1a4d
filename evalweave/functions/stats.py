"""Paired tests, intervals and closed-form losses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def chi_square(b: Column, c: Column) -> Column:
    """McNemar's statistic with continuity correction; 0 without disagreement."""
    return F.coalesce(F.try_divide(F.pow(F.greatest(F.abs(b - c) - 1, F.lit(0)), F.lit(2)).cast("double"), (b + c).cast("double")), F.lit(0.0))


def z_value(b: Column, c: Column) -> Column:
    return F.coalesce(F.try_divide((b - c).cast("double"), F.sqrt((b + c).cast("double"))), F.lit(0.0))


def exact_binomial(k: Column, n: Column) -> Column:
    """Two-sided chance of a split as uneven as min(k, n - k) under 1/2, at most 1.

    log C(n, i) runs along the sum, so n may be large.
    """
    low = F.least(k, n - k).cast("int")
    start = F.struct((n * F.log(F.lit(0.5))).alias("log"), F.exp(n * F.log(F.lit(0.5))).alias("sum"))

    def put(s: Column, i: Column) -> Column:
        log = s["log"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double"))
        return F.struct(log.alias("log"), (s["sum"] + F.exp(log)).alias("sum"))

    tail = F.aggregate(F.when(low > 0, F.sequence(F.lit(1), F.greatest(low, F.lit(1)))).otherwise(F.array().cast("array<int>")), start, put)["sum"]
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def wilson(correct: Column, n: Column, z: float = 1.96) -> Column:
    """Score interval struct<low, high>; 0 to 0 without trials."""
    p = F.coalesce(F.try_divide(correct.cast("double"), n.cast("double")), F.lit(0.0))
    m = F.greatest(n, F.lit(1)).cast("double")
    scale = 1 + z * z / m
    centre = (p + z * z / (2 * m)) / scale
    half = z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / scale
    none = n == 0
    return F.struct(F.when(none, 0.0).otherwise(F.greatest(F.lit(0.0), centre - half)).alias("low"), F.when(none, 0.0).otherwise(F.least(F.lit(1.0), centre + half)).alias("high"))


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def preference_loss(chosen: Column, rejected: Column, ref_chosen: Column, ref_rejected: Column, kind: str = "sigmoid", beta: float = 0.1, smoothing: float = 0.0) -> Column:
    """Loss of a preference pair over log-probabilities: "sigmoid", "hinge" or "ipo"."""
    x = (chosen - rejected) - (ref_chosen - ref_rejected)

    def soft(v: Column) -> Column:  # -log sigmoid, without overflow
        return F.greatest(-v, F.lit(0.0)) + F.log1p(F.exp(-F.abs(v)))

    if kind == "sigmoid":
        return (1 - smoothing) * soft(beta * x) + smoothing * soft(-beta * x)
    if kind == "hinge":
        return F.greatest(F.lit(0.0), 1 - beta * x)
    return F.pow(x - 1 / (2 * beta), F.lit(2))


def log_sum_exp(values: Column) -> Column:
    """Of an array, shifted by its maximum."""
    top = F.array_max(values)
    return top + F.log(F.aggregate(values, F.lit(0.0), lambda s, v: s + F.exp(v - top)))


def info_nce(positive: Column, negatives: Column, temperature: float = 0.07, penalty: Column | None = None) -> Column:
    """-log of the positive's share among all, plus a penalty, within 0 to 100; null for NaN."""
    all_ = F.transform(F.concat(F.array(positive), negatives), lambda v: v / temperature)
    loss = log_sum_exp(all_) - positive / temperature + (penalty if penalty is not None else 0.0)
    return F.when(~F.isnan(loss), F.least(F.lit(100.0), F.greatest(F.lit(0.0), loss)))


def effective_weight(n: Column, beta: float = 0.999) -> Column:
    """(1 - beta) / (1 - beta^n): a class's weight before the weights are scaled to their number."""
    return (1 - beta) / (1 - F.pow(F.lit(beta), n))


def focal(p: Column, gamma: float = 2.0) -> Column:
    """Loss of the true class's probability, easy cases weighed down."""
    return -F.pow(1 - p, F.lit(gamma)) * F.log(p)


def reference_margin(chosen: Column, rejected: Column, n_chosen: Column, n_rejected: Column) -> tuple[Column, Column]:
    """Difference of log-probabilities, and of their means a token."""
    one = F.lit(1)
    return chosen - rejected, chosen / F.greatest(one, n_chosen) - rejected / F.greatest(one, n_rejected)


def token_budget(frames: Column, per_frame: int, text: Column, chars_per_token: int = 4, most: int = 32768) -> tuple[Column, Column]:
    """Estimated tokens, and whether they are within ``most``."""
    n = frames * per_frame + F.floor(F.length(text) / chars_per_token)
    return n, n <= most
