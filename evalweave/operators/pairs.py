"""Preference pairs: negatives, filters, caps, splits and the order of training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.functions import arrays, text
from evalweave.operators import dedup, filters, joins, ranking


def truncated(answer: Column, key: str, least: int = 4, most: int = 12) -> Column:
    """The first words of an answer, their number set by a hash of the key."""
    n = F.ascii(F.substring(ranking.hash_order(key), 1, 1)) % (most - least + 1) + least
    return text.first_words(answer, n)


def wrong_choice(choices: Column, right: Column, key: str) -> Column:
    """A choice other than the right one, the first in an order set by a hash of the key; null if there is none."""
    order = arrays.permutation(F.size(choices), F.lit("wrong"), F.col(key))
    return F.get(F.filter(arrays.permuted(choices, order), lambda c: c != right), F.lit(0))


def with_donors(rows: DataFrame, key: str, group: str, answer: str) -> DataFrame:
    """Adds ``rejected``: the answer of a row of another group."""
    donors = joins.ring_donors(rows.select(key, group), key, group)
    of = rows.select(F.col(key).alias("donor"), F.col(answer).alias("rejected"))
    return rows.join(donors, key, "left").join(of, "donor", "left").drop("donor")


def with_predictions(rows: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Adds ``rejected``: the row's own wrong prediction; rows without one go."""
    wrong = predictions.where(~F.col("correct")).groupBy(key).agg(F.min("prediction").alias("rejected"))
    return rows.join(wrong, key)


def screened(pairs: DataFrame, least_words: int = 5, most_rouge: float = 0.7) -> DataFrame:
    """Adds ``drop_reason``, rules from cheap to dear: same, abstains, short, alike, keys.

    The dear rules run on what the cheap ones leave: each is asked inside the earlier ones' otherwise.
    """
    c, r = F.col("chosen"), F.col("rejected")
    rules = [
        ("same", F.lower(F.trim(c)) == F.lower(F.trim(r))),
        ("abstains", text.abstains(r)),
        ("short", F.size(text.alnum_tokens(r)) < least_words),
        ("alike", text.rouge_l(r, c) > most_rouge),
        ("keys", text.keys_covered(c, r)),
    ]
    return filters.funnel(pairs, rules)


def assembled(pairs: DataFrame, key: str, axis: str, margin: str, most_margin: float, cap: int, fraction: float, seed: int = 0) -> DataFrame:
    """One pair a (key, axis), none over the margin, at most ``cap`` an axis, split into train and val."""
    one = dedup.keep_one(pairs, [F.col(key), F.col(axis)], [ranking.hash_order(key, seed)])
    kept = one.where(F.coalesce(F.col(margin), F.lit(-1e9)) <= most_margin)
    capped = ranking.capped(kept, [axis], [ranking.hash_order(key, seed)], cap)
    return ranking.split_fraction(capped, key, fraction, seed)


def curriculum(pairs: DataFrame, shares: DataFrame, on: list[str], key: str) -> DataFrame:
    """Pairs with ``difficulty`` (1 - share of right answers, 0.5 where unknown) and their place, easy ones first."""
    rows = pairs.join(shares.select(*on, "share"), on, "left").withColumn("difficulty", 1 - F.coalesce("share", F.lit(0.5))).drop("share")
    return ranking.numbered(rows, ["difficulty", key], "place")
