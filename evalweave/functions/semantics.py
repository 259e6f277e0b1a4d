"""Small rules where Python's habits and SQL's differ."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks that DuckDB's trim takes off: Unicode's space separators.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def first_nonempty(*columns: Column) -> Column:
    """The first value that is neither null nor an empty string."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def divide_or(a: Column, b: Column, default: float | None = None) -> Column:
    """a / b; ``default`` where b is 0 or null."""
    out = F.try_divide(a.cast("double"), b.cast("double"))
    return out if default is None else F.coalesce(out, F.lit(default))


def half_even(x: Column, digits: int = 0) -> Column:
    """Rounds halves to the even neighbour."""
    return F.bround(x, digits)


def truncated(x: Column) -> Column:
    """Whole part, towards zero."""
    return x.cast("long")


def words(text: Column) -> Column:
    """Runs of non-blanks; none for a blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def re2(pattern: str) -> str:
    r"""A pattern for Java that finds what DuckDB (RE2) finds by the pattern without its ``(?U)``.

    ``\b`` and ``\s`` are those of ASCII, without the vertical tab; only a line feed ends a line; where case is ignored,
    the long s and the Kelvin sign are an s and a k. (No s or k may stand in a range or a name.)
    """
    plain = pattern.replace("(?U)", "")
    if plain.startswith("(?i)"):
        plain = re.sub(r"(?<!\\)[sk]", lambda m: {"s": "[s\u017f]", "k": "[k\u212a]"}[m[0]], plain)
    edge = "(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"
    return "(?d)" + plain.replace(r"\b", edge).replace(r"\s", r"[\t\n\f\r ]")


def upper_median(values: Column) -> Column:
    """sorted[n // 2] of an array; null if it is empty."""
    s = F.array_sort(values)
    return F.get(s, F.floor(F.size(s) / 2).cast("int"))


def index_percentile(values: Column, percent: int) -> Column:
    """sorted[min(n - 1, int(n * p / 100))] of an array; null if it is empty."""
    s = F.array_sort(values)
    return F.get(s, F.least(F.size(s) - 1, F.floor(F.size(s) * F.lit(percent) / 100).cast("int")))


def spread(n: int | Column, k: int | Column, rounding: str = "even", base: int = 0) -> Column:
    """Indices of ``k`` evenly spaced items of ``n``, both ends in, each once.

    ``rounding``: "even" rounds halves to even, "down" truncates.
    """
    n, k = (x if isinstance(x, Column) else F.lit(x) for x in (n, k))
    step = F.coalesce(F.try_divide((n - 1).cast("double"), (k - 1).cast("double")), F.lit(0.0))
    to_int = F.rint if rounding == "even" else F.floor
    at = F.transform(F.sequence(F.lit(0), k.cast("int") - 1), lambda i: to_int(i * step).cast("int") + base)
    return F.when((n < 1) | (k < 1), F.array().cast("array<int>")).otherwise(F.array_distinct(at))
