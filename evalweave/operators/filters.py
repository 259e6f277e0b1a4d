"""Row rules: filters from maps, drop funnels and decision tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_COMPARE = {"eq": Column.__eq__, "ne": Column.__ne__, "gt": Column.__gt__, "ge": Column.__ge__, "lt": Column.__lt__, "le": Column.__le__}


def condition(rules: Mapping[str, Mapping[str, object]]) -> Column:
    """{field: {op: value}} as one condition; null fields fail."""
    out = F.lit(True)
    for field, ops in rules.items():
        for op, value in ops.items():
            if op not in _COMPARE:
                raise ValueError(f"unknown comparison {op}")
            out = out & _COMPARE[op](F.col(field), F.lit(value))
    return out


def without_named(rows: DataFrame, names: list[str]) -> DataFrame:
    """Rows that hold none of the names anywhere."""
    whole = F.to_json(F.struct("*"))
    bad = F.lit(False)
    for n in names:
        bad = bad | F.contains(whole, F.lit(n))
    return rows.where(~bad)


def funnel(rows: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Adds ``drop_reason``: the first rule that hits, or null. Rules are tried in order."""
    out = None
    for reason, hit in rules:
        out = F.when(hit, reason) if out is None else out.when(hit, reason)
    return rows.withColumn("drop_reason", out.otherwise(F.lit(None).cast("string")) if out is not None else F.lit(None).cast("string"))


def funnel_counts(rows: DataFrame, by: str, reasons: list[str]) -> DataFrame:
    """total, kept, share kept and each reason's count by group."""
    counts = [F.count_if(F.col("drop_reason") == r).alias(r) for r in reasons]
    kept = F.count_if(F.col("drop_reason").isNull())
    return rows.groupBy(by).agg(F.count("*").alias("total"), kept.alias("kept"), (kept * 100.0 / F.count("*")).alias("kept_pct"), *counts)


def ladder(value: Column, steps: list[tuple[float, str]], last: str) -> Column:
    """The name of the first step that the value doesn't exceed."""
    out = None
    for top, name in steps:
        out = F.when(value <= top, name) if out is None else out.when(value <= top, name)
    return out.otherwise(last)


def confidence(margin: Column, score: Column) -> Column:
    return F.when((margin > 1.5) & (score > 1.5), "high").when(margin > 0.4, "medium").otherwise("low")


def verdict_policy(verdict: Column) -> tuple[Column, Column]:
    """(kept, what counted): YES and PARTIAL go; NO, ERROR and a missing verdict stay."""
    v = F.coalesce(verdict, F.lit("MISSING"))
    return ~v.isin("YES", "PARTIAL"), v


def question_validity(mode: Column, known: Column, in_transcript: Column, temporal: Column, different: Column, has_transcript: Column) -> tuple[Column, Column]:
    """(valid, reason) of a generated question by its judges' texts."""
    yes = lambda c: F.contains(F.coalesce(c, F.lit("")), F.lit("YES"))
    reason = (
        F.when((mode == "priority") & F.contains(F.coalesce(different, F.lit("")), F.lit("DIFFERENT")), "distinct")
        .when(mode == "priority", "too generic")
        .when(yes(known), "known beforehand")
        .when((mode == "time") & yes(F.upper(temporal)), "bridges time")
        .when(mode == "time", "no temporal synthesis")
        .when(~has_transcript, "no transcript")
        .when((mode == "audio") & ~yes(in_transcript), "not in transcript")
        .when((mode == "visual") & yes(in_transcript), "found in transcript")
        .otherwise("passed")
    )
    return reason.isin("distinct", "bridges time", "no transcript", "passed"), reason


def flattened(rows: DataFrame, sep: str = ".") -> DataFrame:
    """Nested structs as columns with dotted names."""

    def walk(fields, path: list[str]) -> list[Column]:
        out = []
        for f in fields:
            here = [*path, f.name]
            if f.dataType.typeName() == "struct":
                out += walk(f.dataType.fields, here)
            else:
                out.append(F.col(".".join(f"`{p}`" for p in here)).alias(sep.join(here)))
        return out

    return rows.select(*walk(rows.schema.fields, []))


def number_or_null(text: Column, digits: int = 4) -> Column:
    """Numeric texts rounded half to even, others null."""
    return F.bround(text.try_cast("double"), digits)


def all_needles(name: Column, sets: dict[str, list[str]]) -> Column:
    """The first label all of whose needles stand in the name."""
    out = F.lit(None).cast("string")
    for label, needles in reversed(sets.items()):
        every = F.lit(True)
        for n in needles:
            every = every & F.contains(name, F.lit(n))
        out = F.when(every, label).otherwise(out)
    return out
