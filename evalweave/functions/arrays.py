"""Nested values: choices, chat turns, JSON inside model answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_turn(turns: Column, role: str) -> Column:
    """The first text of a role in array<struct<role, text>>."""
    return F.get(F.filter(turns, lambda t: t["role"] == role), F.lit(0))["text"]


def turn_pairs(turns: Column, asks: str = "user", answers: str = "assistant") -> Column:
    """Question and answer pairs at places 0-1, 2-3, …; pairs with other roles are left out."""
    at = F.when(F.size(turns) > 1, F.sequence(F.lit(0), F.greatest(F.size(turns) - 2, F.lit(0)), F.lit(2))).otherwise(F.array().cast("array<int>"))
    made = F.transform(at, lambda i: F.struct(F.get(turns, i).alias("q"), F.get(turns, i + 1).alias("a")))
    good = F.filter(made, lambda p: (p["q"]["role"] == asks) & (p["a"]["role"] == answers))
    return F.transform(good, lambda p: F.struct(p["q"]["text"].alias("question"), p["a"]["text"].alias("answer")))


def chat(question: Column, answer: Column, prefix: str = "") -> Column:
    """A two-turn conversation."""
    return F.array(F.struct(F.lit("human").alias("from"), F.concat(F.lit(prefix), question).alias("value")), F.struct(F.lit("gpt").alias("from"), answer.alias("value")))


def valid_segments(segments: Column) -> Column:
    """Segments that have both ends, in order."""
    return F.transform(F.filter(segments, lambda s: s["start"].isNotNull() & s["end"].isNotNull() & (s["end"] > s["start"])), lambda s: F.struct(s["start"].cast("double").alias("start"), s["end"].cast("double").alias("end")))


def json_object(text: Column) -> Column:
    """A JSON text out of a model's answer: as it is, without code fences, or from the first { to the last }."""
    bare = F.trim(text)
    unfenced = F.trim(F.regexp_replace(text, "```(?:json)?", ""))
    braced = F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))

    def good(t: Column) -> Column:
        return F.when(F.try_parse_json(t).isNotNull(), t)

    return F.coalesce(good(bare), good(unfenced), good(braced))


def selected_ids(text: Column, allowed: Column) -> Column:
    """Allowed ids of an answer's "frame_ids", or of a bare list: sorted, each once; all if it can't be parsed, none if it names none."""
    found = json_object(text)
    listed = F.coalesce(F.get_json_object(found, "$.frame_ids"), F.when(F.startswith(F.trim(found), F.lit("[")), found))
    ids = F.transform(F.from_json(listed, "array<string>"), lambda x: x.try_cast("int"))
    kept = F.array_sort(F.array_intersect(F.coalesce(ids, F.array().cast("array<int>")), allowed))
    return F.when(found.isNull(), F.array_sort(allowed)).otherwise(kept)


def verdict(text: Column) -> Column:
    """YES, NO or ERROR of a judge's answer; a stray verdict in broken JSON counts."""
    parsed = F.try_parse_json(F.trim(text))
    value = F.lower(F.trim(F.try_variant_get(parsed, "$.verdict", "string")))
    stray = F.lower(text)
    read = F.when(value.isin("true", "1"), "YES").when(value.isNotNull() & (value != "null"), F.when(value.try_cast("double") > 0, "YES").otherwise("NO")).otherwise("ERROR")
    rescued = F.when(stray.rlike(r'"verdict"\s*:\s*true'), "YES").when(stray.rlike(r'"verdict"\s*:\s*false'), "NO").otherwise("ERROR")
    whole = F.startswith(F.trim(text), F.lit("{")) & F.endswith(F.trim(text), F.lit("}")) & parsed.isNotNull()
    return F.when(whole, read).otherwise(rescued)


def numbers(text: Column) -> Column:
    """All numbers of a text."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(-?\d+(?:\.\d+)?)"), 1), lambda x: x.cast("double"))


def paired_intervals(text: Column) -> Column:
    """Intervals of an answer's numbers, two by two; a last odd one is left out."""
    n = numbers(text)
    at = F.when(F.size(n) > 1, F.sequence(F.lit(0), F.greatest(F.size(n) - 2, F.lit(0)), F.lit(2))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(F.get(n, i).alias("start"), F.get(n, i + 1).alias("end")))


def permutation(n: Column, *salt: Column) -> Column:
    """0 to n - 1 in an order set by a hash of the salt."""
    key = F.concat_ws("|", *(s.cast("string") for s in salt))
    items = F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: F.struct(F.md5(F.concat_ws("|", key, i.cast("string"))).alias("h"), i.alias("i")))
    return F.when(n > 0, F.transform(F.array_sort(items), lambda x: x["i"])).otherwise(F.array().cast("array<int>"))


def permuted(items: Column, order: Column) -> Column:
    return F.transform(order, lambda i: F.get(items, i))


def original_index(shown: Column, order: Column) -> Column:
    """Where the item shown at a place stood before."""
    return F.get(order, shown)


def by_keyword(name: Column, table: dict[str, str], default: str = "other") -> Column:
    """The value of the first key that the name contains."""
    out = F.lit(default)
    for key, value in reversed(table.items()):
        out = F.when(F.contains(F.lower(name), F.lit(key.lower())), value).otherwise(out)
    return out


def sorted_by_suffix(names: Column) -> Column:
    """Distinct names by the number that each ends with."""
    keyed = F.transform(F.array_distinct(names), lambda n: F.struct(F.regexp_extract(n, r"(\d+)$", 1).try_cast("long").alias("k"), n.alias("n")))
    return F.transform(F.array_sort(keyed), lambda x: x["n"])
