"""Clock texts, intervals and windows. Intervals are arrays of struct<start, end> in seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEGMENTS = "array<struct<start:double,end:double>>"


def seconds(clock: Column, default: float | None = None) -> Column:
    """Seconds of ``H:M:S``, ``M:S`` or a number, with ``.`` or ``,`` before fractions; bad texts give ``default``."""
    parts = F.transform(F.split(F.regexp_replace(F.trim(clock.cast("string")), ",", "."), ":"), lambda p: p.try_cast("double"))
    value = F.aggregate(parts, F.lit(0.0), lambda s, p: s * 60 + p)
    value = F.when(F.size(parts) <= 3, value)
    return value if default is None else F.coalesce(value, F.lit(default))


def clock(s: Column, style: str = "hms") -> Column:
    """``HH:MM:SS`` ("hms"), ``MM:SS`` ("ms") or ``HH:MM:SS,mmm`` ("srt")."""
    whole = F.floor(s).cast("long")
    if style == "ms":
        return F.format_string("%02d:%02d", F.floor(whole / 60), whole % 60)
    if style == "hms":
        return F.format_string("%02d:%02d:%02d", F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60)
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60, F.floor((s % 1) * 1000))


def segment(start: Column, end: Column) -> Column:
    return F.named_struct(F.lit("start"), start.cast("double"), F.lit("end"), end.cast("double"))


def merged(segments: Column) -> Column:
    """Sorted segments, those that overlap or touch joined: of the few segments of one row (``ranking.islands`` joins a table's)."""

    def put(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(segment(last["start"], F.greatest(last["end"], s["end"]))))
        return F.when(F.size(done) == 0, F.array(s)).when(s["start"] <= F.try_element_at(done, F.lit(-1))["end"], joined).otherwise(F.concat(done, F.array(s)))

    ordered = F.array_sort(F.transform(segments, lambda s: segment(s["start"], s["end"])))
    return F.when(F.size(segments) > 0, F.aggregate(F.slice(ordered, F.lit(2), F.greatest(F.size(ordered), F.lit(1))), F.slice(ordered, 1, 1), put)).otherwise(F.array().cast(SEGMENTS))


def total_length(segments: Column) -> Column:
    return F.aggregate(segments, F.lit(0.0), lambda s, x: s + (x["end"] - x["start"]))


def intersection(a: Column, b: Column) -> Column:
    """Length that two sets of disjoint segments share."""
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + F.aggregate(b, F.lit(0.0), lambda t, y: t + F.greatest(F.lit(0.0), F.least(x["end"], y["end"]) - F.greatest(x["start"], y["start"]))))


def iou(a: Column, b: Column) -> Column:
    """Shared length over covered length of two sets of segments; 0 if nothing is covered."""
    a, b = merged(a), merged(b)
    shared = intersection(a, b)
    union = total_length(a) + total_length(b) - shared
    return F.when(union > 0, F.try_divide(shared, union)).otherwise(0.0)


def overlaps(start: Column, end: Column, segments: Column, closed: bool = False) -> Column:
    """Does [start, end] meet any segment? ``closed``: a common point is enough."""
    if closed:
        return F.exists(segments, lambda s: (start <= s["end"]) & (end >= s["start"]))
    return F.exists(segments, lambda s: (start < s["end"]) & (end > s["start"]))


def bounds(segments: Column) -> Column:
    """From the least start to the largest end; 0 to 0 without segments."""
    return segment(F.coalesce(F.array_min(F.transform(segments, lambda s: s["start"])), F.lit(0.0)), F.coalesce(F.array_max(F.transform(segments, lambda s: s["end"])), F.lit(0.0)))


def sanitised(start: Column, end: Column, duration: Column) -> Column:
    """The range in order and within the duration; null if nothing is left."""
    low, high = F.greatest(F.lit(0.0), F.least(start, end)), F.least(duration, F.greatest(start, end))
    return F.when(high > low, segment(low, high))


def index_span(start: Column, end: Column, width: Column, n: Column) -> tuple[Column, Column]:
    """First and last index of the ``n`` windows of ``width`` that a range covers."""
    first = F.least(n - 1, F.greatest(F.lit(0), F.floor(start / width).cast("int")))
    last = F.least(n - 1, F.greatest(first, F.floor((end - 0.001) / width).cast("int")))
    return first, last


def windows(duration: Column, n: int) -> Column:
    """``n`` equal windows over the duration."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: segment(i * duration / n, (i + 1) * duration / n))


def split_long(segments: Column, longest: float) -> Column:
    """Segments cut every ``longest`` seconds."""

    def cut(s: Column) -> Column:
        n = F.greatest(F.lit(1), F.ceil((s["end"] - s["start"]) / longest).cast("int"))
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: segment(s["start"] + i * longest, F.least(s["end"], s["start"] + (i + 1) * longest)))

    return F.flatten(F.transform(segments, cut))


def shifted(segments: Column, duration: Column, shift: float, far: bool = False) -> Column:
    """Clips of the segments' span moved away from them, in a fixed order: forward, backward, wrapped, opposite.

    Each is clamped to the duration; those under one second or over a segment are out.
    """
    b = bounds(segments)
    span = b["end"] - b["start"]
    size = F.when(span > 0, span).otherwise(F.least(F.lit(10.0), duration * 0.05))
    ahead, back = b["end"] + shift, b["start"] - shift - size
    made = [segment(ahead, ahead + size), segment(back, back + size)]
    made.append(F.when(ahead + size > duration, segment(ahead % duration, ahead % duration + size)))
    low = duration + back
    made.append(F.when(back < 0, segment(F.greatest(F.lit(0.0), low), low + size)))
    if far:
        centre = ((b["start"] + b["end"]) / 2 + duration / 2) % duration
        s = F.greatest(F.lit(0.0), centre - size / 2)
        e = F.when(centre - size / 2 < 0, size).otherwise(centre + size / 2)
        made.append(F.when(e > duration, segment(F.greatest(F.lit(0.0), duration - size), duration)).otherwise(segment(s, e)))
    clamped = F.transform(F.filter(F.array(*made), lambda c: c.isNotNull()), lambda c: segment(F.greatest(F.lit(0.0), c["start"]), F.least(duration, c["end"])))
    fit = F.filter(clamped, lambda c: (c["end"] - c["start"] >= 1.0) & ~overlaps(c["start"], c["end"], segments))
    return F.when((F.size(segments) > 0) & (duration > 0), fit).otherwise(F.array().cast(SEGMENTS))


def disjoint(candidates: Column, forbidden: Column, most: int) -> Column:
    """Up to ``most`` candidates in order, each clear of the forbidden segments and of those taken."""

    def put(done: Column, c: Column) -> Column:
        clear = ~overlaps(c["start"], c["end"], F.concat(forbidden, done))
        return F.when((F.size(done) < most) & clear, F.concat(done, F.array(c))).otherwise(done)

    return F.aggregate(candidates, F.array().cast(SEGMENTS), put)


def gap_merged(points: Column, least: float) -> Column:
    """Sorted points, each at least ``least`` after the one kept before it: of one row (``ranking.gap_merged`` takes a table's)."""

    def put(done: Column, t: Column) -> Column:
        return F.when((F.size(done) == 0) | (t - F.try_element_at(done, F.lit(-1)) >= least), F.concat(done, F.array(t))).otherwise(done)

    return F.aggregate(F.array_sort(points), F.array().cast("array<double>"), put)


def short_merged(segments: Column, least: float = 30.0) -> Column:
    """Segments in order; one shorter than ``least`` is joined with the next, and the pair is passed over: of one row (``ranking.short_merged`` takes a table's)."""

    def put(state: Column, s: Column) -> Column:
        held = state["held"]
        joined = segment(held["start"], s["end"])
        short = s["end"] - s["start"] < least
        done = F.when(held.isNotNull(), F.concat(state["done"], F.array(joined))).when(short, state["done"]).otherwise(F.concat(state["done"], F.array(s)))
        return F.struct(done.alias("done"), F.when(held.isNull() & short, s).alias("held"))

    null = F.lit(None).cast("struct<start:double,end:double>")
    end = F.aggregate(segments, F.struct(F.array().cast(SEGMENTS).alias("done"), null.alias("held")), put)
    return F.when(end["held"].isNotNull(), F.concat(end["done"], F.array(end["held"]))).otherwise(end["done"])


def clue_frames(segments: Column, budget: int, fps: float = 1.0) -> Column:
    """Frame numbers, the budget dealt by the segments' lengths, at least one for each."""
    total = total_length(segments)

    def pick(s: Column) -> Column:
        n = F.greatest(F.lit(1), F.floor(budget * F.try_divide(s["end"] - s["start"], total)).cast("int"))
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.floor((s["start"] + (i + 0.5) * (s["end"] - s["start"]) / n) * fps).cast("long"))

    return F.array_distinct(F.flatten(F.transform(segments, pick)))
