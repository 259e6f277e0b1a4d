"""Choosing frames of a recording; a score stands in for the model that looks at what it is shown.

Frames are rows (group, index, score). "Shown" frames are evenly spaced ones, both ends
in; of these the ``q`` with the best scores are chosen, ties by index. All modes return
the rows chosen, so that a long recording never has to be one array.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalweave.operators.ranking import capped, equal_parts
from evalweave.sources.scratch import staged


class Frames(NamedTuple):
    rows: DataFrame
    group: str
    index: str
    score: str

    def placed(self, *by: str) -> DataFrame:
        """With ``__at`` and ``__n``: a frame's place among those of its group (and ``by``), and how many there are."""
        w = Window.partitionBy(self.group, *by)
        return self.rows.withColumns({"__n": F.count("*").over(w), "__at": F.row_number().over(w.orderBy(self.index)) - 1})

    def of(self, rows: DataFrame) -> Frames:
        return self._replace(rows=rows)

    def even(self, k: int, *by: str) -> Frames:
        """The frames at ``k`` even steps of each group (and ``by``); all if there are no more."""
        step = (F.col("__n") - 1) / max(1, k - 1)
        hit = F.exists(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.rint(i * step) == F.col("__at"))
        return self.of(self.placed(*by).where((F.col("__n") <= k) | hit).drop("__n", "__at"))

    def best(self, q: int, *by: str) -> Frames:
        return self.of(capped(self.rows, [self.group, *by], [F.col(self.score).desc(), F.col(self.index)], q))

    def parts(self, n: int, name: str) -> Frames:
        """Adds the equal part of its group in which a frame lies; the last one has what is over."""
        rows = self.placed()
        return self.of(rows.withColumn(name, equal_parts(F.col("__at"), F.col("__n"), n)).drop("__n", "__at"))


def clip(f: Frames, q: int, pool: int = 512) -> DataFrame:
    """The best of an evenly spaced pool."""
    return f.even(pool).best(q).rows


def vlm_prune(f: Frames, q: int, show: int = 64) -> DataFrame:
    """One look at ``show`` frames."""
    return f.even(show).best(q).rows


def vlm(f: Frames, q: int, rounds: int = 12, size: int = 16) -> DataFrame:
    """Rounds over consecutive frames, ``size`` shown and ``q`` chosen in each; a short last round joins the one before."""
    each = F.greatest(F.lit(1), F.floor(F.col("__n") / rounds))
    last = F.ceil(F.col("__n") / each) - 1
    short = (last >= rounds) & (F.col("__n") - last * each < F.floor(each / 2))
    turn = F.floor(F.col("__at") / each)
    turn = F.when(short, F.least(turn, last - 1)).otherwise(turn)
    rows = f.of(f.placed().withColumn("__turn", turn).drop("__n", "__at"))
    return rows.even(size, "__turn").best(q, "__turn").rows.drop("__turn")


def scene_zoom(f: Frames, q: int, scenes: int = 16) -> DataFrame:
    """All frames of the ``q`` scenes with the best frame."""
    cut = f.parts(scenes, "__scene")
    top = cut.rows.groupBy(f.group, "__scene").agg(F.max(f.score).alias("__top"))
    top = capped(top, [f.group], [F.col("__top").desc(), F.col("__scene")], q)
    return cut.rows.join(top.select(f.group, "__scene"), [f.group, "__scene"], "left_semi").drop("__scene")


def time_router(f: Frames, q: int, span: int = 2, scenes: int = 16) -> DataFrame:
    """All frames of the scenes that a range of ``span`` frames about one of the ``q`` best meets."""
    cut = f.of(f.parts(scenes, "__scene").placed())
    near = F.sequence(F.greatest(F.col("__at") - span, F.lit(0)), F.least(F.col("__at") + span, F.col("__n") - 1))
    at = cut.best(q).rows.select(f.group, F.explode(near).alias("__at")).distinct()
    met = cut.rows.join(at, [f.group, "__at"], "left_semi").select(f.group, "__scene").distinct()
    return cut.rows.join(met, [f.group, "__scene"], "left_semi").drop("__scene", "__n", "__at")


#: Selection modes by name; each takes frames and how many to choose.
MODES: dict[str, Callable[[Frames, int], DataFrame]] = {"clip": clip, "scene_zoom": scene_zoom, "time_router": time_router, "vlm_prune": vlm_prune, "vlm": vlm, "none": lambda f, q: f.rows}


def select(mode: str, f: Frames, q: int) -> DataFrame:
    if mode not in MODES:
        raise ValueError(f"unknown selection mode {mode}; there are {sorted(MODES)}")
    return MODES[mode](f, q)


def single_step(f: Frames, k: int, q: int) -> DataFrame:
    """One look at ``k`` frames of the whole."""
    return f.even(k).best(q).rows


def dynamic_segment(f: Frames, segments: int, show: int, q: int) -> DataFrame:
    """A look at ``show`` frames of each segment."""
    return f.parts(segments, "__part").even(show, "__part").best(q, "__part").rows.drop("__part")


def neighbourhoods(f: Frames, k: int, q: int, near: int, rounds: int) -> DataFrame:
    """Looks at ``k`` frames: first of the whole, then of those up to ``near`` places from one chosen, until no choice changes, ``rounds`` at most.

    A group whose choice stays sees the same frames again, so all groups go on together.
    """
    shown, chosen = f.even(k), None
    placed = staged(f.placed(), "frames")
    for turn in range(rounds):
        now = staged(shown.best(q).rows.select(f.group, f.index), "chosen")
        if chosen is not None and now.exceptAll(chosen).isEmpty() and chosen.exceptAll(now).isEmpty():
            break
        chosen = now
        if turn < rounds - 1:
            at = placed.join(chosen, [f.group, f.index], "left_semi").select(f.group, F.explode(F.sequence(F.col("__at") - near, F.col("__at") + near)).alias("__at")).distinct()
            shown = f.of(placed.join(at, [f.group, "__at"], "left_semi").select(*f.rows.columns)).even(k)
    return f.rows.join(chosen, [f.group, f.index], "left_semi")


def context(selected: DataFrame, f: Frames, k: int, u: int) -> DataFrame:
    """(group, index) of at most k - u even ones of the frames selected, and u even ones of all."""
    some, all_ = f.of(selected).even(k - u).rows, f.even(u).rows if u else f.rows.limit(0)
    return some.select(f.group, f.index).union(all_.select(f.group, f.index)).distinct()

