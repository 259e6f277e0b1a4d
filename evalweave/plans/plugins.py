"""Where models and providers come in: registries of callables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.functions import text, vectors

_providers: dict[tuple[str, str], Callable] = {}


def provider(kind: str, name: str) -> Callable[[Callable], Callable]:
    """Register a provider under its kind and name."""

    def put(f: Callable) -> Callable:
        _providers[kind, name] = f
        return f

    return put


def get(kind: str, name: str) -> Callable:
    if (kind, name) not in _providers:
        raise KeyError(f"no {kind} provider {name}; there are {sorted(n for k, n in _providers if k == kind)}")
    return _providers[kind, name]


def predict(rows: DataFrame, model: Callable[[pd.DataFrame], pd.Series], name: str = "prediction", kind: str = "string") -> DataFrame:
    """Adds a model's output, batch by batch; rows of a failing batch get null and the error's text."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            try:
                yield part.assign(**{name: model(part), "error": None})
            except Exception as e:  # a remote model may fail in any way; the batch says so
                yield part.assign(**{name: None, "error": repr(e)})

    return rows.mapInPandas(run, f"{schema}, {name} {kind}, error string")


@provider("judge", "overlap")
def overlap_judge(question: Column, truth: Column, prediction: Column, least: float = 2.0) -> Column:
    """A repeatable judge: does the truth score high enough against the prediction? Null without a prediction."""
    del question
    return F.when(prediction.isNotNull() & (prediction != ""), text.choice_score(prediction, truth) >= least)


for _name, _score in vectors.SCORES.items():
    provider("change", _name)(_score)
