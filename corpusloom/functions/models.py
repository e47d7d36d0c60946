"""What wraps a model that a caller brings: scorers and embedders that run in workers, in bounded batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _parts(n: int, size: int) -> Iterator[slice]:
    return (slice(i, i + size) for i in range(0, n, size))


def batched_scorer(make: Callable[[], Callable[[list, list], list[float]]], *, batch: int = 64) -> Callable[[Column, Column], Column]:
    """A scorer of (question, text) from a function that makes the model, once in a worker's task; null where either is null.

    The model gets at most ``batch`` pairs at a time.
    """
    @F.pandas_udf("double")
    def score(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = make()
        for questions, texts in pairs:
            out = pd.Series([None] * len(texts), dtype="float64")
            real = (questions.notna() & texts.notna()).to_numpy().nonzero()[0]
            for part in _parts(len(real), batch):
                at = real[part]
                out.iloc[at] = model(questions.iloc[at].tolist(), texts.iloc[at].tolist())
            yield out

    return score


def batched_embedder(make: Callable[[], Callable[[list[str]], list[list[float]]]], *, batch: int = 128) -> Callable[[Column], Column]:
    """As batched_scorer, a vector for each text."""
    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in batches:
            out: list = [None] * len(texts)
            real = texts.notna().to_numpy().nonzero()[0]
            for part in _parts(len(real), batch):
                for i, v in zip(real[part], model(texts.iloc[real[part]].tolist()), strict=True):
                    out[i] = [float(x) for x in v]
            yield pd.Series(out, dtype="object")

    return embed
