"""A student scorer trained on a teacher's pairs: whole-batch descent, gradients summed by Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Features at most: weights and gradients pass through the driver, one number each.
MAX_FEATURES = 100_000


def loss_gradient(x: np.ndarray, y: np.ndarray, w: np.ndarray, loss: str) -> tuple[np.ndarray, float]:
    """Sums over rows of the gradient and the loss: ``mse`` of the raw score against logits, ``bce`` of its logistic against labels."""
    z = x @ w
    if loss == "mse":
        return 2 * x.T @ (z - y), float(((z - y) ** 2).sum())
    p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
    return x.T @ (p - y), float((np.logaddexp(0, z) - y * z).sum())


def partial_gradients(pairs: DataFrame, w: np.ndarray, loss: str) -> DataFrame:
    """(at, value): each component's part of the gradient by task; place -1 is the loss, -2 the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, lost, n = np.zeros(len(w)), 0.0, 0
        for b in batches:
            if b.num_rows:
                x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(w))
                g, more = loss_gradient(x, b.column("y").to_numpy(zero_copy_only=False), w, loss)
                total, lost, n = total + g, lost + more, n + b.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *range(len(w))], pa.int32()), pa.array([float(n), lost, *total], pa.float64())], ["at", "value"])

    return pairs.mapInArrow(run, "at int, value double")


def train_student(pairs: DataFrame, *, features: str = "x", target: str = "y", loss: str = "mse", rounds: int = 20, rate: float = 0.1, start: list[float] | None = None, weight_decay: float = 0.0) -> tuple[list[float], list[float]]:
    """Weights, and the mean loss before each round, of descent over all pairs at once.

    ``mse`` fits a teacher's logits, ``bce`` hard labels. Tasks sum the gradients of their rows, Spark sums the tasks'
    by component; one number a component reaches the driver. Rows with a null in features or target, or of another number of
    features than the commonest, take no part; without rows weights stay as they start. ``pairs`` is read once a round:
    give a stored table.
    """
    if loss not in ("mse", "bce"):
        raise ValueError(f"no loss {loss}")
    rows = pairs.select(F.col(features).cast("array<double>").alias("x"), F.col(target).cast("double").alias("y")).where(F.col("x").isNotNull() & F.col("y").isNotNull() & F.forall("x", lambda v: v.isNotNull()))
    common = rows.groupBy(F.size("x").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").head()
    dim = common["n"] if common else len(start or [])
    if dim > MAX_FEATURES:
        raise ValueError(f"{dim} features are more than {MAX_FEATURES}")
    w, losses = np.array(start if start is not None else np.zeros(dim), float), []
    rows = rows.where(F.size("x") == dim)
    for _ in range(rounds if common else 0):
        found = {r["at"]: r["value"] for r in partial_gradients(rows, w, loss).groupBy("at").agg(F.sum("value").alias("value")).collect()}
        losses.append(found[-1] / found[-2])
        w = w - rate * (np.array([found[i] for i in range(dim)]) / found[-2] + weight_decay * w)
    return w.tolist(), losses


def student_score(features: Column, weights: list[float], *, logistic: bool = False) -> Column:
    """The student's score as a column, in the JVM."""
    z = F.aggregate(F.zip_with(features, F.array(*map(F.lit, weights)), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return 1 / (1 + F.exp(-z)) if logistic else z
