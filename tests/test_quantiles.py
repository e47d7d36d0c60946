"""Percentiles by sketch and counts against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators.quantiles import percentiles

QS = [0.0, 0.05, 0.5, 0.95, 0.99, 1.0]


@pytest.mark.parametrize("accuracy", [50, 10_000])
def test_against_numpy(spark, accuracy):
    rng = np.random.default_rng(accuracy)
    groups = {
        "even": rng.random(4000), "skewed": np.exp(3 * rng.normal(size=4000)), "few": rng.integers(0, 4, 3000).astype(float), "same": np.full(2000, 7.0), "one": np.array([3.5]), "two": np.array([1.0, 2.0]), None: rng.normal(size=500),
        "mostly": np.concatenate([np.zeros(2990), rng.random(10)]),
    }
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("even", None), ("none", None)]
    got = {r["g"]: r for r in percentiles(spark.createDataFrame(rows, "g string, x double").repartition(7), F.col("x"), ["g"], QS, accuracy=accuracy).collect()}
    assert set(got) == {*groups, "none"} and got["none"]["n"] == 0 and got["none"]["p"] is None
    for g, xs in groups.items():
        assert got[g]["n"] == len(xs) and np.allclose(got[g]["p"], np.quantile(xs, QS), rtol=1e-12, atol=1e-12), g


def test_without_groups_or_rows(spark):
    df = spark.range(1, 102).selectExpr("id * 1.0 AS x", "1 AS g")
    assert list(percentiles(df, F.col("x"), [], [0.5]).first()["p"]) == [51.0]
    assert percentiles(df.limit(0), F.col("x"), ["g"], [0.5]).count() == 0
