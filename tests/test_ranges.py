"""Running values by ranges against one window over the whole key."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.operators import corpus as C
from corpusloom.operators.ranges import running


@pytest.mark.parametrize("size", [1, 7, 10_000])
def test_against_one_window(spark, size):
    rng = random.Random(size)
    rows = [(rng.choice(["a", "b", None]), p, rng.choice([None, rng.randrange(9)]), rng.randrange(5)) for p in rng.sample(range(500), 120)]
    df = spark.createDataFrame(rows, "k string, pos int, x int, y int").repartition(5)
    got = running(df, ["k"], ["pos"], F.floor(F.col("pos") / size), sums={"total": F.col("x")}, lasts={"seen": F.col("x")}, maxima={"top": F.struct("y", "pos")}, lags={"before": F.col("x")}, leads={"after": F.col("x")})
    w = Window.partitionBy("k").orderBy("pos")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumns({"total": F.coalesce(F.sum("x").over(upto), F.lit(0)), "seen": F.last("x", ignorenulls=True).over(upto), "top": F.max(F.struct("y", "pos")).over(upto), "before": F.lag("x").over(w), "after": F.lead("x").over(w)})
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert running(df.limit(0), ["k"], ["pos"], F.col("pos"), sums={"total": F.col("x")}).count() == 0


def test_paths_and_repeals_across_ranges(spark):
    rng = random.Random(3)
    heads = spark.createDataFrame([(d, p, rng.randrange(1, 7), f"h{p}") for d in "ab" for p in range(150)], "doc string, pos int, rank int, label string")
    assert sorted(map(str, C.heading_paths(heads, range_size=4).collect())) == sorted(map(str, C.heading_paths(heads).collect()))
    articles = spark.createDataFrame([(d, n, rng.random() < 0.8, "gone" if rng.random() < 0.9 else "other", "") for d in "ab" for n in range(200) if rng.random() < 0.95], "doc string, article_number int, is_repealed boolean, text_en string, text_ar string")
    assert sorted(map(str, C.merge_repealed(articles, range_size=3).collect())) == sorted(map(str, C.merge_repealed(articles).collect()))


def test_assembly_across_ranges(spark):
    """Pages one by one give the same articles, paths and anomalies as all pages together."""
    rng = random.Random(8)
    kinds = {"heading": ["PART I", "CHAPTER II", "PART III\nTitle", "1. Scope", "Title alone", "1. A\n2. B"], "article": ["Article {n}\ntext"], "continuation": ["goes on"], "repeal": ["Articles {n} - {m} were repealed"], "anomaly": ["stray"]}
    rows = []
    for doc in "ab":
        for page in range(25):
            for i in range(rng.randrange(1, 5)):
                kind = rng.choice(["heading", "heading", "article", "article", "continuation", "repeal", "anomaly"])
                n = len(rows) + 1
                rows.append((doc, page, i, kind, rng.choice(kinds[kind]).format(n=n, m=n + 1), ""))
    df = spark.createDataFrame(rows, "doc string, page int, row_index int, kind string, en_text string, ar_text string")
    small, whole = C.assemble(df, pages=1), C.assemble(df)
    for a, b in zip(small, whole, strict=True):
        got, want = sorted(map(str, a.collect())), sorted(map(str, b.collect()))
        assert got == want and got
