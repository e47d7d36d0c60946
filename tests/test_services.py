"""Table functions, subwords, student training and ruled tables, by hand and against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import subwords, tables
from corpusloom.operators import cells as C, student as L


def packed(texts, most):
    out = []
    for t in (t for t in texts if t is not None):
        if out and len(out[-1]) + 1 + len(t) <= most:
            out[-1] += "\n" + t
        else:
            out.append(t)
    return out


def test_chunks_by_the_table_function(spark):
    tables.register(spark)
    rng = np.random.default_rng(1)
    docs = {d: [None if rng.random() < 0.1 else "x" * int(rng.integers(0, 30)) for _ in range(40)] for d in range(7)}
    spark.createDataFrame([(d, i, t) for d, ts in docs.items() for i, t in enumerate(ts)], "doc long, at int, text string").repartition(5).createOrReplaceTempView("paragraphs")
    got = spark.sql("SELECT * FROM chunk_parts(TABLE(paragraphs) PARTITION BY (doc) ORDER BY (at), 50)").collect()
    for d, ts in docs.items():
        mine = sorted((r for r in got if r["doc"] == d), key=lambda r: r["part"])
        assert [r["text"] for r in mine] == packed(ts, 50) and [r["part"] for r in mine] == list(range(1, len(mine) + 1))
        kept = [i for i, t in enumerate(ts) if t is not None]
        assert sum(r["paragraphs"] for r in mine) == len(kept) and [r["first"] for r in mine] == [kept[sum(m["paragraphs"] for m in mine[:i])] for i in range(len(mine))]
    spark.sql("SELECT * FROM paragraphs WHERE false").createOrReplaceTempView("no_paragraphs")
    assert spark.sql("SELECT * FROM chunk_parts(TABLE(no_paragraphs) PARTITION BY (doc) ORDER BY (at), 50)").count() == 0


@pytest.mark.parametrize("rows_of_part", [4096, 5])
def test_centroids(spark, rows_of_part):
    rng = np.random.default_rng(2)
    rows = [(i, i % 3 if i % 7 else None, rng.normal(size=4).tolist() if i % 11 else None) for i in range(300)]
    got = tables.centroids(spark, spark.createDataFrame(rows, "id long, label int, v array<double>"), by="label", vector="v", salt="id", rows_of_part=rows_of_part, parts=3).collect()
    assert list(got[0].__fields__) == ["label", "n", "centroid"]
    for r in got:
        mine = np.array([v for _, b, v in rows if b == r["label"] and v is not None])
        assert r["n"] == len(mine) and np.allclose(r["centroid"], mine.mean(0))
    assert {r["label"] for r in got} == {None, 0, 1, 2}


def test_the_aggregate_alone(spark):
    tables.register(spark)
    spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 4.0]), (1, None), (2, None)], "k int, v array<double>").createOrReplaceTempView("some_vectors")
    assert {r["k"]: r["s"] for r in spark.sql("SELECT k, vector_sum(v) AS s FROM some_vectors GROUP BY k").collect()} == {1: [4.0, 6.0], 2: []}


def longest(word, pieces, inner):
    out, at = [], 0
    while at < len(word):
        fits = [p for p in pieces if word[at:].startswith(p[len(inner) :] if p.startswith(inner) else p) and (p.startswith(inner) == bool(at) if inner else True)]
        fits = [p for p in fits if len(p) > (len(inner) if at else 0)]
        if not fits:
            return ["[UNK]"]
        best = max(fits, key=len)
        out.append(best)
        at += len(best) - (len(inner) if inner and at else 0)
    return out


@pytest.mark.parametrize("inner", ["", "##"])
def test_subwords_against_brute_force(spark, inner):
    rng = np.random.default_rng(3)
    word = lambda most: "".join(rng.choice(list("abcé"), rng.integers(1, most)))
    plain = {word(5) for _ in range(30)} | set("abc")
    vocabulary = sorted(plain | {inner + p for p in plain}) if inner else sorted(plain)
    words = [word(12) for _ in range(300)] + ["", "x", "a" * 101]
    rows = [(0, words), (1, None), (2, []), (3, [None, "ab", "ab"])]
    cut = subwords.subword_tokens(vocabulary, inner=inner)
    got = {r["id"]: r["p"] for r in spark.createDataFrame(rows, "id int, w array<string>").select("id", cut(F.col("w")).alias("p")).collect()}
    want = [p for w in words for p in (longest(w, vocabulary, inner) if len(w) <= 100 else ["[UNK]"])]
    assert list(got[0]) == want and got[1] is None and list(got[2]) == [] and list(got[3]) == longest("ab", vocabulary, inner) * 2
    with pytest.raises(ValueError):
        subwords.subword_tokens(["a"] * (subwords.MAX_PIECES + 1))


@pytest.mark.parametrize("loss", ["mse", "bce"])
def test_training_agrees_with_one_machine(spark, loss):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 5))
    z = x @ np.array([1.0, -2.0, 0.5, 0.0, 3.0]) + 0.1 * rng.normal(size=500)
    y = z if loss == "mse" else (z > 0).astype(float)
    rows = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y, strict=True)] + [(None, 1.0), ([1.0] * 5, None), ([1.0], 1.0), ([None] * 5, 1.0)], "x array<double>, y double").repartition(6)
    got, losses = L.train_student(rows, loss=loss, rounds=15, rate=0.1, weight_decay=0.01)
    w, want = np.zeros(5), []
    for _ in range(15):
        g, lost = L.loss_gradient(x, y, w, loss)
        want.append(lost / 500)
        w = w - 0.1 * (g / 500 + 0.01 * w)
    assert np.allclose(got, w) and np.allclose(losses, want) and losses[-1] < losses[0]
    # the gradient is that of the loss
    at, step = rng.normal(size=5), 1e-6
    g = L.loss_gradient(x, y, at, loss)[0]
    for i in range(5):
        up, down = at.copy(), at.copy()
        up[i] += step
        down[i] -= step
        assert g[i] == pytest.approx((L.loss_gradient(x, y, up, loss)[1] - L.loss_gradient(x, y, down, loss)[1]) / (2 * step), rel=1e-4, abs=1e-3)
    score = L.student_score(F.col("x"), got, logistic=loss == "bce")
    shown = spark.createDataFrame([(x[0].tolist(),)], "x array<double>").select(score).first()[0]
    assert shown == pytest.approx(x[0] @ w if loss == "mse" else 1 / (1 + np.exp(-x[0] @ w)))


def test_training_without_rows(spark):
    none = spark.createDataFrame([], "x array<double>, y double")
    assert L.train_student(none, start=[1.0, 2.0]) == ([1.0, 2.0], [])
    with pytest.raises(ValueError):
        L.train_student(none, loss="other")


LINES = "page int, x0 double, y0 double, x1 double, y1 double"


def flat(y, x0=0.0, x1=100.0, page=1):
    return page, x0, y, x1, y


def upright(x, y0, y1, page=1):
    return page, x, y0, x, y1


def test_ruled_rows(spark):
    lines = [
        flat(0.0), flat(10.0), flat(10.4), flat(20.0), flat(30.0), flat(60.0), flat(70.0), upright(0.0, 0.0, 30.0), upright(50.0, 0.0, 30.0), upright(100.0, 0.0, 20.0), upright(25.0, 10.0, 20.0), upright(60.0, 12.0, 15.0),
        upright(0.0, 60.0, 70.0), upright(100.5, 60.0, 70.0), upright(100.0, 60.0, 70.0), flat(5.0, page=2), (3, 0.0, 0.0, 50.0, 50.0),
    ]
    glyphs = [(1, 60.0, 5.0, "r"), (1, 10.0, 5.0, "a"), (1, 5.0, 5.0, "b"), (1, 5.0, 3.0, "first"), (1, 30.0, 15.0, "x"), (1, 20.0, 15.0, "y"), (1, 10.0, 20.0, "edge"), (1, 70.0, 25.0, "none"), (1, 10.0, 40.0, "between"), (1, 80.0, 65.0, "t"), (2, 1.0, 1.0, "p")]
    df = spark.createDataFrame(lines, LINES)
    got = {(r["table"], r["row"]): (r["last"], r["left"], r["right"]) for r in C.row_texts(df, spark.createDataFrame(glyphs, "page int, x double, y double, text string")).collect()}
    # the second table is one cell of the whole width: its middle is the table's, so it is on the right
    assert got == {(0, 0): (False, "first b a", "r"), (0, 1): (False, "y x", ""), (0, 2): (True, "edge", None), (1, 0): (True, None, "t")}
    cells = {(r["table"], r["row"], r["x0"], r["x1"]) for r in C.grid(df).collect()}
    assert {c for c in cells if c[:2] == (0, 1)} == {(0, 1, 0.0, 25.0), (0, 1, 25.0, 50.0), (0, 1, 50.0, 100.0)}
    assert C.row_texts(df.limit(0), spark.createDataFrame([], "page int, x double, y double, text string")).count() == 0
