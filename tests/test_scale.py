"""What must hold where a table is large or skewed: blocks, ranges, whole listings."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from corpusloom.operators import corpus as C, quality as Q, records as O, retrieval as R
from corpusloom.plans import retrieval as plans


def test_dense_search_in_blocks(spark):
    rng = np.random.default_rng(3)
    x = {i: rng.normal(size=8).tolist() for i in range(90)} | {90: None, 91: [0.0] * 8, 92: [1.0], 93: None}
    x[40] = x[7]
    df = spark.createDataFrame(list(x.items()), "id long, vec array<double>")
    asked = df.where("id % 9 = 7 OR id = 90").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    got = {}
    for r in R.dense_search(asked, df, k=6, block=16).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append((r["id"], r["score"]))

    def cosine(a, b):
        if a is None or b is None or len(a) != len(b) or not np.any(a) or not np.any(b):
            return 0.0
        return round(float(np.dot(a, b) / np.sqrt(np.dot(a, a)) / np.sqrt(np.dot(b, b))), 9)

    for q in [i for i in x if i % 9 == 7 or i == 90]:
        want = sorted(((i, cosine(x[q], v)) for i, v in x.items() if i != q), key=lambda p: (-p[1], p[0]))[:6]
        assert [i for i, _ in got[q]] == [i for i, _ in want] and np.allclose([s for _, s in got[q]], [s for _, s in want])
    assert R.dense_search(asked, df.limit(0), k=3).count() == R.dense_search(asked.limit(0), df, k=3).count() == 0


def test_islands_over_ranges(spark):
    rng = random.Random(1)
    values = sorted({rng.randint(-60, 200) for _ in range(180)})
    want, at = [], None
    for v in values:
        if at is not None and v == at[1] + 1:
            at[1] = v
        else:
            at = [v, v]
            want.append(at)
    df = spark.createDataFrame([(v, "g") for v in values] * 2, "v long, g string")
    for size in (1, 2, 7, 1000):
        got = sorted((r["first"], r["last"], r["n"]) for r in C.islands(df, "v", ["g"], range_size=size).collect())
        assert got == [(a, b, b - a + 1) for a, b in want]


def test_gaps_of_large_numbers(spark):
    rows = spark.createDataFrame([(1,), (3_000_000,), (3_000_000,), (None,)], "n long")
    out = Q.number_gaps(rows, "n", known=spark.range(3, 2_999_999).withColumnRenamed("id", "n")).collect()
    assert sorted(map(tuple, out)) == [(2, "missing"), (2_999_999, "missing"), (3_000_000, "duplicate")]
    assert Q.number_gaps(rows.limit(0), "n").count() == 0


def test_digest_of_a_set(spark):
    rows = spark.range(5000).repartition(7)
    one = O.set_digest(rows, "id", F.sha2(F.col("id").cast("string").cast("binary"), 256)).collect()
    want = hashlib.sha256("".join(hashlib.sha256(str(i).encode()).hexdigest() for i in range(5000)).encode()).hexdigest()
    assert [r["digest"] for r in one] == [want]
    assert O.set_digest(rows.limit(0), "id", F.lit("x")).head()["digest"] == hashlib.sha256(b"").hexdigest()


def test_all_failed_checks_are_named(spark):
    rows = spark.range(150).select(F.format_string("c%03d", "id").alias("check_id"), F.lit(False).alias("passed"))
    try:
        Q.require(rows)
    except ValueError as e:
        assert "c000" in str(e) and "c149" in str(e)
    else:
        raise AssertionError


def test_items_of_one_or_two_tokens_are_found(spark, tmp_path):
    docs = [(1, "the brown fox"), (2, "xfoxy"), (3, "a-b"), (4, "nothing"), (5, "one two three four"), (6, "!?"), (7, None)]
    items = [(10, "fox"), (11, "a-b"), (12, "one two three"), (13, "!"), (14, ""), (15, "absent"), (16, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(map(tuple, plans.expected(spark, str(tmp_path)).collect())) == [(10, 1), (10, 2), (11, 3), (12, 5), (13, 6)]


def test_the_index_follows_its_files(spark, tmp_path):
    write = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    write([(1, "a b a")])
    first = plans.indexed(spark, str(tmp_path))
    assert [tuple(t) for t in first.head()["terms"]] == [("a", 2), ("b", 1)] and plans.indexed(spark, str(tmp_path)).inputFiles() == first.inputFiles()
    write([(1, "c")])
    assert [tuple(t) for t in plans.indexed(spark, str(tmp_path)).head()["terms"]] == [("c", 1)]


def test_drift_windows_over_ranges(spark):
    from corpusloom.operators import monitor as M

    rng = np.random.default_rng(2)
    at = {g: sorted(rng.choice(400, 60 if g else 5, replace=False).tolist()) for g in range(3)}
    rows = [(g, o, rng.normal(size=4).tolist()) for g, places in at.items() for o in places]
    df = spark.createDataFrame(rows, "g int, o long, v array<double>")
    base = M.drift_baseline(df, "v")
    b = base.head()
    cosine = lambda v: float(np.dot(v, b["centroid"]) / np.linalg.norm(v) / np.linalg.norm(b["centroid"]))
    for size in (1, 7, 50, 10_000):
        got = {(r["g"], r["o"]): (r["ratio"], r["line"]) for r in M.drift_windows(df, base, vector="v", order="o", by=["g"], last=8, range_size=size).collect()}
        assert len(got) == len(rows)
        for g in at:
            c = [cosine(v) for h, _, v in rows if h == g]
            for i, o in enumerate(at[g]):
                part = c[max(0, i - 7) : i + 1]
                assert np.allclose(got[g, o], (np.mean(part) / b["mean"], 1 - 3 * b["std"] / (b["mean"] * len(part) ** 0.5)), atol=2e-6)
