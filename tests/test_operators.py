"""Hand-computed cases of retrieval, evaluation, corpus and quality operators."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import corpus as C, evaluate as E, monitor as M, quality as Q, retrieval as R


def lists(spark, *rows):
    return [spark.createDataFrame([("q", x, i + 1) for i, x in enumerate(r)], "qid string, id string, rank int") for r in rows]


def test_rrf_scores(spark):
    rows = R.rrf(lists(spark, "abc", "bcd"), k=60).orderBy("rank").collect()
    assert [r["id"] for r in rows] == ["b", "c", "a", "d"]
    assert rows[0]["rrf"] == pytest.approx(1 / 62 + 1 / 61)
    assert rows[3]["rrf"] == pytest.approx(1 / 63)


def test_rrf_repeat_keeps_later_ranks(spark):
    rows = {r["id"]: r["rrf"] for r in R.rrf(lists(spark, "aab")).collect()}
    assert rows == {"a": pytest.approx(1 / 61), "b": pytest.approx(1 / 63)}


def test_rrf_ties_and_errors(spark):
    assert [r["id"] for r in R.rrf(lists(spark, "b", "a")).orderBy("rank").collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        R.rrf(lists(spark, "a"), k=-1)


def test_bm25_repeated_terms_and_missing_terms(spark):
    docs = spark.createDataFrame([(1, ["x", "y"]), (2, ["x", "x", "z"]), (3, []), (4, None)], "id int, w array<string>")
    index = R.token_index(docs, F.col("w"), id="id")
    assert {r["id"]: (r["dl"], [tuple(t) for t in r["terms"]]) for r in index.collect()} == {1: (2, [("x", 1), ("y", 1)]), 2: (3, [("x", 2), ("z", 1)]), 3: (0, []), 4: (0, [])}
    assert {r["id"]: (r["dl"], len(r["terms"])) for r in R.without_terms(index, ["x"]).collect()} == {1: (1, 1), 2: (1, 1), 3: (0, 0), 4: (0, 0)}
    asked = spark.createDataFrame([("a", ["x"]), ("b", ["x", "x"]), ("c", ["none"]), ("d", [])], "qid string, words array<string>")
    rows = R.bm25_search(asked, index, k=5).collect()
    score = {(r["qid"], r["id"]): r["score"] for r in rows}
    assert set(score) == {("a", 1), ("a", 2), ("b", 1), ("b", 2)}
    assert score["b", 1] == pytest.approx(2 * score["a", 1], abs=1e-8)


def test_inserted_chunk_never_expands(spark):
    ranked = spark.createDataFrame([("q", 1, "a"), ("q", 2, "b")], "qid string, rank int, id string")
    cites = spark.createDataFrame([("a", ["b"]), ("b", ["c"])], "id string, cited array<string>")
    rows = R.expand_citations(ranked, cites, top_k=5).orderBy("position").collect()
    assert [(r["id"], r["cited_by"]) for r in rows] == [("a", None), ("b", "a")]


def stack_paths(ranks):
    open_, out = [], []
    for i, r in enumerate(ranks):
        open_ = [(k, n) for k, n in open_ if k < r] + [(r, str(i))]
        out.append([n for _, n in open_])
    return out


def test_heading_paths_equal_a_stack(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for doc in range(60):
        ranks = [rng.randint(1, 7) for _ in range(rng.randint(1, 25))]
        rows += [(doc, i, r, str(i)) for i, r in enumerate(ranks)]
        want |= {(doc, i): p for i, p in enumerate(stack_paths(ranks))}
    got = C.heading_paths(spark.createDataFrame(rows, "doc int, pos int, rank int, label string")).collect()
    assert {(r["doc"], r["pos"]): r["path"] for r in got} == want


def test_split_is_stable_when_questions_are_added(spark):
    rng = random.Random(3)
    rows = [(f"q{i:03d}", None if i % 5 else f"p{i // 10}", rng.choice("ab"), rng.choice(["english", "msa"])) for i in range(60)]
    kind = "qid string, pair_id string, kind string, register string"
    half = lambda n: {r["qid"]: r["half"] for r in E.balanced_split(spark.createDataFrame(rows[:n], kind)).collect()}
    few, many = half(40), half(60)
    assert all(many[q] == h for q, h in few.items())
    assert abs(sum(h == "tuning" for h in many.values()) - 30) <= 2


def test_errata_must_match_once(spark):
    rows = spark.createDataFrame([(1, 1, "a\nb\na", "", None, None)], "page int, row_index int, en_text string, ar_text string, en_all_bold boolean, ar_all_bold boolean")
    kind = "n int, page int, row int, side string, expect string, replace string"
    fixed, problems = C.apply_errata(rows, spark.createDataFrame([(1, 1, 1, "en", "b", "c"), (2, 1, 1, "en", "a", "x"), (3, 9, 9, "en", "a", "x")], kind))
    assert fixed.head()["en_text"] == "a\nc\na"
    assert sorted((r["n"], r["found"]) for r in problems.collect()) == [(2, 2), (3, 0)]


def test_append_rejects_clashes(spark):
    old, new = spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(2,), (3,), (4,), (4,)], "id int")
    joined, clashes = C.append_checked(old, new, id="id")
    assert sorted(r["id"] for r in joined.collect()) == [1, 2, 3]
    assert sorted(r["id"] for r in clashes.collect()) == [2, 4]


def test_error_rate_without_gold_is_one(spark):
    assert Q.character_error_rate(spark.createDataFrame([], "got string, gold string"), "got", "gold").head()["cer"] == 1.0


def test_failed_checks_raise(spark):
    checks = Q.check_rows(spark.createDataFrame([(1,)], "n int"), {"a": (F.col("n") == 1, F.col("n")), "b": (F.col("n") > 1, F.col("n"))})
    with pytest.raises(ValueError, match="b"):
        Q.require(checks)


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "qid string, hit_1 boolean, hit_3 boolean, hit_5 boolean, hit_10 boolean, reciprocal double")
    row = E.summary(none).head()
    assert (row["questions"], row["recall_5"], row["mrr"]) == (0, 0.0, 0.0)
    assert M.drift_baseline(spark.createDataFrame([], "v array<double>"), "v").count() == 0
    assert M.histogram(spark.createDataFrame([], "t string, v double"), "v", ["t"]).count() == 0


def test_quantile_beyond_the_last_bound(spark):
    rows = spark.createDataFrame([("a", 500.0)] * 3, "t string, v double")
    out = M.histogram_quantile(M.histogram(rows, "v", ["t"], (1.0, 2.0)), 0.5, ["t"]).head()
    assert out["quantile"] == 2.0
