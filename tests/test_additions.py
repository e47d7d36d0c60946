"""Glyph measures, report rows, judges, settings, runs, paged sources and plugged-in models."""

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from corpusloom.functions import glyphs as G, models
from corpusloom.operators import monitor as M, quality as Q, records as O, retrieval as R
from corpusloom.sources import paged, records as S

BOX = "array<struct<c:string,x0:double,y0:double,x1:double,y1:double>>"


def box(c, x):
    return (c, x, 0.0, x + 2, 10.0)


def test_highlighted_text(spark):
    line = [box(c, 2.0 * i) for i, c in enumerate(". ab cd")]
    fills = [[(3.0, 0.0, 9.0, 10.0)], [], [(0.0, 0.0, 100.0, 10.0)], [(0.0, 20.0, 100.0, 30.0)], [(4.0, 0.0, 5.0, 10.0)], [(4.0, 0.0, 5.1, 10.0)]]
    rows = spark.createDataFrame([(i, line, f) for i, f in enumerate(fills)], f"i int, line {BOX}, fills array<struct<x0:double,y0:double,x1:double,y1:double>>")
    got = [r["t"] for r in rows.orderBy("i").select(G.highlighted_text(F.col("line"), F.col("fills")).alias("t")).collect()]
    assert got == ["ab", "", "ab cd", "", "", "a"]


def test_vertical_overlap(spark):
    rows = spark.createDataFrame([(0.0, 10.0, 5.0, 25.0), (0.0, 10.0, 20.0, 30.0), (0.0, 0.0, 0.0, 5.0), (0.0, 10.0, 2.0, 4.0)], "a double, b double, c double, d double")
    assert [r[0] for r in rows.select(G.vertical_overlap(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()] == [0.5, 0.0, 0.0, 1.0]


def test_defects(spark):
    thin, wide = ("ا", 5.0, 5.0), ("ا", 5.0, 7.0)
    spans = [[("x", 1.0, 2.0), thin, ("ل", 5.0, 7.0), ("y", 8.0, 9.0)], [wide, ("ل", 5.0, 7.0)], [thin], [], [("٣", 9.0, 10.0), ("٢", 5.0, 6.0), ("a", 0.0, 1.0), ("١", 1.0, 2.0), ("٢", 3.0, 4.0)], [("١", 1.0, 2.0), ("٢", 5.0, 6.0), ("٣", 3.0, 4.0)], [("١", 1.0, 2.0)]]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(spans)], f"i int, g {G.GLYPHS}")
    got = rows.orderBy("i").select(G.broken_lam_alefs(F.col("g")).alias("b"), G.digit_runs(F.col("g")).alias("d")).collect()
    assert [r["b"] for r in got] == [["xالy"], [], [], [], [], [], []]
    assert [tuple(r["d"]) for r in got][3:] == [(0, 0, 0), (1, 1, 0), (0, 0, 1), (0, 0, 0)]


def test_report_rows(spark):
    rows = spark.createDataFrame([("Base", "q8"), ("None", "zz")], "name string, generator string")
    table = spark.createDataFrame([("q8", 0.5, 3)], "label string, faith double, n int")
    out = O.report_rows(rows, {"generator": (table, "label")})
    assert O.markdown_table(out, ["name"]) == "| name | generator | faith | n |\n| --- | --- | --- | --- |\n| Base | q8 | 0.500 | 3 |\n| None | zz | – | – |\n"
    with pytest.raises(Exception, match="label twice"):
        O.report_rows(rows, {"generator": (table.unionByName(table), "label")}).collect()


def test_markdown_is_whole(spark):
    assert len(O.markdown_table(spark.range(1500), ["id"]).splitlines()) == 1502


def test_questions_of_articles(spark):
    asked = O.question_requests(spark.createDataFrame([(n,) for n in (7, 3, 5)], "article_number int"))
    assert {r[0]: r[1] for r in asked.collect()} == {3: "ar", 5: "en", 7: "ar"}
    replies = [(3, 1, "about long latin"), (3, 2, "ما هذا؟"), (5, 1, "ما"), (5, 2, None), (5, 3, "What?"), (7, 4, "ما هذا؟")]
    got = O.accepted_questions(asked, spark.createDataFrame(replies, "article_number int, attempt int, reply string")).collect()
    assert [tuple(r) for r in got] == [(3, "ar", "ما هذا؟")]


def test_gates_settings_and_judges(spark):
    facts = spark.createDataFrame([(3, 0.5)], "pages int, share double")
    assert {r["gate"]: r["passed"] for r in Q.profile_gates(facts, {"pages": 3, "share": 0.4, "rows": 1}).collect()} == {"pages": True, "share": False, "rows": False}
    settings = [("a", "path", "x/y"), ("b", "path", "/x"), ("c", "path", "x/../y"), ("d", "url", "https://x"), ("e", "url", "ftp://x"), ("f", "revision", "0" * 40), ("g", "revision", "xyz"), ("h", "text", " "), ("i", "bucket", None), ("j", "odd", "x"), ("k", "experiment", "a.b-c")]
    bad = {r["name"]: r["problem"] for r in Q.setting_problems(spark.createDataFrame(settings, "name string, kind string, value string")).collect()}
    assert bad == {"b": "no path", "c": "no path", "e": "no url", "g": "no revision", "h": "no text", "i": "missing", "j": "unknown kind"}
    Q.check_endpoints({"model": "a", "url": "u"}, {"model": "b", "url": "u"})
    for generator, judge, what in (({"model": "a", "url": ""}, {"model": None}, "generator.url, judge.model"), ({"model": "a"}, {"model": "a"}, "both")):
        with pytest.raises(ValueError, match=what):
            Q.check_endpoints(generator, judge)
    replies = ['{"faith": 0.5, "cp": "x"}', "no json", None, '{"faith": 2, "cp": 1}']
    rows = Q.judged(spark.createDataFrame([(r,) for r in replies], "reply string"), "reply", ["faith", "cp"]).collect()
    assert [(r["faith"], r["cp"]) for r in rows] == [(0.5, None), (None, None), (None, None), (None, 1.0)]


def test_span_rollup_and_observation(spark):
    spans = spark.createDataFrame([("t", "a", None, 0.0, 10.0), ("t", "b", "a", 1.0, 4.0), ("t", "c", "a", 4.0, 6.0), ("t", "d", "b", 1.0, 9.0)], "trace_id string, span_id string, parent_id string, began double, ended double")
    assert {r["span_id"]: (r["n_children"], r["total"], r["own"]) for r in M.span_rollup(spans).collect()} == {"a": (2, 10.0, 5.0), "b": (1, 3.0, 0.0), "c": (0, 2.0, 2.0), "d": (0, 8.0, 8.0)}
    seen = Observation()
    assert M.observed(spark.range(10), seen, n=F.count("*"), top=F.max("id")).count() == 10 and seen.get == {"n": 10, "top": 9}


def test_models_are_batched(spark):
    def make():
        def score(questions, texts):
            assert len(texts) <= 4
            return [len(q) / (1 + len(t)) for q, t in zip(questions, texts, strict=True)]

        return score

    rows = spark.createDataFrame([("q", i + 1, "x" * i if i != 5 else None, "ab") for i in range(11)], "qid string, rank int, text string, question string").coalesce(1)
    out = R.rerank(rows, models.batched_scorer(make, batch=4), question="question", text="text", depth=20).orderBy("final_rank").collect()
    assert [r["rank"] for r in out] == [1, 2, 3, 4, 5, 7, 8, 9, 10, 11, 6] and out[0]["rerank"] == 2.0 and out[-1]["rerank"] is None
    kept = R.rerank(rows, R.scorer_named("none"), question="question", text="text", depth=20).orderBy("final_rank").collect()
    assert [r["rank"] for r in kept] == list(range(1, 12)) and kept[0]["rerank"] is None
    with pytest.raises(ValueError, match="token_overlap"):
        R.scorer_named("other")
    embedder = models.batched_embedder(lambda: lambda texts: [[3.0, 4.0 * len(t)] for t in texts], batch=2)
    vecs = {r["text"]: r["vec"] for r in R.embedded(rows.select("text"), embedder, text="text", dim=2).collect()}
    assert vecs["x"] == [0.6, 0.8] and vecs[None] is None and vecs[""] is None
    with pytest.raises(Exception, match="expected 3 numbers"):
        R.embedded(rows, embedder, text="text", dim=3).collect()


def test_predictions(spark):
    lists = spark.createDataFrame([("a", 1, 5), ("a", 2, 6), ("a", 3, 5), ("a", 4, 7)], "qid string, rank int, id int")
    chunks = spark.createDataFrame([(5, "five"), (6, "six"), (7, "seven")], "id int, citation string")
    asked = spark.createDataFrame([("a",), ("b",)], "qid string")
    assert {r[0]: r[1] for r in R.predictions(asked, lists, chunks, top_k=3).collect()} == {"a": ["five", "six", "five"], "b": []}


def test_paged_source(spark):
    def fetch(cursor, query="x", size="2"):
        at = int(cursor or 0)
        rows = [(query, i) for i in range(at, min(at + int(size), 5))]
        return rows, str(at + int(size))

    spark.dataSource.register(paged.paged_source("test_pages", fetch, "query string, n int"))
    assert [r["n"] for r in spark.read.format("test_pages").load().orderBy("n").collect()] == [0, 1, 2, 3, 4]
    two = spark.read.format("test_pages").option("query", "a,b").option("size", "3").load()
    assert two.count() == 10 and {r["query"] for r in two.collect()} == {"a", "b"} and two.rdd.getNumPartitions() == 2


def test_stage_runs(spark, tmp_path):
    path = f"{tmp_path}/runs"
    with paged.stage_run(spark, path, "one", {"k": 1}) as metrics:
        metrics["n"] = 3
    with pytest.raises(ZeroDivisionError), paged.stage_run(spark, path, "two"):
        1 / 0
    with pytest.raises(KeyboardInterrupt), paged.stage_run(spark, path, "three"):
        raise KeyboardInterrupt
    got = {r["stage"]: r for r in spark.read.parquet(path).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"one": "FINISHED", "two": "FAILED", "three": "KILLED"}
    assert got["one"]["params"] == {"k": "1"} and got["one"]["metrics"] == {"n": 3.0} and "ZeroDivision" in got["two"]["error"] and got["one"]["ended"] >= got["one"]["began"]


def test_evidence_is_the_same_twice(spark, tmp_path):
    for name in ("a", "b"):
        df = spark.createDataFrame([(2, "x"), (1, "y")], "id int, t string").repartition(2)
        S.write_evidence({"rows": (df, ["id"])}, {"n": 2}, f"{tmp_path}/{name}")
    text = lambda d, part: next((tmp_path / d / part).glob("part-*")).read_bytes()
    assert text("a", "rows") == text("b", "rows") == b"id\tt\n1\ty\n2\tx\n" and text("a", "summary") == text("b", "summary")
