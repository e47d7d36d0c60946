"""What searches move: no postings and no index."""

import random

from pyspark.sql import functions as F

from corpusloom.operators import retrieval as R
from corpusloom.plans import catalogue


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def searched(spark, rng, ids):
    words = lambda n: [rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randrange(n))]
    docs = spark.createDataFrame([(i, words(60)) for i in ids] + [(ids[0] + ids[1], None)], ["id", "w"]).repartition(5)
    asked = spark.createDataFrame([(q, words(9)) for q in ["x", "y", None, "z"]] + [("none", ["zzz"]), ("empty", [])], "qid string, words array<string>")
    return asked, R.token_index(docs, F.col("w"), id="id")


def test_search_scores_documents_where_they_are(spark):
    """The lists are those of postings that meet terms, ties and all, and no posting is shuffled."""
    rng = random.Random(10)
    for ids in (list(range(300)), [f"d{i}" for i in range(300)]):
        asked, index = searched(spark, rng, ids)
        for b in (R.B, 0.0):
            here, meet = R.bm25_search(asked, index, k=7, b=b), R.bm25_search(asked, index, k=7, b=b, broadcast_rows=0)
            got = sorted(map(str, here.collect()))
            assert got == sorted(map(str, meet.collect())) and len(got) > 20
            assert "Generate" not in plan(here) and "Generate" in plan(meet)


def test_search_in_small_blocks(spark):
    """Blocks of some documents, whose equal scores are more than k, give what one block gives."""
    rows = [(i, ["a"] * (1 + i % 2) + ["b"] * (i % 5 == 0)) for i in range(200)]
    index = R.token_index(spark.createDataFrame(rows, "id long, w array<string>").repartition(3), F.col("w"), id="id")
    asked = spark.createDataFrame([(q, "a" if q % 2 else "b", 1 + q % 3) for q in range(6)], "qid long, term string, times long")
    found = [R.ranked(R.best_by_task(asked, index, k=4, k1=R.K1, b=R.B, block=n), F.desc("score"), F.asc("id"), k=4).collect() for n in (1, 50, 1 << 18)]
    assert len(found[0]) == 24 and sorted(found[0]) == sorted(found[1]) == sorted(found[2])
    nothing = R.best_by_task(asked.limit(0), index, k=4, k1=R.K1, b=R.B)
    assert nothing.columns == ["qid", "id", "score"] and nothing.count() == 0


def test_list_without_stopwords_reads_the_index_as_it_is(spark):
    """Where lengths do not count, no document's terms are filtered first; the lists are as in the SQL."""
    out = plan(catalogue.QUERIES["rrf_fusion"](spark, "/root/testdata/sf0.001"))
    assert "aggregate(" not in out and "filter(terms" not in out


def test_reranking_does_not_shuffle_the_index(spark):
    out = plan(catalogue.QUERIES["rerank_head"](spark, "/root/testdata/sf0.001"))
    assert "SortMergeJoin [id" not in out
