"""Calls that fail: waits, a run that fails and goes on, a memo that is never asked twice; counts taken while writing."""

import os

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import answering as A, quality as Q


def test_waits_are_used_up():
    tries = []

    def call(q):
        tries.append(q)
        if len(tries) < 3:
            raise OSError("busy")
        return q.upper()

    assert A.called(call, "a", (0.0, 0.0)) == "A" and len(tries) == 3
    tries.clear()
    with pytest.raises(A.CallFailed):
        A.called(call, "a", (0.0,))


def test_a_failed_run_goes_on(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"q{i}") for i in range(60)] + [(5, "q5"), (None, "no key"), (61, None)], "id int, q string")
    memo, log = str(tmp_path / "memo"), tmp_path / "log"
    log.mkdir()

    def asked(q, fails):
        # one file a call: workers are other processes
        with open(log / f"{q}-{os.getpid()}-{len(os.listdir(log))}", "w"):
            pass
        if q in fails:
            raise ConnectionError(q)
        return f"answer to {q}"

    with pytest.raises(Exception, match="q17"):
        A.answer_all(rows, lambda q: asked(q, {"q17"}), memo, key="id", question="q", waits=(), buckets=6, chunk=4)
    stored = spark.read.option("recursiveFileLookup", True).parquet(memo).count()
    assert 0 < stored < 61
    before = len(os.listdir(log))
    got = {r["key"]: r["answer"] for r in A.answer_all(rows, lambda q: asked(q, set()), memo, key="id", question="q", waits=(), buckets=6, chunk=4).collect()}
    assert got == {**{str(i): f"answer to q{i}" for i in range(60)}, "61": "answer to "}
    assert len(os.listdir(log)) - before == 61 - stored  # only what was left
    assert A.answer_all(rows.limit(0), lambda q: asked(q, set()), memo, key="id", question="q").count() == 0


def test_counts_are_taken_while_rows_are_written(spark, tmp_path):
    path = str(tmp_path / "rows")
    counts = {"n": F.count("*"), "even": F.count_if(F.col("id") % 2 == 0), "top": F.max("id")}
    assert Q.written_with_counts(spark.range(10), path, counts, {"n": (1, 10)}) == {"n": 10, "even": 5, "top": 9}
    with pytest.raises(Q.CountsWrong, match="even is 5, n is 10"):
        Q.written_with_counts(spark.range(10), path, counts, {"n": (11, 20), "even": (0, 4), "top": (0, 100)})
    assert spark.read.parquet(path).count() == 10
