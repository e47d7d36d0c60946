"""Streams with an exactly-once sink, joins by time and timers: against plain Python, killed and run again."""

import hashlib
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.sources.scores import MANIFEST, ScoreWriter, Scores, Staged, gauges, read_scores
from corpusloom.streaming.answers import answer_stream
from corpusloom.streaming.readings import joined_readings
from corpusloom.streaming.scoring import sampled_periods, scored

TRACES = "id long, ts timestamp, value double"
SCORES = "period long, id long, ts timestamp, value double, score double"


@pytest.fixture(autouse=True)
def state_store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def score(p: pd.DataFrame) -> pd.Series:
    return p["value"] / (1 + p["value"])


def traces(spark, rows, path):
    spark.createDataFrame([(i, float(t), v) for i, t, v in rows], "id long, t double, value double").select("id", F.timestamp_seconds("t").alias("ts"), "value").coalesce(1).write.mode("append").parquet(path)


def drained(spark, df, log, **options):
    """Runs a stream until all there is was read."""
    writer = df.writeStream.option("checkpointLocation", log).trigger(availableNow=True)
    for k, v in options.items():
        writer = writer.option(k, v)
    return writer


def sample(rows, n, seconds, until):
    by = {}
    for i, t, v in rows:
        by.setdefault(int(t // seconds * seconds), set()).add((hashlib.md5(f"0:{i}".encode()).hexdigest(), str(i), i, v))
    return sorted((p, i, v / (1 + v)) for p, xs in by.items() if p + seconds <= until for _, _, i, v in sorted(xs)[:n])


def evaluated(spark, place):
    source = spark.readStream.schema(TRACES).parquet(f"{place}/in")
    out = scored(sampled_periods(source, ts="ts", id="id", seconds=100, n=3, late="10 seconds"), score)
    spark.dataSource.register(Scores)
    drained(spark, out, f"{place}/log").format("scores").option("path", f"{place}/scores").start().awaitTermination()
    return sorted((r["period"], r["id"], r["score"]) for r in read_scores(spark, f"{place}/scores", SCORES).collect())


def test_periods_are_sampled_and_scored_once(spark, tmp_path):
    place = str(tmp_path)
    assert read_scores(spark, f"{place}/scores", SCORES).count() == 0 and gauges(spark, f"{place}/scores").count() == 0
    rows = [(i, i * 7 % 500, float(i % 13)) for i in range(200)]
    traces(spark, rows, f"{place}/in")
    want = sample(rows, 3, 100, max(t for _, t, _ in rows) - 10)
    assert evaluated(spark, place) == want and len(want) == 12
    assert evaluated(spark, place) == want  # nothing new
    # rows of closed periods are late, later ones close the last period
    late = [(900 + i, 20, 1.0) for i in range(50)]
    more = [(300 + i, 450 + i * 10, 2.0) for i in range(30)]
    traces(spark, late, f"{place}/in")
    traces(spark, more, f"{place}/in")
    every = sample(rows + more, 3, 100, 740 - 10)
    assert evaluated(spark, place) == every and len(every) > len(want)
    seen = gauges(spark, f"{place}/scores").where("n > 0").collect()
    assert sum(r["n"] for r in seen) == len(every)
    assert sum(r["n"] * r["mean"] for r in seen) == pytest.approx(sum(x[2] for x in every))


@pytest.mark.parametrize("after", ["tasks", "commit"])
def test_a_killed_run_writes_each_score_once(spark, tmp_path, monkeypatch, after):
    """The engine's own record of the last batch is lost: the batch runs again, with the sink's commit done or not."""
    place = str(tmp_path)
    rows = [(i, i * 7 % 500, float(i % 13)) for i in range(200)]
    traces(spark, rows, f"{place}/in")
    want = evaluated(spark, place)
    files = sorted(os.listdir(f"{place}/scores/rows"))
    for folder in (f"{place}/log/commits", f"{place}/log/state"):
        assert os.path.isdir(folder)
    commits = sorted((x for x in os.listdir(f"{place}/log/commits") if x[0] != "."), key=int)
    with_rows = max(int(x["batch"]) for x in spark.read.schema(MANIFEST).json(f"{place}/scores/batches").where("rows > 0").collect())
    for c in (x for x in commits if int(x) >= with_rows):
        os.remove(f"{place}/log/commits/{c}")
        if os.path.exists(f"{place}/log/commits/.{c}.crc"):
            os.remove(f"{place}/log/commits/.{c}.crc")
        if after == "tasks":
            os.remove(f"{place}/scores/batches/{int(c):012d}.json")
    assert (read_scores(spark, f"{place}/scores", SCORES).count() == 0) == (after == "tasks")
    assert evaluated(spark, place) == want
    assert len(os.listdir(f"{place}/scores/rows")) >= len(files)


def test_the_writer_alone(tmp_path):
    import pyarrow as pa

    place = str(tmp_path / "s")
    batch = pa.RecordBatch.from_pydict({"id": [1, 2], "score": [0.5, None]})
    writer = ScoreWriter(place, "score")
    assert writer.write(iter([])) == Staged(None, 0, 0.0)
    one, two = writer.write(iter([batch])), writer.write(iter([batch, batch]))
    assert (one.rows, one.total, two.rows, two.total) == (1, 0.5, 2, 1.0)
    writer.commit([one, None, Staged(None, 0, 0.0)], 0)
    writer.commit([two], 0)  # batch 0 is there
    assert os.listdir(f"{place}/rows") == [one.file]
    three = writer.write(iter([batch]))
    writer.abort([three, None], 1)
    assert os.listdir(f"{place}/rows") == [one.file] and len(os.listdir(f"{place}/batches")) == 1


def readings(spark, rows, path):
    spark.createDataFrame(rows, "host string, t double, value long").select("host", F.timestamp_seconds(F.col("t") + 1000).alias("ts"), "value").coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("how", ["inner", "leftOuter", "leftSemi"])
def test_readings_of_two_samplers(spark, tmp_path, how):
    place = str(tmp_path)
    fields = "host string, ts timestamp, value long"
    got, left, right = [], [], []
    for step in range(3):  # each step's rows come in a run of their own
        a = [(f"h{i % 3}", step * 1000.0 + i * 10, i) for i in range(60)]
        b = [(f"h{i % 4}", step * 1000.0 + i * 17, 100 + i) for i in range(30)]
        readings(spark, a, f"{place}/a")
        readings(spark, b, f"{place}/b")
        left, right = left + a, right + b
        streams = [spark.readStream.schema(fields).parquet(f"{place}/{x}") for x in "ab"]
        out = joined_readings(*streams, on=["host"], seconds=20, late="30 seconds", how=how)
        drained(spark, out, f"{place}/log", path=f"{place}/out").format("parquet").start().awaitTermination()
    got = sorted(map(str, spark.read.parquet(f"{place}/out").collect()))
    whole = joined_readings(spark.read.parquet(f"{place}/a"), spark.read.parquet(f"{place}/b"), on=["host"], seconds=20, how=how)
    want = sorted(map(str, whole.collect()))
    if how == "leftOuter":  # rows near the end may still find a partner
        late = [r for r in want if r not in got]
        assert set(got) <= set(want) and all("right_ts=None" in r and "1970, 1, 1, 0, 5" in r for r in late)
    else:
        assert got == want
    near = [(x, y) for x in left for y in right if x[0] == y[0] and abs(x[1] - y[1]) <= 20]
    assert len(want) == {"inner": len(near), "leftSemi": len({x for x, _ in near}), "leftOuter": len(near) + len(left) - len({x for x, _ in near})}[how]


PIECES = "key long, seq long, piece string, last boolean, ts timestamp"


def answers(spark, place, steps, **how):
    """Rows given after each step of pieces."""
    shown = []
    for rows in steps:
        spark.createDataFrame([(k, s, p, last, 1000.0 + t) for k, s, p, last, t in rows], "key long, seq long, piece string, last boolean, t double").select("key", "seq", "piece", "last", F.timestamp_seconds("t").alias("ts")).coalesce(1).write.mode("append").parquet(f"{place}/in")
        out = answer_stream(spark.readStream.schema(PIECES).parquet(f"{place}/in"), **how)
        drained(spark, out, f"{place}/log", path=f"{place}/out").format("parquet").start().awaitTermination()
        shown.append({tuple(r) for r in spark.read.parquet(f"{place}/out").collect()})
    return shown


def test_pieces_then_a_final_record(spark, tmp_path):
    first, second, third, last = answers(
        spark,
        str(tmp_path),
        [
            [(1, 0, "He", False, 0), (2, 0, "whole", True, 0), (3, 1, "late ", False, 1), (1, 1, "llo", False, 2), (4, 0, "st", False, 3), (4, 2, "lost", False, 3)],
            [(1, 2, " you", True, 5), (3, 0, "not ", False, 6), (1, 3, "after", False, 6), (1, 1, "again", False, 6), (3, 2, None, True, 7)],
            [(9, 0, "x", False, 100)],
            [(4, 1, "too late", False, 100), (9, 1, "y", True, 101)],
        ],
        idle_ms=20_000,
        ts="ts",
    )
    assert first == {(1, 0, "piece", "He", 1), (1, 1, "piece", "llo", 1), (2, 0, "piece", "whole", 1), (2, 1, "final", "whole", 1), (4, 0, "piece", "st", 1)}
    assert second - first == {(1, 2, "piece", " you", 1), (1, 3, "final", "Hello you", 3), (3, 0, "piece", "not ", 1), (3, 1, "piece", "late ", 1), (3, 2, "piece", "", 1), (3, 3, "final", "not late ", 3)}
    assert third - second == {(9, 0, "piece", "x", 1), (4, 1, "stalled", "st", 1)}
    assert last - third == {(9, 1, "piece", "y", 1), (9, 2, "final", "xy", 2)}


def test_the_clock_closes_a_stalled_answer(spark, tmp_path):
    """On a running stream: with timers of the clock it looks for expired ones without end."""
    import time

    place, shown = str(tmp_path), lambda: {tuple(r) for r in spark.read.schema("key long, seq long, kind string, text string, pieces long").parquet(f"{place}/out").collect()}
    add = lambda rows: spark.createDataFrame([(*r, None) for r in rows], PIECES).coalesce(1).write.mode("append").parquet(f"{place}/in")
    add([(1, 0, "a", False), (2, 0, "b", True)])
    out = answer_stream(spark.readStream.schema(PIECES).parquet(f"{place}/in"), idle_ms=1000, ttl_ms=600_000)
    run = out.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/log").trigger(processingTime="1 second").start()

    def until(want):
        for _ in range(60):
            if shown() == want:
                return
            time.sleep(0.5)
        assert shown() == want

    try:
        first = {(1, 0, "piece", "a", 1), (2, 0, "piece", "b", 1), (2, 1, "final", "b", 1), (1, 1, "stalled", "a", 1)}
        time.sleep(3)
        until(first)
        add([(3, 0, "c", True), (2, 1, "after", False), (1, 1, "late", True)])
        until(first | {(3, 0, "piece", "c", 1), (3, 1, "final", "c", 1)})
    finally:
        run.stop()
