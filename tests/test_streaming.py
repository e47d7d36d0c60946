"""Streams over finite tables against their batch forms."""

import datetime as dt


from corpusloom.functions.pii import Pieces
from corpusloom.plans.monitoring import streamed
from corpusloom.streaming import processors as P


def test_redaction_across_pieces(spark):
    texts = {1: "mail me at a.b@c.org or call +20 10 1234 5678 today please and thank you very much indeed my friend", 2: "السيد محمد علي حسن حضر", 3: "", 4: "word " * 40 + "x@y.zz"}
    rows = []
    for key, text in texts.items():
        parts = [text[i : i + 5] for i in range(0, len(text), 5)] or [""]
        rows += [(key, i, p, i == len(parts) - 1) for i, p in enumerate(parts)]
    out = streamed(spark.createDataFrame(rows, "key long, seq long, piece string, last boolean"), P.redact_stream).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r["key"], r["seq"])):
        got[r["key"]] = got.get(r["key"], "") + r["shown"]
    assert got == {k: Pieces().take(t, last=True) for k, t in texts.items()}


def test_counters_and_rates(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(minutes=i), "view" if i % 3 else "click") for i in range(60)]
    events = spark.createDataFrame(rows, "ts timestamp, event_type string")
    counts = {r["event_type"]: r["n"] for r in streamed(events, lambda e: P.counter_stream(e, ["event_type"]), "complete").collect()}
    assert counts == {"view": 40, "click": 20}
    rates = streamed(events, P.rate_stream).where("event_type = 'view'").orderBy("window_start").collect()
    assert rates and max(r["rate"] for r in rates) <= 4 / 300


def test_drift_of_short_streams(spark):
    rows = [(1, i, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(25)]
    out = streamed(spark.createDataFrame(rows, "key long, seq long, vec array<double>"), lambda v: P.drift_stream(v, [1.0, 0.0], 0.5, 0.1)).orderBy("seq").collect()
    assert [r["ratio"] for r in out[:2]] == [0.0, 1.0]
    assert abs(out[0]["line"] - (1 - 3 * 0.1 / 0.5)) < 1e-9 and abs(out[24]["line"] - (1 - 0.6 / 20**0.5)) < 1e-9
