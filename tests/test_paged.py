"""Paged events: every type counts, and every row is in one part, whatever the files look like."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from corpusloom.plans import catalogue
from corpusloom.sources import paged

EVENTS = "event_id long, event_type string, value double"
ODD = [(1, None, 1.5), (2, "a,b", 2.25), (3, "a", 4.0), (4, "b", None), (5, "", 8.0), (6, None, None), (7, "a,b", 0.5)]


@pytest.mark.parametrize("rows", [[(i, f"type {i % 1205}", i / 4) for i in range(2500)], ODD, []], ids=["more than 1,000 types", "odd types", "none"])
def test_events_of_all_types(spark, tmp_path, rows):
    """Types beyond the first thousand were left out; a null type failed, one with a comma was read as two."""
    path = f"{tmp_path}/events.parquet"
    spark.createDataFrame(rows, EVENTS).repartition(3).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{path}/*.parquet')")
    want = con.execute(catalogue.ORACLES["paged_events"])
    got = catalogue.QUERIES["paged_events"](spark, str(tmp_path)).select(*[c[0] for c in want.description])
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))


def test_parts_and_cursors_of_a_table(tmp_path):
    at = 0
    for i, (n, group) in enumerate([(10, 4), (0, 1), (1, 1), (25, 25), (6, 2)]):
        pq.write_table(pa.table({"n": pa.array(range(at, at + n), pa.int64()), "t": pa.array([f"r{k}" for k in range(at, at + n)], pa.string())}), f"{tmp_path}/{i}.parquet", row_group_size=group)
        at += n
    for parts, least, size in [(1, 1, 3), (4, 1, 100), (4, 1, 2), (100, 1, 5), (100, 5, 4), (3, 40, 7)]:
        cursors = paged.parquet_parts(str(tmp_path), parts, least)
        fetch, got, again = paged.parquet_pages(str(tmp_path), ["t", "n"], size), [], []
        assert 1 <= len(cursors) <= parts
        for query in cursors:
            cursor = None
            while True:
                # a fetch of its own has no reader to go on with
                again += paged.parquet_pages(str(tmp_path), ["t", "n"], size)(cursor, query)[0]
                rows, cursor = fetch(cursor, query)
                assert 0 < len(rows) <= size
                got += rows
                if cursor is None:
                    break
        assert got == again == [(f"r{k}", k) for k in range(at)]
    fetch = paged.parquet_pages(str(tmp_path), ["n"])
    rows, cursor = fetch(None, "4:2:0:3")
    assert rows == [(40,), (41,)]
    with pytest.raises(EOFError):
        fetch(cursor, "4:2:0:3")
