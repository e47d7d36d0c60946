"""A data source of pages behind a cursor, and a table of runs."""

from __future__ import annotations

import math
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Query(InputPartition):
    pass


def paged_source(name: str, fetch: Callable[..., tuple[list[tuple], str | None]], schema: str) -> type[DataSource]:
    """A data source whose rows come from fetch(cursor, **options) -> (rows, next cursor), from no cursor on.

    It ends with a page without rows or without a next cursor. Options named ``query`` hold values, by comma, that are
    read as partitions of their own, in parallel.
    """
    class Reader(DataSourceReader):
        def __init__(self, options: dict[str, str]):
            self.options = {k: v for k, v in options.items() if k != "query"}
            self.queries = options.get("query", "").split(",") if options.get("query") else [None]

        def partitions(self) -> list[InputPartition]:
            return [Query(q) for q in self.queries]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            options = self.options | ({} if partition.value is None else {"query": partition.value})
            cursor = None
            while True:
                rows, cursor = fetch(cursor, **options)
                yield from rows
                if not rows or cursor is None:
                    return

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:  # noqa: ARG002
            return Reader(dict(self.options))

    return Paged


def parquet_parts(path: str, parts: int, least: int = 20_000) -> list[str]:
    """First cursors of parquet_pages for all rows of a Parquet table, in at most that many parts of about equal numbers of rows.

    A part has `least` rows or more, but for the last. Only the files' footers are read.
    """
    import pyarrow.dataset as ds

    groups = []
    for at, f in enumerate(ds.dataset(path, format="parquet").get_fragments()):
        groups += [(at, g.id, g.num_rows) for g in f.row_groups if g.num_rows]
    rows = sum(n for _, _, n in groups)
    size, out, before = max(least, math.ceil(rows / parts)), [], 0
    for file, group, n in groups:
        # a part begins at each multiple of size
        out += [f"{file}:{group}:{begin - before}:{min(size, rows - begin)}" for begin in range(math.ceil(before / size) * size, before + n, size)]
        before += n
    return out


def parquet_pages(path: str, columns: list[str], size: int = 20_000) -> Callable[..., tuple[list[tuple], str | None]]:
    """A fetch for paged_source over a Parquet table: pages of up to size rows, in order of the files.

    A cursor names a file, a row group, the rows to skip in it and the rows that are left; the query is the first one. The
    reader that gave a page is kept for the next, so that a part's rows are decoded once and no row group is held; at any other
    cursor a reader of its own begins, which decodes the rows to skip.
    """
    held: dict[str, Iterator[tuple[list[tuple], str | None]]] = {}

    def pages(file: int, group: int, skip: int, left: int) -> Iterator[tuple[list[tuple], str | None]]:
        import pyarrow.dataset as ds
        import pyarrow.parquet as pq

        for at, f in list(enumerate(ds.dataset(path, format="parquet").get_fragments()))[file:]:
            with f.open() as source:
                table = pq.ParquetFile(source, buffer_size=1 << 20)
                for g in range(group, table.num_row_groups):
                    seen = 0
                    for batch in table.iter_batches(size, row_groups=[g], columns=columns, use_threads=False):
                        page = batch.slice(min(max(skip - seen, 0), batch.num_rows), left)
                        seen += batch.num_rows
                        left -= page.num_rows
                        if page.num_rows:
                            yield list(zip(*(page.column(c).to_pylist() for c in columns), strict=True)), f"{at}:{g}:{seen}:{left}" if left else None
                        if not left:
                            return
                    skip = 0
            group = 0
        raise EOFError(f"{left} rows less than when {path} was divided")

    def fetch(cursor: str | None, query: str = "") -> tuple[list[tuple], str | None]:
        at = cursor or query
        if not at:  # a table without rows
            return [], None
        reader = held.pop(at, None) or pages(*map(int, at.split(":")))
        rows, after = next(reader)
        held.clear()
        if after:
            held[after] = reader
        return rows, after

    return fetch


RUNS = "run_id string, stage string, status string, params map<string,string>, metrics map<string,double>, began double, ended double, error string"


@contextmanager
def stage_run(spark: SparkSession, path: str, stage: str, params: dict | None = None) -> Iterator[dict[str, float]]:
    """A stage's run as a row of the runs table at path: parameters, the metrics put into what it gives, and how it ended.

    FINISHED, FAILED with the error, or KILLED on an interrupt; the row is written in every case and errors go on.
    """
    metrics: dict[str, float] = {}
    began, status, error = time.time(), "FINISHED", None
    try:
        yield metrics
    except (KeyboardInterrupt, SystemExit) as e:
        status, error = "KILLED", repr(e)
        raise
    except Exception as e:
        status, error = "FAILED", repr(e)
        raise
    finally:
        row = (uuid.uuid4().hex, stage, status, {k: str(v) for k, v in (params or {}).items()}, {k: float(v) for k, v in metrics.items()}, began, time.time(), error)
        spark.createDataFrame([row], RUNS).coalesce(1).write.mode("append").parquet(path)
