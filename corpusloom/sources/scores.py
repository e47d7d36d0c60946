"""A stream sink of scores: rows of a batch appear all together and once, however often the batch is written.

Tasks write Parquet files under names of their own. A batch's commit puts one small manifest in place that lists the files of
its successful tasks, with their number of scores and sum; only listed files are read. A batch that runs again after a loss
finds its manifest and drops what it wrote anew; files of tasks that failed or of a run that was killed are in no manifest.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

MANIFEST = "batch long, rows long, total double, files array<string>"


@dataclass
class Staged(WriterCommitMessage):
    """What one task wrote: nothing, or a file."""

    file: str | None
    rows: int
    total: float


class ScoreWriter(DataSourceStreamArrowWriter):
    def __init__(self, path: str, score: str):
        self.path, self.score = path.rstrip("/"), score

    def _place(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        system, root = self._place()
        name, rows, total, out = f"{uuid.uuid4().hex}.parquet", 0, 0.0, None
        for b in iterator:
            if not b.num_rows:
                continue
            if out is None:
                system.create_dir(f"{root}/rows", recursive=True)
                out = pq.ParquetWriter(f"{root}/rows/{name}", b.schema, filesystem=system)
            out.write_batch(b)
            scores = b.column(self.score)
            rows += len(scores) - scores.null_count
            total += pc.sum(scores).as_py() or 0.0
        if out is None:
            return Staged(None, 0, 0.0)
        out.close()
        return Staged(name, rows, total)

    def _drop(self, messages: list[Staged | None]) -> None:
        from pyarrow import fs

        system, root = self._place()
        for m in messages:
            if m is not None and m.file and system.get_file_info(f"{root}/rows/{m.file}").type != fs.FileType.NotFound:
                system.delete_file(f"{root}/rows/{m.file}")

    def commit(self, messages: list[Staged | None], batchId: int) -> None:  # noqa: N803
        from pyarrow import fs

        system, root = self._place()
        manifest = f"{root}/batches/{batchId:012d}.json"
        if system.get_file_info(manifest).type != fs.FileType.NotFound:
            self._drop(messages)  # a batch that was committed and ran again
            return
        files = sorted(m.file for m in messages if m is not None and m.file)
        entry = {"batch": batchId, "rows": sum(m.rows for m in messages if m), "total": sum(m.total for m in messages if m), "files": files}
        system.create_dir(f"{root}/batches", recursive=True)
        staged = f"{root}/.staged-{uuid.uuid4().hex}"
        with system.open_output_stream(staged) as out:
            out.write(json.dumps(entry).encode())
        system.move(staged, manifest)

    def abort(self, messages: list[Staged | None], batchId: int) -> None:  # noqa: ARG002, N803
        self._drop(messages)


class Scores(DataSource):
    """``format("scores")`` with options path, a folder that all executors share, and score, the column of the gauges."""

    @classmethod
    def name(cls) -> str:
        return "scores"

    def streamWriter(self, schema: StructType, overwrite: bool) -> ScoreWriter:  # noqa: ARG002
        return ScoreWriter(self.options["path"], self.options.get("score", "score"))


def read_scores(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The rows of all committed batches; empty before the first."""
    if not _exists(spark, f"{path}/batches") or not _exists(spark, f"{path}/rows"):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(f"{path}/rows")
    listed = spark.read.schema(MANIFEST).json(f"{path}/batches").select(F.explode("files").alias("file"))
    return rows.withColumn("file", F.col("_metadata.file_name")).join(listed, "file", "left_semi").drop("file")


def gauges(spark: SparkSession, path: str) -> DataFrame:
    """(batch, n, mean): of each committed batch the number of scores and their mean, null without any."""
    if not _exists(spark, f"{path}/batches"):
        return spark.createDataFrame([], "batch long, n long, mean double")
    rows = spark.read.schema(MANIFEST).json(f"{path}/batches")
    return rows.select("batch", F.col("rows").alias("n"), F.try_divide("total", "rows").alias("mean"))


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
