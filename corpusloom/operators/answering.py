"""Calls of a service that fails at times: every question is answered once, or the run fails and goes on where it was."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

MEMO = "key string, answer string"


class CallFailed(RuntimeError):
    """A call failed after all waits."""


def called(call: Callable[[str], str], question: str, waits: Sequence[float]) -> str:
    """The call's answer; after a failure it is tried again after each of the waits, then CallFailed is raised."""
    for i, wait in enumerate([*waits, None]):
        try:
            return call(question)
        except Exception as e:
            if wait is None:
                raise CallFailed(f"{i + 1} calls failed, the last with {e!r}") from e
            time.sleep(wait)
    raise AssertionError


def answer_all(questions: DataFrame, call: Callable[[str], str], memo: str, *, key: str, question: str, waits: Sequence[float] = (10.0, 30.0), buckets: int = 64, chunk: int = 32) -> DataFrame:
    """(key, answer) of every question with a key: a question is never dropped, and never asked again once its answer is stored.

    ``memo`` is a folder that all executors share. Keys are dealt over buckets; a task takes whole buckets, reads which of a
    bucket's keys are answered, asks the others and stores each ``chunk`` of answers as one whole file. A task that is run
    again, or a run after one that failed, asks only what is left (what a lost worker had asked of its last chunk is asked
    twice). When the waits are used up the run fails. Keys are text and told apart as such; a key's first question by text counts.
    """
    spark = questions.sparkSession
    rows = questions.select(F.col(key).cast("string").alias("key"), F.coalesce(F.col(question), F.lit("")).alias("question")).where("key IS NOT NULL")
    rows = rows.groupBy("key").agg(F.min("question").alias("question")).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(memo)
        now, known, held = None, set(), []
        schema = pa.schema([("key", pa.string()), ("answer", pa.string())])

        def store() -> None:
            if held:
                folder, name = f"{root}/bucket={now}", f"{uuid.uuid4().hex}.parquet"
                system.create_dir(folder, recursive=True)
                pq.write_table(pa.Table.from_pylist(held, schema), f"{folder}/.{name}", filesystem=system)
                system.move(f"{folder}/.{name}", f"{folder}/{name}")
                held.clear()

        try:
            for b in batches:
                for bucket, k, q in zip(*[b.column(c).to_pylist() for c in ("bucket", "key", "question")], strict=True):
                    if bucket != now:
                        store()
                        now, known = bucket, stored_keys(system, f"{root}/bucket={bucket}")
                    if k in known:
                        continue
                    held.append({"key": k, "answer": called(call, q, waits)})
                    if len(held) >= chunk:
                        store()
        finally:
            store()  # what was answered before a failure counts
        yield pa.RecordBatch.from_pydict({"done": pa.array([now], pa.int32())})

    rows.repartition("bucket").sortWithinPartitions("bucket", "key").mapInArrow(ask, "done int").write.format("noop").mode("overwrite").save()
    fields = StructType([StructField("key", StringType()), StructField("answer", StringType())])
    # a chunk that was asked twice has two answers: the same one counts on each read
    answered = spark.read.schema(fields).option("recursiveFileLookup", True).parquet(memo) if rows.head(1) else spark.createDataFrame([], fields)
    return answered.groupBy("key").agg(F.min("answer").alias("answer")).join(rows.select("key"), "key", "left_semi")


def stored_keys(system, folder: str) -> set[str]:
    """The keys of one bucket that have answers."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    if system.get_file_info(folder).type == fs.FileType.NotFound:
        return set()
    out: set[str] = set()
    for f in system.get_file_info(fs.FileSelector(folder)):
        if f.base_name.endswith(".parquet") and not f.base_name.startswith("."):
            out.update(pq.read_table(f.path, columns=["key"], filesystem=system, partitioning=None).column("key").to_pylist())
    return out
