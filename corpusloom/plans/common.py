"""Shared by the query catalogue."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deals a table of fewer partitions than half the cores over all cores; larger tables stay as they are scanned."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def file_states(spark: SparkSession, df: DataFrame) -> list[tuple[str, int, int]]:
    """Name, length and time of the files that a table is read from: one listing for each folder, not a call for each file."""
    names, folders = set(df.inputFiles()), {}
    place = spark._jvm.org.apache.hadoop.fs.Path
    for name in names:
        folders.setdefault(name.rsplit("/", 1)[0], set()).add(place(name).toUri().getPath())
    out = []
    for folder, held in folders.items():
        path = place(folder)
        for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path):
            found = s.getPath().toUri().getPath()
            if found in held:
                out.append((found, s.getLen(), s.getModificationTime()))
    return sorted(out)


def quoted(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, list):
        return "[" + ", ".join(map(quoted, value)) + "]"
    return "'" + str(value).replace("'", "''") + "'"


def values_sql(rows: list[tuple], columns: str) -> str:
    """A FROM item of literal rows."""
    return "(VALUES " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows) + f") AS t({columns})"


def long(c: str) -> F.Column:
    return F.col(c).cast("long").alias(c)
