"""What the operators share: word splitting, hold-out folds, tables in the shared folder, bounded training samples."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# A word is a run of code points outside space and \t..\r: what bytes.split() gives on UTF-8.
WORD_REGEX = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else a temporary one (local runs and tests only)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        sc = spark.sparkContext
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="corpusloom-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def added(df: DataFrame, kept: list[str], ddl: str) -> StructType:
    """The schema of some columns of df, then those of the DDL."""
    return StructType([*df.select(*kept).schema.fields, *StructType.fromDDL(ddl).fields])


def table(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage and survives the loss of any executor."""
    return Tables(df.sparkSession).write(df, label)


class Tables:
    """Tables written to the shared folder, to be dropped once nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.held: list[tuple[DataFrame, str]] = []

    def write(self, df: DataFrame, label: str, *, per_file: int = 0) -> DataFrame:
        """per_file: rows of a file at most, for large rows, of which readers hold many at once; 0: any number."""
        path = f"{shared_dir(self.spark)}/corpusloom/{label}-{uuid.uuid4().hex}"
        df.write.option("maxRecordsPerFile", per_file).parquet(path)
        found = self.spark.read.schema(df.schema).parquet(path)
        self.held.append((found, path))
        return found

    def drop(self, *but: DataFrame) -> None:
        """Deletes all tables but these."""
        for df, name in self.held:
            if not any(df is x for x in but):
                path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.held = [(df, name) for df, name in self.held if any(df is x for x in but)]


def slices(batches: Iterator, rows: int = 512) -> Iterator:
    """Batches cut into short ones: what Python makes of their texts is held for one at a time."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def with_text(df: DataFrame, kept: list[str], text: str) -> DataFrame:
    """The kept columns, and the text if it is not one of them."""
    return df.select(*kept) if text in kept else df.select(*kept, text)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


@dataclass(frozen=True)
class Sample:
    """Labelled texts for training; share: of each label among all labelled rows."""

    texts: list[bytes]
    labels: list
    share: dict

    def weights(self) -> list[float]:
        """Weights that give the labels their shares again; they average 1."""
        n = Counter(self.labels)
        return [self.share[y] * len(self.labels) / n[y] for y in self.labels]


#: Of texts for training: no longer than the first, and no more of them together than the second, in bytes.
LONGEST_TEXT, ALL_TEXTS = 200_000, 64_000_000


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, *, per_label: int, max_rows: int | None = None, longest: int = LONGEST_TEXT, all_texts: int = ALL_TEXTS, key: str = "doc_id", text: str = "text", seed: int = 0
) -> Sample:
    """At most per_label texts of each label: the first ids by a seeded hash.

    Of labels so many that this is over ``max_rows``, each has an equal part of max_rows. Texts of over ``longest`` bytes
    are not learned from, nor those of a label after its part of ``all_texts`` bytes, so what reaches the driver is
    bounded in rows and bytes. Counts of labels are over all rows; the sample is the same on each run. Rows without id or
    label and ids with two different labels are left out; of rows that repeat an id the smallest text counts.
    """
    part = (F.shiftrightunsigned(F.xxhash64("key", F.lit(seed)), 11) * 2.0**-53).alias("part")
    clean = (
        labels.select(F.col(key).alias("key"), F.col(label).alias("label"))
        .where("key IS NOT NULL AND label IS NOT NULL")
        .groupBy("key")
        .agg(F.min("label").alias("label"), F.max("label").alias("high"))
        .where("label = high")
        .select("key", "label", part)
    )
    counts = {r["label"]: r["n"] for r in clean.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").collect()}  # one row a label
    if not counts:
        return Sample([], [], {})
    if max_rows is not None:
        per_label = min(per_label, max(1, max_rows // len(counts)))
    # A hash bound by label leaves a few more rows than are wanted, few enough to be ranked together. The bounds are literals:
    # rows beyond them go where they are read, before anything is dealt by label.
    kind = clean.schema["label"].dataType
    bounds = F.create_map(*[x for v, n in counts.items() for x in (F.lit(v).cast(kind), F.lit(min(1.0, 1.2 * (per_label + 100) / n)))])
    near = clean.where(F.col("part") <= F.element_at(bounds, F.col("label")))
    first = Window.partitionBy("label").orderBy("part", "key")
    chosen = near.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= per_label).select("key", "label", "part")
    rows = (
        docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
        .join(F.broadcast(chosen), "key")  # at most per_label rows a label
        .where(F.col("text").isNotNull() & (F.length("text") <= longest))
        .groupBy("key", "label", "part")
        .agg(F.min("text").alias("text"))
        .withColumn("bytes", F.sum(F.length("text")).over(first.rowsBetween(Window.unboundedPreceding, 0)))
        .where(F.col("bytes") <= max(longest, all_texts // len(counts)))
        .select("key", "label", "text")
        .toPandas()
        .sort_values("key", kind="stable")
    )
    total = sum(counts.values())
    return Sample([bytes(t) for t in rows["text"]], rows["label"].tolist(), {v: n / total for v, n in counts.items()})
