"""Header-checked record files, plain JSON lines, YAML errata, TSV, metrics JSON, tables with manifests."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.schemas import fingerprint


class SchemaMismatch(ValueError):
    """A file's header names another model or schema."""


def header(name: str, fields: StructType) -> dict[str, str]:
    return {"model": name, "schema": f"{name}@{fingerprint(fields)}"}


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else a temporary one (local runs and tests only)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):  # local-cluster has executors of its own
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="corpusloom-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df under the scratch folder and reads it back: what is read several times is worked out once, and lineage is cut."""
    place = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def write_records(df: DataFrame, path: str, name: str, *, key: list[str] | None = None, single_file: bool = False) -> None:
    """JSON lines under a header line: a folder with the header and the rows, in as many parts as there are partitions, sorted by key.

    With ``single_file`` all is one file whose first line is the header, for small sets that others read: equal rows
    give equal bytes.
    """
    rows = df.orderBy(*key) if key else df
    body = rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    top = df.sparkSession.createDataFrame([(json.dumps(header(name, df.schema), ensure_ascii=False),)], "value string")
    if single_file:
        numbered = top.withColumn("o", F.lit(0).cast("long")).unionByName(body.withColumn("o", F.monotonically_increasing_id() + 1))
        numbered.coalesce(1).sortWithinPartitions("o").select("value").write.mode("overwrite").text(path)
        return
    body.write.mode("overwrite").text(f"{path}/rows")
    top.coalesce(1).write.mode("overwrite").text(f"{path}/header")


def read_records(spark: SparkSession, path: str, name: str, fields: StructType) -> DataFrame:
    """Checks the header, the first line, before any record is parsed; malformed records raise."""
    folder = exists(spark, f"{path}/header")
    lines = spark.read.text(f"{path}/rows" if folder else path)
    first = (spark.read.text(f"{path}/header") if folder else lines).head()
    try:
        found = json.loads(first["value"]) if first else None
    except ValueError:
        found = first["value"]
    if found != header(name, fields):
        raise SchemaMismatch(f"{path}: expected {header(name, fields)}, found {found}")
    if not folder:
        # the header is the file's first line; a record may read like it
        row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        lines = lines.withColumns({"row": row, "block": F.col("_metadata.file_block_start")}).where((F.col("row") != 0) | (F.col("block") != 0) | (F.col("value") != first["value"])).select("value")
    body = lines.where(F.trim("value") != "")
    return body.select(F.from_json("value", fields, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_jsonl(spark: SparkSession, path: str, fields: StructType) -> DataFrame:
    """Blank lines are skipped."""
    return spark.read.schema(fields).option("mode", "FAILFAST").json(path)


def read_json_document(spark: SparkSession, path: str, fields: StructType) -> DataFrame:
    return spark.read.schema(fields).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_errata(spark: SparkSession, text: str) -> DataFrame:
    """A YAML list to rows in file order; an empty file has none."""
    import yaml

    listed = yaml.safe_load(text) or []
    rows = [(i, e["page"], e["row"], e["side"], e["expect"], e["replace"]) for i, e in enumerate(listed)]
    return spark.createDataFrame(rows, "n int, page int, row int, side string, expect string, replace string")


def write_tsv(df: DataFrame, path: str, *, key: list[str], single_file: bool = False) -> None:
    """Sorted parts, each under the header; with ``single_file`` one, for small sets that people read."""
    rows = df.orderBy(*key)
    (rows.coalesce(1) if single_file else rows).write.mode("overwrite").csv(path, sep="\t", header=True)


def metrics_json(metrics: dict) -> str:
    return json.dumps(metrics, indent=2, sort_keys=True, ensure_ascii=False) + "\n"


def write_evidence(tables: dict[str, tuple[DataFrame, list[str]]], summary: dict, path: str) -> None:
    """Each table as sorted TSV under its name, and the summary as JSON: equal inputs give equal bytes."""
    for name, (df, key) in tables.items():
        write_tsv(df, f"{path}/{name}", key=key, single_file=True)
        spark = df.sparkSession
    text = spark.createDataFrame([(metrics_json(summary).rstrip("\n"),)], "value string")
    text.coalesce(1).write.mode("overwrite").text(f"{path}/summary")


def flatten(metrics: dict, prefix: str = "") -> dict[str, float]:
    """Dotted keys of the numeric leaves."""
    out: dict[str, float] = {}
    for k, v in metrics.items():
        if isinstance(v, dict):
            out |= flatten(v, f"{prefix}{k}.")
        elif isinstance(v, (int, float)) and not isinstance(v, bool):
            out[f"{prefix}{k}"] = float(v)
    return out


def write_indexed(df: DataFrame, path: str, manifest: dict) -> None:
    """A table and its manifest, both replaced."""
    df.write.mode("overwrite").parquet(f"{path}/rows")
    df.sparkSession.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "manifest string").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


def open_indexed(spark: SparkSession, path: str, expected: dict) -> DataFrame:
    """The table, if its manifest agrees in every expected key; lists all differences otherwise."""
    found = json.loads(spark.read.parquet(f"{path}/manifest").head()["manifest"])
    wrong = {k: (v, found.get(k)) for k, v in expected.items() if found.get(k) != v}
    if wrong:
        raise SchemaMismatch(f"{path}: " + ", ".join(f"{k}: expected {a!r}, found {b!r}" for k, (a, b) in sorted(wrong.items())))
    return spark.read.parquet(f"{path}/rows")
