"""Versions of a result and the aliases that name them, as tables under one folder.

A version is a Parquet table and one commit file, numbered from 1 without gaps. The commit file is put in place only if
no other writer has taken its number: whole or not at all, so of writers that race one gets the number and the
others see that. An alias is one small file, moved by an atomic rename: a reader finds the old version or the new
one, never neither. Rows are written by executors; only commit files, a line each, pass through the driver.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSIONS = "version long, data string, schema string, base long, tags map<string,string>, metrics map<string,double>"
ALIASES = "alias string, version long"


class VersionConflict(RuntimeError):
    """Another writer committed first."""


class NotPromoted(ValueError):
    """A candidate that must not take the champion's place."""


@dataclass(frozen=True)
class Version:
    version: int
    data: str
    schema: str
    base: int | None
    tags: dict[str, str]
    metrics: dict[str, float]


class Registry:
    """The versions of one named result under ``path``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs
        self.place = hadoop.Path
        self.fs = hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.context = hadoop.FileContext.getFileContext(self.fs.getUri(), spark._jsc.hadoopConfiguration())
        self.local = self.fs.getScheme() == "file"
        for folder in ("commits", "aliases", "data"):
            self.fs.mkdirs(self.place(f"{self.path}/{folder}"))

    # ---- files ----

    def _write(self, path: str, text: str) -> None:
        out = self.fs.create(self.place(path), True)
        out.write(bytearray(text.encode()))
        out.close()

    def _read(self, path: str) -> str | None:
        if not self.fs.exists(self.place(path)):
            return None
        found = self.fs.open(self.place(path))
        try:
            return bytes(found.readAllBytes()).decode()
        finally:
            found.close()

    def _put(self, path: str, text: str, *, replace: bool) -> bool:
        """Puts a whole file in place, or false if there is one and it may not be replaced."""
        staged = f"{self.path}/.staged-{uuid.uuid4().hex}"
        if self.local:  # Hadoop's own local rename is no single step
            staged, path = (self.place(p).toUri().getPath() for p in (staged, path))
            with open(staged, "w", encoding="utf-8") as out:
                out.write(text)
            if replace:
                os.replace(staged, path)
                return True
            try:
                os.link(staged, path)
                return True
            except FileExistsError:
                return False
            finally:
                os.remove(staged)
        self._write(staged, text)
        option = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(option, 1)
        options[0] = option.OVERWRITE if replace else option.NONE
        try:
            self.context.rename(self.place(staged), self.place(path), options)
            return True
        except Exception:
            self.fs.delete(self.place(staged), False)
            if replace or not self.fs.exists(self.place(path)):
                raise
            return False

    # ---- versions ----

    def _commit_path(self, version: int) -> str:
        return f"{self.path}/commits/{version:012d}.json"

    def latest(self) -> int:
        """The last version's number, 0 without any."""
        names = [s.getPath().getName() for s in self.fs.listStatus(self.place(f"{self.path}/commits"))]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != "."), default=0)

    def commit(self, rows: DataFrame, *, base: int | None = None, tags: dict[str, str] | None = None, metrics: dict[str, float] | None = None, alias: str | None = "candidate") -> int:
        """Writes the rows and takes the next number, which alias then names.

        With ``base`` the rows were made from that version: if it is not the last one when the number is taken, nothing
        is kept and VersionConflict is raised. Without it the next free number is taken, however many writers there are.
        """
        data = f"data/{uuid.uuid4().hex}"
        if base is not None and base != self.latest():
            raise VersionConflict(f"version {base} is not the last one, which is {self.latest()}")
        rows.write.parquet(f"{self.path}/{data}")
        while True:
            version = (self.latest() if base is None else base) + 1
            entry = {"version": version, "data": data, "schema": rows.schema.json(), "base": base, "tags": {k: str(v) for k, v in (tags or {}).items()}, "metrics": {k: float(v) for k, v in (metrics or {}).items()}}
            if self._put(self._commit_path(version), json.dumps(entry, sort_keys=True), replace=False):
                break
            if base is not None:
                self.fs.delete(self.place(f"{self.path}/{data}"), True)
                raise VersionConflict(f"version {version} was taken by another writer")
        if alias:
            self.move(alias, version)
        return version

    def version(self, number: int) -> Version:
        found = self._read(self._commit_path(number))
        if found is None:
            raise KeyError(f"no version {number}")
        return Version(**json.loads(found))

    def open(self, name: int | str) -> DataFrame:
        """The rows of a version, by its number or an alias."""
        number = self.named(name) if isinstance(name, str) else name
        if number is None:
            raise KeyError(f"no version is named {name}")
        found = self.version(number)
        return self.spark.read.schema(self._schema(found.schema)).parquet(f"{self.path}/{found.data}")

    @staticmethod
    def _schema(text: str):
        from pyspark.sql.types import StructType

        return StructType.fromJson(json.loads(text))

    def versions(self) -> DataFrame:
        """A row for each version."""
        return self.spark.read.schema(VERSIONS).json(f"{self.path}/commits")

    # ---- aliases ----

    def named(self, alias: str) -> int | None:
        found = self._read(f"{self.path}/aliases/{alias}.json")
        return None if found is None else json.loads(found)["version"]

    def move(self, alias: str, version: int) -> None:
        """The alias names this version from now on; there must be such a version."""
        self.version(version)
        self._put(f"{self.path}/aliases/{alias}.json", json.dumps({"alias": alias, "version": version}), replace=True)

    def aliases(self) -> DataFrame:
        return self.spark.read.schema(ALIASES).json(f"{self.path}/aliases")

    def promote(self, metric: str, *, candidate: str = "candidate", champion: str = "champion", better: Callable[[float, float], bool] = float.__ge__) -> int:
        """The candidate becomes champion if its metric stands the comparison with the champion's, or there is no champion yet.

        Raises NotPromoted otherwise, and where a metric is missing: what was not measured is not served.
        """
        new, old = self.named(candidate), self.named(champion)
        if new is None:
            raise NotPromoted(f"no version is named {candidate}")
        got = self.version(new).metrics.get(metric)
        if got is None:
            raise NotPromoted(f"version {new} has no {metric}")
        if old is not None and old != new:
            had = self.version(old).metrics.get(metric)
            if had is None or not better(got, had):
                raise NotPromoted(f"{metric} of version {new} is {got}, of {old}, the {champion}, {had}")
        self.move(champion, new)
        return new

    def expire(self, keep: int = 1) -> list[int]:
        """Drops the rows of versions before the last ``keep`` ones that no alias names; their commits stay. Returns their numbers."""
        named = {r["version"] for r in self.aliases().collect()}  # a row an alias
        old = self.versions().where(F.col("version") <= self.latest() - keep).collect()  # a row a version
        gone = [r for r in old if r["version"] not in named and self.fs.exists(self.place(f"{self.path}/{r['data']}"))]
        for r in gone:
            self.fs.delete(self.place(f"{self.path}/{r['data']}"), True)
        return sorted(r["version"] for r in gone)
