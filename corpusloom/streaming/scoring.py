"""Periodic evaluation as a stream: of each period a bounded sample, scored once the period is over."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, StructField, StructType


def plain(p: pd.DataFrame) -> pd.DataFrame:
    """Strings as Python objects, which every pandas hands on alike."""
    return p.astype({c: "object" for c in p.columns if isinstance(p[c].dtype, pd.StringDtype)})


class PeriodSample(StatefulProcessor):
    """Keeps the ``n`` rows of a period that come first by (tie, id) and gives them when its end is past the watermark.

    State of a period is n rows at most; rows of a period that is over are too late and dropped.
    """

    def __init__(self, n: int, seconds: int, columns: list[str]):
        self.n, self.seconds, self.columns = n, seconds, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", "tie string, id string, row string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        end = (int(key[0]) + self.seconds) * 1000
        if end > timerValues.getCurrentWatermarkInMs():
            first = not self.kept.exists()
            kept = [] if first else list(self.kept.get())
            for part in rows:
                kept = sorted({*kept, *zip(part["tie"], part["id"], part["row"], strict=True)})[: self.n]
            self.kept.put(kept)
            if first:
                self.handle.registerTimer(end)
        yield from ()  # rows come with the timer

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ARG002
        kept = list(self.kept.get()) if self.kept.exists() else []
        self.kept.clear()
        if kept:
            yield self._frame(key, kept)

    @staticmethod
    def _frame(key, kept: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({"period": pd.Series([int(key[0])] * len(kept), dtype="int64"), "row": pd.Series([k[2] for k in kept], dtype="object")})

    def close(self) -> None:
        pass


def sampled_periods(rows: DataFrame, *, ts: str, id: str, seconds: int, n: int, late: str, seed: str = "0") -> DataFrame:
    """period (its start, in seconds) and the columns of the n rows of each whole period that come first by a seeded hash of id.

    A period is given once the watermark, ``late`` behind the latest row, is past its end. Tasks pass on only what may be among the
    first of their own rows, so a period's rows need not all meet. Null times and ids take no part.
    """
    fields = rows.schema
    period = (F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (1_000_000 * seconds)) * seconds).cast("long")
    tie = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id).cast("string")).cast("binary"))
    packed = rows.where(F.col(ts).isNotNull() & F.col(id).isNotNull()).select(
        period.alias("period"), F.col(ts).cast("timestamp").alias("at"), tie.alias("tie"), F.col(id).cast("string").alias("id"), F.to_json(F.struct("*")).alias("row")
    )

    def prune(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            ordered = p.sort_values(["tie", "id"])
            # the latest row moves the watermark
            yield plain(p.loc[sorted({*ordered.groupby("period").head(n).index, *([p["at"].idxmax()] if len(p) else [])})])

    first = packed.mapInPandas(prune, packed.schema).withWatermark("at", late)
    kept = first.groupBy("period").transformWithStateInPandas(PeriodSample(n, seconds, fields.names), "period long, row string", "append", "eventTime")
    return kept.select("period", F.from_json("row", fields).alias("r")).select("period", "r.*")


def scored(rows: DataFrame, scorer: Callable[[pd.DataFrame], pd.Series], name: str = "score") -> DataFrame:
    """Adds the scorer's value for each row, a batch at a time; works on streams too. A row it cannot score has null."""
    out = StructType([*rows.schema.fields, StructField(name, DoubleType())])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                yield plain(p.assign(**{name: scorer(p).astype("float64")}))

    return rows.mapInPandas(run, out)
