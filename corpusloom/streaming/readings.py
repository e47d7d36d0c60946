"""Readings of two samplers joined by time, as a stream and as tables alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def joined_readings(left: DataFrame, right: DataFrame, *, on: list[str], ts: str = "ts", right_ts: str | None = None, seconds: int, late: str = "10 minutes", how: str = "inner") -> DataFrame:
    """Each left row with the right rows of its keys that were read within ``seconds`` before or after it.

    Columns: those of the left, then the right's but the keys, its time as ``right_<ts>``. On streams both sides carry a watermark,
    so a side's row is held only until no partner can come: the interval and ``late`` bound the state. ``how``: inner,
    leftOuter (a stream gives a row without partner once none can come), or leftSemi.
    """
    other = right_ts or ts
    left, right = (x.withWatermark(c, late) if x.isStreaming else x for x, c in ((left, ts), (right, other)))
    renamed = right.select(*[F.col(c).alias(f"__{c}") for c in right.columns])
    near = F.expr(f"`__{other}` BETWEEN `{ts}` - INTERVAL {int(seconds)} SECONDS AND `{ts}` + INTERVAL {int(seconds)} SECONDS")
    for k in on:
        near = near & (F.col(k) == F.col(f"__{k}"))
    kept = [] if how == "leftSemi" else [F.col(f"__{c}").alias(f"right_{c}" if c == other or c in left.columns else c) for c in right.columns if c not in on]
    return left.join(renamed, near, how).select(*left.columns, *kept)
