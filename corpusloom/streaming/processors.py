"""Structured Streaming forms: redaction of pieces, drift windows, counters and rates.

State is bounded per key: a redactor holds what may still be part of a match, a drift window its last vectors.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpusloom.functions.pii import KINDS, Pieces


class Redactor(StatefulProcessor):
    """Pieces (key, seq, piece, last) in arrival order to (key, seq, shown): shown joined over a key equals batch redaction."""

    def __init__(self, kinds: Sequence[str] = KINDS):
        self.kinds = tuple(kinds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("pieces", "before string, held string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pieces = Pieces(*(self.state.get() if self.state.exists() else ()), kinds=self.kinds)
        batch = pd.concat(list(rows)).sort_values("seq")
        shown = []
        for piece, last in zip(batch["piece"], batch["last"], strict=True):
            shown.append(pieces.take(piece or "", bool(last)))
            if last:
                pieces = Pieces(kinds=self.kinds)
        if pieces.before or pieces.held:
            self.state.update((pieces.before, pieces.held))
        else:
            self.state.clear()
        yield pd.DataFrame({"key": key[0], "seq": batch["seq"].to_numpy(), "shown": shown})

    def close(self) -> None:
        pass


def redact_stream(pieces: DataFrame, kinds: Sequence[str] = KINDS) -> DataFrame:
    return pieces.groupBy("key").transformWithStateInPandas(Redactor(kinds), "key long, seq long, shown string", "append", "none")


class DriftWindow(StatefulProcessor):
    """The last ``size`` vectors of each key to (key, seq, ratio, line) for every row."""

    def __init__(self, centroid: list[float], mean: float, std: float, size: int = 20):
        self.centroid, self.mean, self.std, self.size = centroid, mean, std, size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cosines = handle.getListState("cosines", "c double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = [c for (c,) in self.cosines.get()] if self.cosines.exists() else []
        middle = np.array(self.centroid)

        def cosine(v) -> float:
            x = np.asarray(v, float)
            size = np.linalg.norm(x) * np.linalg.norm(middle)
            return float(x @ middle / size) if size else 0.0

        # vectors are let go part by part: of a batch two numbers a row are put in order
        seen = [(seq, cosine(v)) for part in rows for seq, v in zip(part["seq"], part["vec"], strict=True)]
        out = []
        for seq, c in sorted(seen, key=lambda x: x[0]):
            last = [*last, c][-self.size :]
            out.append((key[0], seq, float(np.mean(last)) / self.mean, 1 - 3 * self.std / (self.mean * len(last) ** 0.5)))
        self.cosines.put([(c,) for c in last])
        yield pd.DataFrame(out, columns=["key", "seq", "ratio", "line"])

    def close(self) -> None:
        pass


def drift_stream(vectors: DataFrame, centroid: list[float], mean: float, std: float, size: int = 20) -> DataFrame:
    return vectors.groupBy("key").transformWithStateInPandas(DriftWindow(centroid, mean, std, size), "key long, seq long, ratio double, line double", "append", "none")


def rate_stream(events: DataFrame, *, ts: str = "ts", by: str = "event_type", late: str = "5 minutes") -> DataFrame:
    """Sliding rates with a watermark; state of a window goes once it is past."""
    windows = events.withWatermark(ts, late).groupBy(F.window(ts, "5 minutes", "1 minute").alias("w"), by).agg(F.count("*").alias("n"))
    return windows.select(by, F.col("w.start").alias("window_start"), (F.col("n") / 300.0).alias("rate"))


def counter_stream(events: DataFrame, labels: list[str]) -> DataFrame:
    return events.groupBy(*labels).agg(F.count("*").alias("n"))
