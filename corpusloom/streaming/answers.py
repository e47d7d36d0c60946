"""Answers that come in pieces: each piece goes through as it comes, then one final record; a stalled answer is closed by a timer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "key long, seq long, kind string, text string, pieces long"
COLUMNS = ["key", "seq", "kind", "text", "pieces"]


class AnswerStream(StatefulProcessor):
    """Pieces (key, seq from 0, piece, last) to rows: ``piece`` for each in order, then ``final`` with the whole text, or ``stalled``.

    A piece before its turn waits; one that was seen, and those after the end, are dropped. An answer whose next piece
    does not come within ``idle_ms`` is closed with what it has, pieces behind a gap left out. Times are those of the
    watermark (event time) or of the clock (processing time). With processing time the mark of a closed answer goes
    after ``ttl_ms``; with event time it is a single number that stays, or goes with its timer after ``ttl_ms``.
    """

    def __init__(self, idle_ms: int, ttl_ms: int, event_time: bool):
        self.idle_ms, self.ttl_ms, self.event_time = idle_ms, ttl_ms, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        ttl = None if self.event_time else self.ttl_ms
        self.open = handle.getValueState("open", "next long, text string, timer long")
        self.waiting = handle.getMapState("waiting", "seq long", "piece string, last boolean")
        self.closed = handle.getValueState("closed", "timer long", ttl)

    def _now(self, timerValues) -> int:
        return timerValues.getCurrentWatermarkInMs() if self.event_time else timerValues.getCurrentProcessingTimeInMs()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if self.closed.exists():
            return
        at, text, timer = self.open.get() if self.open.exists() else (0, "", None)
        latest = None
        for part in rows:
            out = []
            if self.event_time:
                seen = int(part["at_ms"].max())
                latest = seen if latest is None else max(latest, seen)
            for seq, piece, last in zip(part["seq"], part["piece"], part["last"], strict=True):
                if seq >= at and not self.waiting.containsKey((int(seq),)):
                    self.waiting.updateValue((int(seq),), (piece or "", bool(last)))
            while self.waiting.containsKey((at,)):
                piece, last = self.waiting.getValue((at,))
                self.waiting.removeKey((at,))
                out.append((key[0], at, "piece", piece, 1))
                at, text = at + 1, text + piece
                if last:
                    out.append((key[0], at, "final", text, at))
                    yield pd.DataFrame(out, columns=COLUMNS)
                    self._close(timer, latest, timerValues)
                    return
            if out:
                yield pd.DataFrame(out, columns=COLUMNS)
        # a later piece puts the end off
        if timer is not None:
            self.handle.deleteTimer(timer)
        begin = latest if self.event_time else self._now(timerValues)
        timer = max(begin, self._now(timerValues)) + self.idle_ms
        self.handle.registerTimer(timer)
        self.open.update((at, text, timer))

    def _close(self, timer: int | None, latest: int | None, timerValues) -> None:
        if timer is not None:
            self.handle.deleteTimer(timer)
        self.open.clear()
        self.waiting.clear()
        end = 0
        if self.event_time and self.ttl_ms:
            end = max(latest or 0, self._now(timerValues)) + self.ttl_ms
            self.handle.registerTimer(end)
        self.closed.update((end,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.closed.exists():
            self.closed.clear()
        elif self.open.exists():
            at, text, _ = self.open.get()
            yield pd.DataFrame([(key[0], at, "stalled", text, at)], columns=COLUMNS)
            self._close(None, expiredTimerInfo.getExpiryTimeInMs(), timerValues)

    def close(self) -> None:
        pass


def answer_stream(pieces: DataFrame, *, idle_ms: int, ttl_ms: int = 0, ts: str | None = None, late: str = "0 seconds") -> DataFrame:
    """(key, seq, kind, text, pieces) of a stream of (key, seq, piece, last).

    With ``ts`` event time decides what is stalled, and a closed answer's mark is forgotten ttl_ms later (never for 0); without it
    the clock does, and the mark is dropped by the state's time to live. An answer in one piece is a piece and its final.
    """
    from pyspark.sql import functions as F

    if ts is None:
        return pieces.select("key", "seq", "piece", "last").groupBy("key").transformWithStateInPandas(AnswerStream(idle_ms, ttl_ms or idle_ms, False), OUT, "append", "processingTime")
    timed = pieces.withWatermark(ts, late).withColumn("at_ms", F.unix_millis(ts)).select("key", "seq", "piece", "last", "at_ms", ts)
    return timed.groupBy("key").transformWithStateInPandas(AnswerStream(idle_ms, ttl_ms, True), OUT, "append", "eventTime")
