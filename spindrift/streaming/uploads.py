"""The states of uploads as a stream: each upload's state is kept by its id, an event
changes it if it may follow, and one that stays in processing too long fails by a timer."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.uploads import STATES

STATE = "status string, progress int, error string, seq long"
OUT = "id string, status string, progress int, error string, seq long, stalled boolean"
#: Milliseconds in processing after which an upload fails; those after which one that has
#: come to an end is forgotten. Both by the times of events.
STALLED, FORGOTTEN = 3_600_000, 90 * 86_400_000
#: A stream of states needs this store.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def follows(before: str, after: str) -> bool:
    return after in STATES.get(before, ())


class UploadStates(StatefulProcessor):
    """Rows of a key come in any order within a batch and are taken by ``seq``; one that is
    older than the last one taken, or that may not follow, is passed over."""

    def __init__(self, stalled: int = STALLED, forgotten: int = FORGOTTEN) -> None:
        self.stalled, self.forgotten = stalled, forgotten

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", STATE)
        self.timer = handle.getValueState("timer", "at long")

    def _timed(self, at: int) -> None:
        """One timer a key: the one that its state asks for."""
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        known = self.state.exists()
        status, progress, error, seq = self.state.get() if known else ("processing", 0, None, -1)
        before, at = (status if known else None), 0
        for r in sorted(rows, key=lambda r: r["seq"]):
            at = max(at, r["ms"])
            if r["seq"] <= seq:
                continue
            seq = r["seq"]
            if follows(status, r["status"]):
                status, progress, error = r["status"], r["progress"], (r["error"] or "")[:2000] or None
        self.state.update((status, progress, error, seq))
        if status != before:
            self._timed(max(at, timerValues.getCurrentWatermarkInMs()) + (self.stalled if status == "processing" else self.forgotten))
        yield Row(id=key[0], status=status, progress=progress, error=error, seq=seq, stalled=False)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        status, progress, _, seq = self.state.get()
        if status == "processing":
            self.state.update(("failed", progress, "stalled", seq))
            self.timer.clear()
            self._timed(timerValues.getCurrentWatermarkInMs() + self.forgotten)
            yield Row(id=key[0], status="failed", progress=progress, error="stalled", seq=seq, stalled=True)
        else:
            self.state.clear()
            self.timer.clear()

    def close(self) -> None:
        pass


def states(events: DataFrame, late: str = "10 minutes", stalled: int = STALLED, forgotten: int = FORGOTTEN) -> DataFrame:
    """(id, status, progress, error, seq, stalled) after each batch of a stream of events
    (id, status, seq, progress, error, at), of the uploads that it has changed. Events
    that are ``late`` are dropped. The session's state store has to be ``PROVIDER``."""
    at = F.col("at").cast("timestamp")
    e = events.select(F.col("id").cast("string").alias("id"), "status", F.col("seq").cast("long").alias("seq"), F.col("progress").cast("int").alias("progress"), F.col("error").cast("string").alias("error"), at.alias("at"), F.unix_millis(at).alias("ms"))
    return e.withWatermark("at", late).groupBy("id").transformWithState(UploadStates(stalled, forgotten), OUT, "update", "EventTime")
