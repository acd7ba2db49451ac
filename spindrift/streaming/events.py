"""Windows over an event stream, with a watermark for what comes late."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Event time as the parquet tables have it has no zone; a watermark needs one.
TIME = "ts"


def windowed(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "30 minutes") -> DataFrame:
    """Counts and sums by window and event type."""
    e = events.withColumn(TIME, F.col(TIME).cast("timestamp")).withWatermark(TIME, late)
    w = F.window(TIME, length, slide) if slide else F.window(TIME, length)
    return e.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def distinct_events(events: DataFrame, late: str = "30 minutes") -> DataFrame:
    e = events.withColumn(TIME, F.col(TIME).cast("timestamp")).withWatermark(TIME, late)
    return e.dropDuplicatesWithinWatermark(["event_id"])


def running_sessions(messages: DataFrame) -> DataFrame:
    """(conv_id, n, last_role) after each batch of messages, from state kept by
    conversation."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        n, turn, role = state.get if state.exists else (0, -1, "")
        for df in batches:
            n += len(df)
            last = df.sort_values("turn").iloc[-1]
            if int(last["turn"]) >= turn:
                turn, role = int(last["turn"]), str(last["role"])
        state.update((n, turn, role))
        yield pd.DataFrame({"conv_id": [key[0]], "n": [n], "last_role": [role]})

    return messages.groupBy("conv_id").applyInPandasWithState(fold, "conv_id long, n long, last_role string", "n long, turn long, role string", "update", "NoTimeout")
