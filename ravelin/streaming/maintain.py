"""Structured Streaming over the same operators: records that arrive are upserted, repeated ids are dropped, slots age out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def upsert_files(lines: DataFrame, apply, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Hand each micro-batch of a stream to ``apply(batch, epoch)``; replayed epochs come with the same number."""
    return lines.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def first_of_each(stream: DataFrame, key: str, at: str, lateness: str = "1 hour") -> DataFrame:
    """The first row of each key; what is remembered of keys is bounded by the watermark."""
    return stream.withWatermark(at, lateness).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, at: str, key: str, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """(start, key, n) of tumbling windows, rows later than the watermark left out."""
    return stream.withWatermark(at, lateness).groupBy(F.window(at, width), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")


SLOT_STATE = "text string, valid_from timestamp"
SLOT_OUT = "slot string, text string, valid_from timestamp, valid_to timestamp, reason string"


def slot_stream(stream: DataFrame, slot: str, text: str, at: str, ttl_ms: int, lateness: str = "10 minutes") -> DataFrame:
    """(slot, text, valid_from, valid_to, reason): each value of a slot once it is over, superseded or expired.

    The state of a slot is its one current value, whatever the number of writes; it times out by event time.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        held = state.get if state.exists else None
        if state.hasTimedOut:
            over = pd.Timestamp(held[1]) + pd.Timedelta(milliseconds=ttl_ms)
            state.remove()
            yield pd.DataFrame([(key[0], held[0], held[1], over, "expired")], columns=["slot", "text", "valid_from", "valid_to", "reason"])
            return
        rows = pd.concat(list(batches)).sort_values("at", kind="stable")
        for value, when in zip(rows["text"], rows["at"], strict=True):
            if held is None:
                held = (value, when)
            elif value != held[0] and when >= held[1]:
                out.append((key[0], held[0], held[1], when, "superseded"))
                held = (value, when)
        state.update(held)
        state.setTimeoutTimestamp(max(int(pd.Timestamp(held[1]).timestamp() * 1000) + ttl_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["slot", "text", "valid_from", "valid_to", "reason"])

    rows = stream.select(F.col(slot).cast("string").alias("slot"), F.col(text).alias("text"), F.col(at).cast("timestamp").alias("at")).withWatermark("at", lateness)
    return rows.groupBy("slot").applyInPandasWithState(fold, SLOT_OUT, SLOT_STATE, "append", GroupStateTimeout.EventTimeTimeout)
