"""Event logs as streams: counters by blocks, late results, throttled writes, windows over event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..model import CHECKPOINT


def trace_stream(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """Trace files in order of arrival."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def stream_blocks(trace: DataFrame, stride: int = CHECKPOINT) -> DataFrame:
    """Counts of every block of events; complete or update mode (partial counts merge across batches)."""
    count = lambda k: F.sum(F.when(F.col("kind") == k, 1).otherwise(0)).alias
    return trace.groupBy(F.floor((F.col("event") - 1) / stride).alias("block")).agg(F.count(F.lit(1)).alias("events"), count(0)("settled"), count(1)("examined"), count(2)("improved"))


def stream_windows(events: DataFrame, width: str, late: str, slide: str | None = None) -> DataFrame:
    """Events (ts, event_type) by time windows with a watermark."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def latest_results(results: DataFrame) -> DataFrame:
    """Only results of each client's latest request stay: the highest request id with its value."""
    return results.groupBy("client").agg(F.max_by("value", "request_id").alias("value"), F.max("request_id").alias("request_id"))


def throttle_times(times: list[int], gap: int) -> list[int]:
    """Which arrival is written when: at most one write a gap; a write carries the latest arrival before it."""
    writes, due = [], None
    last = None
    for i, t in enumerate(times):
        while due is not None and due <= t:
            writes.append(due)
            last, due = due, None
        if due is None:
            due = t if last is None or t - last >= gap else last + gap
            if due == t:
                writes.append(t)
                last, due = t, None
    if due is not None:
        writes.append(due)
    return writes


class Throttle:
    """Writes of one client: the time of the last one, when the pending one is due (-1: none) and its value."""

    def __init__(self, gap: int, last: int = -(10**15), due: int = -1, value: str = ""):
        self.gap, self.last, self.due, self.value = gap, last, due, value

    def release(self, now: int | None = None) -> list[tuple[int, str]]:
        """The pending write, if it is due by now (or at all)."""
        if self.due < 0 or now is not None and self.due > now:
            return []
        self.last, self.due = self.due, -1
        return [(self.last, self.value)]

    def change(self, at: int, value: str) -> list[tuple[int, str]]:
        made = self.release(at)
        if self.due < 0:
            self.due = max(at, self.last + self.gap)
        self.value = value
        return made + (self.release(at) if self.due <= at else [])


def throttled(changes: DataFrame, gap_ms: int = 500) -> DataFrame:
    """client, at, value: coalesced writes of a table or a stream of changes (client, at in ms, value).

    A client writes once a gap at most; a write carries the latest change before it. A pending
    write is released by a later change or, in a stream, when the gap has passed since its batch;
    in a table the last one is released at its time. A client's changes are one task's.
    """
    schema = "client string, at long, value string"

    def frame(client, made) -> pd.DataFrame:
        return pd.DataFrame([(client, *m) for m in made], columns=["client", "at", "value"])

    if not changes.isStreaming:

        def whole(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            t = Throttle(gap_ms)
            rows = rows.sort_values("at", kind="stable")
            made = [m for at, v in zip(rows["at"], rows["value"], strict=True) for m in t.change(int(at), v)]
            return frame(key[0], made + t.release())

        return changes.groupBy("client").applyInPandas(whole, schema)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        t = Throttle(gap_ms, *(state.get if state.exists else ()))
        if state.hasTimedOut:
            made = t.release()
        else:
            rows = pd.concat(list(batches)).sort_values("at", kind="stable")
            made = [m for at, v in zip(rows["at"], rows["value"], strict=True) for m in t.change(int(at), v)]
        state.update((int(t.last), int(t.due), t.value))
        if t.due >= 0:
            state.setTimeoutDuration(gap_ms)
        yield frame(key[0], made)

    return changes.groupBy("client").applyInPandasWithState(run, schema, "last long, due long, value string", "append", GroupStateTimeout.ProcessingTimeTimeout)
