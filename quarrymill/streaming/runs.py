"""The run log as a stream: states of runs from their events, late events held back by a watermark."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, files: int = 8) -> DataFrame:
    """New Parquet files of a folder as a stream, a bounded number of files for each batch."""
    rows = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """start, event_type, n, total of each window; state older than the watermark is dropped."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def run_states(events: DataFrame) -> DataFrame:
    """user_id, status, events, updated: the last event of each run wins."""
    return events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.count("*").alias("events"), F.max("ts").alias("updated"))


def write(df: DataFrame, target: str, checkpoint: str, mode: str = "append"):
    """Start a query that handles what is there and stops; from its checkpoint a later call goes on.

    append writes Parquet files to the target; complete and update keep a table in memory under that name, for tests.
    """
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.format("parquet").start(target) if mode == "append" else writer.format("memory").queryName(target).start()


#: What a run may turn to, by its status; a run begins with none.
ALLOWED = {"": ("signup", "view"), "signup": ("view",), "view": ("view", "click"), "click": ("view", "click", "purchase"), "purchase": ("view",)}
CHANGES = "user_id long, event_id long, ts timestamp, event_type string, before string, status string, outcome string"


def transitions(events: DataFrame, allowed: Mapping[str, Sequence[str]] = ALLOWED, late: str = "1 hour", stuck: str = "1 day") -> DataFrame:
    """user_id, event_id, ts, event_type, before, status, outcome of each event: 'accepted' where the run's status allows it, else 'refused'; and a row 'stuck' for each run that hears nothing for so long.

    The state of a run is its status and the time of its last event. The events of a batch are taken in the order of their times;
    those behind the watermark are gone. A timer on event time ends with the next event of its run. This goes beyond a last-event-wins log: an event
    that a run's status forbids leaves it as it is, and goes to the side (``outcome``).
    """
    wait = int(pd.Timedelta(stuck).total_seconds() * 1000)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        status, last = state.get if state.exists else ("", 0)
        if state.hasTimedOut:
            state.update((status, last))
            yield pd.DataFrame({"user_id": [key[0]], "event_id": [None], "ts": [pd.Timestamp(last + wait, unit="ms")], "event_type": [None], "before": [status], "status": [status], "outcome": ["stuck"]})
            return
        out = []
        for r in pd.concat(frames).sort_values(["ts", "event_id"]).itertuples():
            before, ok = status, r.event_type in allowed.get(status, ())
            status = r.event_type if ok else status
            last = max(last, int(r.ts.timestamp() * 1000))
            out.append((key[0], r.event_id, r.ts, r.event_type, before, status, "accepted" if ok else "refused"))
        state.update((status, last))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + wait)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CHANGES.split(", ")])

    held = events.select("user_id", "event_id", "ts", "event_type").withWatermark("ts", late)
    return held.groupBy("user_id").applyInPandasWithState(step, CHANGES, "status string, last long", "append", "EventTimeTimeout")
