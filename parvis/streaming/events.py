"""Streams of page fetches and events: incremental manifests, windows and alerts.

The catalog's own work is batch; these run the same operators on Structured Streaming for continuous feeds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(events: DataFrame, *, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, events, value) per window; events later than the watermark are left out on a stream."""
    kept = events.withWatermark("ts", late) if events.isStreaming else events
    return kept.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "events", "value")


def latest_by_key(folder: str, key: list[str], order: str):
    """A foreachBatch function that keeps a parquet table of the latest row per key, writing each version aside."""

    def apply(batch: DataFrame, epoch: int) -> None:
        from parvis.operators.dedupe import keep_first

        spark = batch.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        done = sorted(int(s.getPath().getName()) for s in (fs.globStatus(path(f"{folder}/*")) or []) if s.getPath().getName().isdigit() and fs.exists(path(f"{folder}/{s.getPath().getName()}/_SUCCESS")))
        before = [v for v in done if v < epoch]
        rows = batch if not before else batch.unionByName(spark.read.parquet(f"{folder}/{before[-1]}"))
        keep_first(rows, key, [-F.unix_micros(order)]).write.mode("overwrite").parquet(f"{folder}/{epoch}")

    return apply


def sessions(events: DataFrame, *, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user_id, start, end, events) per session of a user."""
    kept = events.withWatermark("ts", late) if events.isStreaming else events
    return kept.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("events")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "events")


def running_totals(events: DataFrame) -> DataFrame:
    """(user_id, events, value) per user so far, kept as state on a stream; state of idle users ends after a day."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        if state.hasTimedOut:
            state.remove()
            return
        for b in batches:
            n, total = n + len(b), total + float(b["value"].sum())
        state.update((n, total))
        state.setTimeoutDuration(86_400_000)
        yield pd.DataFrame({"user_id": [key[0]], "events": [n], "value": [total]})

    return events.groupBy("user_id").applyInPandasWithState(update, "user_id bigint, events bigint, value double", "events bigint, value double", "update", GroupStateTimeout.ProcessingTimeTimeout)


def start(rows: DataFrame, apply, checkpoint: str) -> DataStreamWriter:
    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
