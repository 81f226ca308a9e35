"""Streams of messages and usage events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.cost import with_cost
from ..operators.prepare import lenient_stream_filter


def file_stream(spark: SparkSession, path: str, schema, kind: str = "parquet", files: int = 16, **options) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).options(**options).format(kind).load(path)


def messages(stream: DataFrame) -> DataFrame:
    """The messages of a stream that are kept, cleaned."""
    return lenient_stream_filter(stream)


def hourly_usage(usage: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Cost by hour; a bucket is final once the watermark has passed it."""
    w = with_cost(usage).withWatermark("ts", late).groupBy(F.window("ts", "1 hour")).agg(F.count("*").alias("n"), F.sum("cost_usd").alias("cost_usd"))
    return w.select(F.col("window.start").alias("hour"), "n", "cost_usd")


def sliding_spikes(usage: DataFrame, limit: float, late: str = "10 minutes") -> DataFrame:
    w = with_cost(usage).withWatermark("ts", late).groupBy(F.window("ts", "1 hour", "5 minutes")).agg(F.sum("cost_usd").alias("cost_usd"))
    return w.filter(F.col("cost_usd") >= limit).select(F.col("window.start").alias("start"), "cost_usd")


def user_sessions(usage: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    w = with_cost(usage).withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"), F.sum("cost_usd").alias("cost_usd"))
    return w.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "cost_usd")


def cooled_alerts(alerts: DataFrame, seconds: int = 3600, forget: int | None = None) -> DataFrame:
    """Of alerts (alert_type, seconds, value): those that pass their type's cooldown; the
    state is the time of the last alert that passed. Late alerts don't pass. A type of
    which nothing came for `forget` seconds of the clock loses its state (None: never); choose
    more than the cooldown and the greatest delay."""

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, passed = (state.get[0] if state.exists else None), []
        rows = pd.concat([p.sort_values("seconds", kind="stable") for p in parts]).sort_values("seconds", kind="stable")
        at = rows["seconds"].to_numpy()
        i = 0 if last is None else int(at.searchsorted(last + seconds))
        while i < len(at):  # from one passing time to the next
            passed.append(i)
            last = int(at[i])
            i += int(at[i:].searchsorted(last + seconds)) if seconds > 0 else 1
        if last is not None:
            state.update((last,))
        if forget is not None:
            state.setTimeoutDuration(forget * 1000)
        yield rows.iloc[passed]

    schema = "alert_type string, seconds long, value double"
    timeout = GroupStateTimeout.NoTimeout if forget is None else GroupStateTimeout.ProcessingTimeTimeout
    return alerts.select("alert_type", "seconds", "value").groupBy("alert_type").applyInPandasWithState(fold, schema, "last long", "append", timeout)


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that is there, as a table in memory; for tests and small results."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def for_each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """Call `handle` with every micro-batch, once each by its number."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
