"""Budget alerts over usage and metric tables: thresholds, spikes, predictions, cooldown."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .ordered import positions

#: What `check` finds.
FOUND = "alert_id string, alert_type string, level string, ts timestamp, value double, threshold double, acknowledged boolean, suspends boolean"
ALERT = "alert_type string, level string, ts timestamp_ntz, value double, threshold double"


# Default rules (alert_type, level, threshold).
RULES = [("budget_threshold", "warning", 0.5), ("budget_threshold", "critical", 0.75), ("budget_threshold", "emergency", 0.95), ("daily_limit", "critical", 10.0), ("hourly_spike", "warning", 2.0)]


def rules(spark: SparkSession, own: list[tuple[str, str, float]] | None = None) -> DataFrame:
    """The rules as a table; rules of a type and threshold replace each other."""
    every = {(t, v): (t, level, v) for t, level, v in [*RULES, *(own or [])]}
    return spark.createDataFrame(sorted(every.values()), "alert_type string, level string, threshold double")


def without_rule(table: DataFrame, alert_type: str, threshold: float) -> DataFrame:
    return table.filter(~((F.col("alert_type") == alert_type) & (F.col("threshold") == threshold)))


def check(values: DataFrame, table: DataFrame) -> DataFrame:
    """Alerts of values (alert_type, ts, value) that reach a rule of their type; an
    emergency suspends. Rules are few and broadcast."""
    from .joins import dimension

    hit = values.join(dimension(table), "alert_type").filter(F.col("value") >= F.col("threshold"))
    name = F.sha2(F.concat_ws(":", "alert_type", "threshold", F.col("ts").cast("string")), 256)
    return hit.select(name.alias("alert_id"), "alert_type", "level", "ts", "value", "threshold", F.lit(False).alias("acknowledged"), (F.col("level") == "emergency").alias("suspends"))


def daily_limit(usage_cost: DataFrame, limit: float) -> DataFrame:
    """Days whose cost reaches the limit."""
    return usage_cost.groupBy(F.to_date("ts").alias("day")).agg(F.sum("cost_usd").alias("cost")).filter(F.col("cost") >= limit)


def hourly_spikes(points: DataFrame, value: str, seconds: str, limit: float) -> DataFrame:
    """Points where the value has moved by the limit within an hour."""
    from .trend import trailing_range

    return trailing_range(points, value, seconds).filter(F.col("spread") >= limit)


def predictive(points: DataFrame, budget: float, group: str | None = None) -> DataFrame:
    """Points (progress, cost) whose cost at this progress leads over the budget; from a
    tenth of the work and the fifth point on. Without a group, the points are of one job."""
    if group:
        out = points.withColumn("n", F.row_number().over(W.partitionBy(group).orderBy("ts")))
    else:
        out = positions(points, "ts", name="n").withColumn("n", F.col("n") + 1)
    out = out.withColumn("projected", F.try_divide("cost", "progress"))
    return out.filter((F.col("progress") > 0.1) & (F.col("n") >= 5) & (F.col("projected") > budget))


def efficiency_drops(sessions: DataFrame, limit: float = 0.10) -> DataFrame:
    return sessions.filter(F.col("cost_per_item") > limit)


def cooldown(alerts: DataFrame, key: str, seconds_col: str, seconds: int = 3600) -> DataFrame:
    """Alerts that pass the cooldown of their key: the first, and each at least so long
    after the last one that passed; of those at one time, one. Alerts without a time don't
    pass. A key's different times are found in parallel, so that its task folds at
    most a row for each second that has alerts, however many there are, from one passing time
    to the next by binary search."""
    if seconds <= 0:
        return alerts
    rows = alerts.filter(F.col(seconds_col).isNotNull())
    times = rows.select(F.col(key).alias("__k"), F.col(seconds_col).cast("long").alias("__t")).distinct()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, last = object(), None
        for b in batches:
            if not len(b):
                continue
            keys, t = b.column(0).to_pylist(), b.column(1).to_numpy()
            new = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]
            keep = []
            for begin, end in zip([0, *new], [*new, len(keys)]):
                if keys[begin] != current:
                    current, last = keys[begin], None
                i = begin if last is None else begin + int(np.searchsorted(t[begin:end], last + seconds))
                while i < end:
                    keep.append(i)
                    last = int(t[i])
                    i += int(np.searchsorted(t[i:end], last + seconds))
            yield b.take(pa.array(keep, pa.int64()))

    kind = alerts.schema[key].dataType.simpleString()
    passing = times.repartition("__k").sortWithinPartitions("__k", "__t").mapInArrow(fold, f"__k {kind}, __t long")
    found = rows.join(passing, F.col(key).eqNullSafe(F.col("__k")) & (F.col(seconds_col).cast("long") == F.col("__t")), "left_semi")
    return found.dropDuplicates([key, seconds_col])


def statistics(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("alert_type", "level").agg(F.count("*").alias("n"))


def keep_last(alerts: DataFrame, n: int = 1000) -> DataFrame:
    return alerts.orderBy(F.desc("ts")).limit(n)


def acknowledge(alerts: DataFrame, ids: DataFrame) -> DataFrame:
    """The alerts with those of the ids marked."""
    marked = ids.select("alert_id").distinct().withColumn("__m", F.lit(True))
    return alerts.join(marked, "alert_id", "left").withColumn("acknowledged", F.coalesce(F.col("__m"), F.col("acknowledged"))).drop("__m")


