"""Trends, frames and anomalies over ordered series.

Series that belong to something are partitioned by it; a series of its own is dealt out by
ranges of its order, each with what its frames need of the ranges beside it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .ordered import over_rows, over_time, positions, running_sum


def _rows(df: DataFrame, order: str, group: str | None, columns: Callable, before: int = 0, after: int = 0) -> DataFrame:
    """Columns over frames of a few rows, of each group or of the whole series."""
    if group:
        return df.withColumns(columns(W.partitionBy(group).orderBy(order)))
    return over_rows(df, [order], columns, before, after)


def _time(df: DataFrame, time: str, group: str | None, columns: Callable, back: int) -> DataFrame:
    return df.withColumns(columns(W.partitionBy(group).orderBy(time))) if group else over_time(df, time, columns, back)


def half_split_trend(df: DataFrame, value: str, order: str, group: str | None = None, percent: float = 5.0, least: int = 3, floor: float | None = None) -> DataFrame:
    """Mean of the later half against the earlier one. With a floor, changes are relative to
    no less than it, and short series are stable."""
    if group:
        w = W.partitionBy(group)
        rows = df.withColumn("__r", F.row_number().over(w.orderBy(order))).withColumn("__n", F.count("*").over(w))
    else:
        rows = positions(df, order, name="__r").withColumn("__r", F.col("__r") + 1).crossJoin(F.broadcast(df.agg(F.count("*").alias("__n"))))  # a single row
    first = F.col("__r") <= F.floor(F.col("__n") / 2)
    g = rows.groupBy(*([group] if group else [])).agg(F.count("*").alias("n"), F.avg(F.when(first, F.col(value))).alias("before"), F.avg(F.when(~first, F.col(value))).alias("after"))
    change = F.when(F.col("before") != 0, (F.col("after") - F.col("before")) / F.col("before") * 100).otherwise(0.0)
    if floor is not None:
        change = (F.col("after") - F.col("before")) / F.greatest(F.col("before"), F.lit(floor)) * 100
    label = F.when(F.col("n") < least, "insufficient_data" if floor is None else "stable").when(change > percent, "increasing").when(change < -percent, "decreasing").otherwise("stable")
    return g.withColumn("change", change).withColumn("trend", label)


def ends_trend(df: DataFrame, value: str, order: str, k: int = 3, margin: float = 5.0) -> DataFrame:
    """Mean of the last k against the first k."""
    end = lambda o, name: df.orderBy(o).limit(k).agg(F.avg(value).alias(name))  # noqa: E731  k rows each
    g = end(F.asc(order), "first").crossJoin(end(F.desc(order), "last"))  # single rows
    d = F.col("last") - F.col("first")
    return g.withColumn("trend", F.when(d > margin, "improving").when(d < -margin, "declining").otherwise("stable"))


def last_zscore(df: DataFrame, value: str, order: str, group: str | None = None, n: int = 10, sigmas: float = 2.0) -> DataFrame:
    """Each value against mean and population deviation of the last n."""
    frame = lambda w: w.rowsBetween(-(n - 1), 0)
    out = _rows(df, order, group, lambda w: {"mean": F.avg(value).over(frame(w)), "std": F.stddev_pop(value).over(frame(w)), "n": F.count(value).over(frame(w))}, before=n - 1)
    return out.withColumn("z", F.when(F.col("std") > 0, (F.col(value) - F.col("mean")) / F.col("std"))).withColumn("anomaly", (F.col("n") >= n) & (F.col(value) > F.col("mean") + sigmas * F.col("std")))


def trailing_range(df: DataFrame, value: str, seconds_col: str, group: str | None = None, seconds: int = 3600) -> DataFrame:
    """Greatest minus least value of the trailing time."""
    frame = lambda w: w.rangeBetween(-seconds, 0)
    return _time(df, seconds_col, group, lambda w: {"spread": F.max(value).over(frame(w)) - F.min(value).over(frame(w))}, seconds)


def trailing_mean(df: DataFrame, value: str, seconds_col: str, group: str | None = None, seconds: int = 600) -> DataFrame:
    return _time(df, seconds_col, group, lambda w: {"trailing": F.avg(value).over(w.rangeBetween(-seconds, 0))}, seconds)


def recent_trend(df: DataFrame, value: str, seconds_col: str, group: str, minutes: int = 10, last: int = 10) -> DataFrame:
    """Mean and trend (10 per cent, floor 0.01) of each group's last minutes, or of its last
    rows if these hold less than two."""
    w = W.partitionBy(group)
    rows = df.withColumn("__t", F.max(seconds_col).over(w)).withColumn("__r", F.row_number().over(w.orderBy(F.desc(seconds_col))))
    rows = rows.withColumn("__in", F.col(seconds_col) >= F.col("__t") - 60 * minutes)
    rows = rows.withColumn("__k", F.sum(F.col("__in").cast("int")).over(w))
    kept = rows.filter(F.when(F.col("__k") >= 2, F.col("__in")).otherwise(F.col("__r") <= last))
    trend = half_split_trend(kept, value, seconds_col, group, percent=10.0, least=2, floor=0.01)
    return trend.join(kept.groupBy(group).agg(F.avg(value).alias("mean")), group).select(group, "n", "mean", "trend")


def slope(df: DataFrame, value: str, order: str, group: str | None = None, n: int = 5) -> DataFrame:
    """(last - first) / n over the last n values."""
    return _rows(df, order, group, lambda w: {"slope": (F.col(value) - F.lag(value, n - 1).over(w)) / n}, before=n - 1)


def running_mean(df: DataFrame, value: str, order: str, group: str | None = None) -> DataFrame:
    if group:
        w = W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
        return df.withColumn("running", F.sum(value).over(w) / F.count(value).over(w))
    counted = df.withColumn("__v", F.col(value).isNotNull().cast("int"))
    out = running_sum(running_sum(counted, value, order, name="__s"), "__v", order, name="__c")
    return out.withColumn("running", F.try_divide("__s", "__c")).drop("__v", "__s", "__c")


def stability_points(df: DataFrame, value: str, order: str, n: int = 5, most: float = 100.0) -> DataFrame:
    """10 points for steady last values, 5 if their variance is over `most`."""
    out = _rows(df, order, None, lambda w: {"__v": F.var_pop(value).over(w.rowsBetween(-(n - 1), 0))}, before=n - 1)
    return out.withColumn("points", F.when(F.col("__v") > most, 5).otherwise(10)).drop("__v")


def diminishing_returns(df: DataFrame, x: str, y: str) -> DataFrame:
    """The least x after which y falls no further."""
    steps = _rows(df, x, None, lambda w: {"__s": (F.lead(y).over(w) - F.col(y)) / (F.lead(x).over(w) - F.col(x))}, after=1)
    return steps.filter(F.col("__s") > -1e-6).agg(F.min(x).alias("from_size"))


def best_neighbourhood(df: DataFrame, x: str, y: str) -> DataFrame:
    """The x of the least y, and the x before and after it."""
    rows = _rows(df, x, None, lambda w: {"previous": F.lag(x).over(w), "following": F.lead(x).over(w)}, before=1, after=1)
    return rows.agg(F.min_by(x, F.struct(y, x)).alias("optimal"), F.min_by("previous", F.struct(y, x)).alias("previous"), F.min_by("following", F.struct(y, x)).alias("following"))


def outliers(df: DataFrame, value: str, sigmas: float = 2.0, high: float = 3.0, least: int = 3) -> DataFrame:
    """Rows over `sigmas` sample deviations off the mean. The statistics are one row."""
    s = df.agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n"))
    off = F.abs(F.col(value) - F.col("mean"))
    out = df.crossJoin(F.broadcast(s)).filter((F.col("n") >= least) & (off > sigmas * F.col("std")))
    return out.withColumn("severity", F.when(off > high * F.col("std"), "high").otherwise("medium")).drop("n")


def eviction_order(df: DataFrame, size: str, accessed: str, limit: float, keep: float = 0.8) -> DataFrame:
    """Least recently used entries to delete until `keep` of the limit is met; none if
    the limit holds."""
    total = df.agg(F.sum(size).alias("__t"))
    out = running_sum(df, size, accessed, name="__run").withColumn("__before", F.col("__run") - F.coalesce(F.col(size), F.lit(0))).drop("__run").crossJoin(F.broadcast(total))  # a single row
    return out.filter((F.col("__t") > limit) & (F.col("__t") - F.col("__before") > keep * limit)).drop("__before", "__t")
