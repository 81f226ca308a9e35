"""Positions, running sums and frames over a whole table in one order, without a task that
holds all of it: rows are dealt out by ranges of the order and written, sums are made within a
range, and the ranges' totals (a row for each) are added. For a frame of some rows or
some time, each range also gets copies of the rows that it needs of its neighbours."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.work import materialise

_INSIDE = (1 << 33) - 1


def placed(df: DataFrame, *order: str) -> DataFrame:
    """The rows with their range (__p) and their place in it (__i). They're written to the
    shared folder, as ranges are drawn from a sample and must not be drawn twice."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialise(ranged.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id().bitwiseAND(F.lit(_INSIDE))), "ranges")


def _offsets(rows: DataFrame, total) -> DataFrame:
    sums = rows.groupBy("__p").agg(total.alias("__s"))
    w = W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    return sums.select("__p", F.coalesce(F.sum("__s").over(w), F.lit(0)).alias("__b"))


def positions(df: DataFrame, *order: str, name: str = "position") -> DataFrame:
    """With each row's number in the order, from 0."""
    rows = placed(df, *order)
    return rows.join(F.broadcast(_offsets(rows, F.count("*"))), "__p").withColumn(name, F.col("__b") + F.col("__i")).drop("__p", "__i", "__b")


def running_sum(df: DataFrame, value: str, *order: str, name: str = "running") -> DataFrame:
    """With the sum of the value over all rows up to and including this one; nulls count 0."""
    rows = placed(df, *order)
    v = F.coalesce(F.col(value), F.lit(0))
    inside = F.sum(v).over(W.partitionBy("__p").orderBy("__i").rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn(name, inside).join(F.broadcast(_offsets(rows, F.sum(v))), "__p").withColumn(name, F.col(name) + F.col("__b")).drop("__p", "__i", "__b")


def _framed(rows: DataFrame, halo: DataFrame, inner: str, columns: Callable) -> DataFrame:
    """Columns over a window of each range and its copies, for the range's own rows."""
    names = [c for c in rows.columns if not c.startswith("__")]
    every = rows.withColumn("__own", F.lit(True)).unionByName(halo.withColumn("__own", F.lit(False)))
    made = columns(W.partitionBy("__p").orderBy(inner))
    return every.withColumns(made).filter("__own").select(*names, *(c for c in made if c not in names))


def over_rows(df: DataFrame, order: list[str], columns: Callable[[object], dict[str, Column]], before: int = 0, after: int = 0) -> DataFrame:
    """With columns over windows in the order, whose frames reach at most `before` rows back
    and `after` rows ahead. `columns` makes them from the ordered window."""
    rows = placed(df, *order)
    counts = rows.groupBy("__p").agg(F.count("*").alias("__n"))
    first = F.coalesce(F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    ranges = counts.withColumn("__f", first)
    rows = rows.join(F.broadcast(ranges), "__p").withColumn("__g", F.col("__f") + F.col("__i"))
    edge = rows.filter((F.col("__i") >= F.col("__n") - before) | (F.col("__i") < after)).drop("__f", "__n")
    others = ranges.select(F.col("__p").alias("__q"), F.col("__f").alias("__from"), (F.col("__f") + F.col("__n")).alias("__to"))
    near = (F.col("__q") != F.col("__p")) & (F.col("__g") >= F.col("__from") - before) & (F.col("__g") < F.col("__to") + after)
    halo = edge.join(F.broadcast(others), near).withColumn("__p", F.col("__q")).drop("__q", "__from", "__to")
    return _framed(rows.drop("__f", "__n"), halo, "__g", columns)


def over_time(df: DataFrame, time: str, columns: Callable[[object], dict[str, Column]], back: float) -> DataFrame:
    """As `over_rows`, for frames that reach `back` units of the order's value back. Rows of one
    value lie in one range."""
    rows = placed(df, time)
    ahead = W.orderBy("__p")  # a row for each range
    ranges = rows.groupBy("__p").agg(F.min(time).alias("__from")).filter("__from is not null").withColumn("__next", F.lead("__from").over(ahead))
    edge = rows.join(F.broadcast(ranges.select("__p", "__next")), "__p").filter(F.col(time) >= F.col("__next") - back).drop("__next")
    others = ranges.select(F.col("__p").alias("__q"), "__from")
    near = (F.col("__q") > F.col("__p")) & (F.col(time) >= F.col("__from") - back)
    halo = edge.join(F.broadcast(others), near).withColumn("__p", F.col("__q")).drop("__q", "__from")
    return _framed(rows, halo, time, columns)
