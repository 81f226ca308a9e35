"""Exact quantiles of whole tables, without a buffer of all values: equal values are counted
first, the counts are summed up along ranges of the values, and the values at the two places
around each quantile are picked by one more aggregation. No task holds more than a range."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import dimension
from .ordered import running_sum


def quantiles(df: DataFrame, value: str, fractions: dict[str, float], by: tuple[str, ...] = ()) -> DataFrame:
    """For each group of `by` (the whole table if there's none): a column for each named fraction,
    interpolated between neighbours; nulls don't count. Without a value, the whole table gives a
    row of nulls and a group gives none."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    run = running_sum(counts, "__n", *by, "__v", name="__c")
    span = run.groupBy(*(F.col(c).alias(f"__{c}") for c in by)).agg(F.min(F.col("__c") - F.col("__n")).alias("__f"), F.sum("__n").alias("__t"))
    if by:
        same = functools.reduce(operator.and_, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by))
        run = run.join(dimension(span), same)
    else:
        run = run.crossJoin(F.broadcast(span))  # a single row
    place = lambda q: F.lit(q) * (F.col("__t") - 1)
    at = lambda r: F.min(F.when(F.col("__c") - F.col("__f") > r, F.col("__v").cast("double")))
    ends = [x for n, q in fractions.items() for x in (at(F.floor(place(q))).alias(f"__lo_{n}"), at(F.ceil(place(q))).alias(f"__hi_{n}"), F.first(place(q) - F.floor(place(q))).alias(f"__w_{n}"))]
    between = lambda n: F.when(F.col(f"__w_{n}") == 0, F.col(f"__lo_{n}")).otherwise((1 - F.col(f"__w_{n}")) * F.col(f"__lo_{n}") + F.col(f"__w_{n}") * F.col(f"__hi_{n}"))
    return run.groupBy(*by).agg(*ends).select(*by, *(between(n).alias(n) for n in fractions))


def with_medians(one: DataFrame, df: DataFrame, medians: dict[str, Column]) -> DataFrame:
    """A row of statistics with the median of each column of `df`."""
    for name, c in medians.items():
        one = one.crossJoin(F.broadcast(quantiles(df.select(c.alias("v")), "v", {name: 0.5})))  # single rows
    return one
