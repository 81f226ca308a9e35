"""Joins and set operations between message, category and taxonomy tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Rows of a dimension that is broadcast at most; larger ones are joined by shuffle.
DIMENSION_ROWS = 100_000


def dimension(df: DataFrame) -> DataFrame:
    """The table with a broadcast hint if it is small enough, else as it is."""
    return F.broadcast(df) if df.limit(DIMENSION_ROWS + 1).count() <= DIMENSION_ROWS else df


def merge_results(categories: DataFrame, summaries: DataFrame, key: str = "ticket_id") -> DataFrame:
    """All rows of both sides by key; the categories alone if the summaries have no key."""
    return categories.join(summaries, key, "full_outer") if key in summaries.columns else categories


def without(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return df.join(other.select(key), key, "left_anti")


def only_in(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return df.join(other.select(key), key, "left_semi")


def common_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def missing_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).subtract(b.select(key))


def with_names(df: DataFrame, names: DataFrame, key: str, name_key: str, name: str, alias: str) -> DataFrame:
    """Look up a name; `Category_{id}` where there is none."""
    dim = dimension(names.select(F.col(name_key).alias("__k"), F.col(name).alias("__n")))
    out = df.join(dim, df[key] == F.col("__k"), "left").drop("__k")
    return out.withColumn(alias, F.coalesce("__n", F.concat(F.lit("Category_"), F.col(key).cast("string")))).drop("__n")


def names_of(ids: Column, table: dict[int, str]) -> Column:
    """Names of the known ids, in their order."""
    if not table:
        return F.array().cast("array<string>")
    known = F.create_map(*(F.lit(x) for p in table.items() for x in p))
    return F.array_compact(F.transform(ids, lambda i: F.try_element_at(known, i)))


def merge_taxonomies(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of two taxonomies by technical_name: keywords and examples of both, the longer
    description, ids of the first and new ones after its greatest."""
    x, y = a.alias("x"), b.alias("y")
    rows = x.join(y, "technical_name", "full_outer")
    both = lambda c: F.array_distinct(F.concat(F.coalesce(f"x.{c}", F.array().cast("array<string>")), F.coalesce(f"y.{c}", F.array().cast("array<string>"))))
    longer = F.when(F.length(F.coalesce("y.description", F.lit(""))) > F.length(F.coalesce("x.description", F.lit(""))), F.col("y.description")).otherwise(F.coalesce("x.description", "y.description"))
    rows = rows.select(F.col("x.id").alias("__id"), "technical_name", F.coalesce("x.display_name", "y.display_name").alias("display_name"), longer.alias("description"), both("keywords").alias("keywords"), both("examples").alias("examples"))
    top = a.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__top"))
    fresh = F.row_number().over(W.partitionBy(F.col("__id").isNull()).orderBy("technical_name"))  # a taxonomy has tens of rows
    return rows.crossJoin(F.broadcast(top)).select(F.coalesce(F.col("__id"), F.col("__top") + fresh).alias("id"), "technical_name", "display_name", "description", "keywords", "examples")


def range_lookup(df: DataFrame, value: str, ranges: DataFrame) -> DataFrame:
    """Rows of a small table (low, high, ...) whose range holds the value."""
    return df.join(dimension(ranges), (F.col(value) >= F.col("low")) & (F.col(value) <= F.col("high")))


def union_all(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
