"""Statistics of categories, classifications and experiments."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.numbers import effect_label
from .quantiles import quantiles, with_medians


def split_ids(c: Column) -> Column:
    """Distinct trimmed values of a comma-separated text."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != ""))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def frequencies(df: DataFrame, column: str) -> DataFrame:
    """Counts and shares of each value; the window is over one row a value."""
    return value_counts(df, column).withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))


def category_distribution(df: DataFrame, column: str = "categoria") -> DataFrame:
    """Rows and per cent of all rows of each category, and its rank (ties by name)."""
    out = frequencies(df, column)
    rank = F.row_number().over(W.orderBy(F.desc("n"), column))
    return out.select(column, "n", F.round(F.col("share") * 100, 2).alias("percent"), rank.alias("rank"))


def category_summary(df: DataFrame, column: str = "categoria") -> DataFrame:
    """Of the category counts: extremes with their names, mean, median, deviation."""
    c = value_counts(df, column)
    return c.agg(
        F.count("*").alias("n_categories"),
        F.max_by(column, F.struct(F.col("n"), _negated(column))).alias("most_common"),
        F.min_by(column, F.struct(F.col("n"), F.col(column))).alias("least_common"),
        F.round(F.avg("n"), 2).alias("mean"),
        F.floor(F.median("n")).cast("long").alias("median"),
        F.stddev_samp("n").alias("std"),
        F.min("n").alias("least"),
        F.max("n").alias("most"),
    )


def _negated(column: str) -> Column:
    """Orders texts downwards inside a struct, so that the least name wins a tie."""
    return F.transform(F.split(column, ""), lambda ch: -F.ascii(ch))


def shannon_diversity(df: DataFrame, column: str = "categoria") -> DataFrame:
    """Normalised entropy of the shares: 0 for one category."""
    p = F.col("share")
    return frequencies(df, column).agg(
        F.when(F.count("*") > 1, -F.sum(p * F.ln(p + 1e-10)) / F.ln(F.count("*"))).otherwise(0.0).alias("diversity")
    )


def concentration(df: DataFrame, column: str = "categoria", k: int = 5) -> DataFrame:
    """Per cent of rows in the k largest categories."""
    ranked = value_counts(df, column).withColumn("r", F.row_number().over(W.orderBy(F.desc("n"), column)))
    return ranked.agg((F.sum(F.when(F.col("r") <= k, F.col("n"))) * 100.0 / F.sum("n")).alias("concentration"))


def size_histogram(df: DataFrame, column: str) -> DataFrame:
    """Categories of one row, of 2-5, 6-20, 21-100 and more."""
    n = F.col("n")
    return value_counts(df, column).agg(
        F.count_if(n == 1).alias("one"),
        F.count_if(n.between(2, 5)).alias("to_5"),
        F.count_if(n.between(6, 20)).alias("to_20"),
        F.count_if(n.between(21, 100)).alias("to_100"),
        F.count_if(n > 100).alias("more"),
        F.avg("n").alias("mean"),
        F.median("n").alias("median"),
        F.stddev_samp("n").alias("std"),
    )


def threshold_counts(df: DataFrame, column: str, thresholds: tuple[int, ...] = (1, 5, 10, 20)) -> DataFrame:
    """Categories with at least so many rows; for 1, with just one."""
    n = F.col("n")
    return value_counts(df, column).agg(*(F.count_if(n == 1 if t == 1 else n >= t).alias(f"at_{t}") for t in thresholds))


def naming_quality(df: DataFrame, column: str) -> DataFrame:
    """Valid and empty values, completeness, and lengths of the distinct names."""
    name = F.col(column)
    valid = name.isNotNull() & (F.trim(name) != "")
    per = df.groupBy(column).agg(F.count("*").alias("n"))
    return per.agg(
        F.sum(F.when(valid, F.col("n")).otherwise(0)).alias("valid"),
        F.sum(F.when(valid, 0).otherwise(F.col("n"))).alias("empty"),
        F.round(F.sum(F.when(valid, F.col("n")).otherwise(0)) * 100.0 / F.sum("n"), 2).alias("completeness"),
        F.round(F.avg(F.when(valid, F.length(name))), 1).alias("mean_length"),
        F.min(F.when(valid, F.length(name).cast("long"))).alias("least_length"),
        F.max(F.when(valid, F.length(name).cast("long"))).alias("most_length"),
    )


def column_coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per cent of rows that aren't null, a row for each column."""
    one = df.agg(*(F.round(F.count(c) * 100.0 / F.count("*"), 2).alias(c) for c in columns))
    return one.unpivot([], columns, "column", "coverage")


def first_rows(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The first n rows of each group; Spark keeps n rows a group before the shuffle."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(order))).filter(F.col("rank") <= n)


def top_categories(df: DataFrame, column: str, id_col: str, k: int = 10, ids: int = 3) -> DataFrame:
    """The k largest categories with share and the first ids of each."""
    top = category_distribution(df, column).filter(F.col("rank") <= k)
    sample = first_rows(df.select(column, id_col), column, id_col, ids)
    sample = sample.groupBy(column).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(id_col).cast("string").alias("i")))), lambda x: x["i"]), ", ").alias("sample_ids"))
    return top.join(sample, column, "left").select("rank", column, "n", "percent", "sample_ids")


def in_top(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The rows of the k largest categories."""
    return df.join(category_distribution(df, column).filter(F.col("rank") <= k).select(column), column, "left_semi")


def cross_analysis(categorised: DataFrame, original: DataFrame, key: str) -> DataFrame:
    """Rows and ids of both tables, ids in both, and what share was processed."""
    ids = categorised.select(key).distinct().withColumn("a", F.lit(1)).join(original.select(key).distinct().withColumn("b", F.lit(1)), key, "full_outer")
    both = ids.agg(F.count("a").alias("ids_categorised"), F.count("b").alias("ids_original"), F.count(F.col("a") + F.col("b")).alias("ids_both"))
    n, m = categorised.agg(F.count("*").alias("rows_categorised")), original.agg(F.count("*").alias("rows_original"))
    out = both.crossJoin(n).crossJoin(m)  # single rows
    return out.withColumn("processed", F.round(F.try_divide(F.col("rows_categorised") * 100.0, F.col("rows_original")), 2)).withColumn("filtered_out", F.col("rows_original") - F.col("rows_categorised"))


def multilabel_accuracy(pred: DataFrame, truth: DataFrame, key: str, column: str) -> DataFrame:
    """Exact and partial match, macro precision and recall, and F1 of these two."""
    both = pred.select(key, split_ids(F.col(column)).alias("p")).join(truth.select(key, split_ids(F.col(column)).alias("t")), key)
    common = F.size(F.array_intersect("p", "t"))
    part = lambda n: F.when(F.size(n) > 0, common / F.size(n)).otherwise(0.0)
    out = both.agg(
        F.count("*").alias("n"),
        F.avg((F.array_sort("p") == F.array_sort("t")).cast("int")).alias("exact"),
        F.avg((common > 0).cast("int")).alias("overlap"),
        F.avg(part("p")).alias("precision"),
        F.avg(part("t")).alias("recall"),
    )
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


def classification_stats(df: DataFrame, high: float = 0.85) -> DataFrame:
    """Of rows with category_ids and confidence: classified, rates and confidences."""
    done = F.coalesce(F.col("category_ids"), F.lit("")) != ""
    one = df.agg(
        F.count("*").alias("total"),
        F.count_if(done).alias("classified"),
        (F.count_if(done) / F.count("*")).alias("rate"),
        F.avg("confidence").alias("mean_confidence"),
        F.count_if(F.col("confidence") >= high).alias("high_confidence"),
    )
    return with_medians(one, df, {"median_confidence": F.col("confidence")})


def id_distribution(df: DataFrame) -> DataFrame:
    """Rows for each single id of category_ids."""
    return df.select(F.explode(split_ids(F.col("category_ids"))).alias("category_id")).groupBy("category_id").agg(F.count("*").alias("n"))


def accuracy_metrics(df: DataFrame, n_categories: int, high: float = 0.85) -> DataFrame:
    """High-confidence share, coverage of the categories, and consistency of confidence."""
    used = df.select(F.explode(split_ids(F.col("category_ids"))).alias("i")).agg(F.count_distinct("i").alias("used"))
    out = df.agg(
        F.avg((F.col("confidence") >= high).cast("int")).alias("high_share"),
        F.greatest(F.lit(0.0), 1 - F.try_divide(F.stddev_samp("confidence"), F.avg("confidence"))).alias("consistency"),
    )
    return out.crossJoin(used).select("high_share", (F.col("used") / float(n_categories)).alias("coverage"), "consistency")


def ab_metrics(df: DataFrame, method: str, high: float = 0.85) -> DataFrame:
    done = F.coalesce(F.col("category_ids"), F.lit("")) != ""
    rows = df.groupBy(method).agg(
        F.count("*").alias("n"),
        F.avg("confidence").alias("mean"),
        F.stddev_samp("confidence").alias("std"),
        F.avg((F.col("confidence") >= high).cast("int")).alias("high_share"),
        F.avg(done.cast("int")).alias("rate"),
        F.count_distinct("category_ids").alias("n_ids"),
    )
    medians = quantiles(df, "confidence", {"median": 0.5}, by=(method,)).withColumnRenamed(method, "__m")
    return rows.join(medians, F.col(method).eqNullSafe(F.col("__m")), "left").drop("__m")


def pooled_t_test(df: DataFrame, group: str, value: str, a: object, b: object) -> DataFrame:
    """Pooled two-sample t, degrees of freedom, its two-sided p, Cohen's d and its label, in one row."""
    s = lambda g: (F.count(F.when(F.col(group) == g, F.col(value))), F.avg(F.when(F.col(group) == g, F.col(value))), F.var_samp(F.when(F.col(group) == g, F.col(value))))
    (n1, m1, v1), (n2, m2, v2) = s(a), s(b)
    out = df.agg(n1.alias("n1"), m1.alias("m1"), v1.alias("v1"), n2.alias("n2"), m2.alias("m2"), v2.alias("v2"))
    pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / (F.col("n1") + F.col("n2") - 2)
    out = out.withColumn("diff", F.col("m1") - F.col("m2")).withColumn("pooled", pooled).withColumn("df", F.col("n1") + F.col("n2") - 2)
    out = out.withColumn("t", F.try_divide(F.col("diff"), F.sqrt(F.col("pooled") * (1 / F.col("n1") + 1 / F.col("n2"))))).withColumn("d", F.try_divide(F.col("diff"), F.sqrt("pooled")))
    p_of = F.pandas_udf(lambda t, df: pd.Series([None if pd.isna(a) or not b > 0 else t_p_value(a, b) for a, b in zip(t, df)], dtype="float64"), "double")  # of one row
    return out.select("n1", "n2", "df", "t", "d", effect_label(F.col("d")).alias("effect"), p_of("t", F.col("df").cast("double")).alias("p"))


def t_p_value(t: float, df: float) -> float:
    """Two-sided p of Student's t, by the continued fraction of the incomplete beta."""
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x >= 1:
        return 1.0
    flip = x > (a + 1) / (a + b + 2)
    if flip:
        x, a, b = 1 - x, b, a
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-30)
    h = d
    for m in range(1, 300):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / ((1 + k * d) or 1e-30), (1 + k / c) or 1e-30
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    return 1 - front * h if flip else front * h


def baseline_comparison(runs: DataFrame, lower_is_better: tuple[str, ...] = ("cost", "minutes"), higher_is_better: tuple[str, ...] = ("confidence",)) -> DataFrame:
    """Of rows name, cost, minutes, confidence: a row for each metric with the change from
    `baseline` to each other run; an equal value counts as a regression."""
    metrics = [*lower_is_better, *higher_is_better]
    flat = runs.unpivot(["name"], metrics, "metric", "value")
    base = flat.filter("name = 'baseline'").select("metric", F.col("value").alias("base"))
    better = F.when(F.col("metric").isin(list(higher_is_better)), F.col("value") > F.col("base")).otherwise(F.col("value") < F.col("base"))
    return flat.filter("name <> 'baseline'").join(base, "metric").select("name", "metric", "base", "value", (F.col("value") - F.col("base")).alias("delta"), better.alias("improved"))


def bullet_coverage(df: DataFrame, column: str = "bullets") -> DataFrame:
    """Tickets with bullets, statistics of their numbers, and texts that don't parse."""
    n = F.json_array_length(column)
    has = F.col(column).isNotNull() & (F.trim(column) != "")
    return df.agg(F.count_if(has).alias("with_bullets"), F.round(F.avg(n), 1).alias("mean"), F.min(n).alias("least"), F.max(n).alias("most"), F.count_if(has & n.isNull()).alias("errors"))


def taxonomy_stats(categories: DataFrame) -> DataFrame:
    """Of rows with keywords, examples and subcategories: counts, means and complexity."""
    subs = F.coalesce(F.size("subcategories"), F.lit(0))
    return categories.agg(
        F.count("*").alias("categories"),
        F.sum(subs).alias("subcategories"),
        F.round(F.avg(F.size("keywords")), 1).alias("mean_keywords"),
        F.round(F.avg(F.size("examples")), 1).alias("mean_examples"),
        F.count_if(subs <= 0).alias("simple"),
        F.count_if(subs.between(1, 2)).alias("medium"),
        F.count_if(subs > 2).alias("complex"),
    )


def run_metrics(runs: DataFrame, cost_target: float = 0.20, minutes_target: float = 25.0, confidence_target: float = 0.85) -> DataFrame:
    """Compliance of runs (cost_per_1k, minutes, confidence) with their targets."""
    ok = (F.col("cost_per_1k") <= cost_target, F.col("minutes") <= minutes_target, F.col("confidence") >= confidence_target)
    out = runs.withColumns({"cost_ok": ok[0], "minutes_ok": ok[1], "confidence_ok": ok[2]})
    return out.withColumn("compliant", F.col("cost_ok") & F.col("minutes_ok") & F.col("confidence_ok"))
