"""Metrics of pipeline runs and their reports: costs, times, compliance, recommendations,
token use by phase and batch, data flow, integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import stats
from .cost import with_cost

# Orders of complexity and impact.
COMPLEXITIES, IMPACTS = ["easy", "moderate", "complex"], ["low", "medium", "high", "critical"]


def cost_metrics(runs: DataFrame, target: float = 0.20) -> DataFrame:
    """Of discovery_cost, application_cost, total_cost, tickets and categories: the cost for
    each category and 1,000 tickets, the overhead, and whether the target is met."""
    d, a, t = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("discovery_cost", "application_cost", "total_cost"))
    per_1k = F.when(F.col("tickets") > 0, t / F.col("tickets") * 1000).otherwise(0.0)
    return runs.withColumns(
        {"cost_per_category": F.when(F.col("categories") > 0, t / F.col("categories")).otherwise(0.0), "cost_per_1k": per_1k, "overhead": F.greatest(F.lit(0.0), t - d - a), "meets_cost_target": per_1k <= target}
    )


def performance_metrics(runs: DataFrame, target_minutes: float = 25.0) -> DataFrame:
    """Of total_time, discovery_time and application_time in seconds, and tickets: seconds for
    each ticket, tickets a second, the slower phase, and whether the target is met."""
    t, d, a = F.col("total_time"), F.col("discovery_time"), F.col("application_time")
    return runs.withColumns(
        {
            "seconds_per_ticket": F.when(F.col("tickets") > 0, t / F.col("tickets")).otherwise(0.0),
            "tickets_per_second": F.when(t > 0, F.col("tickets") / t).otherwise(0.0),
            "bottleneck": F.when(d > a, "discovery").when(a > d, "application").otherwise("balanced"),
            "meets_time_target": t <= target_minutes * 60,
        }
    )


def validate(runs: DataFrame, cost_target: float = 0.20, minutes_target: float = 25.0, confidence_target: float = 0.85) -> DataFrame:
    """A run's metrics (also confidence, coverage and consistency) with compliance, what to
    improve and what to do next."""
    out = performance_metrics(cost_metrics(runs, cost_target), minutes_target)
    out = out.withColumn("meets_accuracy_target", F.col("confidence") >= confidence_target)
    ok = F.col("meets_cost_target") & F.col("meets_time_target") & F.col("meets_accuracy_target")
    improve = F.array(
        F.when(~F.col("meets_cost_target"), "reduce batch sizes or optimise prompts"),
        F.when(~F.col("meets_cost_target") & (F.col("discovery_cost") > F.col("application_cost")), "reduce the sample or chunk sizes"),
        F.when(~F.col("meets_time_target"), F.concat(F.lit("more parallelism in "), F.col("bottleneck"))),
        F.when(~F.col("meets_accuracy_target"), "better definitions or more examples"),
        F.when(F.col("coverage") < 0.8, "consolidate unused categories"),
        F.when(F.col("consistency") < 0.8, "review the prompts"),
        F.when(F.col("tickets_per_second") < 1.0, "optimise batches"),
    )
    after = F.when(ok, F.array(F.lit("use in production"), F.lit("monitor"), F.lit("review from time to time"))).otherwise(
        F.array_compact(F.array(F.lit("optimise"), F.when(~F.col("meets_cost_target"), "analyse cost by phase"), F.when(~F.col("meets_time_target"), "profile the slower phase"), F.when(~F.col("meets_accuracy_target"), "review categories")))
    )
    return out.withColumns({"compliant": ok, "recommendations": F.array_compact(improve), "next_actions": F.concat(after, F.array(F.lit("compare with one-phase methods")))})


def ab_recommendation(metrics: DataFrame, method: str, a: object, b: object, significant: bool) -> DataFrame:
    """Of two rows of ab_metrics: which method to use."""
    pick = lambda g, c: F.max(F.when(F.col(method) == g, F.col(c)))
    one = metrics.agg((pick(a, "mean") > pick(b, "mean")).alias("c"), (pick(a, "rate") > pick(b, "rate")).alias("r"))
    text = F.when(F.lit(not significant), "no significant difference: either").when(F.col("c") & F.col("r"), "A").when(~F.col("c") & ~F.col("r"), "B")
    return one.select(text.otherwise(F.when(F.col("c"), "mixed: A for confidence, B for rate").otherwise("mixed: B for confidence, A for rate")).alias("recommendation"))


# --- recommendations


def _rank(column: str, order: list[str]):
    return F.array_position(F.array(*(F.lit(x) for x in order)), F.col(column))


def constrained(recs: DataFrame, max_complexity: str | None = None, min_savings: float | None = None, min_impact: str | None = None) -> DataFrame:
    """The recommendations (complexity, impact, saving, priority) within all limits, in the
    order of priority."""
    if max_complexity is not None:
        recs = recs.filter(_rank("complexity", COMPLEXITIES) <= COMPLEXITIES.index(max_complexity) + 1)
    if min_savings is not None:
        recs = recs.filter(F.col("saving") >= min_savings)
    if min_impact is not None:
        recs = recs.filter(_rank("impact", IMPACTS) >= IMPACTS.index(min_impact) + 1)
    return recs.orderBy(F.desc("priority"), "name")


def recommendation_counts(recs: DataFrame, by: tuple[str, ...] = ("category", "impact", "complexity")) -> DataFrame:
    """Rows for each value of each of the columns: kind, value, n and saving."""
    flat = recs.select("saving", F.explode(F.create_map(*(x for c in by for x in (F.lit(c), F.col(c))))).alias("kind", "value"))
    return flat.groupBy("kind", "value").agg(F.count("*").alias("n"), F.sum("saving").alias("saving"))


# --- tokens


def phase_report(usage: DataFrame, phase: str = "operation_type") -> DataFrame:
    """Tokens and cost of each phase, its share, cost for 1,000 tokens and tokens in for each out."""
    g = with_cost(usage).groupBy(F.col(phase).alias("phase")).agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost_usd").alias("cost_usd"), F.count("*").alias("calls"))
    tokens = F.col("input_tokens") + F.col("output_tokens")
    return g.withColumns({"cost_per_1k": F.round(F.col("cost_usd") / F.greatest(tokens, F.lit(1)) * 1000, 4), "input_output_ratio": F.round(F.col("input_tokens") / F.greatest(F.col("output_tokens"), F.lit(1)), 2)})


def batch_report(results: DataFrame, batch: str = "batch_id", rate_1k: float = 0.0003, high: float = 0.85) -> DataFrame:
    """Of results (category_ids, confidence, tokens_used, seconds): batches first, then all:
    tokens, time, mean success rate of the batches, cost and confidence."""
    done = (F.coalesce(F.col("category_ids"), F.lit("")) != "").cast("int")
    b = results.groupBy(batch).agg(
        F.count("*").alias("n"), F.sum("tokens_used").alias("tokens"), F.sum("seconds").alias("seconds"), F.avg(done).alias("rate"), F.sum("confidence").alias("confidence"), F.sum((F.col("confidence") >= high).cast("int")).alias("high")
    )
    one = b.agg(F.sum("n").alias("tickets"), F.sum("tokens").alias("tokens"), F.sum("seconds").alias("seconds"), F.avg("rate").alias("success_rate"), F.sum("confidence").alias("c"), F.sum("high").alias("h"), F.count("*").alias("batches"))
    cost_usd = F.col("tokens") / 1000 * rate_1k
    return one.select("tickets", "batches", "tokens", "seconds", "success_rate", cost_usd.alias("cost_usd"), F.try_divide(cost_usd, F.col("tickets")).alias("each"), (F.col("c") / F.col("tickets")).alias("mean_confidence"), (F.col("h") / F.col("tickets")).alias("high_share")).withColumn("cost_per_1k", F.col("each") * 1000).drop("each")


# --- reports on tables


def data_flow(categorised: DataFrame, final: DataFrame) -> DataFrame:
    """Rows of both tables, and the rows that the merge kept, in per cent."""
    out = categorised.agg(F.count("*").alias("categorised")).crossJoin(final.agg(F.count("*").alias("final")))  # single rows
    return out.withColumn("merge_rate", F.round(F.try_divide(F.col("final") * 100.0, F.col("categorised")), 2))


def summary_quality(df: DataFrame, column: str = "bullets") -> DataFrame:
    """Rows and the share with bullets, in per cent."""
    return df.agg(F.count("*").alias("summarised"), F.round(F.try_divide(F.count(column) * 100.0, F.count("*")), 2).alias("bullet_completion"))


def insights(df: DataFrame, columns: list[str], bullets: str = "bullets") -> DataFrame:
    """Coverage of the columns and of the bullets, as rows (metric, value)."""
    from ..sources.tables import metric_rows

    cover = stats.column_coverage(df, columns).select(F.concat(F.lit("coverage."), "column").alias("metric"), F.col("coverage").cast("string").alias("value"))
    b = metric_rows(stats.bullet_coverage(df, bullets)).select(F.concat(F.lit("bullets."), "metric").alias("metric"), "value")
    return cover.unionByName(b)


def integrity(categorised: DataFrame, final: DataFrame | None = None, column: str = "categoria", key: str = "ticket_id") -> DataFrame:
    """Rows without a category, and ids that both tables have. A missing column is an error."""
    missing = [c for c in (key, column) if c not in categorised.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    out = categorised.agg(F.count_if(F.col(column).isNull()).alias("empty_categories"))
    if final is None or key not in final.columns:
        return out.withColumn("common_ids", F.lit(0).cast("long"))
    return out.crossJoin(categorised.select(key).intersect(final.select(key)).agg(F.count("*").alias("common_ids")))  # single rows


def original_analysis(messages: DataFrame) -> DataFrame:
    """Rows, columns, lengths of texts, and messages of the category TEXT."""
    n = F.length("text")
    return messages.agg(
        F.count("*").alias("rows"), F.lit(len(messages.columns)).alias("columns"), F.round(F.avg(n), 2).alias("mean_length"), F.min(n).cast("long").alias("least_length"), F.max(n).cast("long").alias("most_length"),
        F.count_if(F.col("category") == "TEXT").alias("text_messages"), F.count_distinct("sender").alias("senders"),
    )


def category_analysis(df: DataFrame, column: str = "categoria") -> DataFrame:
    """Categories, diversity, the share of the five largest, and of the largest, in one row."""
    largest = stats.category_distribution(df, column).agg(F.count("*").alias("categories"), F.max("percent").alias("dominant_share"))
    return largest.crossJoin(stats.shannon_diversity(df, column)).crossJoin(stats.concentration(df, column))  # single rows


def phase_events(events: DataFrame) -> DataFrame:
    """Of start and end events (run_id, phase, event, seconds, cost): each phase's duration
    and cost; phases without an end have none."""
    g = events.groupBy("run_id", "phase").agg(F.min(F.when(F.col("event") == "start", F.col("seconds"))).alias("started"), F.max(F.when(F.col("event") == "end", F.col("seconds"))).alias("ended"), F.sum("cost").alias("cost"))
    return g.withColumn("duration", F.col("ended") - F.col("started"))
