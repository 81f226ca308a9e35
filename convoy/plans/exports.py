"""What a run hands over: cost, alert, cache, recommendation, validation and quality reports
as files of small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import format_cost
from ..operators import alerts, cache, cost, prepare, roi, runs, stats
from ..sources import reports, tables


def cost_report(usage: DataFrame, session_key: str, path: str) -> None:
    """One CSV with the sections SUMMARY, SESSIONS and OPERATIONS."""
    sessions = cost.sessions(usage, session_key)
    summary = tables.metric_rows(sessions.agg(F.count("*").alias("sessions"), F.sum("tokens").alias("tokens"), F.sum("cost_usd").alias("cost_usd"), F.avg("cost_per_item").alias("cost_per_item")))
    reports.sections_csv({"SUMMARY": summary, "SESSIONS": sessions, "OPERATIONS": cost.operation_breakdown(usage)}, path)


def alert_report(found: DataFrame, path: str) -> None:
    """Counts by type and level, the open alerts, and the last ones."""
    parts = {"statistics": alerts.statistics(found), "open": found.filter("not acknowledged"), "last": alerts.keep_last(found, 100)}
    reports.write_json_report(found.sparkSession, parts, path)


def recommendation_report(recs: DataFrame, path: str) -> None:
    """Recommendations by priority, with totals and counts by category, impact and complexity."""
    totals = recs.agg(F.count("*").alias("recommendations"), F.sum("saving").alias("saving"))
    reports.write_json_report(recs.sparkSession, {"totals": totals, "counts": runs.recommendation_counts(recs), "recommendations": recs.orderBy(F.desc("priority"), "name")}, path)


def cache_metrics(snapshots: DataFrame, path: str) -> None:
    """The snapshots as CSV, in the order of time."""
    tables.write_csv(snapshots, path, sep=",", order=["ts"], one_file=True)


def cache_report(snapshots: DataFrame, path: str, hours: int = 24) -> None:
    """Series of the last hours, alerts, recommendations of the latest snapshot."""
    newest = snapshots.agg(F.max("ts").alias("newest"))  # a single row
    rows = snapshots.crossJoin(F.broadcast(newest))
    latest = rows.filter("ts = newest").select(*snapshots.columns)
    parts = {
        "performance": cache.performance_report(rows, F.col("newest") - F.expr(f"interval {hours} hours")),
        "alerts": cache.alerts(snapshots).groupBy("alert").agg(F.count("*").alias("n")),
        "recommendations": cache.cache_recommendations(latest).select("recommendation"),
    }
    reports.write_json_report(snapshots.sparkSession, parts, path)


def run_metrics(measured: DataFrame, path: str) -> None:
    """A run's metrics as texts: costs in words, rates in per cent, minutes."""
    out = runs.performance_metrics(runs.cost_metrics(measured))
    shown = out.select(
        F.col("tickets").cast("string").alias("tickets"), format_cost(F.col("total_cost")).alias("total_cost"), F.format_string("%.4f", F.col("cost_per_1k").cast("double")).alias("cost_per_1k"),
        F.format_string("%.1f min", F.col("total_time") / 60).alias("time"), F.format_string("%.1f%%", F.col("confidence") * 100).alias("confidence"), "bottleneck",
    )
    reports.write_json_report(measured.sparkSession, {"metrics": shown}, path)


def validation_report(measured: DataFrame, path: str) -> None:
    """Metrics, compliance, recommendations and next actions of runs."""
    reports.write_json_report(measured.sparkSession, {"validation": runs.validate(measured)}, path)


def quality_report(tickets: DataFrame, path: str) -> None:
    """Completeness, lengths and dates of tickets."""
    parts = {"assessment": prepare.quality_assessment(tickets), "lengths": prepare.length_stats(tickets)}
    if "ticket_created_at" in tickets.columns:
        parts["dates"] = prepare.date_range(tickets)
    reports.write_json_report(tickets.sparkSession, parts, path)


def scaling_report(spark: SparkSession, size: int, path: str, budget: float | None = None, hours: float | None = None) -> None:
    """The comprehensive analysis of a dataset size."""
    reports.write_json_report(spark, roi.comprehensive(spark, size, budget, hours), path)


def dashboard(usage: DataFrame, session_key: str, path: str, sizes: list[int] | None = None, kind: str = "comprehensive") -> None:
    """The overview as JSON and CSV: `summary` has totals, breakdown and shares;
    `comprehensive` also sessions and the comparison of dataset sizes."""
    spark = usage.sparkSession
    parts = {"totals": cost.cost_trend(usage, 24), "operations": cost.operation_breakdown(usage), "shares": cost.operation_shares(usage)}
    if kind == "comprehensive":
        grid = cost.project(cost.scenario_grid(spark, sizes or [1000, 10000, 50000, 100000, 500000], list(cost.OPTION_FACTORS), [4]))
        parts |= {"sessions": cost.sessions(usage, session_key), "comparison": cost.compare(grid), "trends": roi.size_comparison(grid), "recommendations": roi.comparison_recommendations(grid)}
    reports.write_json_report(spark, parts, f"{path}/json")
    reports.sections_csv(parts, f"{path}/csv")


def analysis_tables(categorised: DataFrame, original: DataFrame, final: DataFrame | None = None, summarised: DataFrame | None = None, key: str = "ticket_id") -> dict[str, DataFrame]:
    """All tables of an analysis: those of the report, of the original data, and of both."""
    from .jobs import report_tables

    out = report_tables(categorised, key=key, final=final, summarised=summarised)
    out["original"] = runs.original_analysis(original)
    out["cross"] = stats.cross_analysis(categorised, original, key)
    out["coverage"] = stats.column_coverage(categorised, categorised.columns)
    return out
