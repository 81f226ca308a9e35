"""`python -m convoy.cli`: the jobs from a command line.

    categorize | summarize | merge | analyze | all    over a message file
    discover | classify                                a taxonomy from a message file, and with one
    cost breakdown | trends | sessions | project       over a usage table
    cache status | cleanup | clear                     over a result table
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import cache, cost, joins, prepare
from .plans import jobs
from .functions.text import KEYWORD_RULES
from .sources import reports, tables


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="convoy")
    sub = p.add_subparsers(dest="command", required=True)
    for mode in ("categorize", "summarize", "merge", "analyze", "all"):
        c = sub.add_parser(mode)
        c.add_argument("--input-file")
        c.add_argument("--output", required=True)
        c.add_argument("--nrows", type=int)
        c.add_argument("--no-export", action="store_true")
    for mode in ("discover", "classify"):
        c = sub.add_parser(mode)
        c.add_argument("--input-file", required=True)
        c.add_argument("--output", required=True)
        c.add_argument("--taxonomy", required=mode == "classify")
        c.add_argument("--nrows", type=int)
    c = sub.add_parser("cost")
    c.add_argument("what", choices=["breakdown", "trends", "sessions", "project"])
    c.add_argument("--usage")
    c.add_argument("--hours", type=float, default=24)
    c.add_argument("--session-key", default="session_id")
    c.add_argument("--sizes", type=int, nargs="*", default=[1000, 10000, 100000])
    c = sub.add_parser("cache")
    c.add_argument("what", choices=["status", "cleanup", "clear"])
    c.add_argument("--table", required=True)
    c.add_argument("--max-age-hours", type=float, default=72)
    return p


def _tickets(spark: SparkSession, args) -> DataFrame:
    m = tables.numbered(tables.read_messages(spark, args.input_file, limit=args.nrows))
    if "ticket_created_at" not in m.columns:
        m = m.withColumn("ticket_created_at", F.lit(None).cast("string"))
    return prepare.prepare_tickets(m)


def run(spark: SparkSession, argv: list[str]) -> DataFrame | None:
    """Run a command; returns its table, if it has one to show."""
    args = _parser().parse_args(argv)
    if args.command == "cost":
        if args.what == "project":
            return cost.compare(cost.project(cost.scenario_grid(spark, args.sizes, list(cost.OPTION_FACTORS), [1, 4, 8, 16])))
        usage = spark.read.parquet(args.usage)
        return {"breakdown": lambda: cost.operation_breakdown(usage), "trends": lambda: cost.cost_trend(usage, args.hours), "sessions": lambda: cost.sessions(usage, args.session_key)}[args.what]()
    if args.command == "cache":
        tables.restore_table(spark, args.table.rstrip("/"))
        stored = spark.read.parquet(args.table)
        if args.what == "status":
            return stored.agg(F.count("*").alias("entries"), F.count_distinct("key").alias("keys"))
        kept = cache.live(stored, F.current_timestamp(), args.max_age_hours) if args.what == "cleanup" else stored.limit(0)
        tables.replace_table(kept, args.table.rstrip("/"))
        return spark.read.parquet(args.table)
    out = args.output.rstrip("/")
    if args.command == "discover":
        reports.write_taxonomy(jobs.discover(_tickets(spark, args)), out)
        return reports.read_taxonomy(spark, out, jobs.TAXONOMY)
    if args.command == "classify":
        return jobs.classify_file(spark, args.taxonomy, args.input_file, out)
    names = {i + 1: n for i, (n, _) in enumerate(KEYWORD_RULES)}
    if args.command in ("categorize", "all"):
        jobs.categorise(_tickets(spark, args), names).write.mode("overwrite").parquet(f"{out}/categorized")
        reports.write_categorised(spark.read.parquet(f"{out}/categorized"), f"{out}/categorized_tickets.csv")
    if args.command in ("summarize", "all"):
        jobs.summarise(_tickets(spark, args)).write.mode("overwrite").parquet(f"{out}/summarized")
        reports.write_summary(spark.read.parquet(f"{out}/summarized"), f"{out}/summary")
    if args.command in ("merge", "all"):
        joins.merge_results(spark.read.parquet(f"{out}/categorized"), spark.read.parquet(f"{out}/summarized")).write.mode("overwrite").parquet(f"{out}/final")
        reports.write_merged(spark.read.parquet(f"{out}/final"), f"{out}/final_tickets.csv")
    if args.command in ("analyze", "all") and not args.no_export:
        jobs.report(spark, spark.read.parquet(f"{out}/categorized"), f"{out}/reports")
    return spark.read.parquet(f"{out}/categorized") if args.command != "summarize" else spark.read.parquet(f"{out}/summarized")


def main() -> None:
    import sys

    spark = SparkSession.builder.appName("convoy").getOrCreate()
    shown = run(spark, sys.argv[1:])
    if shown is not None:
        shown.show(50, truncate=False)


if __name__ == "__main__":
    main()
