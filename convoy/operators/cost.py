"""Usage, cost projections and returns on investment.

Usage rows have ts, operation_type, input_tokens and output_tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.numbers import PRICING, token_cost
from .ordered import over_rows, running_sum
from .quantiles import with_medians

# Factors and prices of the planning model, in USD.
OPTION_FACTORS = {"discovery_only": 0.6, "application_only": 0.8, "parallel_discovery": 0.7, "optimized_application": 0.85, "discovery_application": 1.0}
COST_PER_TICKET, MODEL_INPUT_1K, MODEL_OUTPUT_1K = 0.048, 0.075 / 1000, 0.30 / 1000
WORKER_HOUR = {"local": 0.001, "cloud": 0.05}
STORAGE_GB_MONTH, BANDWIDTH_GB, OVERHEAD, CLOUD_COMPUTE_HOUR = 0.023, 0.09, 0.10, 0.02
WORKER_CHOICES = [2, 4, 8, 16, 32, 64]


def with_cost(usage: DataFrame, pricing: dict[str, float] = PRICING) -> DataFrame:
    i, o = F.col("input_tokens"), F.col("output_tokens")
    return usage.withColumn("total_tokens", i + o).withColumn("cost_usd", token_cost(i, o, pricing))


def operation_breakdown(usage: DataFrame) -> DataFrame:
    """Count, tokens and cost of each kind of operation."""
    return with_cost(usage).groupBy("operation_type").agg(
        F.count("*").alias("n"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.sum("cost_usd").alias("cost_usd"), F.avg("total_tokens").alias("mean_tokens"), F.avg("cost_usd").alias("mean_cost"),
    )


def hourly_cost(usage: DataFrame) -> DataFrame:
    return with_cost(usage).groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"), F.sum("total_tokens").alias("tokens"), F.sum("cost_usd").alias("cost_usd"))


def cost_trend(usage: DataFrame, hours: float) -> DataFrame:
    """Totals, means for each hour of the period, and daily and weekly projections."""
    t = with_cost(usage).agg(F.sum("cost_usd").alias("cost"), F.sum("total_tokens").alias("tokens"), F.count("*").alias("n"))
    return t.withColumns({"cost_per_hour": F.col("cost") / hours, "tokens_per_hour": F.col("tokens") / hours, "daily": F.col("cost") / hours * 24, "weekly": F.col("cost") / hours * 168})


def sessions(usage: DataFrame, key: str) -> DataFrame:
    """One row a session: times, totals, cost for each item and tokens a second."""
    g = with_cost(usage).groupBy(key).agg(
        F.min("ts").alias("start_time"), F.max("ts").alias("end_time"), F.count("*").alias("operations"),
        F.sum("total_tokens").alias("tokens"), F.sum("cost_usd").alias("cost_usd"),
    )
    seconds = (F.unix_timestamp(F.col("end_time").cast("timestamp")) - F.unix_timestamp(F.col("start_time").cast("timestamp"))).cast("double")
    return g.withColumn("seconds", seconds).withColumn("cost_per_item", F.col("cost_usd") / F.col("operations")).withColumn("tokens_per_second", F.when(seconds > 0, F.col("tokens") / seconds))


def efficiency_metrics(s: DataFrame) -> DataFrame:
    return s.agg(F.avg("cost_per_item").alias("mean"), F.min("cost_per_item").alias("least"), F.max("cost_per_item").alias("most"), F.avg("tokens_per_second").alias("throughput"), F.try_divide(F.lit(1000.0), F.avg("cost_per_item")).alias("score"))


def record_operation(spark: SparkSession, path: str, operation: str, tokens_in: int, tokens_out: int, phase: str = "") -> None:
    """Append one operation to the usage log."""
    row = spark.range(1).select(F.current_timestamp().alias("ts"), F.lit(operation).alias("operation_type"), F.lit(phase).alias("phase"), F.lit(tokens_in).cast("long").alias("input_tokens"), F.lit(tokens_out).cast("long").alias("output_tokens"))
    row.write.mode("append").parquet(path)


def total_spent(sessions: DataFrame) -> DataFrame:
    return sessions.agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("spent"))


def since(df: DataFrame, seconds_col: str, now: Column, hours: float) -> DataFrame:
    """The rows of the last hours."""
    return df.filter(F.col(seconds_col) >= now - hours * 3600)


def session_events(events: DataFrame, order: str) -> DataFrame:
    """Sessions of start and end events (session_id, event, seconds): a start closes the
    session that is still open, at its own time."""
    starts = over_rows(events.filter("event = 'start'"), ["seconds", order], lambda w: {"next": F.lead("seconds").over(w)}, after=1)
    ends = events.filter("event = 'end'").groupBy(F.col("session_id").alias("s")).agg(F.min("seconds").alias("ended"))
    out = starts.join(ends, F.col("session_id") == F.col("s"), "left")
    end = F.least(F.coalesce("ended", "next"), F.coalesce("next", "ended"))
    return out.select("session_id", F.col("seconds").alias("start"), end.alias("end"), (F.col("next").isNotNull() & (F.col("ended").isNull() | (F.col("next") < F.col("ended")))).alias("auto_closed"))


def efficiency_patterns(sessions: DataFrame, order: str) -> DataFrame:
    """Of sessions (dataset_size, total_cost_usd, tokens, seconds): cost for each item (mean,
    median, trend of the halves, consistency), tokens for each item and second, and a score."""
    from ..functions.numbers import efficiency_score
    from .trend import half_split_trend

    rows = sessions.withColumns(
        {"c": F.when(F.col("dataset_size") > 0, F.col("total_cost_usd") / F.col("dataset_size")), "t": F.when(F.col("dataset_size") > 0, F.col("tokens") / F.col("dataset_size")), "r": F.when(F.col("seconds") > 0, F.col("tokens") / F.col("seconds"))}
    )
    one = rows.agg(F.avg("c").alias("mean_cost"), F.stddev_samp("c").alias("std"), F.avg("t").alias("tokens_per_item"), F.coalesce(F.avg("r"), F.lit(0.0)).alias("tokens_per_second"))
    trend = half_split_trend(rows.filter("c is not null").select(order, "c"), "c", order).select("trend")
    out = with_medians(one, rows, {"median_cost": F.col("c")}).crossJoin(trend)  # single rows
    steady = F.when(F.col("mean_cost") > 0, 1 - F.col("std") / F.col("mean_cost")).otherwise(0.0)
    return out.select("mean_cost", "median_cost", "trend", "tokens_per_item", "tokens_per_second", efficiency_score(F.col("mean_cost"), F.col("tokens_per_second")).alias("score"), F.coalesce(steady, F.lit(0.0)).alias("consistency"))


def temporal_patterns(s: DataFrame) -> DataFrame:
    v = F.col("seconds")
    rows = s.filter("seconds > 0")
    consistency = F.greatest(F.lit(0.0), 1 - F.try_divide(F.stddev_samp(v), F.avg(v)))
    one = rows.agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.var_samp(v).alias("variance"), consistency.alias("consistency"))
    return with_medians(one, rows, {"median": v}).select("n", "mean", "median", "variance", "consistency")


def operation_shares(usage: DataFrame) -> DataFrame:
    """Cost of each kind of operation, its share, and the running share, dearest first."""
    b = operation_breakdown(usage).select("operation_type", "n", "cost_usd", F.try_divide("cost_usd", F.col("n")).alias("cost_per_operation"))
    w = W.orderBy(F.desc("cost_usd"), "operation_type")  # a row for each kind
    total = F.sum("cost_usd").over(W.partitionBy())
    return b.withColumn("share", F.col("cost_usd") / total).withColumn("running_share", F.sum("cost_usd").over(w.rowsBetween(W.unboundedPreceding, 0)) / total)


def budget_crossings(usage: DataFrame, budget: float, order: str, group: str | None = None, thresholds: tuple[float, ...] = (0.5, 0.75, 0.9, 0.95)) -> DataFrame:
    """When the cumulative cost first reaches each threshold: once for each."""
    if group:
        w = W.partitionBy(group).orderBy("ts", order).rowsBetween(W.unboundedPreceding, 0)
        run = with_cost(usage).withColumn("running", F.sum("cost_usd").over(w))
    else:
        run = running_sum(with_cost(usage), "cost_usd", "ts", order)
    levels = F.explode(F.array(*(F.lit(t) for t in thresholds))).alias("threshold")
    keys = [group] if group else []
    hit = run.select(*keys, "ts", order, "running", levels).filter(F.col("running") >= F.col("threshold") * budget)
    return hit.groupBy(*keys, "threshold").agg(F.min(F.struct("ts", order, "running")).alias("f")).select(*keys, "threshold", F.col("f.ts").alias("ts"), F.col(f"f.{order}").alias(order), F.col("f.running").alias("running"))


def calibration(history: DataFrame) -> DataFrame:
    """Median cost and tokens for each item of earlier sessions, their deviation, and how many."""
    h = history.filter("dataset_size > 0").select((F.col("total_cost_usd") / F.col("dataset_size")).alias("c"), (F.col("total_tokens") / F.col("dataset_size")).alias("t"))
    one = h.agg(F.stddev_samp("c").alias("std"), F.count("*").alias("n"))
    return with_medians(one, h, {"cost_per_item": F.col("c"), "tokens_per_item": F.col("t")}).select("cost_per_item", "tokens_per_item", "std", "n")


# --- scenarios


def _case(c: Column, bounds: list[tuple[float, float]], other: float, inclusive: bool = True) -> Column:
    out = None
    for limit, value in bounds:
        cond = c <= limit if inclusive else c < limit
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(other)


def option_factor(c: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for p in OPTION_FACTORS.items() for x in p))[c], F.lit(1.0))


def scale_factor(n: Column) -> Column:
    return _case(n, [(1000, 1.1), (10000, 1.0), (50000, 0.95), (100000, 0.92)], 0.90)


def chunk_factor(m: Column) -> Column:
    return F.when(m < 0.5, 1.2).when(m <= 1.0, 1.0).when(m <= 2.0, 0.95).otherwise(1.05)


def parallel_factor(w: Column) -> Column:
    return _case(w, [(1, 1.0), (4, 0.95), (8, 0.98)], 1.05)


def processing_hours(n: Column, workers: Column, efficiency: Column) -> Column:
    lanes = F.when(workers > 1, F.least(workers * 0.8, workers.cast("double"))).otherwise(1.0)
    return n / (1000 * efficiency * lanes / 4)


def scenarios_of(sizes: DataFrame, options: list[str], workers: list[int]) -> DataFrame:
    """Each size of a table (dataset_size) with all combinations of a few options and workers."""
    rows = sizes.select("dataset_size", F.explode(F.array(*map(F.lit, options))).alias("option"))
    return rows.select("dataset_size", "option", F.explode(F.array(*(F.lit(w).cast("int") for w in workers))).alias("workers"))


def scenario_grid(spark: SparkSession, sizes: list[int], options: list[str], workers: list[int]) -> DataFrame:
    """All combinations of a few sizes, options and workers."""
    return scenarios_of(spark.range(1).select(F.explode(F.array(*(F.lit(n).cast("long") for n in sizes))).alias("dataset_size")), options, workers)


def project(grid: DataFrame, cost_per_ticket: float = COST_PER_TICKET, chunk: float = 1.0) -> DataFrame:
    """Cost, time and an interval for each scenario."""
    n, w = F.col("dataset_size"), F.col("workers")
    each = F.lit(cost_per_ticket) * option_factor(F.col("option")) * scale_factor(n) * chunk_factor(F.lit(chunk)) * parallel_factor(w)
    spread = _case(n, [(1000, 0.3), (10000, 0.2)], 0.15, inclusive=False)
    out = grid.withColumn("cost_per_ticket", each).withColumn("cost", each * n).withColumn("hours", processing_hours(n, w, option_factor(F.col("option"))))
    return out.withColumn("low", F.col("cost") * (1 - spread)).withColumn("high", F.col("cost") * (1 + spread))


def compare(projected: DataFrame) -> DataFrame:
    """Best and worst option of each size, mean, range and savings."""
    g = projected.groupBy("dataset_size").agg(
        F.min_by("option", F.struct("cost", "option", "workers")).alias("best"), F.max_by("option", F.struct("cost", "option", "workers")).alias("worst"),
        F.min("cost").alias("least"), F.max("cost").alias("most"), F.avg("cost").alias("mean"),
    )
    return g.withColumn("savings", F.col("most") - F.col("least")).withColumn("savings_percent", F.try_divide(F.col("most") - F.col("least"), F.col("most")) * 100)


def risks(n: Column, workers: Column, cost: Column) -> Column:
    rules = [(n > 50000, "large dataset"), (workers > 8, "many workers"), (cost > 100, "high cost")]
    return F.array_compact(F.array(*(F.when(c, t) for c, t in rules)))


def optimal_workers(n: Column) -> Column:
    return _case(n, [(1000, 2), (10000, 4), (50000, 8), (100000, 16), (500000, 32)], 64, inclusive=False)


def duration_hours(n: Column, workers: Column) -> Column:
    rate = 100 * F.greatest(F.lit(0.5), 1.0 - (workers - 1) * 0.02)
    return F.greatest(F.lit(0.1), n / (workers * rate))


def total_cost(n: Column, workers: Column, hours: Column, infrastructure: str = "local") -> Column:
    """API, workers, storage of half a KB a ticket for a month, and overhead."""
    api = n * 2000 / 1000 * MODEL_INPUT_1K + n * 200 / 1000 * MODEL_OUTPUT_1K
    compute = hours * CLOUD_COMPUTE_HOUR if infrastructure == "cloud" else F.lit(0.0)
    return api + workers * hours * WORKER_HOUR[infrastructure] + n * 0.5 / 1024 * STORAGE_GB_MONTH + compute + OVERHEAD


def linear_projection(sizes: DataFrame, infrastructure: str = "local") -> DataFrame:
    """Workers, hours and cost of each dataset_size, and the cost for each ticket."""
    n = F.col("dataset_size")
    out = sizes.withColumn("workers", optimal_workers(n)).withColumn("hours", duration_hours(n, F.col("workers")))
    return out.withColumn("total", total_cost(n, F.col("workers"), F.col("hours"), infrastructure)).withColumn("cost_per_ticket", F.col("total") / n)


def _choices(sizes: DataFrame, infrastructure: str) -> DataFrame:
    n, w = F.col("dataset_size"), F.col("workers")
    grid = sizes.withColumn("workers", F.explode(F.array(*(F.lit(x) for x in WORKER_CHOICES)))).withColumn("hours", duration_hours(n, w))
    return grid.withColumn("total", total_cost(n, w, F.col("hours"), infrastructure)).withColumn("efficiency", n / (F.col("hours") * w))


def optimise_for_budget(sizes: DataFrame, budget: float, infrastructure: str = "local") -> DataFrame:
    """The most efficient number of workers within a budget, of at most a hundredth of the tickets."""
    ok = _choices(sizes, infrastructure).filter((F.col("total") <= budget) & (F.col("workers") <= F.greatest(F.lit(2), F.floor(F.col("dataset_size") / 100))))
    return ok.groupBy("dataset_size").agg(F.max(F.struct("efficiency", -F.col("workers"), "hours", "total")).alias("b")).select("dataset_size", (-F.col("b.col2")).alias("workers"), F.col("b.hours").alias("hours"), F.col("b.total").alias("total"))


def optimise_for_time(sizes: DataFrame, hours: float, infrastructure: str = "local") -> DataFrame:
    """The cheapest number of workers that is done in time."""
    ok = _choices(sizes, infrastructure).filter(F.col("hours") <= hours)
    return ok.groupBy("dataset_size").agg(F.min(F.struct("total", "workers", "hours")).alias("b")).select("dataset_size", F.col("b.workers").alias("workers"), F.col("b.hours").alias("hours"), F.col("b.total").alias("total"))


def roi(projected: DataFrame, manual_cost: float = 50.0, manual_hours: float = 0.5, setup: float = 1000.0) -> DataFrame:
    """Savings of money and time against manual work, return, payback and break-even."""
    n, cost = F.col("dataset_size"), F.col("cost")
    out = projected.withColumn("manual", n * manual_cost).withColumn("saved", n * manual_cost - cost)
    out = out.withColumn("hours_saved", n * manual_hours - F.col("hours"))
    out = out.withColumn("roi_percent", F.coalesce(F.try_divide("saved", "cost") * 100, F.lit(0.0))).withColumn("payback", F.col("saved") / (cost + setup))
    return out.withColumn("break_even_items", setup / (manual_cost - F.col("cost_per_ticket")))


def sensitivity(base: DataFrame, cost_per_ticket: float = COST_PER_TICKET) -> DataFrame:
    """ROI with size, workers and tokens changed, and its distance to the unchanged one."""
    cases = [("base", 1.0, None, 1.0), ("size_half", 0.5, None, 1.0), ("size_more", 1.5, None, 1.0), ("workers_2", 1.0, 2, 1.0), ("workers_8", 1.0, 8, 1.0), ("tokens_less", 1.0, None, 0.7), ("tokens_more", 1.0, None, 1.3)]
    each = F.array(*(F.struct(F.lit(c).alias("case"), F.lit(s).alias("size"), F.lit(w).cast("int").alias("w"), F.lit(t).alias("tokens")) for c, s, w, t in cases))
    grid = base.withColumn("base_size", F.col("dataset_size")).select("*", F.inline(each))
    grid = grid.withColumn("dataset_size", (F.col("dataset_size") * F.col("size")).cast("long")).withColumn("workers", F.coalesce("w", "workers"))
    out = project(grid, cost_per_ticket).withColumn("cost", F.col("cost") * F.col("tokens")).withColumn("cost_per_ticket", F.col("cost_per_ticket") * F.col("tokens"))
    out = roi(out)
    same = F.max(F.when(F.col("case") == "base", F.col("roi_percent"))).over(W.partitionBy("option", "base_size"))
    return out.withColumn("change", F.col("roi_percent") - same).select("option", "base_size", "case", "dataset_size", "workers", "cost", "roi_percent", "change")


def recommendations(metrics: DataFrame) -> DataFrame:
    """Rules over cost_per_item, tokens_per_second, hit_rate and workers, by priority."""
    from ..functions.numbers import priority_score

    rule = lambda cond, name, impact, effort, saving: F.when(cond, F.struct(F.lit(name).alias("name"), F.lit(impact).alias("impact"), F.lit(effort).alias("complexity"), F.lit(float(saving)).alias("saving")))
    rules = F.array_compact(
        F.array(
            rule(F.col("cost_per_item") > 0.20, "reduce cost", "critical", "moderate", 30),
            rule(F.col("cost_per_item").between(0.10, 0.20), "review cost", "high", "easy", 20),
            rule(F.col("tokens_per_second") < 50, "raise throughput", "high", "moderate", 15),
            rule(F.col("hit_rate") < 0.75, "improve cache", "medium", "easy", 25),
            rule(F.col("workers") < 4, "add workers", "medium", "easy", 10),
        )
    )
    out = metrics.select("id", F.explode(rules).alias("r")).select("id", "r.*")
    score = priority_score(F.col("impact"), F.col("complexity"), F.lit(0.8), F.col("saving"), F.lit(0))
    return out.withColumn("priority", score)


def implementation_plan(recs: DataFrame) -> DataFrame:
    """Three phases: up to five easy, four moderate and two complex recommendations."""
    rank = F.row_number().over(W.partitionBy("complexity").orderBy(F.desc("priority"), "name"))
    most = F.create_map(F.lit("easy"), F.lit(5), F.lit("moderate"), F.lit(4), F.lit("complex"), F.lit(2))[F.col("complexity")]
    phase = F.create_map(F.lit("easy"), F.lit(1), F.lit("moderate"), F.lit(2), F.lit("complex"), F.lit(3))[F.col("complexity")]
    return recs.withColumn("rank", rank).filter(F.col("rank") <= most).withColumn("phase", phase)
