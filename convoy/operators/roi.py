"""Returns on investment, comparisons between sizes, and the overview of costs.

Tables here have a row for each dataset size, session or run; windows over all rows run
over these only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import cost
from .trend import best_neighbourhood, diminishing_returns

# Default scenarios (name, workers, mode, infrastructure) and test sizes.
SCENARIOS = [("Conservative", 4, "memory_optimized", "local"), ("Balanced", 8, "balanced", "local"), ("Aggressive", 16, "speed_optimized", "cloud")]
TEST_SIZES = [1000, 5000, 10000, 50000, 100000, 500000]
MANUAL_COST, IMPLEMENTATION, HOURS_SAVED, HOURLY_RATE = 5.0, 2000.0, 0.01, 50.0


def cost_parts(tokens_in: Column, tokens_out: Column, workers: Column, hours: Column, gigabytes: Column, infrastructure: str = "local", days: int = 30, transfer: Column | None = None) -> dict[str, Column]:
    """The parts of a run's cost, and their sum as `total`."""
    parts = {
        "api": tokens_in / 1000 * cost.MODEL_INPUT_1K + tokens_out / 1000 * cost.MODEL_OUTPUT_1K,
        "infrastructure": workers * hours * cost.WORKER_HOUR[infrastructure],
        "storage": gigabytes * cost.STORAGE_GB_MONTH * (days / 30),
        "bandwidth": (F.lit(0.0) if transfer is None else transfer) * cost.BANDWIDTH_GB,
        "compute": hours * cost.CLOUD_COMPUTE_HOUR if infrastructure == "cloud" else F.lit(0.0),
        "overhead": F.lit(cost.OVERHEAD),
    }
    total = F.lit(0.0)
    for part in parts.values():
        total = total + part
    return parts | {"total": total}


def automation_roi(df: DataFrame, hourly_rate: float = HOURLY_RATE) -> DataFrame:
    """Of dataset_size, manual_cost and automated_cost (each a ticket), implementation and
    hours_saved: totals, savings, return, tickets until it pays, and gain."""
    n, manual, auto, setup = (F.col(c) for c in ("dataset_size", "manual_cost", "automated_cost", "implementation"))
    out = df.withColumns({"manual_total": n * manual, "automated_total": n * auto + setup})
    out = out.withColumn("direct_savings", F.col("manual_total") - F.col("automated_total"))
    out = out.withColumn("total_savings", F.col("direct_savings") + F.col("hours_saved") * hourly_rate)
    return out.withColumns(
        {
            "roi_percent": F.coalesce(F.try_divide(F.col("total_savings"), F.when(F.col("automated_total") > 0, F.col("automated_total"))) * 100, F.lit(0.0)),
            "payback_tickets": setup / F.greatest(F.lit(0.01), manual - auto),
            "reduction_percent": F.coalesce(F.col("direct_savings") / F.when(F.col("manual_total") > 0, F.col("manual_total")) * 100, F.lit(0.0)),
            "profitable": F.col("total_savings") > 0,
            "gain": manual / F.greatest(F.lit(0.01), auto),
        }
    )


def scaling_roi(sizes: DataFrame, base_size: int, setup: float = 1000.0) -> DataFrame:
    """For each dataset_size: the cost at the base size's rate, the optimised cost with its
    part of the set-up, and what is saved."""
    one = sizes.sparkSession.range(1).select(F.lit(base_size).cast("long").alias("dataset_size"))
    base = cost.linear_projection(one).select(F.col("cost_per_ticket").alias("base_rate"))
    shares = sizes.agg(F.count("*").alias("n_sizes"))
    out = cost.linear_projection(sizes).crossJoin(F.broadcast(base)).crossJoin(F.broadcast(shares))  # single rows
    out = out.withColumns({"naive_cost": F.col("dataset_size") * F.col("base_rate"), "optimized_cost": F.col("total") + F.lit(setup) / F.col("n_sizes")})
    out = out.withColumn("savings", F.col("naive_cost") - F.col("optimized_cost"))
    return out.withColumn("roi_percent", F.when(F.col("optimized_cost") > 0, F.col("savings") / F.col("optimized_cost") * 100).otherwise(0.0)).select("dataset_size", "naive_cost", "optimized_cost", "savings", "roi_percent", "cost_per_ticket")


def scaling_summary(rows: DataFrame) -> DataFrame:
    """Savings of all sizes, mean return, and the size with the least cost for each ticket."""
    return rows.agg(F.sum("savings").alias("total_savings"), F.avg("roi_percent").alias("mean_roi"), F.min_by("dataset_size", F.struct("cost_per_ticket", "dataset_size")).alias("best_size"))


def scenarios(sizes: DataFrame) -> DataFrame:
    """The default scenarios of each size (dataset_size) with their hours, total and cost for each ticket."""
    rows = F.inline(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(w).alias("workers"), F.lit(m).alias("mode"), F.lit(i).alias("infrastructure")) for n, w, m, i in SCENARIOS)))
    grid = sizes.select("dataset_size", rows)
    n, w = F.col("dataset_size"), F.col("workers")
    grid = grid.withColumn("hours", cost.duration_hours(n, w))
    total = F.when(F.col("infrastructure") == "cloud", cost.total_cost(n, w, F.col("hours"), "cloud")).otherwise(cost.total_cost(n, w, F.col("hours"), "local"))
    return grid.withColumn("total", total).withColumn("cost_per_ticket", F.col("total") / n)


def efficiency_recommendations(projection: DataFrame) -> DataFrame:
    """What a projection over sizes (dataset_size, workers, cost_per_ticket) suggests."""
    one = projection.agg(
        F.min_by("dataset_size", F.struct("cost_per_ticket", "dataset_size")).alias("best"), F.avg("workers").alias("workers"), F.count("*").alias("n"),
        (F.max_by("cost_per_ticket", "dataset_size") - F.min_by("cost_per_ticket", "dataset_size")).alias("trend"),
    )
    rules = F.array(
        F.concat(F.lit("most efficient size: "), F.col("best").cast("string")),
        F.when(F.col("n") > 1, F.when(F.col("trend") < 0, "economies of scale").otherwise("diseconomies of scale")),
        F.when(F.col("workers") > 16, "many workers: watch coordination").when(F.col("workers") < 4, "few workers: raise parallelism"),
    )
    return one.select(F.posexplode(F.array_compact(rules)).alias("nr", "recommendation"))


def comprehensive(spark: SparkSession, size: int, budget: float | None = None, hours: float | None = None) -> dict[str, DataFrame]:
    """The tables of a whole analysis of a dataset size."""
    sizes = [n for n in TEST_SIZES if n <= 5 * size] or [size]
    make = lambda values: spark.range(1).select(F.explode(F.array(*(F.lit(v).cast("long") for v in values))).alias("dataset_size"))
    projection = cost.linear_projection(make(sizes))
    out = {"projection": projection, "scenarios": scenarios(make([size])), "recommendations": efficiency_recommendations(projection)}
    auto = F.min_by("cost_per_ticket", "dataset_size").alias("automated_cost")
    base = projection.agg(auto).select(F.lit(size).cast("long").alias("dataset_size"), F.lit(MANUAL_COST).alias("manual_cost"), "automated_cost", F.lit(IMPLEMENTATION).alias("implementation"), F.lit(size * HOURS_SAVED).alias("hours_saved"))
    out["automation"] = automation_roi(base)
    larger = [n for n in (2 * size, 5 * size, 10 * size) if n <= 1_000_000]
    if larger:
        out["scaling"] = scaling_roi(make(larger), size)
    if budget:
        out["budget"] = cost.optimise_for_budget(make([size]), budget)
    if hours:
        out["time"] = cost.optimise_for_time(make([size]), hours)
    return out


# --- overview and comparison


def indicators(sessions: DataFrame, daily: str = "daily_cost", score: str = "score") -> DataFrame:
    """For each session (cost_per_item, budget_percent, daily_cost, score): the state of
    budget and efficiency, and insights."""
    from ..functions.numbers import budget_status

    c = F.col("cost_per_item")
    efficiency = F.when(c > 0.1, "attention").when(c > 0.05, "warning").otherwise("good")
    insights = F.array(
        F.when(c > 0, F.when(c < 0.01, "excellent cost for each item").when(c < 0.05, "good cost for each item").otherwise("high cost for each item")),
        F.when(F.col(daily) > 10, "high daily projection"),
        F.when(F.col(score) > 500, "excellent efficiency score"),
    )
    return sessions.withColumns({"budget_status": budget_status(F.col("budget_percent")), "efficiency_status": efficiency, "insights": F.array_compact(insights)})


def size_comparison(projected: DataFrame) -> DataFrame:
    """Over the best cost of each size (from cost.project): scale efficiency, linearity, the
    optimal size with its neighbours, where returns diminish, and the most frequent option."""
    best = cost.compare(projected).select("dataset_size", (F.col("least") / F.col("dataset_size")).alias("per_item"), "best")
    ends = best.agg(F.min_by("per_item", "dataset_size").alias("a"), F.max_by("per_item", "dataset_size").alias("z"), F.min("dataset_size").alias("least_size"), F.max("dataset_size").alias("most_size"))
    option = best.groupBy("best").agg(F.count("*").alias("n"), F.min("dataset_size").alias("s")).agg(F.max_by("best", F.struct(F.col("n"), -F.col("s"))).alias("option"))
    near = best_neighbourhood(best, "dataset_size", "per_item").crossJoin(diminishing_returns(best, "dataset_size", "per_item"))
    out = ends.crossJoin(near).crossJoin(option)  # single rows
    out = out.withColumn("scale_efficiency", F.col("a") / F.col("z"))
    return out.select("scale_efficiency", (F.abs(F.col("scale_efficiency") - 1) < 0.1).alias("linear"), F.col("optimal").alias("optimal_size"), F.coalesce("previous", "least_size").alias("min_efficient"), F.coalesce("following", "most_size").alias("max_efficient"), F.col("from_size").alias("diminishing_from"), "option")


def comparison_recommendations(projected: DataFrame) -> DataFrame:
    """What a comparison of sizes suggests: best option, economy of scale, savings over 100 USD."""
    c = cost.compare(projected)
    head = size_comparison(projected).select(F.explode(F.array_compact(F.array(F.concat(F.lit("best option: "), "option"), F.when(F.col("scale_efficiency") > 2, "strong economy of scale")))).alias("recommendation"))
    rest = c.filter("savings > 100").select(F.concat(F.lit("size "), F.col("dataset_size").cast("string"), F.lit(": the best option saves more than 100 USD")).alias("recommendation"))
    return head.unionByName(rest)


def history_context(sessions: DataFrame, order: str) -> DataFrame:
    """Of sessions (dataset_size, total_cost_usd): totals, whether the last three cost less
    than those before (of three sessions or less: than the first), and how many costs the
    last five have."""
    c = F.col("total_cost_usd")
    every = sessions.agg(
        F.sum(F.when(F.col("dataset_size") > 0, F.col("dataset_size")).otherwise(0)).alias("items"), F.sum(c).alias("cost"), F.count("*").alias("sessions"),
        F.count(c).alias("costs"), F.min_by(c, F.col(order)).alias("first"),
    )
    last = sessions.orderBy(F.desc(order)).limit(5).select(c, F.row_number().over(W.orderBy(F.desc(order))).alias("r"))  # five rows
    recent = F.when(F.col("r") <= 3, c)
    ends = last.agg(F.avg(recent).alias("recent"), F.sum(recent).alias("s"), F.count(recent).alias("k"), F.count_distinct(c).alias("last_costs"))
    older = F.when(F.col("sessions") > 3, F.try_divide(F.col("cost") - F.coalesce("s", F.lit(0)), F.col("costs") - F.col("k"))).otherwise(F.col("first"))
    one = every.crossJoin(F.broadcast(ends)).withColumn("older", older)  # single rows
    trend = F.when(F.col("sessions") < 2, "insufficient_data").when(F.col("recent") < F.col("older"), "improving").otherwise("stable")
    return one.select("items", "cost", (F.col("cost") / F.greatest(F.col("items"), F.lit(1))).alias("cost_per_item"), "sessions", "recent", "older", trend.alias("trend"), F.when(F.col("last_costs") < 3, "stable").otherwise("variable").alias("stability"))


# --- projections of the model stages


def pipeline_projection(df: DataFrame) -> DataFrame:
    """Of dataset_size, tokens and cost so far: projected tokens and cost with its range,
    and alerts. Without a cost, tokens are those of one ticket at 0.25 USD a thousand."""
    known = F.col("cost") > 0
    each = F.when(F.col("tokens") > 0, F.col("tokens")).otherwise(1000)
    tokens = F.when(known, F.col("tokens")).otherwise(each * F.col("dataset_size"))
    out = df.withColumn("projected_tokens", tokens.cast("long"))
    raw = F.when(known, F.col("cost")).otherwise(F.col("projected_tokens") / 1000 * 0.25)
    out = out.withColumns({"projected_cost": F.round(raw, 4), "conservative": F.round(raw * 0.8, 4), "pessimistic": F.round(raw * 1.2, 4)})
    return out.withColumn("alerts", F.array_compact(F.array(F.when(raw > 50, "over 50 USD"), F.when(raw > 100, "over 100 USD"))))


def token_recommendations(phases: DataFrame) -> DataFrame:
    """Of usage by phase (phase, input_tokens, output_tokens, cost_usd): what to change."""
    part = lambda *names: F.coalesce(F.sum(F.when(F.col("phase").isin(*names), F.col("cost_usd"))), F.lit(0.0))
    one = phases.agg(F.sum("input_tokens").alias("i"), F.sum("output_tokens").alias("o"), F.sum("cost_usd").alias("cost"), part("map").alias("m"), part("combine").alias("c"), part("classify", "categorize").alias("k"))
    rules = F.array_compact(
        F.array(
            F.when(F.col("i") > F.col("o") * 3, "smaller chunks: input outweighs output"),
            F.when(F.col("cost") > 10, "more caching or larger batches: high cost"),
            F.when(F.col("m") > F.col("c") + F.col("k"), "chunk size: the map phase dominates"),
            F.when(F.col("k") > F.col("m") + F.col("c"), "batch size: the classify phase dominates"),
        )
    )
    return one.select(F.explode(F.when(F.size(rules) > 0, rules).otherwise(F.array(F.lit("nothing: token use is efficient")))).alias("recommendation"))


def flat_estimates(n: Column, tokens: Column) -> dict[str, Column]:
    """Estimates at flat rates: classification by tokens; discovery and application by tickets."""
    return {"classification": tokens / 1000 * 0.0003, "discovery": n * 500 / 1000 * 0.000075, "application": n * 150 / 1000 * 0.000075 + n * 32 / 1000 * 0.000075}
