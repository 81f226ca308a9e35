"""Dataset profiles, resource profiles and scaling decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import accented, sentence_marks
from .joins import range_lookup

# Low, high, workers, memory MB, chunk tokens, overlap, batch, USD a ticket.
PROFILES = [
    (1, 1000, 2, 512, 50000, 5000, 25, 0.0003),
    (1001, 10000, 4, 512, 75000, 7500, 50, 0.00028),
    (10001, 50000, 8, 768, 100000, 10000, 75, 0.00026),
    (50001, 100000, 16, 1024, 150000, 15000, 100, 0.00024),
    (100001, 500000, 32, 1536, 200000, 20000, 150, 0.00023),
    (500001, 9223372036854775807, 64, 2048, 250000, 25000, 200, 0.00022),
]


def profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROFILES, "low long, high long, workers int, memory_mb int, chunk_tokens int, overlap_tokens int, batch_size int, cost_per_ticket double")


def profile_for(sizes: DataFrame, size_col: str = "dataset_size") -> DataFrame:
    return range_lookup(sizes, size_col, profiles(sizes.sparkSession))


def profile_cost(sizes: DataFrame, size_col: str = "dataset_size") -> DataFrame:
    out = profile_for(sizes, size_col)
    return out.withColumn("cost", F.col(size_col) * F.col("cost_per_ticket") + F.col("workers") * 0.001)


def distinct_characters(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Different characters of all texts, and their part of 200 at most."""
    each = df.select(F.explode(F.array_distinct(F.split(F.coalesce(F.col(text_col), F.lit("")), ""))).alias("c")).filter("c <> ''").distinct()
    return each.agg(F.count("*").alias("characters"), F.least(F.count("*") / 200, F.lit(1.0)).alias("diversity"))


def complexity(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The mean of three parts up to 1: mean length over 1,000, character diversity, and mean
    sentence marks over 10; language diversity; seconds for a ticket. Over all rows."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    one = df.agg(F.count("*").alias("rows"), F.avg(F.length(t)).alias("mean_length"), F.avg(sentence_marks(t)).alias("marks"), F.avg(accented(t)).alias("accents"))
    out = one.crossJoin(distinct_characters(df, text_col))  # single rows
    parts = F.least(F.col("mean_length") / 1000, F.lit(1.0)) + F.col("diversity") + F.least(F.col("marks") / 10, F.lit(1.0))
    language = F.least(F.coalesce(F.try_divide("accents", "mean_length"), F.lit(0.0)) * 10, F.lit(1.0))
    out = out.withColumn("complexity", parts / 3).withColumn("language_diversity", language)
    return out.withColumn("seconds_per_ticket", 0.1 + F.col("mean_length") / 1000 + 2 * F.col("complexity")).select("rows", "mean_length", "characters", "complexity", "language_diversity", "seconds_per_ticket")


def dataset_profile(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows, mean length, complexity and accented share, over all rows."""
    n, marks = F.length(text_col), sentence_marks(F.col(text_col))
    out = df.agg(
        F.count("*").alias("rows"), F.avg(n).alias("mean_length"), F.avg(F.least(n / 1000, F.lit(1.0))).alias("length_part"),
        F.avg(F.least(marks / 10, F.lit(1.0))).alias("sentence_part"), F.try_divide(F.sum(accented(F.col(text_col))), F.sum(n)).alias("accented"),
    )
    out = out.withColumn("complexity", (F.col("length_part") + F.col("sentence_part")) / 2)
    return out.withColumn("seconds_per_ticket", 0.1 + F.col("mean_length") / 1000 + 2 * F.col("complexity"))


def _similar(history: DataFrame, size: int, tolerance: float) -> DataFrame:
    off = F.abs(F.col("dataset_size") - size)
    return history.filter(off / F.greatest(F.col("dataset_size"), F.lit(size)) <= tolerance).withColumn("distance", off)


def similar_workloads(history: DataFrame, size: int, tolerance: float = 0.3, k: int = 5) -> DataFrame:
    """The nearest earlier runs whose size differs by at most the tolerance."""
    return _similar(history, size, tolerance).orderBy("distance", "run_id").limit(k)


def predict(history: DataFrame, size: int, workers: int, tolerance: float = 0.3) -> DataFrame:
    """Mean duration of the five nearest runs, weighted by how like they are in size and
    workers and, if there is a column `days` of their age, how recent; each adjusted to the
    workers. Without a similar run, a hundredth of a minute a ticket at a confidence of 0.1."""
    near = similar_workloads(history, size, tolerance)
    closeness = lambda c, v: 1 - F.abs(F.col(c) - v) / F.greatest(F.col(c), F.lit(v))
    weight = closeness("dataset_size", size) * closeness("workers", workers)
    if "days" in history.columns:
        weight = weight * F.least(F.lit(1.0), F.lit(30.0) / F.greatest(F.lit(1), F.col("days")))
    one = near.agg(F.sum(weight * F.col("hours") * F.col("workers") / workers).alias("h"), F.sum(weight).alias("w"))
    one = one.crossJoin(_similar(history, size, tolerance).agg(F.count("*").alias("similar")))  # single rows
    known = F.coalesce(F.col("w"), F.lit(0.0)) > 0
    confidence = F.when(F.col("similar") == 0, 0.1).when(known, F.least(F.lit(1.0), F.col("w") / F.col("similar"))).otherwise(0.2)
    return one.select(F.when(known, F.col("h") / F.col("w")).otherwise(size * 0.01 / 60).alias("hours"), confidence.alias("confidence"), "similar")


def recommend(jobs: DataFrame) -> DataFrame:
    """Of tickets, cores, memory_gb, seconds_per_ticket, predicted_minutes, confidence, mode
    and the overrides max_workers and max_memory_gb (null: none): workers, memory for each,
    chunk, overlap and batch sizes, minutes, peak memory, cost and confidence."""
    n, cores, memory, mode = (F.col(c) for c in ("tickets", "cores", "memory_gb", "mode"))
    base = F.when(n < 1000, 2).when(n < 10000, F.least(F.lit(4), cores)).when(n < 100000, F.least(F.lit(8), cores)).otherwise(F.least(F.lit(16), cores * 2))
    out = jobs.withColumn("__b", base)
    out = out.withColumn("__b", F.when(memory < 2, F.least("__b", F.lit(2))).when(memory > 8, F.least(F.col("__b") * 2, cores * 2)).otherwise(F.col("__b")))
    b = F.least("__b", F.coalesce("max_workers", "__b"))
    half = F.floor(b / 2)
    out = out.withColumn("workers", F.when(mode == "speed_optimized", F.least(b * 2, cores * 2)).when(mode == "memory_optimized", F.greatest(F.lit(1), half)).when(mode == "cost_optimized", F.greatest(F.lit(2), half)).otherwise(b).cast("long"))
    share = F.floor(memory * 1024 / F.col("workers"))
    each = F.when(mode == "speed_optimized", F.least(F.lit(1024), share)).when(mode == "memory_optimized", 256).when(mode == "cost_optimized", 512).otherwise(F.least(F.lit(768), share))
    out = out.withColumn("memory_mb", each.cast("long"))
    most = F.floor(F.col("max_memory_gb") * 1024)
    tight = F.col("workers") * F.col("memory_mb") > most
    out = out.withColumn("workers", F.when(tight, F.greatest(F.lit(1), F.floor(most / F.col("memory_mb")))).otherwise(F.col("workers")).cast("long"))
    chunk = F.when(mode == "speed_optimized", 150000).when(mode == "memory_optimized", 50000).otherwise(100000)
    batch = F.when(mode == "speed_optimized", 100).when(mode == "memory_optimized", 25).otherwise(50)
    minutes = F.when(F.col("confidence") > 0.3, F.col("predicted_minutes")).otherwise(n * F.col("seconds_per_ticket") / F.col("workers") / 60)
    sure = (F.col("confidence") + F.least(F.lit(1.0), n / 1000) + F.least(F.lit(1.0), memory / 4)) / 3
    return out.withColumns(
        {
            "chunk_tokens": chunk, "overlap_tokens": F.floor(chunk / 10).cast("long"), "batch_size": batch, "minutes": minutes, "peak_gb": F.col("workers") * F.col("memory_mb") / 1024,
            "cost": n * 0.0003 / F.least(F.lit(2.0), F.col("workers") / 4), "score": sure,
        }
    ).drop("__b")


def plan_for(texts: DataFrame, history: DataFrame | None, cores: int, memory_gb: float, mode: str = "balanced", text_col: str = "text", cpu: float = 0.0, memory: float = 0.0, disk_gb: float = 1e9) -> DataFrame:
    """A dataset's complexity, the prediction from earlier runs, the recommendation, and
    whether it is feasible, in one row."""
    shape = complexity(texts, text_col)
    size = shape.first()["rows"]  # a single row
    known = predict(history, size, cores) if history is not None else texts.sparkSession.range(1).select(F.lit(size * 0.01 / 60).alias("hours"), F.lit(0.1).alias("confidence"), F.lit(0).alias("similar"))
    job = shape.crossJoin(known).select(  # single rows
        F.col("rows").alias("tickets"), "seconds_per_ticket", (F.col("hours") * 60).alias("predicted_minutes"), "confidence", F.lit(cores).alias("cores"), F.lit(float(memory_gb)).alias("memory_gb"), F.lit(mode).alias("mode"),
        F.lit(None).cast("int").alias("max_workers"), F.lit(None).cast("double").alias("max_memory_gb"), F.lit(cpu).alias("cpu"), F.lit(memory).alias("memory"), F.lit(disk_gb).alias("disk_gb"),
    )
    return feasibility(recommend(job))


def feasibility(recommended: DataFrame) -> DataFrame:
    """Of a recommendation beside cores, memory_gb, cpu, memory (per cent in use) and disk_gb:
    what speaks against it, and whether nothing does."""
    need = F.col("workers") * F.col("memory_mb") / 1024
    issues = F.array_compact(
        F.array(
            F.when(F.col("workers") > F.col("cores") * 4, "too many workers"),
            F.when(need > F.col("memory_gb"), "insufficient memory"),
            F.when(F.col("cpu") > 80, "high CPU use"),
            F.when(F.col("memory") > 85, "high memory use"),
            F.when(F.col("peak_gb") * 2 > F.col("disk_gb"), "insufficient disk"),
        )
    )
    return recommended.withColumn("issues", issues).withColumn("valid", F.size("issues") == 0)


def scaling_decision(metrics: DataFrame, least: int = 1, most: int = 64) -> DataFrame:
    """up, down, emergency or none for each row of queue, cpu, memory, free_gb, error_rate
    and workers, and the number of workers after it."""
    urgent = (F.col("error_rate") > 0.20) | (F.col("free_gb") < 0.5) | (F.col("queue") > 1000)
    up = (F.col("queue") > 100) | (F.col("cpu") > 75) | (F.col("memory") > 80)
    down = (F.col("queue") < 10) & (F.col("cpu") < 30) & (F.col("memory") < 40)
    w = F.col("workers")
    action = F.when(urgent, "emergency").when(up & (w < most), "up").when(down & (w > least), "down").otherwise("none")
    target = F.when(F.col("action") == "emergency", w * 2).when(F.col("action") == "up", F.ceil(w * 1.5)).when(F.col("action") == "down", F.floor(w / 1.5)).otherwise(w)
    return metrics.withColumn("action", action).withColumn("target", F.least(F.greatest(target, F.lit(least)), F.lit(most)).cast("long"))


# The threshold of each check.
THRESHOLDS = {
    ("queue_depth", "up"): 100.0, ("queue_depth", "down"): 10.0, ("cpu_usage", "up"): 75.0, ("cpu_usage", "down"): 30.0,
    ("memory_pressure", "up"): 80.0, ("memory_pressure", "down"): 40.0, ("throughput_drop", "up"): 20.0,
}


def threshold_of(trigger: Column, action: Column) -> Column:
    """The threshold of a check; 0 where it has none."""
    known = F.create_map(*(F.lit(x) for (t, a), v in THRESHOLDS.items() for x in (f"{t}:{a}", v)))
    return F.coalesce(F.try_element_at(known, F.concat_ws(":", trigger, action)), F.lit(0.0))


def scaling_checks(metrics: DataFrame, least: int = 1, most: int = 64, factor: float = 1.5) -> DataFrame:
    """Of queue, cpu, memory, free_gb, error_rate (per cent), throughput, workers, with_app
    and the trends and mean of the trailing time (queue_trend, cpu_trend, throughput_trend,
    mean_throughput): action, trigger, its value and threshold, and the workers after it.
    Without metrics of the application only high load counts. The cooldown of each trigger
    is `alerts.cooldown` over the actions."""
    q, cpu, mem, w = (F.col(c) for c in ("queue", "cpu", "memory", "workers"))
    hit = lambda cond, action, trigger, value: F.when(cond, F.struct(value.cast("double").alias("value"), F.lit(action).alias("action"), F.lit(trigger).alias("trigger")))
    rising, falling = F.array(F.lit("increasing"), F.lit("stable")), F.array(F.lit("decreasing"), F.lit("stable"))
    t = lambda trigger, action: THRESHOLDS[trigger, action]
    mean, now = F.col("mean_throughput"), F.col("throughput")
    drop = F.abs(mean - now) / F.greatest(mean, F.lit(1)) * 100
    up = F.array_compact(
        F.array(
            hit((q > t("queue_depth", "up")) & F.array_contains(rising, F.col("queue_trend")), "up", "queue_depth", q),
            hit((cpu > t("cpu_usage", "up")) & F.array_contains(rising, F.col("cpu_trend")), "up", "cpu_usage", cpu),
            hit(mem > t("memory_pressure", "up"), "up", "memory_pressure", mem),
            hit((F.col("throughput_trend") == "decreasing") & (drop > t("throughput_drop", "up")), "up", "throughput_drop", drop),
        )
    )
    down = F.array_compact(
        F.array(
            hit((q < t("queue_depth", "down")) & F.array_contains(falling, F.col("queue_trend")), "down", "queue_depth", q),
            hit((cpu < t("cpu_usage", "down")) & F.array_contains(falling, F.col("cpu_trend")), "down", "cpu_usage", cpu),
            hit(mem < t("memory_pressure", "down"), "down", "memory_pressure", mem),
            hit((F.col("throughput_trend") == "stable") & (mean > now * 1.5), "down", "throughput_drop", mean),
        )
    )
    urgent = F.coalesce(
        hit(F.col("error_rate") > 20, "emergency", "error_rate", F.col("error_rate")), hit(F.col("free_gb") < 0.5, "emergency", "memory_pressure", mem), hit(q > 1000, "emergency", "queue_depth", q)
    )
    blind = F.coalesce(hit(cpu > 90, "up", "cpu_usage", cpu), hit(mem > 90, "up", "memory_pressure", mem), hit((cpu < 20) & (mem < 30) & (w > least), "down", "cpu_usage", cpu))
    none = F.struct(F.lit(0.0).alias("value"), F.lit("maintain").alias("action"), F.lit("manual_trigger").alias("trigger"))
    seen = F.coalesce(urgent, F.when((F.size(up) > 0) & (w < most), F.array_max(up)), F.when((F.size(down) > 0) & (w > least), F.array_max(down)))
    out = metrics.withColumn("__d", F.coalesce(F.when(F.col("with_app"), seen).otherwise(blind), none))
    out = out.withColumns({"action": F.col("__d.action"), "trigger": F.col("__d.trigger"), "value": F.col("__d.value")}).drop("__d")
    a = F.col("action")
    target = F.when(a == "emergency", F.least(w * 2, F.lit(most))).when(a == "up", F.least(F.floor(w * factor), F.lit(most))).when(a == "down", F.greatest(F.floor(w / factor), F.lit(least))).otherwise(w)
    return out.withColumns({"threshold": threshold_of(F.col("trigger"), a), "target": target.cast("long")})


def trimmed(events: DataFrame, order: str, most: int = 1000, keep: int = 500) -> DataFrame:
    """The event log; beyond `most` rows only the last `keep` of it."""
    n = events.agg(F.count("*").alias("__n"))
    last = events.orderBy(F.desc(order)).limit(keep).select(F.col(order).alias("__o")).agg(F.min("__o").alias("__from"))
    return events.crossJoin(F.broadcast(n.crossJoin(last))).filter((F.col("__n") <= most) | (F.col(order) >= F.col("__from"))).drop("__n", "__from")  # single rows


def scaling_history(events: DataFrame, order: str, n: int = 10) -> DataFrame:
    """The last n events, latest first, beside the success rate of all in per cent."""
    rate = events.agg(F.coalesce(F.avg(F.col("success").cast("int")) * 100, F.lit(0.0)).alias("success_rate"), F.count("*").alias("total"))
    return events.orderBy(F.desc(order)).limit(n).crossJoin(F.broadcast(rate))  # a single row


def record_run(run: DataFrame, path: str) -> None:
    """Append an observed run to the history."""
    run.write.mode("append").parquet(path)


def scaling_dashboard(events: DataFrame) -> DataFrame:
    return events.groupBy("trigger").agg(F.count("*").alias("n"), F.avg(F.col("success").cast("int")).alias("success_rate"))
