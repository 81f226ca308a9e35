"""A table of results by key: look-up before a model call, storage after it, time to
live, health. Keys hash the whole text with model and prompt version, so a changed text,
model or prompt never meets an old result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTRY = "key string, result string, tokens_in long, tokens_out long, created_at timestamp, size long"


def cache_key(text: Column, model: str, version: str = "v1") -> Column:
    return F.sha2(F.concat_ws(":", F.lit(version), F.lit(model), text), 256)


def look_up(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests with their stored results, and those without one."""
    return requests.join(cache.select("key", "result"), "key"), requests.join(cache.select("key"), "key", "left_anti")


def live(cache: DataFrame, now: Column, hours: float = 72) -> DataFrame:
    return cache.filter(F.unix_timestamp(now) - F.unix_timestamp("created_at") < hours * 3600)


def invalidate(cache: DataFrame, keys: DataFrame) -> DataFrame:
    return cache.join(keys.select("key"), "key", "left_anti")


def statistics(log: DataFrame) -> DataFrame:
    """Of an access log (hit, size): accesses, hits, misses and hit rate."""
    return log.agg(F.count("*").alias("accesses"), F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), (F.count_if("hit") * 100.0 / F.count("*")).alias("hit_rate"), F.sum("size").alias("bytes"))


def patterns(metrics: DataFrame) -> DataFrame:
    """Of hit_rate and usage in per cent, files and compressed: an efficiency score of both
    rates, and the compressed share."""
    hit, use = F.col("hit_rate") / 100, F.col("usage") / 100
    return metrics.withColumns({"efficiency": 0.7 * hit + 0.3 * (1 - use), "compression_ratio": F.col("compressed") / F.greatest(F.col("files"), F.lit(1))})


def performance_report(metrics: DataFrame, since: Column, series: tuple[str, ...] = ("hit_rate", "usage", "files")) -> DataFrame:
    """Mean, least, greatest and latest value of each series of the snapshots after `since`."""
    rows = metrics.filter(F.col("ts") > since)
    one = rows.agg(*(f(c).cast("double").alias(f"{c}.{n}") for c in series for n, f in (("mean", F.avg), ("least", F.min), ("most", F.max), ("current", lambda x: F.max_by(x, "ts")))))
    parts = F.array(*(F.struct(F.lit(c).alias("series"), *(F.col(f"`{c}.{n}`").alias(n) for n in ("mean", "least", "most", "current"))) for c in series))
    return one.select(F.inline(parts))


def retained(metrics: DataFrame, now: Column, hours: float = 24) -> DataFrame:
    """The snapshots of the last hours."""
    return metrics.filter(F.unix_timestamp("ts") > F.unix_timestamp(now) - int(hours * 3600))


def cache_recommendations(metrics: DataFrame) -> DataFrame:
    """What each snapshot (hit_rate, usage, files, compressed) suggests, a row for each."""
    rules = F.array_compact(
        F.array(
            F.when(F.col("hit_rate") < 50, "revise keys: very low hit rate").when(F.col("hit_rate") < 70, "revise policy: low hit rate"),
            F.when(F.col("usage") > 85, "clean up: nearly full").when(F.col("usage") > 70, "watch growth: fairly full"),
            F.when(F.col("files") > 5000, "compress or delete: many files"),
            F.when((F.col("compressed") / F.greatest(F.col("files"), F.lit(1)) < 0.1) & (F.col("files") > 100), "compress: few files are"),
        )
    )
    return metrics.withColumn("recommendation", F.explode(F.when(F.size(rules) > 0, rules).otherwise(F.array(F.lit("go on")))))


def needs_cleanup(cache: DataFrame, new_bytes: int, limit: int) -> DataFrame:
    """Bytes held, and whether an entry of the new size would lead over the limit."""
    held = F.coalesce(F.sum("size"), F.lit(0))
    return cache.agg(held.alias("held"), (held + new_bytes > limit).alias("cleanup"))


def most_recent(cache: DataFrame, accessed: str, most: int = 1000) -> DataFrame:
    """The entries that a bounded memory keeps: the last accessed (ties by key)."""
    return cache.orderBy(F.desc(accessed), "key").limit(most)


def guarded(cache: DataFrame, entry: DataFrame, limit: int, now: Column, hours: float = 72) -> DataFrame:
    """The cache with new entries: if they'd lead over the limit, expired entries go first."""
    sizes = cache.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("__held")).crossJoin(entry.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("__new")))  # single rows
    fresh = F.unix_timestamp(now) - F.unix_timestamp("created_at") < int(hours * 3600)
    kept = cache.crossJoin(F.broadcast(sizes)).filter((F.col("__held") + F.col("__new") <= limit) | fresh).select(*cache.columns)
    return kept.unionByName(entry.select(*cache.columns))


def source_key(spark, path: str, method: str, limit: int | None = None) -> str:
    """The key of data prepared from a file: its path, bytes and time of change, so that a
    changed file is prepared again."""
    import hashlib

    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at)
    return hashlib.sha256(f"{path}:{status.getLen()}:{status.getModificationTime()}:{limit}:{method}".encode()).hexdigest()


def file_counts(spark, path: str) -> tuple[int, int]:
    """Plain and compressed files of a folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [s.getPath().getName() for s in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at) if s.isFile()]
    packed = sum(n.endswith((".gz", ".snappy.parquet", ".zstd.parquet")) for n in names)
    return len(names) - packed, packed


def alerts(metrics: DataFrame) -> DataFrame:
    """Snapshots (ts, hit_rate, usage, files) with a low hit rate, high usage or many files."""
    rule = lambda cond, name: F.when(cond, F.lit(name))
    found = F.array_compact(F.array(rule(F.col("hit_rate") < 60, "low_hit_rate"), rule(F.col("usage") > 90, "high_usage"), rule(F.col("files") > 10000, "many_files")))
    return metrics.select("ts", F.explode(found).alias("alert"))


def health(metrics: DataFrame) -> DataFrame:
    """Score in per cent of five parts: hits 30, usage 25, errors 20, organisation 15 and
    stability 10 (`points`). Rows have hit_rate, usage, saves, errors, compressed, files."""
    part = lambda x, most: F.greatest(F.lit(0.0), F.least(x, F.lit(float(most))))
    error_rate = F.col("errors") / F.greatest(F.col("saves") + F.col("errors"), F.lit(1)) * 100
    score = (
        part(F.col("hit_rate") / 80 * 30, 30)
        + part((100 - F.col("usage")) / 20 * 25, 25)
        + part((5 - error_rate) / 5 * 20, 20)
        + part(F.col("compressed") / F.greatest(F.col("files"), F.lit(1)) * 15, 15)
        + F.col("points")
    )
    return metrics.withColumn("score", score).withColumn("label", F.when(score >= 80, "excellent").when(score >= 60, "good").when(score >= 40, "fair").otherwise("poor"))
