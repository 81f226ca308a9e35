"""Frames over many small ranges against one window, and batches against the plain fold."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from convoy.operators import alerts, cost, ordered, pack, roi, trend


@pytest.fixture
def many_ranges(spark):
    names = {"spark.sql.shuffle.partitions": "23", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def same(got, want):
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))


@pytest.mark.parametrize("n", [0, 1, 9, 60, 500])
def test_frames_of_rows(spark, many_ranges, n):
    """Ranges may hold fewer rows than a frame reaches."""
    df = spark.range(n).select((F.col("id") * 7919 % 1009).alias("k"), (F.col("id") * 31 % 17).alias("v"))
    w = W.orderBy("k")
    columns = lambda w: {"s": F.sum("v").over(w.rowsBetween(-7, 0)), "back": F.lag("v", 5).over(w), "ahead": F.lead("v", 9).over(w)}
    same(ordered.over_rows(df, ["k"], columns, before=7, after=9), df.withColumns(columns(w)))


@pytest.mark.parametrize("back", [0, 3, 100, 5000])
def test_frames_of_time(spark, many_ranges, back):
    df = spark.range(400).select((F.col("id") * 7919 % 211).alias("t"), (F.col("id") * 31 % 17).alias("v"))  # with ties
    columns = lambda w: {"s": F.sum("v").over(w.rangeBetween(-back, 0)), "m": F.max("v").over(w.rangeBetween(-back, 0))}
    same(ordered.over_time(df, "t", columns, back), df.withColumns(columns(W.orderBy("t"))))


def test_series_need_no_single_task(spark):
    df = spark.range(100).select(F.col("id").alias("k"), (F.col("id") * 31 % 17).cast("double").alias("v"), F.col("id").alias("ts"), F.lit(0.5).alias("progress"), F.lit(9.0).alias("cost"))
    made = [
        trend.last_zscore(df, "v", "k"), trend.slope(df, "v", "k"), trend.stability_points(df, "v", "k"), trend.trailing_range(df, "v", "k"), trend.trailing_mean(df, "v", "k"),
        alerts.predictive(df, 1.0), cost.session_events(df.select(F.col("k").alias("session_id"), F.lit("start").alias("event"), F.col("k").alias("seconds")), "session_id"),
    ]
    for out in made:
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        for line in plan.splitlines():  # windows over all rows at once see a row for each range
            assert "Window" not in line or "__p" in line, line
        assert out.count() > 0


def test_history_of_few_sessions(spark):
    for n, want in ((1, "insufficient_data"), (2, "improving"), (3, "improving"), (9, "improving")):
        df = spark.range(n).select("id", F.lit(2).alias("dataset_size"), (100 - F.col("id")).cast("double").alias("total_cost_usd"))
        got = roi.history_context(df, "id").first()
        assert (got["trend"], got["sessions"], got["items"]) == (want, n, 2 * n)
        assert got["older"] == (100.0 if n <= 3 else sum(100.0 - i for i in range(n - 3)) / (n - 3))


def plain_batches(rows, limit, most, sequential):
    out, current = {}, None
    for s, i, t in sorted(rows):
        if s != current:
            current, batch, tokens, n = s, 0, pack.HEADER_TOKENS, 0
        if n and not sequential and (tokens + t >= limit or n >= most):
            batch, tokens, n = batch + 1, pack.HEADER_TOKENS, 0
        out[s, i], tokens, n = batch, tokens + t, n + 1
        if sequential and (tokens >= limit or n >= most):
            batch, tokens, n = batch + 1, 0, 0
    return out


@pytest.mark.parametrize("n,limit,most,shards,fan", [(0, 9, 3, 1, 4), (1, 9, 3, 1, 4), (300, 100, 5, 3, 3), (300, 10**9, 4, 1, 1024), (400, 5000, 50, 40, 2)])
def test_batches_equal_the_fold(spark, monkeypatch, n, limit, most, shards, fan):
    """Small blocks, composed in several levels."""
    monkeypatch.setattr(pack, "BLOCK_ROWS", 10)
    monkeypatch.setattr(pack.first_states, "__defaults__", (fan,))
    rng = random.Random(n + most)
    rows = [(str(rng.randrange(shards)), i, rng.choice([0, 1, 10, 100, 400, 9000])) for i in range(n)]
    df = spark.createDataFrame(rows, "s string, i long, t long").repartition(3)
    for sequential, make in ((False, pack.greedy_batches), (True, pack.sequential_batches)):
        out = make(df, "i", "t", limit, most, "s")
        assert {(r["shard"], r["i"]): r["batch_id"] for r in out.collect()} == plain_batches(rows, limit, most, sequential)
        many = make(df, "i", "t", limit, 10**9, "s")
        assert {(r["shard"], r["i"]): r["batch_id"] for r in many.collect()} == plain_batches(rows, limit, 10**9, sequential)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "SinglePartition" not in plan


@pytest.mark.parametrize("n,span,seconds", [(0, 10, 5), (500, 3000, 60), (3000, 200, 7), (500, 100_000, 3600), (50, 40, 0)])
def test_cooldown_equals_the_fold(spark, monkeypatch, n, span, seconds):
    """Over small Arrow batches, with ties, null keys and null times."""
    rng = random.Random(n)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, rng.randrange(span), rng.randrange(span)]), i) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, seconds long, value long").repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    got = alerts.cooldown(df, "k", "seconds", seconds).collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want, last = [], {}
    for k, t, _ in sorted((r for r in rows if r[1] is not None), key=lambda r: (str(r[0]), r[1])):
        if k not in last or t - last[k] >= seconds:
            last[k] = t
            want.append((k, t))
    if not seconds:
        want = [(k, t) for k, t, _ in rows]
    assert sorted(((r["k"], r["seconds"]) for r in got), key=str) == sorted(want, key=str)
    assert set(map(tuple, got)) <= set(rows)
