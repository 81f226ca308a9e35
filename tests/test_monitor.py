"""A monitor whose handlers fail."""

import time

import pytest

from convoy.operators import alerts
from convoy.streaming.monitor import Monitor

SCHEMA = "alert_type string, ts timestamp, value double"


@pytest.fixture
def values(spark, tmp_path):
    spark.sql("select 'budget_threshold' as alert_type, timestamp'2024-01-01' as ts, 0.8D as value union all select 'budget_threshold', timestamp'2024-01-02', 0.99D union all select 'daily_limit', timestamp'2024-01-02', 11D").coalesce(1).write.parquet(f"{tmp_path}/in")
    return spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")


def test_a_failing_handler_gets_each_alert_once(spark, values, tmp_path):
    m = Monitor(values, alerts.rules(spark), f"{tmp_path}/m", seconds=0)
    first, second, other, urgent = [], [], [], []

    def fails_once(found):
        if not second:
            second.append(None)
            raise RuntimeError("down")
        second.append(found.count())

    m.handle("budget_threshold", lambda found: first.append(found.count()))
    m.handle("budget_threshold", fails_once)
    m.handle("daily_limit", lambda found: other.append(found.count()))
    m.suspension = lambda found: urgent.append(found.count())
    with pytest.raises(Exception, match="down"):
        m.start(once=True).awaitTermination()
    assert (first, second, other, m.errors) == ([5], [None], [], 1) and not m.suspended
    m.start(once=True).awaitTermination()
    assert (first, second, other, urgent, m.errors) == ([5], [None, 5], [1], [1], 0) and m.suspended
    stored = spark.read.parquet(f"{tmp_path}/m/alerts")
    assert stored.count() == 6 == stored.select("alert_id").distinct().count()


def test_stop_doesnt_wait_for_the_next_try(spark, values, tmp_path):
    m = Monitor(values, alerts.rules(spark), f"{tmp_path}/m", seconds=60)

    def fails(found):
        raise RuntimeError("down")

    m.handle("daily_limit", fails)
    m.start()
    for _ in range(300):
        if m.errors:
            break
        time.sleep(0.1)
    began = time.time()
    m.stop()
    assert m.errors == 1 and time.time() - began < 30


def test_state_of_quiet_types_is_forgotten(spark, tmp_path):
    from convoy.streaming import jobs

    schema = "alert_type string, seconds long, value double"
    write = lambda *rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/a")
    write(("x", 0, 1.0), ("x", 10, 2.0), ("x", 4000, 3.0), ("y", 5, 1.0))
    cooled = jobs.cooled_alerts(jobs.file_stream(spark, f"{tmp_path}/a", schema), forget=1)
    query = cooled.writeStream.format("memory").queryName("forgotten").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="200 milliseconds").start()
    held = lambda: [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    try:
        for _ in range(300):
            if 2 in held() and held()[-1] == 0:
                break
            time.sleep(0.1)
        assert 2 in held() and held()[-1] == 0
        write(("x", 4001, 9.0))  # begins anew
        for _ in range(300):
            if spark.table("forgotten").count() == 4:
                break
            time.sleep(0.1)
    finally:
        query.stop()
    rows = sorted((r["alert_type"], r["seconds"]) for r in spark.table("forgotten").collect())
    assert rows == [("x", 0), ("x", 4000), ("x", 4001), ("y", 5)]
