"""Reports and the loads of what earlier runs left."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from convoy import cli
from convoy.operators import runs
from convoy.plans import jobs
from convoy.plans.model import STORED
from convoy.sources import reports, tables
from convoy.sources.store import ResultStore


@pytest.fixture
def categorised(spark):
    return spark.createDataFrame([(str(i), f"c{i % 3}") for i in range(9)], "ticket_id string, categoria string")


def parts(path, end):
    return [p for p in sorted(Path(path).glob("*")) if p.name.endswith(end)]


def test_report_in_all_formats(spark, categorised, tmp_path):
    summaries = spark.createDataFrame([("[]",), (None,)], "bullets string")
    jobs.report(spark, categorised, f"{tmp_path}/r", final=categorised.limit(6), summarised=summaries)
    text = parts(f"{tmp_path}/r/report_text", ".txt")[0].read_text()
    assert text.startswith("Ticket report\n== summary ==") and "== data_flow ==" in text and "merge_rate: 66.67" in text
    doc = json.loads(parts(f"{tmp_path}/r/report_json", ".json")[0].read_text())
    assert doc["summaries"][0]["bullet_completion"] == 50.0 and len(doc["distribution"]) == 3
    assert spark.read.csv(f"{tmp_path}/r/samples", header=True, sep=";").count() == 9
    reports.sections_csv({"a": categorised.limit(1), "b": summaries}, f"{tmp_path}/s")
    lines = parts(f"{tmp_path}/s", ".csv")[0].read_text().splitlines()
    assert len(lines) == 5 and lines[0].startswith("a,ticket_id")


def test_categorised_file(spark, categorised, tmp_path):
    reports.write_categorised(categorised.orderBy(F.rand(3)), f"{tmp_path}/c")
    raw = parts(f"{tmp_path}/c", ".csv")[0].read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfticket_id;categoria\n0;c0\n1;c1")


def test_loads(spark, categorised, tmp_path):
    assert reports.read_array(spark, f"file://{tmp_path}/none.json", reports.SESSIONS).count() == 0
    (tmp_path / "s.json").write_text(json.dumps([{"session_id": "a", "total_cost_usd": 1.5}, {"session_id": "b"}]))
    assert reports.read_array(spark, f"file://{tmp_path}/s.json", reports.SESSIONS).count() == 2
    (tmp_path / "b.csv").write_text("ticket_id;category;text;sender\n1;TEXT;x;USER\n")
    (tmp_path / "a.csv").write_text("ticket_id;category;text\n1;TEXT;x\n")
    folder = f"file://{tmp_path}"
    assert [p[-5:] for p in reports.inputs_in(spark, folder)] == ["a.csv", "b.csv"] and reports.choose_input(spark, folder, "b.csv").endswith("/b.csv")
    assert reports.load_messages(spark, folder, "b.csv").count() == 1
    with pytest.raises(ValueError, match="sender"):
        reports.load_messages(spark, folder)
    with pytest.raises(FileNotFoundError):
        reports.artefacts(spark, f"{folder}/runs")
    categorised.write.parquet(f"{tmp_path}/runs/categorized")
    assert set(reports.artefacts(spark, f"{folder}/runs")) == {"categorized"}
    with pytest.raises(ValueError, match="xls"):
        tables.read_messages(spark, f"{folder}/old.xls")


def test_integrity_needs_its_columns(categorised):
    with pytest.raises(ValueError, match="categoria"):
        runs.integrity(categorised.drop("categoria"))
    assert runs.insights(categorised.withColumn("bullets", F.lit("[1]")), ["ticket_id"]).count() == 6


def test_cache_commands_change_the_table(spark, tmp_path):
    spark.sql("select 'a' as key, 'r' as result, timestamp'2020-01-01' as created_at union all select 'b', 'r', current_timestamp()").write.parquet(f"{tmp_path}/c")
    cli.run(spark, ["cache", "cleanup", "--table", f"{tmp_path}/c"])
    assert [r["key"] for r in spark.read.parquet(f"{tmp_path}/c").collect()] == ["b"]
    cli.run(spark, ["cache", "clear", "--table", f"{tmp_path}/c"])
    assert spark.read.parquet(f"{tmp_path}/c").count() == 0


def test_exports(spark, small, tmp_path):
    from convoy.operators import alerts, cost
    from convoy.plans import exports
    from convoy.plans.adapters import messages, usage

    u = usage(spark, small)
    exports.cost_report(u, "user_id", f"{tmp_path}/cost")
    assert {line.split(",")[0] for line in parts(f"{tmp_path}/cost", ".csv")[0].read_text().splitlines()} == {"SUMMARY", "SESSIONS", "OPERATIONS"}
    exports.dashboard(u, "user_id", f"{tmp_path}/dash", sizes=[1000, 5000])
    doc = json.loads(parts(f"{tmp_path}/dash/json", ".json")[0].read_text())
    assert set(doc) >= {"totals", "operations", "shares", "sessions", "comparison", "trends", "recommendations"}
    values = u.select(F.lit("daily_limit").alias("alert_type"), "ts", F.col("input_tokens").cast("double").alias("value"))
    exports.alert_report(alerts.check(values, alerts.rules(spark)), f"{tmp_path}/alerts")
    recs = cost.recommendations(spark.createDataFrame([(1, 0.25, 30.0, 0.6, 2)], "id int, cost_per_item double, tokens_per_second double, hit_rate double, workers int")).withColumn("category", F.lit("cost"))
    exports.recommendation_report(recs, f"{tmp_path}/recs")
    assert json.loads(parts(f"{tmp_path}/recs", ".json")[0].read_text())["totals"][0]["recommendations"] == 4
    shots = spark.sql("select timestamp'2024-01-02' as ts, 40.0D as hit_rate, 95.0D as usage, 20000 as files, 1 as compressed")
    exports.cache_report(shots, f"{tmp_path}/cache")
    exports.cache_metrics(shots, f"{tmp_path}/metrics")
    assert len(json.loads(parts(f"{tmp_path}/cache", ".json")[0].read_text())["alerts"]) == 3
    run = spark.sql("select 0.01D as discovery_cost, 0.02D as application_cost, 0.05D as total_cost, 100 as tickets, 5 as categories, 90.0D as total_time, 30.0D as discovery_time, 50.0D as application_time, 0.9D as confidence, 0.9D as coverage, 0.9D as consistency")
    exports.run_metrics(run, f"{tmp_path}/run")
    exports.validation_report(run, f"{tmp_path}/valid")
    assert json.loads(parts(f"{tmp_path}/run", ".json")[0].read_text())["metrics"][0] == {"tickets": "100", "total_cost": "5.00¢", "cost_per_1k": "0.5000", "time": "1.5 min", "confidence": "90.0%", "bottleneck": "application"}
    m = messages(spark, small)
    exports.quality_report(m, f"{tmp_path}/quality")
    exports.scaling_report(spark, 5000, f"{tmp_path}/scaling")
    cats = m.select("ticket_id", F.col("sender").alias("categoria"))
    assert set(exports.analysis_tables(cats, m)) >= {"original", "cross", "coverage", "distribution"}


def test_chunks_and_tasks(spark):
    import pandas as pd

    from convoy.plans import chunks

    def total(pdf, number):
        if number == 1:
            raise ValueError("bad chunk")
        return pd.DataFrame({"total": [int(pdf["id"].sum())]})

    got = chunks.map_chunks(spark.range(25), "id", 10, total, "total long")
    rows = {r["chunk"]: (r["total"], r["error"]) for r in got.collect()}
    assert rows == {0: (45, None), 1: (None, "ValueError: bad chunk"), 2: (110, None)}
    merged = chunks.merge_chunks(got.withColumn("k", F.lit(1)), "k", lambda pdf: pd.DataFrame({"total": [pdf["total"].sum()]}), "total long")
    assert merged.first()["total"] == 155
    maps = spark.createDataFrame([({"a": 1, "b": 2},), ({"a": 0},)], "m map<string,int>")
    assert {r["key"]: r["values"] for r in chunks.merge_maps(maps, "m").collect()} == {"a": [0, 1], "b": [2]}
    tasks = chunks.map_tasks(spark.range(6), lambda r: {"half": r["id"] // (r["id"] - 3)}, "half long", 3)
    assert tasks.filter("error is not null").count() == 1 and tasks.count() == 6


def test_positions_and_sums(spark):
    from convoy.operators import ordered, trend

    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 5).alias("v")).repartition(7)
    got = {r["k"]: r["position"] for r in ordered.positions(df, "k").collect()}
    assert got == {i: i for i in range(1000)}
    values = {r["k"]: r["v"] for r in df.collect()}
    run, want = 0, {}
    for k in range(1000):
        run += values[k]
        want[k] = run
    assert {r["k"]: r["running"] for r in ordered.running_sum(df, "v", "k").collect()} == want
    assert abs({r["k"]: r["running"] for r in trend.running_mean(df, "v", "k").collect()}[999] - run / 1000) < 1e-9


def test_monitor(spark, tmp_path):
    from convoy.operators import alerts
    from convoy.streaming.monitor import Monitor

    schema = "alert_type string, ts timestamp, value double"
    spark.sql("select 'budget_threshold' as alert_type, timestamp'2024-01-01' as ts, 0.8D as value union all select 'budget_threshold', timestamp'2024-01-02', 0.99D").write.parquet(f"{tmp_path}/in")
    seen, urgent = [], []
    m = Monitor(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), alerts.rules(spark), f"{tmp_path}/m", seconds=0)
    m.handle("budget_threshold", lambda found: seen.append(found.count()))
    m.suspension = lambda found: urgent.append(found.count())
    m.start(once=True).awaitTermination()
    m.stop()
    assert sum(seen) == 5 and urgent == [1] and m.suspended
    assert spark.read.parquet(f"{tmp_path}/m/alerts").count() == 5


def test_small_tables(spark, small, tmp_path):
    from convoy.operators import cost, planning, sample

    metrics = spark.createDataFrame([(0.05, 0.0, 3.0, 1.0, 0.03)], "kl double, sender_diff double, mean_diff double, std_diff double, share double")
    lines = [r["line"] for r in sample.report_lines(metrics, 0.9).orderBy("nr").collect()]
    assert lines[3] == "| months (KL) | 0.0500 | excellent |" and lines[-1].endswith("diverse |")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    plan = planning.plan_for(docs, None, 8, 16.0).first()
    assert plan["valid"] and plan["workers"] >= 1 and plan["issues"] == []
    for _ in range(2):
        cost.record_operation(spark, f"{tmp_path}/log", "classify", 100, 10)
    assert cost.operation_breakdown(spark.read.parquet(f"{tmp_path}/log")).first()["n"] == 2
    tables.write_spill(docs.limit(3), f"{tmp_path}/spill")
    assert spark.read.parquet(f"{tmp_path}/spill").count() == 3
    assert tables.row_json(spark.sql("select 1 as a, timestamp'2024-01-02 03:04:05' as t")).first()["json"] == '{"a":1,"t":"2024-01-02T03:04:05"}'


def test_cached_classification(spark, tmp_path):
    tickets = spark.createDataFrame([("1", "problema"), ("2", "problema"), ("3", "oi")], "ticket_id string, text string")
    taxonomy = jobs.discover(tickets)
    for _ in range(2):
        got = {r["ticket_id"]: r["category_ids"] for r in jobs.classify_cached(tickets, taxonomy, f"file://{tmp_path}/cache").collect()}
        assert got == {"1": "2", "2": "2", "3": "1"}
    assert ResultStore(spark, f"file://{tmp_path}/cache", STORED).read().count() == 2
