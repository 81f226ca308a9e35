import zipfile

from pyspark.sql import functions as F

from convoy.functions.numbers import token_cost
from convoy.plans.adapters import messages, usage
from convoy.sources import tables
from convoy.streaming import jobs


def test_csv(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_bytes("﻿ticket_id;category;text;sender\n1;TEXT;olá;USER\n2;TEXT;null;USER\n3;TEXT\n4;TEXT;a;b;c\n".encode())
    rows = {r["ticket_id"]: r for r in tables.read_messages(spark, str(p)).collect()}
    assert set(rows) == {"1", "2", "3"}
    assert rows["1"]["text"] == "olá" and rows["2"]["text"] is None and rows["3"]["sender"] is None
    (tmp_path / "c.csv").write_bytes("ticket_id,category,text,sender\n1,TEXT,ação,USER\n".encode("latin-1"))
    assert tables.read_messages(spark, str(tmp_path / "c.csv")).first()["text"] == "ação"


def test_json_and_xlsx(spark, tmp_path):
    (tmp_path / "m.json").write_text('[{"ticket_id": 1, "text": "a"}, {"ticket_id": 2, "text": "b"}]')
    assert tables.read_messages(spark, str(tmp_path / "m.json")).count() == 2
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>%s</sheetData></worksheet>'
    cell = lambda r, v: f'<c r="{r}" t="inlineStr"><is><t>{v}</t></is></c>'
    with zipfile.ZipFile(tmp_path / "m.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet % f'<row>{cell("A1", "ticket_id")}{cell("B1", "text")}</row><row>{cell("A2", "7")}{cell("B2", "x")}</row><row>{cell("B3", "y")}</row>')
    got = tables.read_messages(spark, str(tmp_path / "m.xlsx")).collect()
    assert [(r["ticket_id"], r["text"]) for r in got] == [("7", "x"), (None, "y")]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a"]), (2, [])], "k long, v array<string>")
    tables.write_csv(df, f"{tmp_path}/out", order=["k"], one_file=True)
    assert spark.read.csv(f"{tmp_path}/out", header=True, sep=";").count() == 2
    assert {r["metric"] for r in tables.metric_rows(df.agg(F.count("*").alias("n"), F.max("k").alias("m"))).collect()} == {"n", "m"}


def test_streams_equal_batches(spark, small, tmp_path):
    events = usage(spark, small)
    events.write.parquet(f"{tmp_path}/u")
    stream = jobs.file_stream(spark, f"{tmp_path}/u", events.schema)
    cost = token_cost(F.col("input_tokens"), F.col("output_tokens"))
    want = events.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"), F.sum(cost).alias("c")).count()
    hours = jobs.run_available(jobs.hourly_usage(stream.withColumn("ts", F.col("ts").cast("timestamp"))), "hours", "complete")
    assert hours.count() == want and hours.agg(F.sum("n")).first()[0] == events.count()
    found = jobs.run_available(jobs.user_sessions(stream.withColumn("ts", F.col("ts").cast("timestamp"))), "sessions", "append")
    assert found.columns == ["user_id", "start", "end", "n", "cost_usd"]


def test_stream_messages_and_cooldown(spark, small, tmp_path):
    m = messages(spark, small)
    m.write.parquet(f"{tmp_path}/m")
    kept = jobs.run_available(jobs.messages(jobs.file_stream(spark, f"{tmp_path}/m", m.schema)), "kept")
    assert kept.count() > 0
    a = spark.createDataFrame([("x", 0, 1.0), ("x", 10, 2.0), ("x", 4000, 3.0), ("y", 5, 1.0)], "alert_type string, seconds long, value double")
    a.write.parquet(f"{tmp_path}/a")
    got = jobs.run_available(jobs.cooled_alerts(jobs.file_stream(spark, f"{tmp_path}/a", a.schema)), "cooled")
    assert sorted((r["alert_type"], r["seconds"]) for r in got.collect()) == [("x", 0), ("x", 4000), ("y", 5)]
