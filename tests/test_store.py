"""Results by key: which files a look-up reads, several writers, merged runs."""

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from convoy.plans.model import CallableModel, apply_cached
from convoy.sources.store import ResultStore


def test_look_ups_read_the_buckets_they_hit(spark, tmp_path):
    store = ResultStore(spark, f"file://{tmp_path}/s", "key string, result string", buckets=16)
    rows = spark.range(400).select(F.col("id").cast("string").alias("key"), (F.col("id") * 2).cast("string").alias("result"))
    assert store.get(rows.select("key")).count() == 0 and store.read().count() == 0
    store.put(rows.filter("key % 2 = 0"))
    store.put(rows.filter("key % 2 = 1"))
    keys = spark.createDataFrame([("7",), ("7",), ("-1",)], "key string")
    got = store.get(keys)
    assert [tuple(r) for r in got.collect()] == [("7", "14")]
    every = len(store._every(store.runs()).inputFiles())
    buckets = {r["b"] for r in keys.select(store.bucket().alias("b")).collect()}
    scan = got._jdf.queryExecution().executedPlan().toString()
    read = store._every(store.runs()).filter(F.col("bucket").isin(list(buckets)))
    assert every == 32 and "PartitionFilters" in scan
    held = read.select(F.input_file_name().alias("f")).distinct().count()
    assert held == 2 * len(buckets)
    assert ResultStore(spark, f"file://{tmp_path}/s", "key string, result string", buckets=5).buckets == 16


def test_the_earliest_result_counts_and_runs_merge(spark, tmp_path):
    store = ResultStore(spark, f"file://{tmp_path}/s", "key string, result string", buckets=4, fan_in=3)
    write = lambda i: store.put(spark.createDataFrame([("same", f"r{i}"), (f"own{i}", None)], "key string, result string"))
    write(0)
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(write, range(1, 6)))
    before = sorted(map(tuple, store.read().collect()), key=str)
    assert ("same", "r0") in before and len(before) == 7 and len(store.runs()) == 6
    store.compact()
    assert sorted(map(tuple, store.read().collect()), key=str) == before and len(store.runs()) == 1


def test_stored_texts_need_no_call(spark, tmp_path):
    log = f"{tmp_path}/calls"

    def build():
        def call(prompt, text):
            with open(log, "a") as f:
                f.write("x")
            if text == "bad":
                raise ValueError("no")
            return f"[{text}]"

        return call

    model, path = CallableModel("m", build), f"file://{tmp_path}/cache"
    texts = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "bad")], "id long, text string")
    for n in (1, 2):
        got = {r["id"]: r["result"] for r in apply_cached(texts, model, "p", "text", path).collect()}
        assert got == {1: "[a]", 2: "[a]", 3: "[]" if got[3] == "[]" else "[None]", 4: None}
        assert len(open(log).read()) == 3 + (n - 1)  # the failed one is tried again
    assert {r["result"] for r in apply_cached(texts.filter("id = 1"), model, "other", "text", path).collect()} == {"[a]"} and len(open(log).read()) == 5
