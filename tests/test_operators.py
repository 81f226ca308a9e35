import pytest
from pyspark.sql import functions as F

from convoy.operators import alerts, cache, cost, joins, pack, planning, prepare, sample, stats, trend
from convoy.plans import jobs, model
from convoy.plans.adapters import messages, usage


@pytest.fixture(scope="module")
def chat(spark):
    rows = [("A", i, s, t, c, None) for i, (s, t, c) in enumerate([("USER", "oi", "TEXT"), ("AGENT", "bom dia", "text "), ("USER", "erro", "TEXT"), ("AGENT", "ok", "TEXT"), (" Bot ", "x", "TEXT"), ("USER", "foto", "IMAGE")])]
    rows += [("B", i, s, "t", "TEXT", None) for i, s in enumerate(["USER", "USER", "AGENT"])] + [(None, 0, "USER", "t", "TEXT", None), ("C", 0, None, None, None, None)]
    return spark.createDataFrame(rows, "ticket_id string, seq long, sender string, text string, category string, ticket_created_at timestamp")


def test_prepare(chat):
    got = prepare.prepare_tickets(chat).collect()
    assert [(r["ticket_id"], r["text"], r["sender"]) for r in got] == [("A", "oi bom dia erro ok", "Total: 4 mensagens ({'AGENT': 2, 'USER': 2})")]
    with pytest.raises(ValueError):
        prepare.filter_category(chat.drop("category"))


def test_funnel_counts_every_step(chat):
    got = {r["step"]: r["n"] for r in prepare.filtering_report(chat).collect()}
    assert got == {"raw": 11, "category": 9, "fields": 8, "human": 7, "valid": 4, "tickets": 1}


def test_single_category(spark):
    df = spark.createDataFrame([("x",)] * 3, "categoria string")
    assert stats.shannon_diversity(df).first()["diversity"] == 0
    assert stats.category_summary(df).first()["std"] is None


def test_multilabel(spark):
    pred = spark.createDataFrame([(1, "1, 2"), (2, ""), (3, "3")], "k long, ids string")
    truth = spark.createDataFrame([(1, "2,1"), (2, "1"), (3, "3,4")], "k long, ids string")
    r = stats.multilabel_accuracy(pred, truth, "k", "ids").first()
    assert (r["n"], round(r["exact"], 4), round(r["overlap"], 4), round(r["recall"], 4)) == (3, 0.3333, 0.6667, 0.5)


def test_baseline(spark):
    runs = spark.createDataFrame([("baseline", 0.2, 20.0, 0.9), ("new", 0.1, 20.0, 0.95)], "name string, cost double, minutes double, confidence double")
    assert {r["metric"]: r["improved"] for r in stats.baseline_comparison(runs).collect()} == {"cost": True, "minutes": False, "confidence": True}


def test_taxonomies(spark):
    kind = "id int, technical_name string, display_name string, description string, keywords array<string>, examples array<string>"
    a = spark.createDataFrame([(1, "pay", "Pay", "short", ["x"], [])], kind)
    b = spark.createDataFrame([(1, "pay", "Pay", "much longer", ["x", "y"], ["e"]), (2, "new", "New", "d", [], [])], kind)
    got = {r["technical_name"]: r for r in joins.merge_taxonomies(a, b).collect()}
    assert got["pay"]["description"] == "much longer" and got["pay"]["keywords"] == ["x", "y"] and got["new"]["id"] == 2


def test_samples(spark):
    df = spark.range(300).select(F.col("id"), F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, id)").alias("ts"), F.concat(F.lit("word"), F.col("id") % 7, F.lit(" text"), F.col("id") % 3).alias("text"))
    for n in (1, 50, 299, 300, 400):
        got = sample.stratified(df, n, "id", "ts")
        assert got.count() == got.select("id").distinct().count() == min(n, 300)
    both = sample.hybrid(df, 40, "id", "ts", "text")
    assert both.count() == both.select("id").distinct().count() == 40
    for n in (0, 50, 5000, 9000, 20000, 150000):
        low, high = sample.adaptive_bounds(n)
        assert 0 < low <= high
    with pytest.raises(ValueError):
        sample.target_size(10, 0)


def test_batches(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([10, 10, 90, 10, 10, 10])], "id long, tokens long")
    got = [r["batch_id"] for r in pack.greedy_batches(df, "id", "tokens", limit=40).orderBy("id").collect()]
    assert got == [0, 0, 1, 2, 2, 2]
    fixed = pack.fixed_batches(spark.range(1000).repartition(7), "id", 64)
    assert fixed.filter(F.col("batch_id") != F.floor(F.col("id") / 64)).count() == 0


def test_chunks_cover_the_text():
    words = " ".join(f"word{i}." for i in range(500))
    chunks = pack.split_text(words, 100, 20)
    assert all(words[at : at + len(s)] == s and len(s) // 4 <= 110 for at, s in chunks)
    end = 0
    for at, s in chunks:
        assert at <= end
        end = max(end, at + len(s))
    assert end == len(words) and pack.split_text("", 10, 2) == []


def test_trends(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 1, 1, 2, 2])], "t long, v double")
    assert trend.half_split_trend(df, "v", "t").first()["trend"] == "increasing"
    assert trend.half_split_trend(df.limit(2), "v", "t").first()["trend"] == "insufficient_data"
    assert trend.best_neighbourhood(df, "t", "v").first()["following"] == 1
    files = spark.createDataFrame([(i, 10) for i in range(10)], "atime long, size long")
    assert [r["atime"] for r in trend.eviction_order(files, "size", "atime", 90).orderBy("atime").collect()] == [0, 1, 2]


def test_cooldown(spark):
    df = spark.createDataFrame([("a", 0), ("a", 100), ("a", 3600), ("b", 50), ("a", 7000)], "k string, s long")
    assert sorted((r["k"], r["s"]) for r in alerts.cooldown(df, "k", "s").collect()) == [("a", 0), ("a", 3600), ("b", 50)]


def test_cost(spark, small):
    u = usage(spark, small)
    assert cost.operation_breakdown(u).agg(F.sum("n")).first()[0] == u.count()
    crossings = cost.budget_crossings(u, 0.01, "event_id")
    assert crossings.count() == crossings.select("threshold").distinct().count() == 4
    got = cost.recommendations(spark.createDataFrame([(1, 0.25, 30.0, 0.6, 2)], "id int, cost_per_item double, tokens_per_second double, hit_rate double, workers int"))
    assert got.count() == 4 and got.filter("name = 'reduce cost'").count() == 1
    assert cost.implementation_plan(got).filter("phase = 1").count() <= 5


def test_planning(spark):
    got = planning.profile_for(spark.createDataFrame([(500,), (1001,), (10**7,)], "dataset_size long")).orderBy("dataset_size").collect()
    assert [r["workers"] for r in got] == [2, 4, 64]
    history = spark.createDataFrame([(i, 1000 + i, 4, 1.0 + i) for i in range(8)], "run_id long, dataset_size long, workers int, hours double")
    assert 1.0 <= planning.predict(history, 1000, 4).first()["hours"] <= 5.0


def failing():
    """A model whose calls fail for some texts, made on the executor."""

    def build():
        def call(prompt, text):
            if "bad" in text:
                raise ValueError("bad row")
            return '{"categories": [1], "confidence": 0.9}'

        return call

    return model.CallableModel("failing", build)


def test_model_rows_fail_alone(spark):
    df = spark.createDataFrame([("1", "good"), ("2", "bad")], "ticket_id string, text string")
    got = {r["ticket_id"]: (r["category_ids"], r["confidence"]) for r in jobs.classify(df, failing()).collect()}
    assert got == {"1": ("1", 0.9), "2": ("", 0.0)}


def test_failed_batches_and_chunks_are_left_out(spark):
    df = spark.createDataFrame([(f"{i:02}", "problema" if i < 5 else "bad") for i in range(10)], "ticket_id string, text string")
    keywords = model.KeywordModel()

    def build():
        def call(prompt, text):
            if "bad" in text:
                raise ValueError("bad text")
            return keywords(prompt, text)

        return call

    picky = model.CallableModel("picky", build)
    assert {r["ticket_id"] for r in jobs.classify_batches(df, picky, size=5).collect()} == {f"{i:02}" for i in range(5)}
    chunks = spark.createDataFrame([(i, "oi problema" if i % 2 else "bad") for i in range(12)], "chunk_id int, text string")
    assert jobs.map_reduce(chunks, picky, fan_in=2).first()["result"] == "Saudação\nProblema Técnico"


def test_discovery_and_classification_are_connected(spark):
    df = spark.createDataFrame([("1", "quero ajuda"), ("2", "problema"), ("3", "nada")], "ticket_id string, text string")
    found = jobs.discover(df)
    got = found.first()
    assert [c["id"] for c in got["categories"]] == [1, 2, 3] and got["discovery_stats"]["category_count"] == "few" and got["discovery_stats"]["unique_tickets"] == 3
    rows = {r["ticket_id"]: r for r in jobs.classify_with(df, found).collect()}
    assert rows["2"]["category_names"] == "Problema Técnico" and rows["2"]["category_ids"] == "1"
    assert rows["1"]["category_ids"] == "2,3" and rows["3"]["category_ids"] == "" and rows["3"]["confidence"] == 0.5

    def build():
        return lambda prompt, text: "no JSON"

    assert jobs.discover(df, model.CallableModel("mute", build)).count() == 0


def test_summary_has_its_bullets(spark):
    df = spark.createDataFrame([("1", "quero ajuda"), ("2", "problema")], "ticket_id string, text string")
    got = jobs.summarise(df).first()
    assert len(got["bullets"]) == 15 and got["resumo"] and got["issues"] == []
    assert jobs.compress(spark.createDataFrame([("Saudação\nx",)], "result string")).first()["result"] == "Saudação"


def test_sequential_batches(spark):
    from convoy.operators import pack

    df = spark.createDataFrame([(i, 10) for i in range(7)], "id long, tokens long")
    got = [r["batch_id"] for r in pack.sequential_batches(df, "id", "tokens", 25, 50).orderBy("id").collect()]
    assert got == [0, 0, 0, 1, 1, 1, 2]  # the header of 2 tokens counts in the first batch only, which needs a third row too
    assert [r["batch_id"] for r in pack.sequential_batches(df, "id", "tokens", 1000, 3).orderBy("id").collect()] == [0, 0, 0, 1, 1, 1, 2]


def test_cache_guard_and_keys(spark, tmp_path):
    rows = [("a", 60, "2024-01-01 00:00:00"), ("b", 30, "2024-01-04 12:00:00")]
    entries = spark.createDataFrame(rows, "key string, size long, t string").selectExpr("key", "size", "cast(t as timestamp) created_at")
    now = F.to_timestamp(F.lit("2024-01-05 00:00:00"))
    new = lambda n: spark.createDataFrame([("c", n, "2024-01-05 00:00:00")], "key string, size long, t string").selectExpr("key", "size", "cast(t as timestamp) created_at")
    kept = lambda n: {r["key"] for r in cache.guarded(entries, new(n), 100, now).collect()}
    assert kept(10) == {"a", "b", "c"} and kept(20) == {"b", "c"}
    path = tmp_path / "m.csv"
    path.write_text("a")
    first = cache.source_key(spark, f"file://{path}", "x")
    assert first == cache.source_key(spark, f"file://{path}", "x") != cache.source_key(spark, f"file://{path}", "y")
    path.write_text("ab")
    assert cache.source_key(spark, f"file://{path}", "x") != first
    (tmp_path / "z.gz").write_text("")
    assert cache.file_counts(spark, f"file://{tmp_path}") == (1, 1)
    assert cache.retained(entries.withColumnRenamed("created_at", "ts"), now).count() == 1


def test_prediction_prefers_recent_runs(spark):
    history = spark.createDataFrame([(1, 1000, 4, 2.0, 1), (2, 1000, 4, 4.0, 300)], "run_id long, dataset_size long, workers int, hours double, days int")
    assert abs(planning.predict(history, 1000, 4).first()["hours"] - (2 + 0.1 * 4) / 1.1) < 1e-9
    assert planning.predict(history, 10, 4).first()["confidence"] == 0.1


def test_comprehensive_analysis(spark):
    from convoy.operators import roi

    got = roi.comprehensive(spark, 5000, budget=1000.0, hours=10.0)
    assert set(got) == {"projection", "scenarios", "recommendations", "automation", "scaling", "budget", "time"}
    assert all(df.count() > 0 for df in got.values()) and got["projection"].count() == 3
    parts = spark.range(1).select(*(c.alias(n) for n, c in roi.cost_parts(F.lit(1e6), F.lit(1e6), F.lit(2), F.lit(10.0), F.lit(1.0), "cloud", transfer=F.lit(1.0)).items())).first()
    assert abs(parts["total"] - (0.375 + 1.0 + 0.023 + 0.09 + 0.2 + 0.10)) < 1e-9


def test_cached_results(spark, tmp_path):
    df = spark.createDataFrame([(1, "problema"), (2, "problema"), (3, None)], "id long, text string")
    path = f"file://{tmp_path}/cache"
    for _ in range(2):
        got = model.apply_cached(df, model.KeywordModel(), "p", "text", path)
        assert got.count() == 3 and got.filter("result is null").count() == 0
    assert spark.read.parquet(path).count() == 2
    assert cache.health(spark.createDataFrame([(80.0, 0.0, 10, 0, 1, 1, 10)], "hit_rate double, usage double, saves int, errors int, compressed int, files int, points int")).first()["score"] == 100


def test_orchestrate_and_report(spark, small, tmp_path):
    folder = f"file://{tmp_path}/run"
    first = jobs.orchestrate(spark, messages(spark, small), folder).first()
    again = jobs.orchestrate(spark, messages(spark, small), folder).first()
    assert first == again and first["total"] > 0
    tickets = spark.read.parquet(f"{folder}/tickets")
    named = jobs.categorise(tickets, {i + 1: n for i, (n, _) in enumerate(model.KEYWORD_RULES)})
    jobs.report(spark, named.union(spark.createDataFrame([("t", "x")], "a string, b string")), f"{folder}/report")
    assert spark.read.csv(f"{folder}/report/summary", header=True, sep=";").count() == 1
    assert jobs.summarise(tickets).first()["result"]
