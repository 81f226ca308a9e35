"""Registered queries of runs, returns, cache reports, allocation and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alerts, cache, cost, planning, roi, runs, trend
from .adapters import CATEGORISED, MESSAGES, RESULTS, SIZES, USAGE, categorised, messages, results, sizes, table, usage
from .catalogue import _round, query

#: The planning model's total for a size n with w workers and h hours, on local machines.
_TOTAL = "n * 2000 / 1000.0 * 0.000075 + n * 200 / 1000.0 * 0.0003 + w * h * 0.001 + n * 0.5 / 1024 * 0.023 + 0.10"
_HOURS = "greatest(0.1, n / (w * (100 * greatest(0.5, 1.0 - (w - 1) * 0.02))))"
_WORKERS = "CASE WHEN n < 1000 THEN 2 WHEN n < 10000 THEN 4 WHEN n < 50000 THEN 8 WHEN n < 100000 THEN 16 WHEN n < 500000 THEN 32 ELSE 64 END"
_LINEAR = f"l AS (SELECT n, w, {_TOTAL} AS total, ({_TOTAL}) / n AS each FROM (SELECT n, w, {_HOURS} AS h FROM (SELECT n, {_WORKERS} AS w FROM z)))"


def _text(c: str):
    return F.array_join(c, "; ").alias(c)


# --- returns


@query("""WITH o AS (SELECT o_orderkey AS id, 1 + o_custkey % 5000 AS n, 1 + o_orderkey % 90 / 10.0 AS m, o_custkey % 60 / 10.0 AS a, CAST(o_orderkey % 3000 AS DOUBLE) AS s, o_custkey % 40 / 1.0 AS h FROM orders), x AS (
    SELECT *, n * m AS mt, n * a + s AS tt FROM o), y AS (SELECT *, mt - tt AS direct, mt - tt + h * 50 AS total FROM x)
    SELECT id, round(direct, 6) AS direct_savings, round(total, 6) AS total_savings, round(CASE WHEN tt > 0 THEN total / tt * 100 ELSE 0 END, 6) AS roi_percent, round(s / greatest(0.01, m - a), 6) AS payback_tickets,
           round(CASE WHEN mt > 0 THEN direct / mt * 100 ELSE 0 END, 6) AS reduction_percent, total > 0 AS profitable, round(m / greatest(0.01, a), 6) AS gain FROM y""")
def automation_roi(spark, d):
    o = table(spark, d, "orders")
    rows = o.select(F.col("o_orderkey").alias("id"), (1 + F.col("o_custkey") % 5000).alias("dataset_size"), (1 + F.col("o_orderkey") % 90 / 10).alias("manual_cost"), (F.col("o_custkey") % 60 / 10).alias("automated_cost"),
                    (F.col("o_orderkey") % 3000).cast("double").alias("implementation"), (F.col("o_custkey") % 40).cast("double").alias("hours_saved"))
    out = roi.automation_roi(rows).select("id", "direct_savings", "total_savings", "roi_percent", "payback_tickets", "reduction_percent", "profitable", "gain")
    return _round(out, "direct_savings", "total_savings", "roi_percent", "payback_tickets", "reduction_percent", "gain")


_SCALING = f"""z AS (SELECT * FROM {SIZES} t(n)), {_LINEAR}, b AS (SELECT each FROM l WHERE n = 1000),
    s AS (SELECT CAST(l.n AS BIGINT) AS dataset_size, l.n * b.each AS naive, total + 1000 / CAST((SELECT count(*) FROM z) AS DOUBLE) AS optimized, l.each AS each FROM l, b)"""


@query(f"""WITH {_SCALING} SELECT dataset_size, round(naive, 6) AS naive_cost, round(optimized, 6) AS optimized_cost, round(naive - optimized, 6) AS savings, round((naive - optimized) / optimized * 100, 6) AS roi_percent, round(each, 6) AS cost_per_ticket FROM s""")
def scaling_roi(spark, d):
    return _round(roi.scaling_roi(sizes(spark, d), 1000), "naive_cost", "optimized_cost", "savings", "roi_percent", "cost_per_ticket")


@query(f"""WITH {_SCALING} SELECT round(sum(naive - optimized), 2) AS total_savings, round(avg((naive - optimized) / optimized * 100), 6) AS mean_roi, arg_min(dataset_size, each) AS best_size FROM s""")
def scaling_summary(spark, d):
    return _round(_round(roi.scaling_summary(roi.scaling_roi(sizes(spark, d), 1000)), "mean_roi"), "total_savings", places=2)


@query(f"""WITH z AS (SELECT n, name, w, cloud FROM {SIZES} y(n), (VALUES ('Conservative', 4, 0), ('Balanced', 8, 0), ('Aggressive', 16, 1)) t(name, w, cloud)), h AS (SELECT *, {_HOURS} AS h FROM z)
    SELECT n AS dataset_size, name, w AS workers, round(h, 6) AS hours, round({_TOTAL} + cloud * (w * h * 0.049 + h * 0.02), 9) AS total FROM h""")
def scaling_scenarios(spark, d):
    return _round(_round(roi.scenarios(sizes(spark, d)).select("dataset_size", "name", "workers", "hours", "total"), "hours"), "total", places=9)


@query(f"""WITH z AS (SELECT * FROM {SIZES} t(n)), {_LINEAR}, x AS (SELECT arg_min(n, each) AS best, avg(w) AS w, arg_max(each, n) - arg_min(each, n) AS trend FROM l)
    SELECT 0 AS nr, 'most efficient size: ' || CAST(best AS VARCHAR) AS recommendation FROM x UNION ALL SELECT 1, CASE WHEN trend < 0 THEN 'economies of scale' ELSE 'diseconomies of scale' END FROM x
    UNION ALL SELECT 2, CASE WHEN w > 16 THEN 'many workers: watch coordination' ELSE 'few workers: raise parallelism' END FROM x WHERE w > 16 OR w < 4""")
def efficiency_recommendations(spark, d):
    return roi.efficiency_recommendations(cost.linear_projection(sizes(spark, d)))


@query("""WITH s AS (SELECT o_orderkey AS id, o_custkey % 30 / 200.0 AS c, CAST(o_orderkey % 120 AS DOUBLE) AS b, CAST(o_custkey % 15 AS DOUBLE) AS day, CAST(o_custkey % 900 AS DOUBLE) AS s FROM orders)
    SELECT id, CASE WHEN b >= 95 THEN 'critical' WHEN b >= 75 THEN 'warning' WHEN b >= 50 THEN 'caution' ELSE 'healthy' END AS budget_status, CASE WHEN c > 0.1 THEN 'attention' WHEN c > 0.05 THEN 'warning' ELSE 'good' END AS efficiency_status,
           concat_ws('; ', CASE WHEN c <= 0 THEN NULL WHEN c < 0.01 THEN 'excellent cost for each item' WHEN c < 0.05 THEN 'good cost for each item' ELSE 'high cost for each item' END,
                     CASE WHEN day > 10 THEN 'high daily projection' END, CASE WHEN s > 500 THEN 'excellent efficiency score' END) AS insights FROM s""")
def cost_indicators(spark, d):
    k = F.col("o_custkey")
    s = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (k % 30 / 200).alias("cost_per_item"), (F.col("o_orderkey") % 120).cast("double").alias("budget_percent"), (k % 15).cast("double").alias("daily_cost"), (k % 900).cast("double").alias("score"))
    return roi.indicators(s).select("id", "budget_status", "efficiency_status", _text("insights"))


_FACTOR = "CASE option WHEN 'discovery_only' THEN 0.6 WHEN 'application_only' THEN 0.8 WHEN 'parallel_discovery' THEN 0.7 WHEN 'optimized_application' THEN 0.85 ELSE 1.0 END"
_BEST = f"""g AS (SELECT n, option FROM {SIZES} z(n), (VALUES ('discovery_only'), ('application_only'), ('parallel_discovery'), ('optimized_application'), ('discovery_application')) o(option)), c AS (
    SELECT CAST(n AS BIGINT) AS n, option, CAST(0.048 AS DOUBLE) * CAST({_FACTOR} AS DOUBLE) * CAST(CASE WHEN n <= 1000 THEN 1.1 WHEN n <= 10000 THEN 1.0 WHEN n <= 50000 THEN 0.95 WHEN n <= 100000 THEN 0.92 ELSE 0.90 END AS DOUBLE) * CAST(0.95 AS DOUBLE) * n AS cost FROM g),
    b AS (SELECT n, min(cost) / n AS each, arg_min(option, cost) AS best, max(cost) - min(cost) AS savings FROM c GROUP BY n)"""


def _projected(spark, d):
    return cost.project(cost.scenarios_of(sizes(spark, d), list(cost.OPTION_FACTORS), [4]))


@query(f"""WITH {_BEST}, r AS (SELECT *, row_number() OVER (ORDER BY n) AS i, (lead(each) OVER (ORDER BY n) - each) / (lead(n) OVER (ORDER BY n) - n) AS step FROM b), m AS (SELECT arg_min(i, (each, n)) AS i FROM r)
    SELECT round((SELECT each FROM r ORDER BY n LIMIT 1) / (SELECT each FROM r ORDER BY n DESC LIMIT 1), 6) AS scale_efficiency, (SELECT n FROM r, m WHERE r.i = m.i) AS optimal_size, (SELECT n FROM r, m WHERE r.i = greatest(1, m.i - 1)) AS min_efficient,
           (SELECT n FROM r, m WHERE r.i = least((SELECT max(i) FROM r), m.i + 1)) AS max_efficient, (SELECT min(n) FROM r WHERE step > -1e-6) AS diminishing_from, 'discovery_only' AS option""")
def size_comparison(spark, d):
    return _round(roi.size_comparison(_projected(spark, d)).drop("linear"), "scale_efficiency")


@query(f"""WITH {_BEST} SELECT 'best option: discovery_only' AS recommendation UNION ALL SELECT 'size ' || CAST(n AS VARCHAR) || ': the best option saves more than 100 USD' FROM b WHERE savings > 100""")
def comparison_recommendations(spark, d):
    return roi.comparison_recommendations(_projected(spark, d))


@query("""WITH s AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS i FROM orders), h AS (SELECT o_orderkey AS id, o_custkey % 100 AS n, o_totalprice AS c FROM orders),
    r AS (SELECT *, row_number() OVER (ORDER BY id DESC) AS i, count(*) OVER () AS k FROM h)
    SELECT CAST(sum(n) AS BIGINT) AS items, round(sum(c), 4) AS cost, round(sum(c) / greatest(sum(n), 1), 6) AS cost_per_item, count(*) AS sessions, CASE WHEN avg(c) FILTER (WHERE i <= 3) < avg(c) FILTER (WHERE i > 3) THEN 'improving' ELSE 'stable' END AS trend,
           CASE WHEN count(DISTINCT c) FILTER (WHERE i <= 5) < 3 THEN 'stable' ELSE 'variable' END AS stability FROM r""")
def history_context(spark, d):
    h = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 100).alias("dataset_size"), F.col("o_totalprice").alias("total_cost_usd"))
    return _round(_round(roi.history_context(h, "id").drop("recent", "older"), "cost_per_item"), "cost", places=4)


@query("""WITH o AS (SELECT o_orderkey AS id, 1 + o_custkey % 3000 AS n, o_orderkey % 2000 * 4 AS t, o_custkey % 130 * 1.0 AS c FROM orders), x AS (SELECT id, CASE WHEN c > 0 THEN t ELSE (CASE WHEN t > 0 THEN t ELSE 1000 END) * n END AS k, c FROM o),
    y AS (SELECT id, k, CASE WHEN c > 0 THEN c ELSE k / 1000.0 * 0.25 END AS p FROM x)
    SELECT id, CAST(k AS BIGINT) AS projected_tokens, round(p, 4) AS projected_cost, round(p * 0.8, 4) AS conservative, round(p * 1.2, 4) AS pessimistic, concat_ws('; ', CASE WHEN p > 50 THEN 'over 50 USD' END, CASE WHEN p > 100 THEN 'over 100 USD' END) AS alerts FROM y""")
def pipeline_projection(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (1 + F.col("o_custkey") % 3000).alias("dataset_size"), (F.col("o_orderkey") % 2000 * 4).alias("tokens"), (F.col("o_custkey") % 130).cast("double").alias("cost"))
    return roi.pipeline_projection(o).select("id", "projected_tokens", "projected_cost", "conservative", "pessimistic", _text("alerts"))


_PHASE = "CASE event_type WHEN 'click' THEN 'map' WHEN 'view' THEN 'combine' ELSE 'classify' END"


def _phases(spark, d):
    kind = F.col("operation_type")
    return usage(spark, d).withColumn("phase", F.when(kind == "click", "map").when(kind == "view", "combine").otherwise("classify"))


@query(f"""WITH {USAGE}, p AS (SELECT CASE operation_type WHEN 'click' THEN 'map' WHEN 'view' THEN 'combine' ELSE 'classify' END AS phase, sum(input_tokens) AS i, sum(output_tokens) AS o, sum(cost_usd) AS c, count(*) AS n FROM uc GROUP BY 1)
    SELECT phase, CAST(i AS BIGINT) AS input_tokens, CAST(o AS BIGINT) AS output_tokens, round(c, 6) AS cost_usd, n AS calls, round(c / greatest(i + o, 1) * 1000, 4) AS cost_per_1k, round(i / CAST(greatest(o, 1) AS DOUBLE), 2) AS input_output_ratio FROM p""")
def phase_report(spark, d):
    return _round(runs.phase_report(_phases(spark, d), "phase"), "cost_usd")


@query(f"""WITH {USAGE}, t AS (SELECT sum(input_tokens) AS i, sum(output_tokens) AS o, sum(cost_usd) AS c, sum(cost_usd) FILTER (WHERE operation_type = 'click') AS m, sum(cost_usd) FILTER (WHERE operation_type = 'view') AS b,
    sum(cost_usd) FILTER (WHERE operation_type NOT IN ('click', 'view')) AS k FROM uc), x AS (
    SELECT 'smaller chunks: input outweighs output' AS recommendation FROM t WHERE i > o * 3 UNION ALL SELECT 'more caching or larger batches: high cost' FROM t WHERE c > 10
    UNION ALL SELECT 'chunk size: the map phase dominates' FROM t WHERE m > b + k UNION ALL SELECT 'batch size: the classify phase dominates' FROM t WHERE k > m + b)
    SELECT * FROM x UNION ALL SELECT 'nothing: token use is efficient' WHERE NOT EXISTS (FROM x)""")
def token_recommendations(spark, d):
    return roi.token_recommendations(runs.phase_report(_phases(spark, d), "phase"))


@query("""SELECT o_orderkey AS id, round(o_custkey / 1000.0 * 0.0003, 9) AS classification, round(o_custkey * 500 / 1000.0 * 0.000075, 9) AS discovery, round(o_custkey * 182 / 1000.0 * 0.000075, 9) AS application FROM orders""")
def flat_estimates(spark, d):
    o = table(spark, d, "orders")
    return _round(o.select(F.col("o_orderkey").alias("id"), *(c.alias(n) for n, c in roi.flat_estimates(F.col("o_custkey"), F.col("o_custkey")).items())), "classification", "discovery", "application", places=9)


@query("""WITH e AS (SELECT event_id, user_id, epoch(date_trunc('second', ts)) AS s, event_id % 3 <> 0 AS start FROM events), st AS (SELECT event_id, s, lead(s) OVER (ORDER BY s, event_id) AS nx FROM e WHERE start),
    en AS (SELECT event_id + 1 AS id, min(s) AS ended FROM e WHERE NOT start GROUP BY 1)
    SELECT event_id AS session_id, CAST(s AS BIGINT) AS start, CAST(least(coalesce(ended, nx), coalesce(nx, ended)) AS BIGINT) AS "end", nx IS NOT NULL AND (ended IS NULL OR nx < ended) AS auto_closed FROM st LEFT JOIN en ON event_id = id""")
def session_events(spark, d):
    start = F.col("event_id") % 3 != 0
    e = table(spark, d, "events").select(F.when(start, F.col("event_id")).otherwise(F.col("event_id") + 1).alias("session_id"), F.when(start, "start").otherwise("end").alias("event"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("seconds"))
    return cost.session_events(e, "session_id")


@query("""WITH s AS (SELECT o_orderkey AS id, o_custkey % 50 AS n, o_totalprice AS c, o_orderkey * 3 AS t, o_custkey % 900 AS sec FROM orders), x AS (
    SELECT id, CASE WHEN n > 0 THEN c / n END AS c, CASE WHEN n > 0 THEN t / CAST(n AS DOUBLE) END AS t, CASE WHEN sec > 0 THEN t / CAST(sec AS DOUBLE) END AS r FROM s), k AS (SELECT c, row_number() OVER (ORDER BY id) AS i, count(*) OVER () AS m FROM x WHERE c IS NOT NULL),
    h AS (SELECT avg(c) FILTER (WHERE i <= m // 2) AS a, avg(c) FILTER (WHERE i > m // 2) AS b FROM k), o AS (SELECT avg(c) AS mean, median(c) AS med, stddev_samp(c) AS std, avg(t) AS t, avg(r) AS r FROM x)
    SELECT round(mean, 4) AS mean_cost, round(med, 4) AS median_cost, CASE WHEN (b - a) / a * 100 > 5 THEN 'increasing' WHEN (b - a) / a * 100 < -5 THEN 'decreasing' ELSE 'stable' END AS trend, round(t, 4) AS tokens_per_item, round(r, 4) AS tokens_per_second,
           round(0.6 / (1 + 100 * mean) + 0.4 * least(r / 200, 1), 6) AS score, round(1 - std / mean, 6) AS consistency FROM o, h""")
def efficiency_patterns(spark, d):
    k = F.col("o_custkey")
    s = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (k % 50).alias("dataset_size"), F.col("o_totalprice").alias("total_cost_usd"), (F.col("o_orderkey") * 3).alias("tokens"), (k % 900).alias("seconds"))
    return _round(_round(cost.efficiency_patterns(s, "id"), "score", "consistency"), "mean_cost", "median_cost", "tokens_per_item", "tokens_per_second", places=4)


@query(f"WITH {USAGE} SELECT round(sum(cost_usd), 6) AS spent FROM uc WHERE epoch(ts) >= (SELECT epoch(max(ts)) FROM uc) - 7 * 86400")
def spent_last_week(spark, d):
    u = cost.with_cost(usage(spark, d)).withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    last = u.agg(F.max("s").alias("last"))  # a single row
    return _round(cost.total_spent(cost.since(u.crossJoin(F.broadcast(last)), "s", F.col("last"), 168)), "spent")


# --- runs


_RUNS = """r AS (SELECT o_orderkey AS id, o_custkey % 50 / 100.0 AS d, o_custkey % 70 / 100.0 AS a, o_custkey % 150 / 100.0 AS t, o_custkey % 3000 AS n, o_orderkey % 30 AS k, CAST(o_custkey % 2000 AS DOUBLE) AS total,
    CAST(o_orderkey % 900 AS DOUBLE) AS disc, CAST(o_custkey % 900 AS DOUBLE) AS appl, o_orderkey % 100 / 100.0 AS conf, o_custkey % 100 / 100.0 AS cov, o_custkey % 90 / 100.0 AS cons FROM orders), m AS (
    SELECT *, CASE WHEN n > 0 THEN t / n * 1000 ELSE 0 END AS per, CASE WHEN total > 0 THEN n / total ELSE 0 END AS tps, CASE WHEN disc > appl THEN 'discovery' WHEN appl > disc THEN 'application' ELSE 'balanced' END AS slow FROM r)"""


def _runs(spark, d):
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    return table(spark, d, "orders").select(
        o.alias("id"), (c % 50 / 100).alias("discovery_cost"), (c % 70 / 100).alias("application_cost"), (c % 150 / 100).alias("total_cost"), (c % 3000).alias("tickets"), (o % 30).alias("categories"), (c % 2000).cast("double").alias("total_time"),
        (o % 900).cast("double").alias("discovery_time"), (c % 900).cast("double").alias("application_time"), (o % 100 / 100).alias("confidence"), (c % 100 / 100).alias("coverage"), (c % 90 / 100).alias("consistency"),
    )


@query(f"""WITH {_RUNS} SELECT id, round(CASE WHEN k > 0 THEN t / k ELSE 0 END, 6) AS cost_per_category, round(per, 6) AS cost_per_1k, round(greatest(0, t - d - a), 6) AS overhead, per <= 0.20 AS meets_cost_target FROM m""")
def run_costs(spark, d):
    return _round(runs.cost_metrics(_runs(spark, d)).select("id", "cost_per_category", "cost_per_1k", "overhead", "meets_cost_target"), "cost_per_category", "cost_per_1k", "overhead")


@query(f"""WITH {_RUNS} SELECT id, round(CASE WHEN n > 0 THEN total / n ELSE 0 END, 6) AS seconds_per_ticket, round(tps, 6) AS tickets_per_second, slow AS bottleneck, total <= 1500 AS meets_time_target FROM m""")
def run_times(spark, d):
    return _round(runs.performance_metrics(_runs(spark, d)).select("id", "seconds_per_ticket", "tickets_per_second", "bottleneck", "meets_time_target"), "seconds_per_ticket", "tickets_per_second")


@query(f"""WITH {_RUNS}, v AS (SELECT *, per <= 0.20 AS c1, total <= 1500 AS c2, conf >= 0.85 AS c3 FROM m)
    SELECT id, c1 AND c2 AND c3 AS compliant, concat_ws('; ', CASE WHEN NOT c1 THEN 'reduce batch sizes or optimise prompts' END, CASE WHEN NOT c1 AND d > a THEN 'reduce the sample or chunk sizes' END, CASE WHEN NOT c2 THEN 'more parallelism in ' || slow END,
           CASE WHEN NOT c3 THEN 'better definitions or more examples' END, CASE WHEN cov < 0.8 THEN 'consolidate unused categories' END, CASE WHEN cons < 0.8 THEN 'review the prompts' END, CASE WHEN tps < 1 THEN 'optimise batches' END) AS recommendations,
           CASE WHEN c1 AND c2 AND c3 THEN 'use in production; monitor; review from time to time' ELSE concat_ws('; ', 'optimise', CASE WHEN NOT c1 THEN 'analyse cost by phase' END, CASE WHEN NOT c2 THEN 'profile the slower phase' END, CASE WHEN NOT c3 THEN 'review categories' END) END || '; compare with one-phase methods' AS next_actions FROM v""")
def validated_runs(spark, d):
    return runs.validate(_runs(spark, d)).select("id", "compliant", _text("recommendations"), _text("next_actions"))


@query(f"""WITH {RESULTS}, m AS (SELECT arm, avg(confidence) AS c, avg(CASE WHEN category_ids <> '' THEN 1 ELSE 0 END) AS r FROM r GROUP BY 1), x AS (SELECT a.c > b.c AS c, a.r > b.r AS r FROM m a, m b WHERE a.arm = 0 AND b.arm = 1)
    SELECT CASE WHEN c AND r THEN 'A' WHEN NOT c AND NOT r THEN 'B' WHEN c THEN 'mixed: A for confidence, B for rate' ELSE 'mixed: B for confidence, A for rate' END AS recommendation FROM x""")
def ab_recommendation(spark, d):
    from ..operators import stats

    return runs.ab_recommendation(stats.ab_metrics(results(spark, d), "arm"), "arm", 0, 1, True)


_RECS = """q AS (SELECT o_orderkey AS name, ['low', 'medium', 'high', 'critical'][1 + o_custkey % 4] AS impact, ['easy', 'moderate', 'complex'][1 + o_custkey % 3] AS complexity, o_custkey % 100 * 1.0 AS saving, o_totalprice AS priority, ['cost', 'speed'][1 + o_orderkey % 2] AS category FROM orders)"""


def _recs(spark, d):
    c = F.col("o_custkey")
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("name"), pick(runs.IMPACTS, c % 4).alias("impact"), pick(runs.COMPLEXITIES, c % 3).alias("complexity"), (c % 100).cast("double").alias("saving"), F.col("o_totalprice").alias("priority"), pick(["cost", "speed"], F.col("o_orderkey") % 2).alias("category"))


@query(f"WITH {_RECS} SELECT name, impact, complexity, saving FROM q WHERE complexity <> 'complex' AND saving >= 30 AND impact IN ('high', 'critical')")
def constrained_recommendations(spark, d):
    return runs.constrained(_recs(spark, d), max_complexity="moderate", min_savings=30, min_impact="high").select("name", "impact", "complexity", "saving")


@query(f"""WITH {_RECS}, f AS (SELECT 'category' AS kind, category AS value, saving FROM q UNION ALL SELECT 'impact', impact, saving FROM q UNION ALL SELECT 'complexity', complexity, saving FROM q) SELECT kind, value, count(*) AS n, sum(saving) AS saving FROM f GROUP BY 1, 2""")
def recommendation_counts(spark, d):
    return runs.recommendation_counts(_recs(spark, d))


@query(f"""WITH {RESULTS}, x AS (SELECT event_id // 100 AS b, category_ids <> '' AS done, confidence, event_id % 50 AS tokens, event_id % 7 / 10.0 AS s FROM r), g AS (SELECT b, avg(CASE WHEN done THEN 1 ELSE 0 END) AS rate FROM x GROUP BY 1)
    SELECT (SELECT count(*) FROM x) AS tickets, (SELECT count(*) FROM g) AS batches, (SELECT CAST(sum(tokens) AS BIGINT) FROM x) AS tokens, (SELECT round(sum(s), 4) FROM x) AS seconds, (SELECT round(avg(rate), 6) FROM g) AS success_rate,
           (SELECT round(sum(tokens) / 1000 * 0.0003, 9) FROM x) AS cost_usd, (SELECT round(avg(confidence), 6) FROM x) AS mean_confidence, (SELECT round(avg(CASE WHEN confidence >= 0.85 THEN 1 ELSE 0 END), 6) FROM x) AS high_share, (SELECT round(sum(tokens) / 1000 * 0.0003 / count(*) * 1000, 9) FROM x) AS cost_per_1k""")
def batch_report(spark, d):
    e = F.col("event_id")
    rows = results(spark, d).select(F.floor(e / 100).alias("batch_id"), "category_ids", "confidence", (e % 50).alias("tokens_used"), (e % 7 / 10).alias("seconds"))
    return _round(_round(_round(runs.batch_report(rows), "success_rate", "mean_confidence", "high_share"), "cost_usd", "cost_per_1k", places=9), "seconds", places=4)


@query(f"WITH {CATEGORISED} SELECT count(*) AS categorised, (SELECT count(*) FROM labels) AS final, round((SELECT count(*) FROM labels) * 100.0 / count(*), 2) AS merge_rate FROM c")
def data_flow(spark, d):
    return runs.data_flow(categorised(spark, d), table(spark, d, "labels"))


@query("SELECT count(*) AS summarised, round(count(*) FILTER (WHERE doc_id % 3 <> 0) * 100.0 / count(*), 2) AS bullet_completion FROM documents")
def summary_quality(spark, d):
    return runs.summary_quality(table(spark, d, "documents").select(F.when(F.col("doc_id") % 3 != 0, "[]").alias("bullets")))


@query("SELECT (SELECT count(*) FROM documents WHERE lang IS NULL) AS empty_categories, (SELECT count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)) AS common_ids")
def integrity(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("ticket_id"), F.col("lang").alias("categoria"))
    return runs.integrity(docs, table(spark, d, "labels").select(F.col("doc_id").alias("ticket_id")))


@query(f"WITH {MESSAGES} SELECT count(*) AS rows, 6 AS columns, round(avg(length(text)), 2) AS mean_length, min(length(text)) AS least_length, max(length(text)) AS most_length, count(*) FILTER (WHERE category = 'TEXT') AS text_messages, count(DISTINCT sender) AS senders FROM m")
def original_analysis(spark, d):
    return runs.original_analysis(messages(spark, d))


@query(f"""WITH {CATEGORISED}, n AS (SELECT categoria, count(*) AS n FROM c GROUP BY 1), s AS (SELECT n / CAST(sum(n) OVER () AS DOUBLE) AS p, n, row_number() OVER (ORDER BY n DESC, categoria) AS r FROM n)
    SELECT count(*) AS categories, round(max(p) * 100, 2) AS dominant_share, round(-sum(p * ln(p + 1e-10)) / ln(count(*)), 6) AS diversity, round(sum(CASE WHEN r <= 5 THEN n END) * 100.0 / sum(n), 6) AS concentration FROM s""")
def category_analysis(spark, d):
    return _round(runs.category_analysis(categorised(spark, d)), "diversity", "concentration")


@query("""SELECT user_id AS run_id, event_type AS phase, min(epoch(ts)) FILTER (WHERE event_id % 2 = 0) AS started, max(epoch(ts)) FILTER (WHERE event_id % 2 = 1) AS ended, round(sum(value), 4) AS cost,
    max(epoch(ts)) FILTER (WHERE event_id % 2 = 1) - min(epoch(ts)) FILTER (WHERE event_id % 2 = 0) AS duration FROM (SELECT * REPLACE (date_trunc('second', ts) AS ts) FROM events) GROUP BY 1, 2""")
def phase_events(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("phase"), F.when(F.col("event_id") % 2 == 0, "start").otherwise("end").alias("event"), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("seconds"), F.col("value").alias("cost"))
    return _round(runs.phase_events(e), "cost", places=4)


# --- cache


def _snapshots(spark, d):
    e = F.col("event_id")
    return table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), (e * 31 % 101).cast("double").alias("hit_rate"), (e * 3 % 101).cast("double").alias("usage"), (e * 7 % 8000).alias("files"), (e % 300).alias("compressed"))


_SNAPSHOTS = "m AS (SELECT event_id, ts, CAST(event_id * 31 % 101 AS DOUBLE) AS hit, CAST(event_id * 3 % 101 AS DOUBLE) AS use, event_id * 7 % 8000 AS files, event_id % 300 AS packed FROM events)"


@query(f"WITH {_SNAPSHOTS} SELECT event_id, round(0.7 * hit / 100 + 0.3 * (1 - use / 100), 6) AS efficiency, round(packed / CAST(greatest(files, 1) AS DOUBLE), 6) AS compression_ratio FROM m")
def cache_patterns(spark, d):
    return _round(cache.patterns(_snapshots(spark, d)).select("event_id", "efficiency", "compression_ratio"), "efficiency", "compression_ratio")


@query(f"""WITH {_SNAPSHOTS}, k AS (SELECT * FROM m WHERE epoch(ts) > (SELECT epoch(max(ts)) FROM m) - 86400) SELECT 'hit_rate' AS series, round(avg(hit), 6) AS mean, min(hit) AS least, max(hit) AS most FROM k
    UNION ALL SELECT 'usage', round(avg(use), 6), min(use), max(use) FROM k UNION ALL SELECT 'files', round(avg(files), 6), CAST(min(files) AS DOUBLE), CAST(max(files) AS DOUBLE) FROM k""")
def cache_report(spark, d):
    m = _snapshots(spark, d)
    since = m.agg((F.max("ts") - F.expr("interval 24 hours")).alias("since"))  # a single row
    return _round(cache.performance_report(m.crossJoin(F.broadcast(since)), F.col("since")).drop("current"), "mean")


@query(f"""WITH {_SNAPSHOTS}, x AS (SELECT event_id, CASE WHEN hit < 50 THEN 'revise keys: very low hit rate' WHEN hit < 70 THEN 'revise policy: low hit rate' END AS recommendation FROM m UNION ALL
    SELECT event_id, CASE WHEN use > 85 THEN 'clean up: nearly full' WHEN use > 70 THEN 'watch growth: fairly full' END FROM m UNION ALL SELECT event_id, CASE WHEN files > 5000 THEN 'compress or delete: many files' END FROM m
    UNION ALL SELECT event_id, CASE WHEN packed / CAST(greatest(files, 1) AS DOUBLE) < 0.1 AND files > 100 THEN 'compress: few files are' END FROM m), y AS (SELECT * FROM x WHERE recommendation IS NOT NULL)
    SELECT * FROM y UNION ALL SELECT event_id, 'go on' FROM m WHERE event_id NOT IN (SELECT event_id FROM y)""")
def cache_recommendations(spark, d):
    return cache.cache_recommendations(_snapshots(spark, d)).select("event_id", "recommendation")


@query("""WITH e AS (SELECT doc_id AS key, length(text) AS size, doc_id % 200 AS age FROM documents), h AS (SELECT sum(size) AS held FROM e) SELECT CAST(held AS BIGINT) AS held, held + 1000 > 100000 AS cleanup FROM h""")
def cache_size_guard(spark, d):
    e = table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.length("text").alias("size"))
    return cache.needs_cleanup(e, 1000, 100_000)


@query("SELECT doc_id AS key FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 100")
def cache_memory(spark, d):
    return cache.most_recent(table(spark, d, "documents").select(F.col("doc_id").alias("key"), "n_chars"), "n_chars", 100).select("key")


@query("SELECT doc_id AS key FROM documents WHERE doc_id % 100 < 72 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def cache_live_entries(spark, d):
    now = F.to_timestamp(F.lit("2024-05-05 00:00:00"))
    entries = table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.timestamp_seconds(F.unix_timestamp(now) - F.col("doc_id") % 100 * 3600).alias("created_at"))
    dropped = table(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("key"))
    return cache.invalidate(cache.live(entries, now, 72), dropped).select("key")


# --- allocation and scaling


@query(r"""WITH t AS (SELECT count(*) AS rows, avg(length(text)) AS l, avg(len(regexp_extract_all(text, '[.!?]'))) AS m, avg(len(regexp_extract_all(text, '[àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ]'))) AS a FROM documents), c AS (
    SELECT count(DISTINCT ch) AS k FROM (SELECT unnest(list_distinct(string_split(text, ''))) AS ch FROM documents) WHERE ch <> ''), x AS (SELECT rows, l, k, (least(l / 1000, 1) + least(k / 200.0, 1) + least(m / 10, 1)) / 3 AS cx, least(a / l * 10, 1) AS lang FROM t, c)
    SELECT rows, round(l, 6) AS mean_length, k AS characters, round(cx, 6) AS complexity, round(lang, 6) AS language_diversity, round(0.1 + l / 1000 + 2 * cx, 6) AS seconds_per_ticket FROM x""")
def text_complexity(spark, d):
    return _round(planning.complexity(table(spark, d, "documents")), "mean_length", "complexity", "language_diversity", "seconds_per_ticket")


_JOBS = """j AS (SELECT o_orderkey AS id, o_custkey * 37 % 150000 AS n, 2 + o_orderkey % 15 AS cores, 0.5 + o_custkey % 30 / 2.0 AS mem, 0.5 AS sec, o_custkey % 100 * 1.0 AS pm, o_orderkey % 100 / 100.0 AS conf,
    ['speed_optimized', 'memory_optimized', 'cost_optimized', 'balanced'][1 + o_orderkey % 4] AS mode, CASE WHEN o_custkey % 5 = 0 THEN 3 END AS mw, CASE WHEN o_custkey % 7 = 0 THEN 1.0 END AS mg, CAST(o_custkey % 100 AS DOUBLE) AS cpu, CAST(o_orderkey % 99 AS DOUBLE) AS used, CAST(o_orderkey % 20 AS DOUBLE) AS disk FROM orders),
    b1 AS (SELECT *, CASE WHEN n < 1000 THEN 2 WHEN n < 10000 THEN least(4, cores) WHEN n < 100000 THEN least(8, cores) ELSE least(16, cores * 2) END AS b FROM j),
    b2 AS (SELECT * REPLACE (CASE WHEN mem < 2 THEN least(b, 2) WHEN mem > 8 THEN least(b * 2, cores * 2) ELSE b END AS b) FROM b1), b3 AS (SELECT * REPLACE (least(b, coalesce(mw, b)) AS b) FROM b2),
    w1 AS (SELECT *, CASE mode WHEN 'speed_optimized' THEN least(b * 2, cores * 2) WHEN 'memory_optimized' THEN greatest(1, b // 2) WHEN 'cost_optimized' THEN greatest(2, b // 2) ELSE b END AS w FROM b3),
    m1 AS (SELECT *, CAST(CASE mode WHEN 'speed_optimized' THEN least(1024, floor(mem * 1024 / w)) WHEN 'memory_optimized' THEN 256 WHEN 'cost_optimized' THEN 512 ELSE least(768, floor(mem * 1024 / w)) END AS BIGINT) AS mb FROM w1),
    r AS (SELECT * REPLACE (CAST(CASE WHEN w * mb > floor(mg * 1024) THEN greatest(1, floor(floor(mg * 1024) / mb)) ELSE w END AS BIGINT) AS w) FROM m1)"""


def _jobs(spark, d):
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    mode = F.element_at(F.array(*map(F.lit, ("speed_optimized", "memory_optimized", "cost_optimized", "balanced"))), (o % 4 + 1).cast("int"))
    return table(spark, d, "orders").select(
        o.alias("id"), (c * 37 % 150000).alias("tickets"), (2 + o % 15).alias("cores"), (0.5 + c % 30 / 2).alias("memory_gb"), F.lit(0.5).alias("seconds_per_ticket"), (c % 100).cast("double").alias("predicted_minutes"), (o % 100 / 100).alias("confidence"), mode.alias("mode"),
        F.when(c % 5 == 0, 3).alias("max_workers"), F.when(c % 7 == 0, 1.0).alias("max_memory_gb"), (c % 100).cast("double").alias("cpu"), (o % 99).cast("double").alias("memory"), (o % 20).cast("double").alias("disk_gb"),
    )


@query(f"""WITH {_JOBS} SELECT id, w AS workers, mb AS memory_mb, CASE mode WHEN 'speed_optimized' THEN 150000 WHEN 'memory_optimized' THEN 50000 ELSE 100000 END AS chunk_tokens, CAST(CASE mode WHEN 'speed_optimized' THEN 15000 WHEN 'memory_optimized' THEN 5000 ELSE 10000 END AS BIGINT) AS overlap_tokens,
    CASE mode WHEN 'speed_optimized' THEN 100 WHEN 'memory_optimized' THEN 25 ELSE 50 END AS batch_size, round(CASE WHEN conf > 0.3 THEN pm ELSE n * sec / w / 60 END, 9) AS minutes, round(w * mb / 1024.0, 10) AS peak_gb, round(n * 0.0003 / least(2.0, w / 4.0), 6) AS cost, round((conf + least(1, n / 1000.0) + least(1, mem / 4)) / 3, 6) AS score FROM r""")
def allocation(spark, d):
    out = planning.recommend(_jobs(spark, d)).select("id", "workers", "memory_mb", "chunk_tokens", "overlap_tokens", "batch_size", "minutes", "peak_gb", "cost", "score")
    return _round(_round(_round(out, "cost", "score"), "peak_gb", places=10), "minutes", places=9)


@query(f"""WITH {_JOBS}, i AS (SELECT id, concat_ws('; ', CASE WHEN w > cores * 4 THEN 'too many workers' END, CASE WHEN w * mb / 1024.0 > mem THEN 'insufficient memory' END, CASE WHEN cpu > 80 THEN 'high CPU use' END, CASE WHEN used > 85 THEN 'high memory use' END,
    CASE WHEN w * mb / 1024.0 * 2 > disk THEN 'insufficient disk' END) AS issues FROM r) SELECT id, issues, issues = '' AS valid FROM i""")
def allocation_feasibility(spark, d):
    return planning.feasibility(planning.recommend(_jobs(spark, d))).select("id", _text("issues"), "valid")


_METRICS = """s AS (SELECT event_id, CAST(event_id * 13 % 1100 AS DOUBLE) AS q, CAST(event_id * 7 % 100 AS DOUBLE) AS cpu, CAST(event_id * 11 % 100 AS DOUBLE) AS mem, CASE WHEN event_id % 97 = 0 THEN 0.2 ELSE 4.0 END AS free, CAST(event_id % 23 AS DOUBLE) AS err, CAST(event_id % 60 AS DOUBLE) AS now, 40.0 AS mean, 1 + event_id % 64 AS w,
    event_id % 5 <> 0 AS app, ['increasing', 'stable', 'decreasing'][1 + event_id % 3] AS t1, ['increasing', 'stable', 'decreasing'][1 + event_id // 3 % 3] AS t2 FROM events),
    c AS (SELECT *, abs(mean - now) / 40 * 100 AS dropped,
      [CASE WHEN q > 100 AND t1 <> 'decreasing' THEN {'v': q, 'a': 'up', 't': 'queue_depth'} END, CASE WHEN cpu > 75 AND t2 <> 'decreasing' THEN {'v': cpu, 'a': 'up', 't': 'cpu_usage'} END, CASE WHEN mem > 80 THEN {'v': mem, 'a': 'up', 't': 'memory_pressure'} END, CASE WHEN t2 = 'decreasing' AND abs(mean - now) / 40 * 100 > 20 THEN {'v': abs(mean - now) / 40 * 100, 'a': 'up', 't': 'throughput_drop'} END] AS up,
      [CASE WHEN q < 10 AND t1 <> 'increasing' THEN {'v': q, 'a': 'down', 't': 'queue_depth'} END, CASE WHEN cpu < 30 AND t2 <> 'increasing' THEN {'v': cpu, 'a': 'down', 't': 'cpu_usage'} END, CASE WHEN mem < 40 THEN {'v': mem, 'a': 'down', 't': 'memory_pressure'} END, CASE WHEN t2 = 'stable' AND mean > now * 1.5 THEN {'v': mean, 'a': 'down', 't': 'throughput_drop'} END] AS down FROM s),
    e AS (SELECT *, list_max(list_filter(up, lambda x: x IS NOT NULL)) AS u, list_max(list_filter(down, lambda x: x IS NOT NULL)) AS l FROM c),
    f AS (SELECT *, CASE WHEN app THEN CASE WHEN err > 20 THEN {'v': err, 'a': 'emergency', 't': 'error_rate'} WHEN free < 0.5 THEN {'v': mem, 'a': 'emergency', 't': 'memory_pressure'} WHEN q > 1000 THEN {'v': q, 'a': 'emergency', 't': 'queue_depth'} WHEN u IS NOT NULL AND w < 64 THEN u WHEN l IS NOT NULL AND w > 1 THEN l ELSE {'v': 0.0, 'a': 'maintain', 't': 'manual_trigger'} END
      WHEN cpu > 90 THEN {'v': cpu, 'a': 'up', 't': 'cpu_usage'} WHEN mem > 90 THEN {'v': mem, 'a': 'up', 't': 'memory_pressure'} WHEN cpu < 20 AND mem < 30 AND w > 1 THEN {'v': cpu, 'a': 'down', 't': 'cpu_usage'} ELSE {'v': 0.0, 'a': 'maintain', 't': 'manual_trigger'} END AS d FROM e)"""


@query(f"""WITH {_METRICS} SELECT event_id, d.a AS action, d.t AS trigger, round(d.v, 6) AS value, CASE d.t || ':' || d.a WHEN 'queue_depth:up' THEN 100.0 WHEN 'queue_depth:down' THEN 10.0 WHEN 'cpu_usage:up' THEN 75.0 WHEN 'cpu_usage:down' THEN 30.0 WHEN 'memory_pressure:up' THEN 80.0 WHEN 'memory_pressure:down' THEN 40.0 WHEN 'throughput_drop:up' THEN 20.0 ELSE 0.0 END AS threshold,
    CAST(CASE d.a WHEN 'emergency' THEN least(w * 2, 64) WHEN 'up' THEN least(floor(w * 1.5), 64) WHEN 'down' THEN greatest(floor(w / 1.5), 1) ELSE w END AS BIGINT) AS target FROM f""")
def scaling_checks(spark, d):
    e = F.col("event_id")
    pick = lambda i: F.element_at(F.array(*map(F.lit, ("increasing", "stable", "decreasing"))), (i % 3 + 1).cast("int"))
    m = table(spark, d, "events").select(
        "event_id", (e * 13 % 1100).cast("double").alias("queue"), (e * 7 % 100).cast("double").alias("cpu"), (e * 11 % 100).cast("double").alias("memory"), F.when(e % 97 == 0, 0.2).otherwise(4.0).alias("free_gb"), (e % 23).cast("double").alias("error_rate"), (e % 60).cast("double").alias("throughput"),
        F.lit(40.0).alias("mean_throughput"), (1 + e % 64).alias("workers"), (e % 5 != 0).alias("with_app"), pick(e).alias("queue_trend"), pick(F.floor(e / 3)).alias("cpu_trend"), pick(F.floor(e / 3)).alias("throughput_trend"),
    )
    return _round(planning.scaling_checks(m).select("event_id", "action", "trigger", "value", "threshold", "target"), "value")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id DESC) AS r, count(*) OVER () AS n FROM events) WHERE n <= 1000 OR r <= 500")
def trimmed_log(spark, d):
    return planning.trimmed(table(spark, d, "events").select("event_id"), "event_id")


@query("SELECT event_id, round((SELECT avg(CASE WHEN value > 50 THEN 1.0 ELSE 0 END) * 100 FROM events), 6) AS success_rate, (SELECT count(*) FROM events) AS total FROM events ORDER BY event_id DESC LIMIT 10")
def scaling_history(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("value") > 50).alias("success"))
    return _round(planning.scaling_history(e, "event_id").select("event_id", "success_rate", "total"), "success_rate")


# --- alerts and trends


@query("""WITH r AS (SELECT * FROM (VALUES ('budget_threshold', 'warning', 0.5), ('budget_threshold', 'critical', 0.75), ('budget_threshold', 'emergency', 0.95), ('daily_limit', 'critical', 10.0), ('hourly_spike', 'warning', 3.0)) t(alert_type, level, threshold)), v AS (
    SELECT ts, CASE event_type WHEN 'click' THEN 'budget_threshold' WHEN 'view' THEN 'daily_limit' ELSE 'hourly_spike' END AS alert_type, CASE event_type WHEN 'click' THEN value / 300 WHEN 'view' THEN value / 20 ELSE value / 50 END AS value FROM events)
    SELECT alert_type, level, count(*) AS n, count(*) FILTER (WHERE level = 'emergency') AS suspended FROM v JOIN r USING (alert_type) WHERE value >= threshold GROUP BY 1, 2""")
def rule_alerts(spark, d):
    kind, value = F.col("event_type"), F.col("value")
    v = table(spark, d, "events").select("ts", F.when(kind == "click", "budget_threshold").when(kind == "view", "daily_limit").otherwise("hourly_spike").alias("alert_type"), F.when(kind == "click", value / 300).when(kind == "view", value / 20).otherwise(value / 50).alias("value"))
    rules = alerts.without_rule(alerts.rules(spark, [("hourly_spike", "warning", 3.0)]), "hourly_spike", 2.0)
    found = alerts.check(v, rules)
    return alerts.statistics(found).join(found.groupBy("alert_type", "level").agg(F.count_if("suspends").alias("suspended")), ["alert_type", "level"])


@query("""WITH e AS (SELECT user_id, event_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS s, value FROM events), a AS (SELECT *, max(s) OVER (PARTITION BY user_id) AS t, row_number() OVER (PARTITION BY user_id ORDER BY s DESC) AS r FROM e), b AS (
    SELECT *, s >= t - 864000 AS i FROM a), c AS (SELECT *, sum(CASE WHEN i THEN 1 ELSE 0 END) OVER (PARTITION BY user_id) AS k FROM b), k AS (SELECT * FROM c WHERE CASE WHEN k >= 2 THEN i ELSE r <= 10 END)
    SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean FROM k GROUP BY 1""")
def recent_load(spark, d):
    e = table(spark, d, "events").select("user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("s"), "value")
    return _round(trend.recent_trend(e, "value", "s", "user_id", minutes=14400).select("user_id", "n", "mean"), "mean")


@query("""WITH r AS (SELECT o_custkey, o_totalprice AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders), g AS (
    SELECT o_custkey, max(n) AS n, avg(v) FILTER (WHERE r <= n // 2) AS a, avg(v) FILTER (WHERE r > n // 2) AS b FROM r GROUP BY 1), x AS (SELECT *, (b - a) / greatest(a, 0.01) * 100 AS c FROM g)
    SELECT o_custkey, CASE WHEN n < 2 THEN 'stable' WHEN c > 10 THEN 'increasing' WHEN c < -10 THEN 'decreasing' ELSE 'stable' END AS trend FROM x""")
def floored_trend(spark, d):
    return trend.half_split_trend(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", "o_custkey", percent=10.0, least=2, floor=0.01).select("o_custkey", "trend")


@query("""WITH p AS (SELECT o_custkey AS k, o_orderkey AS ts, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) / 20.0 AS progress, o_totalprice AS cost, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)
    SELECT k, ts, round(cost / progress, 4) AS projected FROM p WHERE progress > 0.1 AND n >= 5 AND cost / progress > 500000""")
def predicted_overruns(spark, d):
    from pyspark.sql.window import Window as W

    n = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    p = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("ts"), (n / 20).alias("progress"), F.col("o_totalprice").alias("cost"))
    return _round(alerts.predictive(p, 500_000.0, group="k").select("k", "ts", "projected"), "projected", places=4)


@query("SELECT o_orderkey AS session_id, round(o_totalprice / 1e6, 9) AS cost_per_item FROM orders WHERE o_totalprice / 1e6 > 0.10")
def efficiency_drops(spark, d):
    s = table(spark, d, "orders").select(F.col("o_orderkey").alias("session_id"), (F.col("o_totalprice") / 1e6).alias("cost_per_item"))
    return _round(alerts.efficiency_drops(s), "cost_per_item", places=9)


@query("SELECT event_id AS alert_id, event_type AS alert_type, event_id IN (SELECT doc_id FROM labels) OR event_id % 10 = 0 AS acknowledged FROM events")
def acknowledged_alerts(spark, d):
    a = table(spark, d, "events").select(F.col("event_id").alias("alert_id"), F.col("event_type").alias("alert_type"), (F.col("event_id") % 10 == 0).alias("acknowledged"))
    return alerts.acknowledge(a, table(spark, d, "labels").select(F.col("doc_id").alias("alert_id"))).select("alert_id", "alert_type", "acknowledged")


@query("SELECT event_type AS alert_type, CASE WHEN value > 100 THEN 'critical' ELSE 'warning' END AS level, count(*) AS n FROM events GROUP BY 1, 2")
def alert_statistics(spark, d):
    return alerts.statistics(table(spark, d, "events").select(F.col("event_type").alias("alert_type"), F.when(F.col("value") > 100, "critical").otherwise("warning").alias("level")))
