"""Further registered queries: trends, cache, taxonomies, runs and plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import format_age, format_cost, ticket_block
from ..operators import cache, cost, joins, planning, prepare, stats, trend
from .adapters import HOURLY, MESSAGES, USAGE, hourly, messages, table, usage
from .catalogue import _round, query


def _daily(spark, d):
    return hourly(spark, d).groupBy(F.to_date("hour").alias("day")).agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"))


_DAILY = HOURLY + ", dd AS (SELECT CAST(hour AS DATE) AS day, sum(n) AS n, sum(cost) AS cost FROM h GROUP BY 1)"


@query(f"""WITH {_DAILY}, r AS (SELECT *, row_number() OVER (ORDER BY day) AS a, row_number() OVER (ORDER BY day DESC) AS b FROM dd), x AS (SELECT avg(n) FILTER (WHERE a <= 3) AS first, avg(n) FILTER (WHERE b <= 3) AS last FROM r)
    SELECT round(first, 6) AS first, round(last, 6) AS last, CASE WHEN last - first > 5 THEN 'improving' WHEN last - first < -5 THEN 'declining' ELSE 'stable' END AS trend FROM x""")
def ends_trend(spark, d):
    return _round(trend.ends_trend(_daily(spark, d), "n", "day"), "first", "last")


@query(f"WITH {_DAILY} SELECT CAST(day AS VARCHAR) AS day, round((n - lag(n, 4) OVER (ORDER BY day)) / 5.0, 6) AS slope FROM dd")
def last5_slope(spark, d):
    return _round(trend.slope(_daily(spark, d), "n", "day").select(F.col("day").cast("string").alias("day"), "slope"), "slope")


@query(f"WITH {_DAILY} SELECT CAST(day AS VARCHAR) AS day, round(avg(n) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING), 6) AS running FROM dd")
def running_mean(spark, d):
    return _round(trend.running_mean(_daily(spark, d), "n", "day").select(F.col("day").cast("string").alias("day"), "running"), "running")


@query(f"WITH {_DAILY} SELECT CAST(day AS VARCHAR) AS day, CASE WHEN var_pop(n) OVER (ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) > 100 THEN 5 ELSE 10 END AS points FROM dd")
def stability_points(spark, d):
    return trend.stability_points(_daily(spark, d), "n", "day").select(F.col("day").cast("string").alias("day"), "points")


@query(f"""WITH {_DAILY}, r AS (SELECT CAST(day AS VARCHAR) AS day, n, lag(CAST(day AS VARCHAR)) OVER (ORDER BY day) AS p, lead(CAST(day AS VARCHAR)) OVER (ORDER BY day) AS f FROM dd)
    SELECT day AS optimal, p AS previous, f AS following FROM r ORDER BY n, day LIMIT 1""")
def best_neighbourhood(spark, d):
    return trend.best_neighbourhood(_daily(spark, d).withColumn("day", F.col("day").cast("string")), "day", "n")


@query("""WITH e AS (SELECT l_orderkey * 10 + l_linenumber AS k, CAST(l_quantity AS BIGINT) AS size, CAST(epoch(l_shipdate) AS BIGINT) * 100000 + l_orderkey * 10 + l_linenumber AS a FROM lineitem), r AS (
    SELECT *, coalesce(sum(size) OVER (ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size) OVER () AS t FROM e) SELECT k FROM r WHERE t > 1000 AND t - before > 800""")
def lru_eviction(spark, d):
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    seconds = F.unix_timestamp(F.col("l_shipdate").cast("timestamp"))
    e = table(spark, d, "lineitem").select(key.alias("k"), F.col("l_quantity").cast("long").alias("size"), (seconds * 100000 + key).alias("a"))
    return trend.eviction_order(e, "size", "a", 1000.0).select("k")


@query("""WITH m AS (SELECT event_id, CAST(event_id % 101 AS DOUBLE) AS hit, CAST(event_id * 3 % 101 AS DOUBLE) AS usage, event_id % 90 AS saves, event_id % 4 AS errors, event_id % 30 AS compressed, event_id % 60 AS files, 5 + 5 * (event_id % 2) AS points FROM events), s AS (
    SELECT event_id, least(hit / 80 * 30, 30) + greatest(0, least((100 - usage) / 20 * 25, 25)) + greatest(0, least((5 - errors / CAST(greatest(saves + errors, 1) AS DOUBLE) * 100) / 5 * 20, 20)) + least(compressed / CAST(greatest(files, 1) AS DOUBLE) * 15, 15) + points AS score FROM m)
    SELECT event_id, round(score, 6) AS score, CASE WHEN score >= 80 THEN 'excellent' WHEN score >= 60 THEN 'good' WHEN score >= 40 THEN 'fair' ELSE 'poor' END AS label FROM s""")
def cache_health(spark, d):
    e = F.col("event_id")
    m = table(spark, d, "events").select("event_id", (e % 101).cast("double").alias("hit_rate"), (e * 3 % 101).cast("double").alias("usage"), (e % 90).alias("saves"), (e % 4).alias("errors"),
                                         (e % 30).alias("compressed"), (e % 60).alias("files"), (5 + 5 * (e % 2)).alias("points"))
    return _round(cache.health(m).select("event_id", "score", "label"), "score")


@query("""WITH m AS (SELECT ts, event_id, event_id % 100 AS hit, event_id * 7 % 100 AS usage, event_id * 11 % 20000 AS files FROM events), a AS (
    SELECT event_id, 'low_hit_rate' AS alert FROM m WHERE hit < 60 UNION ALL SELECT event_id, 'high_usage' FROM m WHERE usage > 90 UNION ALL SELECT event_id, 'many_files' FROM m WHERE files > 10000) SELECT alert, count(*) AS n FROM a GROUP BY 1""")
def cache_alerts(spark, d):
    e = F.col("event_id")
    m = table(spark, d, "events").select("ts", (e % 100).alias("hit_rate"), (e * 7 % 100).alias("usage"), (e * 11 % 20000).alias("files"))
    return cache.alerts(m).groupBy("alert").agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT event_id % 4 <> 0 AS hit, CAST(value AS BIGINT) AS size FROM (SELECT event_id, floor(value) AS value FROM events))
    SELECT count(*) AS accesses, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses, round(count(*) FILTER (WHERE hit) * 100.0 / count(*), 6) AS hit_rate, CAST(sum(size) AS BIGINT) AS bytes FROM l""")
def cache_statistics(spark, d):
    log = table(spark, d, "events").select((F.col("event_id") % 4 != 0).alias("hit"), F.floor("value").cast("long").alias("size"))
    return _round(cache.statistics(log), "hit_rate")


@query("SELECT doc_id, sha256('v1:keywords:' || text) AS key FROM documents WHERE text IS NOT NULL")
def cache_keys(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", cache.cache_key(F.col("text"), "keywords").alias("key"))


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def cache_hits(spark, d):
    docs = table(spark, d, "documents").withColumn("key", F.col("doc_id").cast("string"))
    stored = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("key"), F.lit("x").alias("result"))
    return cache.look_up(docs, stored)[0].select("doc_id", "source")


@query("""WITH b AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN 'broken' WHEN doc_id % 5 = 2 THEN '[1]' ELSE '[1, 2, 3]' END AS x FROM documents)
    SELECT count(*) FILTER (WHERE x IS NOT NULL) AS with_bullets, round(avg(CASE WHEN doc_id % 5 = 2 THEN 1 WHEN doc_id % 5 > 2 THEN 3 END), 1) AS mean, min(CASE WHEN doc_id % 5 = 2 THEN 1 WHEN doc_id % 5 > 2 THEN 3 END) AS least,
           max(CASE WHEN doc_id % 5 = 2 THEN 1 WHEN doc_id % 5 > 2 THEN 3 END) AS most, count(*) FILTER (WHERE doc_id % 5 = 1) AS errors FROM b""")
def bullet_coverage(spark, d):
    k = F.col("doc_id") % 5
    b = table(spark, d, "documents").select(F.when(k == 0, None).when(k == 1, "broken").when(k == 2, "[1]").otherwise("[1, 2, 3]").alias("bullets"))
    return stats.bullet_coverage(b)


@query("SELECT doc_id, 'Ticket ' || CAST(doc_id AS VARCHAR) || ':' || chr(10) || text AS block FROM documents")
def ticket_blocks(spark, d):
    return table(spark, d, "documents").select("doc_id", ticket_block(F.col("doc_id").cast("string"), F.col("text")).alias("block"))


@query("""SELECT event_id, CASE WHEN value < 1 THEN CAST(CAST(floor(value * 60) AS INTEGER) AS VARCHAR) || ' min' WHEN value < 24 THEN printf('%.1f h', value) ELSE printf('%.1f d', value / 24) END AS age FROM (SELECT event_id, floor(value) + 0.3 AS value FROM events)""")
def age_labels(spark, d):
    e = table(spark, d, "events").select("event_id", (F.floor("value") + 0.3).alias("value"))
    return e.select("event_id", format_age(F.col("value")).alias("age"))


@query(f"""WITH {USAGE} SELECT event_id, CASE WHEN cost_usd < 0.001 THEN CAST(CAST(round(CAST(CAST(cost_usd * 1000 AS VARCHAR) AS DECIMAL(38, 24)), 3) AS DECIMAL(18, 3)) AS VARCHAR) || 'm¢' WHEN cost_usd < 0.10 THEN CAST(CAST(round(CAST(CAST(cost_usd * 100 AS VARCHAR) AS DECIMAL(38, 24)), 2) AS DECIMAL(18, 2)) AS VARCHAR) || '¢' ELSE '$' || CAST(CAST(round(CAST(CAST(cost_usd AS VARCHAR) AS DECIMAL(38, 24)), 3) AS DECIMAL(18, 3)) AS VARCHAR) END AS label FROM uc""")
def cost_labels(spark, d):
    return cost.with_cost(usage(spark, d)).select("event_id", format_cost(F.col("cost_usd")).alias("label"))


@query(f"WITH {MESSAGES} SELECT sender, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM m) AS DOUBLE), 6) AS share FROM m GROUP BY 1")
def sender_frequencies(spark, d):
    return _round(stats.frequencies(messages(spark, d), "sender"), "share")


@query(f"WITH {USAGE}, t AS (SELECT sum(cost_usd) AS c, CAST(sum(total_tokens) AS BIGINT) AS k, count(*) AS n FROM uc) SELECT round(c, 6) AS cost, k AS tokens, n, round(c / 720, 9) AS cost_per_hour, round(k / 720.0, 6) AS tokens_per_hour, round(c / 720 * 24, 6) AS daily, round(c / 720 * 168, 6) AS weekly FROM t")
def cost_trend(spark, d):
    return _round(_round(cost.cost_trend(usage(spark, d), 720), "cost", "tokens_per_hour", "daily", "weekly"), "cost_per_hour", places=9)


@query("""WITH h AS (SELECT o_totalprice / o_custkey AS c, CAST(o_orderkey AS DOUBLE) / o_custkey AS t FROM orders WHERE o_custkey > 0)
    SELECT round(median(c), 6) AS cost_per_item, round(median(t), 6) AS tokens_per_item, round(stddev_samp(c), 4) AS std, count(*) AS n FROM h""")
def calibration(spark, d):
    h = table(spark, d, "orders").select(F.col("o_custkey").alias("dataset_size"), F.col("o_totalprice").alias("total_cost_usd"), F.col("o_orderkey").alias("total_tokens"))
    return _round(_round(cost.calibration(h), "cost_per_item", "tokens_per_item"), "std", places=4)


@query("""WITH h AS (SELECT o_orderkey AS run_id, o_custkey AS n, 1 + o_orderkey % 16 AS w, o_totalprice / 1000 AS hours FROM orders), s AS (SELECT *, abs(n - 1000) AS d FROM h WHERE abs(n - 1000) / CAST(greatest(n, 1000) AS DOUBLE) <= 0.3 ORDER BY d, run_id LIMIT 5), x AS (
    SELECT hours * w / 4 AS hours, (1 - d / CAST(greatest(n, 1000) AS DOUBLE)) * (1 - abs(w - 4) / CAST(greatest(w, 4) AS DOUBLE)) AS weight FROM s), c AS (SELECT count(*) AS k FROM h WHERE abs(n - 1000) / CAST(greatest(n, 1000) AS DOUBLE) <= 0.3)
    SELECT coalesce(round(sum(weight * hours) / sum(weight), 6), round(10 / 60.0, 6)) AS hours, CASE WHEN max(k) = 0 THEN 0.1 ELSE round(least(1, sum(weight) / max(k)), 6) END AS confidence FROM c LEFT JOIN x ON TRUE""")
def predicted_hours(spark, d):
    h = table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("dataset_size"), (1 + F.col("o_orderkey") % 16).alias("workers"), (F.col("o_totalprice") / 1000).alias("hours"))
    return _round(planning.predict(h, 1000, 4).drop("similar"), "hours", "confidence")


@query("SELECT event_type AS trigger, count(*) AS n, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0 END), 6) AS success_rate FROM events GROUP BY 1")
def scaling_dashboard(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("trigger"), (F.col("value") > 50).alias("success"))
    return _round(planning.scaling_dashboard(e), "success_rate")


@query("""WITH a AS (SELECT n_nationkey AS id, lower(n_name) AS t FROM nation WHERE n_nationkey < 15), b AS (SELECT lower(n_name) AS t FROM nation WHERE n_nationkey >= 10), j AS (SELECT a.id, coalesce(a.t, b.t) AS t FROM a FULL OUTER JOIN b ON a.t = b.t)
    SELECT CAST(coalesce(id, 14 + row_number() OVER (PARTITION BY id IS NULL ORDER BY t)) AS INTEGER) AS id, t AS technical_name FROM j""")
def taxonomy_merge(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.lower("n_name").alias("technical_name"), F.col("n_name").alias("display_name"), F.lit("d").alias("description"), F.array(F.lit("k")).alias("keywords"), F.array(F.lit("e")).alias("examples"))
    return joins.merge_taxonomies(n.filter("id < 15"), n.filter("id >= 10")).select("id", "technical_name")


@query("""WITH r AS (SELECT o_orderkey, o_custkey % 40 / 100.0 AS c, CAST(o_orderkey % 50 AS DOUBLE) AS m, o_custkey % 100 / 100.0 AS f FROM orders) SELECT o_orderkey, c <= 0.20 AND m <= 25 AND f >= 0.85 AS compliant FROM r""")
def run_compliance(spark, d):
    r = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 40 / 100).alias("cost_per_1k"), (F.col("o_orderkey") % 50).cast("double").alias("minutes"), (F.col("o_custkey") % 100 / 100).alias("confidence"))
    return stats.run_metrics(r).select("o_orderkey", "compliant")


@query("""WITH r AS (SELECT o_orderkey AS id, o_custkey % 40 / 100.0 AS c, o_custkey % 90 AS t, o_custkey % 100 / 100.0 AS h, o_custkey % 8 AS w FROM orders), x AS (
    SELECT id, 'reduce cost' AS name, 'critical' AS impact, 'moderate' AS complexity FROM r WHERE c > 0.20 UNION ALL SELECT id, 'review cost', 'high', 'easy' FROM r WHERE c BETWEEN 0.10 AND 0.20
    UNION ALL SELECT id, 'raise throughput', 'high', 'moderate' FROM r WHERE t < 50 UNION ALL SELECT id, 'improve cache', 'medium', 'easy' FROM r WHERE h < 0.75 UNION ALL SELECT id, 'add workers', 'medium', 'easy' FROM r WHERE w < 4) SELECT * FROM x""")
def recommendations(spark, d):
    k = F.col("o_custkey")
    m = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (k % 40 / 100).alias("cost_per_item"), (k % 90).cast("double").alias("tokens_per_second"), (k % 100 / 100).alias("hit_rate"), (k % 8).alias("workers"))
    return cost.recommendations(m).select("id", "name", "impact", "complexity")


@query(f"WITH {MESSAGES}, h AS (SELECT ticket_id, sender, count(*) AS n FROM m GROUP BY 1, 2) SELECT ticket_id, 'Total: ' || CAST(CAST(sum(n) AS BIGINT) AS VARCHAR) || ' mensagens ({{' || string_agg('''' || sender || ''': ' || CAST(n AS VARCHAR), ', ' ORDER BY n DESC, sender) || '}})' AS histogram FROM h GROUP BY 1")
def sender_histogram(spark, d):
    m = messages(spark, d).groupBy("ticket_id").agg(F.collect_list("sender").alias("s"))
    return m.select("ticket_id", prepare.sender_histogram(F.col("s")).alias("histogram"))
