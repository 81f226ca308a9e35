"""The tables of a folder as messages, categories, usage and so on, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGES = """m AS (
    SELECT CAST(conv_id AS VARCHAR) AS ticket_id, turn AS seq, text,
           CASE role WHEN 'user' THEN 'USER' WHEN 'assistant' THEN 'AGENT' ELSE role END AS sender,
           CASE WHEN conv_id % 10 = 9 THEN 'IMAGE' WHEN conv_id % 10 = 8 THEN ' text ' ELSE 'TEXT' END AS category,
           TIMESTAMP '2024-01-01 00:00:00' + CAST(conv_id * 7 AS INTEGER) * INTERVAL 1 HOUR AS ticket_created_at
    FROM conversations)"""
CATEGORISED = "c AS (SELECT doc_id AS ticket_id, source || '/' || lang AS categoria FROM documents)"
USAGE = """u AS (
    SELECT event_id, ts, user_id, event_type AS operation_type, CAST(floor(value * 10) AS BIGINT) AS input_tokens,
           coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS output_tokens
    FROM events), uc AS (
    SELECT *, input_tokens + output_tokens AS total_tokens, input_tokens / 1e6 * 0.075 + output_tokens / 1e6 * 0.30 AS cost_usd FROM u)"""
RESULTS = """r AS (
    SELECT event_id, user_id % 2 AS arm, least(1.0, value / 500) AS confidence,
           CASE event_type WHEN 'click' THEN '1' WHEN 'view' THEN '2,3' WHEN 'purchase' THEN '3' WHEN 'signup' THEN '1, 4' ELSE '' END AS category_ids
    FROM events)"""
LABELS = """t AS (
    SELECT doc_id, CASE WHEN quality = 1 AND toxic = 1 THEN '1,2' WHEN quality = 1 THEN '1' WHEN toxic = 1 THEN '2' ELSE '' END AS ids FROM labels), p AS (
    SELECT doc_id, CASE WHEN n_chars > 1000 AND lang = 'en' THEN '1, 2' WHEN n_chars > 1000 THEN '1' ELSE '2' END AS ids FROM documents)"""
HOURLY = USAGE + """, h AS (
    SELECT date_trunc('hour', ts) AS hour, count(*) AS n, sum(cost_usd) AS cost FROM uc GROUP BY 1)"""

#: Workload sizes: for each customer, what the orders sum up to, from hundreds to millions, in steps of 32
#: (so that no figure lies between two roundings); and 1000.
SIZES = """(SELECT DISTINCT greatest(96, s // CAST(power(10, k % 4) AS BIGINT) // 32 * 32) AS n FROM (SELECT o_custkey AS k, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS s FROM orders GROUP BY 1) UNION SELECT CAST(1000 AS BIGINT))"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    sender = F.when(F.col("role") == "user", "USER").when(F.col("role") == "assistant", "AGENT").otherwise(F.col("role"))
    last = F.pmod("conv_id", F.lit(10))
    return c.select(
        F.col("conv_id").cast("string").alias("ticket_id"),
        F.col("turn").alias("seq"),
        "text",
        sender.alias("sender"),
        F.when(last == 9, "IMAGE").when(last == 8, " text ").otherwise("TEXT").alias("category"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, int(conv_id * 7))").alias("ticket_created_at"),
    )


def categorised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ticket_id"), F.concat_ws("/", "source", "lang").alias("categoria"))


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.coalesce(F.get_json_object("props", "$.k").try_cast("long"), F.lit(0))
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", F.col("event_type").alias("operation_type"), F.floor(F.col("value") * 10).cast("long").alias("input_tokens"), k.alias("output_tokens"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    ids = F.when(kind == "click", "1").when(kind == "view", "2,3").when(kind == "purchase", "3").when(kind == "signup", "1, 4").otherwise("")
    return table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 2).alias("arm"), F.least(F.lit(1.0), F.col("value") / 500).alias("confidence"), ids.alias("category_ids"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    return table(spark, sf_dir, "labels").select("doc_id", F.when(q & t, "1,2").when(q, "1").when(t, "2").otherwise("").alias("ids"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = F.col("n_chars") > 1000
    return table(spark, sf_dir, "documents").select("doc_id", F.when(long & (F.col("lang") == "en"), "1, 2").when(long, "1").otherwise("2").alias("ids"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.cost import hourly_cost

    return hourly_cost(usage(spark, sf_dir)).select("hour", "n", F.col("cost_usd").alias("cost"))


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.sum(F.floor("o_totalprice").cast("long")).alias("s"))
    n = s.select(F.greatest(F.lit(96).cast("long"), F.expr("s div cast(power(10, k % 4) as bigint) div 32 * 32")).alias("dataset_size"))
    return n.unionByName(spark.range(1).select(F.lit(1000).cast("long").alias("dataset_size"))).distinct()
