"""Registered queries that write what the tables hold to files, as another program would, and
read it again: CSV in many blocks, JSON arrays, workbook-style exports, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import jsonx, text
from ..operators import cache, cost, pack, runs, sample, stats
from ..sources import documents, reports, tables, workbook
from ..sources.work import materialise, work_dir
from ..streaming import jobs as streams
from . import jobs
from .adapters import CATEGORISED, MESSAGES, USAGE, categorised, messages, table, usage
from . import catalogue_functions  # noqa: F401  the SQL of the model jobs is there
from .catalogue import ORACLE_SQL, _round, query

#: The messages with line breaks, separators and quotes in their texts.
_HARD = "ticket_id, seq, CASE seq % 3 WHEN 0 THEN text WHEN 1 THEN text || chr(10) || '; \"quoted\" ' || ticket_id ELSE 'a \"b\" ' || text END AS text, sender"


def _hard(spark, d) -> DataFrame:
    m, k = messages(spark, d), F.col("seq") % 3
    hard = F.when(k == 0, F.col("text")).when(k == 1, F.concat("text", F.lit('\n; "quoted" '), "ticket_id")).otherwise(F.concat(F.lit('a "b" '), "text"))
    return m.select("ticket_id", "seq", "category", hard.alias("text"), "sender")


def _digests(df: DataFrame) -> DataFrame:
    return df.select("ticket_id", F.col("seq").cast("long").alias("seq"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), "sender")


_DIGESTS = f"WITH {MESSAGES}, h AS (SELECT {_HARD} FROM m) SELECT ticket_id, CAST(seq AS BIGINT) AS seq, sha256(coalesce(text, '')) AS digest, sender FROM h"


@query(_DIGESTS)
def csv_messages(spark, d):
    """A `;` file with a byte-order mark, too long rows (skipped) and short ones."""
    path = work_dir(spark, "messages-csv")
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))
    lines = _hard(spark, d).select(F.concat_ws(";", "ticket_id", F.col("seq").cast("string"), "category", quoted(F.coalesce("text", F.lit(""))), "sender").alias("value"))
    long = table(spark, d, "region").select(F.concat(F.lit("0;0;TEXT;x;USER;one;two "), F.col("r_regionkey").cast("string")).alias("value"))
    head = documents.line(spark, "﻿ticket_id;seq;category;text;sender")
    documents.write_lines([head, lines, long], path, "messages.csv")
    return _digests(tables.read_messages(spark, f"{path}/messages.csv", na_values=[]))


@query(_DIGESTS)
def json_messages(spark, d):
    """A JSON array of objects."""
    path = work_dir(spark, "messages-json")
    documents.write_array(_hard(spark, d), path)
    return _digests(tables.read_messages(spark, f"{path}/array.json", na_values=[]))


@query(f"WITH {CATEGORISED} SELECT CAST(ticket_id AS VARCHAR) AS ticket_id, categoria, row_number() OVER (ORDER BY CAST(ticket_id AS VARCHAR)) AS nr FROM c")
def categorised_file(spark, d):
    """The file of categorised tickets, in its order, read again."""
    path = work_dir(spark, "categorised")
    reports.write_categorised(categorised(spark, d).select(F.col("ticket_id").cast("string").alias("ticket_id"), "categoria"), path)
    part = next(n for n in documents.names_in(spark, path) if n.endswith(".csv"))
    rows = tables.read_messages(spark, f"{path}/{part}", na_values=[], position="nr")
    return rows.select("ticket_id", "categoria", (F.col("nr") + 1).alias("nr"))


@query(f"WITH {USAGE} SELECT CAST(user_id AS VARCHAR) AS session_id, count(*) AS operations_count, CAST(sum(input_tokens) AS BIGINT) AS total_input_tokens, round(sum(cost_usd), 9) AS total_cost_usd FROM uc GROUP BY 1")
def session_array(spark, d):
    """Sessions appended in two parts, compacted, and appended to again."""
    u = cost.with_cost(usage(spark, d)).groupBy(F.col("user_id").cast("string").alias("session_id"))
    s = u.agg(F.count("*").alias("operations_count"), F.sum("input_tokens").alias("total_input_tokens"), F.sum("cost_usd").alias("total_cost_usd"))
    path, third = work_dir(spark, "sessions"), F.pmod(F.crc32(F.col("session_id").cast("binary")), F.lit(3))
    documents.append_array(s.filter(third == 0), path)
    documents.append_array(s.filter(third == 1), path)
    documents.compact_array(spark, path, reports.SESSIONS)
    documents.append_array(s.filter(third == 2), path)
    return _round(documents.read_array(spark, path, reports.SESSIONS).select("session_id", "operations_count", "total_input_tokens", "total_cost_usd"), "total_cost_usd", places=9)


@query(f"WITH {CATEGORISED}, d AS (SELECT categoria, count(*) AS n FROM c GROUP BY 1) SELECT 'tickets' AS sheet, CAST(ticket_id AS VARCHAR) AS a, categoria AS b FROM c UNION ALL SELECT 'counts', categoria, CAST(n AS VARCHAR) FROM d")
def workbook_sheets(spark, d):
    """Two sheets of a workbook, read again by their names."""
    c, path = categorised(spark, d), f"{work_dir(spark, 'book')}/report.xlsx"
    workbook.write_workbook({"tickets": c, "counts": stats.value_counts(c, "categoria")}, path)
    sheet = lambda name: tables.read_sheet(spark, path, name).toDF("a", "b").select(F.lit(name).alias("sheet"), "a", "b")
    return sheet("tickets").unionByName(sheet("counts"))


@query(f"WITH {CATEGORISED} SELECT section, count(*) AS lines FROM (SELECT 'distribution' AS section FROM c GROUP BY categoria UNION ALL SELECT 'tickets' FROM c) GROUP BY 1")
def report_rows(spark, d):
    """Rows of each section of a report's CSV: all of them."""
    c, path = categorised(spark, d), work_dir(spark, "report")
    reports.sections_csv({"distribution": stats.category_distribution(c, "categoria"), "tickets": c}, path)
    rows = spark.read.csv(path, schema="section string, a string, b string, c string, d string, e string").groupBy("section").agg((F.count("*") - 1).alias("lines"))  # but the names
    return rows


@query(f"WITH {USAGE} SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS hour, count(*) AS n, round(sum(cost_usd), 9) AS cost_usd FROM uc GROUP BY 1")
def streamed_hours(spark, d):
    """Usage as a file stream, by hour; the state is complete once all files are read."""
    path, name = work_dir(spark, "usage"), f"hours_{work_dir(spark, 'x').rsplit('-', 1)[1]}"
    events = usage(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(path)
    hours = streams.run_available(streams.hourly_usage(streams.file_stream(spark, path, events.schema)), name, "complete")
    return _round(hours.select(F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("hour"), "n", "cost_usd"), "cost_usd", places=9)


@query("""WITH RECURSIVE t AS (SELECT doc_id, length(text) // 4 AS tokens, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r, source FROM documents), f AS (
    SELECT source, doc_id, r, CAST(0 AS BIGINT) AS b, CAST(2 + tokens AS BIGINT) AS s, CAST(1 AS BIGINT) AS n FROM t WHERE r = 1 UNION ALL
    SELECT t.source, t.doc_id, t.r, CASE WHEN f.s >= 5000 OR f.n >= 50 THEN f.b + 1 ELSE f.b END, CASE WHEN f.s >= 5000 OR f.n >= 50 THEN t.tokens ELSE f.s + t.tokens END, CASE WHEN f.s >= 5000 OR f.n >= 50 THEN 1 ELSE f.n + 1 END
    FROM f JOIN t ON t.source = f.source AND t.r = f.r + 1)
    SELECT source AS shard, doc_id, b AS batch_id FROM f""")
def sequential_batches(spark, d):
    docs = table(spark, d, "documents").withColumn("tokens", text.estimate_tokens(F.col("text")))
    return pack.sequential_batches(docs, "doc_id", "tokens", limit=5000, shard_col="source")


@query("""SELECT o_orderkey AS id, o_custkey % 4 <> 0 AND o_custkey % 5 <> 0 AS valid FROM orders""")
def valid_taxonomies(spark, d):
    """Documents of one or two categories, of which some lack their name or all categories."""
    o = table(spark, d, "orders")
    named = lambda n: F.struct(F.lit(n).alias("id"), F.lit("t").alias("technical_name"), F.when(F.col("o_custkey") % 4 != 0, F.lit("n")).alias("display_name"), F.lit("d").alias("description"))
    found = F.when(F.col("o_custkey") % 5 != 0, F.when(F.col("o_orderkey") % 2 == 0, F.array(named(1))).otherwise(F.array(named(1), named(2)))).otherwise(F.slice(F.array(named(1)), 1, 0))
    return o.withColumn("categories", found).select(F.col("o_orderkey").alias("id"), jobs.valid_taxonomy().alias("valid"))


@query("""WITH d AS (SELECT doc_id, lang, source, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN '["a"]' ELSE '["a", "b"]' END AS bullets FROM documents), n AS (SELECT count(*) AS n FROM d), b AS (SELECT CASE WHEN bullets IS NOT NULL THEN json_array_length(bullets) END AS k FROM d)
    SELECT 'coverage.lang' AS metric, round(count(lang) * 100.0 / count(*), 2) AS value FROM d UNION ALL SELECT 'coverage.source', round(count(source) * 100.0 / count(*), 2) FROM d
    UNION ALL SELECT 'bullets.most', max(k) FROM b UNION ALL SELECT 'bullets.least', min(k) FROM b""")
def run_insights(spark, d):
    k = F.col("doc_id") % 3
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", F.when(k == 1, '["a"]').when(k == 2, '["a", "b"]').alias("bullets"))
    out = runs.insights(docs, ["lang", "source"]).withColumn("value", F.col("value").cast("double"))
    return out.filter(F.col("metric").startswith("coverage.") | F.col("metric").isin("bullets.most", "bullets.least"))


@query("SELECT event_id FROM events WHERE epoch(date_trunc('second', ts)) > (SELECT epoch(date_trunc('second', max(ts))) FROM events) - 24 * 3600")
def retained_snapshots(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    newest = e.agg(F.max("ts").alias("newest"))
    return cache.retained(e.crossJoin(F.broadcast(newest)), F.col("newest"), 24).select("event_id")  # a single row


@query("SELECT l_orderkey * 10 + l_linenumber AS id, greatest(0.1, least(pow(2, l_linenumber), 60.0)) AS delay FROM lineitem")
def backoff_delays(spark, d):
    from ..functions.numbers import retry_delays

    return table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), retry_delays(F.col("l_linenumber")).alias("delay"))


@query("""WITH n AS (SELECT count(*) AS n FROM orders), t AS (SELECT least(n, greatest(CASE WHEN n < 5000 THEN greatest(100, n * 200 // 1000) WHEN n < 20000 THEN greatest(500, n * 26 // 1000) ELSE greatest(1000, n * 20 // 1000) END,
    least(CAST(floor(n * 0.15) AS BIGINT), CASE WHEN n < 5000 THEN greatest(500, n * 500 // 1000) WHEN n < 20000 THEN least(1000, n * 52 // 1000) ELSE least(2000, n * 40 // 1000) END))) AS rows FROM n) SELECT rows, rows AS ids FROM t""")
def sample_size(spark, d):
    """Rows of a sample drawn by month, and their different ids."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("t"))
    drawn = sample.stratified(o, sample.target_size(o.count(), 0.15), "o_orderkey", "t")
    return drawn.agg(F.count("*").alias("rows"), F.count_distinct("o_orderkey").alias("ids"))


@query("""WITH t AS (SELECT doc_id, length(text) // 4 AS t FROM documents), p AS (SELECT doc_id, t, CAST(sum(t) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e FROM t), x AS (SELECT doc_id, e - t AS s, e FROM p),
    w AS (SELECT unnest(range(0, (SELECT CAST(max(s) // 4000 + 1 AS BIGINT) FROM x))) AS c), h AS (SELECT doc_id, s, c FROM x JOIN w ON c * 4000 <= s AND e <= c * 4000 + 5000)
    SELECT c AS chunk_id, doc_id, s AS position FROM h UNION ALL
    SELECT min(c), doc_id, s FROM x JOIN w ON c * 4000 <= s AND s < c * 4000 + 5000 WHERE doc_id NOT IN (SELECT doc_id FROM h) GROUP BY doc_id, s""")
def overlapping_chunks(spark, d):
    docs = table(spark, d, "documents").withColumn("tokens", text.estimate_tokens(F.col("text")))
    return pack.overlapping_chunks(docs, "doc_id", "tokens", 5000, 1000)


@query(f"""WITH {MESSAGES}, n AS (SELECT count(DISTINCT ticket_id) AS n FROM (SELECT ticket_id FROM m GROUP BY 1)) SELECT n AS tickets, true AS same FROM n""")
def discover_with_overlap(spark, d):
    """Discovery over overlapping chunks finds the categories of discovery over single ones."""
    t = messages(spark, d).groupBy("ticket_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), " ").alias("text"))
    named = lambda found: found.select(F.transform("categories", lambda c: c["technical_name"]).alias("names"), "discovery_stats.unique_tickets")
    one, other = named(jobs.discover(t, tokens=2000)), named(jobs.discover(t, tokens=2000, overlap=400)).withColumnsRenamed({"names": "names2", "unique_tickets": "tickets"})
    return one.crossJoin(F.broadcast(other)).select("tickets", (F.array_sort("names") == F.array_sort("names2")).alias("same"))  # single rows


# --- responses built from the texts, so that what is escaped, nested and how long it is varies


def _responses(spark, d, c, before: str, after: str) -> DataFrame:
    """doc_id, the text (null: empty) and a response that holds a JSON document made of it."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return docs.withColumn("response", F.concat(F.lit(before), F.to_json(c), F.lit(after)))


_T = "coalesce(text, '') AS t"


@query(f"WITH d AS (SELECT doc_id, {_T} FROM documents) SELECT doc_id, sha256(t) AS digest, length(t) AS n FROM d")
def fenced_texts(spark, d):
    """The text comes out of a fenced response as it went in."""
    rows = _responses(spark, d, F.struct(F.struct("text").alias("d")), "Here you are, {as asked}:\n```json\n", "\n```\nThat is all }")
    found = F.from_json(jsonx.extract_json(F.col("response")), "d struct<text:string>")["d"]["text"]
    return rows.select("doc_id", F.sha2(F.coalesce(found, F.lit("lost")), 256).alias("digest"), F.length(found).alias("n"))


@query(f"WITH d AS (SELECT doc_id, {_T} FROM documents) SELECT doc_id, CAST(doc_id AS VARCHAR) || '=' || sha256(trim(t, ' ')) || ',' || CAST(length(t) AS VARCHAR) || ',b' AS items, 'more than three categories' AS issues FROM d")
def text_items(spark, d):
    """Items whose categories are texts: the first three are kept, and a fourth is named as an issue."""
    item = F.struct(F.col("doc_id").cast("string").alias("id"), F.array("text", F.length("text").cast("string"), F.lit(" b "), F.lit("c")).alias("cat"))
    rows = _responses(spark, d, F.struct(F.array(item).alias("cat")), "ok ", " end")
    shown = lambda x: F.concat(x["id"], F.lit("="), F.sha2(x["cat"][0], 256), F.lit(","), F.array_join(F.slice(x["cat"], 2, 3), ","))
    items = F.transform(jsonx.items_of(F.col("response")), shown)
    return rows.select("doc_id", F.array_join(items, ";").alias("items"), F.array_join(jsonx.response_issues(F.col("response"), "json"), ";").alias("issues"))


@query(f"WITH d AS (SELECT doc_id, {_T} FROM documents) SELECT doc_id, CASE WHEN t <> '' THEN CAST(doc_id AS VARCHAR) || ':' || sha256(t) ELSE '' END AS items FROM d")
def text_batch_items(spark, d):
    """Items of a batch: those whose summary, the text, isn't empty."""
    item = F.struct(F.col("doc_id").cast("string").alias("ticket_id"), F.array(F.lit("a")).alias("categorias"), F.col("text").alias("resumo"))
    rows = _responses(spark, d, F.array(item), "see ", " (end)")
    items = F.transform(jsonx.batch_items(F.col("response")), lambda x: F.concat(x["ticket_id"], F.lit(":"), F.sha2(x["resumo"], 256)))
    return rows.select("doc_id", F.array_join(items, ";").alias("items"))


@query(f"WITH d AS (SELECT doc_id, {_T} FROM documents) SELECT doc_id, CAST((trim(t, ' ') <> '') AS INTEGER) + 1 AS bullets, sha256(trim(t, ' ')) AS digest FROM d WHERE NOT regexp_matches(t, '[{{}}]')")
def text_bullets(spark, d):
    """Bullets that are texts (without braces, as an object is told by them), blank ones gone."""
    bullet = lambda c: F.struct(c.alias("bullet"))
    whole = F.struct(F.array(bullet(F.col("text")), bullet(F.lit(" last "))).alias("bullets"), F.col("text").alias("resumo"))
    rows = _responses(spark, d, whole, "{bad} then ", " and {more}").filter(~F.col("text").rlike("[{}]"))
    b = jsonx.bullets_of(F.col("response"), 2)
    return rows.select("doc_id", F.size(b["bullets"]).alias("bullets"), F.sha2(b["resumo"], 256).alias("digest"))


# --- model jobs that keep what they have


@query(f"SELECT ticket_id, category_ids FROM ({ORACLE_SQL['classify_with_taxonomy']})")
def classify_twice(spark, d):
    """Classification with stored results; the second run reads them all."""
    from ..operators.prepare import prepare_tickets

    tickets, path = materialise(prepare_tickets(messages(spark, d)), "tickets"), work_dir(spark, "results")
    taxonomy = materialise(jobs.discover(tickets), "taxonomy")
    jobs.classify_cached(tickets, taxonomy, path, buckets=4).write.format("noop").mode("overwrite").save()
    return jobs.classify_cached(tickets, taxonomy, path, buckets=4)


@query(f"SELECT replace(resumo, '; ', chr(10)) AS result FROM ({ORACLE_SQL['summarise_tickets']})")
def compressed_analysis(spark, d):
    """The reduced analysis of all tickets, from partial results that are kept, and a call that shortens it."""
    from ..operators.prepare import prepare_tickets

    chunks = jobs.ticket_chunks(prepare_tickets(messages(spark, d)), 2000, shards=1)
    reduced = jobs.map_reduce(chunks, jobs.KeywordModel(), folder=work_dir(spark, "reduced"))
    return jobs.compress(reduced).select("result")
