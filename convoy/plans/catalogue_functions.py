"""Registered queries of text, JSON and score functions, and of the model jobs with the
deterministic keyword model. Responses are built from ids, so that SQL names the right
result of each case."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsonx, numbers, text
from ..functions.text import DEFAULT_CATEGORY, KEYWORD_RULES
from ..operators import cost, pack, prepare, sample, stats, trend
from .adapters import MESSAGES, SIZES, USAGE, messages, sizes, table, usage
from .catalogue import _KEPT, _round, query


def _cases(spark, d, *values):
    """doc_id and a text by doc_id modulo the number of texts; `#` stands for the id."""
    k = F.col("doc_id") % len(values)
    out = F.lit(None).cast("string")
    for i, v in enumerate(values):
        out = F.when(k == i, F.lit(None).cast("string") if v is None else F.replace(F.lit(v), F.lit("#"), F.col("doc_id").cast("string"))).otherwise(out)
    return table(spark, d, "documents").select("doc_id", out.alias("c"))


def _case_sql(name: str, *values) -> str:
    """The same, as SQL with the expected results."""
    one = lambda v: "NULL" if v is None else str(v) if isinstance(v, int | float) else "replace('" + v.replace("'", "''") + "', '#', CAST(doc_id AS VARCHAR))"
    return f"SELECT doc_id, CASE doc_id % {len(values)} " + " ".join(f"WHEN {i} THEN {one(v)}" for i, v in enumerate(values)) + f" END AS {name} FROM documents"


_RESPONSES = ('ok {"cat":[{"id":"#","cat":["a"," b ","c","d"]}]} end', '{"cat":[{"cat":["a"]}]}', "no json here", '{"cat":[{"id":"#","cat":["x"]},{"id":"y"}]}')


@query(_case_sql("items", "#=a,b,c", "", None, "#=x"))
def response_items(spark, d):
    items = F.transform(jsonx.items_of(F.col("c")), lambda x: F.concat(x["id"], F.lit("="), F.array_join(x["cat"], ",")))
    return _cases(spark, d, *_RESPONSES).select("doc_id", F.array_join(items, ";").alias("items"))


@query(_case_sql("issues", "more than three categories", "item without id or cat", "missing or invalid cat list", "item without id or cat"))
def response_issues(spark, d):
    return _cases(spark, d, *_RESPONSES).select("doc_id", F.array_join(jsonx.response_issues(F.col("c"), "json"), ";").alias("issues"))


@query("SELECT doc_id, CASE WHEN length(text) < 50 THEN 'too short' WHEN length(text) > 5000 THEN 'too long' ELSE '' END AS issues FROM documents")
def text_issues(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(jsonx.response_issues(F.col("text"), "text"), ";").alias("issues"))


@query(_case_sql("ids", "#", "", "", None))
def batch_items(spark, d):
    rows = _cases(spark, d, 'see [{"ticket_id":"#","categorias":["a"],"resumo":"r"}]', '[{"ticket_id":"#","categorias":[],"resumo":"r"}]', '[{"ticket_id":"#","categorias":["a"],"resumo":""}]', "none")
    return rows.select("doc_id", F.array_join(F.transform(jsonx.batch_items(F.col("c")), lambda x: x["ticket_id"]), ";").alias("ids"))


@query(_case_sql("found", "one,two|sum #|another number of bullets", "||no bullets;no summary", "a|s|another number of bullets"))
def summary_bullets(spark, d):
    b = jsonx.bullets_of(F.col("c"), 15)
    rows = _cases(spark, d, '{"bullets":[{"bullet":" one "},{"bullet":""},{"bullet":"two"}],"resumo":"sum #"}', "nothing", 'x {"bullets":[{"bullet":"a"}],"resumo":" s "}')
    return rows.select("doc_id", F.concat_ws("|", F.array_join(b["bullets"], ","), b["resumo"], F.array_join(b["issues"], ";")).alias("found"))


@query(_case_sql("kind", "RATE_LIMIT_EXCEEDED:true", "TIMEOUT:true", "CONNECTION_ERROR:true", "JSON_DECODE_ERROR:true", "INTERNAL_ERROR:true", "UNKNOWN_ERROR:false"))
def error_kinds(spark, d):
    kind = numbers.error_kind(F.col("c"))
    rows = _cases(spark, d, "Quota reached #", "request timed out", "Network down #", "json: could not decode", "Internal trouble", "strange #")
    return rows.select("doc_id", F.concat_ws(":", kind, numbers.retryable(kind).cast("string")).alias("kind"))


@query(_case_sql("totals", "#|{'USER': 2}", "0|", None))
def message_totals(spark, d):
    n, histogram = text.message_totals(F.col("c"))
    rows = _cases(spark, d, "Total: # mensagens ({'USER': 2})", "Total: 0 mensagens ()", None)
    return rows.select("doc_id", F.when(F.col("c").isNotNull(), F.concat_ws("|", F.coalesce(n, F.lit(0)).cast("string"), histogram)).alias("totals"))


@query(_case_sql("ids", "#,7", "", "12"))
def named_tickets(spark, d):
    rows = _cases(spark, d, "Ticket #: a\nTicket 7: b", "ticket 5: small", "xTicket 12:y Ticket :")
    return rows.select("doc_id", F.array_join(text.ticket_ids_in(F.col("c")), ",").alias("ids"))


@query("SELECT n_nationkey, CAST(n_nationkey AS VARCHAR) || '. ' || n_name || ': region ' || CAST(n_regionkey AS VARCHAR) || CASE WHEN n_nationkey % 2 = 0 THEN ' (ex: a, b)' ELSE '' END AS line FROM nation")
def category_lines(spark, d):
    examples = F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("a"), F.lit("b"), F.lit("c"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "nation").select("n_nationkey", text.category_line(F.col("n_nationkey"), F.col("n_name"), F.concat(F.lit("region "), F.col("n_regionkey").cast("string")), examples).alias("line"))


@query(_case_sql("json", '{"a": #}', '{"b": 1}', "no json #", '{"d": {"e": 2}}'))
def extracted_json(spark, d):
    rows = _cases(spark, d, 'text {"a": #} more', '```json\n{"x": 0}\n``` then ```json\n{"b": 1}\n``` end', "  no json # ", 'see ```json {"d": {"e": 2}} ```')
    return rows.select("doc_id", jsonx.extract_json(F.col("c")).alias("json"))


@query(_case_sql("json", '{"a": {"b": #}}', '{"c": 1}', None))
def first_json_object(spark, d):
    rows = _cases(spark, d, '{bad} then {"a": {"b": #}} and {"c": 1}', 'x {"c": 1} y', "{broken")
    return rows.select("doc_id", jsonx.first_object(F.col("c")).alias("json"))


@query("SELECT count(DISTINCT (n_regionkey, length(n_name))) AS keys FROM nation")
def canonical_keys(spark, d):
    n = table(spark, d, "nation")
    a = n.select(F.sha2(jsonx.canonical({"r": F.col("n_regionkey"), "l": F.length("n_name")}), 256).alias("k"))
    b = n.select(F.sha2(jsonx.canonical({"l": F.length("n_name"), "r": F.col("n_regionkey")}), 256).alias("k"))
    return a.unionByName(b).agg(F.count_distinct("k").alias("keys"))


@query(f"WITH {MESSAGES} SELECT ticket_id, seq FROM m WHERE category = 'TEXT' AND sender IN ('USER', 'AGENT') AND trim(text) <> ''")
def demo_messages(spark, d):
    return prepare.demo_filter(messages(spark, d)).select("ticket_id", "seq")


@query("WITH t AS (SELECT source FROM documents GROUP BY 1 ORDER BY count(*) DESC, source LIMIT 3) SELECT doc_id FROM documents WHERE source IN (FROM t)")
def top_source_rows(spark, d):
    return stats.in_top(table(spark, d, "documents").select("doc_id", "source"), "source", 3).select("doc_id")


@query(_case_sql("year", 2024, None, None))
def parsed_times(spark, d):
    rows = _cases(spark, d, "2024-01-02 03:04:05", "no time", None)
    return rows.select("doc_id", F.year(prepare.parse_time(F.col("c"))).alias("year"))


# --- scores


@query("""SELECT o_orderkey AS id, round(0.6 / (1 + 100 * (o_custkey % 100 / 1000.0)) + 0.4 * least(o_orderkey % 400 / 200.0, 1), 6) AS efficiency, round(CASE WHEN 1 + o_custkey % 12 <= 4 THEN (1 + o_custkey % 12) / 4.0 ELSE greatest(0.5, 1 - (1 + o_custkey % 12 - 4) * 0.1) END, 6) AS utilisation,
    round(0.4 * (o_custkey % 100 / 100.0) + 0.3 * coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 100 / 100.0 END, 0.5) + 0.3 * 0.5, 6) AS health FROM orders""")
def scores(spark, d):
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    out = table(spark, d, "orders").select(
        o.alias("id"), numbers.efficiency_score(c % 100 / 1000, (o % 400).cast("double")).alias("efficiency"), numbers.utilisation_score(1 + c % 12).alias("utilisation"),
        numbers.health_score(c % 100 / 100, F.when(o % 2 == 0, o % 100 / 100), F.lit(None).cast("double")).alias("health"),
    )
    return _round(out, "efficiency", "utilisation", "health")


@query("""SELECT o_orderkey AS id, round(greatest(0, [1.0, 2.5, 4.0, 6.0][1 + o_custkey % 4] * [3.0, 2.0, 1.0][1 + o_custkey % 3] * 0.8 + least(o_custkey % 500 / 100.0, 2) - 0.2 * (o_orderkey % 40)), 6) AS priority FROM orders""")
def priority_scores(spark, d):
    c = F.col("o_custkey")
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    score = numbers.priority_score(pick(("low", "medium", "high", "critical"), c % 4), pick(("easy", "moderate", "complex"), c % 3), F.lit(0.8), (c % 500).cast("double"), F.col("o_orderkey") % 40)
    return _round(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), score.alias("priority")), "priority")


@query("SELECT o_orderkey AS id, round_even(o_custkey / 8.0, 2) AS rounded FROM orders")
def rounded_even(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), numbers.round_even(F.col("o_custkey") / 8, 2).alias("rounded"))


@query(f"""SELECT n, CASE WHEN n < 5000 THEN greatest(100, n * 200 // 1000) WHEN n < 20000 THEN greatest(500, n * 26 // 1000) ELSE greatest(1000, n * 20 // 1000) END AS low,
    greatest(low, CASE WHEN n < 5000 THEN greatest(500, n * 500 // 1000) WHEN n < 20000 THEN least(1000, n * 52 // 1000) ELSE least(2000, n * 40 // 1000) END) AS high FROM {SIZES} t(n)""")
def sample_bounds(spark, d):
    low, high = sample.bounds_of(F.col("dataset_size"))
    return sizes(spark, d).select(F.col("dataset_size").alias("n"), low.cast("long").alias("low"), high.cast("long").alias("high"))


@query("SELECT CAST(sum(length(text) // 4) // 50000 + 1 AS BIGINT) AS batches FROM documents")
def batch_estimate(spark, d):
    return pack.batch_estimate(table(spark, d, "documents"), "text", 50_000)


@query("""SELECT o_orderkey AS id, concat_ws('; ', CASE WHEN o_custkey * 100 > 50000 THEN 'large dataset' END, CASE WHEN o_orderkey % 16 > 8 THEN 'many workers' END, CASE WHEN o_totalprice / 1000 > 100 THEN 'high cost' END) AS risks FROM orders""")
def scenario_risks(spark, d):
    risks = cost.risks(F.col("o_custkey") * 100, F.col("o_orderkey") % 16, F.col("o_totalprice") / 1000)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.array_join(risks, "; ").alias("risks"))


@query("""WITH r AS (SELECT o_orderkey AS name, ['easy', 'moderate', 'complex'][1 + o_custkey % 3] AS complexity, o_totalprice AS priority FROM orders), k AS (SELECT *, row_number() OVER (PARTITION BY complexity ORDER BY priority DESC, name) AS rank FROM r)
    SELECT name, CASE complexity WHEN 'easy' THEN 1 WHEN 'moderate' THEN 2 ELSE 3 END AS phase, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= CASE complexity WHEN 'easy' THEN 5 WHEN 'moderate' THEN 4 ELSE 2 END""")
def implementation_plan(spark, d):
    level = F.element_at(F.array(F.lit("easy"), F.lit("moderate"), F.lit("complex")), (F.col("o_custkey") % 3 + 1).cast("int"))
    return cost.implementation_plan(table(spark, d, "orders").select(F.col("o_orderkey").alias("name"), level.alias("complexity"), F.col("o_totalprice").alias("priority"))).select("name", "phase", "rank")


@query(f"""WITH {USAGE}, s AS (SELECT user_id, sum(cost_usd) / count(*) AS c, sum(total_tokens) / nullif(CAST(epoch(date_trunc('second', max(ts))) - epoch(date_trunc('second', min(ts))) AS DOUBLE), 0) AS t FROM uc GROUP BY 1)
    SELECT round(avg(c), 9) AS mean, round(min(c), 9) AS least, round(max(c), 9) AS most, round(avg(t), 4) AS throughput, round(1000 / avg(c), 2) AS score FROM s""")
def efficiency_metrics(spark, d):
    out = cost.efficiency_metrics(cost.sessions(usage(spark, d), "user_id"))
    return _round(_round(_round(out, "mean", "least", "most", places=9), "throughput", places=4), "score", places=2)


@query("""WITH b AS (SELECT o_custkey AS k, avg(o_totalprice) AS each FROM orders GROUP BY 1), s AS (SELECT k, each, lead(each) OVER (ORDER BY k) - each AS dy, lead(k) OVER (ORDER BY k) - k AS dx FROM b WHERE k < 500) SELECT min(k) FILTER (WHERE dy / dx > -1e-6) AS from_size FROM s""")
def diminishing_returns(spark, d):
    b = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.avg("o_totalprice").alias("each")).filter("k < 500")
    return trend.diminishing_returns(b, "k", "each")


@query("""SELECT count(*) AS categories, CAST(sum(n_regionkey) AS BIGINT) AS subcategories, round(avg(1 + n_nationkey % 4), 1) AS mean_keywords, round(avg(n_nationkey % 3), 1) AS mean_examples, count(*) FILTER (WHERE n_regionkey = 0) AS simple, count(*) FILTER (WHERE n_regionkey IN (1, 2)) AS medium, count(*) FILTER (WHERE n_regionkey > 2) AS complex FROM nation""")
def taxonomy_stats(spark, d):
    some = lambda n: F.array_repeat(F.lit("x"), n.cast("int"))
    n = table(spark, d, "nation").select(some(1 + F.col("n_nationkey") % 4).alias("keywords"), some(F.col("n_nationkey") % 3).alias("examples"), some(F.col("n_regionkey")).alias("subcategories"))
    return stats.taxonomy_stats(n)


@query("""WITH r AS (SELECT CASE WHEN n_nationkey = 0 THEN 'baseline' ELSE n_name END AS name, n_nationkey % 7 * 1.0 AS cost, n_nationkey % 5 * 2.0 AS minutes, n_nationkey % 9 / 10.0 AS confidence FROM nation), f AS (
    SELECT name, 'cost' AS metric, cost AS value FROM r UNION ALL SELECT name, 'minutes', minutes FROM r UNION ALL SELECT name, 'confidence', confidence FROM r), b AS (SELECT metric, value AS base FROM f WHERE name = 'baseline')
    SELECT name, metric, round(value - base, 6) AS delta, CASE metric WHEN 'confidence' THEN value > base ELSE value < base END AS improved FROM f JOIN b USING (metric) WHERE name <> 'baseline'""")
def baseline_comparison(spark, d):
    k = F.col("n_nationkey")
    r = table(spark, d, "nation").select(F.when(k == 0, "baseline").otherwise(F.col("n_name")).alias("name"), (k % 7).cast("double").alias("cost"), (k % 5 * 2).cast("double").alias("minutes"), (k % 9 / 10).alias("confidence"))
    return _round(stats.baseline_comparison(r).select("name", "metric", "delta", "improved"), "delta")


# --- jobs with the keyword model

_quote = lambda s: "'" + s.replace("'", "''") + "'"
_HIT = lambda words, c: "(" + " OR ".join(f"contains(lower({c}), {_quote(w)})" for w in words) + ")"
_TICKETS = f"""{_KEPT}, tk AS (SELECT k.ticket_id, string_agg(text, ' ' ORDER BY seq) AS text FROM k JOIN g ON k.ticket_id = g.ticket_id GROUP BY k.ticket_id)"""
_NAMES = lambda c: "list_filter([" + ", ".join(f"CASE WHEN {_HIT(words, c)} THEN {_quote(name)} END" for name, words in KEYWORD_RULES) + "], lambda x: x IS NOT NULL)"
_NUMBERS = lambda c: "list_filter([" + ", ".join(f"CASE WHEN {_HIT(words, c)} THEN {i} END" for i, (_, words) in enumerate(KEYWORD_RULES, 1)) + "], lambda x: x IS NOT NULL)"
_FOUND = f"""fd AS (SELECT CAST(row_number() OVER (ORDER BY nr) AS INTEGER) AS id, name FROM (VALUES {", ".join(f"({i}, {_quote(n)})" for i, (n, _) in enumerate(KEYWORD_RULES))}) v(nr, name) WHERE name IN (SELECT unnest({_NAMES("'Ticket ' || ticket_id || ':' || chr(10) || text")}) FROM tk))"""


def _tickets(spark, d):
    return prepare.prepare_tickets(messages(spark, d))


@query(f"WITH {_TICKETS}, h AS (SELECT ticket_id, {_NUMBERS('text')}[1:3] AS ids FROM tk) SELECT ticket_id, array_to_string(ids, ',') AS category_ids, CASE WHEN len(ids) > 0 THEN 0.9 ELSE 0.5 END AS confidence FROM h")
def classify_tickets(spark, d):
    from . import jobs

    return jobs.classify(_tickets(spark, d)).select("ticket_id", "category_ids", "confidence")


@query(f"WITH {_TICKETS}, h AS (SELECT ticket_id, {_NAMES('text')}[1:3] AS names FROM tk) SELECT ticket_id, unnest(CASE WHEN len(names) > 0 THEN names ELSE [{_quote(DEFAULT_CATEGORY)}] END) AS categoria FROM h")
def classify_in_batches(spark, d):
    from . import jobs

    return jobs.classify_batches(_tickets(spark, d))


@query(f"WITH {_TICKETS}, {_FOUND} SELECT id, name AS display_name, 'Tickets: ' || name AS description FROM fd")
def discover_taxonomy(spark, d):
    from . import jobs

    return jobs.categories_of(jobs.discover(_tickets(spark, d), tokens=2000)).select("id", "display_name", "description")


@query(f"WITH {_TICKETS}, {_FOUND} SELECT (SELECT count(*) FROM tk) AS total_tickets_analyzed, (SELECT count(*) FROM tk) AS unique_tickets, CAST(count(*) AS INTEGER) AS categories_created, least(0.95, round(0.6 + count(*) * 0.02, 6)) AS confidence_level, CASE WHEN count(*) < 5 THEN 'few' ELSE 'expected' END AS category_count FROM fd")
def taxonomy_statistics(spark, d):
    from . import jobs

    found = jobs.discover(_tickets(spark, d)).select("discovery_stats.*")
    return _round(found.select("total_tickets_analyzed", "unique_tickets", "categories_created", "confidence_level", "category_count"), "confidence_level")


@query(f"""WITH {_TICKETS}, {_FOUND}, h AS (SELECT ticket_id, unnest(list_filter({_NAMES('text')}, lambda x: TRUE)) AS name FROM tk), n AS (SELECT ticket_id, fd.id, fd.name, row_number() OVER (PARTITION BY ticket_id ORDER BY fd.id) AS r FROM h JOIN fd USING (name))
    SELECT ticket_id, coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FILTER (WHERE r <= 3), '') AS category_ids, coalesce(string_agg(name, ',' ORDER BY id) FILTER (WHERE r <= 3), '') AS category_names, CASE WHEN count(id) > 0 THEN 0.9 ELSE 0.5 END AS confidence FROM tk LEFT JOIN n USING (ticket_id) GROUP BY 1""")
def classify_with_taxonomy(spark, d):
    from . import jobs

    tickets = _tickets(spark, d)
    return jobs.classify_with(tickets, jobs.discover(tickets)).select("ticket_id", "category_ids", "category_names", "confidence")


@query(f"WITH {_TICKETS}, {_FOUND} SELECT coalesce(string_agg(name, '; ' ORDER BY id), {_quote(DEFAULT_CATEGORY)}) AS resumo, CAST(15 AS INTEGER) AS bullets, '' AS issues FROM fd")
def summarise_tickets(spark, d):
    from . import jobs

    return jobs.summarise(_tickets(spark, d)).select("resumo", F.size("bullets").alias("bullets"), F.array_join("issues", ";").alias("issues"))


@query(f"WITH {MESSAGES}, n AS (SELECT ticket_id, sum(length(text) // 4) AS t FROM m GROUP BY 1) SELECT count(*) AS tickets FROM n")
def ticket_batches(spark, d):
    """Tickets that the sequential batcher deals out, each once."""
    t = messages(spark, d).groupBy("ticket_id").agg(F.sum(F.floor(F.length("text") / 4)).alias("tokens")).withColumn("shard", F.pmod(F.xxhash64("ticket_id"), F.lit(8)))
    return pack.sequential_batches(t, "ticket_id", "tokens", 2000, 20, "shard").agg(F.count_distinct("ticket_id").alias("tickets"))
