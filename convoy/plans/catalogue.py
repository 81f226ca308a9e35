"""The registered queries over the reference tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import jsonx, text
from ..operators import alerts, cost, joins, pack, planning, prepare, sample, stats, trend
from .adapters import CATEGORISED, HOURLY, LABELS, MESSAGES, RESULTS, SIZES, USAGE, categorised, hourly, messages, predictions, results, sizes, table, truth, usage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _round(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


_IS_TEXT = "lower(trim(category)) = 'text'"
_AI = ", ".join(f"'{s}'" for s in text.AI_SENDERS)
_CLEAN = text.clean_text_sql("coalesce(text, '')")
_KEPT = f"""{MESSAGES}, f AS (
    SELECT ticket_id, seq, sender, ticket_created_at, {_CLEAN} AS text FROM m WHERE {_IS_TEXT} AND lower(trim(sender)) NOT IN ({_AI})), k AS (
    SELECT * FROM f WHERE trim(text) <> ''), g AS (
    SELECT ticket_id FROM k GROUP BY 1 HAVING count(*) FILTER (WHERE sender = 'USER') >= 2 AND count(*) FILTER (WHERE sender IN ('AGENT', 'HELPDESK_INTEGRATION')) >= 2)"""


# --- preparation


@query(f"""WITH {_KEPT}, s AS (SELECT ticket_id, sender, count(*) AS n FROM k GROUP BY 1, 2), hs AS (
    SELECT ticket_id, 'Total: ' || CAST(CAST(sum(n) AS BIGINT) AS VARCHAR) || ' mensagens ({{' || string_agg('''' || sender || ''': ' || CAST(n AS VARCHAR), ', ' ORDER BY n DESC, sender) || '}})' AS sender FROM s GROUP BY 1)
    SELECT k.ticket_id, string_agg(text, ' ' ORDER BY seq) AS text, min(ticket_created_at) AS ticket_created_at, min(hs.sender) AS sender
    FROM k JOIN g ON k.ticket_id = g.ticket_id JOIN hs ON k.ticket_id = hs.ticket_id GROUP BY k.ticket_id""")
def prepare_tickets(spark, d):
    return prepare.prepare_tickets(messages(spark, d))


@query(f"WITH {MESSAGES} SELECT ticket_id, seq FROM m WHERE {_IS_TEXT}")
def filter_category_text(spark, d):
    return prepare.filter_category(messages(spark, d)).select("ticket_id", "seq")


@query(f"WITH {MESSAGES} SELECT ticket_id, seq, sender FROM m WHERE lower(trim(sender)) NOT IN ({_AI})")
def filter_ai_senders(spark, d):
    return prepare.drop_ai_messages(messages(spark, d)).select("ticket_id", "seq", "sender")


@query(f"WITH {MESSAGES} SELECT ticket_id, seq FROM m WHERE ticket_id IN (SELECT ticket_id FROM m GROUP BY 1 HAVING count(*) FILTER (WHERE sender = 'USER') >= 2 AND count(*) FILTER (WHERE sender IN ('AGENT', 'HELPDESK_INTEGRATION')) >= 2)")
def valid_ticket_semijoin(spark, d):
    return prepare.valid_messages(messages(spark, d)).select("ticket_id", "seq")


@query(f"""WITH {MESSAGES}, b AS (
    SELECT ticket_id, sender, {_IS_TEXT} AS a, trim({_CLEAN}) <> '' AS b, lower(trim(sender)) NOT IN ({_AI}) AS c FROM m), t AS (
    SELECT ticket_id, count(*) AS raw, count(*) FILTER (WHERE a) AS category, count(*) FILTER (WHERE a AND b) AS fields, count(*) FILTER (WHERE a AND b AND c) AS human,
           count(*) FILTER (WHERE a AND b AND c AND sender = 'USER') >= 2 AND count(*) FILTER (WHERE a AND b AND c AND sender IN ('AGENT', 'HELPDESK_INTEGRATION')) >= 2 AS ok FROM b GROUP BY 1), x AS (
    SELECT sum(raw) AS raw, sum(category) AS category, sum(fields) AS fields, sum(human) AS human, sum(CASE WHEN ok THEN human ELSE 0 END) AS valid, count(*) FILTER (WHERE ok) AS tickets FROM t), y AS (
    SELECT raw, 'raw' AS step, raw AS n FROM x UNION ALL SELECT raw, 'category', category FROM x UNION ALL SELECT raw, 'fields', fields FROM x
    UNION ALL SELECT raw, 'human', human FROM x UNION ALL SELECT raw, 'valid', valid FROM x UNION ALL SELECT raw, 'tickets', tickets FROM x)
    SELECT step, CAST(n AS BIGINT) AS n, round(n * 100.0 / raw, 2) AS percent FROM y""")
def filtering_funnel(spark, d):
    return prepare.filtering_report(messages(spark, d))


@query(f"""WITH {MESSAGES}, n AS (SELECT ticket_id, count(*) FILTER (WHERE sender = 'USER') AS u, count(*) FILTER (WHERE sender IN ('AGENT', 'HELPDESK_INTEGRATION')) AS a FROM m GROUP BY 1)
    SELECT round(avg(u), 6) AS mean_user, round(median(u), 6) AS median_user, max(u) AS max_user, round(avg(a), 6) AS mean_agent, round(median(a), 6) AS median_agent, max(a) AS max_agent FROM n""")
def messages_per_ticket(spark, d):
    return _round(prepare.messages_per_ticket(messages(spark, d)), "mean_user", "median_user", "mean_agent", "median_agent")


@query(f"""WITH {MESSAGES}, x AS (SELECT * FROM m WHERE trim(coalesce(text, '')) <> '')
    SELECT ticket_id, string_agg('[' || coalesce(sender, 'UNKNOWN') || ']: ' || text, chr(10) ORDER BY seq) AS text, count(*) AS n_messages FROM x GROUP BY 1""")
def conversation_texts(spark, d):
    return prepare.conversation_texts(messages(spark, d))


@query(f"""WITH {MESSAGES}, n AS (SELECT ticket_id, CAST(count(*) AS DOUBLE) AS n FROM m GROUP BY 1)
    SELECT round(avg(n), 6) AS mean, CAST(min(n) AS BIGINT) AS least, CAST(max(n) AS BIGINT) AS most, round(stddev_samp(n), 6) AS std,
           round(quantile_cont(n, 0.25), 6) AS q25, round(quantile_cont(n, 0.5), 6) AS q50, round(quantile_cont(n, 0.75), 6) AS q75 FROM n""")
def message_quartiles(spark, d):
    tickets = prepare.group_tickets(messages(spark, d))
    return _round(prepare.message_distribution(tickets), "mean", "std", "q25", "q50", "q75")


@query(f"""WITH {MESSAGES} SELECT min(ticket_created_at) AS first, max(ticket_created_at) AS last,
    CAST(floor((epoch(max(ticket_created_at)) - epoch(min(ticket_created_at))) / 86400) AS BIGINT) AS days FROM m""")
def ticket_dates(spark, d):
    return prepare.date_range(messages(spark, d)).select(F.col("first").cast("timestamp_ntz").alias("first"), F.col("last").cast("timestamp_ntz").alias("last"), "days")


@query("""WITH l AS (SELECT doc_id AS id, text AS t, length(text) AS n FROM documents), b AS (SELECT quantile_cont(n, 0.05) AS lo, quantile_cont(n, 0.95) AS hi FROM l)
    SELECT round(count(*) FILTER (WHERE t IS NOT NULL AND t <> '') * 100.0 / count(*), 6) AS completeness, round(count(DISTINCT id) * 100.0 / count(*), 6) AS uniqueness,
           round(count(*) FILTER (WHERE n > 10) * 100.0 / count(*), 6) AS over_ten, count(*) FILTER (WHERE n > hi) AS very_long, count(*) FILTER (WHERE n < lo) AS very_short FROM l, b""")
def quality_assessment(spark, d):
    return _round(prepare.quality_assessment(table(spark, d, "documents"), "doc_id"), "completeness", "uniqueness", "over_ten")


@query(f"""WITH {MESSAGES} SELECT ticket_id, seq, {text.clean_text_sql("text")} AS text FROM m WHERE {_IS_TEXT} AND trim(text) <> '' AND lower(sender) NOT IN ({_AI})""")
def lenient_filter(spark, d):
    return prepare.lenient_stream_filter(messages(spark, d)).select("ticket_id", "seq", "text")


# --- text


@query(f"SELECT doc_id, {text.clean_text_sql('text')} AS cleaned FROM documents")
def clean_text_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", text.clean_text(F.col("text")).alias("cleaned"))


@query(f"SELECT page_id, {text.clean_text_sql('html')} AS cleaned FROM pages")
def clean_text_pages(spark, d):
    return table(spark, d, "pages").select("page_id", text.clean_text(F.col("html")).alias("cleaned"))


@query("SELECT doc_id, length(text) // 4 AS tokens FROM documents")
def token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"))


@query("""WITH n AS (SELECT length(text) AS chars, CASE WHEN trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) END AS words FROM documents)
    SELECT round(avg(chars), 6) AS mean_chars, median(chars) AS median_chars, min(chars) AS min_chars, max(chars) AS max_chars, round(stddev_samp(chars), 6) AS std_chars,
           round(avg(words), 6) AS mean_words, median(words) AS median_words, min(words) AS min_words, max(words) AS max_words, round(stddev_samp(words), 6) AS std_words FROM n""")
def text_stats(spark, d):
    return _round(prepare.length_stats(table(spark, d, "documents")), "mean_chars", "std_chars", "mean_words", "std_words")


@query(f"SELECT doc_id, {text.keyword_category_sql('text')} AS categoria FROM documents")
def keyword_rules(spark, d):
    return table(spark, d, "documents").select("doc_id", text.keyword_category(F.col("text")).alias("categoria"))


@query("SELECT doc_id, array_to_string(list_slice(list_transform(regexp_extract_all(text, '\\b(\\d+)\\b', 1), lambda x: CAST(TRY_CAST(x AS BIGINT) AS VARCHAR)), 1, 3), ',') AS numbers FROM documents")
def json_fallback_numbers(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(text.first_numbers(F.col("text")).cast("array<string>"), ",").alias("numbers"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract_k(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 2 THEN CAST(event_id AS VARCHAR) || ',7' ELSE CAST(event_id % 5 AS VARCHAR) || ',2' END AS ids, CASE WHEN event_id % 3 = 2 THEN 0.7 ELSE 0.95 END AS confidence FROM events""")
def parse_classification(spark, d):
    e = F.col("event_id")
    body = F.concat(F.lit('{"categories": ['), e % 5, F.lit(', 2], "confidence": 0.95}'))
    response = F.when(e % 3 == 0, body).when(e % 3 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(F.concat(F.lit("category "), e, F.lit(" or 7")))
    got = jsonx.parse_classification(response)
    return table(spark, d, "events").select("event_id", F.array_join(got["categories"].cast("array<string>"), ",").alias("ids"), got["confidence"].alias("confidence"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[.!?]')) AS marks, len(regexp_extract_all(text, '[àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ]')) AS accents FROM documents")
def character_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", text.sentence_marks(F.col("text")).cast("long").alias("marks"), text.accented(F.col("text")).cast("long").alias("accents"))


# --- categories

_COUNTS = CATEGORISED + ", n AS (SELECT categoria, count(*) AS n FROM c WHERE categoria IS NOT NULL GROUP BY 1)"


@query(f"WITH {_COUNTS} SELECT categoria, n, round(n / (SELECT CAST(sum(n) AS DOUBLE) FROM n) * 100, 2) AS percent, CAST(row_number() OVER (ORDER BY n DESC, categoria) AS INTEGER) AS rank FROM n")
def category_distribution(spark, d):
    return stats.category_distribution(categorised(spark, d))


@query(f"""WITH {_COUNTS} SELECT count(*) AS n_categories, (SELECT categoria FROM n ORDER BY n DESC, categoria LIMIT 1) AS most_common, (SELECT categoria FROM n ORDER BY n, categoria LIMIT 1) AS least_common,
    round(avg(n), 2) AS mean, CAST(floor(median(n)) AS BIGINT) AS median, round(stddev_samp(n), 6) AS std, min(n) AS least, max(n) AS most FROM n""")
def category_summary(spark, d):
    return _round(stats.category_summary(categorised(spark, d)), "std")


@query(f"WITH {_COUNTS}, s AS (SELECT n / (SELECT CAST(sum(n) AS DOUBLE) FROM n) AS p FROM n) SELECT round(CASE WHEN count(*) > 1 THEN -sum(p * ln(p + 1e-10)) / ln(count(*)) ELSE 0 END, 6) AS diversity FROM s")
def shannon_diversity(spark, d):
    return _round(stats.shannon_diversity(categorised(spark, d)), "diversity")


@query(f"WITH {_COUNTS}, r AS (SELECT n, row_number() OVER (ORDER BY n DESC, categoria) AS r FROM n) SELECT round(sum(n) FILTER (WHERE r <= 5) * 100.0 / sum(n), 6) AS concentration FROM r")
def concentration_top5(spark, d):
    return _round(stats.concentration(categorised(spark, d)), "concentration")


@query("""WITH n AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT count(*) FILTER (WHERE n = 1) AS one, count(*) FILTER (WHERE n BETWEEN 2 AND 5) AS to_5, count(*) FILTER (WHERE n BETWEEN 6 AND 20) AS to_20, count(*) FILTER (WHERE n BETWEEN 21 AND 100) AS to_100,
           count(*) FILTER (WHERE n > 100) AS more, round(avg(n), 6) AS mean, median(n) AS median, round(stddev_samp(n), 6) AS std FROM n""")
def category_histogram(spark, d):
    return _round(stats.size_histogram(table(spark, d, "lineitem"), "l_partkey"), "mean", "std")


@query(f"WITH {_COUNTS} SELECT count(*) FILTER (WHERE n = 1) AS at_1, count(*) FILTER (WHERE n >= 5) AS at_5, count(*) FILTER (WHERE n >= 10) AS at_10, count(*) FILTER (WHERE n >= 20) AS at_20 FROM n")
def threshold_counts(spark, d):
    return stats.threshold_counts(categorised(spark, d), "categoria")


@query("""WITH n AS (SELECT p_type AS x, count(*) AS n FROM part GROUP BY 1)
    SELECT CAST(coalesce(sum(n) FILTER (WHERE trim(x) <> ''), 0) AS BIGINT) AS valid, CAST(coalesce(sum(n) FILTER (WHERE x IS NULL OR trim(x) = ''), 0) AS BIGINT) AS empty,
           round(coalesce(sum(n) FILTER (WHERE trim(x) <> ''), 0) * 100.0 / sum(n), 2) AS completeness, round(avg(length(x)) FILTER (WHERE trim(x) <> ''), 1) AS mean_length,
           min(length(x)) FILTER (WHERE trim(x) <> '') AS least_length, max(length(x)) FILTER (WHERE trim(x) <> '') AS most_length FROM n""")
def naming_quality(spark, d):
    return stats.naming_quality(table(spark, d, "part"), "p_type")


@query("""WITH j AS (SELECT d.doc_id, d.text, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
    SELECT 'doc_id' AS "column", round(count(doc_id) * 100.0 / count(*), 2) AS coverage FROM j UNION ALL SELECT 'text', round(count(text) * 100.0 / count(*), 2) FROM j
    UNION ALL SELECT 'quality', round(count(quality) * 100.0 / count(*), 2) FROM j UNION ALL SELECT 'toxic', round(count(toxic) * 100.0 / count(*), 2) FROM j""")
def column_coverage(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return stats.column_coverage(j, ["doc_id", "text", "quality", "toxic"])


@query("""WITH a AS (SELECT count(DISTINCT doc_id) AS ids_categorised, count(*) AS rows_categorised FROM labels), b AS (SELECT count(DISTINCT doc_id) AS ids_original, count(*) AS rows_original FROM documents)
    SELECT ids_categorised, ids_original, (SELECT count(*) FROM (SELECT doc_id FROM labels INTERSECT SELECT doc_id FROM documents)) AS ids_both, rows_categorised, rows_original,
           round(rows_categorised * 100.0 / rows_original, 2) AS processed, rows_original - rows_categorised AS filtered_out FROM a, b""")
def cross_analysis(spark, d):
    return stats.cross_analysis(table(spark, d, "labels"), table(spark, d, "documents"), "doc_id")


@query(f"""WITH {_COUNTS}, t AS (SELECT categoria, n, round(n / (SELECT CAST(sum(n) AS DOUBLE) FROM n) * 100, 2) AS percent, CAST(row_number() OVER (ORDER BY n DESC, categoria) AS INTEGER) AS rank FROM n),
    s AS (SELECT categoria, ticket_id, row_number() OVER (PARTITION BY categoria ORDER BY ticket_id) AS r FROM c)
    SELECT t.rank, t.categoria, t.n, t.percent, string_agg(CAST(s.ticket_id AS VARCHAR), ', ' ORDER BY s.r) AS sample_ids FROM t JOIN s ON t.categoria = s.categoria AND s.r <= 3 WHERE t.rank <= 10 GROUP BY ALL""")
def top10_detail(spark, d):
    return stats.top_categories(categorised(spark, d), "categoria", "ticket_id")


@query(f"WITH {CATEGORISED}, s AS (SELECT *, CAST(row_number() OVER (PARTITION BY categoria ORDER BY ticket_id) AS INTEGER) AS rank FROM c) SELECT categoria, ticket_id, rank FROM s WHERE rank <= 5")
def samples_per_category(spark, d):
    return stats.first_rows(categorised(spark, d), "categoria", "ticket_id", 5).select("categoria", "ticket_id", "rank")


@query(f"WITH {MESSAGES}, s AS (SELECT *, row_number() OVER (PARTITION BY ticket_id ORDER BY seq) AS r FROM m) SELECT ticket_id, seq, sender FROM s WHERE r = 1")
def first_per_ticket(spark, d):
    return stats.first_rows(messages(spark, d), "ticket_id", "seq", 1).select("ticket_id", "seq", "sender")


# --- joins and sets


@query("SELECT doc_id, d.source, l.quality FROM documents d FULL OUTER JOIN labels l USING (doc_id)")
def merge_outer(spark, d):
    return joins.merge_results(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels").select("doc_id", "quality"), "doc_id")


@query("SELECT c_custkey, coalesce(n_name, 'Category_' || CAST(c_nationkey AS VARCHAR)) AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def category_lookup(spark, d):
    return joins.with_names(table(spark, d, "customer"), table(spark, d, "nation"), "c_nationkey", "n_nationkey", "n_name", "nation").select("c_custkey", "nation")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join_unlabelled(spark, d):
    return joins.without(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id").select("doc_id", "source")


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def id_intersection(spark, d):
    return joins.common_ids(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def id_difference(spark, d):
    return joins.missing_ids(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query("SELECT doc_id, 'short' AS stratum FROM documents WHERE n_chars < 1000 UNION ALL SELECT doc_id, 'long' FROM documents WHERE n_chars >= 1000")
def union_strata(spark, d):
    docs = table(spark, d, "documents")
    part = lambda cond, name: docs.filter(cond).select("doc_id", F.lit(name).alias("stratum"))
    return joins.union_all(part(F.col("n_chars") < 1000, "short"), part(F.col("n_chars") >= 1000, "long"))


@query(f"""WITH {LABELS}, s AS (
    SELECT list_distinct(list_filter(list_transform(string_split(p.ids, ','), lambda x: trim(x)), lambda x: x <> '')) AS a, list_distinct(list_filter(list_transform(string_split(t.ids, ','), lambda x: trim(x)), lambda x: x <> '')) AS b FROM p JOIN t ON p.doc_id = t.doc_id), x AS (
    SELECT count(*) AS n, avg(CASE WHEN list_sort(a) = list_sort(b) THEN 1.0 ELSE 0 END) AS exact, avg(CASE WHEN len(list_intersect(a, b)) > 0 THEN 1.0 ELSE 0 END) AS overlap,
           avg(CASE WHEN len(a) > 0 THEN len(list_intersect(a, b)) / CAST(len(a) AS DOUBLE) ELSE 0 END) AS precision, avg(CASE WHEN len(b) > 0 THEN len(list_intersect(a, b)) / CAST(len(b) AS DOUBLE) ELSE 0 END) AS recall FROM s)
    SELECT n, round(exact, 6) AS exact, round(overlap, 6) AS overlap, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1 FROM x""")
def multilabel_accuracy(spark, d):
    return _round(stats.multilabel_accuracy(predictions(spark, d), truth(spark, d), "doc_id", "ids"), "exact", "overlap", "precision", "recall", "f1")


# --- classification results


@query(f"""WITH {RESULTS} SELECT count(*) AS total, count(*) FILTER (WHERE category_ids <> '') AS classified, round(count(*) FILTER (WHERE category_ids <> '') / CAST(count(*) AS DOUBLE), 6) AS rate,
    round(avg(confidence), 6) AS mean_confidence, round(median(confidence), 6) AS median_confidence, count(*) FILTER (WHERE confidence >= 0.85) AS high_confidence FROM r""")
def classification_stats(spark, d):
    return _round(stats.classification_stats(results(spark, d)), "rate", "mean_confidence", "median_confidence")


@query(f"""WITH {RESULTS}, x AS (SELECT unnest(list_distinct(list_filter(list_transform(string_split(category_ids, ','), lambda x: trim(x)), lambda x: x <> ''))) AS category_id FROM r) SELECT category_id, count(*) AS n FROM x GROUP BY 1""")
def id_distribution(spark, d):
    return stats.id_distribution(results(spark, d))


@query(f"""WITH {RESULTS}, x AS (SELECT unnest(list_filter(list_transform(string_split(category_ids, ','), lambda x: trim(x)), lambda x: x <> '')) AS i FROM r)
    SELECT round(avg(CASE WHEN confidence >= 0.85 THEN 1.0 ELSE 0 END), 6) AS high_share, round((SELECT count(DISTINCT i) FROM x) / 5.0, 6) AS coverage, round(greatest(0, 1 - stddev_samp(confidence) / avg(confidence)), 6) AS consistency FROM r""")
def accuracy_metrics(spark, d):
    return _round(stats.accuracy_metrics(results(spark, d), 5), "high_share", "coverage", "consistency")


@query(f"""WITH {RESULTS} SELECT arm, count(*) AS n, round(avg(confidence), 6) AS mean, round(median(confidence), 6) AS median, round(stddev_samp(confidence), 6) AS std,
    round(avg(CASE WHEN confidence >= 0.85 THEN 1.0 ELSE 0 END), 6) AS high_share, round(avg(CASE WHEN category_ids <> '' THEN 1.0 ELSE 0 END), 6) AS rate, count(DISTINCT category_ids) AS n_ids FROM r GROUP BY 1""")
def ab_metrics(spark, d):
    return _round(stats.ab_metrics(results(spark, d), "arm"), "mean", "median", "std", "high_share", "rate")


@query(f"""WITH {RESULTS}, a AS (SELECT count(*) AS n1, avg(confidence) AS m1, var_samp(confidence) AS v1 FROM r WHERE arm = 0), b AS (SELECT count(*) AS n2, avg(confidence) AS m2, var_samp(confidence) AS v2 FROM r WHERE arm = 1), x AS (
    SELECT *, ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) AS pooled FROM a, b), y AS (SELECT *, (m1 - m2) / sqrt(pooled * (1.0 / n1 + 1.0 / n2)) AS t, (m1 - m2) / sqrt(pooled) AS d FROM x)
    SELECT n1, n2, n1 + n2 - 2 AS df, round(t, 6) AS t, round(d, 6) AS d, CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS effect FROM y""")
def ab_ttest(spark, d):
    return _round(stats.pooled_t_test(results(spark, d), "arm", "confidence", 0, 1).drop("p"), "t", "d")


@query(f"""WITH {RESULTS}, a AS (SELECT count(*) AS n1, avg(confidence) AS m1, var_samp(confidence) AS v1 FROM r WHERE arm = 0), b AS (SELECT count(*) AS n2, avg(confidence) AS m2, var_samp(confidence) AS v2 FROM r WHERE arm = 1), x AS (
    SELECT *, CAST(n1 + n2 - 2 AS DOUBLE) AS df, ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) AS pooled FROM a, b), y AS (SELECT df, abs((m1 - m2) / sqrt(pooled * (1.0 / n1 + 1.0 / n2))) AS t FROM x),
    z AS (SELECT df, t, i, CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) * pow(1 + pow(t * i / 20000, 2) / df, -(df + 1) / 2) AS f FROM y, range(20001) s(i))
    SELECT round(1 - 2 * sum(f) * any_value(t) / 60000, 6) AS p FROM z""")
def ab_pvalue(spark, d):
    """The t-test's p; in SQL, the density's integral."""
    return _round(stats.pooled_t_test(results(spark, d), "arm", "confidence", 0, 1).select("p"), "p")


# --- usage and cost


@query(f"WITH {USAGE} SELECT event_id, total_tokens, round(cost_usd, 9) AS cost_usd FROM uc")
def usage_cost(spark, d):
    return _round(cost.with_cost(usage(spark, d)).select("event_id", "total_tokens", "cost_usd"), "cost_usd", places=9)


@query(f"""WITH {USAGE} SELECT operation_type, count(*) AS n, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, round(sum(cost_usd), 6) AS cost_usd,
    round(avg(total_tokens), 6) AS mean_tokens, round(avg(cost_usd), 9) AS mean_cost FROM uc GROUP BY 1""")
def operation_breakdown(spark, d):
    return _round(_round(cost.operation_breakdown(usage(spark, d)), "cost_usd", "mean_tokens"), "mean_cost", places=9)


@query(f"WITH {USAGE} SELECT date_trunc('hour', ts) AS hour, count(*) AS n, CAST(sum(total_tokens) AS BIGINT) AS tokens, round(sum(cost_usd), 9) AS cost_usd FROM uc GROUP BY 1")
def hourly_cost_trend(spark, d):
    out = cost.hourly_cost(usage(spark, d))
    return _round(out.withColumn("hour", F.col("hour").cast("timestamp_ntz")), "cost_usd", places=9)


@query(f"""WITH {USAGE}, s AS (SELECT user_id, count(*) AS operations, sum(total_tokens) AS tokens, sum(cost_usd) AS cost, epoch(max(ts)) - epoch(min(ts)) AS seconds FROM uc GROUP BY 1)
    SELECT user_id, operations, CAST(tokens AS BIGINT) AS tokens, round(cost, 9) AS cost_usd, round(cost / operations, 9) AS cost_per_item FROM s""")
def session_efficiency(spark, d):
    out = cost.sessions(usage(spark, d), "user_id").select("user_id", "operations", "tokens", "cost_usd", "cost_per_item")
    return _round(out, "cost_usd", "cost_per_item", places=9)


@query(f"""WITH {USAGE}, r AS (SELECT ts, event_id, user_id, sum(cost_usd) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS running FROM uc), x AS (
    SELECT *, unnest([0.5, 0.75, 0.9, 0.95]) AS threshold FROM r), y AS (SELECT user_id, threshold, ts, event_id, row_number() OVER (PARTITION BY user_id, threshold ORDER BY ts, event_id) AS rn FROM x WHERE running >= threshold * 0.0011)
    SELECT user_id, CAST(threshold AS DOUBLE) AS threshold, ts, event_id FROM y WHERE rn = 1""")
def budget_crossings(spark, d):
    return cost.budget_crossings(usage(spark, d), 0.0011, "event_id", group="user_id").select("user_id", "threshold", "ts", "event_id")


@query(f"""WITH {USAGE}, s AS (SELECT user_id, sum(cost_usd) / 0.002 * 100 AS percent FROM uc GROUP BY 1)
    SELECT user_id, CASE WHEN percent >= 95 THEN 'critical' WHEN percent >= 75 THEN 'warning' WHEN percent >= 50 THEN 'caution' ELSE 'healthy' END AS status FROM s""")
def budget_status(spark, d):
    from ..functions.numbers import budget_status as status

    spent = cost.with_cost(usage(spark, d)).groupBy("user_id").agg((F.sum("cost_usd") / 0.002 * 100).alias("percent"))
    return spent.select("user_id", status(F.col("percent")).alias("status"))


@query(f"""WITH {USAGE}, s AS (SELECT user_id, epoch(max(ts)) - epoch(min(ts)) AS x FROM (SELECT user_id, date_trunc('second', ts) AS ts FROM uc) GROUP BY 1), y AS (SELECT * FROM s WHERE x > 0)
    SELECT count(*) AS n, round(avg(x), 3) AS mean, round(median(x), 3) AS median, round(greatest(0, 1 - stddev_samp(x) / avg(x)), 6) AS consistency FROM y""")
def temporal_patterns(spark, d):
    out = cost.temporal_patterns(cost.sessions(usage(spark, d), "user_id")).drop("variance")
    return _round(_round(out, "mean", "median", places=3), "consistency")


@query(f"""WITH {USAGE}, b AS (SELECT operation_type, count(*) AS n, sum(cost_usd) AS cost FROM uc GROUP BY 1)
    SELECT operation_type, n, round(cost / n, 9) AS cost_per_operation, round(cost / sum(cost) OVER (), 6) AS share, round(sum(cost) OVER (ORDER BY cost DESC, operation_type ROWS UNBOUNDED PRECEDING) / sum(cost) OVER (), 6) AS running_share FROM b""")
def operation_shares(spark, d):
    out = cost.operation_shares(usage(spark, d)).select("operation_type", "n", "cost_per_operation", "share", "running_share")
    return _round(_round(out, "cost_per_operation", places=9), "share", "running_share")


_OUT = """SELECT user_id, round(cost, 9) AS cost, CASE WHEN abs(cost - mean) > 3 * std THEN 'high' ELSE 'medium' END AS severity FROM s, (SELECT avg(cost) AS mean, stddev_samp(cost) AS std, count(*) AS k FROM s) WHERE k >= 3 AND abs(cost - mean) > 2 * std"""


@query(f"WITH {USAGE}, s AS (SELECT user_id, sum(cost_usd) AS cost FROM uc GROUP BY 1) {_OUT}")
def session_outliers(spark, d):
    s = cost.with_cost(usage(spark, d)).groupBy("user_id").agg(F.sum("cost_usd").alias("cost"))
    return _round(trend.outliers(s, "cost").select("user_id", "cost", "severity"), "cost", places=9)


# --- scenarios

_FACTOR = "CASE o WHEN 'discovery_only' THEN 0.6 WHEN 'application_only' THEN 0.8 WHEN 'parallel_discovery' THEN 0.7 WHEN 'optimized_application' THEN 0.85 ELSE 1.0 END"
_GRID = f"""g AS (SELECT n, o, w, CAST({_FACTOR} AS DOUBLE) AS f FROM {SIZES} a(n), (VALUES ('discovery_only'), ('application_only'), ('parallel_discovery'), ('optimized_application'), ('discovery_application')) b(o), (VALUES (1), (4), (8), (16)) c(w)), pr AS (
    SELECT n, o, w, 0.048 * f * CASE WHEN n <= 1000 THEN 1.1 WHEN n <= 10000 THEN 1.0 WHEN n <= 50000 THEN 0.95 WHEN n <= 100000 THEN 0.92 ELSE 0.90 END * CASE WHEN w <= 1 THEN 1.0 WHEN w <= 4 THEN 0.95 WHEN w <= 8 THEN 0.98 ELSE 1.05 END AS each,
           n / (1000 * f * CASE WHEN w > 1 THEN w * 0.8 ELSE 1.0 END / 4) AS hours FROM g), pc AS (SELECT *, each * n AS cost, CASE WHEN n < 1000 THEN 0.3 WHEN n < 10000 THEN 0.2 ELSE 0.15 END AS v FROM pr)"""


def _grid(spark, d):
    return cost.scenarios_of(sizes(spark, d), list(cost.OPTION_FACTORS), [1, 4, 8, 16])


@query(f"WITH {_GRID} SELECT CAST(n AS BIGINT) AS dataset_size, o AS option, w AS workers, round(each, 6) AS cost_per_ticket, round(cost, 4) AS cost, round(hours, 4) AS hours, round(cost * (1 - v), 4) AS low, round(cost * (1 + v), 4) AS high FROM pc")
def scenario_grid(spark, d):
    return _round(_round(cost.project(_grid(spark, d)), "cost_per_ticket"), "cost", "hours", "low", "high", places=4)


@query(f"""WITH {_GRID} SELECT CAST(n AS BIGINT) AS dataset_size, arg_min(o, cost) AS best, arg_max(o, cost) AS worst, round(min(cost), 4) AS least, round(max(cost), 4) AS most, round(avg(cost), 4) AS mean,
    round(max(cost) - min(cost), 4) AS savings, round((max(cost) - min(cost)) / max(cost) * 100, 4) AS savings_percent FROM pc GROUP BY n""")
def scenario_compare(spark, d):
    return _round(cost.compare(cost.project(_grid(spark, d))), "least", "most", "mean", "savings", "savings_percent", places=4)


@query(f"""WITH {_GRID} SELECT CAST(n AS BIGINT) AS dataset_size, o AS option, w AS workers, round(n * 50.0 - cost, 4) AS saved, round(n * 0.5 - hours, 4) AS hours_saved, round((n * 50.0 - cost) / cost * 100, 4) AS roi_percent,
    round((n * 50.0 - cost) / (cost + 1000), 4) AS payback, round(1000 / (50.0 - each), 6) AS break_even_items FROM pc""")
def roi_grid(spark, d):
    out = cost.roi(cost.project(_grid(spark, d))).select("dataset_size", "option", "workers", "saved", "hours_saved", "roi_percent", "payback", "break_even_items")
    return _round(_round(out, "saved", "hours_saved", "roi_percent", "payback", places=4), "break_even_items")


@query(f"""WITH o AS (SELECT * FROM (VALUES ('discovery_only', 0.6), ('application_only', 0.8), ('parallel_discovery', 0.7), ('optimized_application', 0.85), ('discovery_application', 1.0)) a(option, f)),
    c AS (SELECT * FROM (VALUES ('base', 1.0, 4, 1.0), ('size_half', 0.5, 4, 1.0), ('size_more', 1.5, 4, 1.0), ('workers_2', 1.0, 2, 1.0), ('workers_8', 1.0, 8, 1.0), ('tokens_less', 1.0, 4, 0.7), ('tokens_more', 1.0, 4, 1.3)) b(c, s, w, t)),
    g AS (SELECT option, c, z, CAST(floor(z * s) AS BIGINT) AS n, w, CAST(t AS DOUBLE) AS t, CAST(f AS DOUBLE) AS f FROM o, c, {SIZES} y(z)),
    r AS (SELECT *, 0.048 * f * CASE WHEN n <= 1000 THEN 1.1 WHEN n <= 10000 THEN 1.0 WHEN n <= 50000 THEN 0.95 WHEN n <= 100000 THEN 0.92 ELSE 0.90 END * CASE WHEN w <= 4 THEN 0.95 ELSE 0.98 END * t AS each FROM g),
    q AS (SELECT *, n * each AS cost, (n * 50 - n * each) / (n * each) * 100 AS roi FROM r)
    SELECT option, z AS base_size, c AS "case", n AS dataset_size, w AS workers, round(cost, 4) AS cost, round(roi, 4) AS roi_percent, round(roi - max(CASE WHEN c = 'base' THEN roi END) OVER (PARTITION BY option, z), 4) + 0.0 AS change FROM q""")
def roi_sensitivity(spark, d):
    return _round(cost.sensitivity(cost.scenarios_of(sizes(spark, d), list(cost.OPTION_FACTORS), [4])), "cost", "roi_percent", "change", places=4).withColumn("change", F.col("change") + 0.0)  # no negative zero


_COST = "(n * 2000 / 1000.0 * (0.075 / 1000) + n * 200 / 1000.0 * (0.30 / 1000) + w * h * 0.001 + n * 0.5 / 1024 * 0.023 + 0.10)"
_HOURS = "greatest(0.1, n / (w * (100 * greatest(0.5, 1.0 - (w - 1) * 0.02))))"


@query(f"""WITH s AS (SELECT CAST(n AS DOUBLE) AS n, CASE WHEN n < 1000 THEN 2 WHEN n < 10000 THEN 4 WHEN n < 50000 THEN 8 WHEN n < 100000 THEN 16 WHEN n < 500000 THEN 32 ELSE 64 END AS w FROM {SIZES} t(n)), x AS (SELECT *, {_HOURS} AS h FROM s)
    SELECT CAST(n AS BIGINT) AS dataset_size, w AS workers, round(h, 6) AS hours, round({_COST}, 9) AS total, round({_COST} / n, 9) AS cost_per_ticket FROM x""")
def linear_projection(spark, d):
    return _round(_round(cost.linear_projection(sizes(spark, d)), "hours"), "total", "cost_per_ticket", places=9)


_SEARCH = f"s AS (SELECT CAST(n AS DOUBLE) AS n, w FROM {SIZES} t(n), (VALUES (2), (4), (8), (16), (32), (64)) u(w)), x AS (SELECT *, {_HOURS} AS h FROM s), y AS (SELECT *, {_COST} AS total, n / (h * w) AS e FROM x)"


@query(f"""WITH {_SEARCH}, z AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY e DESC, w) AS r FROM y WHERE total <= 50 AND w <= greatest(2, floor(n / 100))) SELECT CAST(n AS BIGINT) AS dataset_size, w AS workers, round(h, 6) AS hours, round(total, 6) AS total FROM z WHERE r = 1""")
def budget_search(spark, d):
    return _round(cost.optimise_for_budget(sizes(spark, d), 50.0), "hours", "total")


@query(f"WITH {_SEARCH}, z AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY total, w) AS r FROM y WHERE h <= 24) SELECT CAST(n AS BIGINT) AS dataset_size, w AS workers, round(h, 6) AS hours, round(total, 6) AS total FROM z WHERE r = 1")
def time_search(spark, d):
    return _round(cost.optimise_for_time(sizes(spark, d), 24.0), "hours", "total")


@query(f"""SELECT CAST(n AS BIGINT) AS dataset_size, w AS workers, round(n * c + w * 0.001, 6) AS cost FROM {SIZES} t(n), (VALUES (1, 1000, 2, 0.0003), (1001, 10000, 4, 0.00028), (10001, 50000, 8, 0.00026), (50001, 100000, 16, 0.00024), (100001, 500000, 32, 0.00023), (500001, 9223372036854775807, 64, 0.00022)) p(lo, hi, w, c) WHERE n BETWEEN lo AND hi""")
def profile_range_lookup(spark, d):
    return _round(planning.profile_cost(sizes(spark, d)).select("dataset_size", "workers", "cost"), "cost")


# --- trends, alerts, batches, samples


@query(f"""WITH {HOURLY}, r AS (SELECT cost, row_number() OVER (ORDER BY hour) AS r, count(*) OVER () AS k FROM h), g AS (SELECT max(k) AS n, avg(cost) FILTER (WHERE r <= k // 2) AS before, avg(cost) FILTER (WHERE r > k // 2) AS after FROM r), x AS (SELECT *, (after - before) / before * 100 AS change FROM g)
    SELECT n, round(before, 9) AS before, round(after, 9) AS after, round(change, 6) AS change, CASE WHEN n < 3 THEN 'insufficient_data' WHEN change > 5 THEN 'increasing' WHEN change < -5 THEN 'decreasing' ELSE 'stable' END AS trend FROM x""")
def half_split_trend(spark, d):
    return _round(_round(trend.half_split_trend(hourly(spark, d), "cost", "hour"), "before", "after", places=9), "change")


@query(f"""WITH {HOURLY}, w AS (SELECT hour, n AS events, avg(n) OVER z AS mean, stddev_pop(n) OVER z AS std, count(*) OVER z AS k FROM h WINDOW z AS (ORDER BY hour ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
    SELECT hour, round(mean, 6) AS mean, round(std, 6) AS std, k >= 10 AND events > mean + 2 * std AS anomaly FROM w""")
def last10_zscore(spark, d):
    h = hourly(spark, d).select(F.col("hour").cast("timestamp_ntz").alias("hour"), F.col("n").alias("events"))
    return _round(trend.last_zscore(h, "events", "hour").select("hour", "mean", "std", "anomaly"), "mean", "std")


@query("""WITH e AS (SELECT event_id, user_id, value, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events)
    SELECT event_id, round(max(value) OVER w - min(value) OVER w, 6) AS spread FROM e WINDOW w AS (PARTITION BY user_id ORDER BY s RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW)""")
def hourly_spike(spark, d):
    e = table(spark, d, "events").withColumn("s", F.floor(F.unix_timestamp(F.col("ts").cast("timestamp"))))
    return _round(trend.trailing_range(e, "value", "s", "user_id").select("event_id", "spread"), "spread")


@query(f"WITH {USAGE} SELECT CAST(ts AS DATE) AS day, round(sum(cost_usd), 9) AS cost FROM uc GROUP BY 1 HAVING sum(cost_usd) >= 0.0125")
def daily_limit(spark, d):
    return _round(alerts.daily_limit(cost.with_cost(usage(spark, d)), 0.0125), "cost", places=9)


@query("""WITH RECURSIVE a AS (SELECT event_type AS k, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events WHERE value > 100), o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s, event_id) AS r FROM a), f AS (
    SELECT k, event_id, s, r, s AS last, true AS passes FROM o WHERE r = 1 UNION ALL
    SELECT o.k, o.event_id, o.s, o.r, CASE WHEN o.s - f.last >= 3600 THEN o.s ELSE f.last END, o.s - f.last >= 3600 FROM f JOIN o ON o.k = f.k AND o.r = f.r + 1)
    SELECT k AS event_type, s AS seconds FROM f WHERE passes""")
def cooldown_alerts(spark, d):
    e = table(spark, d, "events").filter("value > 100").select("event_type", F.floor(F.unix_timestamp(F.col("ts").cast("timestamp"))).cast("long").alias("seconds"))
    return alerts.cooldown(e, "event_type", "seconds")


@query("""WITH RECURSIVE t AS (SELECT doc_id, length(text) // 4 AS tokens, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r, source FROM documents), f AS (
    SELECT source, doc_id, r, CAST(0 AS BIGINT) AS b, CAST(2 + tokens AS BIGINT) AS s, CAST(1 AS BIGINT) AS n FROM t WHERE r = 1 UNION ALL
    SELECT t.source, t.doc_id, t.r, CASE WHEN f.s + t.tokens >= 5000 OR f.n >= 50 THEN f.b + 1 ELSE f.b END, CASE WHEN f.s + t.tokens >= 5000 OR f.n >= 50 THEN 2 + t.tokens ELSE f.s + t.tokens END, CASE WHEN f.s + t.tokens >= 5000 OR f.n >= 50 THEN 1 ELSE f.n + 1 END
    FROM f JOIN t ON t.source = f.source AND t.r = f.r + 1)
    SELECT source AS shard, doc_id, b AS batch_id FROM f""")
def greedy_batches(spark, d):
    docs = table(spark, d, "documents").withColumn("tokens", text.estimate_tokens(F.col("text")))
    return pack.greedy_batches(docs, "doc_id", "tokens", limit=5000, shard_col="source")


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 100 AS batch_id FROM documents")
def fixed_batches(spark, d):
    return pack.fixed_batches(table(spark, d, "documents").select("doc_id"), "doc_id", 100)


@query("""WITH o AS (SELECT o_orderkey, date_trunc('month', o_orderdate) AS m, md5(CAST(o_orderkey AS VARCHAR) || ':42') AS h FROM orders), c AS (SELECT m, greatest(1, floor(count(*) * 1000 / CAST((SELECT count(*) FROM orders) AS DOUBLE))) AS q FROM o GROUP BY 1), r AS (
    SELECT o.o_orderkey, o.h, row_number() OVER (PARTITION BY o.m ORDER BY o.h) > c.q AS over_quota FROM o JOIN c ON o.m = c.m)
    SELECT o_orderkey FROM r ORDER BY over_quota, h LIMIT 1000""")
def stratified_month_sample(spark, d):
    return sample.stratified(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), 1000, "o_orderkey", "o_orderdate").select("o_orderkey")


@query("""WITH a AS (SELECT date_trunc('month', o_orderdate) AS k, o_orderpriority AS s, length(o_orderpriority) AS n FROM orders), b AS (SELECT date_trunc('month', o_orderdate) AS k, o_orderpriority AS s, length(o_orderpriority) AS n FROM orders WHERE o_orderkey % 7 = 0),
    p AS (SELECT k, count(*) / CAST((SELECT count(*) FROM a) AS DOUBLE) AS p FROM a GROUP BY 1), q AS (SELECT k, count(*) / CAST((SELECT count(*) FROM b) AS DOUBLE) AS q FROM b GROUP BY 1),
    sp AS (SELECT s, count(*) / CAST((SELECT count(*) FROM a) AS DOUBLE) AS p FROM a GROUP BY 1), sq AS (SELECT s, count(*) / CAST((SELECT count(*) FROM b) AS DOUBLE) AS q FROM b GROUP BY 1)
    SELECT round((SELECT sum(p * ln((p + 1e-10) / (q + 1e-10))) FROM p JOIN q ON p.k = q.k), 6) AS kl, round((SELECT sum(abs(p - q)) FROM sp JOIN sq ON sp.s = sq.s), 6) AS sender_diff,
           round(abs((SELECT avg(n) FROM a) - (SELECT avg(n) FROM b)), 6) AS mean_diff, round(abs((SELECT stddev_samp(n) FROM a) - (SELECT stddev_samp(n) FROM b)), 6) AS std_diff, round((SELECT count(*) FROM b) / CAST((SELECT count(*) FROM a) AS DOUBLE), 6) AS share""")
def sample_representativeness(spark, d):
    o = table(spark, d, "orders")
    return _round(sample.representativeness(o, o.filter("o_orderkey % 7 = 0"), "o_orderdate", "o_orderpriority", "o_orderpriority"), "kl", "sender_diff", "mean_diff", "std_diff", "share")


@query()
def diversity_sample(spark, d):
    return sample.diverse(table(spark, d, "documents").select("doc_id", "text"), 100, "doc_id", "text", max_k=20).select("doc_id")


@query()
def chunk_overlap(spark, d):
    return pack.chunk_texts(table(spark, d, "documents"), "doc_id", "text", size=200, overlap=40).select("doc_id", "chunk_id", "start_index", "estimated_tokens")


@query("""SELECT source, count(*) AS n, CAST(sum(CASE WHEN regexp_matches(text, '[0-9]') THEN 1 ELSE 0 END) AS BIGINT) AS with_digits FROM documents GROUP BY GROUPING SETS ((source), ())""")
def source_rollup(spark, d):
    docs = table(spark, d, "documents")
    return docs.rollup("source").agg(F.count("*").alias("n"), F.count_if(F.col("text").rlike("[0-9]")).alias("with_digits"))


@query("""SELECT count(*) AS rows, round(avg(length(text)), 6) AS mean_length, round((avg(least(length(text) / 1000.0, 1)) + avg(least(len(regexp_extract_all(text, '[.!?]')) / 10.0, 1))) / 2, 6) AS complexity FROM documents""")
def dataset_profile(spark, d):
    return _round(planning.dataset_profile(table(spark, d, "documents")).select("rows", "mean_length", "complexity"), "mean_length", "complexity")


@query("""WITH s AS (SELECT event_id, CAST(user_id % 1200 AS DOUBLE) AS queue, CAST(event_id % 100 AS DOUBLE) AS cpu, CAST(event_id * 7 % 100 AS DOUBLE) AS memory, 1 + event_id % 60 AS workers FROM events), x AS (
    SELECT *, CASE WHEN queue > 1000 THEN 'emergency' WHEN (queue > 100 OR cpu > 75 OR memory > 80) AND workers < 64 THEN 'up' WHEN queue < 10 AND cpu < 30 AND memory < 40 AND workers > 1 THEN 'down' ELSE 'none' END AS action FROM s)
    SELECT event_id, action, CAST(least(64, greatest(1, CASE action WHEN 'emergency' THEN workers * 2 WHEN 'up' THEN ceil(workers * 1.5) WHEN 'down' THEN floor(workers / 1.5) ELSE workers END)) AS BIGINT) AS target FROM x""")
def scaling_decisions(spark, d):
    e = table(spark, d, "events")
    m = e.select("event_id", (F.col("user_id") % 1200).cast("double").alias("queue"), (F.col("event_id") % 100).cast("double").alias("cpu"), (F.col("event_id") * 7 % 100).cast("double").alias("memory"),
                 (1 + F.col("event_id") % 60).alias("workers"), F.lit(4.0).alias("free_gb"), F.lit(0.0).alias("error_rate"))
    return planning.scaling_decision(m).select("event_id", "action", "target")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Prepared tickets by keyword category, with shares."""
    tickets = prepare.prepare_tickets(messages(spark, d)).withColumn("categoria", text.keyword_category(F.col("text")))
    shares = tickets.groupBy("categoria").agg(F.count("*").alias("n_tickets"), F.avg(F.length("text")).alias("mean_length"))
    return shares.withColumn("share", F.col("n_tickets") / F.sum("n_tickets").over(W.partitionBy()))
