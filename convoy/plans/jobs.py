"""Whole jobs: categorise, summarise, discover, classify, merge, orchestrate, report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.jsonx import bullets_of, extract_json, items_of, parse_classification
from ..functions.text import estimate_tokens, ticket_block
from ..operators import joins, pack, prepare, runs, sample, stats
from ..sources import documents, reports, tables, work, workbook
from .model import PROMPTS, KeywordModel, Model, apply_cached, apply_model

TAXONOMY = (
    "version string, generated_at string, discovery_stats struct<total_patterns_analyzed:long,categories_created:long,confidence_level:double>, "
    "categories array<struct<id:int,technical_name:string,display_name:string,description:string,keywords:array<string>,examples:array<string>,subcategories:array<string>>>"
)


#: Partial results that one call combines at most.
FAN_IN = 50
#: What stands between the analyses that discovery combines.
ANALYSES = "\n\n---ANÁLISE---\n\n"


def map_reduce(chunks: DataFrame, model: Model, order: str = "chunk_id", separator: str = "\n\n", fan_in: int = FAN_IN, folder: str | None = None) -> DataFrame:
    """MAP over chunks, then COMBINE in the order of the chunks, at most `fan_in` results a
    call, in as many rounds as that takes; chunks whose call failed are left out. With a
    folder, the first round is kept there as it goes on (see `merged_as_it_goes`), so that a job
    that died goes on where it was."""
    if folder:
        parts = merged_as_it_goes(chunks, model, folder, order, separator, fan_in)
        if parts.count() == 1:
            return parts.select(F.col("text").alias("result"), "tokens_in", "tokens_out")
    else:
        done = apply_model(chunks, model, PROMPTS["map"], order, "text")
        parts = done.filter("error is null").select(F.col(order).alias("nr"), F.col("result").alias("text"), "tokens_in", "tokens_out")
    while True:
        parts = work.materialise(parts, "partials")
        n = parts.count()
        grouped = parts.withColumn("batch_id", F.lit(0).cast("long")) if n <= fan_in else pack.fixed_batches(parts, "nr", fan_in)
        called = _combined(grouped, model, separator)
        if n <= fan_in:
            return called.select("result", "tokens_in", "tokens_out")
        parts = called.select(F.col("batch_id").alias("nr"), F.col("result").alias("text"), "tokens_in", "tokens_out")


def _combined(parts: DataFrame, model: Model, separator: str) -> DataFrame:
    """One call for the parts (nr, text) of each batch_id, in their order; tokens are summed up."""
    joined = parts.groupBy("batch_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nr", "text"))), lambda x: x["text"]), separator).alias("text"), F.sum("tokens_in").alias("i"), F.sum("tokens_out").alias("o"))
    called = apply_model(joined, model, PROMPTS["combine"], "batch_id", "text").join(joined.select("batch_id", "i", "o"), "batch_id")
    return called.select("batch_id", "result", (F.col("tokens_in") + F.col("i")).alias("tokens_in"), (F.col("tokens_out") + F.col("o")).alias("tokens_out"))


_PARTIAL = "nr long, text string, tokens_in long, tokens_out long"


def merged_as_it_goes(chunks: DataFrame, model: Model, folder: str, order: str = "chunk_id", separator: str = "\n\n", every: int = FAN_IN, at_once: int = 16) -> DataFrame:
    """(nr, text, tokens_in, tokens_out): results of every so many chunks in their order, combined.
    The chunks lie in `folder` as a file for each group; a stream takes `at_once` files a
    micro-batch, whose partial results are a part of their own and count once they're written.
    Called again with the folder, it goes on: chunks whose partial is there aren't called
    again. Groups of which all calls failed are left out."""
    spark = chunks.sparkSession
    if not documents.exists(spark, f"{folder}/chunks/_SUCCESS"):
        grouped = pack.fixed_batches(chunks.select(F.col(order).alias("nr"), "text"), "nr", every)
        grouped.repartition("batch_id").sortWithinPartitions("batch_id", "nr").write.mode("overwrite").partitionBy("batch_id").parquet(f"{folder}/chunks")
    kind = chunks.schema[order].dataType.simpleString()

    def merge(batch: DataFrame, number: int) -> None:
        rows = work.materialise(batch, "batch")  # the calls below are made once
        done = apply_model(rows, model, PROMPTS["map"], "nr", "text").filter("error is null")
        named = done.select("nr", F.col("result").alias("text"), "tokens_in", "tokens_out").join(rows.select(F.col("nr").alias("own"), "batch_id"), F.col("nr") == F.col("own"))
        parts = work.materialise(named.drop("own"), "mapped")
        out = _combined(parts, model, separator).select(F.col("batch_id").alias("nr"), F.col("result").alias("text"), "tokens_in", "tokens_out")
        out.write.mode("overwrite").parquet(f"{folder}/partials/batch={number}")
        work.discard(rows, parts)

    stream = spark.readStream.schema(f"nr {kind}, text string, batch_id long").option("maxFilesPerTrigger", at_once).parquet(f"{folder}/chunks")
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    if not documents.exists(spark, f"{folder}/partials"):
        return spark.createDataFrame([], _PARTIAL)
    return spark.read.schema(_PARTIAL).parquet(f"{folder}/partials").select("nr", "text", "tokens_in", "tokens_out")


#: Tickets that one fold puts into chunks, at scale.
SHARD_TICKETS = 20_000


def ticket_chunks(tickets: DataFrame, tokens: int = 100_000, shards: int | None = None) -> DataFrame:
    """Tickets as blocks, put together into chunks of at most so many tokens; folds run
    within shards, one for `SHARD_TICKETS` tickets unless their number is given, so that chunk
    boundaries depend on it."""
    shards = shards or max(1, tickets.count() // SHARD_TICKETS)
    blocks = tickets.select("ticket_id", ticket_block(F.col("ticket_id"), F.col("text")).alias("text"))
    blocks = blocks.withColumn("tokens", estimate_tokens(F.col("text"))).withColumn("shard", F.pmod(F.xxhash64("ticket_id"), F.lit(shards)))
    batch = pack.greedy_batches(blocks, "ticket_id", "tokens", limit=tokens, most=1 << 30, shard_col="shard")
    grouped = blocks.select("ticket_id", "text").join(batch, "ticket_id").groupBy("shard", "batch_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ticket_id", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    return grouped.withColumn("chunk_id", F.concat_ws("-", F.lpad("shard", 6, "0"), F.lpad(F.col("batch_id").cast("string"), 12, "0")))


def overlapping_ticket_chunks(tickets: DataFrame, tokens: int, overlap: int) -> DataFrame:
    """Tickets as blocks in windows of so many tokens that overlap, over the whole corpus in the
    order of ids: no fold, and the same windows however many tickets there are."""
    blocks = tickets.select("ticket_id", ticket_block(F.col("ticket_id"), F.col("text")).alias("text"))
    blocks = blocks.withColumn("tokens", estimate_tokens(F.col("text")))
    held = pack.overlapping_chunks(blocks, "ticket_id", "tokens", tokens, overlap)
    parts = F.array_sort(F.collect_list(F.struct("position", "ticket_id", "text")))
    return blocks.select("ticket_id", "text").join(held, "ticket_id").groupBy("chunk_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n\n").alias("text"))


def classify(tickets: DataFrame, model: Model | None = None, most: int = 3, prompt: str = PROMPTS["classify"]) -> DataFrame:
    """ticket_id, category_ids, confidence, tokens_used: a failed call gives none at 0."""
    model = model or KeywordModel()
    got = apply_model(tickets, model, prompt, "ticket_id", "text")
    parsed = parse_classification(F.col("result"))
    ids = F.array_join(F.slice(parsed["categories"], 1, most).cast("array<string>"), ",")
    return got.select("ticket_id", F.coalesce(ids, F.lit("")).alias("category_ids"), F.coalesce(parsed["confidence"], F.lit(0.0)).alias("confidence"), (F.col("tokens_in") + F.col("tokens_out")).alias("tokens_used"))


def categorise(tickets: DataFrame, names: dict[int, str], model: Model | None = None) -> DataFrame:
    """Long rows (ticket_id, categoria), at most three a ticket."""
    out = classify(tickets, model).select("ticket_id", F.transform(F.filter(F.split("category_ids", ","), lambda x: x != ""), lambda x: x.cast("int")).alias("ids"))
    return out.select("ticket_id", F.explode(joins.names_of(F.col("ids"), names)).alias("categoria"))


def classify_batches(tickets: DataFrame, model: Model | None = None, size: int = 5) -> DataFrame:
    """Long rows (ticket_id, categoria), three a ticket at most: one call for each batch of
    `size` tickets in the order of their ids. Items without id or categories, and failed
    batches, give no rows."""
    rows = pack.fixed_batches(tickets.select(F.col("ticket_id").cast("string").alias("ticket_id"), "text"), "ticket_id", size)
    block = F.struct("ticket_id", ticket_block(F.col("ticket_id"), F.col("text")).alias("text"))
    batches = rows.groupBy("batch_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(block)), lambda x: x["text"]), "\n\n").alias("text"))
    got = apply_model(batches, model or KeywordModel(), PROMPTS["classify_batch"], "batch_id", "text")
    items = got.select(F.explode(items_of(F.col("result"))).alias("i"))
    return items.select(F.col("i.id").alias("ticket_id"), F.explode("i.cat").alias("categoria"))


def summarise(tickets: DataFrame, model: Model | None = None, bullets: int = 15) -> DataFrame:
    """The reduced text, then a call that gives its bullets and summary, and what is wrong
    with them."""
    model = model or KeywordModel()
    reduced = map_reduce(ticket_chunks(tickets), model).withColumn("id", F.lit(0))
    called = apply_model(reduced.select("id", F.col("result").alias("text")), model, PROMPTS["summarise"], "id", "text").select("id", F.col("result").alias("response"))
    return reduced.join(called, "id").withColumn("b", bullets_of(F.col("response"), bullets)).select("result", "b.bullets", "b.resumo", "b.issues")


def compress(analysis: DataFrame, model: Model | None = None) -> DataFrame:
    """A shorter text of a reduced analysis (column `result`), by one more call."""
    rows = analysis.select(F.lit(0).alias("id"), F.col("result").alias("text"))
    return apply_model(rows, model or KeywordModel(), PROMPTS["compress"], "id", "text").select("result", "tokens_in", "tokens_out")


def discover(tickets: DataFrame, model: Model | None = None, tokens: int = 100_000, overlap: int | None = None, folder: str | None = None) -> DataFrame:
    """A taxonomy: MAP over chunks of tickets (which share tickets of `overlap` tokens, if it's
    given), COMBINE, then EXTRACT as JSON; the document with its statistics, in one row. A
    response that holds no JSON leaves no row. With a folder, partial results are kept there."""
    model = model or KeywordModel()
    chunks = ticket_chunks(tickets, tokens) if overlap is None else overlapping_ticket_chunks(tickets, tokens, overlap)
    combined = map_reduce(chunks, model, separator=ANALYSES, folder=folder)
    called = apply_model(combined.select(F.lit(0).alias("id"), F.col("result").alias("text")), model, PROMPTS["extract"], "id", "text")
    whole = F.from_json("result", TAXONOMY)
    parsed = called.select(F.when(whole["categories"].isNotNull(), whole).otherwise(F.from_json(extract_json(F.col("result")), TAXONOMY)).alias("t")).select("t.*").filter("categories is not null")
    return with_statistics(parsed, tickets)


def with_statistics(taxonomy: DataFrame, tickets: DataFrame, least: int = 5, most: int = 25) -> DataFrame:
    """A taxonomy document with counts of tickets and categories, mean keywords, a level of
    confidence that grows with the categories, and whether their number is as expected."""
    counts = tickets.agg(F.count("*").alias("total_tickets_analyzed"), F.count_distinct("ticket_id").alias("unique_tickets"))
    n = F.size("categories")
    keywords = F.aggregate("categories", F.lit(0), lambda s, c: s + F.coalesce(F.size(c["keywords"]), F.lit(0))) / F.greatest(n, F.lit(1))
    subs = F.size(F.filter("categories", lambda c: F.coalesce(F.size(c["subcategories"]), F.lit(0)) > 0))
    found = F.struct(
        F.col("total_tickets_analyzed"), F.col("unique_tickets"), n.alias("categories_created"), F.round(keywords, 1).alias("avg_keywords_per_category"), subs.alias("categories_with_subcategories"),
        F.least(F.lit(0.95), 0.6 + n * 0.02).alias("confidence_level"), F.when(n < least, "few").when(n > most, "many").otherwise("expected").alias("category_count"),
    )
    return taxonomy.crossJoin(F.broadcast(counts)).select("version", "categories", found.alias("discovery_stats"))  # single rows


def categories_of(taxonomy: DataFrame) -> DataFrame:
    """The categories of a taxonomy document, a row each."""
    return taxonomy.select(F.inline("categories"))


def classify_with(tickets: DataFrame, taxonomy: DataFrame, model: Model | None = None, most: int = 3) -> DataFrame:
    """Classification with the categories of a taxonomy: their lines stand in the prompt, and
    results carry their names; ids that the taxonomy lacks go. The taxonomy has tens of
    rows and comes to the driver."""
    from ..functions.text import category_line

    model = model or KeywordModel()
    rows = categories_of(taxonomy).select("id", "display_name", category_line(F.col("id"), F.col("display_name"), F.col("description"), F.col("examples")).alias("line")).orderBy("id").collect()
    names = {r["id"]: r["display_name"] for r in rows}
    got = classify(tickets, model, most, "\n".join([PROMPTS["classify"], *(r["line"] for r in rows)]))
    ids = F.transform(F.filter(F.split("category_ids", ","), lambda x: x != ""), lambda x: x.cast("int"))
    known = F.filter(ids, lambda i: i.isin(list(names))) if names else F.array().cast("array<int>")
    out = got.withColumn("known", known)
    return out.select("ticket_id", F.array_join(F.col("known").cast("array<string>"), ",").alias("category_ids"), F.array_join(joins.names_of(F.col("known"), names), ",").alias("category_names"), "confidence", "tokens_used", F.lit(model.name).alias("model_used"))


def valid_taxonomy(c: str = "categories") -> "F.Column":
    """Every category of a taxonomy document has its id, name and description."""
    return F.col(c).isNotNull() & (F.size(c) > 0) & F.forall(c, lambda x: x["id"].isNotNull() & x["technical_name"].isNotNull() & x["display_name"].isNotNull() & x["description"].isNotNull())


def classify_cached(tickets: DataFrame, taxonomy: DataFrame, cache_path: str, model: Model | None = None, most: int = 3, buckets: int = 64) -> DataFrame:
    """ticket_id and category_ids, with responses stored by text, model and prompt: a
    ticket whose text was classified with this taxonomy before needs no call."""
    from ..functions.text import category_line

    model = model or KeywordModel()
    rows = categories_of(taxonomy).select(category_line(F.col("id"), F.col("display_name"), F.col("description"), F.col("examples")).alias("line")).orderBy("line").collect()  # tens of rows
    got = apply_cached(tickets, model, "\n".join([PROMPTS["classify"], *(r["line"] for r in rows)]), "text", cache_path, buckets)
    ids = parse_classification(F.col("result"))["categories"]
    return got.select("ticket_id", F.coalesce(F.array_join(F.slice(ids, 1, most).cast("array<string>"), ","), F.lit("")).alias("category_ids"))


def classify_file(spark: SparkSession, taxonomy_path: str, tickets_path: str, output: str, model: Model | None = None) -> DataFrame:
    """Classify the tickets of a message file with a stored taxonomy and save them as CSV."""
    taxonomy = reports.read_taxonomy(spark, taxonomy_path, TAXONOMY)
    messages = tables.numbered(tables.read_messages(spark, tickets_path))
    tickets = messages.groupBy("ticket_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n").alias("text"))
    out = work.materialise(classify_with(tickets, taxonomy, model), "classified")
    reports.write_classified(out, output)
    return out


def orchestrate(spark: SparkSession, messages: DataFrame, folder: str, fraction: float = 0.15, force: bool = False, model: Model | None = None) -> DataFrame:
    """Discovery on a sample, then application to all tickets; a phase whose table exists
    is not run again unless forced."""

    def once(name: str, make) -> DataFrame:
        path = f"{folder}/{name}"
        jpath = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if force or not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
            make().write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    tickets = once("tickets", lambda: prepare.prepare_tickets(messages))

    def taxonomy() -> DataFrame:
        n = tickets.count()
        drawn = sample.stratified(tickets, sample.target_size(n, fraction), "ticket_id", "ticket_created_at") if n else tickets
        return discover(drawn, model)

    found = once("taxonomy", taxonomy)
    results = once("results", lambda: classify_with(tickets, found, model))
    return stats.classification_stats(results)


def report_tables(categorised: DataFrame, column: str = "categoria", key: str = "ticket_id", final: DataFrame | None = None, summarised: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables of a report: what the sheets of a workbook and the sections of a text hold."""
    out = {
        "summary": stats.category_summary(categorised, column),
        "distribution": stats.category_distribution(categorised, column),
        "top_categories": stats.top_categories(categorised, column, key),
        "histogram": stats.size_histogram(categorised, column),
        "thresholds": stats.threshold_counts(categorised, column),
        "quality": stats.naming_quality(categorised, column),
        "diversity": runs.category_analysis(categorised, column),
    }
    if final is not None:
        out["data_flow"] = runs.data_flow(categorised, final)
        out["integrity"] = runs.integrity(categorised, final, column, key)
    if summarised is not None and "bullets" in summarised.columns:
        out["summaries"] = runs.summary_quality(summarised)
    return out


def report(spark: SparkSession, categorised: DataFrame, folder: str, column: str = "categoria", key: str | None = None, formats: tuple[str, ...] = ("csv", "text", "json", "xlsx"), **others: DataFrame) -> None:
    """The report: a CSV folder for each table, a text with a section for each, a JSON
    document, and a workbook with a sheet for each. Samples of the ten largest categories are
    a table of their own."""
    key = key or next(c for c in categorised.columns if c != column)
    parts = report_tables(categorised, column, key, **others)
    top = parts["top_categories"].select(column)
    samples = stats.first_rows(categorised.join(top, column, "left_semi"), column, key, 5)
    if "csv" in formats:
        for name, df in [*parts.items(), ("samples", samples)]:
            tables.write_csv(df, f"{folder}/{name}")
    if "xlsx" in formats:
        workbook.write_workbook({**parts, "samples": samples}, f"{folder}/report.xlsx")
    if "text" in formats:
        reports.write_text_report(spark, "Ticket report", parts, f"{folder}/report_text")
    if "json" in formats:
        reports.write_json_report(spark, parts, f"{folder}/report_json")
