"""From messages to tickets: filters, cleaning, roll-up and quality reports.

Messages have ticket_id, seq (order of arrival), sender, text, category and
ticket_created_at. Nulls in text columns count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions.text import AI_SENDERS, clean_text, message_totals, strip, word_count
from .quantiles import quantiles, with_medians

AGENTS = ["AGENT", "HELPDESK_INTEGRATION"]
TICKET_COLUMNS = ["ticket_id", "text", "ticket_created_at", "sender"]


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def is_text_category(c: Column) -> Column:
    return F.lower(strip(F.coalesce(c, F.lit("")))) == "text"


def is_ai_sender(c: Column) -> Column:
    return F.lower(strip(F.coalesce(c, F.lit("")))).isin(AI_SENDERS)


def filter_category(messages: DataFrame) -> DataFrame:
    return require_columns(messages, "category").filter(is_text_category(F.col("category")))


def prepare_fields(messages: DataFrame) -> DataFrame:
    """Text cleaned; rows with a blank ticket, sender or text go."""
    out = require_columns(messages, "text", "ticket_id", "sender")
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    out = out.withColumns({"ticket_id": empty("ticket_id"), "sender": empty("sender"), "text": clean_text(empty("text"))})
    return out.filter((strip(F.col("ticket_id")) != "") & (strip(F.col("sender")) != "") & (strip(F.col("text")) != ""))


def drop_ai_messages(messages: DataFrame) -> DataFrame:
    return messages.filter(~is_ai_sender(F.col("sender")))


def valid_messages(messages: DataFrame, least: int = 2) -> DataFrame:
    """All messages of tickets with enough messages of users and of agents; one shuffle."""
    w = W.partitionBy("ticket_id")
    return (
        messages.withColumn("__u", F.count_if(F.col("sender") == "USER").over(w))
        .withColumn("__a", F.count_if(F.col("sender").isin(AGENTS)).over(w))
        .filter((F.col("__u") >= least) & (F.col("__a") >= least))
        .drop("__u", "__a")
    )


def sender_histogram(senders: Column) -> Column:
    """`Total: 5 mensagens ({'USER': 3, 'AGENT': 2})` of an array, most frequent first."""
    counted = F.transform(F.array_distinct(senders), lambda s: F.struct((-F.size(F.filter(senders, lambda x: x == s))).alias("n"), s.alias("s")))
    shown = F.transform(F.array_sort(counted), lambda p: F.concat(F.lit("'"), p["s"], F.lit("': "), (-p["n"]).cast("string")))
    return F.concat(F.lit("Total: "), F.size(senders).cast("string"), F.lit(" mensagens ({"), F.array_join(shown, ", "), F.lit("})"))


def group_tickets(messages: DataFrame, least: int = 0) -> DataFrame:
    """One row a ticket: texts joined in order, first creation time, histogram of senders.
    With `least`, tickets with too few messages of either side go, in the same shuffle."""
    grouped = messages.groupBy("ticket_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("seq", "text")))), lambda x: x["text"]), " ").alias("text"),
        F.min_by("ticket_created_at", F.when(F.col("ticket_created_at").isNotNull(), F.col("seq"))).alias("ticket_created_at"),
        F.collect_list("sender").alias("__senders"),
    )
    if least:
        side = lambda names: F.size(F.filter("__senders", lambda s: s.isin(names)))
        grouped = grouped.filter((side(["USER"]) >= least) & (side(AGENTS) >= least))
    return grouped.withColumn("sender", sender_histogram(F.col("__senders"))).filter(strip(F.col("text")) != "").select(*TICKET_COLUMNS)


def prepare_tickets(messages: DataFrame) -> DataFrame:
    """The whole preparation. AI messages go before texts are cleaned, which gives the
    same rows for less work; tickets are counted and rolled up in one shuffle."""
    return group_tickets(prepare_fields(drop_ai_messages(filter_category(messages))), least=2)


def filtering_report(messages: DataFrame) -> DataFrame:
    """Rows left after each step, and their share of all rows. One pass and one shuffle:
    the messages of a ticket are counted where they meet."""
    c = clean_text(F.coalesce(F.col("text"), F.lit("")))
    flags = messages.select(
        "ticket_id",
        "sender",
        is_text_category(F.col("category")).alias("a"),
        ((strip(F.coalesce("ticket_id", F.lit(""))) != "") & (strip(F.coalesce("sender", F.lit(""))) != "") & (strip(c) != "")).alias("b"),
        (~is_ai_sender(F.col("sender"))).alias("c"),
    )
    left = F.col("a") & F.col("b") & F.col("c")
    tickets = flags.groupBy("ticket_id").agg(
        F.count("*").alias("raw"),
        F.count_if("a").alias("category"),
        F.count_if(F.col("a") & F.col("b")).alias("fields"),
        F.count_if(left).alias("human"),
        F.count_if(left & (F.col("sender") == "USER")).alias("u"),
        F.count_if(left & F.col("sender").isin(AGENTS)).alias("g"),
    )
    ok = (F.col("u") >= 2) & (F.col("g") >= 2)
    total = tickets.agg(
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("raw", "category", "fields", "human")),
        F.coalesce(F.sum(F.when(ok, F.col("human"))), F.lit(0)).alias("valid"),
        F.count_if(ok).alias("tickets"),
    )
    steps = ", ".join(f"'{c}', {c}" for c in ("raw", "category", "fields", "human", "valid", "tickets"))
    return total.select("raw", F.expr(f"stack(6, {steps}) as (step, n)")).select("step", "n", F.round(F.try_divide(F.col("n") * 100.0, F.col("raw")), 2).alias("percent"))


def messages_per_ticket(messages: DataFrame) -> DataFrame:
    """Mean, median and most messages of users and of agents in a ticket."""
    counts = messages.groupBy("ticket_id").agg(F.count_if(F.col("sender") == "USER").alias("user"), F.count_if(F.col("sender").isin(AGENTS)).alias("agent"))
    one = counts.agg(*(f(c).alias(f"{n}_{c}") for c in ("user", "agent") for n, f in (("mean", F.avg), ("max", F.max))))
    one = with_medians(one, counts, {f"median_{c}": F.col(c) for c in ("user", "agent")})
    return one.select(*(f"{n}_{c}" for c in ("user", "agent") for n in ("mean", "median", "max")))


def length_stats(df: DataFrame, column: str = "text") -> DataFrame:
    """Mean, median, least, greatest and deviation of characters and words."""
    n = df.select(F.length(column).cast("long").alias("chars"), word_count(F.col(column)).alias("words"))
    parts = (("mean", F.avg), ("min", F.min), ("max", F.max), ("std", F.stddev_samp))
    one = n.agg(*(f(c).alias(f"{name}_{c}") for c in ("chars", "words") for name, f in parts))
    one = with_medians(one, n, {f"median_{c}": F.col(c) for c in ("chars", "words")})
    return one.select(*(f"{name}_{c}" for c in ("chars", "words") for name in ("mean", "median", "min", "max", "std")))


def date_range(df: DataFrame, column: str = "ticket_created_at") -> DataFrame:
    """First and last time and whole days between them; texts that aren't times are skipped."""
    t = F.try_to_timestamp(F.col(column)) if isinstance(df.schema[column].dataType, T.StringType) else F.col(column).cast("timestamp")
    out = df.agg(F.min(t).alias("first"), F.max(t).alias("last"))
    return out.withColumn("days", F.floor((F.unix_timestamp("last") - F.unix_timestamp("first")) / 86400))


def message_distribution(tickets: DataFrame) -> DataFrame:
    """Statistics and quartiles of the totals in the tickets' sender histograms."""
    n = tickets.select(message_totals(F.col("sender"))[0].alias("n")).filter("n is not null")
    out = n.agg(F.avg("n").alias("mean"), F.min("n").alias("least"), F.max("n").alias("most"), F.stddev_samp("n").alias("std"))
    return out.crossJoin(F.broadcast(quantiles(n, "n", {"q25": 0.25, "q50": 0.5, "q75": 0.75})))  # single rows


def quality_assessment(df: DataFrame, id_col: str = "ticket_id", text_col: str = "text") -> DataFrame:
    """Completeness and uniqueness in percent, texts over ten characters, and counts
    beyond the 95th and under the 5th percentile of lengths."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.length(text_col).alias("n"))
    bounds = quantiles(rows, "n", {"short": 0.05, "long": 0.95})
    return (
        rows.crossJoin(F.broadcast(bounds))  # a single row
        .agg(
            (F.count_if(F.col("t").isNotNull() & (F.col("t") != "")) * 100.0 / F.count("*")).alias("completeness"),
            (F.count_distinct("id") * 100.0 / F.count("*")).alias("uniqueness"),
            (F.count_if(F.col("n") > 10) * 100.0 / F.count("*")).alias("over_ten"),
            F.count_if(F.col("n") > F.col("long")).alias("very_long"),
            F.count_if(F.col("n") < F.col("short")).alias("very_short"),
        )
    )


def demo_filter(messages: DataFrame) -> DataFrame:
    """Messages of the category TEXT by a user or an agent that aren't blank."""
    return messages.filter((F.col("category") == "TEXT") & F.col("sender").isin("USER", "AGENT") & (strip(F.coalesce("text", F.lit(""))) != ""))


def parse_time(c: Column, strict: bool = False) -> Column:
    """A text as a timestamp: what isn't one is null, or an error if strict."""
    return F.to_timestamp(c) if strict else F.try_to_timestamp(c)


def lenient_stream_filter(messages: DataFrame) -> DataFrame:
    """The row filter of streams: no rule about the number of messages, blank senders stay."""
    blank = lambda c: strip(F.coalesce(F.col(c), F.lit(""))) == ""
    keep = is_text_category(F.col("category")) & ~blank("text") & ~blank("ticket_id")
    return messages.filter(keep & ~F.lower(F.coalesce("sender", F.lit(""))).isin(AI_SENDERS)).withColumn("text", clean_text(F.col("text")))


def conversation_texts(messages: DataFrame) -> DataFrame:
    """Per ticket: its lines `[sender]: text` in order; blank messages and empty tickets go."""
    from ..functions.text import conversation_line

    rows = messages.filter(strip(F.coalesce("text", F.lit(""))) != "")
    line = F.struct("seq", conversation_line(F.col("sender"), F.col("text")).alias("line"))
    return rows.groupBy("ticket_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("text"), F.count("*").alias("n_messages"))
