"""Reports: a text with sections, a JSON document, metric tables and the loads of what
earlier runs left. A report's tables have a row for each category, phase, session or
metric, and all rows are written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import documents
from .documents import read_array, write_array  # noqa: F401  loads and saves of sessions, runs and rules
from .tables import read_messages, write_csv


def report_lines(title: str, tables: dict[str, DataFrame]) -> DataFrame:
    """(section, nr, line): a title, then a heading and a line for each row of each table,
    `column: value` with a bar between."""
    spark = next(iter(tables.values())).sparkSession
    out = spark.range(1).select(F.lit(0).alias("section"), F.lit(0).cast("long").alias("nr"), F.lit(title).alias("line"))
    for n, (name, df) in enumerate(tables.items(), 1):
        cells = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("-"))) for c in df.columns]
        lines = df.select(F.lit(n).alias("section"), (F.monotonically_increasing_id() + 1).alias("nr"), F.concat_ws(" | ", *cells).alias("line"))
        head = spark.range(1).select(F.lit(n).alias("section"), F.lit(0).cast("long").alias("nr"), F.lit(f"== {name} ==").alias("line"))
        out = out.unionByName(head).unionByName(lines)
    return out


def write_text_report(spark: SparkSession, title: str, tables: dict[str, DataFrame], path: str) -> None:
    """One text file with a section for each table."""
    lines = report_lines(title, tables).orderBy("section", "nr").select(F.col("line").alias("value"))
    lines.coalesce(1).write.mode("overwrite").text(path)


def write_json_report(spark: SparkSession, tables: dict[str, DataFrame], path: str) -> None:
    """One JSON document with all rows of each table, and the time."""
    documents.write_document(tables, path)


def sections_csv(tables: dict[str, DataFrame], path: str, sep: str = ",") -> None:
    """One CSV with all tables: section, then up to as many values as the widest has."""
    width = max(len(df.columns) for df in tables.values())
    rows = None
    for n, (name, df) in enumerate(tables.items()):
        spark = df.sparkSession
        values = [F.col(f"`{c}`").cast("string") for c in df.columns] + [F.lit(None).cast("string")] * (width - len(df.columns))
        names = [F.lit(c) for c in df.columns] + [F.lit(None).cast("string")] * (width - len(df.columns))
        head = spark.range(1).select(F.lit(n).alias("s"), F.lit(0).cast("long").alias("nr"), F.lit(name).alias("section"), *(v.alias(f"v{i}") for i, v in enumerate(names)))
        body = df.select(F.lit(n).alias("s"), (F.monotonically_increasing_id() + 1).alias("nr"), F.lit(name).alias("section"), *(v.alias(f"v{i}") for i, v in enumerate(values)))
        part = head.unionByName(body)
        rows = part if rows is None else rows.unionByName(part)
    rows.orderBy("s", "nr").drop("s", "nr").coalesce(1).write.mode("overwrite").csv(path, sep=sep, header=False)


def write_categorised(df: DataFrame, path: str) -> None:
    """The file of categorised tickets: `;`, header, UTF-8 with a byte-order mark, by ticket_id."""
    first, *rest = df.columns
    rows = df.orderBy("ticket_id").select(F.col(first).alias("\ufeff" + first), *rest)
    rows.coalesce(1).write.mode("overwrite").csv(path, sep=";", header=True)


def write_classified(df: DataFrame, path: str) -> None:
    """Classified tickets as one CSV, by ticket_id."""
    write_csv(df, path, sep=",", order=["ticket_id"], one_file=True)


def write_merged(df: DataFrame, path: str) -> None:
    """Categories and summaries of tickets as one CSV: `;`, by ticket_id, nested columns as JSON."""
    write_csv(df, path, order=["ticket_id"] if "ticket_id" in df.columns else None, one_file=True)


def write_summary(summary: DataFrame, path: str) -> None:
    """A summary (bullets, resumo) as `bullets.csv` (nr, bullet) and `summary.txt` in a folder each."""
    spark = summary.sparkSession
    bullets = summary.select(F.posexplode("bullets").alias("nr", "bullet")).select(F.concat_ws(";", (F.col("nr") + 1).cast("string"), F.concat(F.lit('"'), F.replace("bullet", F.lit('"'), F.lit('\\"')), F.lit('"'))).alias("value"))
    documents.write_lines([documents.line(spark, "nr;bullet"), bullets], f"{path}/bullets", "bullets.csv")
    documents.write_lines([summary.select(F.coalesce("resumo", F.lit("")).alias("value"))], f"{path}/summary", "summary.txt")


def write_taxonomy(taxonomy: DataFrame, path: str) -> None:
    """A taxonomy document (one row) as indented JSON, `taxonomy.json` in a folder."""
    whole = taxonomy.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in taxonomy.columns)), {"pretty": "true"}).alias("value"))
    documents.write_lines([whole], path, "taxonomy.json")


def read_taxonomy(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A taxonomy document from its JSON file; one without categories is an error."""
    found = spark.read.schema(schema).json(path, multiLine=True)
    if found.filter("categories is not null and size(categories) > 0").isEmpty():
        raise ValueError(f"no categories in {path}")
    return found


def write_quarantine(failed: DataFrame, path: str, text_col: str = "text") -> None:
    """Rows whose call failed, with the first 1,000 characters of their text."""
    failed.select("error", F.substring(text_col, 1, 1000).alias("text"), F.current_timestamp().alias("at")).write.mode("append").json(path)


def error_context(c, at, around: int = 100):
    """The text around a place."""
    return F.substring(c, F.greatest(at - around, F.lit(1)), 2 * around)


# --- what earlier runs left


def inputs_in(spark: SparkSession, folder: str) -> list[str]:
    """The message files of a folder, sorted."""
    return [f"{folder.rstrip('/')}/{n}" for n in documents.names_in(spark, folder) if n.lower().endswith((".csv", ".xlsx"))]


def choose_input(spark: SparkSession, folder: str, path: str | None = None) -> str:
    """The named file, relative to the folder unless absolute, or the folder's first one."""
    if path:
        return path if path.startswith("/") or "://" in path else f"{folder.rstrip('/')}/{path}"
    found = inputs_in(spark, folder)
    if not found:
        raise FileNotFoundError(f"no message file in {folder}")
    return found[0]


def artefacts(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """What a run left in its folder: `categorized` has to be there, `final` and `summarized`
    may be."""
    held = documents.names_in(spark, folder)
    out = {n: spark.read.parquet(f"{folder.rstrip('/')}/{n}") for n in ("categorized", "final", "summarized") if n in held}
    if "categorized" not in out:
        raise FileNotFoundError(f"no categorized tickets in {folder}")
    return out


SESSIONS = "session_id string, start_time double, end_time double, total_input_tokens long, total_output_tokens long, total_cost_usd double, operations_count long, dataset_size long, processing_mode string"
RUNS = "run_id string, timestamp timestamp, dataset_size long, workers_used int, actual_duration_minutes double, throughput_tickets_per_minute double"
ALERT_RULES = "alert_type string, alert_level string, threshold_value double, enabled boolean, cooldown_minutes int"


def required_columns(df: DataFrame, names: tuple[str, ...] = ("ticket_id", "category", "text", "sender")) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return df


def load_messages(spark: SparkSession, folder: str, path: str | None = None, limit: int | None = None) -> DataFrame:
    """The chosen message file, with the required columns checked."""
    return required_columns(read_messages(spark, choose_input(spark, folder, path), limit=limit))
