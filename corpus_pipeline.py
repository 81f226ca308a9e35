"""The corpus pipeline: documents to packed training sequences, in five stages.

Every stage takes all that its predecessor kept. All but the last return the columns of
their input, whatever other columns it has and whatever they're called (doc_id, text and
lang are read, n_chars is kept up to date where it exists). Repeated rows and equal ids
stay rows of their own unless a stage's decision is about them; an empty table gives an
empty result in every stage. What nulls, empty and very long texts and ties mean is in
each stage's docstring.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoy.llm import decontam, jaccard, langid, lines, packing
from convoy.llm.common import remove_dir, work_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: A prediction below this says that the text is in none of the languages.
LEAST_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or that fit no learned language, go.

    Null and empty texts have no letter and go; a null id is judged by its text; texts of
    any length are judged as a whole; of equally probable languages the first by name
    counts; repeated rows are judged alike; without any labelled document all go.
    """
    own = {c: f"own_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    net = langid.fit(docs.filter(~langid.held_out("doc_id")))
    rows = docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(n) for c, n in own.items()))
    named = langid.predict(rows, net, keep=["text", *own.values()])
    kept = named.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return kept.select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines go; documents of which nothing is left go.

    The first of equal chunks stays: that of the least id (null is less than any), then the
    first place in it. Null and empty texts lose nothing and stay; texts of any length are
    cut as a whole; of repeated rows one keeps its lines.
    """
    own = {c: f"own_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "n_chars")}
    rows = docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(n) for c, n in own.items()))
    kept = lines.dedup_lines(rows, keep=list(own.values())).filter("n_removed = 0 or text <> ''")
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns))


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word shingles with similarity 0.8 or more stays:
    the one with the least id.

    Null and empty texts have no shingles and stay, and so do null ids; a text of fewer
    than five words is one shingle; texts of any length count as a whole; rows with one id
    stay or go together.
    """
    groups = jaccard.similar_groups(docs, k=5, num=80, den=100)
    return docs.join(groups.filter("component_id <> doc_id").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold none and stay; a null id stays, as rows are named by their
    ids; texts of any length are searched as a whole; rows with one id go together.
    """
    found = decontam.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens, a row for each piece of a document.

    Null and empty texts are the end token alone; null ids and repeated rows are documents
    of their own; texts of any length are cut over as many sequences as they need.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), size=1024, end_id=0)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language),
    ("line_dedup", line_dedup),
    ("near_dup", near_dup),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: The stages learn a network, follow hashes and align texts: SQL can't express them.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again by the next; a stage's table is
    deleted once the next has been written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    folder = work_dir(spark, "pipeline")
    for n, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{n}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove_dir(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
