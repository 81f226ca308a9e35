"""Exact deduplication with a persistent digest index (operator 12), in DataFrame
operations alone.

Texts are equal if they're identical without ASCII white space; the SHA-256 of what is left
names them. The index is a list of runs in a folder, one for each batch that was added: a
Parquet table bucketed and sorted by digest, with a row for each text that the batch was the
first to bring. A new batch is reduced to a row for each of its digests (copies
are combined before they're shuffled), dealt out like the buckets, and sort-merge
anti-joined with every run, none of which moves; what is left is appended as a run
of its own. An index begins with an empty run, so that the first batch takes the way of all
others. A batch is named, its entries bear its name, and adding it again replaces its run,
so that a job that dies is simply run again.

Rows find the row that stays by their digest. Texts that more than one row in
`HOT_SHARE` has are at most `HOT_SHARE`: these are broadcast, all others are joined by
sort-merge, so that no task receives more than a small part of the rows for one text.

Edge cases: null and empty texts are equal to each other and to texts of white space
alone; of equal texts the row with the most code points stays, then the one of the least
id (a null id comes last); of repeated rows one stays; an empty table gives an empty result; texts of any length are
hashed whole; extra columns are not read, whatever they're called.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, remove_dir, table_bytes, work_dir

WHITE = r"[\x20\x09-\x0D]+"
#: A text is hot if more than one row in so many has it; there are at most so many hot texts.
HOT_SHARE = 1000
ENTRY = "digest binary, keep_id long, place long, n_chars long, n long, batch string"
EMPTY_RUN = "empty"


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null is empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), WHITE, "")


class DigestIndex:
    """Runs below `path`, bucketed and sorted by digest. The number of buckets is that of
    the first run; choose it for the index at its largest."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, fan_in: int = 8):
        self.spark, self.path, self.fan_in = spark, path.rstrip("/"), fan_in
        known = [int(n.split("-")[1]) for n in self._names(self.path) if n.startswith("buckets-")]
        self.buckets = known[0] if known else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.folder = f"{self.path}/buckets-{self.buckets}"
        if not self.runs():
            self.write(spark.createDataFrame([], ENTRY), EMPTY_RUN)

    def _names(self, path: str) -> list[str]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []

    def runs(self) -> list[str]:
        """Names of the runs whose write has ended."""
        return [n for n in self._names(self.folder) if "_SUCCESS" in self._names(f"{self.folder}/{n}")]

    def read(self, run: str) -> DataFrame:
        """A run; the catalogue knows it only while the plan is made."""
        name = f"digests_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} ({ENTRY}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{run}'")
        table = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")
        return table

    def write(self, entries: DataFrame, run: str) -> DataFrame:
        remove_dir(self.spark, f"{self.folder}/{run}")
        name = f"digests_{uuid.uuid4().hex}"
        entries.write.format("parquet").option("path", f"{self.folder}/{run}").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")
        return self.read(run)

    def dealt(self, entries: DataFrame) -> DataFrame:
        """As the buckets are."""
        return entries.repartition(self.buckets, "digest")

    def fresh(self, entries: DataFrame, batch: str) -> DataFrame:
        """Entries whose digest no other batch has, by sort-merge anti-joins with the buckets."""
        for run in self.others(batch):
            entries = entries.join(self.read(run).filter(F.col("batch") != batch).select("digest").hint("merge"), "digest", "left_anti")
        return entries

    def known(self, entries: DataFrame, batch: str) -> DataFrame:
        """Entries that another batch has, with the row that stays there."""
        found = []
        for run in self.others(batch):
            old = self.read(run).filter(F.col("batch") != batch).select("digest", F.col("keep_id").alias("old_id"), F.col("batch").alias("old_batch"))
            own = entries.join(old.hint("merge"), "digest")
            found.append(own.select("digest", F.col("old_id").alias("keep_id"), F.lit(None).cast("long").alias("place"), "n_chars", "n", F.col("old_batch").alias("batch")))
        return functools.reduce(DataFrame.unionByName, found)

    def others(self, batch: str) -> list[str]:
        return [r for r in self.runs() if r != f"batch-{batch}"]

    def add(self, entries: DataFrame, batch: str) -> DataFrame:
        """Append what is new; returns the row that stays for every entry of the batch."""
        entries = materialise(entries, "entries")
        new = self.write(self.fresh(self.dealt(entries), batch), f"batch-{batch}")
        old = materialise(self.known(self.dealt(entries), batch), "known")
        discard(entries)
        return new.unionByName(old)

    def compact(self) -> None:
        """Merge the runs into one if they are many. It is written before they go: a job
        that dies between leaves entries twice, which changes no anti-join."""
        runs = self.runs()
        if len(runs) < self.fan_in:
            return
        every = self.dealt(functools.reduce(DataFrame.unionByName, [self.read(r) for r in runs]))
        self.write(every.dropDuplicates(["digest"]), f"merged-{uuid.uuid4().hex}")
        for run in runs:
            remove_dir(self.spark, f"{self.folder}/{run}")


def dedup_exact(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, batch: str = "batch", buckets: int | None = None, hot_share: int = HOT_SHARE
) -> DataFrame:
    """Per row: id, keep_id, group_size (rows of this batch with the text), kept and
    text_sha256. Texts that an index at `folder` holds from other batches keep the row
    that stays there; all others are appended to it as the run `batch`."""
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"),
        F.unhex(F.sha2(normalised(text), 256)).alias("digest"), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n_chars"),
    )
    rows = materialise(rows, "digests")  # texts are hashed once, and a row keeps its number
    index = DigestIndex(spark, folder or work_dir(spark, "digest-index"), buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), table_bytes(rows) >> 27))
    index.compact()
    best = F.min(F.struct((-F.col("n_chars")).alias("shorter"), F.col("id").isNull().alias("nameless"), "id", "row"))
    groups = rows.groupBy("digest").agg(best.alias("best"), F.count("*").alias("n"))
    names = index.add(groups.select("digest", F.col("best.id").alias("keep_id"), F.col("best.row").alias("place"), (-F.col("best.shorter")).alias("n_chars"), "n", F.lit(batch).alias("batch")), batch)
    names, total = names.select("digest", "keep_id", "place", "n"), rows.count()
    hot = F.broadcast(names.filter(F.col("n") * hot_share > total))  # fewer than hot_share rows
    cold = rows.join(hot.select("digest"), "digest", "left_anti").join(names.filter(F.col("n") * hot_share <= total).hint("merge"), "digest")
    return rows.join(hot, "digest").unionByName(cold).select(
        F.col("id").alias(id_col), "keep_id", F.col("n").alias("group_size"), (F.col("row").eqNullSafe(F.col("place"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )
