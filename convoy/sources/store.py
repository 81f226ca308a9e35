"""Results by key, in immutable runs that are cut by buckets of keys.

Every write is a run of its own, so that writers at the same time don't touch each other's files;
a run counts once its write has ended. A look-up reads the files of the buckets that its
keys fall into, and no others. Of several results for a key the earliest counts, so that all
readers agree whoever wrote twice. When there are `fan_in` runs, they're merged into one."""

from __future__ import annotations

import functools
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .documents import names_in
from .work import remove_dir


class ResultStore:
    """Rows of `columns` (a schema in which key is a string) below `path`. The number of
    buckets is that with which the store began."""

    def __init__(self, spark: SparkSession, path: str, columns: str, buckets: int = 64, fan_in: int = 8):
        self.spark, self.path, self.columns, self.fan_in = spark, path.rstrip("/"), columns, fan_in
        known = [n for n in names_in(spark, self.path) if n.startswith("buckets-")]
        self.buckets = int(known[0].split("-")[1]) if known else buckets
        self.folder = f"{self.path}/buckets-{self.buckets}"

    def bucket(self, key: str = "key") -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def runs(self) -> list[str]:
        return [n for n in names_in(self.spark, self.folder) if "_SUCCESS" in names_in(self.spark, f"{self.folder}/{n}")]

    def _read(self, run: str) -> DataFrame:
        return self.spark.read.schema(f"{self.columns}, written long, bucket int").parquet(f"{self.folder}/{run}")

    def _every(self, runs: list[str]) -> DataFrame:
        none = self.spark.createDataFrame([], f"{self.columns}, written long, bucket int")
        return functools.reduce(DataFrame.unionByName, [self._read(r) for r in runs], none)

    def _write(self, rows: DataFrame) -> str:
        run = f"run-{time.time_ns():020d}-{uuid.uuid4().hex}"
        dealt = rows.repartition(self.buckets, "bucket").sortWithinPartitions("bucket", "key")
        dealt.write.partitionBy("bucket").option("parquet.bloom.filter.enabled#key", "true").parquet(f"{self.folder}/{run}")
        return run

    def put(self, rows: DataFrame) -> None:
        self._write(rows.withColumn("written", F.lit(time.time_ns())).withColumn("bucket", self.bucket()))

    def get(self, keys: DataFrame) -> DataFrame:
        """The stored rows of the keys (`key`)."""
        hit = [r["b"] for r in keys.select(self.bucket().alias("b")).distinct().collect()]  # a row for each bucket at most
        rows = self._every(self.runs()).filter(F.col("bucket").isin(hit)).join(keys.select("key").distinct(), "key", "left_semi")
        return self._earliest(rows).drop("bucket", "written")

    def _earliest(self, rows: DataFrame) -> DataFrame:
        names = [c for c in rows.columns if c not in ("key", "bucket")]
        first = rows.groupBy("bucket", "key").agg(F.min(F.struct("written", *(c for c in names if c != "written"))).alias("first"))
        return first.select("bucket", "key", *(F.col(f"first.{c}").alias(c) for c in names))

    def read(self) -> DataFrame:
        return self._earliest(self._every(self.runs())).drop("bucket", "written")

    def compact(self) -> None:
        """Merge the runs if there are many. They go once the merged one is there: a job that
        dies between leaves rows twice, which readers don't see."""
        runs = self.runs()
        if len(runs) < self.fan_in:
            return
        self._write(self._earliest(self._every(runs)))
        for run in runs:
            remove_dir(self.spark, f"{self.folder}/{run}")
