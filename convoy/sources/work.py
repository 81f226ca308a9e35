"""Work tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where the session
    names none: a temporary folder in a single JVM, else a folder beside the warehouse."""
    path = spark.conf.get("spark.checkpoint.dir", None) or (
        spark.sparkContext._jsc.sc().getCheckpointDir().get() if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else None
    )
    if not path:
        alone = spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")
        path = "file://" + tempfile.mkdtemp(prefix="convoy-") if alone else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-work"
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def work_dir(spark: SparkSession, what: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write to the shared folder as Parquet and read again: cuts lineage, survives
    the loss of any executor."""
    path = work_dir(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.work_folder = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the folders of materialised tables that no later plan reads."""
    for df in tables:
        if getattr(df, "work_folder", None):
            remove_dir(df.sparkSession, df.work_folder)


def remove_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
