"""JSON documents and arrays: one document of many rows without holding them, arrays that
several writers append to, and the first bytes of a file.

An array at `path` grows beside it: every append is a folder of its own in `path.log`, which
counts once its write has ended, so that writers at the same time lose nothing and
a writer that dies leaves nothing. `compact_array` writes all of it as one JSON
array and names the parts that it stands for before it counts; only then do these go.
"""

from __future__ import annotations

import functools
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _at(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if it's missing."""
    fs, at = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


def touch(spark: SparkSession, path: str) -> None:
    """An empty file; one that is there already stays."""
    fs, at = _at(spark, path)
    fs.create(at, True).close()


def first_bytes(spark: SparkSession, path: str, n: int = 65536) -> bytes:
    """The first bytes of the first file that has any, of a file, a folder or a pattern; no more is read."""
    fs, at = _at(spark, path)
    for found in fs.globStatus(at) or []:
        files = sorted(fs.listStatus(found.getPath()), key=lambda s: s.getPath().getName()) if found.isDirectory() else [found]
        for f in files:
            if f.isFile() and f.getLen() and not f.getPath().getName().startswith(("_", ".")):
                stream = fs.open(f.getPath())
                try:
                    return bytes(stream.readNBytes(n))
                finally:
                    stream.close()
    return b""


def write_lines(lines: list[DataFrame], path: str, name: str) -> None:
    """One text file `name` in the folder `path`: the lines (a column each) of all tables in
    their order. They stream through one task, as a file has one writer."""
    spark = lines[0].sparkSession
    every = functools.reduce(DataFrame.union, [x.coalesce(1) for x in lines])
    every.coalesce(1).write.mode("overwrite").text(path)
    part = next(n for n in names_in(spark, path) if n.startswith("part-"))
    fs, _ = _at(spark, path)
    if not fs.rename(_at(spark, f"{path}/{part}")[1], _at(spark, f"{path}/{name}")[1]):
        raise OSError(f"{path}/{name} could not be named")


def line(spark: SparkSession, text: str) -> DataFrame:
    return spark.range(1).select(F.lit(text).alias("value"))


def array_lines(df: DataFrame) -> DataFrame:
    """The rows of a table as JSON, each with a comma before it but the first."""
    rows = df.coalesce(1).select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}).alias("json"), F.monotonically_increasing_id().alias("nr"))
    return rows.select(F.concat(F.when(F.col("nr") > 0, ",").otherwise(""), F.col("json")).alias("value"))


def write_document(tables: dict[str, DataFrame], path: str, name: str = "report.json") -> None:
    """One JSON object with an array of all rows of each table, and the time."""
    spark = next(iter(tables.values())).sparkSession
    key = lambda text: text.replace("\\", "\\\\").replace('"', '\\"')
    lines = [line(spark, "{")]
    for table, df in tables.items():
        lines += [line(spark, f'"{key(table)}": ['), array_lines(df), line(spark, "],")]
    now = spark.range(1).select(F.concat(F.lit('"generated_at": "'), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"), F.lit('"}')).alias("value"))
    write_lines([*lines, now], path, name)


def write_array(df: DataFrame, path: str) -> None:
    """All rows as one JSON array, in a file of the folder `path`."""
    spark = df.sparkSession
    write_lines([line(spark, "["), array_lines(df), line(spark, "]")], path, "array.json")


def _records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON array or of JSON lines, told apart by the first byte and line."""
    head = first_bytes(spark, path).decode("utf-8", "replace").lstrip("﻿ \t\r\n")
    whole = head.startswith("[") or not head.split("\n", 1)[0].rstrip().endswith("}")
    return spark.read.schema(schema).json(path, multiLine=whole)


def read_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records of an array (sessions, runs, alert rules) and of what was appended to it:
    a file or folder with a JSON array or JSON lines; none of it, no rows."""
    path = path.rstrip("/")
    base, parts = _parts(spark, path)
    found = [_records(spark, p, schema) for p in [*base, *parts]]
    return functools.reduce(DataFrame.unionByName, found, spark.createDataFrame([], schema))


def _parts(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """What holds the array: the last compaction, or else the file itself, and later parts."""
    log = f"{path}.log"
    ended = [n for n in names_in(spark, log) if not n.startswith("replaced-") and "_SUCCESS" in names_in(spark, f"{log}/{n}")]
    base = max((n for n in ended if n.startswith("base-")), default=None)
    gone = {r["value"] for r in spark.read.text(f"{log}/replaced-{base}").collect()} if base else set()  # names of parts
    own = [f"{log}/{base}"] if base else []
    if exists(spark, path) and "." not in gone:
        own.append(path)
    return own, [f"{log}/{n}" for n in ended if n.startswith("part-") and n not in gone]


def append_array(df: DataFrame, path: str) -> None:
    """Append rows to the array at `path`; others may append at the same time."""
    df.write.json(f"{path.rstrip('/')}.log/part-{time.time_ns():020d}-{uuid.uuid4().hex}")


def compact_array(spark: SparkSession, path: str, schema: str) -> None:
    """All of the array as one JSON array. What is appended meanwhile stays beside it; of
    two compactions at once the later one's parts count. A crash leaves the array as it was."""
    path = path.rstrip("/")
    base, parts = _parts(spark, path)
    log, name = f"{path}.log", f"base-{time.time_ns():020d}-{uuid.uuid4().hex}"
    replaced = ["." if p == path else p.rsplit("/", 1)[1] for p in [*base, *parts]]
    replaced = sorted({*replaced, "."})
    spark.createDataFrame([(x,) for x in replaced], "value string").coalesce(1).write.text(f"{log}/replaced-{name}")
    write_array(functools.reduce(DataFrame.unionByName, [_records(spark, p, schema) for p in [*base, *parts]], spark.createDataFrame([], schema)), f"{log}/{name}")
    for p in [*base, *parts]:
        fs, at = _at(spark, p)
        fs.delete(at, True)
