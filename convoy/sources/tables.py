"""Readers and writers of message files and of reports."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import NA_VALUES
from .delimited import read_csv
from .documents import first_bytes

REQUIRED = ("ticket_id", "category", "text", "sender")


def sniff(head: bytes) -> tuple[str, str, list[str]]:
    """Encoding, separator and header of a CSV file. The separator is the one whose
    header has the most of the required columns."""
    body = head.removeprefix(b"\xef\xbb\xbf")
    try:
        body[: body.rfind(b"\n") + 1 or None].decode("utf-8")
        encoding = "utf-8"
    except UnicodeDecodeError:
        encoding = "iso-8859-1"
    line = body.decode(encoding, "replace").split("\n", 1)[0].rstrip("\r")
    names = {sep: [x.strip().strip('"') for x in line.split(sep)] for sep in (";", ",")}
    sep = max(names, key=lambda s: (sum(r in names[s] for r in REQUIRED), len(names[s]) * (s == ";")))
    return encoding, sep, names[sep]


def read_messages(spark: SparkSession, path: str, *, limit: int | None = None, na_values: list[str] | None = None, sep: str | None = None, position: str | None = None) -> DataFrame:
    """A message file: CSV (encoding and separator found out), JSON, Parquet or .xlsx; all
    columns are text. Rows with too many fields are skipped, short ones filled with nulls;
    the words for missing values are null. `position` (of CSV only) names a column for the
    rows' numbers in the file, from 0."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if position and suffix != "csv":
        raise ValueError(f"rows have no position in a file of kind {suffix}")
    if suffix == "xls":
        raise ValueError("old workbooks (.xls) can't be read: save the file as .xlsx")
    if suffix == "xlsx":
        out = read_sheet(spark, path)
    elif suffix == "json":
        out = spark.read.json(path, multiLine=True, primitivesAsString=True)
    elif suffix == "parquet":
        out = spark.read.parquet(path)
    elif suffix == "csv":
        encoding, found, names = sniff(first_bytes(spark, path))
        out = read_csv(spark, path, names, sep or found, encoding, position)
    else:
        raise ValueError(f"unknown kind of file: {suffix}")
    words = NA_VALUES if na_values is None else na_values
    if words:
        out = out.select(*(F.when(~F.col(f"`{c}`").isin(words), F.col(f"`{c}`")).alias(c) if isinstance(out.schema[c].dataType, T.StringType) else F.col(f"`{c}`") for c in out.columns))
    return out if limit is None else out.limit(limit)


def numbered(df: DataFrame, name: str = "seq") -> DataFrame:
    """With the order of arrival, for all aggregates that depend on it; numbers have gaps."""
    return df.withColumn(name, F.monotonically_increasing_id())


class _Whole(InputPartition):
    def __init__(self, path: str):
        super().__init__(0)
        self.path = path


class XlsxSource(DataSource):
    """A sheet of a workbook (the option `sheet`, its name; else the first one), all text, by
    reading its XML. A sheet is one task, as it is one compressed stream."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(str(c), T.StringType()) for c in next(sheet_rows(self.options["path"], self.options.get("sheet")), [])])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _XlsxReader(self.options["path"], len(schema), self.options.get("sheet"))


class _XlsxReader(DataSourceReader):
    def __init__(self, path: str, width: int, sheet: str | None = None):
        self.path, self.width, self.sheet = path, width, sheet

    def partitions(self):
        return [_Whole(self.path)]

    def read(self, partition):
        rows = sheet_rows(partition.path, self.sheet)
        next(rows, None)
        for row in rows:
            yield tuple((row + [None] * self.width)[: self.width])


def _sheet_file(z: zipfile.ZipFile, sheet: str | None) -> str:
    """The part that holds the named sheet, or the first one."""
    if sheet is None:
        return min((n for n in z.namelist() if n.startswith("xl/worksheets/sheet")), key=lambda n: (len(n), n))  # sheet2 before sheet10
    links = {r.get("Id"): r.get("Target") for r in ElementTree.parse(z.open("xl/_rels/workbook.xml.rels")).iter() if r.get("Target")}
    for found in ElementTree.parse(z.open("xl/workbook.xml")).iter():
        if found.tag.endswith("}sheet") and found.get("name") == sheet:
            target = links[next(v for k, v in found.attrib.items() if k.endswith("}id"))]
            return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    raise ValueError(f"no sheet {sheet!r}")


def read_sheet(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A sheet by its name, or the first one, all text."""
    spark.dataSource.register(XlsxSource)
    reader = spark.read.format("xlsx")
    return (reader.option("sheet", sheet) if sheet else reader).load(path)


def sheet_rows(path: str, name: str | None = None) -> Iterator[list[str | None]]:
    import pyarrow.fs

    fs, at = pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if path.startswith("/") else path)
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with fs.open_input_file(at) as f, zipfile.ZipFile(f) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{ns}t")) for si in ElementTree.parse(z.open("xl/sharedStrings.xml")).iter(f"{ns}si")]
        sheet = _sheet_file(z, name)
        for _, row in ElementTree.iterparse(z.open(sheet)):
            if row.tag == f"{ns}row":
                out: list[str | None] = []
                for cell in row.iter(f"{ns}c"):
                    column = 0
                    for ch in (c for c in cell.get("r", "") if c.isalpha()):
                        column = column * 26 + ord(ch.upper()) - 64
                    out += [None] * (column - 1 - len(out)) if column else []
                    v, inline = cell.find(f"{ns}v"), cell.find(f"{ns}is")
                    text = "".join(t.text or "" for t in inline.iter(f"{ns}t")) if inline is not None else v.text if v is not None else None
                    out.append(shared[int(text)] if cell.get("t") == "s" and text is not None else text)
                yield out
                row.clear()


def _flat(df: DataFrame) -> DataFrame:
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*(F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema))


def write_csv(df: DataFrame, path: str, sep: str = ";", order: list[str] | None = None, one_file: bool = False) -> None:
    """CSV with a header; nested columns as JSON. One file only where a reader needs it."""
    out = _flat(df)
    out = out.orderBy(*order) if order else out
    (out.coalesce(1) if one_file else out).write.mode("overwrite").csv(path, sep=sep, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_text(df: DataFrame, path: str, template: str, *columns: str) -> None:
    """A line of text for each row, by a format."""
    df.select(F.format_string(template, *columns).alias("value")).write.mode("overwrite").text(path)


def metric_rows(df: DataFrame) -> DataFrame:
    """The columns of a single row as rows (metric, value)."""
    return df.select(*(F.col(c).cast("string").alias(c) for c in df.columns)).unpivot([], df.columns, "metric", "value")


def replace_table(df: DataFrame, path: str) -> None:
    """Put `df`, which may be made from the table at `path`, in that table's place: it is
    written beside it first, then the old one is moved aside, and deleted last. If a job died
    between the moves, the old table is put back (`restore_table`)."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}-new")
    new, now, old = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (f"{path}-new", path, f"{path}-old"))
    fs = now.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(now):
        fs.delete(old, True)
        if not fs.rename(now, old):
            raise OSError(f"{path} could not be moved aside")
    if not fs.rename(new, now):
        raise OSError(f"{path}-new could not take the place of {path}")
    fs.delete(old, True)
    spark.catalog.refreshByPath(path)


def restore_table(spark: SparkSession, path: str) -> None:
    """After a crash inside `replace_table`: the old table, if none has its place."""
    now, old = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}-old"))
    fs = now.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(old) and not fs.exists(now) and not fs.rename(old, now):
        raise OSError(f"{path}-old could not take its place again")


def write_spill(df: DataFrame, path: str) -> None:
    """Intermediate results, packed as small as Parquet gets."""
    df.write.mode("overwrite").option("compression", "gzip").parquet(path)


def row_json(df: DataFrame, name: str = "json") -> DataFrame:
    """Each row as a JSON text: times in ISO form, nulls left out."""
    return df.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss"}).alias(name))


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
