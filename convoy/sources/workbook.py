"""Workbooks (.xlsx) of several sheets. Rows become XML on the executors, in parallel; the file
has one writer, as a zip must: the driver's JVM streams the finished parts into it, so that
neither a table nor a sheet is ever held.

A sheet has a header and at most `MOST_ROWS` rows; numbers and booleans stay such, nested columns
are JSON, everything else is text, and nulls are empty cells. Characters that XML can't hold go.
A cell holds at most 32,767 characters, by the format: longer texts end there."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .documents import _at, names_in
from .work import remove_dir, work_dir

MOST_ROWS, MOST_CHARACTERS = 1_048_575, 32_767
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_SHEET = "application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"
_BOOK = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"


def _escaped(c: Column) -> Column:
    shown = F.regexp_replace(F.substring(c, 1, MOST_CHARACTERS), r"[\x00-\x08\x0B\x0C\x0E-\x1F￾￿]", "")
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#13;")):
        shown = F.replace(shown, F.lit(raw), F.lit(name))
    return shown


def _text(c: Column) -> Column:
    return F.concat(F.lit('<c t="inlineStr"><is><t xml:space="preserve">'), _escaped(c), F.lit("</t></is></c>"))


def _cell(field: T.StructField) -> Column:
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.BooleanType):
        cell = F.concat(F.lit('<c t="b"><v>'), c.cast("int").cast("string"), F.lit("</v></c>"))
    elif isinstance(field.dataType, T.NumericType):
        real = isinstance(field.dataType, T.DoubleType | T.FloatType)
        number = F.concat(F.lit("<c><v>"), c.cast("string"), F.lit("</v></c>"))
        cell = F.when(F.isnan(c) | (F.abs(c) == float("inf")), _text(c.cast("string"))).otherwise(number) if real else number
    elif isinstance(field.dataType, T.ArrayType | T.MapType | T.StructType):
        cell = _text(F.to_json(c))
    else:
        cell = _text(c.cast("string"))
    return F.coalesce(cell, F.lit("<c/>"))


def sheet_lines(df: DataFrame) -> DataFrame:
    """Each row as XML."""
    return df.select(F.concat(F.lit("<row>"), *map(_cell, df.schema), F.lit("</row>")).alias("value"))


def _attribute(name: str) -> str:
    return name.replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;")


def sheet_names(names: list[str]) -> list[str]:
    """Names that a workbook allows: at most 31 characters, some of them barred, all different."""
    out: list[str] = []
    for name in names:
        plain = re.sub(r"[\[\]:*?/\\]", "_", name)[:31] or "Sheet"
        n, unique = 1, plain
        while unique.lower() in {x.lower() for x in out}:
            n += 1
            unique = f"{plain[: 28 - len(str(n))]} ({n})"
        out.append(unique)
    return out


def write_workbook(sheets: dict[str, DataFrame], path: str) -> None:
    """One workbook with a sheet for each table, in their order. It takes the place of one at
    `path` once it's whole."""
    spark = next(iter(sheets.values())).sparkSession
    folder = work_dir(spark, "workbook")
    try:
        parts = []
        for n, df in enumerate(sheets.values()):
            lines = sheet_lines(df)
            lines.write.text(f"{folder}/{n}")
            if df.sparkSession.read.text(f"{folder}/{n}", lineSep="</row>\n").count() > MOST_ROWS:
                raise ValueError(f"a sheet holds at most {MOST_ROWS} rows")
            head = spark.createDataFrame([tuple(df.columns)], ", ".join(f"`c{i}` string" for i in range(len(df.columns))))
            parts.append((sheet_lines(head).first()["value"], [f"{folder}/{n}/{x}" for x in names_in(spark, f"{folder}/{n}") if x.startswith("part-")]))
        _assemble(spark, sheet_names(list(sheets)), parts, path)
    finally:
        remove_dir(spark, folder)


def _assemble(spark: SparkSession, names: list[str], parts: list[tuple[str, list[str]]], path: str) -> None:
    jvm, numbers = spark._jvm, range(1, len(names) + 1)
    fs, at = _at(spark, path)
    _, part = _at(spark, f"{path}.part")
    out = jvm.java.util.zip.ZipOutputStream(fs.create(part, True))

    def entry(name: str, before: str, files: list[str] = (), after: str = "") -> None:
        out.putNextEntry(jvm.java.util.zip.ZipEntry(name))
        out.write(before.encode())
        for file in files:
            own, where = _at(spark, file)
            stream = own.open(where)
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 16, False)
            stream.close()
        out.write(after.encode())
        out.closeEntry()

    types = "".join(f'<Override PartName="/xl/worksheets/sheet{n}.xml" ContentType="{_SHEET}"/>' for n in numbers)
    defaults = '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
    entry("[Content_Types].xml", f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types">{defaults}<Override PartName="/xl/workbook.xml" ContentType="{_BOOK}"/>{types}</Types>')
    entry("_rels/.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
    listed = "".join(f'<sheet name="{_attribute(name)}" sheetId="{n}" r:id="rId{n}"/>' for n, name in zip(numbers, names))
    entry("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets>{listed}</sheets></workbook>')
    links = "".join(f'<Relationship Id="rId{n}" Type="{_OFFICE}/worksheet" Target="worksheets/sheet{n}.xml"/>' for n in numbers)
    entry("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships">{links}</Relationships>')
    for n, (head, files) in zip(numbers, parts):
        entry(f"xl/worksheets/sheet{n}.xml", f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData>{head}\n', files, "</sheetData></worksheet>")
    out.close()
    fs.delete(at, False)
    if not fs.rename(part, at):
        raise OSError(f"{path} could not be put in its place")
