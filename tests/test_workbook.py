"""Workbooks that are written and read again."""

import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from convoy.sources import tables, workbook


def test_sheets_read_back_equal(spark, tmp_path):
    rows = [(1, "a & <b> ]]>", 0.5, True, ["x"], None), (2, " line\nbreak\r\n ", None, False, [], "é⭐"), (-3, "", 1e300, None, None, "\x00\x0bctl"), (None, "'\"", float("nan"), True, ["<"], "t")]
    small = spark.createDataFrame(rows, "n long, text string, d double, b boolean, l array<string>, other string")
    large = spark.range(20_000).select("id", F.concat(F.lit("row "), "id").alias("text")).repartition(9).orderBy("id")
    sheets = {"small": small, "large": large, "empty": small.limit(0), "A/B:long " + "x" * 40: large.limit(3), "SMALL": small.select("n")}
    path = f"file://{tmp_path}/r.xlsx"
    workbook.write_workbook(sheets, path)
    workbook.write_workbook(sheets, path)  # in the place of the first
    assert {p.name for p in tmp_path.iterdir() if not p.name.startswith(".")} == {"r.xlsx"}
    with zipfile.ZipFile(tmp_path / "r.xlsx") as z:
        assert z.testzip() is None
        names = [s.get("name") for s in ElementTree.parse(z.open("xl/workbook.xml")).iter() if s.tag.endswith("}sheet")]
    assert len({n.lower() for n in names}) == 5 and all(len(n) <= 31 for n in names) and names[:3] == ["small", "large", "empty"]
    got = [tuple(r) for r in tables.read_sheet(spark, path, "small").collect()]
    assert got[0] == ("1", "a & <b> ]]>", "0.5", "1", '["x"]', None) and got[1] == ("2", " line\nbreak\r\n ", None, "0", "[]", "é⭐")
    assert got[2][2:] == ("1.0E300", None, None, "ctl") and got[3][0] is None and got[3][2] == "NaN"
    back = tables.read_sheet(spark, path, "large")
    assert [(int(r["id"]), r["text"]) for r in back.collect()] == [(i, f"row {i}") for i in range(20_000)]
    assert tables.read_sheet(spark, path, "empty").columns == small.columns and tables.read_sheet(spark, path, "empty").count() == 0
    assert tables.read_messages(spark, path).count() == 4  # the first sheet
    with pytest.raises(Exception, match="no sheet"):
        tables.read_sheet(spark, path, "none")


def test_limits(spark, tmp_path, monkeypatch):
    workbook.write_workbook({"a": spark.range(1).select(F.repeat(F.lit("é"), 40_000).alias("t"))}, f"file://{tmp_path}/l.xlsx")
    assert len(tables.read_sheet(spark, f"file://{tmp_path}/l.xlsx").first()["t"]) == workbook.MOST_CHARACTERS
    monkeypatch.setattr(workbook, "MOST_ROWS", 5)
    workbook.write_workbook({"a": spark.range(5)}, f"file://{tmp_path}/five.xlsx")
    with pytest.raises(ValueError, match="at most 5 rows"):
        workbook.write_workbook({"a": spark.range(6)}, f"file://{tmp_path}/six.xlsx")
    assert not (tmp_path / "six.xlsx").exists()
