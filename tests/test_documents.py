"""Reports of many rows, arrays that grow, and tables that are replaced."""

import json
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from convoy.sources import documents, reports, tables


def files(path, end):
    return [p for p in sorted(Path(path).glob("*")) if p.name.endswith(end) and not p.name.startswith((".", "_"))]


def test_reports_hold_every_row(spark, tmp_path):
    df = spark.range(2500).select("id", F.concat(F.lit('q" \\ '), "id").alias("text")).repartition(7).orderBy("id")
    reports.write_text_report(spark, "T", {"a": df}, f"{tmp_path}/t")
    lines = files(f"{tmp_path}/t", ".txt")[0].read_text().splitlines()
    assert len(lines) == 2502 and lines[2].startswith("id: 0 |") and lines[-1].startswith("id: 2499 |")
    reports.write_json_report(spark, {"a": df, 'b"x': df.limit(0)}, f"{tmp_path}/j")
    doc = json.loads(files(f"{tmp_path}/j", ".json")[0].read_text())
    assert [r["id"] for r in doc["a"]] == list(range(2500)) and doc["a"][3]["text"] == 'q" \\ 3' and doc['b"x'] == [] and doc["generated_at"]
    reports.sections_csv({"a": df}, f"{tmp_path}/c")
    assert len(files(f"{tmp_path}/c", ".csv")[0].read_text().splitlines()) == 2501


@pytest.mark.parametrize("n", [0, 1, 5])
def test_array_round_trip(spark, tmp_path, n):
    schema = "session_id string, total_cost_usd double, start_time double"
    df = spark.createDataFrame([(f"s{i}", i / 3, None) for i in range(n)], schema)
    path = f"file://{tmp_path}/s"
    reports.write_array(df, path)
    assert len(json.loads((tmp_path / "s/array.json").read_text())) == n
    assert sorted(reports.read_array(spark, path, schema).collect()) == sorted(df.collect())


def test_arrays_of_all_forms(spark, tmp_path):
    schema = "a long, b string"
    forms = {"lines": '{"a": 1}\n{"a": 2}\n', "array": ' [{"a": 1},\n {"a": 2, "b": "]"}]', "object": '{\n "a": 1,\n "b": "x"\n}', "empty": "[]", "nothing": ""}
    for name, text in forms.items():
        (tmp_path / f"{name}.json").write_text(text)
    got = {n: reports.read_array(spark, f"file://{tmp_path}/{n}.json", schema).count() for n in [*forms, "missing"]}
    assert got == {"lines": 2, "array": 2, "object": 1, "empty": 0, "nothing": 0, "missing": 0}


def test_writers_at_once_lose_nothing(spark, tmp_path):
    schema, path = "id long", f"file://{tmp_path}/sessions.json"
    (tmp_path / "sessions.json").write_text('[{"id": -1}, {"id": -2}]')
    append = lambda i: documents.append_array(spark.createDataFrame([(2 * i,), (2 * i + 1,)], schema), path)
    ids = lambda: sorted(r["id"] for r in documents.read_array(spark, path, schema).collect())
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(append, range(8)))
    assert ids() == [-2, -1, *range(16)]
    with pytest.MonkeyPatch.context() as patch:  # a compaction that dies
        patch.setattr(documents, "write_array", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            documents.compact_array(spark, path, schema)
    assert ids() == [-2, -1, *range(16)]
    documents.compact_array(spark, path, schema)
    assert ids() == [-2, -1, *range(16)] and not (tmp_path / "sessions.json").exists()
    append(9)
    assert ids() == [-2, -1, *range(16), 18, 19]
    documents.compact_array(spark, path, schema)
    assert ids() == [-2, -1, *range(16), 18, 19]
    assert len([n for n in documents.names_in(spark, f"{path}.log") if not n.startswith("replaced-")]) == 1


def test_replaced_tables_survive_a_crash(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.range(3).write.parquet(path)
    tables.replace_table(spark.read.parquet(path).filter("id > 0"), path)
    assert spark.read.parquet(path).count() == 2
    (tmp_path / "t").rename(tmp_path / "t-old")  # died between the moves
    tables.restore_table(spark, path)
    assert spark.read.parquet(path).count() == 2


def test_first_bytes_of_a_large_file(spark, tmp_path):
    (tmp_path / "_x.csv").write_text("no")
    with open(tmp_path / "m.csv", "wb") as f:
        f.write(b"a;b\n1;2\n")
        f.truncate(3 << 30)  # sparse: more than a binary column can hold
    assert documents.first_bytes(spark, f"file://{tmp_path}", 8) == b"a;b\n1;2\n" == documents.first_bytes(spark, f"file://{tmp_path}/*.csv", 8)
    assert documents.first_bytes(spark, f"file://{tmp_path}/none") == b""
