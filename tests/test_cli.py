import json

import pytest

from convoy import cli
from convoy.plans.adapters import usage


def test_all_modes(spark, tmp_path):
    rows = "".join(f"{t};TEXT;tenho um problema {i};{'USER' if i % 2 else 'AGENT'}\n" for t in ("1", "2") for i in range(6))
    (tmp_path / "m.csv").write_text("ticket_id;category;text;sender\n" + rows)
    got = cli.run(spark, ["all", "--input-file", str(tmp_path / "m.csv"), "--output", f"{tmp_path}/out"])
    assert sorted(r["ticket_id"] for r in got.collect()) == ["1", "2"]
    assert spark.read.csv(f"{tmp_path}/out/reports/distribution", header=True, sep=";").count() == 1
    lines = (tmp_path / "out/summary/bullets/bullets.csv").read_text().splitlines()
    assert lines[0] == "nr;bullet" and len(lines) == 16 and lines[1].startswith('1;"')
    assert (tmp_path / "out/summary/summary/summary.txt").read_text().strip()
    assert spark.read.csv(f"{tmp_path}/out/final_tickets.csv", header=True, sep=";").count() == 2


def test_discover_and_classify(spark, tmp_path):
    rows = "".join(f"{t};TEXT;tenho um problema não {i};{'USER' if i % 2 else 'AGENT'}\n" for t in ("1", "2") for i in range(6))
    (tmp_path / "m.csv").write_text("ticket_id;category;text;sender\n" + rows)
    found = cli.run(spark, ["discover", "--input-file", str(tmp_path / "m.csv"), "--output", f"{tmp_path}/t"])
    text = (tmp_path / "t/taxonomy.json").read_text()
    assert text.startswith("{\n  \"") and len(json.loads(text)["categories"]) == found.selectExpr("size(categories)").first()[0] > 0
    got = cli.run(spark, ["classify", "--input-file", str(tmp_path / "m.csv"), "--taxonomy", f"{tmp_path}/t/taxonomy.json", "--output", f"{tmp_path}/c"])
    assert sorted(r["ticket_id"] for r in got.collect()) == ["1", "2"]
    saved = spark.read.csv(f"{tmp_path}/c", header=True)
    assert [r["ticket_id"] for r in saved.collect()] == ["1", "2"] and saved.first()["category_names"]
    (tmp_path / "bad.json").write_text('{"version": "1.0", "categories": []}')
    with pytest.raises(ValueError, match="no categories"):
        cli.run(spark, ["classify", "--input-file", str(tmp_path / "m.csv"), "--taxonomy", f"{tmp_path}/bad.json", "--output", f"{tmp_path}/c"])


def test_cost_and_cache(spark, small, tmp_path):
    usage(spark, small).write.parquet(f"{tmp_path}/u")
    assert cli.run(spark, ["cost", "breakdown", "--usage", f"{tmp_path}/u"]).count() == 5
    assert cli.run(spark, ["cost", "sessions", "--usage", f"{tmp_path}/u", "--session-key", "user_id"]).count() > 0
    assert cli.run(spark, ["cost", "project"]).count() == 3
    spark.sql("select 'a' as key, 'r' as result, timestamp'2020-01-01' as created_at union all select 'b', 'r', current_timestamp()").write.parquet(f"{tmp_path}/c")
    assert cli.run(spark, ["cache", "status", "--table", f"{tmp_path}/c"]).first()["keys"] == 2
    assert cli.run(spark, ["cache", "cleanup", "--table", f"{tmp_path}/c"]).count() == 1
