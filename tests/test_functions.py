import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from convoy.functions import jsonx, numbers, text
from convoy.operators import stats


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("Olá 📱 como você está?", "Ol como voc est?"),
        ("a\tb", "ab"),
        ("um *forte* abraço", "um forte abrao"),
        ("veja https://x.com/a/b agora", "veja [URL: b] agora"),
        ("lista: •[item]", "lista: [item]"),
        ("a  b \n\n c .", "a b c."),
        ("【x】", "[x]"),
        ("", ""),
        (None, None),
    ],
)
def test_clean_text(spark, raw, want):
    assert one(spark, raw, text.clean_text) == want


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="ab *[]|•…é\n.,!?【＋", max_size=30), min_size=1, max_size=20))
def test_cleaned_text_is_plain(spark, texts):
    got = spark.createDataFrame([(t,) for t in texts], "x string").select(text.clean_text(F.col("x")).alias("y")).collect()
    for r in got:
        assert r["y"].isascii() and r["y"] == r["y"].strip() and not re.search(r"\s{2}|\s[.,!?;:]", r["y"])


@pytest.mark.parametrize(
    "raw, want",
    [
        ('{"a": 1}', '{"a": 1}'),
        ('```json\n{"a": 1}\n```', '{"a": 1}'),
        ('see {"a": 1} there', '{"a": 1}'),
        ("no json", "no json"),
    ],
)
def test_extract_json(spark, raw, want):
    assert one(spark, raw, jsonx.extract_json) == want


@pytest.mark.parametrize("raw, ids, confidence", [('{"categories": [1, 2], "confidence": 0.95}', [1, 2], 0.95), ("classes 3 and 7", [3, 7], 0.7), ("invalid json", [], 0.7), (None, [], 0.0)])
def test_parse_classification(spark, raw, ids, confidence):
    got = one(spark, raw, jsonx.parse_classification)
    assert (got["categories"], got["confidence"]) == (ids, confidence)


def test_items_and_first_object(spark):
    got = one(spark, '{"cat": [{"id": "7", "cat": [" a", "b", "c", "d"]}, {"id": null, "cat": ["x"]}]}', jsonx.items_of)
    assert [(g["id"], g["cat"]) for g in got] == [("7", ["a", "b", "c"])]
    assert one(spark, 'x {bad} {"a": {"b": 1}} y', jsonx.first_object) == '{"a": {"b": 1}}'
    assert one(spark, "short", lambda c: jsonx.response_issues(c, "text")) == ["too short"]


def test_t_p_value():
    assert math.isclose(stats.t_p_value(2.0, 10), 0.07338803, abs_tol=1e-7)
    assert math.isclose(stats.t_p_value(0.5, 30), 0.62072, abs_tol=1e-4)
    assert stats.t_p_value(0.0, 5) == pytest.approx(1.0)


def test_numbers(spark):
    assert numbers.retry_delay(0) == 1.0 and numbers.retry_delay(10) == 60.0
    assert one(spark, "Rate limit reached", numbers.error_kind) == "RATE_LIMIT_EXCEEDED"
    df = spark.createDataFrame([(40.0,), (50.0,), (80.0,), (96.0,)], "p double").select(numbers.budget_status(F.col("p")).alias("s"))
    assert [r["s"] for r in df.collect()] == ["healthy", "caution", "warning", "critical"]


def test_long_responses_need_no_stack(spark):
    """Objects with long texts and with many inner objects."""
    from pyspark.sql import functions as F

    from convoy.functions import jsonx

    long = '{"a": "' + "x" * 1_000_000 + '"}'
    many = '{"l": [' + ", ".join('{"k": 1}' for _ in range(50_000)) + "]}"
    rows = spark.createDataFrame([(1, f"{{bad}} then {long} end"), (2, many), (3, "{" * 100_000), (4, "{a" + "}" * 100_000)], "id int, c string")
    got = {r["id"]: r["o"] for r in rows.select("id", jsonx.first_object(F.col("c")).alias("o")).collect()}
    assert got[1] == long and got[2] == many and got[3] is None and got[4] is None
