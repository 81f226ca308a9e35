"""Exact quantiles against the built-in percentile."""

import random

import pytest
from pyspark.sql import functions as F

from convoy.operators.quantiles import quantiles

FRACTIONS = {"a": 0.0, "b": 0.05, "c": 0.25, "d": 0.5, "e": 0.9, "f": 1.0}


@pytest.mark.parametrize("n,kinds", [(0, 1), (1, 1), (2, 2), (7, 1), (1000, 3), (1000, 1000)])
def test_quantiles(spark, n, kinds):
    rng = random.Random(n)
    rows = [(rng.choice(["x", "y", None]), rng.choice([None, *(rng.randrange(kinds) / 3 for _ in range(5))])) for _ in range(n)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    built_in = [F.percentile("v", q).alias(name) for name, q in FRACTIONS.items()]
    near = lambda rows: sorted([[x if x is None or isinstance(x, str) else round(x, 9) for x in r] for r in rows], key=str)
    assert near(quantiles(df, "v", FRACTIONS).collect()) == near(df.agg(*built_in).collect())
    want = df.filter("v is not null").groupBy("g").agg(*built_in)
    assert near(quantiles(df, "v", FRACTIONS, by=("g",)).collect()) == near(want.collect())


def test_whole_numbers_and_no_buffer_of_values(spark):
    df = spark.range(10_001).select((F.col("id") * 7919 % 10_007).alias("v"))
    out = quantiles(df, "v", {"median": 0.5})
    assert out.first()["median"] == df.agg(F.median("v")).first()[0]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "ObjectHashAggregate" not in plan
