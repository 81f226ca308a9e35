"""Every query of the catalogue against its SQL."""

import duckdb
import pandas as pd
import pytest

import convoy.plans.catalogue_files  # noqa: F401
import convoy.plans.catalogue_functions  # noqa: F401
import convoy.plans.catalogue_more  # noqa: F401
import convoy.plans.catalogue_runs  # noqa: F401
from convoy.plans.catalogue import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return con


def rows(df: pd.DataFrame) -> list[str]:
    plain = lambda x: None if pd.isna(x) else float(x) if isinstance(x, int | float) and not isinstance(x, bool) else str(x)[:19] if hasattr(x, "year") else x
    return sorted(repr([plain(x) for x in r]) for r in df[sorted(df.columns)].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, db, small, name):
    got, want = QUERIES[name](spark, small).toPandas(), db.execute(ORACLE_SQL[name]).fetchdf()
    assert set(got.columns) == set(want.columns)
    if name == "daily_limit":
        got["day"] = pd.to_datetime(got["day"])
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_gives_rows(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
