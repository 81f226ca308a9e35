"""User functions over chunks and batches of rows, and their merge."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import pack


def map_chunks(df: DataFrame, order: str, size: int, function: Callable[[pd.DataFrame, int], pd.DataFrame], schema: str) -> DataFrame:
    """`function(chunk, number)` over consecutive chunks of `size` rows: its rows with the
    chunk's number and a null error. A chunk that fails gives one row of nulls with its error."""
    names = [f.strip().split()[0] for f in schema.split(",")]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        number = int(key[0])
        try:
            out = function(pdf.drop(columns="batch_id").sort_values(order, kind="stable"), number).reset_index(drop=True)
            return out.assign(chunk=number, error=None)[[*names, "chunk", "error"]]
        except Exception as e:  # a chunk must not fail the job
            return pd.DataFrame([{n: None for n in names} | {"chunk": number, "error": f"{type(e).__name__}: {e}"}])

    return pack.fixed_batches(df, order, size).groupBy("batch_id").applyInPandas(run, f"{schema}, chunk long, error string")


def merge_chunks(results: DataFrame, key: str, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """`function` over all results of a key, without the failed chunks."""
    kept = results.filter("error is null").drop("error") if "error" in results.columns else results
    return kept.groupBy(key).applyInPandas(lambda pdf: function(pdf), schema)


def merge_maps(results: DataFrame, column: str) -> DataFrame:
    """Maps of all rows as one list of values by key, a row each."""
    flat = results.select(F.explode(column).alias("key", "value"))
    return flat.groupBy("key").agg(F.sort_array(F.collect_list("value")).alias("values"))


def map_tasks(df: DataFrame, function: Callable[[dict], dict], schema: str, tasks: int = 8) -> DataFrame:
    """`function(row)` over rows dealt out to tasks, with an error for each row that fails."""
    names = [f.strip().split()[0] for f in schema.split(",")]

    def one(row: dict) -> dict:
        try:
            return {n: function(row).get(n) for n in names} | {"error": None}
        except Exception as e:
            return {n: None for n in names} | {"error": f"{type(e).__name__}: {e}"}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame([one(r) for r in pdf.to_dict("records")], columns=[*names, "error"])

    return df.repartition(tasks).mapInPandas(run, f"{schema}, error string")
