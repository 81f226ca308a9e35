"""Connected components of an edge list, by alternating large-star and small-star
steps. Every step is joins and aggregations; nothing is collected.

First, every task turns up to `TASK_EDGES` of its edges into stars around their least
vertices, which connect the same. Edges of one such task are components then; those of
several go on in rounds.

A round joins only the vertices that it changes: those between two others, and those
below which there are several. Where these are few (counted before), they're broadcast,
so that the hub of a large star is never a join key.

Edge cases: loops and repeated edges don't count, an empty list gives an empty result,
edges with a null end join nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

#: Vertices (two longs each) that a round broadcasts at most; beyond it the join shuffles.
BROADCAST_VERTICES = 1_000_000
#: Edges (two longs each) that a task makes stars of at a time.
TASK_EDGES = 500_000


def _few(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_VERTICES else df


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vertices of some edges that aren't the least of their component, and that one."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(ids))
    while len(a):
        high, low = np.maximum(root[a], root[b]), np.minimum(root[a], root[b])
        live = high != low
        a, b = a[live], b[live]
        np.minimum.at(root, high[live], low[live])
        while (root[root] != root).any():
            root = root[root]
    other = np.flatnonzero(root != np.arange(len(ids)))
    return ids[other], ids[root[other]]


def _contracted(edges: DataFrame, tasks: int, most: int) -> DataFrame:
    """Edges (u, v) that connect the same, as stars of each `most` edges of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def taken() -> pa.RecordBatch:
            u, v = (np.concatenate(x) for x in zip(*held))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x) for x in stars(u, v)], names=["u", "v"])

        for b in batches:
            if held and n + b.num_rows > most:
                yield taken()
                n = 0
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            n += b.num_rows
        if held:
            yield taken()

    return edges.coalesce(tasks).mapInArrow(run, "u long, v long")


def connected_components(edges: DataFrame, u: str, v: str, task_edges: int = TASK_EDGES) -> DataFrame:
    """(vertex, component) for each vertex with an edge to another; a component's name
    is its least vertex. The edges become stars around the least vertices in a number
    of rounds that grows with the logarithm of the components' diameter; none if one task
    holds all (`task_edges`, on which the result doesn't depend)."""
    edges = materialise(edges.select(F.greatest(u, v).cast("long").alias("u"), F.least(u, v).cast("long").alias("v")).filter("u <> v").distinct(), "edges")
    tasks = -(-edges.count() // task_edges)
    given, edges = edges, materialise(_contracted(edges, max(1, tasks), task_edges), "edges")
    discard(given)
    while tasks > 1:
        down = edges.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("most"))
        between = down.join(edges.select(F.col("v").alias("x")).distinct(), F.col("u") == F.col("x"), "left_semi").select(F.col("u").alias("x"), "m")
        between = materialise(between, "between")
        n = between.count()
        if not n and down.filter("m < most").isEmpty():
            break
        before = (edges, between)
        large = edges.join(_few(between, n), F.col("v") == F.col("x"), "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        large = materialise(large, "edges")
        discard(*before)
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("most"))
        several = materialise(least.filter("m < most").select(F.col("u").alias("x"), "m"), "several")
        small = large.join(_few(several, several.count()), F.col("u") == F.col("x")).filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialise(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(large, several)
    centres = edges.select("v").distinct()
    return edges.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(centres.select(F.col("v").alias("vertex"), F.col("v").alias("component")))
