"""Embedding near-duplicates: an exact metric range join over pivot cells (operator 1).

Vectors are scaled to length one, where cosine >= c means a distance of at most
r = sqrt(2 - 2c). Each vector lives in the cell of its nearest pivot. By the triangle
inequality it can only have a neighbour in cell j if its distance to pivot j is at most
the cell's radius + r and at most 2r more than the distance to its own pivot; it is a
guest in just these cells. All neighbours of a vector are then in its own cell, so cells
join independently; large cells are dealt out by slices of residents and members.

Edge cases: a vector that is null, empty, zero or has a null or non-finite component
links with nothing; vectors of different dimensions don't link, and there may be any
number of dimensions; equal vectors are joined as one with a count; a null id is never
linked; repeated rows count as vectors of their own; an empty table gives an empty
result; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release_caches, work_dir
from .components import connected_components

#: Most pivots, and what a task holds at most of residents and of members: vectors and bytes.
MOST_PIVOTS, RESIDENTS, MEMBERS, RESIDENT_BYTES, MEMBER_BYTES = 512, 16384, 32768, 32 << 20, 64 << 20
#: Slack of bounds and of the single-precision filter; the decision is in double precision.
SLACK, COARSE = 1e-7, 1e-4
_UNITS = "id long, unit binary"
_LINKS = "id long, links long, other long"


def unit_vectors(column: pa.Array) -> list[bytes | None]:
    """Vectors scaled to length one, as doubles; None for those that link with nothing."""
    out: list[bytes | None] = [None] * len(column)
    if column.offset or column.null_count:
        column = pa.array(column.to_pylist(), column.type)
    sizes = np.diff(column.offsets.to_numpy())
    valid = np.ones(len(column), bool) if not column.null_count else column.is_valid().to_numpy(zero_copy_only=False)
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)  # null components become nan
    starts = column.offsets.to_numpy()[:-1]
    for d in np.unique(sizes[valid & (sizes > 0)]).tolist():
        rows = np.flatnonzero(valid & (sizes == d))
        x = flat[starts[rows][:, None] + np.arange(d)]
        top = np.abs(x).max(axis=1)
        good = np.isfinite(top) & (top > 0)
        y = x[good] / top[good, None]
        y /= np.sqrt((y * y).sum(axis=1))[:, None]
        for r, v in zip(rows[good].tolist(), y):
            out[r] = v.tobytes()
    return out


def _pivot_distances(units: list[bytes], pivots: np.ndarray) -> np.ndarray:
    x = np.frombuffer(b"".join(units), np.float64).reshape(len(units), -1)
    return np.sqrt(np.maximum(2 - 2 * (x @ pivots.T), 0))


def _cells(distances: np.ndarray, radius: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, cell and whether the row lives there."""
    home = distances.argmin(axis=1)
    near = distances[np.arange(len(home)), home][:, None]
    member = (distances <= radius + r + SLACK) & (distances <= near + 2 * r + SLACK)
    member[np.arange(len(home)), home] = True
    row, cell = np.nonzero(member)
    return row, cell, home[row] == cell


def join_cell(home_ids, home, ids, members, counts, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each resident (weighted by counts), and a label for each resident and
    member: nodes that are connected by links found here have one label."""
    n, links = len(home_ids), np.zeros(len(home_ids), np.int64)
    names, node = np.unique(np.concatenate([home_ids, ids]), return_inverse=True)
    root = np.arange(len(names))  # a union-find over all tiles, in which every node points to its root
    h32, m32 = home.astype(np.float32), members.astype(np.float32)
    for s in range(0, n, 512):
        for t in range(0, len(ids), 4096):
            c = h32[s : s + 512] @ m32[t : t + 4096].T
            i, j = np.nonzero(c >= threshold - COARSE)
            if not len(i):
                continue
            close = np.flatnonzero(c[i, j] < threshold + COARSE)
            if len(close):
                exact = np.einsum("ij,ij->i", home[s + i[close]], members[t + j[close]])
                keep = np.ones(len(i), bool)
                keep[close] = exact >= threshold
                i, j = i[keep], j[keep]
            other = home_ids[s + i] != ids[t + j]
            i, j = s + i[other], t + j[other]
            np.add.at(links, i, counts[j])
            a, b = node[i], node[n + j]
            while len(a):  # of two roots the lesser becomes the other's
                a, b = root[a], root[b]
                apart = a != b
                a, b = a[apart], b[apart]
                np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
                while (root[root] != root).any():
                    root = root[root]
    return links, names[root][node]


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """Per vector: id, n_links, component_id and kept."""
    r = math.sqrt(2 - 2 * threshold)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches("neardup")
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(unit_vectors(b.column(1)), pa.binary())], names=["id", "unit"])

    units = materialise(rows.mapInArrow(scale, _UNITS), "units")
    usable = units.filter("id is not null and unit is not null")
    reps = materialise(usable.groupBy("unit").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "reps")
    reps = reps.withColumn("d", (F.octet_length("unit") / 8).cast("int"))
    # dimensions with vectors for two pivots or more are joined one by one, all others in one join
    sizes = reps.groupBy("d").agg(F.count("*").alias("n"))
    large = [(row["d"], row["n"]) for row in sizes.filter(F.col("n") >= 2 * _per_task(F.col("d"))).orderBy("d").collect()]
    path = work_dir(vectors.sparkSession, "links")
    few = _join_small(reps.filter(~F.col("d").isin([d for d, _ in large])), threshold)
    few.write.parquet(path)
    for d, n in large:
        _join(reps.filter(F.col("d") == d), d, n, threshold, r).write.mode("append").parquet(path)
    got = vectors.sparkSession.read.schema(few.schema).parquet(path)
    edges, links = got.select("id", "other").filter("id <> other"), got.filter("links > 0").select("id", "links")
    parts = connected_components(edges, "id", "other")
    total = links.groupBy("id").agg(F.sum("links").alias("links"))
    named = reps.join(total, reps["rep"] == total["id"], "left").drop("id").join(parts, F.col("rep") == F.col("vertex"), "left")
    named = named.select(
        F.col("unit").alias("u"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    out = units.join(named, units["unit"] == named["u"], "left")
    alone = F.col("id").isNull()
    component = F.when(alone, None).otherwise(F.coalesce("component_id", "id"))
    return out.select(
        F.col("id").alias(id_col),
        F.when(alone, 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def _per_task(d):
    """Residents that a task holds, for a column of dimensions."""
    return F.greatest(F.lit(1), F.least(F.lit(RESIDENTS), F.floor(F.lit(RESIDENT_BYTES) / (8 * d))))


def _join(reps: DataFrame, d: int, n: int, threshold: float, r: float) -> DataFrame:
    """(id, links, other): links of residents by slice; other is a node each is connected to."""
    n_residents, n_members = max(1, min(RESIDENTS, RESIDENT_BYTES // (8 * d))), max(1, min(MEMBERS, MEMBER_BYTES // (8 * d)))
    n_pivots = max(1, min(MOST_PIVOTS, n // n_residents))
    chosen = reps.select("unit").orderBy(F.xxhash64("unit")).limit(n_pivots).collect()  # a bounded number of vectors
    pivots = np.frombuffer(b"".join(bytes(p["unit"]) for p in chosen), np.float64).reshape(len(chosen), -1)

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = _pivot_distances(b.column(0).to_pylist(), pivots)
            yield pa.RecordBatch.from_arrays([pa.array(d.argmin(axis=1)), pa.array(d.min(axis=1))], names=["cell", "far"])

    radius, residents = np.full(n_pivots, -np.inf), np.zeros(n_pivots, np.int64)
    for row in reps.select("unit").mapInArrow(survey, "cell long, far double").groupBy("cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect():  # a row a pivot
        radius[row["cell"]], residents[row["cell"]] = row["far"], row["n"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, cell, _ = _cells(_pivot_distances(b.column(0).to_pylist(), pivots), radius, r)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_pivots)), pa.array(np.bincount(cell, minlength=n_pivots))], names=["cell", "n"])

    members = np.zeros(n_pivots, np.int64)
    for row in reps.select("unit").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        members[row["cell"]] = row["n"]
    a, b = np.maximum(1, -(-residents // n_residents)), np.maximum(1, -(-members // n_members))  # slices of residents and of members

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A resident goes to its slice beside all slices of members; a member the other way round."""
        release_caches("neardup")
        for batch in batches:
            row, cell, lives = _cells(_pivot_distances(batch.column(0).to_pylist(), pivots), radius, r)
            ids = batch.column(1).to_numpy()[row].astype(np.uint64)
            spread = (ids * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            for resident in (True, False):
                at = np.flatnonzero(lives) if resident else np.arange(len(row))
                own, other = (a, b) if resident else (b, a)
                times = other[cell[at]]
                rep = np.repeat(at, times)
                nth = np.arange(len(rep)) - np.repeat(np.cumsum(times) - times, times)
                mine = (spread[rep] % own[cell[rep]].astype(np.uint64)).astype(np.int64)
                x, y = (mine, nth) if resident else (nth, mine)
                for k in range(0, len(rep), 8192):
                    s = slice(k, k + 8192)
                    part = batch.take(pa.array(row[rep[s]]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cell[rep[s]]), pa.array(x[s]), pa.array(y[s]), pa.array(np.full(len(rep[s]), resident)), part.column(1), part.column(2), part.column(0)],
                        names=["cell", "x", "y", "resident", "id", "n", "unit"],
                    )

    dealt = reps.select("unit", "rep", "n").mapInArrow(deal, "cell long, x long, y long, resident boolean, id long, n long, unit binary")

    def join(table: pa.Table) -> pa.Table:
        release_caches("neardup")
        resident = table.column("resident").to_numpy()
        return _links(table, resident, ~resident, threshold)

    return dealt.groupBy("cell", "x", "y").applyInArrow(join, _LINKS)


def _join_small(reps: DataFrame, threshold: float) -> DataFrame:
    """As _join, for any number of dimensions of less than two pivots: a cell each."""

    def join(table: pa.Table) -> pa.Table:
        release_caches("neardup")
        every = np.ones(len(table), bool)
        return _links(table, every, every, threshold)

    return reps.select("d", F.col("rep").alias("id"), "n", "unit").groupBy("d").applyInArrow(join, _LINKS)


def _links(table: pa.Table, resident: np.ndarray, member: np.ndarray, threshold: float) -> pa.Table:
    """Links of a cell's residents to its members, and the label of each of them."""
    ids, n = table.column("id").to_numpy(), table.column("n").to_numpy()
    units = np.frombuffer(b"".join(table.column("unit").to_pylist()), np.float64).reshape(len(ids), -1)
    links, label = join_cell(ids[resident], units[resident], ids[member], units[member], n[member], threshold)
    nodes = np.concatenate([ids[resident], ids[member]])
    every = np.concatenate([links, np.zeros(len(nodes) - len(links), np.int64)])
    keep = (every > 0) | (label != nodes)
    return pa.table({"id": nodes[keep], "links": every[keep], "other": label[keep]})
