"""Hard-negative mining over one-dimensional distance keys (operator 13).

Components become integers, floor(scale * x), so that scores (inner products) are exact.
A vector x of norm n is augmented by sqrt(M^2 - n^2), M the greatest norm, and a query by
0: the distance of the two is then sqrt(|q|^2 + M^2 - 2 score), so the highest scores are
the nearest vectors. Each augmented vector belongs to its nearest pivot, and the index stores
the vectors sorted by (pivot, distance to it), in blocks of consecutive keys.

A search looks for the k best vectors of each query between two scores. A vector at a
distance of at most r from the query, whose pivot is D away, has its key between D - r and
D + r; one beyond an inner radius, at least that radius less D. In rounds, each query
scans the blocks of these key intervals that it hasn't scanned, and ends when its k-th best
lies within r or r has reached the lowest score, as no vector beyond could be among its
k. Otherwise r grows to the distance of the k-th best, or doubles. Queries go in groups of
neighbours, and groups meet blocks in tiles of bounded size; what a tile finds better
than the k-th best so far goes to a window over (query, score).

Edge cases: rows with a null id or label, a null or empty vector, a null or non-finite
component, or scores that could exceed a long (squared norms of 2^62 and more) take no part;
vectors of different lengths have no score with each other; ties go to the lesser id; rows
with one id are vectors of their own, and an anchor is not its own positive but another
row of its id may be; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import discard, materialise, release_caches

#: Pivots at most, vectors for a pivot at least, and what blocks, groups of queries and tiles hold.
MOST_PIVOTS, PER_PIVOT, PIVOT_BYTES, BLOCK, GROUP, BLOCK_BYTES, TILE = 512, 2048, 64 << 20, 4096, 1024, 4 << 20, 8
#: Queries scored at a time; squared norms below EXACT are exact in doubles, with a block's place beside.
STEP, EXACT, MOST_NORM = 256, 1 << 40, 1 << 62
#: What rounding may add to a distance, as a part of it, and a score below all.
SLACK, NONE = 1e-6, -(1 << 62) - 1
_VECTORS = "id long, row long, label long, d int, norm long, codes binary"
_BLOCKS = "block long, d int, pivot int, near double, far double, ids binary, rows binary, labels binary, codes binary"
_GROUPS = (
    "grp long, d int, names binary, selfs binary, labels binary, low binary, high binary, kth binary, codes binary, "
    "intervals array<struct<pivot:int,from:double,to:double,was_from:double,was_to:double>>"
)
_FOUND = "query long, id long, row long, score long"


def integer_vectors(column: pa.Array, scale: int) -> tuple[list[bytes | None], list[int]]:
    """Integer components as int64 bytes, None for vectors that take no part, and squared norms."""
    out, norms = [], []
    for v in column.to_pylist():
        code, norm = None, 0
        if v and not any(x is None for x in v):
            with np.errstate(all="ignore"):  # what overflows takes no part
                x = np.floor(np.asarray(v, np.float64) * scale)
                size = float((x * x).sum())
            if size < 2.0 * MOST_NORM:
                whole = x.astype(np.int64)
                norm = int((whole * whole).sum()) if size < 2.0**52 else sum(c * c for c in whole.tolist())
                code = whole.tobytes() if norm < MOST_NORM else None
        out.append(code)
        norms.append(norm if code is not None else 0)
    return out, norms


def _pack(x: np.ndarray) -> bytes:
    """In the least of 2, 4 and 8 bytes a component."""
    most = int(np.abs(x).max(initial=0))
    return x.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64).tobytes()


def _unpack(data: bytes, n: int) -> np.ndarray:
    """Rows of components; their number of bytes is told by `d` beside them."""
    return np.frombuffer(data, np.uint8).reshape(n, -1)


def _rows(data: bytes, n: int, d: int) -> np.ndarray:
    raw = _unpack(data, n)
    return raw.view({2: np.int16, 4: np.int32, 8: np.int64}[raw.shape[1] // d])


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * (x @ pivots.T), 0))


def augmented(x: np.ndarray, rest: np.ndarray | float) -> np.ndarray:
    """The vectors as doubles with one more component."""
    return np.concatenate([x.astype(np.float64), np.broadcast_to(np.sqrt(np.maximum(rest, 0)), len(x))[:, None]], axis=1)


def best_of(score: np.ndarray, k: int, exact: bool) -> np.ndarray:
    """Columns of the k greatest scores of each row, the first of equal ones."""
    n = score.shape[1]
    if n <= k:
        return np.broadcast_to(np.arange(n), score.shape)
    if not exact:
        return np.lexsort((np.broadcast_to(np.arange(n), score.shape), -score))[:, :k]
    return np.argpartition(np.maximum(score, -EXACT) * n + np.arange(n - 1, -1, -1), n - k, axis=1)[:, n - k :]


class Index:
    """Blocks sorted by (pivot, distance), and the pivots: for each vector length,
    what a bounded sample of the vectors has of it, else the origin."""

    def __init__(self, vectors: DataFrame, most_pivots: int = MOST_PIVOTS, per_pivot: int = PER_PIVOT, block: int = BLOCK, group: int = GROUP):
        """`vectors` is a table that gives the same rows whenever it's read."""
        stats = vectors.agg(F.max("norm").alias("norm"), F.count("*").alias("n"), F.max("d").alias("d")).first()
        most_pivots = max(1, min(most_pivots, stats["n"] // per_pivot, PIVOT_BYTES // (8 * (stats["d"] or 1))))
        self.norm, self.group, self.pivots = int(stats["norm"] or 0), group, {}
        chosen = vectors.select("d", "norm", "codes").orderBy(F.xxhash64("codes"), "codes").limit(most_pivots).collect()  # bounded in number and bytes
        for d in {p["d"] for p in chosen}:
            own = [p for p in chosen if p["d"] == d]
            x = np.frombuffer(b"".join(bytes(p["codes"]) for p in own), np.int64).reshape(len(own), d)
            x = augmented(x, float(self.norm) - np.array([p["norm"] for p in own], np.float64))
            self.pivots[d] = np.unique(x, axis=0)
        pivots, most = self.pivots, float(self.norm)

        def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            release_caches("negatives")
            for b in batches:
                pivot, key = np.zeros(len(b), np.int32), np.zeros(len(b))
                for d, at, x in _by_length(b):
                    far = distances(augmented(x, most - b.column("norm").to_numpy()[at].astype(np.float64)), pivots_of(pivots, d))
                    pivot[at] = far.argmin(axis=1)
                    key[at] = far[np.arange(len(at)), pivot[at]]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pivot), pa.array(key)], names=[*b.schema.names, "pivot", "key"])

        keyed = materialise(vectors.mapInArrow(keys, f"{_VECTORS}, pivot int, key double"), "keys")
        order = ("d", "pivot", "key", "id", "row")
        ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
        self.blocks = materialise(ranged.mapInArrow(lambda batches: _blocks(batches, block), _BLOCKS), "blocks")
        discard(keyed)

    def top(self, queries: DataFrame, k: int, same_label: bool) -> DataFrame:
        """(query, id, row, score, rank): the k best vectors of each query's own label, or of
        others. A query has query (a number of its own), self (the row that it is, which
        doesn't count), label, d, norm, codes, and low and high: the scores it asks for."""
        pending, best, ended, norm = self._placed(queries), None, [], self.norm
        held = [pending]  # the tables of the round before
        while not pending.isEmpty():
            groups = materialise(self._groups(pending), "groups")
            spans = groups.select("grp", "d", F.inline("intervals"))
            near = spans.join(self.blocks.select("block", "d", "pivot", "near", "far"), ["d", "pivot"]).filter("far >= from and near <= to and not (far >= was_from and near <= was_to)")
            x, y = F.shiftright("block", TILE.bit_length() - 1), F.shiftright("grp", TILE.bit_length() - 1)
            tiles = materialise(near.groupBy(x.alias("x"), y.alias("y"), "grp").agg(F.collect_list("block").alias("wanted")), "tiles")  # TILE blocks at most
            asking = tiles.join(groups.drop("intervals"), "grp")
            asked = tiles.select(F.col("x").alias("bx"), F.col("y").alias("by"), F.explode("wanted").alias("block")).distinct().join(self.blocks.drop("near", "far", "pivot"), "block")

            def scan(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
                release_caches("negatives")
                return _scan(left, right, k, same_label, norm)

            found = asking.groupBy("x", "y").cogroup(asked.groupBy("bx", "by")).applyInArrow(scan, _FOUND)
            rank = F.dense_rank().over(W.partitionBy("query").orderBy(F.desc("score"), "id", "row"))  # what is found again has the same rank
            every = found.unionByName(best.drop("rank")) if best is not None else found
            best = materialise(every.withColumn("rank", rank).filter(F.col("rank") <= k).dropDuplicates(["query", "rank"]), "best")
            kth = best.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("least"))
            state = pending.drop("kth").join(kth, "query", "left").withColumn("full", F.coalesce(F.col("n") >= k, F.lit(False)))
            reach = F.when(F.col("full"), self._distance("least"))  # no vector beyond it is among the best
            state = state.withColumn("ends", (F.col("radius") >= F.col("outer")) | F.coalesce(reach <= F.col("radius"), F.lit(False)))
            state = materialise(state.withColumn("was", F.col("radius")).withColumn("radius", F.least("outer", F.coalesce(reach, self._wider()))), "queries")
            ended.append(materialise(best.join(state.filter("ends").select("query"), "query", "left_semi"), "ended"))
            pending = state.filter("not ends").withColumn("kth", F.when(F.col("full"), F.col("least"))).drop("n", "least", "full", "ends")
            discard(groups, tiles, *held)
            held, best = [state, best], best.join(pending.select("query"), "query", "left_semi")
        discard(*held)
        none = queries.sparkSession.createDataFrame([], f"{_FOUND}, rank int")
        return functools.reduce(DataFrame.unionByName, ended, none)

    def _distance(self, score: str) -> Column:
        """Distance of a query from vectors of this score."""
        square = F.col("norm").cast("double") + F.lit(float(self.norm)) - 2 * F.col(score).cast("double")
        return F.sqrt(F.when(square > 0, square).when(square.isNotNull(), 0.0))

    def _wider(self) -> Column:
        """Twice as far from where the search began, by a sixteenth of the way at least."""
        return F.col("radius") + F.greatest(F.col("radius") - F.col("inner"), (F.col("outer") - F.col("inner")) / 16)

    def _placed(self, queries: DataFrame) -> DataFrame:
        """Queries with their nearest pivot and how far from it they are, between which
        distances they search and how far at first: to the second pivot, as a part of
        one vector in so many lies within it, or an eighth of the way."""
        pivots = self.pivots

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            release_caches("negatives")
            for b in batches:
                pivot, key, second = np.zeros(len(b), np.int32), np.zeros(len(b)), np.zeros(len(b))
                for d, at, x in _by_length(b):
                    far = distances(augmented(x, 0.0), pivots_of(pivots, d))
                    pivot[at], far = far.argmin(axis=1), np.sort(far, axis=1)
                    key[at], second[at] = far[:, 0], far[:, min(1, far.shape[1] - 1)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pivot), pa.array(key), pa.array(second)], names=[*b.schema.names, "pivot", "key", "second"])

        columns = "query long, self long, label long, d int, norm long, codes binary, low long, high long"
        rows = queries.select([c.split()[0] for c in columns.split(", ")]).mapInArrow(place, f"{columns}, pivot int, key double, second double")
        farthest = F.sqrt(F.col("norm").cast("double")) + F.lit(math.sqrt(self.norm))
        rows = rows.withColumn("inner", F.coalesce(self._distance("high"), F.lit(0.0))).withColumn("outer", F.coalesce(self._distance("low"), farthest * (1 + SLACK)))
        first = F.when(F.col("high").isNull(), F.col("second")).otherwise(F.col("inner") + (F.col("outer") - F.col("inner")) / 8)
        rows = rows.withColumn("radius", F.least("outer", first)).withColumn("was", F.lit(-1.0)).withColumn("kth", F.lit(None).cast("long"))
        return materialise(rows.drop("second"), "queries")

    def _groups(self, pending: DataFrame) -> DataFrame:
        """Neighbouring queries with the key intervals that they ask for, by pivot."""
        pivots, most, far = self.pivots, self.group, math.sqrt(self.norm)
        order = ("d", "pivot", "key", "query")
        ranged = pending.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            release_caches("negatives")
            for number, d, t in _chunks(batches, most, ("d",)):
                codes = np.frombuffer(b"".join(t.column("codes").to_pylist()), np.int64).reshape(len(t), d)
                away, col = distances(augmented(codes, 0.0), pivots_of(pivots, d)), lambda c: t.column(c).to_numpy()[:, None]  # noqa: B023
                slack = SLACK * (away.max() + far)
                was = col("was")
                begin, end = np.maximum(away - col("radius"), col("inner") - away) - slack, away + col("radius") + slack
                was_begin, was_end = np.where(was < 0, np.inf, np.maximum(away - was, col("inner") - away)), np.where(was < 0, -np.inf, away + was)
                spans = zip(begin.min(axis=0).tolist(), end.max(axis=0).tolist(), was_begin.max(axis=0).tolist(), was_end.min(axis=0).tolist())
                intervals = [{"pivot": j, "from": a, "to": b, "was_from": c, "was_to": e} for j, (a, b, c, e) in enumerate(spans)]
                limit = lambda c, none: np.array([none if v is None else v for v in t.column(c).to_pylist()], np.int64).tobytes()  # noqa: E731, B023
                values = [t.column(c).to_numpy().tobytes() for c in ("query", "self", "label")]
                row = [number, d, *values, limit("low", NONE), limit("high", MOST_NORM), limit("kth", NONE), _pack(codes), intervals]
                yield pa.RecordBatch.from_pylist([dict(zip(_GROUP_SCHEMA.names, row))], schema=_GROUP_SCHEMA)

        return ranged.mapInArrow(gather, _GROUPS)


_SPAN = pa.struct([("pivot", pa.int32()), *((c, pa.float64()) for c in ("from", "to", "was_from", "was_to"))])
_GROUP_SCHEMA = pa.schema(
    [("grp", pa.int64()), ("d", pa.int32()), *((c, pa.binary()) for c in ("names", "selfs", "labels", "low", "high", "kth", "codes")), ("intervals", pa.list_(_SPAN))]
)
_FOUND_SCHEMA = pa.schema([(c, pa.int64()) for c in ("query", "id", "row", "score")])


def pivots_of(pivots: dict[int, np.ndarray], d: int) -> np.ndarray:
    return pivots.get(d, np.zeros((1, d + 1)))


def _by_length(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, places and components of the vectors of each length."""
    sizes, codes = b.column("d").to_numpy(), b.column("codes").to_pylist()
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        yield d, at, np.frombuffer(b"".join(codes[i] for i in at.tolist()), np.int64).reshape(len(at), d)


def _chunks(batches: Iterator[pa.RecordBatch], most: int, by: tuple[str, ...]) -> Iterator[tuple[int, int, pa.Table]]:
    """Number, vector length and rows of chunks of consecutive rows that are alike in `by`,
    of at most so many rows and bytes; numbers are a partition's own, in a row."""
    held, n = None, 0
    for b in batches:
        table = pa.Table.from_batches([b])
        held = pa.concat_tables([held, table]) if held is not None else table
        while len(held):
            d = held.column("d")[0].as_py()
            same = np.ones(len(held), bool)
            for c in by:
                own = held.column(c).to_numpy()
                same &= own == own[0]
            alike = len(held) if same.all() else int(same.argmin())
            size = max(1, min(most, BLOCK_BYTES // (8 * d)))
            if alike < size and alike == len(held):
                break  # more may follow
            yield (held.column("part")[0].as_py() << 33) + n, d, held.slice(0, min(alike, size)).combine_chunks()
            held, n = held.slice(min(alike, size)), n + 1
    if held is not None and len(held):
        yield (held.column("part")[0].as_py() << 33) + n, held.column("d")[0].as_py(), held.combine_chunks()


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Consecutive keys of a pivot as one row; within it, vectors go by id."""
    release_caches("negatives")
    for number, d, t in _chunks(batches, most, ("d", "pivot")):
        keys, ids, rows = (t.column(c).to_numpy() for c in ("key", "id", "row"))
        order = np.lexsort((rows, ids))
        codes = np.frombuffer(b"".join(t.column("codes").to_pylist()), np.int64).reshape(len(t), d)[order]
        values = [number, d, t.column("pivot")[0].as_py(), keys[0], keys[-1], ids[order].tobytes(), rows[order].tobytes(), t.column("label").to_numpy()[order].tobytes(), _pack(codes)]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), *[pa.binary()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(values, kinds)], names=[c.split()[0] for c in _BLOCKS.split(", ")])


def _scan(groups: pa.Table, blocks: pa.Table, k: int, same_label: bool, norm: int) -> pa.Table:
    """The k best of the wanted blocks for each query, if better than its k-th best so far."""
    exact = norm < EXACT
    kind = np.float64 if exact else np.int64
    at = {b: i for i, b in enumerate(blocks.column("block").to_pylist())}
    longs = lambda t, c, i: np.frombuffer(t.column(c)[i].as_py(), np.int64)
    out = []
    for g in range(len(groups)):
        d = groups.column("d")[g].as_py()
        names, selfs, labels, low, high, kth = (longs(groups, c, g) for c in ("names", "selfs", "labels", "low", "high", "kth"))
        x = _rows(groups.column("codes")[g].as_py(), len(names), d).astype(kind)
        top = [np.full((len(names), k), v, np.int64) for v in (NONE, 0, 0)]  # score, id, row
        for b in sorted(groups.column("wanted")[g].as_py()):
            ids, rows, own = (longs(blocks, c, at[b]) for c in ("ids", "rows", "labels"))
            v = _rows(blocks.column("codes")[at[b]].as_py(), len(ids), d).astype(kind)
            for s in range(0, len(names), STEP):
                q = slice(s, s + STEP)
                score = (x[q] @ v.T).astype(np.int64) if exact else np.einsum("ij,kj->ik", x[q], v)
                least = np.maximum(np.maximum(low[q], kth[q]), top[0][q, -1])[:, None]
                good = ((labels[q, None] == own) == same_label) & (score >= least) & (score <= high[q, None]) & (selfs[q, None] != rows)
                some = np.flatnonzero(good.any(axis=1))
                if not len(some):
                    continue
                score = np.where(good[some], score[some], NONE)
                pick = best_of(score, k, exact)
                new = [np.take_along_axis(score, pick, 1), ids[pick], rows[pick]]
                every = [np.concatenate([t[s + some], n], axis=1) for t, n in zip(top, new)]
                order = np.lexsort((every[2], every[1], -every[0]))[:, :k]
                for t, e in zip(top, every):
                    t[s + some] = np.take_along_axis(e, order, 1)
        i, j = np.nonzero(top[0] > NONE)
        out.append([names[i], top[1][i, j], top[2][i, j], top[0][i, j]])
    columns = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64)] * 4
    return pa.table([pa.array(c) for c in columns], schema=_FOUND_SCHEMA)


def vectors_of(rows: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """The rows that take part, with a number of their own, as integers; a written table."""
    kept = rows.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches("negatives")
        for b in batches:
            codes, norms = integer_vectors(b.column("v"), scale)
            size = pa.array([0 if c is None else len(c) // 8 for c in codes], pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], size, pa.array(norms, pa.int64()), pa.array(codes, pa.binary())], names=[c.split()[0] for c in _VECTORS.split(", ")])

    return materialise(kept.filter("id is not null and label is not null").mapInArrow(whole, _VECTORS).filter("codes is not null"), "vectors")


def hard_negatives(
    rows: DataFrame, anchors: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    scale: int = 256, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, **index,
) -> DataFrame:
    """For each anchor (a condition on `id`) and each of its best rows of the same label: the
    best rows of other labels whose score is between `least` and `most` per cent of the
    positive's. Columns: anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    vectors = vectors_of(rows, id_col, vector_col, label_col, scale)
    found = Index(vectors, **index)
    nothing = F.lit(None).cast("long")
    own = vectors.filter(anchors).withColumnsRenamed({"id": "anchor_id"}).withColumn("query", F.col("row")).withColumn("self", F.col("row"))
    near = found.top(own.withColumn("low", nothing).withColumn("high", nothing), positives, same_label=True)
    near = near.filter("score >= 0").select("query", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), "rank")  # a negative score has no such share
    part, rest = lambda p: F.expr(f"positive_score div 100 * {p}"), F.expr("positive_score % 100")
    pairs = materialise(own.join(near, "query").withColumn("query", F.col("query") * positives + F.col("rank") - 1).drop("rank"), "pairs")
    pairs = pairs.withColumn("low", (part(least) + F.ceil(rest * least / 100)).cast("long")).withColumn("high", (part(most) + F.floor(rest * most / 100)).cast("long"))
    far = found.top(pairs, negatives, same_label=False)
    return far.join(pairs.select("query", "anchor_id", "positive_id", "positive_score"), "query").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
