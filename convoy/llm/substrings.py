"""Substring deduplication by a hash-compared suffix sort (operator 5).

Removes each byte covered by a string of `length` bytes that also starts in a document
with a smaller id. Anchors bring together the suffixes that can share that string; a
bucket's suffixes, dealt by the hash of their first half, are put in order by mergesort, comparing two of them by the
length of their common extension, which binary search over polynomial prefix hashes
finds in log(length) steps. Neighbours that agree over `length` bytes are compared
byte by byte before they count as equal, so no hash decides alone.

Edge cases: null text has no bytes; texts shorter than `length` lose nothing; equal
ids don't remove each other's bytes; a null id counts as less than any; a document of
any length is one step of its block; extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from .repeats import Windows, _batch, _with_left_key
from .spans import Prefix, Units, block_count, bucket_count, blob, by_bytes, by_key, in_blocks, mix, ragged, same_bytes, unblob

#: Suffixes that one sort holds at a time, unless a single group has more.
SORT_STEP = 400_000


def common_extension(prefix: Prefix, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Symbols that the suffixes at a and b have in common, up to `length`."""
    low, high = np.zeros(len(a), np.int64), np.full(len(a), length, np.int64)
    for _ in range(length.bit_length()):
        mid = (low + high + 1) >> 1
        same = prefix.of(a, mid) == prefix.of(b, mid)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def sort_suffixes(data: np.ndarray, prefix: Prefix, starts: np.ndarray, sizes: np.ndarray, length: int) -> np.ndarray:
    """The order of suffixes within groups (consecutive, of the given sizes), by their
    first `length` symbols: a bottom-up mergesort of all groups at once, in which every
    suffix finds its place in the neighbouring run by binary search."""
    perm = np.arange(len(starts))
    group = np.repeat(np.arange(len(sizes)), sizes)
    base = (np.cumsum(sizes) - sizes)[group]
    size = sizes[group]
    place = np.arange(len(starts)) - base
    width, largest = 1, int(sizes.max()) if len(sizes) else 0
    while width < largest:
        live = np.flatnonzero(size > width)
        own, n, p = base[live], size[live], place[live]
        run = p // width
        other = np.minimum((run ^ 1) * width, n)
        low, high = own + other, own + np.minimum(other + width, n)
        first, right = low.copy(), run & 1
        me = starts[perm[live]]
        todo = np.flatnonzero(low < high)
        while len(todo):
            mid = (low[todo] + high[todo]) >> 1
            them, x = starts[perm[mid]], me[todo]
            shared = common_extension(prefix, them, x, length)
            inside = shared < length
            last = np.minimum(shared, length - 1)
            before = np.where(inside, data[them + last] < data[x + last], right[todo] == 1)  # equal: left ones stay first
            low[todo] = np.where(before, mid + 1, low[todo])
            high[todo] = np.where(before, high[todo], mid)
            todo = todo[low[todo] < high[todo]]
        to = own + np.minimum(run, run ^ 1) * width + (p - run * width) + (low - first)
        moved = perm[live].copy()
        perm[to] = moved
        width *= 2
    return perm


def least_ids(units: Units, prefix: Prefix, first: np.ndarray, windows: np.ndarray, group: np.ndarray, low: np.ndarray, count: np.ndarray, length: int) -> np.ndarray:
    """For each window of each segment, the least id of a document that it starts in."""
    ends = np.cumsum(windows)
    value = np.repeat(low, windows)
    alone = np.bincount(group)[group] == 1  # one segment has this anchor: all its windows are in the same documents
    order = np.argsort(group, kind="stable")
    order = order[~alone[order]]
    total = np.cumsum(windows[order])
    k = 0
    while k < len(order):
        e = max(int(np.searchsorted(total, (total[k - 1] if k else 0) + SORT_STEP, side="right")), k + 1)
        while e < len(order) and group[order[e]] == group[order[e - 1]]:
            e += 1
        own = order[k:e]
        starts = ragged(first[own], windows[own])
        slots = ragged(ends[own] - windows[own], windows[own])
        groups = np.repeat(group[own], windows[own])
        # suffixes are dealt by the hash of their first half; what is alone there has no equal
        half = mix(prefix.of(starts, length // 2) + mix(groups.astype(np.uint64)))
        dealt, bounds = by_key(half)
        sizes = np.diff(bounds)
        dealt = dealt[np.repeat(sizes > 1, sizes)]
        starts, slots, bounds = starts[dealt], slots[dealt], np.append(0, np.cumsum(sizes[sizes > 1]))
        if not len(starts):
            k = e
            continue
        perm = sort_suffixes(units.data, prefix, starts, np.diff(bounds), length)
        a, b = starts[perm[:-1]], starts[perm[1:]]
        same = common_extension(prefix, a, b, length) == length
        same[bounds[1:-1] - 1] = False
        agree = same_bytes(units.data, a[same], b[same], np.full(int(same.sum()), length))
        if not agree.all():  # hashes misled the order of these groups: their bytes decide
            wrong = np.unique(np.searchsorted(bounds, np.flatnonzero(same)[~agree], side="right") - 1)
            for s, e in zip(bounds[wrong].tolist(), bounds[wrong + 1].tolist()):
                number = by_bytes(units.data, starts[perm[s:e]], np.full(e - s, length))
                new = np.argsort(number, kind="stable")
                perm[s:e] = perm[s:e][new]
                same[s : e - 1] = number[new][1:] == number[new][:-1]
        heads = np.flatnonzero(np.append(True, ~same))
        least = np.minimum.reduceat(value[slots[perm]], heads)
        value[slots[perm]] = np.repeat(least, np.diff(np.append(heads, len(perm))))
        k = e
    return value


def dedup_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 50, k: int = 20, with_text: bool = False, hot_places: int = repeats.HOT_PLACES) -> DataFrame:
    """Per document: id, n_bytes, n_removed, n_spans (maximal removed runs) and
    kept_sha256 of the bytes that stay (and these bytes, if asked for). Windows around an
    anchor in more than `hot_places` places are spread; the result doesn't depend on it."""
    windows = Windows(False, length, k)
    blocks = block_count(docs.select(id_col, text_col))
    texts = in_blocks(docs, blocks, id_col, text_col)
    buckets = bucket_count(docs.select(id_col, text_col), blocks, 2)

    def flag(key: tuple, table: pa.Table) -> pa.Table:
        once, more = (unblob(table.column(c), np.uint32) for c in ("once", "more"))
        again = repeats.repeated_keys(once, more)
        hot = repeats.hot_keys([*once, *more], [*(np.ones(len(a), np.uint16) for a in once), *unblob(table.column("counts"), np.uint16)], hot_places)
        rows: list[list] = [[] for _ in repeats.KEYS.split(", ")]
        for block, a, b in zip(table.column("block").to_pylist(), once, more):
            own = np.sort(np.concatenate([a[np.isin(a, again, assume_unique=True)], b]))
            if len(own):
                for column, value in zip(rows, (block, key[0].as_py(), blob(own), b"", blob(own[np.isin(own, hot)]))):
                    column.append(value)
        return _batch(repeats.KEYS, rows)

    def judge(*args):
        return least_ids(*args, length)

    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"

    def cut(key: tuple, table: pa.Table, found: pa.Table) -> pa.Table:
        rows: list[list] = [[], [], [], [], [], []]
        ids = table.column("id").to_pylist()
        for start, end, units, gone in repeats.removed_symbols(table, found, windows, buckets, lambda least, own: least < own):
            edges = np.zeros(len(gone), np.int64)
            if len(gone):
                edges[:] = gone
                edges[1:] -= gone[1:] & gone[:-1]
                heads = units.offsets[:-1][np.diff(units.offsets) > 0]
                edges[heads] = gone[heads]
            removed, spans = np.append(0, np.cumsum(gone)), np.append(0, np.cumsum(edges))
            kept = units.data[~gone].tobytes()
            stay = (units.offsets - removed[units.offsets]).tolist()
            rows[0] += ids[start:end]
            rows[1] += np.diff(units.offsets).tolist()
            rows[2] += np.diff(removed[units.offsets]).tolist()
            rows[3] += np.diff(spans[units.offsets]).tolist()
            own = [kept[a:b] for a, b in zip(stay[:-1], stay[1:])]
            rows[4] += [hashlib.sha256(x).hexdigest() for x in own]
            rows[5] += own if with_text else [None] * len(own)
        return _batch(schema, rows)

    keys = repeats.anchors(texts, windows, buckets, across_docs=True).groupBy("bucket").applyInArrow(flag, repeats.KEYS)
    found = repeats.verdicts(repeats.segments(texts, keys, windows, buckets), windows, buckets, judge)
    out = texts.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_with_left_key(cut, schema), schema)
    columns = [F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return out.select(*columns, *(["kept"] if with_text else []))
