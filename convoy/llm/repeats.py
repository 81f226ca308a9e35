"""The passes that operators on repeated windows share.

1. `anchors`: each block of documents sends, for every bucket of anchors, the keys it
   holds, once each (4 bytes a key). An operator finds the keys that repeat.
2. `segments`: each block sends the segments of its runs with repeating keys, each
   distinct segment once, with its least and greatest id and its count.
   Of a hot key (in more than `HOT_PLACES` places) the windows are sent instead, each by its own
   hash and once a block, so that neither a hot anchor nor a hot window with ever different
   neighbours gathers in a task.
3. An operator judges the windows of a bucket's segments.
4. `verdicts` come back by block, where runs find them by their segment's hash.

A passage that a third of all documents share is sent once a block, so that no task
receives more than a row for each block of it. Blocks recompute their runs in each
pass; the text moves once, as Spark reuses the exchange.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import release_caches, steps
from .spans import (
    Prefix,
    Runs,
    Units,
    blob,
    bucket_of,
    by_key,
    byte_units,
    contains,
    digests,
    equal_groups,
    ids_of,
    known_keys,
    mix,
    ragged,
    runs_of,
    segment_hashes,
    squeeze,
    texts_of,
    unblob,
    unsqueeze,
    word_units,
)

#: Places of an anchor beyond which the windows around it are sent one by one, over all buckets.
HOT_PLACES = 200_000
#: Bytes of text or of segments that a step holds: hashes, orders and minima take many times as much.
STEP_BYTES = 1 << 19
ANCHORS = "bucket long, block long, once binary, more binary, counts binary"
KEYS = "block long, bucket long, keys binary, counts binary, hot binary"
SEGMENTS = "bucket long, block long, hash binary, anchor binary, low binary, high binary, count binary, windows binary, hot binary, sizes binary, data binary"
VERDICTS = "block long, hash binary, parts binary, sizes binary, values binary, hot binary"


def _batch(schema: str, columns: list[list]) -> pa.Table:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [(n, kinds[t]) for n, t in (f.split() for f in schema.split(", "))]
    return pa.table([pa.array(c, t) for c, (_, t) in zip(columns, fields)], schema=pa.schema(fields))


@dataclass(frozen=True)
class Windows:
    """What windows are made of: `length` symbols, `k` symbols in an anchor."""

    words: bool
    length: int
    k: int

    def units(self, data: np.ndarray, offsets: np.ndarray) -> Units:
        return (word_units if self.words else byte_units)(data, offsets)

    def hashes(self, runs: Runs, prefix: Prefix) -> np.ndarray:
        """A hash for the segment of each run."""
        return segment_hashes(runs, prefix, self.length)

    def scan(self, table: pa.Table) -> Iterator[tuple[int, int, Units, Prefix, Runs]]:
        """Steps through the texts of a block: first and last row, units, hashes and runs."""
        data, offsets = texts_of(table)
        for start, end in steps(offsets, STEP_BYTES):
            units = self.units(data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start])
            prefix = Prefix(units.codes)
            yield start, end, units, prefix, runs_of(units, prefix, self.length, self.k)


def anchors(texts: DataFrame, windows: Windows, buckets: int, across_docs: bool) -> DataFrame:
    """Keys of each block by bucket: those it holds once and those it holds more often
    (in more than one document if `across_docs`, else at more than one place)."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        release_caches("repeats")
        found, docs = [], []
        for start, _, _, _, runs in windows.scan(table):
            anchor, doc = runs.anchors_at
            found.append(anchor)
            docs.append(doc + start)
        anchor = np.concatenate(found) if found else np.empty(0, np.uint64)
        doc = np.concatenate(docs) if docs else np.empty(0, np.int64)
        order, starts = by_key(anchor)
        doc = doc[order]
        first = starts[:-1]
        if across_docs:  # documents ascend within an anchor, as the order is stable
            more = doc[starts[1:] - 1] != doc[first]
        else:
            more = np.diff(starts) > 1
        anchor, places = anchor[order][first], np.diff(starts)
        bucket, keys = bucket_of(anchor, buckets)
        order, starts = by_key(bucket)
        rows: list[list] = [[], [], [], [], []]
        for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
            own = order[s:e]
            often, which = np.unique(keys[own[more[own]]], return_inverse=True)
            count = np.bincount(which.ravel(), weights=places[own[more[own]]], minlength=len(often))
            values = (int(bucket[own[0]]), key[0].as_py(), blob(np.unique(keys[own[~more[own]]])), blob(often), blob(np.minimum(count, 65535).astype(np.uint16)))
            for column, value in zip(rows, values):
                column.append(value)
        return _batch(ANCHORS, rows)

    return texts.groupBy("block").applyInArrow(run, ANCHORS)


def repeated_keys(once: list[np.ndarray], more: list[np.ndarray]) -> np.ndarray:
    """Sorted keys that one block holds more often, or two blocks hold."""
    every = np.sort(np.concatenate([np.concatenate([a, b]) for a, b in zip(once, more)]))
    twice = every[1:][every[1:] == every[:-1]]
    return np.unique(np.concatenate([twice, *more]))


def hot_keys(keys: list[np.ndarray], counts: list[np.ndarray], most: int) -> np.ndarray:
    """Sorted keys with more places than `most`; counts beside the keys."""
    every, which = np.unique(np.concatenate(keys), return_inverse=True)
    return every[np.bincount(which.ravel(), weights=np.concatenate(counts), minlength=len(every)) > most]


def _window_by_window(runs: Runs, whole: np.ndarray, apart: np.ndarray) -> Runs:
    """The runs `whole`, then each window of the runs `apart` as a run of its own."""
    n = runs.windows[apart]
    return Runs(
        np.concatenate([runs.anchor[whole], np.repeat(runs.anchor[apart], n)]), np.concatenate([runs.start[whole], ragged(runs.start[apart], n)]),
        np.concatenate([runs.windows[whole], np.ones(int(n.sum()), np.int64)]), np.concatenate([runs.doc[whole], np.repeat(runs.doc[apart], n)]), runs.anchors_at,
    )


def segments(texts: DataFrame, keys: DataFrame, windows: Windows, buckets: int) -> DataFrame:
    """Distinct segments of each block's runs with repeating keys, by bucket."""

    def run(key: tuple, table: pa.Table, known: pa.Table) -> pa.Table:
        release_caches("repeats")
        rows: list[list] = [[] for _ in SEGMENTS.split(", ")]
        wanted, hot, ids, parts = known_keys(known), known_keys(known, "hot"), ids_of(table), []
        if not len(wanted):
            return _batch(SEGMENTS, rows)
        for start, _, units, prefix, runs in windows.scan(table):
            bucket, own = bucket_of(runs.anchor, buckets)
            code = bucket << 32 | own.astype(np.int64)
            sent, apart = contains(wanted, code), contains(hot, code)
            whole = np.flatnonzero(sent & ~apart)
            kept = _window_by_window(runs, whole, np.flatnonzero(sent & apart))
            hashes = windows.hashes(kept, prefix)
            to = np.append(bucket[whole], ((mix(hashes[len(whole) :]) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64))
            first, size = units.stretch(kept.start, kept.windows + windows.length - 1)
            own_ids = ids[kept.doc + start]
            one = _distinct(hashes, units.data, first, size, own_ids, own_ids, np.ones(len(own_ids), np.int64))
            rep = one.pop("rep")
            one.pop("which")
            parts.append(one | {"anchor": kept.anchor[rep], "windows": kept.windows[rep], "bucket": to[rep], "sizes": size[rep], "data": units.data[ragged(first[rep], size[rep])]})
        got = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]} if parts else None
        parts.clear()
        if got is None or not len(got["hash"]):
            return _batch(SEGMENTS, rows)
        first = np.cumsum(got["sizes"]) - got["sizes"]
        one = _distinct(got["hash"], got["data"], first, got["sizes"], got["low"], got["high"], got["count"])
        rep = one.pop("rep")
        one.pop("which")
        one |= {c: got[c][rep] for c in ("anchor", "windows", "bucket", "sizes")}
        first = first[rep]
        order, starts = by_key(one["bucket"])
        for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
            own = order[s:e]
            data = got["data"][ragged(first[own], one["sizes"][own])]
            values = [int(one["bucket"][own[0]]), key[0].as_py()]
            values += [blob(one[c][own]) for c in ("hash", "anchor", "low", "high", "count", "windows")]
            for column, value in zip(rows, [*values, blob(hot) if not s else b"", blob(one["sizes"][own]), squeeze(data)]):  # the block gets its hot keys back
                column.append(value)
        return _batch(SEGMENTS, rows)

    return texts.groupBy("block").cogroup(keys.groupBy("block")).applyInArrow(_with_left_key(run, SEGMENTS), SEGMENTS)


def _with_left_key(run: Callable, schema: str) -> Callable:
    """Blocks without texts give nothing; columns but the key's stay."""

    def call(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return run(key, left, right) if left.num_rows else _batch(schema, [[] for _ in schema.split(", ")])

    return call


def _distinct(hashes, data, first, sizes, low, high, count) -> dict[str, np.ndarray]:
    """One of each segment, told apart by hash and bytes: hash, rep (its place), least
    low, greatest high and total count; `which` has the number of each place's."""
    order, starts, _ = equal_groups(hashes, data, first, sizes)
    begin = starts[:-1]
    which = np.empty(len(order), np.int64)
    which[order] = np.repeat(np.arange(len(begin)), np.diff(starts))
    if not len(begin):
        return {"hash": hashes, "rep": begin, "low": low, "high": high, "count": count, "which": which}
    rep = order[begin]
    return {
        "hash": hashes[rep], "rep": rep, "low": np.minimum.reduceat(low[order], begin), "high": np.maximum.reduceat(high[order], begin),
        "count": np.add.reduceat(count[order], begin), "which": which,
    }


def _anchor_steps(anchor: np.ndarray, sizes: np.ndarray, limit: int = STEP_BYTES) -> Iterator[np.ndarray]:
    """Places by anchor, in steps of at most `limit` bytes of segments, or of one anchor with more."""
    order, starts = by_key(anchor)
    for start, end in steps(np.append(0, np.cumsum(sizes[order]))[starts], limit):
        yield order[starts[start] : starts[end]]


def verdicts(sent: DataFrame, windows: Windows, buckets: int, judge: Callable) -> DataFrame:
    """Judge the windows of each bucket, some anchors at a time, so that a step holds their hashes
    and orders and not the bucket. `judge` gets the distinct segments (units, prefix, first
    symbol, windows, group by anchor, low, count) and returns a value for each window; values return to each block that sent a segment, in stretches, by its
    hash. A hash that different segments have returns without stretches, and each of these
    segments by its digest."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        release_caches("repeats")
        cols = {c: unblob(table.column(c), t) for c, t in (("hash", np.uint64), ("anchor", np.uint64), ("low", np.int64), ("high", np.int64), ("count", np.int64), ("windows", np.int64), ("sizes", np.int64))}
        rows_of = np.repeat(np.arange(table.num_rows), [len(x) for x in cols["hash"]])
        got = {c: np.concatenate(v) for c, v in cols.items()}
        data = np.concatenate(unsqueeze(table.column("data")))
        first, sizes = np.cumsum(got["sizes"]) - got["sizes"], got["sizes"]
        at, seen, found = np.empty(len(first), np.int64), 0, []
        for place in _anchor_steps(got["anchor"], sizes):  # what has one anchor is judged together, and equal segments have one
            piece, begin = data[ragged(first[place], sizes[place])], np.cumsum(sizes[place]) - sizes[place]
            one = _distinct(got["hash"][place], piece, begin, sizes[place], got["low"][place], got["high"][place], got["count"][place])
            rep = one["rep"]
            n_windows, own_sizes = got["windows"][place[rep]], sizes[place[rep]]
            piece = piece[ragged(begin[rep], own_sizes)]
            units = windows.units(piece, np.append(0, np.cumsum(own_sizes)))
            _, group = np.unique(got["anchor"][place[rep]], return_inverse=True)
            values = judge(units, Prefix(units.codes), units.offsets[:-1], n_windows, group, one["low"], one["count"])
            # stretches of windows with one value
            ends = np.cumsum(n_windows)
            new = np.ones(len(values), bool)
            new[1:] = values[1:] != values[:-1]
            new[(ends - n_windows)] = True
            begin = np.flatnonzero(new)
            at[place] = seen + one["which"]
            seen += len(rep)
            found.append((one["hash"], place[rep], np.diff(np.append(0, np.searchsorted(begin, ends))), np.diff(np.append(begin, len(values))), values[begin]))
        hashes, rep, parts, length, values = (np.concatenate(x) for x in zip(*found))
        parts_end = np.cumsum(parts)
        ordered = np.sort(hashes)
        shared = np.isin(hashes, ordered[1:][ordered[1:] == ordered[:-1]])
        name = hashes.copy()
        name[shared] = digests(data, first[rep[shared]], sizes[rep[shared]])
        blocks, hot = table.column("block").to_pylist(), table.column("hot").to_pylist()
        rows: list[list] = [[] for _ in VERDICTS.split(", ")]
        for r in range(table.num_rows):
            own = at[rows_of == r] if table.num_rows < 8 else at[np.searchsorted(rows_of, r) : np.searchsorted(rows_of, r + 1)]
            n = parts[own]
            inner = ragged(parts_end[own] - n, n)
            ask = np.unique(hashes[own[shared[own]]])
            names, counts = np.append(name[own], ask), np.append(n, np.zeros(len(ask), np.int64)).astype(np.int32)
            for column, value in zip(rows, (blocks[r], blob(names), blob(counts), blob(length[inner].astype(np.int32)), blob(values[inner]), hot[r])):
                column.append(value)
        return _batch(VERDICTS, rows)

    return sent.groupBy("bucket").applyInArrow(run, VERDICTS)


def removed_symbols(
    table: pa.Table, found: pa.Table, windows: Windows, buckets: int, removes: Callable[[np.ndarray, np.ndarray], np.ndarray]
) -> Iterator[tuple[int, int, Units, np.ndarray]]:
    """Steps through a block's texts: rows, units and which symbols go. `removes` gets
    the value of a stretch of windows and the id of the document."""
    ids = ids_of(table)
    empty = np.empty(0, np.int64)
    cat = lambda name, kind: np.concatenate([empty.astype(kind), *unblob(found.column(name), kind)])
    hashes, parts, sizes, values = cat("hash", np.uint64), cat("parts", np.int32).astype(np.int64), cat("sizes", np.int32).astype(np.int64), cat("values", np.int64)
    part_end = np.cumsum(parts)
    before = np.cumsum(sizes) - sizes
    hot = np.unique(cat("hot", np.int64))
    order = np.argsort(hashes, kind="stable")
    hashes = hashes[order]
    asked = np.unique(hashes[parts[order] == 0])
    for start, end, units, prefix, runs in windows.scan(table):
        gone = np.zeros(len(units.codes), bool)
        if len(hashes) and len(runs.start):
            if len(hot):
                bucket, key = bucket_of(runs.anchor, buckets)
                apart = contains(hot, bucket << 32 | key.astype(np.int64))
                runs = _window_by_window(runs, np.flatnonzero(~apart), np.flatnonzero(apart))
            own = windows.hashes(runs, prefix)
            ask = np.flatnonzero(np.isin(own, asked))
            if len(ask):
                own[ask] = digests(units.data, *units.stretch(runs.start[ask], runs.windows[ask] + windows.length - 1))
            low, high = np.searchsorted(hashes, own), np.searchsorted(hashes, own, side="right")
            cover = np.zeros(len(gone) + 1, np.int32)
            for k in range(int((high - low).max())):
                hit = np.flatnonzero(high - low > k)
                which = order[low[hit] + k]
                n = parts[which]
                inner = ragged(part_end[which] - n, n)
                run = np.repeat(hit, n)
                shift = before[inner] - np.repeat(before[part_end[which] - n], n)
                goes = removes(values[inner], ids[runs.doc[run] + start])
                a = (runs.start[run] + shift)[goes]
                np.add.at(cover, a, 1)
                np.add.at(cover, a + sizes[inner][goes] + windows.length - 1, -1)
            gone = np.cumsum(cover[:-1]) > 0
        yield start, end, units, gone
