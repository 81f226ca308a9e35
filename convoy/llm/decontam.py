"""Benchmark decontamination by q-gram lemma filtering (operator 3).

Texts and benchmark items are lower-cased, and white space becomes single spaces. An
item of m characters occurs in a document if some region of it is at most
e = floor(rate * m) edits away. An item's disjoint q-grams number floor(m / q); an edit
harms one of them at most, so a region holds floor(m / q) - e of them, on diagonals
(place in the text minus place in the item) at most e apart. Diagonals are covered by
overlapping bands of 2 (e + 1); a band that reaches the count is verified by banded
alignment of the whole item, with free ends in the text.

An item of fewer than 16 characters has to begin and end where words do: not between two
letters or digits, unless one of them is of a script that's written without spaces.

Edge cases: null or empty text holds no item; null and empty items are in no document; items
with equal texts are all reported; repeated rows are reported each; a null document id
is reported as null; without items or documents the result is empty; extra columns are
not read. Items are taken in blocks of at most `block_bytes`, each block against all
documents and let go before the next, so what is broadcast stays bounded however large
the benchmark is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release_caches, steps, utf8
from .spans import ragged

LEAST = 16
TABLE_BITS = 20
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def plain(text: str) -> str:
    return " ".join(text.lower().split())


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


#: Scripts without spaces between words: Thai to Myanmar, Khmer, and from CJK radicals on.
_UNSPACED = ((0x0E00, 0x109F), (0x1780, 0x17FF), (0x2E80, 0xFFFF), (0x1B000, 0x1B16F), (0x20000, 0x3FFFF))


def word_edges(points: np.ndarray) -> np.ndarray:
    """For each place before, between and after the characters, whether a word may begin or end there."""
    distinct, at = np.unique(points, return_inverse=True)
    letter = np.array([chr(c).isalnum() and not any(a <= c <= b for a, b in _UNSPACED) for c in distinct.tolist()], bool)[at]
    edges = np.ones(len(points) + 1, bool)
    edges[1:-1] = ~(letter[1:] & letter[:-1])
    return edges


def _grams(points: np.ndarray, q: int) -> np.ndarray:
    """Each place's q characters, a byte each; equal characters have equal bytes."""
    folded = (points ^ (points >> np.uint32(8)) ^ (points >> np.uint32(16))).astype(np.uint8)
    padded = np.concatenate([folded, np.zeros(8, np.uint8)])
    out = np.ndarray((len(points),), "<u8", padded.tobytes(), strides=(1,))
    return out & np.uint64((1 << (8 * q)) - 1) if q < 8 else out.copy()


@dataclass
class Index:
    """Disjoint q-grams of items: for each distinct one, where it is."""

    q: int
    grams: np.ndarray  # sorted, distinct
    starts: np.ndarray  # into item and offset
    item: np.ndarray
    offset: np.ndarray
    table: np.ndarray  # whether a gram with this hash exists

    @staticmethod
    def of(items: list[np.ndarray], numbers: list[int], q: int) -> Index:
        gram, item, offset = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for number in numbers:
            at = np.arange(0, len(items[number]) - q + 1, q)
            gram.append(_grams(items[number], q)[at])
            item.append(np.full(len(at), number))
            offset.append(at)
        gram, item, offset = np.concatenate(gram), np.concatenate(item), np.concatenate(offset)
        order = np.argsort(gram, kind="stable")
        grams, starts = np.unique(gram[order], return_index=True)
        table = np.zeros(1 << TABLE_BITS, bool)
        table[(grams * _MULTIPLY) >> np.uint64(64 - TABLE_BITS)] = True
        return Index(q, grams, np.append(starts, len(gram)), item[order], offset[order], table)

    def hits(self, points: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Place in the text, item and place in the item of all shared q-grams; about
        `most` at a time, as a repetitive text meets a repetitive item everywhere."""
        gram = _grams(points, self.q)
        place = np.flatnonzero(self.table[(gram * _MULTIPLY) >> np.uint64(64 - TABLE_BITS)])
        gram = gram[place]
        at = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        same = self.grams[at] == gram
        place, at = place[same], at[same]
        n = self.starts[at + 1] - self.starts[at]
        total = np.cumsum(n)
        k = 0
        while k < len(place):
            e = max(k + 1, int(np.searchsorted(total, (total[k - 1] if k else 0) + most, side="right")))
            inner = ragged(self.starts[at[k:e]], n[k:e])
            yield np.repeat(place[k:e], n[k:e]), self.item[inner], self.offset[inner]
            k = e


def banded_distance(item: np.ndarray, text: np.ndarray, low: np.ndarray, width: int, first: np.ndarray, end: np.ndarray, edges: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Least edits between the item and a region of each document whose diagonals are in
    [low, low + width), and where that region ends. first and end delimit documents; with
    edges, regions begin and end only there."""
    t = np.arange(width)
    cost = np.zeros((len(low), width), np.int32)
    cost[(low[:, None] + t < first[:, None]) | (low[:, None] + t > end[:, None])] = 1 << 20
    if edges is not None:
        cost[~edges[np.clip(low[:, None] + t, 0, len(text))]] = 1 << 20
        cost = np.minimum.accumulate(cost - t, axis=1) + t
    for i in range(1, len(item) + 1):
        at = low[:, None] + (i - 1) + t  # the text's character that the item's i-th meets
        inside = (at >= first[:, None]) & (at < end[:, None])
        meets = text[np.clip(at, 0, len(text) - 1)] == item[i - 1]
        step = np.where(inside, cost + ~meets, 1 << 20)
        step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)  # the item's character is missing in the text
        cost = np.minimum.accumulate(step - t, axis=1) + t  # characters of the text that the item lacks
    if edges is not None:
        cost[~edges[np.clip(low[:, None] + len(item) + t, 0, len(text))]] = 1 << 20
    best = cost.argmin(axis=1)
    return cost[np.arange(len(low)), best], low + best + len(item)


class Matcher:
    """Finds items in texts."""

    def __init__(self, texts: list[str], rate: float):
        self.items = [code_points(t) for t in texts]
        self.edits = [int(rate * len(x) + 1e-9) for x in self.items]
        by_q: dict[tuple[int, bool], list[int]] = {}
        for n, t in enumerate(texts):
            if 0 < len(t) < LEAST:  # the longest grams of which a region holds one
                q = next((q for q in (4, 3, 2) if len(t) // q > self.edits[n]), 1)
                by_q.setdefault((q, True), []).append(n)
            elif t:
                by_q.setdefault((8 if len(t) // 8 - self.edits[n] >= 2 else 4, False), []).append(n)
        self.indexes = [(Index.of(self.items, own, q), short) for (q, short), own in by_q.items()]
        self.need = {q: np.array([max(1, len(x) // q - e) for x, e in zip(self.items, self.edits)]) for q, _ in by_q}

    def __call__(self, texts: list[str]) -> list[tuple[int, int, int, int]]:
        """(text, item, edits, end of the region) of each pair that matches."""
        out = []
        points = code_points("\n".join(texts) + "\n")
        offsets = np.append(0, np.cumsum([len(t) + 1 for t in texts]))
        edits, lengths = np.array(self.edits, np.int64), np.array([len(x) for x in self.items], np.int64)
        edges = word_edges(points) if any(short for _, short in self.indexes) else None
        for index, short in self.indexes:
            keys = np.empty((4, 0), np.int64)
            for place, item, offset in index.hits(points):
                if short:  # where nothing may be edited, both ends are known
                    start = place - offset
                    end = start + lengths[item]
                    inside = (start >= 0) & (end <= len(points))
                    good = (edits[item] > 0) | (inside & edges[np.where(inside, start, 0)] & edges[np.where(inside, end, 0)])
                    place, item, offset = place[good], item[good], offset[good]
                row = np.searchsorted(offsets, place, side="right") - 1
                band = (place - offset) // (edits[item] + 1)
                keys = np.concatenate([keys, *(np.stack([row, item, b, offset]) for b in (band, band - 1))], axis=1)
                keys = keys[:, np.lexsort(keys[::-1])]
                fresh = np.ones(keys.shape[1], bool)
                fresh[1:] = (keys[:, 1:] != keys[:, :-1]).any(axis=0)
                keys = keys[:, fresh]
            row, item, band, _ = keys
            heads = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1])]) if len(row) else np.empty(0, np.int64)
            count = np.diff(np.append(heads, len(row)))
            row, item, band = row[heads], item[heads], band[heads]
            good = count >= self.need[index.q][item]
            row, item, band = row[good], item[good], band[good]
            best: dict[tuple[int, int], tuple[int, int]] = {}
            for n in np.unique(item).tolist():
                own, e = np.flatnonzero(item == n), self.edits[n]
                for k in range(0, len(own), 256):
                    part = own[k : k + 256]
                    low = band[part] * (e + 1) - e
                    distance, end = banded_distance(self.items[n], points, low, 2 * (e + 1) + 2 * e, offsets[row[part]], offsets[row[part] + 1] - 1, edges if short else None)
                    for r, d, at in zip(row[part].tolist(), distance.tolist(), end.tolist()):
                        if d <= e:
                            best[r, n] = min(best.get((r, n), (d, at)), (d, at))
            out += [(r, n, d, int(at - offsets[r])) for (r, n), (d, at) in best.items()]
        return out


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    rate: float = 0.1,
    block_bytes: int = 4 << 20,
) -> DataFrame:
    """Per document and item that occurs in it: id, item, edits, and the end of the region
    in characters of the plain text. A narrow map over the documents, once a block of items."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("text")).filter("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    kind = docs.schema[id_col].dataType.simpleString()
    chosen = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    schema = f"`{id_col}` {kind}, `{item_col}` long, edits long, region_end long"
    out = None
    for b in range(blocks):
        got = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).collect()  # block_bytes, give or take
        shared = docs.sparkSession.sparkContext.broadcast(([r["item"] for r in got], [plain(r["text"]) for r in got]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            release_caches("decontam")
            names, texts = shared.value
            find = Matcher(texts, rate)
            for batch in batches:
                _, offsets = utf8(batch.column(1))
                for s, e in steps(offsets, 1 << 20):
                    part = batch.slice(s, e - s)
                    found = find([plain(t or "") for t in part.column(1).to_pylist()])
                    rows, numbers, edits, ends = zip(*found) if found else ((), (), (), ())
                    columns = [part.column(0).take(pa.array(rows, pa.int64()))]
                    columns += [pa.array(x, pa.int64()) for x in ([names[n] for n in numbers], edits, ends)]
                    yield pa.RecordBatch.from_arrays(columns, names=[id_col, item_col, "edits", "region_end"])

        found = chosen.mapInArrow(run, schema)
        if blocks > 1:  # a block's items are let go before the next comes
            found = materialise(found, "found")
            shared.unpersist()
        out = found if out is None else out.unionByName(found)
    return out
