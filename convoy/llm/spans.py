"""Kernels for finding windows of symbols that repeat across documents.

A window of `length` symbols (bytes or words) has as its anchor the least hash among
its symbol k-grams, so equal windows have equal anchors. Neighbouring windows mostly
share their anchor: a *run* is a stretch of windows of one document with one anchor,
and a run's symbols are its *segment*. Comparing anchors first, and segments only
where an anchor repeats, finds every repeated window while a small part of the text
moves: no window is sampled away.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table_bytes, utf8

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_CODES = np.random.default_rng(20240101).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
LONG_WORD = 64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = np.ones(1, U64)
_inverses = np.ones(1, U64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits; a bijection."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


class Prefix:
    """Polynomial prefix hashes of a symbol sequence: the hash of any stretch in O(1)."""

    def __init__(self, codes: np.ndarray):
        global _powers, _inverses
        if len(_powers) <= len(codes):
            n = len(codes) + len(codes) // 8 + 1024
            _powers, _inverses = (np.cumprod(np.concatenate([[U64(1)], np.full(n, b, U64)])) for b in (U64(_BASE), U64(_INVERSE)))
        self.sums = np.zeros(len(codes) + 1, U64)
        np.cumsum(codes * _powers[: len(codes)], out=self.sums[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * _inverses[start]

    def all(self, k: int) -> np.ndarray:
        """Hashes of all stretches of k symbols."""
        n = len(self.sums) - k
        return (self.sums[k:] - self.sums[:-k]) * _inverses[:n] if n > 0 else np.empty(0, U64)


@dataclass
class Units:
    """Symbols of some documents: `codes` hash them, `offsets` delimit documents, and
    symbol i is data[begin(i):end(i)]."""

    data: np.ndarray
    codes: np.ndarray
    offsets: np.ndarray
    begins: np.ndarray | None  # None: each byte is a symbol
    ends: np.ndarray | None

    def stretch(self, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte and number of bytes of stretches of symbols."""
        if self.begins is None:
            return start, length
        first = self.begins[start]
        return first, self.ends[start + length - 1] - first


def byte_units(data: np.ndarray, offsets: np.ndarray) -> Units:
    return Units(data, _CODES[data], offsets, None, None)


def word_hashes(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, eight bytes a round with a bijection between rounds (a
    polynomial modulo 2^64 has one value for many repetitive words); words of more than
    `LONG_WORD` bytes by BLAKE2b."""
    codes = mix(sizes.astype(U64) ^ U64(0x2545F4914F6CDD1D))
    if not len(begins):
        return codes
    lanes = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))
    live, done = np.flatnonzero((sizes > 0) & (sizes <= LONG_WORD)), 0
    while len(live):
        rest = np.minimum(sizes[live] - done, 8).astype(U64)
        own = lanes[begins[live] + done] & (U64(0xFFFFFFFFFFFFFFFF) >> (U64(64) - U64(8) * rest))
        codes[live] = mix(codes[live] ^ own)
        done += 8
        live = live[sizes[live] > done]
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        digest = hashlib.blake2b(data[begins[i] : begins[i] + sizes[i]].tobytes(), digest_size=8).digest()
        codes[i] = U64(int.from_bytes(digest, "little"))
    return codes


def word_units(data: np.ndarray, offsets: np.ndarray) -> Units:
    """Words are runs of bytes other than ASCII white space; `data` becomes the words,
    each with one space behind it."""
    n = len(data)
    letter = ~_SPACE[data]
    begin = letter.copy()
    begin[1:] &= ~letter[:-1]
    inner = offsets[1:-1][offsets[1:-1] < n]
    begin[inner] |= letter[inner]
    stop = np.zeros(n + 1, bool)
    stop[1:] = letter
    stop[:-1] &= ~letter | begin
    begins, ends = np.flatnonzero(begin), np.flatnonzero(stop)
    sizes = ends - begins
    word_offsets = np.searchsorted(begins, offsets)
    codes = word_hashes(data, begins, sizes)
    new_begins = np.cumsum(sizes + 1) - (sizes + 1)
    joined = np.full(int((sizes + 1).sum()), 32, np.uint8)
    joined[ragged(new_begins, sizes)] = data[letter]
    return Units(joined, codes, word_offsets, new_begins, new_begins + sizes)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes of all stretches, one after the other."""
    total = int(lengths.sum())
    return np.arange(total) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


def slide(op, x: np.ndarray, width: int) -> np.ndarray:
    """op over every `width` neighbours."""
    have = 1
    while have * 2 <= width:
        x, have = op(x[:-have], x[have:]), have * 2
    return op(x[: -(width - have)], x[width - have :]) if width > have else x


@dataclass
class Runs:
    """anchor, first symbol, number of windows and document of each run."""

    anchor: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    doc: np.ndarray
    anchors_at: tuple[np.ndarray, np.ndarray]  # anchor and document of each anchor's place


def runs_of(units: Units, prefix: Prefix, length: int, k: int) -> Runs:
    n, w = len(units.codes), length - k + 1
    empty = np.empty(0, np.int64)
    if n < length:
        return Runs(empty.astype(U64), empty, empty, empty, (empty.astype(U64), empty))
    grams = np.maximum(mix(prefix.all(k)), U64(1))
    least = slide(np.minimum, grams, w)
    sizes = np.diff(units.offsets)
    room = np.repeat(units.offsets[1:], sizes)[: len(least)]
    valid = np.arange(length, len(least) + length) <= room
    starts = valid.copy()
    starts[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    first = np.flatnonzero(starts)
    last = valid.copy()
    last[:-1] &= ~valid[1:] | starts[1:]
    count = np.flatnonzero(last) - first + 1
    pieces = -(-count // w)  # very long runs (periodic text) in pieces
    at = np.repeat(first, pieces)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = at + nth * w
    windows = np.minimum(w, np.repeat(first + count, pieces) - begin)
    doc = np.searchsorted(units.offsets, begin, side="right") - 1
    covered = np.zeros(len(grams) + w - 1, U64)
    covered[w - 1 : w - 1 + len(least)] = np.where(valid, least, U64(0))
    places = np.flatnonzero(slide(np.maximum, covered, w) == grams)
    return Runs(least[begin], begin, windows, doc, (grams[places], np.searchsorted(units.offsets, places, side="right") - 1))


def segment_hashes(runs: Runs, prefix: Prefix, length: int) -> np.ndarray:
    size = runs.windows + length - 1
    return mix(prefix.of(runs.start, size) + mix(size.astype(U64)))


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which pairs of stretches of one size hold equal bytes."""
    same = np.ones(len(a), bool)
    for k in range(0, len(a), 20_000):
        s = slice(k, k + 20_000)
        unlike = data[ragged(a[s], sizes[s])] != data[ragged(b[s], sizes[s])]
        if unlike.any():
            same[k + np.repeat(np.arange(len(sizes[s])), sizes[s])[unlike]] = False
    return same


def by_bytes(data: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A number for each stretch, equal for equal bytes: decides where hashes are equal
    and bytes aren't."""
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(data[a : a + n].tobytes(), len(seen)) for a, n in zip(first.tolist(), sizes.tolist())], np.int64)


def digests(data: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64 bits of the stretches' BLAKE2b: names for stretches with one polynomial hash."""
    return np.frombuffer(b"".join(hashlib.blake2b(data[a : a + n].tobytes(), digest_size=8).digest() for a, n in zip(first.tolist(), sizes.tolist())), U64)


def equal_groups(hashes: np.ndarray, data: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by hash and, where one hash has different bytes, by these; the starts of
    equal stretches in it (with the end); and which places have such a hash."""
    order, starts = by_key(hashes)
    leader = np.repeat(order[starts[:-1]], np.diff(starts))
    other = np.flatnonzero(order != leader)
    good = sizes[order[other]] == sizes[leader[other]]
    good[good] = same_bytes(data, first[order[other[good]]], first[leader[other[good]]], sizes[leader[other[good]]])
    mixed = np.zeros(len(hashes), bool)
    if not good.all():
        mixed = np.isin(hashes, hashes[order[other[~good]]])
        own = np.flatnonzero(mixed)
        number = np.zeros(len(hashes), np.int64)
        number[own] = by_bytes(data, first[own], sizes[own])
        order = np.lexsort((number, hashes))
        new = (hashes[order][1:] != hashes[order][:-1]) | (number[order][1:] != number[order][:-1])
        starts = np.append(np.flatnonzero(np.r_[True, new]), len(order))
    return order, starts, mixed


# --- blocks and blobs


def block_count(docs: DataFrame) -> int:
    """Blocks of 1.5 MB of input at least, larger with the square root of the data up
    to 256 MB, so that the blobs between blocks and buckets stay few."""
    total = table_bytes(docs)
    return max(24, int(total / min(256 << 20, max(3 << 19, 70 * math.sqrt(total)))))


def bucket_count(docs: DataFrame, blocks: int, per: int) -> int:
    """Buckets of anchors: one for `per` blocks up to 1024, then one for 256 MB of input, so
    that both a bucket's keys (some 36 MB) and what a block sends to it (dozens of keys)
    keep their size as the data grow."""
    return max(16, min(blocks // per, 1024), table_bytes(docs) >> 28)


def in_blocks(docs: DataFrame, blocks: int, id_col: str, text_col: str, carry: list[str] | None = None) -> DataFrame:
    """block, id, text and carried columns (named carry_0 and so on, so that no name
    clashes); the same exchange serves every pass."""
    key = F.col(id_col).cast("long")
    return docs.select(
        F.pmod(F.xxhash64(key, F.length(F.col(text_col).cast("string"))), F.lit(blocks)).alias("block"), key.alias("id"), F.col(text_col).cast("string").alias("text"),
        *(F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry or [])),
    )


def ids_of(table: pa.Table) -> np.ndarray:
    """Ids; null counts as less than any."""
    return table.column("id").combine_chunks().fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)


def texts_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return utf8(table.column("text"))


def blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def unblob(column: pa.ChunkedArray, dtype) -> list[np.ndarray]:
    return [np.frombuffer(v.as_py(), dtype) for v in column]


def squeeze(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(blob(x))


def unsqueeze(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(zstandard.ZstdDecompressor().decompress(v.as_py()), np.uint8) for v in column]


def bucket_of(anchors: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and the key within it; minima crowd near zero, so they're mixed again."""
    spread = mix(anchors ^ U64(0xA5A5A5A5A5A5A5A5))
    return ((spread >> U64(32)) % U64(buckets)).astype(np.int64), spread.astype(np.uint32)


def known_keys(table: pa.Table, column: str = "keys") -> np.ndarray:
    """Sorted bucket << 32 | key of the rows (bucket, keys)."""
    parts = [keys.astype(np.int64) | b << 32 for b, keys in zip(table.column("bucket").to_pylist(), unblob(table.column(column), np.uint32))]
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.int64)


def contains(sorted_keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(x), bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, x), len(sorted_keys) - 1)] == x


def by_key(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by key, and the starts of equal keys in it (with the end)."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    return order, np.append(np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.empty(0, np.int64), len(k))
