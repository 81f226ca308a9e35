"""Token counts by rank-synchronous array merging (operator 7).

Batched pre-tokens are held as one ragged numpy array of symbols. In every round
each sequence applies its best pair (highest score, leftmost first) - all
sequences at once - until no pair of any sequence is in the vocabulary; the
surviving symbols are the tokens. A symbol outside the vocabulary counts as its
UTF-8 bytes (byte fallback).

Edge cases: null or empty text has 0 bytes and 0 tokens; runs of spaces, literal
word-boundary marks, unknown characters and control strings count as the library
counts them; texts are never truncated; repeated rows give repeated rows; extra
columns are not read.
"""

from __future__ import annotations

import functools
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHES, release_caches, steps, utf8

MARK = "▁"
#: Pre-tokens longer than this are merged one by one, with the places of each rank in arrays.
LONG = 96
#: Distinct pre-tokens whose counts a worker remembers; beyond it, it starts anew.
REMEMBERED = 300_000
_RUNS = re.compile(" +[^ ]*")


class PieceMerger:
    """Counts tokens of pre-tokens under a sentencepiece BPE model."""

    def __init__(self, model_path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = model.get_piece_size()
        pieces, scores = [], np.full(size + 1, -np.inf)
        for i in range(size):
            special = model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i)
            pieces.append(None if special else model.id_to_piece(i))
            scores[i] = -np.inf if special else model.get_score(i)
        self.scores = scores
        self.ids = {p: i for i, p in enumerate(pieces) if p is not None}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece holds a word boundary inside; pre-tokens can't be merged apart")
        missing = {c for p in self.ids for c in p} - self.ids.keys()
        if missing:
            raise ValueError("a character of a piece is no piece itself")
        pairs = sorted(
            (self.ids[p[:k]] << 32 | self.ids[p[k:]], i)
            for p, i in self.ids.items()
            for k in range(1, len(p))
            if p[:k] in self.ids and p[k:] in self.ids
        )
        self.keys = np.array([k for k, _ in pairs], np.int64)
        self.made = np.array([i for _, i in pairs], np.int64)
        self.unknown = size
        # pieces in the order of their scores; -1 for no piece
        made = np.unique(self.made)
        order = np.unique(-scores[made], return_inverse=True)[1].ravel()
        self.ranks = np.full(size + 1, -1)
        self.ranks[made] = order
        # merges that may make a pair of an earlier rank
        self.turns_back = np.zeros(size + 1, bool)
        for part in (self.keys >> 32, self.keys & 0xFFFFFFFF):
            self.turns_back[part[self.ranks[part] >= self.ranks[self.made]]] = True

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece each pair merges to, or `unknown`."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], self.unknown)

    def _bytes_of_unknown(self, text: str) -> int:
        return sum(len(c.encode("utf-8", "surrogatepass")) - 1 for c in text if c not in self.ids)

    def _count_long(self, token: str) -> int:
        """As `count`, for one long sequence: all places of its lowest-ranking pair at once,
        the places of each rank held in arrays. A merge that makes pairs of later ranks only
        doesn't disturb the rank's other places, but for overlaps: of these every second
        goes, from the left. A round ends with the place that makes a pair of an earlier
        rank, if there is one."""
        symbols = np.array([self.ids.get(c, self.unknown) for c in token] + [self.unknown], np.int64)
        n = len(token)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        alive = np.ones(n + 1, bool)
        places: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def push(at: np.ndarray) -> None:
            rank = self.ranks[self._pairs(symbols[at], symbols[after[at]])]
            at, rank = at[rank >= 0], rank[rank >= 0]
            order = np.argsort(rank, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(rank[order])) + 1) if len(order) else ():
                r = int(rank[own[0]])
                if r not in places:
                    heapq.heappush(ranks, r)
                places.setdefault(r, []).append(at[own])

        push(np.arange(n))
        while ranks:
            r = heapq.heappop(ranks)
            at = np.unique(np.concatenate(places.pop(r)))
            at = at[alive[at]]
            made = self._pairs(symbols[at], symbols[after[at]])
            good = self.ranks[made] == r
            at, made = at[good], made[good]
            if not len(at):
                continue
            chained = np.append(False, after[at[:-1]] == at[1:])
            nth = np.arange(len(at)) - np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
            at, made = at[nth % 2 == 0], made[nth % 2 == 0]
            if self.turns_back[made].any():
                joined = np.append(False, before[at[1:]] == after[at[:-1]])  # the symbol before is a merge of this round
                left = np.where(joined, np.append(self.unknown, made[:-1]), np.where(before[at] >= 0, symbols[before[at]], self.unknown))
                ranks_made = np.stack([self.ranks[self._pairs(left, made)], self.ranks[self._pairs(made, symbols[after[after[at]]])]])
                back = ((ranks_made >= 0) & (ranks_made < r)).any(axis=0)
                last = int(back.argmax()) + 1 if back.any() else len(at)
                if last < len(at):
                    heapq.heappush(ranks, r)
                    places[r] = [at[last:]]
                    at, made = at[:last], made[:last]
            gone = after[at]
            symbols[at] = made
            alive[gone] = False
            after[at] = after[gone]
            before[after[at]] = at
            push(np.unique(np.concatenate([before[at][before[at] >= 0], at])))
        return int(alive[:n].sum()) + self._bytes_of_unknown(token)

    def count(self, tokens: list[str]) -> list[int]:
        """Tokens of each pre-token."""
        out = np.zeros(len(tokens), np.int64)
        short = []
        for i, t in enumerate(tokens):
            if len(t) > LONG:
                out[i] = self._count_long(t)
            elif t:
                short.append(i)
        if not short:
            return out.tolist()
        get, unknown = self.ids.get, self.unknown
        lengths = np.array([len(tokens[i]) for i in short], np.int64)
        symbols = np.array([get(c, unknown) for i in short for c in tokens[i]], np.int64)
        extra = np.zeros(len(short), np.int64)
        odd = np.unique(np.repeat(np.arange(len(short)), lengths)[symbols == unknown])
        for k in odd.tolist():
            extra[k] = self._bytes_of_unknown(tokens[short[k]])
        left_over = lengths.copy()
        live = np.arange(len(short))  # sequences that may still merge
        while len(live):
            starts = np.zeros(len(live), np.int64)
            np.cumsum(lengths[:-1], out=starts[1:])
            made = np.full(len(symbols), unknown)
            made[:-1] = self._pairs(symbols[:-1], symbols[1:])
            made[starts[1:] - 1] = unknown  # no pair across sequences
            made[-1] = unknown
            score = self.scores[made]
            best = np.maximum.reduceat(score, starts)
            owner = np.repeat(np.arange(len(live)), lengths)
            hits = np.flatnonzero((score == best[owner]) & (score > -np.inf))
            who = owner[hits]
            first = np.ones(len(hits), bool)
            first[1:] = who[1:] != who[:-1]
            hits, who = hits[first], who[first]
            symbols = symbols.copy()
            symbols[hits] = made[hits]
            keep = np.ones(len(symbols), bool)
            keep[hits + 1] = False
            go_on = np.zeros(len(live), bool)
            go_on[who] = True
            lengths = lengths.copy()
            lengths[who] -= 1
            left_over[live] = lengths
            go_on &= lengths > 1
            keep &= go_on[owner]
            symbols, lengths, live = symbols[keep], lengths[go_on], live[go_on]
        out[short] = left_over + extra
        return out.tolist()


class _Counts(dict):
    """Counts of pre-tokens that were seen."""

    def fill(self, merger: PieceMerger, tokens: set[str]) -> None:
        new = [t for t in tokens if t not in self]
        if len(self) + len(new) > REMEMBERED:
            self.clear()
            new = list(tokens)
        for k in range(0, len(new), 20_000):
            part = new[k : k + 20_000]
            self.update(zip(part, merger.count(part)))


@functools.lru_cache(maxsize=2)
def _merger(model_path: str) -> tuple[PieceMerger, _Counts]:
    return PieceMerger(model_path), _Counts()


CACHES.append(_merger.cache_clear)


def pre_tokens(text: str) -> list[str]:
    """A text's pre-tokens: a run of boundary marks and what follows it."""
    if not text:
        return []
    if MARK in text:
        text = text.replace(MARK, " ")
    if "  " in text or text[0] == " " or text[-1] == " ":
        return [t.replace(" ", MARK) for t in _RUNS.findall(" " + text)]
    return [MARK + w for w in text.split(" ")]


def count_texts(texts: list[str], model_path: str) -> list[int]:
    """Tokens of each text, as the library counts them."""
    merger, counts = _merger(model_path)
    split = [pre_tokens(t) for t in texts]
    counts.fill(merger, {t for tokens in split for t in tokens})
    get = counts.__getitem__
    return [sum(map(get, tokens)) for tokens in split]


def token_counts(
    docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096
) -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    A narrow map over the scan: no shuffle, memory bounded by a step of 2 MB of
    text and the remembered pre-tokens.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches("tokens")
        for batch in batches:
            _, offsets = utf8(batch.column(1))
            for start, end in steps(offsets):
                part = batch.slice(start, end - start)
                tokens = np.array(count_texts([t or "" for t in part.column(1).to_pylist()], model_path), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(offsets[start : end + 1])), pa.array(tokens), pa.array(tokens > limit)],
                    names=[id_col, "n_bytes", "n_tokens", "over_limit"],
                )

    chosen = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
