"""Order-preserving sequence packing by dynamic programming (operator 4).

Each input partition is a stream of documents in their order. A window may end at
a document's end, a sentence's end, or - where a stretch has neither for
`stretch` tokens - inside a sentence. Over these places the dynamic programme

    cost(j) = min over i in [j - size, j) of cost(i) + padding(j - i) + penalty(j)

finds the cuts with the least padding plus truncation penalties. Padding to the
full size makes cost(i) + i the only thing that depends on i, so a monotone queue
gives each minimum in constant amortised time; windows of exactly a power of two
need no padding and are tried besides.

Edge cases: null or empty text is a document of the single end id; a document of
any length is cut into as many pieces as needed; repeated ids or rows are packed
each on their own; an empty table gives no pieces; extra columns are not read.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHES, release_caches, steps, utf8
from .spans import ragged, word_hashes

#: Tokens that one run of the dynamic programme covers, at least (a partition's rest may be fewer).
RUN_TOKENS = 1 << 20
#: Cost, in padding tokens, of a cut at a sentence's end and inside a sentence.
SENTENCE_PENALTY, INSIDE_PENALTY = 2, 32
#: Shortest window that may end early because its length is a power of two.
LEAST_EXACT = 128
#: Distinct words whose ids a worker remembers; beyond it, it starts anew.
REMEMBERED = 1_000_000
#: The pattern of byte-level pre-tokens (a fixed value of this kind of tokenizer).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of the longest word that is remembered.
LONGEST_WORD = 1024
#: White space beyond ASCII, as numbers of its UTF-8 bytes.
_TWO_BYTE_SPACES, _WIDE_SPACES = (
    [int.from_bytes(c.encode(), "big") for c in map(chr, codes)]
    for codes in ((0x85, 0xA0), (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
)


class WordTable:
    """Ids of words, in arrays: an open-addressing table by the words' hashes. Equal hashes
    count only if sizes and bytes are equal; up to eight bytes the hash decides that, as
    it is a bijection there."""

    def __init__(self):
        self.slots = np.full(1 << 16, -1, np.int32)
        self.hashes, self.first, self.data = np.empty(0, np.uint64), np.empty(0, bool), np.empty(0, np.uint8)
        self.begins, self.sizes = np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids, self.ends = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def __len__(self) -> int:
        return len(self.hashes)

    def find(self, data: np.ndarray, begins: np.ndarray, sizes: np.ndarray, first: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The entry of each word: -1 for none, -2 if another word has its hash."""
        out, mask, todo = np.full(len(hashes), -1), len(self.slots) - 1, np.arange(len(hashes))
        at = (hashes & np.uint64(mask)).astype(np.int64)
        while len(todo):
            entry = self.slots[at[todo]]
            todo, entry = todo[entry >= 0], entry[entry >= 0]
            same = self.hashes[entry] == hashes[todo]
            out[todo[same]] = entry[same]
            todo = todo[~same]
            at[todo] = (at[todo] + 1) & mask
        hit = np.flatnonzero(out >= 0)
        entry = out[hit]
        good = _equal(self.data, self.begins[entry], self.sizes[entry], self.first[entry], data, begins[hit], sizes[hit], first[hit])
        out[hit[~good]] = -2
        return out

    def add(self, data: np.ndarray, begins: np.ndarray, sizes: np.ndarray, first: np.ndarray, hashes: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Words with different hashes that aren't here."""
        old, n = len(self), len(hashes)
        self.begins = np.concatenate([self.begins, len(self.data) + np.cumsum(sizes) - sizes])
        self.data = np.concatenate([self.data, data[ragged(begins, sizes)]])
        self.hashes, self.first, self.sizes = np.concatenate([self.hashes, hashes]), np.concatenate([self.first, first]), np.concatenate([self.sizes, sizes])
        self.ids, self.ends = np.concatenate([self.ids, ids]), np.concatenate([self.ends, self.ends[-1] + np.cumsum(counts)])
        if 2 * (old + n) > len(self.slots):
            self.slots = np.full(1 << int(4 * (old + n) - 1).bit_length(), -1, np.int32)
            old, n = 0, old + n
        mask, todo = len(self.slots) - 1, np.arange(old, old + n)
        at = (self.hashes[old:] & np.uint64(mask)).astype(np.int64)
        while len(todo):
            free = todo[self.slots[at[todo - old]] < 0]
            slot, claim = np.unique(at[free - old], return_index=True)
            self.slots[slot] = free[claim]
            todo = todo[self.slots[at[todo - old]] != todo]
            at[todo - old] = (at[todo - old] + 1) & mask

    def only(self, entries: np.ndarray) -> WordTable:
        """A new one with these entries."""
        out, counts = WordTable(), self.ends[entries + 1] - self.ends[entries]
        out.add(self.data, self.begins[entries], self.sizes[entries], self.first[entries], self.hashes[entries], self.ids[ragged(self.ends[entries], counts)], counts)
        return out


def _equal(one: np.ndarray, a: np.ndarray, m: np.ndarray, p: np.ndarray, other: np.ndarray, b: np.ndarray, n: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether words with equal hashes, m and n bytes at a and b of two buffers, are equal,
    and are first words or not (p, q) alike."""
    good = (m == n) & (p == q)
    long = np.flatnonzero(good & (n > 8))
    if len(long):
        sizes = n[long]
        unlike = one[ragged(a[long], sizes)] != other[ragged(b[long], sizes)]
        good[long[np.repeat(np.arange(len(long)), sizes)[unlike]]] = False
    return good


class IdMaker:
    """Ids of whole texts. A byte-level pre-token never reaches over a space behind a
    character that is no white space, so such texts are put together from remembered
    words; all others go to the tokenizer as they are.

    New words are encoded by a faster merger of the same vocabulary where the
    tokenizer file proves the two alike: its merges, in order, make the ids 256, 257
    and so on. Any other file, and any word with a special token's string in it, is
    encoded by the tokenizer itself."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = WordTable()
        tokens = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.n_bytes = np.array([len(t) for t in tokens], np.int64)  # byte-level tokens have a character for each byte
        self.ends_sentence = np.array([t[-1:] in (".", "!", "?", "Ċ") for t in tokens], bool)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.fast = self._same_merger(spec)

    def _same_merger(self, spec: dict):
        model, before = spec["model"], spec["pre_tokenizer"] or {}
        vocab, merges = model.get("vocab", {}), [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
        plain = spec["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        if not plain or model.get("type") != "BPE" or any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
            return None
        import tiktoken

        letters = [c for c in range(256) if chr(c).isprintable() and c not in (32, 0xA0, 0xAD)]  # the rest are written as 256, 257, ...
        byte_of = {chr(c): c for c in letters} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in letters)}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if t not in self.special}
        return tiktoken.Encoding("same", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and their numbers, of words that follow a space. Put behind one
        another they are a text that is cut just before these spaces, and the ids'
        bytes tell which word each belongs to."""
        texts = ["".join(" " + w for w in words[k : k + 2000]) for k in range(0, len(words), 2000)]
        if self.fast is not None:
            flat = np.concatenate([self.fast.encode_to_numpy(t, disallowed_special=()).astype(np.uint32) for t in texts])
        else:
            flat = np.concatenate([np.array(own, np.uint32) for own in self._encode(texts)])
        ends = np.cumsum([len(w.encode()) + 1 for w in words])
        token_ends = np.cumsum(self.n_bytes[flat])
        at = np.searchsorted(token_ends, ends) + 1
        if not np.array_equal(token_ends[at - 1], ends):
            raise ValueError("a token reaches over the space between two words")
        return flat, np.diff(at, prepend=0)

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and their numbers of words: those that begin a text end in a space."""
        every = " ".join(words)
        special = [s for s in self.special if s in every]
        odd = [not w or w[-1].isspace() for w in words]
        if special:
            odd = [o or any(s in w for s in special) for o, w in zip(odd, words)]
        if not any(odd):
            return self._encode_words(words)
        alone = list(itertools.compress(words, odd))
        usual = [w for w, o in zip(words, odd) if not o]
        ids = self._encode([w[:-1] if w[-1:] == " " else " " + w for w in alone])
        flat, counts = self._encode_words(usual) if usual else (np.empty(0, np.uint32), np.empty(0, np.int64))
        flat = np.concatenate([np.array([i for own in ids for i in own], np.uint32), flat])
        counts = np.concatenate([np.array([len(own) for own in ids], np.int64), counts])
        at = np.argsort(np.argsort(~np.array(odd), kind="stable"), kind="stable")  # each word's place in `alone` and `usual`
        begins = (np.cumsum(counts) - counts)[at]
        return flat[ragged(begins, counts[at])], counts[at]

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the number of ids of each text."""
        return self.of_bytes(*utf8(pa.array(texts, pa.string())))

    def of_bytes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As for texts, for their UTF-8 bytes one after the other."""
        docs, space = len(offsets) - 1, np.flatnonzero(data == 32)
        doc = np.searchsorted(offsets, space, side="right") - 1
        cut = (np.bincount(doc, minlength=docs) > 0) & (np.bincount(doc[_after_space(data, space, offsets[doc])], minlength=docs) == 0)
        # words of the texts that spaces cut; the tokenizer takes the others whole
        mine = cut[doc]
        n_words = np.where(cut, np.bincount(doc, minlength=docs) + 1, 0)
        last = np.cumsum(n_words)
        begins, ends, first = np.empty(int(last[-1]) if docs else 0, np.int64), np.empty(int(last[-1]) if docs else 0, np.int64), np.zeros(int(last[-1]) if docs else 0, bool)
        first[(last - n_words)[cut]] = True
        final = np.zeros(len(first), bool)
        final[last[cut] - 1] = True
        begins[first], begins[~first] = offsets[:-1][cut], space[mine] + 1
        ends[final], ends[~final] = offsets[1:][cut], space[mine]
        sizes = ends - begins
        hashes = word_hashes(data, begins, sizes) ^ np.where(first, np.uint64(0x9D39247E33776D41), np.uint64(0))
        entry = self.words.find(data, begins, sizes, first, hashes)
        entry[sizes > LONGEST_WORD] = -2
        new = np.flatnonzero(entry == -1)
        if len(new):
            _, rep, which = np.unique(hashes[new], return_index=True, return_inverse=True)
            rep = new[rep]
            leader = rep[which]
            same = _equal(data, begins[leader], sizes[leader], first[leader], data, begins[new], sizes[new], first[new])
            if len(self.words) + len(rep) > REMEMBERED:  # only what this step needs stays
                kept, back = np.unique(entry[entry >= 0], return_inverse=True)
                self.words = self.words.only(kept)
                entry[entry >= 0] = back
            ids, counts = self._learn([_word(data, begins[i], ends[i], first[i]) for i in rep.tolist()])
            entry[new] = np.where(same, len(self.words) + which, -2)
            self.words.add(data, begins[rep], sizes[rep], first[rep], hashes[rep], ids, counts)
        flat, bounds = self.words.ids, self.words.ends
        apart = np.flatnonzero(entry == -2)
        if len(apart):  # words that aren't remembered
            ids, counts = self._learn([_word(data, begins[i], ends[i], first[i]) for i in apart.tolist()])
            entry[apart] = len(self.words) + np.arange(len(apart))
            flat, bounds = np.concatenate([flat, ids]), np.concatenate([bounds, bounds[-1] + np.cumsum(counts)])
        lengths = bounds[entry + 1] - bounds[entry]
        ids = flat[ragged(bounds[entry], lengths)]
        counts = np.diff(np.append(0, np.cumsum(lengths))[np.append(0, last)])
        if not cut.all():
            whole = iter(self._encode([data[offsets[i] : offsets[i + 1]].tobytes().decode() for i in np.flatnonzero(~cut).tolist()]))
            pieces = np.split(ids, np.cumsum(counts)[:-1])
            pieces = [x if c else np.array(next(whole), np.uint32) for x, c in zip(pieces, cut.tolist())]
            ids, counts = np.concatenate(pieces), np.array([len(x) for x in pieces], np.int64)
        return ids, counts


def _word(data: np.ndarray, begin: int, end: int, first: bool) -> str:
    return data[begin:end].tobytes().decode() + (" " if first else "")


def _after_space(data: np.ndarray, space: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether white space stands before each space; starts: where its text begins. There
    a pre-token may hold several spaces."""
    before = lambda k: np.where(space - k >= starts, data[np.maximum(space - k, 0)], 0)
    one = before(1)
    found = (one == 32) | ((one >= 9) & (one <= 13))
    other = np.flatnonzero(one >= 0x80)
    if len(other):
        space, starts = space[other], starts[other]
        code = before(3).astype(np.int64) << 16 | before(2).astype(np.int64) << 8 | before(1)
        found[other] = np.isin(code, _WIDE_SPACES) | np.isin(code & 0xFFFF, _TWO_BYTE_SPACES)
    return found


@functools.lru_cache(maxsize=2)
def _maker(path: str) -> IdMaker:
    return IdMaker(path)


CACHES.append(_maker.cache_clear)


def choose_cuts(places: np.ndarray, penalties: np.ndarray, size: int) -> np.ndarray:
    """Indexes into `places` (ascending; the first is the stream's start, the last its
    end) at which windows end, for the least padding plus penalties. Neighbouring
    places are at most `size` apart."""
    n = len(places)
    pos, pen = places.tolist(), penalties.tolist()
    exact: list[list[int]] = [[]] * n
    width = LEAST_EXACT
    while width < size:
        at = np.searchsorted(places, places - width)
        for j in np.flatnonzero((places[at] == places - width) & (at < np.arange(n))).tolist():
            exact[j] = [*exact[j], int(at[j])]
        width *= 2
    cost, before = [0] * n, [0] * n
    queue: deque[tuple[int, int]] = deque([(pos[0], 0)])
    for j in range(1, n):
        p = pos[j]
        while pos[queue[0][1]] < p - size:
            queue.popleft()
        value, i = queue[0]
        best = value + size - p
        for k in exact[j]:
            if cost[k] < best:
                best, i = cost[k], k
        cost[j], before[j] = best + pen[j], i
        value = cost[j] + p
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j))
    out, j = [], n - 1
    while j:
        out.append(j)
        j = before[j]
    return np.array(out[::-1], np.int64)


def cut_places(ids: np.ndarray, doc_ends: np.ndarray, ends_sentence: np.ndarray, stretch: int) -> tuple[np.ndarray, np.ndarray]:
    """Where windows may end, and what each place costs."""
    penalty = np.full(len(ids) + 1, -1, np.int64)
    penalty[1:][ends_sentence[ids]] = SENTENCE_PENALTY
    penalty[doc_ends] = 0
    penalty[0] = 0
    places = np.flatnonzero(penalty >= 0)
    gaps = np.diff(places)
    for i in np.flatnonzero(gaps > stretch).tolist():
        penalty[np.arange(places[i] + stretch, places[i + 1], stretch)] = INSIDE_PENALTY
    places = np.flatnonzero(penalty >= 0)
    return places, penalty[places]


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 1024,
    end_id: int = 0,
    with_ids: bool = False,
) -> DataFrame:
    """Per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and the
    ids themselves if asked for). A narrow map over the scan, without a shuffle: each
    partition packs its own stream, and only its last sequence may be short."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    if with_ids:
        schema, names = schema + ", ids array<int>", [*names, "ids"]

    def emit(keys: list[pa.Array], ids: np.ndarray, counts: np.ndarray, maker: IdMaker, first: int) -> tuple[pa.RecordBatch, int]:
        doc_ends = np.cumsum(counts)
        places, penalties = cut_places(ids, doc_ends, maker.ends_sentence, min(256, size))
        cuts = places[choose_cuts(places, penalties, size)]
        ends = np.union1d(cuts, doc_ends)
        starts = np.concatenate([[0], ends[:-1]])
        doc = np.searchsorted(doc_ends, starts, side="right")
        window = np.searchsorted(cuts, starts, side="right")
        raw = ids.astype("<u4").tobytes()
        columns = [
            pa.concat_arrays(keys).take(pa.array(doc)),
            pa.array(starts - (doc_ends - counts)[doc]),
            pa.array(ends - starts),
            pa.array([zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist())], pa.int64()),
            pa.array(counts[doc]),
            pa.array(window + first),
            pa.array(starts - np.concatenate([[0], cuts])[window]),
        ]
        if with_ids:
            columns.append(pa.ListArray.from_arrays(pa.array(np.append(starts, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32))))
        return pa.RecordBatch.from_arrays(columns, names=names), first + len(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches("packing")
        maker = _maker(tokenizer_path)
        at = TaskContext.get().partitionId() << 32
        keys, parts, counts, held = [], [], [], 0
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for start, end in steps(offsets):
                flat, n = maker.of_bytes(data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start])
                ids = np.insert(flat, np.cumsum(n), end_id)
                keys.append(batch.column(0).slice(start, end - start))
                parts.append(ids)
                counts.append(n + 1)
                held += len(ids)
                if held >= RUN_TOKENS:
                    out, at = emit(keys, np.concatenate(parts), np.concatenate(counts), maker, at)
                    yield out
                    keys, parts, counts, held = [], [], [], 0
        if held:
            yield emit(keys, np.concatenate(parts), np.concatenate(counts), maker, at)[0]

    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
