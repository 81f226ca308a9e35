"""N-gram Jaccard join with a count-vector R-tree (operator 2).

A document's set holds hashes of its distinct word shingles. Two sets link when
den * |A & B| >= num * |A | B|. The join is exact:

* Equal sets are joined by their digests; the least document of each goes on.
* Sets of similar size are dealt into cells. For a size class in which linked sets
  differ by at most D shingles, each set is split by hash into D + 1 + s parts: linked
  sets have more than s equal parts, so they meet in a cell of (class, part, its
  content), or, if all those are empty, in the class's cell for sets with more than s
  empty parts. s grows with D, so that hardly any set has so many.
* Shingles are also hashed into groups, and the counts in the groups make a point. The
  sum of two points' coordinate minima bounds the overlap from above. In each cell an
  R-tree over the points finds the pairs that the bound leaves. There are a quarter to an
  eighth as many groups as shingles, so that the bound tells unlike sets of any size
  apart; what it leaves makes neighbourhoods, which links never leave.
* The sets of a neighbourhood, each sent once, are verified: an R-tree finds the pairs,
  and their whole sets are compared. Pairs that are connected already are skipped, so a
  group of m near copies costs about m verifications. Components are of verified links.
* Cells and neighbourhoods of any size are cut into slices of bounded size: members of a
  cell that a block holds many of are a slice already, of which the cell's task gets the
  least only. A slice
  meets the group's least member first; then those pairs of slices meet that aren't of
  one component already. A group of near copies is thus settled by its slices alone.

Words and shingles are held as 64-bit hashes by a bijective mix of each eight bytes (or
BLAKE2b); two different shingles with one hash are as rare as chance makes them, 2^-64 a
pair. Equal sets are found by 128-bit digests and sizes.

Edge cases: null or empty text has an empty set and links with nothing; a text with
fewer words than a shingle is one shingle; a null id links with nothing and has a null
component; rows with equal ids are vertices of one name, each row in the component of its
own set; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, release_caches, steps, table_bytes, utf8
from .components import connected_components
from .repeats import _batch
from .spans import blob, by_key, mix, ragged, unblob, word_units

FAN_OUT = 16
#: Documents that a map task gathers before it sends keys: bounds the blobs in memory.
GATHER_BYTES = 8 << 20
#: Rows of two longs that are broadcast at most; beyond it the join shuffles.
BROADCAST_IDS = 500_000
#: Buckets that a block of texts sends keys to at most. Where there are more, coarse ones
#: are sent to first, whose rows are gathered up to `SPLIT_BYTES` before they're split.
COARSE, SPLIT_BYTES = 2048, 64 << 20
#: Members of a cell in one block from which on they stay together as a slice of it.
BLOCK_MEMBERS = 64
#: Members in a slice of a cell, shingles in a slice of a neighbourhood, and what a task holds of either.
CELL_MEMBERS, SLICE_SHINGLES = 4096, 1_000_000
TASK_ENTRIES, TASK_SHINGLES = 400_000, 2_000_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
U64 = np.uint64


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and the offsets of the sets."""
    units = word_units(_LOWER[data], offsets)
    words = np.diff(units.offsets)
    count = np.where(words >= k, words - k + 1, np.minimum(words, 1))
    doc = np.repeat(np.arange(len(words)), count)
    start = ragged(units.offsets[:-1], count)
    size = np.minimum(words[doc], k)
    hashes = mix(size.astype(U64) + U64(0x51ED270B))
    for i in range(k):
        inner = np.flatnonzero(size > i) if len(size) and size.min() <= i else slice(None)
        hashes[inner] = mix(hashes[inner] * U64(3) ^ units.codes[start[inner] + i])
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    doc, hashes = doc[first], hashes[first]
    return hashes, np.searchsorted(doc, np.arange(len(words) + 1))


def group_bits(sizes: np.ndarray) -> np.ndarray:
    """Binary logarithm of the groups for sets of these sizes: 16 groups, and at least an eighth of the size."""
    return np.maximum(4, np.ceil(np.log2(np.maximum(sizes, 1) / 8)).astype(np.int64))


def count_points(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of each set's shingles in its groups, one set after the other."""
    sizes = np.diff(offsets)
    bits = group_bits(sizes)
    base = np.append(0, np.cumsum(1 << bits))
    at = np.repeat(base[:-1], sizes) + (hashes >> np.repeat(U64(64) - bits.astype(U64), sizes)).astype(np.int64)
    return np.bincount(at, minlength=int(base[-1])).astype(np.uint32)


def folded(points: np.ndarray, base: np.ndarray, bits: np.ndarray, own: np.ndarray, to: int) -> np.ndarray:
    """A row of 2^to counts for each of these sets; finer groups are added up."""
    out = np.zeros((len(own), 1 << to), np.int32)
    for b in np.unique(bits[own]).tolist():
        at = np.flatnonzero(bits[own] == b)
        out[at] = points[base[own[at]][:, None] + np.arange(1 << b)].reshape(len(at), 1 << to, -1).sum(axis=2)
    return out


def size_classes(num: int, den: int, largest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First sizes of the classes, the parts of each, and how many of them may be empty.
    The larger of two linked sets is in the class of the smaller or in the next."""
    firsts, parts, spares = [1], [], []
    while firsts[-1] <= largest:
        low = firsts[-1]
        firsts.append(low * den // num + 1)
        small = firsts[-1] - 1  # |A ^ B| <= (den - num) * |A | B| / den and |A | B| <= |A| * den / num
        most = (den - num) * small // num
        spares.append(3 + -(-3 * most // 100) if most else 0)
        parts.append(most + 1 + spares[-1])
    return np.array(firsts[:-1], np.int64), np.array(parts, np.int64), np.array(spares, np.int64)


def cell_keys(hashes: np.ndarray, offsets: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the cells that each set is in, and their sets."""
    sizes = np.diff(offsets)
    firsts, parts, spares = size_classes(num, den, int(sizes.max(initial=0)))
    own = np.searchsorted(firsts, sizes, side="right") - 1
    keys, sets = [np.empty(0, U64)], [np.empty(0, np.int64)]
    for step in (0, 1):  # its own class, and the one below, where it is the larger partner
        who = np.flatnonzero((sizes > 0) & (own >= step))
        cls = own[who] - step
        n = sizes[who]
        at = ragged(offsets[:-1][who], n)
        index = np.repeat(np.arange(len(who)), n)
        spread = mix(hashes[at] ^ U64(0x5DEECE66D))
        part = (spread >> U64(20)) % parts[cls][index].astype(U64)
        base = np.cumsum(parts[cls]) - parts[cls]
        slot = base[index] + part.astype(np.int64)
        total = int(parts[cls].sum())
        order = np.argsort(slot, kind="stable")
        slots = slot[order]
        heads = np.flatnonzero(np.r_[True, slots[1:] != slots[:-1]]) if len(slots) else np.empty(0, np.int64)
        content = np.zeros(total, U64)
        filled = np.zeros(total, bool)
        if len(heads):
            content[slots[heads]] = np.add.reduceat(mix(spread[order]), heads)
            filled[slots[heads]] = True
        owner = np.repeat(np.arange(len(who)), parts[cls])
        nth = np.arange(total) - base[owner]
        label = mix(cls[owner].astype(U64) * U64(1 << 32) + nth.astype(U64))
        keys.append(mix(content + label)[filled])
        sets.append(who[owner[filled]])
        sparse = np.flatnonzero(parts[cls] - np.bincount(owner[filled], minlength=len(who)) > spares[cls])
        keys.append(mix(cls[sparse].astype(U64) + U64(1 << 62)))
        sets.append(who[sparse])
    return np.concatenate(keys), np.concatenate(sets)


def overlap_needed(a, b, num: int, den: int):
    """Least overlap of linked sets of these sizes."""
    return -(-num * (a + b) // (num + den))


class RTree:
    """Bulk-loaded over points; a node keeps the greatest coordinates and the least and
    greatest sizes of its points."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        order = np.argsort(sizes, kind="stable")
        slab = max(FAN_OUT, int(np.sqrt(len(order) * FAN_OUT)))
        widest = int(points.var(axis=0).argmax())
        self.order = np.concatenate([s[np.argsort(points[s, widest], kind="stable")] for s in np.split(order, range(slab, len(order), slab))])
        self.levels = []
        high, low, most = points[self.order], sizes[self.order], sizes[self.order]
        while len(high) > 1:
            cuts = np.arange(0, len(high), FAN_OUT)
            high, low, most = np.maximum.reduceat(high, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(most, cuts)
            self.levels.append((high, low, most))

    def search(self, query: int, num: int, den: int, wanted: np.ndarray) -> np.ndarray:
        """Wanted points whose overlap with the query's may suffice."""
        q, n = self.points[query], int(self.sizes[query])
        live = [wanted[self.order]]
        for high, _, _ in self.levels:
            live.append(np.logical_or.reduceat(live[-1], np.arange(0, len(live[-1]), FAN_OUT)))
        nodes = np.zeros(1, np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            high, low, most = self.levels[depth]
            nodes = nodes[live[depth + 1][nodes] & (most[nodes] * den >= num * n) & (num * low[nodes] <= den * n)]
            nodes = nodes[np.minimum(high[nodes], q).sum(axis=1) >= overlap_needed(n, low[nodes], num, den)]
            nodes = (nodes[:, None] * FAN_OUT + np.arange(FAN_OUT)).ravel()
            nodes = nodes[nodes < len(live[depth])]
        found = self.order[nodes[live[0][nodes]]]
        found = found[linkable(n, self.sizes[found], num, den)]
        return found[np.minimum(self.points[found], q).sum(axis=1) >= overlap_needed(n, self.sizes[found], num, den)]


def linkable(a, b, num: int, den: int):
    """Whether sets of these sizes may link."""
    return (num * a <= den * b) & (num * b <= den * a)


def sweep(points: np.ndarray, sizes: np.ndarray, label: np.ndarray, num: int, den: int, links=None) -> None:
    """Give one label to all that are connected by pairs that the bound leaves, and that
    `links(query, others)` approves."""
    tree, place = RTree(points, sizes), np.arange(len(label))
    names, count = np.unique(label, return_counts=True)
    asked = label == names[count.argmax()]  # pairs with the largest part are found from the other side
    for q in np.flatnonzero(~asked).tolist():
        wanted = label != label[q]
        wanted &= asked | (place > q)
        if not wanted.any():
            continue
        found = tree.search(q, num, den, wanted)
        if links is not None and len(found):
            found = found[links(q, found)]
        if len(found):
            label[np.isin(label, np.append(label[found], label[q]))] = min(label[q], label[found].min())


def _set_sums(x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(x) + 1, U64)
    np.cumsum(x, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join nodes a and b in a union-find in which every node points to its root, the least."""
    while len(a):  # of two roots the lesser becomes the other's
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root[:] = root[root]


_SKETCH = "bucket long, keys binary, refs binary, ids binary, sizes binary, tags binary, tags2 binary, points binary"


def _dealt(keys: np.ndarray, sets: np.ndarray, marks: np.ndarray, bucket: np.ndarray, ids: np.ndarray, sizes: np.ndarray, tag: np.ndarray, tag2: np.ndarray) -> Iterator[tuple]:
    """A row of blobs for each bucket: keys, and the documents that they are of."""
    order, starts = by_key(bucket)
    for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
        own = order[s:e]
        who, ref = np.unique(sets[own], return_inverse=True)
        yield (int(bucket[own[0]]), blob(keys[own]), blob(ref.astype(np.uint32)), blob(ids[who]), blob(sizes[who]), blob(tag[who]), blob(tag2[who]), blob(marks[own]))


def _bucket_of(keys: np.ndarray, buckets: int, coarse: int) -> np.ndarray:
    """The bucket of each key; `coarse` ones hold the keys of several."""
    fine = (keys >> U64(32)) % U64(buckets)
    return (fine % U64(coarse) if buckets > coarse else fine).astype(np.int64)


def _split(rows: DataFrame, buckets: int, coarse: int, tasks: int) -> DataFrame:
    """Rows of coarse buckets as rows of buckets; profiles and slices pass through."""

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        base = np.cumsum([0] + [len(h[2]) for h in held])
        keys, ids, sizes, tag, tag2, marks = (np.concatenate([h[i] for h in held]) for i in (0, 2, 3, 4, 5, 6))
        sets = np.concatenate([h[1].astype(np.int64) + b for h, b in zip(held, base)])
        out = list(_dealt(keys, sets, marks, _bucket_of(keys, buckets, buckets), ids, sizes, tag, tag2))
        yield from _batch(_SKETCH, [list(c) for c in zip(*out)]).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches("jaccard")
        held, size = [], 0
        for batch in batches:
            negative = pc.less(batch.column(0), 0)
            yield batch.filter(negative)
            for row in batch.filter(pc.invert(negative)).to_pylist():
                raw = [row[c] for c in ("keys", "refs", "ids", "sizes", "tags", "tags2", "points")]
                held.append(tuple(np.frombuffer(r, t) for r, t in zip(raw, (U64, np.uint32, np.int64, np.int64, U64, U64, np.uint8))))
                size += sum(map(len, raw))
                if size >= SPLIT_BYTES:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    salt = F.pmod(F.xxhash64("ids"), F.lit(max(1, -(-tasks // coarse))))
    dealt = rows.repartition(tasks, "bucket", salt).sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, _SKETCH)


def _sketch(docs: DataFrame, k: int, num: int, den: int, buckets: int, coarse: int, block_members: int) -> DataFrame:
    """Blobs of keys for buckets >= 0; for bucket -1 profiles (id, size, digests, point), and
    slices (a key and ids) of cells that a block holds many members of. Such a cell's bucket
    gets the slice's least member, marked in `points`."""

    def emit(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids, valid, hashes, sizes = (np.concatenate([p[i] for p in parts]) for i in range(4))
        offsets = np.append(0, np.cumsum(sizes))
        tag, tag2 = (_set_sums(mix(hashes ^ U64(c)), offsets) for c in (0x1234567, 0x89ABCDEF0123))
        rows: list[list] = [[] for _ in _SKETCH.split(", ")]
        for column, value in zip(rows, (-1, None, blob(valid), blob(ids), blob(sizes), blob(tag), blob(tag2), blob(count_points(hashes, offsets)))):
            column.append(value)
        usable = np.flatnonzero(valid & (sizes > 0))
        usable = usable[np.argsort(ids[usable], kind="stable")]
        _, first = np.unique(np.stack([tag[usable], tag2[usable], sizes[usable].astype(U64)]), axis=1, return_index=True)
        first = np.sort(usable[first])  # of each set its least id sends keys; it names the set from here to the result
        inner = ragged(offsets[:-1][first], sizes[first])
        keys, sets = cell_keys(hashes[inner], np.append(0, np.cumsum(sizes[first])), num, den)
        order, starts = by_key(keys)
        sent, marks = np.ones(len(keys), bool), np.zeros(len(keys), np.uint8)
        for c in np.flatnonzero(np.diff(starts) >= block_members).tolist():
            own = order[starts[c] : starts[c + 1]]
            own = own[np.argsort(ids[first[sets[own]]], kind="stable")]
            sent[own[1:]], marks[own[0]] = False, 1
            for column, value in zip(rows, (-1, blob(keys[own[:1]]), None, blob(ids[first[sets[own]]]), None, None, None, None)):
                column.append(value)
        keys, sets, marks = keys[sent], sets[sent], marks[sent]
        for values in _dealt(keys, first[sets], marks, _bucket_of(keys, buckets, coarse), ids, sizes, tag, tag2):
            for column, value in zip(rows, values):
                column.append(value)
        yield from _batch(_SKETCH, rows).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches("jaccard")
        parts, held = [], 0
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for s, e in steps(offsets):
                hashes, sets = shingle_sets(data[offsets[s] : offsets[e]], offsets[s : e + 1] - offsets[s], k)
                own = batch.column(0).slice(s, e - s)
                parts.append((own.fill_null(0).to_numpy(), own.is_valid().to_numpy(zero_copy_only=False), hashes, np.diff(sets)))
                held += int(offsets[e] - offsets[s])
                if held >= GATHER_BYTES:
                    yield from emit(parts)
                    parts, held = [], 0
        if parts:
            yield from emit(parts)

    return docs.mapInArrow(run, _SKETCH)


_MEET = "kind int, id long, valid boolean, n long, tag long, tag2 long, point binary, cell long, members array<long>"


def _meet(key: tuple, table: pa.Table, cell_members: int) -> pa.Table:
    """Cells of two sets or more, each list of members once, in slices that share the
    least member; only these carry the cell's name. Profiles pass through."""
    names = [f.split()[0] for f in _MEET.split(", ")]
    plain: dict[bytes, None] = {}
    named: dict[tuple[int, bytes], None] = {}

    def cells() -> pa.Table:
        lists = [*plain, *(x for _, x in named)]
        members = pa.array([np.frombuffer(x, np.int64) for x in lists], pa.list_(pa.int64()))
        n = len(members)
        empty = [pa.nulls(n, t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary())]
        return pa.table([pa.array(np.ones(n, np.int32)), *empty, pa.array([None] * len(plain) + [c for c, _ in named], pa.int64()), members], names=names)

    def add(own: np.ndarray, cell: int, sliced: bool) -> None:
        """Members of a cell in order; many are cut into slices."""
        if len(own) <= cell_members:
            (named if sliced else plain).setdefault((cell, own.tobytes()) if sliced else own.tobytes())
            return
        slices = -(-len(own) // cell_members)
        which = mix(own[1:].view(U64)) % U64(slices)
        for x in range(slices):
            named.setdefault((cell, np.append(own[0], own[1:][which == U64(x)]).tobytes()))

    if key[0].as_py() < 0:
        slices = table.filter(pc.is_valid(table.column("keys")))
        for k, own in zip(unblob(slices.column("keys"), np.int64), unblob(slices.column("ids"), np.int64)):
            add(own, int(k[0]), True)
        table = table.filter(pc.is_null(table.column("keys")))
        if not len(table):
            return cells()
    got = {c: unblob(table.column(c), t) for c, t in (("ids", np.int64), ("sizes", np.int64), ("tags", np.uint64), ("tags2", np.uint64))}
    ids, sizes, tags, tags2 = (np.concatenate(got[c]) for c in ("ids", "sizes", "tags", "tags2"))
    if key[0].as_py() < 0:
        valid, points = np.concatenate(unblob(table.column("refs"), np.bool_)), b"".join(v.as_py() for v in table.column("points"))
        n = len(ids)
        ends = np.cumsum(4 << group_bits(sizes)).tolist()
        point = [points[a:b] for a, b in zip([0, *ends], ends)]
        values = [np.zeros(n, np.int32), ids, valid, sizes, tags.view(np.int64), tags2.view(np.int64)]
        profiles = pa.table([*map(pa.array, values), pa.array(point, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64()))], names=names)
        return pa.concat_tables([profiles, cells()])
    keys, refs = unblob(table.column("keys"), np.uint64), unblob(table.column("refs"), np.uint32)
    base = np.cumsum([0, *map(len, got["ids"])])
    doc = np.concatenate([r.astype(np.int64) + b for r, b in zip(refs, base)])
    key_ = np.concatenate(keys)
    sliced = np.unique(key_[np.concatenate(unblob(table.column("points"), np.uint8)) > 0])
    # one name for each set: its least id here
    _, group = np.unique(np.stack([tags, tags2, sizes.view(np.uint64)]), axis=1, return_inverse=True)
    group = group.ravel()
    least = np.full(group.max(initial=-1) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group, ids)
    name = least[group][doc]
    order = np.lexsort((name, key_))
    key_, name = key_[order], name[order]
    fresh = np.ones(len(key_), bool)
    fresh[1:] = (key_[1:] != key_[:-1]) | (name[1:] != name[:-1])
    key_, name = key_[fresh], name[fresh]
    starts = np.append(np.flatnonzero(np.r_[True, key_[1:] != key_[:-1]]) if len(key_) else np.empty(0, np.int64), len(key_))
    count = np.diff(starts)
    several = np.flatnonzero(count > 1)
    flagged = np.isin(key_[starts[:-1][several]], sliced)
    for c, flag in zip(several.tolist(), flagged.tolist()):
        add(name[starts[c] : starts[c + 1]], int(key_[starts[c]].view(np.int64)), flag)
    return cells()


_EDGES = "a long, b long"


def _edges(ids: np.ndarray, label: np.ndarray) -> pa.Table:
    """An edge to its label's first for each that has another's label."""
    other = np.flatnonzero(ids != ids[label])
    return pa.table({"a": ids[other], "b": ids[label[other]]})


def _close(cells: DataFrame, points: DataFrame, num: int, den: int) -> DataFrame:
    """Edges that connect, in each cell (`members`), what pairs within the bound connect.
    Cells with the same least member meet in one task, where a point is sent once."""
    entries = cells.agg(F.sum(F.size("members"))).first()[0] or 0
    tasks = max(8, int(entries) // TASK_ENTRIES)
    lists = cells.select(F.pmod(F.xxhash64(F.col("members")[0], F.when(F.col("cell").isNotNull(), F.xxhash64("members"))), F.lit(tasks)).alias("task"), "members")
    wanted = lists.select("task", F.explode("members").alias("id")).distinct().join(points, "id").select((F.col("task") + 0).alias("task"), "id", "n", "point")

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("id")
        ids, sizes = right.column("id").to_numpy(), right.column("n").to_numpy()
        points = np.frombuffer(b"".join(v.as_py() for v in right.column("point")), np.uint32)
        bits = group_bits(sizes)
        base = np.append(0, np.cumsum(1 << bits))
        root = np.searchsorted(ids, ids)  # rows with equal ids are one node
        members = left.column("members").combine_chunks()
        flat, ends = members.flatten().to_numpy(), np.append(0, np.cumsum(members.value_lengths().to_numpy()))
        low, high = np.searchsorted(ids, flat), np.searchsorted(ids, flat, side="right")
        at, cell = ragged(low, high - low), np.repeat(np.repeat(np.arange(len(members)), np.diff(ends)), high - low)
        starts = np.searchsorted(cell, np.arange(len(members) + 1))
        least = np.minimum.reduceat(bits[at], starts[:-1]) if len(at) else np.empty(0, np.int64)
        size = np.diff(starts)
        for c in sorted(np.flatnonzero(size > FAN_OUT).tolist(), key=lambda c: -size[c]):
            own = at[starts[c] : starts[c + 1]]
            if (root[own] != root[own[0]]).any():
                label = root[own]
                sweep(folded(points, base, bits, own, int(least[c])), sizes[own], label, num, den)
                unite(root, own, label)
        for b in np.unique(least).tolist():
            small = np.flatnonzero((size <= FAN_OUT) & (least == b))
            ahead = np.append(0, np.cumsum(size[small]))
            k = 0
            while k < len(small):  # some cells at a time
                e = max(k + 1, int(np.searchsorted(ahead, ahead[k] + (1 << 23 >> b), side="right")) - 1)
                own = at[ragged(starts[:-1][small[k:e]], size[small[k:e]])]
                which = np.repeat(np.arange(e - k), size[small[k:e]])
                rows, row = np.unique(own, return_inverse=True)
                point = folded(points, base, bits, rows, b)
                for shift in range(1, min(FAN_OUT, len(own))):
                    i = np.flatnonzero((which[shift:] == which[:-shift]) & (root[own[shift:]] != root[own[:-shift]]))
                    x, y = own[i], own[i + shift]
                    good = np.flatnonzero(linkable(sizes[x], sizes[y], num, den))
                    i, x, y = i[good], x[good], y[good]
                    good = np.minimum(point[row[i]], point[row[i + shift]]).sum(axis=1) >= overlap_needed(sizes[x], sizes[y], num, den)
                    unite(root, x[good], y[good])
                k = e
        return _edges(ids, root)

    def call(left: pa.Table, right: pa.Table) -> pa.Table:
        release_caches("jaccard")
        return join(left, right) if left.num_rows and right.num_rows else _edges(np.empty(0, np.int64), np.empty(0, np.int64))

    return lists.groupBy("task").cogroup(wanted.groupBy("task")).applyInArrow(call, _EDGES)


def _few(df: DataFrame) -> DataFrame:
    """Broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def _tiles(rows: DataFrame, limit: int) -> DataFrame:
    """(grp, x, y, id): pairs of slices that cover all pairs of different parts of each
    group of the rows (grp, id, part, weight). The largest part has slices of its own."""
    parts = rows.groupBy("grp", "part").agg(F.sum("weight").alias("w"))
    largest = parts.groupBy("grp").agg(F.max_by("part", "w").alias("largest"), F.count("*").alias("parts"), F.sum("w").alias("w"), F.max("w").alias("top")).filter("parts > 1")
    largest = materialise(largest.select("grp", "largest", F.ceil(F.col("top") / limit).alias("inner"), F.ceil((F.col("w") - F.col("top")) / limit).alias("outer")), "groups")
    spread = F.xxhash64("id", F.lit(7))
    sliced = rows.join(_few(largest), "grp").select(
        "grp", "id", "part", F.when(F.col("part") == F.col("largest"), -1 - F.pmod(spread, F.col("inner"))).otherwise(F.pmod(spread, F.col("outer"))).alias("s")
    )
    sliced = materialise(sliced, "slices")
    pure = sliced.groupBy("grp", "s").agg(F.min("part").alias("low"), F.max("part").alias("high"))
    a, b = pure.toDF("grp", "x", "low", "high"), pure.toDF("grp", "y", "low2", "high2")
    pairs = a.join(b, "grp").filter("x <= y and not (low = high and low2 = high2 and low = low2)")
    ends = pairs.select("grp", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("s"))
    return sliced.join(ends, ["grp", "s"]).select("grp", "x", "y", "id")


def _sets_of(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, members) of the documents with these ids."""
    wanted = docs.join(_few(ids), "id", "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches("jaccard")
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for s, e in steps(offsets):
                hashes, at = shingle_sets(data[offsets[s] : offsets[e]], offsets[s : e + 1] - offsets[s], k)
                own = [hashes[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s, e - s), pa.array(own, pa.binary())], names=["id", "members"])

    return wanted.mapInArrow(sets, "id long, members binary")


def _linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """Whether two sorted sets link."""
    if len(x) > len(y):
        x, y = y, x
    if num * len(y) > den * len(x):
        return False
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = int((y[at] == x).sum())
    return den * both >= num * (len(x) + len(y) - both)


def link_sets(own: list[np.ndarray], label: np.ndarray, num: int, den: int) -> None:
    """Give one label to the sets that links connect."""
    if len(own) <= FAN_OUT:
        for i in range(1, len(own)):
            for j in range(i):
                if label[i] != label[j] and _linked(own[i], own[j], num, den):
                    label[(label == label[i]) | (label == label[j])] = min(label[i], label[j])
        return
    sizes = np.array([len(x) for x in own], np.int64)
    hashes, offsets = np.concatenate(own), np.append(0, np.cumsum(sizes))
    shingles, word = np.unique(hashes, return_inverse=True)
    mine = np.zeros(len(shingles), np.uint8)
    bits = group_bits(sizes)
    point = folded(count_points(hashes, offsets), np.append(0, np.cumsum(1 << bits)), bits, np.arange(len(own)), int(bits.min()))

    def links(q: int, others: np.ndarray) -> np.ndarray:
        mine[word[offsets[q] : offsets[q + 1]]] = 1
        good = []
        for k in range(0, len(others), 2048):
            part = others[k : k + 2048]
            n = sizes[part]
            both = np.add.reduceat(mine[word[ragged(offsets[part], n)]], np.cumsum(n) - n, dtype=np.int64)
            good.append(den * both >= num * (sizes[q] + n - both))
        mine[word[offsets[q] : offsets[q + 1]]] = 0
        return np.concatenate(good)

    sweep(point, sizes, label, num, den, links)


def _verified(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Edges that connect what links connect in each group of the rows (grp, x, y, id, members)."""

    def join(table: pa.Table) -> pa.Table:
        release_caches("jaccard")
        table = table.sort_by([("grp", "ascending"), ("x", "ascending"), ("y", "ascending"), ("id", "ascending")])
        grp, x, y, ids = (table.column(c).to_numpy() for c in ("grp", "x", "y", "id"))
        sets = [np.frombuffer(m.as_py(), U64) for m in table.column("members")]
        new = np.ones(len(ids), bool)
        new[1:] = (grp[1:] != grp[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        starts = np.append(np.flatnonzero(new), len(ids)).tolist()
        out = [pa.table({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})]
        for s, e in zip(starts[:-1], starts[1:]):
            label = np.searchsorted(ids[s:e], ids[s:e])
            link_sets(sets[s:e], label, num, den)
            out.append(_edges(ids[s:e], label))
        return pa.concat_tables(out)

    return rows.groupBy("task").applyInArrow(join, _EDGES)


def _links(rows: DataFrame, places: DataFrame, points: DataFrame, k: int, num: int, den: int, slice_shingles: int) -> DataFrame:
    """Edges that connect what links connect, given the neighbourhoods (vertex, component)."""
    member = places.join(points.select(F.col("id").alias("vertex"), F.col("n").alias("weight")), "vertex")
    member = materialise(member.select(F.col("component").alias("grp"), F.col("vertex").alias("id"), "weight"), "members")
    total = int(member.agg(F.sum("weight")).first()[0] or 0)
    tasks = max(8, total // TASK_SHINGLES)
    sets = materialise(_sets_of(rows, member.select("id").distinct(), k), "sets")
    weights = member.groupBy("grp").agg(F.sum("weight").alias("w")).filter(F.col("w") > slice_shingles)
    weights = materialise(weights.select("grp", F.ceil(F.col("w") / slice_shingles).alias("slices")), "weights")
    # each slice with the neighbourhood's least member, which names it
    slices = F.coalesce("slices", F.lit(1).cast("long"))
    everywhere = F.sequence(F.lit(0).cast("long"), slices - 1)
    own = F.when(F.col("id") == F.col("grp"), everywhere).otherwise(F.array(F.pmod(F.xxhash64("id", F.lit(3)), slices)))
    sliced = member.join(_few(weights), "grp", "left").select("grp", "id", F.explode(own).alias("x"))
    task = F.pmod(F.xxhash64("grp", "x", "y"), F.lit(tasks)).alias("task")
    met = sliced.withColumn("y", F.col("x")).join(sets, "id").select(task, "grp", "x", "y", "id", "members")
    links = materialise(_verified(met, num, den), "links")
    if weights.isEmpty():
        discard(member, sets, weights)
        return links
    parts = materialise(connected_components(links, "a", "b"), "parts")
    large = member.join(_few(weights), "grp", "left_semi").join(parts, F.col("id") == F.col("vertex"), "left")
    tiles = _tiles(large.select("grp", "id", F.coalesce("component", "id").alias("part"), "weight"), slice_shingles)
    more = _verified(tiles.join(sets, "id").select(task, "grp", "x", "y", "id", "members"), num, den)
    return materialise(links.unionByName(more), "links")


def _by_name(df: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """The column's ids replaced by the names (copy, least) of their sets."""
    return df.join(names, F.col(column) == F.col("copy"), "left").withColumn(column, F.coalesce("least", column)).drop("copy", "least")


def _neighbourhoods(cells: DataFrame, profile: DataFrame, points: DataFrame, num: int, den: int, cell_members: int) -> DataFrame:
    """(vertex, component) of what pairs within the bound connect. Members of sliced cells
    may be copies of a set's least document: they get its name first."""
    edges = materialise(_close(cells, points, num, den), "close")
    sliced = cells.filter("cell is not null")
    if not sliced.isEmpty():
        rows = materialise(sliced.select(F.col("cell").alias("grp"), F.explode("members").alias("id")).distinct(), "sliced")
        named = _least(profile).withColumnsRenamed({"t": "t_", "t2": "t2_", "size": "size_"})
        copies = profile.join(rows.select("id").distinct(), "id", "left_semi").join(named, (F.col("tag") == F.col("t_")) & (F.col("tag2") == F.col("t2_")) & (F.col("n") == F.col("size_")))
        names = materialise(copies.filter("id <> least").select(F.col("id").alias("copy"), "least").distinct(), "copies")
        names = _few(names)
        edges = materialise(_by_name(_by_name(edges, "a", names), "b", names), "close")
        rows = _by_name(rows, "id", names).distinct()
        parts = materialise(connected_components(edges, "a", "b"), "parts")
        rows = rows.join(parts, F.col("id") == F.col("vertex"), "left").select("grp", "id", F.coalesce("component", "id").alias("part"), F.lit(1).alias("weight"))
        tiles = _tiles(rows, cell_members).groupBy("grp", "x", "y").agg(F.sort_array(F.collect_list("id")).alias("members"))
        tiles = materialise(tiles.select(F.col("grp").alias("cell"), "members"), "tiles")
        edges = materialise(edges.unionByName(_close(tiles, points, num, den)), "close")
    return materialise(connected_components(edges, "a", "b"), "places")


def _least(profile: DataFrame) -> DataFrame:
    """The least document of each set, which is named by digests and size, and its copies."""
    usable = profile.filter("valid and n > 0")
    return usable.groupBy(F.col("tag").alias("t"), F.col("tag2").alias("t2"), F.col("n").alias("size")).agg(F.min("id").alias("least"), F.count("*").alias("copies"))


def similar_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100, coarse: int = COARSE, block_members: int = BLOCK_MEMBERS, cell_members: int = CELL_MEMBERS, slice_shingles: int = SLICE_SHINGLES) -> DataFrame:
    """Per document: id, n_shingles and component_id (least id reachable by links). The
    last four bound the buckets that a block sends to, and the slices that cells and neighbourhoods are cut into; the result
    doesn't depend on them."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    total = table_bytes(rows)
    buckets = max(24, total >> 25)
    met = _sketch(rows, k, num, den, buckets, coarse, block_members)
    if buckets > coarse:
        met = _split(met, buckets, coarse, max(coarse, total >> 30))
    # profiles are of all documents: they're dealt out by their own salt, not to one task
    salt = F.when(F.col("bucket") < 0, -1 - F.pmod(F.xxhash64("ids"), F.lit(buckets))).otherwise(F.col("bucket"))

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        release_caches("jaccard")
        return _meet(key, table, cell_members)

    met = materialise(met.withColumn("bucket", salt).groupBy("bucket").applyInArrow(meet, _MEET), "cells")
    profile = met.filter("kind = 0").select("id", "valid", "n", "tag", "tag2", "point")
    cells = materialise(met.filter("kind = 1").select("cell", "members").distinct(), "cell-lists")
    points = profile.filter("valid and n > 0").select("id", "n", "point")
    places = _neighbourhoods(cells, profile, points, num, den, cell_members)
    links = _links(rows, places, points, k, num, den, slice_shingles)
    parts = materialise(connected_components(links, "a", "b"), "parts")
    discard(cells, places, links)
    usable = F.col("valid") & (F.col("n") > 0)
    named = _least(profile).join(parts, F.col("least") == F.col("vertex"), "left").select("t", "t2", "size", F.coalesce("component", "least").alias("name"), "copies", "component")
    # sets without a copy or a link need no name; the others are broadcast if they're few
    named = materialise(named.filter("copies > 1 or component is not null").select("t", "t2", "size", "name"), "names")
    out = profile.join(_few(named), usable & (F.col("tag") == F.col("t")) & (F.col("tag2") == F.col("t2")) & (F.col("n") == F.col("size")), "left")
    return out.select(
        F.when(F.col("valid"), F.col("id")).alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("valid"), F.coalesce("name", "id")).alias("component_id"),
    )
