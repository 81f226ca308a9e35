"""Incremental deduplication of word windows over a log-structured fingerprint index
(operator 10).

The index is a list of immutable runs in the shared folder. A run holds, for every
bucket, the sorted fingerprints of one or more batches of documents with the blocks
they are in; a window's fingerprint is its anchor (see spans). A new batch becomes a
sorted run of its own, which is merge-joined, bucket by bucket, with the historical runs,
none of which moves: matches mark the blocks, old and new, that hold a repeating fingerprint. When a level
has `fan_in` runs, they're compacted into one run of the next level before the next batch. Marked windows
are then compared word by word, and only windows that truly start twice count.

`dedup_batch` adds a batch to an index that lives on: beside the runs it keeps each
batch's texts by block and, for each document, which words went. A new batch reads the old
texts of marked blocks alone, and its result names the old documents that lose words
because of it. Every place of a fingerprint that the batch repeats is at hand, so all its
windows are judged anew; what older batches decided on other fingerprints stands. A batch
counts once its result is written: one that was cut off is done again from its start, and
one that ended gives its result again. `dedup_windows` takes a whole table, in batches whose
texts needn't be kept.

Edge cases: null text has no words; texts shorter than a window lose nothing; a window
that repeats inside one document is removed, both times; repeated ids are documents of
their own; the order of batches doesn't change what is left in the end; an empty batch is
a batch; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import repeats
from .common import release_caches, remove_dir, work_dir
from .repeats import KEYS, Windows, _batch, _with_left_key
from .spans import Prefix, Units, block_count, bucket_count, blob, by_key, contains, equal_groups, in_blocks, mix, ragged, unblob

#: Files of a run at most.
MOST_FILES = 1024
RUN = "bucket long, keys binary, owners binary, counts binary"


class FingerprintIndex:
    """Sorted immutable runs below `path`; a run's folder is named by its level and
    number, and counts once its write has ended. `buckets` must stay the same: choose it
    for the index at its largest, so that a bucket's keys (13 bytes each) fit a task.

    Runs are tables in the same number of files by bucket, which the catalogue knows only
    while a plan is made. A batch is dealt out by bucket once, when its run is written;
    matching it with a historical run, and merging runs, reads the files of a bucket
    side by side without moving them."""

    def __init__(self, spark: SparkSession, path: str, buckets: int, fan_in: int = 3):
        self.spark, self.path, self.buckets, self.fan_in = spark, path.rstrip("/"), buckets, fan_in
        self.files = min(buckets, MOST_FILES)

    def runs(self) -> list[tuple[int, int]]:
        """(level, number) of the finished runs."""
        done = [n for n in folder_names(self.spark, f"{self.path}/runs") if "_SUCCESS" in folder_names(self.spark, f"{self.path}/runs/{n}")]
        return sorted(tuple(map(int, n.split("-")[1:])) for n in done)

    def _read(self, folder: str) -> DataFrame:
        name = f"fingerprints_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} ({RUN}) USING parquet CLUSTERED BY (bucket) INTO {self.files} BUCKETS LOCATION '{self.path}/{folder}'")
        table = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")
        return table

    def _write(self, rows: DataFrame, folder: str) -> DataFrame:
        self._drop(folder)
        name = f"fingerprints_{uuid.uuid4().hex}"
        rows.write.format("parquet").option("path", f"{self.path}/{folder}").bucketBy(self.files, "bucket").saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")
        return self._read(folder)

    def _drop(self, folder: str) -> None:
        remove_dir(self.spark, f"{self.path}/{folder}")

    def matches(self, new: DataFrame, old: DataFrame) -> DataFrame:
        """Keys that both runs hold, by block, of either run."""
        return new.groupBy("bucket").cogroup(old.groupBy("bucket")).applyInArrow(_merge_join, KEYS)

    def add(self, anchors: DataFrame, number: int) -> DataFrame:
        """Add a batch's anchors as run `number`, in place of what a batch of this number left
        that was cut off; returns the keys that repeat, by block: those of the batch, and
        those of history that the batch repeats."""
        self._drop(f"runs/run-0-{number}")
        self.compact()
        before = self.runs()
        dealt = anchors.repartition(self.files, "bucket")
        new = self._write(dealt.groupBy("bucket").applyInArrow(_sorted_run, RUN), f"runs/run-0-{number}")
        found = new.mapInArrow(_repeats, KEYS)
        for level, n in before:
            found = found.unionByName(self.matches(new, self._read(f"runs/run-{level}-{n}")))
        found.write.mode("overwrite").parquet(f"{self.path}/found-{number}")
        return self.spark.read.schema(KEYS).parquet(f"{self.path}/found-{number}")

    def compact(self) -> None:
        """Merge the runs of each full level into one of the next, two at a time."""
        while True:
            runs = self.runs()
            full = [level for level in {x for x, _ in runs} if sum(level == x for x, _ in runs) >= self.fan_in]
            if not full:
                return
            level = min(full)
            own = [f"runs/run-{x}-{n}" for x, n in runs if x == level]
            number, merged = max(n for x, n in runs if x == level), own[0]
            for k, run in enumerate(own[1:], 2):
                rows = self._read(merged).groupBy("bucket").cogroup(self._read(run).groupBy("bucket")).applyInArrow(_merge_runs, RUN)
                to = f"runs/run-{level + 1}-{number}" if k == len(own) else f"merge-{level}-{number}-{k}"
                self._write(rows, to)
                if k > 2:
                    self._drop(merged)
                merged = to
            for run in own:
                self._drop(run)


def _columns(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kinds = (("keys", np.uint32), ("owners", np.int64), ("counts", np.uint16))
    return tuple(np.concatenate([np.empty(0, t), *unblob(table.column(c), t)]) for c, t in kinds)


def _sorted_run(key: tuple, table: pa.Table) -> pa.Table:
    keys, owners, counts = [], [], []
    for block, once, often, n in zip(table.column("block").to_pylist(), *(unblob(table.column(c), t) for c, t in (("once", np.uint32), ("more", np.uint32), ("counts", np.uint16)))):
        keys += [once, often]
        owners.append(np.full(len(once) + len(often), block))
        counts += [np.ones(len(once), np.uint16), n]
    keys, owners, counts = np.concatenate(keys), np.concatenate(owners), np.concatenate(counts)
    order = np.lexsort((owners, keys))
    return _batch(RUN, [[key[0].as_py()], [blob(keys[order])], [blob(owners[order])], [blob(counts[order])]])


def _merge_runs(key: tuple, one: pa.Table, other: pa.Table) -> pa.Table:
    """Two sorted runs of a bucket as one; the sort merges what is in order already."""
    columns = [np.concatenate(pair) for pair in zip(_columns(one), _columns(other))]
    order = np.argsort(columns[0], kind="stable")
    return _batch(RUN, [[key[0].as_py()], *([blob(c[order])] for c in columns)])


def _by_block(bucket: int, keys: np.ndarray, owners: np.ndarray, counts: np.ndarray) -> list[tuple]:
    order, starts = by_key(owners)
    out = []
    for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
        own, first = np.unique(keys[order[s:e]], return_index=True)
        out.append((int(owners[order[s]]), bucket, blob(own), blob(counts[order[s:e]][first]), b""))
    return out


def _keys_table(rows: list[tuple]) -> pa.Table:
    return _batch(KEYS, [list(c) for c in zip(*rows)] if rows else [[] for _ in KEYS.split(", ")])


def _with_hot(keys: DataFrame, most: int) -> DataFrame:
    """The keys with those marked that have more places than `most`."""

    def mark(table: pa.Table) -> pa.Table:
        own, counts = unblob(table.column("keys"), np.uint32), unblob(table.column("counts"), np.uint16)
        hot = repeats.hot_keys(own, counts, most)
        marked = pa.array([blob(k[np.isin(k, hot)]) for k in own], pa.binary())
        return table.drop_columns(["counts", "hot"]).append_column("counts", pa.array([b""] * len(own), pa.binary())).append_column("hot", marked)

    return keys.groupBy("bucket").applyInArrow(mark, KEYS)


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys that a run holds more than once, by block."""
    for batch in batches:
        table, rows = pa.Table.from_batches([batch]), []
        for r in range(len(table)):
            keys, owners, counts = _columns(table.slice(r, 1))
            equal = keys[1:] == keys[:-1]
            again = counts > 1
            again[1:] |= equal
            again[:-1] |= equal
            rows += _by_block(table.column("bucket")[r].as_py(), keys[again], owners[again], counts[again])
        yield from _keys_table(rows).to_batches()


def _merge_join(key: tuple, new: pa.Table, old: pa.Table) -> pa.Table:
    """Keys of a bucket that both sorted runs hold, with the blocks of either."""
    keys, owners, counts = _columns(new)
    past, past_owners, past_counts = _columns(old)
    if not len(keys) or not len(past):
        return _keys_table([])
    here, there = contains(past, keys), contains(keys, past)
    return _keys_table(_by_block(key[0].as_py(), np.concatenate([keys[here], past[there]]), np.concatenate([owners[here], past_owners[there]]), np.concatenate([counts[here], past_counts[there]])))


def repeated_windows(units: Units, prefix: Prefix, first: np.ndarray, windows: np.ndarray, group: np.ndarray, low: np.ndarray, count: np.ndarray, length: int) -> np.ndarray:
    """1 for each window whose words start at two places or more."""
    ends = np.cumsum(windows)
    value = np.repeat((count > 1).astype(np.int64), windows)
    own = np.flatnonzero(~((np.bincount(group)[group] == 1) & (count > 1)))
    if not len(own):
        return value
    starts = ragged(first[own], windows[own])
    slots = ragged(ends[own] - windows[own], windows[own])
    weight, groups = np.repeat(count[own], windows[own]), np.repeat(group[own], windows[own])
    if not len(slots):
        return value
    hashes = mix(prefix.of(starts, length)) ^ mix(groups.astype(np.uint64) + np.uint64(1))
    order, bounds, _ = equal_groups(hashes, units.data, *units.stretch(starts, np.full(len(starts), length)))
    total = np.add.reduceat(weight[order], bounds[:-1])
    value[slots[order]] = np.repeat(total, np.diff(bounds)) > 1
    return value


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, which may be missing."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []


_CUT = "block long, batch string, id long, place long, n_words long, n_removed long, kept_sha256 string, kept binary, gone binary, changed boolean"


def _removed(texts: DataFrame, keys: DataFrame, windows: Windows, buckets: int, hot_places: int, with_text: bool, before: DataFrame | None = None) -> DataFrame:
    """Each text with the words that go: those of windows that start twice, of the keys
    given, and those that went `before` (block, place, gone)."""

    length, stored = windows.length, before is not None

    def judge(*args):
        return repeated_windows(*args, length)

    def cut(key: tuple, table: pa.Table, found: pa.Table) -> pa.Table:
        release_caches("repeats")
        rows: list[list] = [[] for _ in _CUT.split(", ")]
        ids, batch, places = (table.column(c).to_pylist() for c in ("id", "batch", "place"))
        past: dict[int, list[bytes]] = {}
        if stored:
            for place, bits in zip(found.column("place").to_pylist(), found.column("gone").to_pylist()):
                past.setdefault(place, []).append(bits)
            found = found.filter(pc.is_valid(found.column("hash")))
        for start, end, units, gone in repeats.removed_symbols(table, found, windows, buckets, lambda value, own: value == 1):
            new = gone.copy()
            for r in range(start, end):
                own = slice(units.offsets[r - start], units.offsets[r - start + 1])
                for bits in past.get(places[r], ()):
                    old = np.unpackbits(np.frombuffer(bits, np.uint8), count=own.stop - own.start).astype(bool)
                    new[own] &= ~old
                    gone[own] |= old
            stay = np.flatnonzero(~gone)
            size = units.ends[stay] - units.begins[stay] + 1
            kept = units.data[ragged(units.begins[stay], size)].tobytes()
            at = np.append(0, np.cumsum(size))[np.searchsorted(stay, units.offsets)].tolist()
            count = lambda x: np.diff(np.append(0, np.cumsum(x))[units.offsets])  # noqa: E731, B023
            own = [kept[a : max(a, b - 1)] for a, b in zip(at[:-1], at[1:])]
            bits = [np.packbits(gone[a:b]).tobytes() if n else None for a, b, n in zip(units.offsets[:-1], units.offsets[1:], count(gone))]
            values = [[key[0].as_py()] * (end - start), batch[start:end], ids[start:end], places[start:end], np.diff(units.offsets).tolist(), count(gone).tolist(), [hashlib.sha256(x).hexdigest() for x in own]]
            values += [own if with_text else [None] * len(own), bits if stored else [None] * len(own), (count(new) > 0).tolist()]
            for column, value in zip(rows, values):
                column += value
        return _batch(_CUT, rows)

    found = repeats.verdicts(repeats.segments(texts, _with_hot(keys, hot_places), windows, buckets), windows, buckets, judge)
    if before is not None:
        found = found.unionByName(before, allowMissingColumns=True)
    return texts.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_with_left_key(cut, _CUT), _CUT)


def dedup_windows(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 35, k: int = 8, batches: int = 3, fan_in: int = 2, with_text: bool = False, hot_places: int = repeats.HOT_PLACES
) -> DataFrame:
    """Per document: id, n_words, n_removed and kept_sha256 of the words that stay,
    joined by one space (and this text, if asked for). Windows around an anchor in more than
    `hot_places` places are spread; the result doesn't depend on it."""
    spark = docs.sparkSession
    windows = Windows(True, length, k)
    blocks = block_count(docs.select(id_col, text_col))
    texts = in_blocks(docs, blocks, id_col, text_col).withColumns({"place": F.lit(0).cast("long"), "batch": F.lit("")})
    index = FingerprintIndex(spark, work_dir(spark, "fingerprints"), bucket_count(docs.select(id_col, text_col), blocks, 4), fan_in)
    keys = spark.createDataFrame([], KEYS)
    for b in range(batches):
        keys = keys.unionByName(index.add(repeats.anchors(texts.filter(F.col("block") % batches == b), windows, index.buckets, across_docs=False), b))
    out = _removed(texts, keys, windows, index.buckets, hot_places, with_text)
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", "kept_sha256", *(["kept"] if with_text else []))


def dedup_batch(
    docs: DataFrame, folder: str, batch: str, *, id_col: str = "doc_id", text_col: str = "text", length: int = 35, k: int = 8, buckets: int = 64, fan_in: int = 3, hot_places: int = repeats.HOT_PLACES
) -> DataFrame:
    """Add a batch to the index in `folder`. Per document of the batch, and per document of
    an older batch that loses words because of it: batch, id, n_words, n_removed,
    kept_sha256 and kept (the words that stay), counted over all batches so far. Windows and
    `buckets` are those with which the index began."""
    spark, windows, folder = docs.sparkSession, Windows(True, length, k), folder.rstrip("/")
    known = [n for n in folder_names(spark, folder) if n.startswith(f"windows-{length}-{k}-")]
    root = f"{folder}/{known[0] if known else f'windows-{length}-{k}-{buckets}'}"
    index = FingerprintIndex(spark, root, int(root.rsplit("-", 1)[1]), fan_in)
    name = hashlib.sha256(batch.encode()).hexdigest()[:16]
    numbers = {n.split("-")[1]: int(n.split("-")[0]) for n in folder_names(spark, f"{root}/texts")}
    ended = {n for n in numbers.values() if "_SUCCESS" in folder_names(spark, f"{root}/results/{n}")}
    number = numbers.get(name, len(numbers))
    if number not in ended:
        for level, n in index.runs():
            if level == 0 and n not in ended:  # of a batch that was cut off
                index._drop(f"runs/run-0-{n}")
        rows = in_blocks(docs, block_count(docs.select(id_col, text_col)), id_col, text_col).withColumn("block", F.col("block") + (number << 32))
        rows = rows.withColumns({"place": F.monotonically_increasing_id(), "batch": F.lit(batch)})
        paths = {n: f"{root}/texts/{n}-{x}" for x, n in numbers.items() if n in ended} | {number: f"{root}/texts/{number}-{name}"}
        rows.repartition("block").write.mode("overwrite").partitionBy("block").parquet(paths[number])
        texts_of = lambda n: spark.read.schema("id long, text string, place long, batch string, block long").parquet(paths[n])
        texts, past = texts_of(number), spark.createDataFrame([], "block long, place long, gone binary")
        keys = index.add(repeats.anchors(texts, windows, index.buckets, across_docs=False), number)
        hit = F.broadcast(keys.filter(F.col("block") < number << 32).groupBy("block").agg(F.count("*").alias("n")).filter("n > 0").select("block"))  # a long for each block
        for n in sorted(ended):
            texts = texts.unionByName(texts_of(n).join(hit, "block", "left_semi"))
            past = past.unionByName(spark.read.parquet(f"{root}/results/{n}").filter("gone is not null").select("block", "place", "gone").join(hit, "block", "left_semi"))
        cut = _removed(texts, keys, windows, index.buckets, hot_places, True, past)
        cut.filter((F.col("block") >= number << 32) | F.col("changed")).write.mode("overwrite").parquet(f"{root}/results/{number}")
    return spark.read.parquet(f"{root}/results/{number}").select("batch", F.col("id").alias(id_col), "n_words", "n_removed", "kept_sha256", "kept")
