"""Periodic runs of words (operator 11): stretches that repeat with a period, such as loops
of a generator or boilerplate said again and again.

All lags of a document, up to its words over `min_exp`, are scanned: its array of word
numbers is compared with itself shifted by the lag, and long stretches of matches are runs.
Documents lie side by side in one array, longest first, so that one comparison serves all
documents that are long enough for the lag. A stretch of `need` matches holds a place that
`need` divides, so only these places are compared at first, and stretches are run-length
encoded where one of them matches and more neighbours do: all lags of n words cost about
n log n comparisons, and no run is missed. A match inside a known run whose period divides
the lag is that run's own, and is not looked at again.

Documents of over `whole_bytes` are dealt out to the cluster by ranges of lags; their
text is sent once for each range, of which there are at most `MOST_RANGES`. All others are
scanned where they lie, in a narrow map.

Edge cases: null, empty and blank texts have no words and no runs; words are compared by
their bytes, whatever their hashes; texts of any length are scanned at all lags; a null id is
an id like others and repeated rows are documents of their own; an empty table gives an empty
result; extra columns are not read, whatever they're called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release_caches, steps, utf8
from .spans import Units, equal_groups, ragged, word_units

#: Longer texts are dealt out by lags; bytes of text for a range of lags, and ranges of a document at most.
WHOLE_BYTES, RANGE_BYTES, MOST_RANGES = 64 << 10, 32 << 10, 64
WORD = r"[\x20\x09-\x0D]+"
_RUNS = "array<struct<start:long,length:long,period:long>>"
_KIND = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def word_numbers(units: Units) -> np.ndarray:
    """A number for each word, equal for equal bytes."""
    sizes = units.ends - units.begins if len(units.codes) else np.empty(0, np.int64)
    order, starts, _ = equal_groups(units.codes, units.data, units.begins, sizes) if len(units.codes) else (np.empty(0, np.int64), np.zeros(1, np.int64), None)
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    return out


class Known:
    """Runs found so far, by their place in the array."""

    def __init__(self):
        self.rows: list[tuple[int, int, int]] = []  # start, end, least period
        self.columns = np.empty((0, 3), np.int64)

    def add(self, start: int, end: int, period: int) -> None:
        self.rows.append((start, end, period))
        self.columns = np.array(sorted(self.rows), np.int64)

    def explains(self, at: np.ndarray, lag: int) -> np.ndarray:
        """Which matches of a lag lie inside a run whose period divides it, and that is long
        enough to be the whole stretch of matches."""
        c = self.columns
        own = c[(lag % c[:, 2] == 0) & (c[:, 1] - c[:, 0] >= c[:, 2] + lag)]
        if not len(own):
            return np.zeros(len(at), bool)
        last = np.maximum.accumulate(own[:, 1] - lag)  # first places beyond the matches, of all runs up to here
        i = np.searchsorted(own[:, 0], at, side="right") - 1
        return (i >= 0) & (last[np.maximum(i, 0)] > at)


def least_period(x: np.ndarray, lag: int) -> int:
    """The least period of a stretch with period `lag` that holds it twice or more: it divides it."""
    rest, f = lag, 2
    while rest > 1:
        if f * f > rest:
            f = rest
        if rest % f:
            f += 1
            continue
        rest //= f
        if len(x) > lag // f and np.array_equal(x[lag // f :], x[: -(lag // f)]):
            lag //= f
    return lag


def scan(numbers: np.ndarray, offsets: np.ndarray, first: int, last: np.ndarray | None, min_words: int, min_exp: int) -> list[tuple[int, int, int, int]]:
    """(document, start, length, period) of all runs with a period from `first` up to the
    words over `min_exp`, or up to `last` of each document."""
    sizes = np.diff(offsets)
    most = sizes // min_exp if last is None else np.minimum(sizes // min_exp, last)
    most = np.where(sizes >= min_words, most, 0)
    order = np.argsort(-most, kind="stable")
    most = most[order]
    order = order[most >= first]
    most = most[: len(order)]
    if not len(order):
        return []
    begins = offsets[order]
    ends = np.cumsum(sizes[order])
    doc = np.repeat(np.arange(len(order)), sizes[order])
    n = int(ends[-1])
    x = np.full(n + 1, -1, np.int64)  # documents have numbers of their own; the last matches nothing
    x[:n] = numbers[ragged(begins, sizes[order])] + doc * (int(numbers.max(initial=0)) + 1)
    known, out = Known(), []
    for lag in range(first, int(most[0]) + 1):
        rows = int(np.searchsorted(-most, -lag, side="right"))  # documents that are long enough
        m = int(ends[rows - 1])
        need = max(min_words, min_exp * lag) - lag
        at = np.flatnonzero(x[: m - lag : need] == x[lag:m:need]) * need if m > lag else np.empty(0, np.int64)
        if not len(at):
            continue
        if known.rows:
            at = at[~known.explains(at, lag)]
        right, left = np.ones(len(at), bool), np.ones(len(at), bool)
        for step in range(1, need // 2 + 1):  # a stretch goes on for half its length to one side
            if not len(at):
                break
            ahead, back = np.minimum(at + step, n), np.maximum(at - step, -1)
            right &= x[ahead] == x[np.minimum(ahead + lag, n)]
            left &= (back >= 0) & (x[back] == x[np.minimum(back + lag, n)])
            live = right | left
            at, right, left = at[live], right[live], left[live]
            if step == 16 and len(at):  # what is left is likely a stretch
                break
        done = -1
        for place in at.tolist():
            if place < done:
                continue
            d = doc[place]
            begin, end = int(ends[d] - sizes[order[d]]), int(ends[d])
            unlike = np.flatnonzero(x[begin : end - lag] != x[begin + lag : end]) + begin
            i = int(np.searchsorted(unlike, place))
            start = int(unlike[i - 1]) + 1 if i else begin
            stop = int(unlike[i]) if i < len(unlike) else end - lag
            done = stop
            length = stop - start + lag
            if length < min_exp * lag or length < min_words:
                continue
            period = least_period(x[start : start + length], lag)
            known.add(start, start + length, period)
            if period == lag:
                out.append((int(order[d]), start - begin, length, lag))
    return out


def _lists(rows: list[tuple[int, int, int, int]], n: int) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in range(n)]
    for doc, start, length, period in sorted(rows, key=lambda r: (r[0], r[1], r[3])):
        out[doc].append({"start": start, "length": length, "period": period})
    return out


def collapsed(units: Units, runs: list[list[dict]]) -> list[bytes]:
    """The words of each document, without those that a run repeats, joined by spaces."""
    n, cover = len(units.codes), np.zeros(len(units.codes) + 1, np.int64)
    for d, own in enumerate(runs):
        for r in own:
            cover[units.offsets[d] + r["start"] + r["period"]] += 1
            cover[units.offsets[d] + r["start"] + r["length"]] -= 1
    stay = np.flatnonzero(np.cumsum(cover[:n]) == 0)
    size = units.ends[stay] - units.begins[stay] + 1 if n else stay
    kept = units.data[ragged(units.begins[stay], size)].tobytes() if len(stay) else b""
    at = np.append(0, np.cumsum(size))[np.searchsorted(stay, units.offsets)].tolist()
    return [kept[a : max(a, b - 1)] for a, b in zip(at[:-1], at[1:])]


def _finished(id_column: pa.Array, units: Units, runs: list[list[dict]]) -> pa.RecordBatch:
    columns = [id_column, pa.array(np.diff(units.offsets)), pa.array(runs, _KIND), pa.array(collapsed(units, runs), pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 24, min_exp: int = 3, whole_bytes: int = WHOLE_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Per document: id, n_words, runs (start, length and period of every maximal stretch of
    at least `min_words` words and `min_exp` periods, by start, then period) and collapsed (its
    words, without those that any run holds after its first period). The result doesn't depend
    on `whole_bytes` and `range_bytes`."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = f"id {kind}, n_words long, runs {_RUNS}, collapsed string"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches("periods")
        for b in batches:
            data, offsets = utf8(b.column(1))
            for start, end in steps(offsets):
                units = word_units(data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start])
                found = scan(word_numbers(units), units.offsets, 1, None, min_words, min_exp)
                yield _finished(b.column(0).slice(start, end - start), units, _lists(found, end - start))

    def lags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of a document with periods of one of its ranges of lags."""
        release_caches("periods")
        for b in batches:
            for i in range(len(b)):
                data, offsets = utf8(b.column(1).slice(i, 1))
                units = word_units(data, offsets)
                nth, of = b.column(2)[i].as_py(), b.column(3)[i].as_py()
                each = -(-(len(units.codes) // min_exp) // of)
                found = scan(word_numbers(units), units.offsets, 1 + nth * each, np.array([(nth + 1) * each]), min_words, min_exp)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array(_lists(found, 1), _KIND)], names=["name", "runs"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches("periods")
        for b in batches:
            for i in range(len(b)):
                units = word_units(*utf8(b.column(1).slice(i, 1)))
                runs = sorted((r for part in b.column(2)[i].as_py() for r in part), key=lambda r: (r["start"], r["period"]))
                yield _finished(b.column(0).slice(i, 1), units, [runs])

    size = F.octet_length("text")
    short = rows.filter(size <= whole_bytes).mapInArrow(whole, schema)
    long = materialise(rows.filter(size > whole_bytes).withColumn("name", F.monotonically_increasing_id()), "long-texts")
    of = F.least(F.lit(MOST_RANGES), F.ceil(F.octet_length("text") / range_bytes).cast("int"))
    ranges = long.select("name", "text", of.alias("of")).withColumn("nth", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    found = ranges.repartition("name", "nth").select("name", "text", "nth", "of").mapInArrow(lags, f"name long, runs {_RUNS}")
    found = found.groupBy("name").agg(F.collect_list("runs").alias("parts"))  # MOST_RANGES of a document
    joined = long.join(found, "name").select("id", "text", "parts").mapInArrow(join, schema)
    return short.unionByName(joined).withColumnRenamed("id", id_col)


def with_loops(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids and texts, of which about one in ten turns into a loop from some word on, as its
    id says: material with known runs. Null ids and texts without words stay as they are."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"), h.alias("h"))
    words = F.when(F.col("h") % 10 == 0, F.filter(F.split("text", WORD), lambda w: w != ""))
    rows = rows.select("*", F.explode(F.array(words)).alias("words"))  # a row each, so that texts are split once
    n, g = F.size("words"), F.floor(F.col("h") / 10)
    rows = rows.withColumn("n", n).withColumn("a", F.when(n > 0, g % n).cast("int")).withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int"))
    loop = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    looped = F.array_join(F.slice(F.concat(F.slice("words", F.lit(1), F.col("a")), loop), F.lit(1), F.col("n")), " ")
    return rows.select(F.col(id_col), F.when(F.col("n") > 0, looped).otherwise(F.col("text")).alias("text"))


def derived(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The greatest run by length over period and digests of all runs and of the collapsed text."""
    better = lambda r, s: r["length"] * s["period"] > s["length"] * r["period"]  # noqa: E731  the first of equal ones stays
    best = F.reduce("runs", F.get("runs", F.lit(0)), lambda s, r: F.when(better(r, s), r).otherwise(s))
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))))
    return found.withColumn("best", best).select(
        id_col, F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
