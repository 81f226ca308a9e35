"""CSV files read by many tasks, with line breaks inside quotes.

Spark's text source cuts a file into blocks of lines, but whether a line begins inside
quotes depends on all lines before it. Two passes settle that. The first one maps each
block to what it does to this state, as if it began outside and as if it began inside
quotes (lines without a quote do nothing and stay in the JVM); a window over a row for
each block composes these, which gives each block's first state. The second pass puts the
lines of each block together to records; the record that a block's last line leaves open is
completed by the first lines of the next ones and takes its place in the order of the
file. Records are then parsed by `from_csv`.

A quote opens a field only at its beginning and closes it only before a separator or the
end of a line; a backslash escapes inside quotes. Empty lines outside quotes are skipped. Line breaks
inside quotes become `\\n`. Compressed files are one block each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators.ordered import positions
from .documents import first_bytes
from .work import materialise

#: Blocks that may begin inside quotes at most, of which each is broadcast (two longs), and
#: most bytes of the records that they complete.
MOST_BLOCKS, BROADCAST_BYTES = 1_000_000, 32 << 20
_BLOCK = ["file", "block"]


def _closes(line: str, at: int, sep: str) -> int:
    """The place behind the quote that closes a field, from inside it; -1 if none does."""
    while True:
        quote, escape = line.find('"', at), line.find("\\", at)
        if quote < 0:
            return -1
        if 0 <= escape < quote:
            at = escape + 2
            continue
        if quote + 1 == len(line) or line.startswith(sep, quote + 1):
            return quote + 1
        at = quote + 1


def stays_open(line: str, inside: bool, sep: str) -> bool:
    """Whether the end of a line lies inside quotes, if its beginning does or doesn't."""
    at = 0
    while True:
        if inside:
            at = _closes(line, at, sep)
            if at < 0:
                return True
            at += len(sep)  # behind the separator; behind the end, if there's none
        if at >= len(line) and (inside or at):
            return False
        if not line.startswith('"', at):  # an unquoted field: its quotes are text
            at = line.find(sep, at)
            if at < 0:
                return False
            at, inside = at + len(sep), False
            continue
        at, inside = at + 1, True


def _lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """file (a hash of its path), block and the lines of each block in their order."""
    raw = spark.read.text(path, lineSep="\n")
    crlf = first_bytes(spark, path).split(b"\n", 1)[0].endswith(b"\r")
    text = F.col("value") if encoding.lower() in ("utf-8", "utf8") else F.decode(F.col("value").cast("binary"), encoding)
    return raw.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), (F.regexp_replace(text, "\r$", "") if crlf else text).alias("line"))


def _stretches(b: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], int, int]]:
    """Consecutive rows of one block: (file, block), first row and the one behind the last."""
    file, block = b.column(0).to_numpy(), b.column(1).to_numpy()
    at = np.flatnonzero(np.r_[True, (file[1:] != file[:-1]) | (block[1:] != block[:-1])]).tolist() if len(b) else []
    for begin, end in zip(at, [*at[1:], len(b)]):
        yield (int(file[begin]), int(block[begin])), begin, end


def _effects(lines: DataFrame, sep: str) -> DataFrame:
    """Per block: the state behind it, if it begins outside and inside quotes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, (False, True)
        for b in batches:
            for own, begin, end in _stretches(b):
                if key != own:
                    if key:
                        yield row(key, state)
                    key, state = own, (False, True)
                for line in b.column(2).slice(begin, end - begin).drop_null().to_pylist():
                    memo = {s: stays_open(line, s, sep) for s in set(state)}
                    state = (memo[state[0]], memo[state[1]])
        if key:
            yield row(key, state)

    def row(key: tuple, state: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"file": [key[0]], "block": [key[1]], "outside": [state[0]], "within": [state[1]]})

    quoted = F.when(F.contains("line", F.lit('"')), F.col("line"))
    return lines.select(*_BLOCK, quoted.alias("line")).mapInArrow(run, "file long, block long, outside boolean, within boolean")


def _first_states(blocks: DataFrame) -> DataFrame:
    """Per block: whether it begins inside quotes. The state before a block is what the last
    block that decides it leaves, turned over by each block since that turns it over."""
    before = W.partitionBy("file").orderBy("block")  # a row for each block
    to_here, above = before.rowsBetween(W.unboundedPreceding, 0), before.rowsBetween(W.unboundedPreceding, -1)
    decides, turns = F.col("outside") == F.col("within"), F.col("outside") & ~F.col("within")
    rows = blocks.withColumn("turns", F.sum(turns.cast("int")).over(to_here))
    rows = rows.withColumn("last", F.when(decides, F.struct(F.col("outside").cast("int").alias("state"), "turns")))
    last, turned = F.last("last", ignorenulls=True).over(above), F.coalesce(F.max("turns").over(above), F.lit(0))
    rows = rows.withColumn("l", last).withColumn("t", turned)
    state = F.coalesce(F.col("l.state"), F.lit(0)) + F.col("t") - F.coalesce(F.col("l.turns"), F.lit(0))
    return rows.select(*_BLOCK, (state % 2 == 1).alias("inside"))


def _records(lines: DataFrame, states: DataFrame, sep: str) -> DataFrame:
    """file, block, nth (of the block; -1: lines that complete an earlier record), open (goes on
    in the next block) and the record's text."""
    kinds = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("nth", pa.int64()), ("open", pa.bool_()), ("record", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, inside, held, nth, rows = None, False, [], 0, []

        def ended() -> None:
            if key and (held or inside):
                rows.append((*key, nth, True, "\n".join(held)))

        def taken() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * len(kinds)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(columns, kinds)], schema=kinds)

        for b in batches:
            quoted = pc.match_substring(b.column(2), '"').to_numpy(zero_copy_only=False)
            for own, begin, end in _stretches(b):
                if key != own:
                    ended()
                    key, inside, held = own, b.column(3)[begin].as_py(), []
                    nth = -1 if inside else 0
                part = b.column(2).slice(begin, end - begin)
                if not inside and not held and not quoted[begin:end].any():  # each line is a record
                    rows += [(*key, nth + i, False, line) for i, line in enumerate(filter(None, part.to_pylist()))]
                    nth += end - begin
                    continue
                for line, q in zip(part.to_pylist(), quoted[begin:end].tolist()):
                    if not inside and not line:
                        continue
                    held.append(line)
                    if q:
                        inside = stays_open(line, inside, sep)
                    if not inside:
                        rows.append((*key, nth, False, "\n".join(held)))
                        held, nth = [], nth + 1
            yield taken()
        ended()
        yield taken()

    first = F.coalesce("inside", F.lit(False)).alias("inside")
    return lines.join(F.broadcast(states), _BLOCK, "left").select(*_BLOCK, "line", first).mapInArrow(run, "file long, block long, nth long, open boolean, record string")


def records(spark: SparkSession, path: str, sep: str, encoding: str = "utf-8") -> DataFrame:
    """(file, block, nth, record): the records of CSV files, headers among them, in the order of
    each file."""
    lines = _lines(spark, path, encoding)
    states = materialise(_first_states(_effects(lines, sep)).filter("inside"), "states")
    n = states.count()
    if n > MOST_BLOCKS:
        raise ValueError(f"{n} blocks begin inside quotes: raise spark.sql.files.maxPartitionBytes")
    found = _records(lines, states, sep)
    if not n:
        return found.drop("open")
    # what a block leaves open goes on in the next ones: their first pieces, up to one that ends
    order = W.partitionBy("file").orderBy("block", "nth").rowsBetween(W.unboundedPreceding, 0)
    pieces = found.filter("nth = -1 or open").withColumn("chain", F.sum((F.col("nth") >= 0).cast("int")).over(order))
    rest = F.array_sort(F.collect_list(F.struct("block", "nth", "record")))
    joined = pieces.groupBy("file", "chain").agg(F.min(F.struct("block", "nth")).alias("at"), F.transform(rest, lambda x: x["record"]).alias("parts"))
    joined = materialise(joined.select("file", F.col("at.block").alias("block"), F.col("at.nth").alias("nth"), F.array_join("parts", "\n").alias("all")), "joined")
    few = joined.agg(F.sum(F.octet_length("all") + 32)).first()[0] <= BROADCAST_BYTES
    whole = found.filter("nth >= 0").join(F.broadcast(joined) if few else joined, ["file", "block", "nth"], "left")
    return whole.select("file", "block", "nth", F.coalesce("all", "record").alias("record"))


def read_csv(spark: SparkSession, path: str, names: list[str], sep: str, encoding: str = "utf-8", position: str | None = None) -> DataFrame:
    """The rows below the headers, all text: missing fields are null, rows with a field too
    many are skipped. `position` names a column for each row's number in the order of the
    file, from 0 and without gaps (several files: one after the other)."""
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in [*names, "_extra", "_corrupt"])
    found = records(spark, path, sep, encoding).filter("not (block = 0 and nth = 0)")
    options = {"sep": sep, "quote": '"', "escape": "\\", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "maxCharsPerColumn": "-1"}
    rows = found.withColumn("r", F.from_csv("record", schema, options)).filter(F.col("r._extra").isNull())
    columns = [F.col(f"r.`{n}`").alias(n) for n in names]
    if position is None:
        return rows.select(*columns)
    return positions(rows.select(*_BLOCK, "nth", "r"), *_BLOCK, "nth", name="at").select(*columns, F.col("at").alias(position))
