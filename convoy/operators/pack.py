"""Batches and chunks for model calls."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.work import materialise
from .joins import dimension
from .ordered import over_rows, positions, running_sum

#: Tokens of the header of each batch.
HEADER_TOKENS = len("Tickets:\n") // 4
#: Rows of a block of the order in which batches are made.
BLOCK_ROWS = 2048
#: Rows of a batch up to which every possible first row of a block is followed (so many for each).
COMPOSED_ROWS = 256
#: Most of the separators at which a text is split, the coarsest first.
SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def greedy_batches(df: DataFrame, id_col: str, tokens_col: str, limit: int = 50_000, most: int = 50, shard_col: str | None = None) -> DataFrame:
    """Batch number of each row, in the order of ids within a shard: a batch ends before a row
    that would reach the token limit or exceed `most` rows; a row over the limit is its own
    batch. Null tokens count 0; a null shard is the shard ''. Batches of up to `COMPOSED_ROWS`
    rows are made from blocks of one global order; larger ones by a fold over each shard,
    whose rows stream through it: name a column with many values."""

    def step(state: tuple[int, int, int], t: int) -> tuple[tuple[int, int, int], int]:
        batch, tokens, n = state
        if n and (tokens + t >= limit or n >= most):
            batch, tokens, n = batch + 1, HEADER_TOKENS, 0
        return (batch, tokens + t, n + 1), batch

    if most > COMPOSED_ROWS:
        return _folded(df, id_col, tokens_col, shard_col, step)
    full = lambda acc, x: (acc["tokens"] + x["tokens"] >= limit) | (acc["n"] >= most)
    return _batches(df, id_col, tokens_col, shard_col, most, full, lambda x: F.lit(HEADER_TOKENS))


def sequential_batches(df: DataFrame, id_col: str, tokens_col: str, limit: int = 50_000, most: int = 50, shard_col: str | None = None) -> DataFrame:
    """Batch number of each row, in the order of ids within a shard: a batch ends after the row
    that reaches the token limit or `most` rows; the header counts in a shard's first batch
    only. Large batches are folded, as in `greedy_batches`."""

    def step(state: tuple[int, int, int], t: int) -> tuple[tuple[int, int, int], int]:
        batch, tokens, n = state[0], state[1] + t, state[2] + 1
        return ((batch + 1, 0, 0) if tokens >= limit or n >= most else (batch, tokens, n)), batch

    if most > COMPOSED_ROWS:
        return _folded(df, id_col, tokens_col, shard_col, step)
    full = lambda acc, x: (acc["tokens"] >= limit) | (acc["n"] >= most)
    return _batches(df, id_col, tokens_col, shard_col, most, full, lambda x: F.when(x["head"], HEADER_TOKENS).otherwise(0))


def _folded(df: DataFrame, id_col: str, tokens_col: str, shard_col: str | None, step: Callable) -> DataFrame:
    """(shard, id, batch_id) by a fold over each shard in the order of ids. Rows stream
    through it sorted, so that a shard of any size needs the memory of one batch."""
    shard = F.col(shard_col) if shard_col else F.lit(0)
    kind = df.schema[id_col].dataType.simpleString()

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = object(), (0, 0, 0)
        for pdf in parts:
            out = []
            for s, t in zip(pdf["shard"], pdf["tokens"]):
                if s != current:
                    current, state = s, (0, HEADER_TOKENS, 0)
                state, batch = step(state, int(t))
                out.append(batch)
            yield pdf.assign(batch_id=out)[["shard", "id", "batch_id"]]

    rows = df.select(F.coalesce(shard.cast("string"), F.lit("")).alias("shard"), F.col(id_col).alias("id"), F.coalesce(F.col(tokens_col).cast("long"), F.lit(0)).alias("tokens"))
    out = rows.repartition("shard").sortWithinPartitions("shard", "id").mapInPandas(fold, f"shard string, id {kind}, batch_id long")
    return out.select("shard", F.col("id").alias(id_col), "batch_id")


def _batches(df: DataFrame, id_col: str, tokens_col: str, shard_col: str | None, most: int, full: Callable, header: Callable) -> DataFrame:
    """(shard, id, batch_id). The rows are cut into blocks in their order. A batch holds at most
    `most` rows, so the first start in a block is one of its first `most` rows: each block
    tells for each of these where the first start in the next block then is, and how many
    batches begin. Composing these functions, in groups of blocks, gives every block's own
    first start, from which its batches follow. No task holds more than a block or a group."""
    shard = F.coalesce(F.col(shard_col).cast("string") if shard_col else F.lit("0"), F.lit(""))
    rows = df.select(shard.alias("shard"), F.col(id_col).alias("id"), F.coalesce(F.col(tokens_col).cast("long"), F.lit(0)).alias("tokens"))
    head = lambda w: {"head": F.coalesce(F.lag("shard").over(w) != F.col("shard"), F.lit(True)), "place": F.col("__g")}
    rows = over_rows(rows, ["shard", "id"], head, before=1)
    size = max(BLOCK_ROWS, 2 * most)
    block, i = F.floor(F.col("place") / size), F.col("place") % size
    also = F.when((i < most) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))  # the first rows end the block before, too
    row = F.struct("place", "shard", "id", "tokens", "head")
    blocks = rows.withColumn("block", F.explode(also)).groupBy("block").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    blocks = materialise(blocks, "blocks")

    def walk(first: Column, starts: Column, also: Callable) -> Column:
        """From the start at row `first` to the first start behind the block: its place there (to),
        and the starts, to which `also` adds one."""
        begin = F.struct(first.cast("int").alias("i"), F.lit(0).cast("long").alias("tokens"), F.lit(0).alias("n"), starts.alias("starts"), F.lit(-1).alias("to"))

        def step(acc: Column, x: Column) -> Column:
            new = (acc["n"] == 0) | x["head"] | full(acc, x)
            begun = F.struct((acc["i"] + 1).alias("i"), (header(x) + x["tokens"]).cast("long").alias("tokens"), F.lit(1).alias("n"), also(acc["starts"], acc["i"]).alias("starts"), F.lit(-1).alias("to"))
            went = F.struct((acc["i"] + 1).alias("i"), (acc["tokens"] + x["tokens"]).alias("tokens"), (acc["n"] + 1).alias("n"), acc["starts"].alias("starts"), F.lit(-1).alias("to"))
            over = F.struct(acc["i"].alias("i"), acc["tokens"].alias("tokens"), acc["n"].alias("n"), acc["starts"].alias("starts"), (acc["i"] - size).alias("to"))
            return F.when(acc["to"] >= 0, acc).when(~new, went).when(acc["i"] < size, begun).otherwise(over)

        return F.aggregate(F.slice("rows", first + 1, F.lit(size + most)), begin, step)

    counted = lambda e: walk(e, F.lit(0).cast("long"), lambda n, i: n + 1)
    ends = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda e: F.when(e < F.size("rows"), counted(e)))
    moves = blocks.select("block", ends.alias("f")).select("block", F.transform("f", lambda x: x["to"]).alias("to"), F.transform("f", lambda x: x["starts"]).alias("n"))
    firsts = first_states(materialise(moves, "moves"), most)
    listed = walk(F.col("e"), F.array().cast("array<int>"), lambda starts, i: F.concat(starts, F.array(i)))
    own = blocks.join(firsts, "block").withColumn("starts", listed["starts"])
    ends = F.concat(F.slice("starts", F.lit(2), F.lit(size)), F.array(F.least(F.lit(size), F.size("rows"))))
    spans = F.transform(F.arrays_zip(F.col("starts").alias("a"), ends.alias("b")), lambda x, k: F.struct(x["a"].alias("a"), x["b"].alias("b"), (F.col("n") + k).alias("batch")))
    before = F.filter(F.array(F.struct(F.lit(0).alias("a"), F.least("e", F.size("rows")).alias("b"), (F.col("n") - 1).alias("batch"))), lambda x: x["b"] > 0)
    spans = own.select("rows", F.explode(F.concat(before, spans)).alias("s")).filter("s.b > s.a")
    found = spans.select(F.col("s.batch").alias("batch"), F.explode(F.slice("rows", F.col("s.a") + 1, F.col("s.b") - F.col("s.a"))).alias("r"))
    found = found.select(F.col("r.shard").alias("shard"), F.col("r.id").alias("id"), "batch", F.col("r.head").alias("head"))
    first = found.filter("head").select(F.col("shard").alias("s"), F.col("batch").alias("first"))  # a row for each shard
    out = found.join(dimension(materialise(first, "shards")), F.col("shard") == F.col("s"))
    return out.select("shard", F.col("id").alias(id_col), (F.col("batch") - F.col("first")).cast("long").alias("batch_id"))


def first_states(moves: DataFrame, most: int, fan: int = 1024) -> DataFrame:
    """(block, e, n): where the first start of each block is and how many came before it, if the
    first block's is its first row. `moves` has, for each place of it, the place in the next
    block and the number of starts. Groups of `fan` blocks are composed until one is left."""
    group = F.array_sort(F.collect_list(F.struct("block", "to", "n"))).alias("parts")
    groups = materialise(moves.groupBy(F.floor(F.col("block") / fan).alias("group")).agg(group), "groups")
    state = lambda e, n: F.struct(e.cast("int").alias("e"), n.cast("long").alias("n"))

    def step(acc: Column, part: Column) -> Column:
        at = acc["e"] + 1
        return F.when(acc["e"] < 0, acc).otherwise(state(F.coalesce(F.try_element_at(part["to"], at), F.lit(-1)), acc["n"] + F.coalesce(F.try_element_at(part["n"], at), F.lit(0))))

    if groups.count() > 1:
        ends = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda e: F.aggregate("parts", state(e, F.lit(0)), step))
        above = groups.select(F.col("group").alias("block"), ends.alias("s")).select("block", F.transform("s", lambda x: x["e"]).alias("to"), F.transform("s", lambda x: x["n"]).alias("n"))
        firsts = first_states(materialise(above, "moves"), most, fan).select(F.col("block").alias("group"), F.struct("e", "n").alias("first"))
        groups = groups.join(firsts, "group")
    else:
        groups = groups.withColumn("first", state(F.lit(0), F.lit(0)))
    # the states before each part: those of the parts so far
    begin = F.struct(F.col("first.e").alias("e"), F.col("first.n").alias("n"), F.array().cast("array<struct<block:long,e:int,n:long>>").alias("out"))

    def push(acc: Column, part: Column) -> Column:
        went = step(F.struct(acc["e"].alias("e"), acc["n"].alias("n")), part)
        return F.struct(went["e"].alias("e"), went["n"].alias("n"), F.concat(acc["out"], F.array(F.struct(part["block"].cast("long").alias("block"), acc["e"].alias("e"), acc["n"].alias("n")))).alias("out"))

    return groups.select(F.inline(F.aggregate("parts", begin, push)["out"])).filter("e >= 0")


def fixed_batches(df: DataFrame, order: str, size: int) -> DataFrame:
    """Consecutive batches of equal size."""
    return positions(df, order, name="__n").withColumn("batch_id", F.floor(F.col("__n") / size)).drop("__n")


def overlapping_chunks(df: DataFrame, id_col: str, tokens_col: str, size: int, overlap: int) -> DataFrame:
    """(chunk_id, id, position): rows in the order of ids lie on a line of their tokens, which windows
    of `size` tokens cover, each `size - overlap` on from the one before. A row belongs to
    every window that holds it whole, or else to the first one that holds its start. Rows
    without tokens belong to where they lie; null tokens count 0."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be less than the size")
    step = size - overlap
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(tokens_col).cast("long"), F.lit(0)).alias("t"))
    rows = running_sum(rows, "t", "id", name="e").withColumn("s", F.col("e") - F.col("t"))
    last = F.floor(F.col("s") / step)  # the last window that begins at the start or before
    first = F.greatest(F.lit(0), F.ceil((F.col("e") - size) / step))  # the first one that ends at the end or behind
    holds = F.greatest(F.lit(0), F.floor((F.col("s") - size) / step) + 1)  # the first one that holds the start
    chunks = F.when(first <= last, F.sequence(first, last)).otherwise(F.array(F.least(holds, last)))
    return rows.select(F.explode(chunks).alias("chunk_id"), F.col("id").alias(id_col), F.col("s").alias("position"))


def batch_estimate(df: DataFrame, text_col: str, limit: int) -> DataFrame:
    return df.agg((F.floor(F.sum(F.floor(F.length(text_col) / 4)) / limit) + 1).cast("long").alias("batches"))


def split_text(text: str, size: int, overlap: int) -> list[tuple[int, str]]:
    """Chunks of at most `size` tokens (of four characters) that share up to `overlap`
    with the one before, cut at the coarsest separator that fits, and where each starts."""
    most, shared = 4 * size, 4 * overlap

    def atoms(s: str, at: int, seps: tuple[str, ...]) -> Iterator[tuple[int, str]]:
        if len(s) <= most:
            yield at, s
            return
        sep = seps[0]
        parts = [p + sep for p in s.split(sep)] if sep else [s[i : i + most] for i in range(0, len(s), most)]
        if sep:
            parts[-1] = parts[-1][: -len(sep)]
        for p in parts:
            if p:
                yield from atoms(p, at, seps[1:])
            at += len(p)

    out: list[tuple[int, str]] = []
    held: list[tuple[int, str]] = []
    length = 0
    for at, s in atoms(text, 0, SEPARATORS):
        if held and length + len(s) > most:
            out.append((held[0][0], "".join(x for _, x in held)))
            while held and (length > shared or length + len(s) > most):
                length -= len(held.pop(0)[1])
        if s:
            held.append((at, s))
            length += len(s)
    if held:
        out.append((held[0][0], "".join(x for _, x in held)))
    return out


def chunk_texts(df: DataFrame, id_col: str, text_col: str, size: int, overlap: int) -> DataFrame:
    """Chunks of each text: chunk_id, start_index, text, estimated_tokens."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [(i, n, at, s, len(s) // 4) for i, t in zip(pdf["id"], pdf["text"]) if t for n, (at, s) in enumerate(split_text(t, size, overlap))]
            yield pd.DataFrame(rows, columns=["id", "chunk_id", "start_index", "text", "estimated_tokens"])

    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, chunk_id int, start_index long, text string, estimated_tokens long")
    return out.withColumnRenamed("id", id_col)
