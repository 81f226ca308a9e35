"""Deduplication of content-defined chunks of lines (operator 6).

A document's lines are hashed; a rolling hash over the last two line hashes ends a
chunk wherever it is divisible by `modulus`, so boundaries move with the content: an
inserted line changes the chunks beside it only. Chunks of two lines or more that
occur again anywhere are removed except at their first place (least document id, then
position). Digests bring candidates together; the chunks themselves are grouped by
their bytes before any is removed.

Edge cases: null text has no lines and stays null; empty text is one empty line; a
document all of whose lines go has empty text; a null id counts as less than any; rows
with equal ids are taken in the order of their texts; extra columns can be carried by
name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release_caches
from .repeats import _batch, _with_left_key
from .spans import block_count, in_blocks

#: Lines in the rolling hash's window; the factor of the older line.
WINDOW, FACTOR = 2, 31
#: Stands for a null id: less than any.
NO_ID = -(1 << 63)


def line_hash(line: bytes) -> int:
    """The first 32 bits of the line's MD5."""
    return int.from_bytes(hashlib.md5(line).digest()[:4], "big")


def chunks_of(text: str, modulus: int) -> tuple[list[bytes], list[tuple[int, int]]]:
    """The lines, and first line and end of each chunk."""
    lines, out, start, before = text.encode().split(b"\n"), [], 0, 0
    for i, line in enumerate(lines):
        own = line_hash(line)
        if (own + FACTOR * before) % modulus == 0:
            out.append((start, i + 1))
            start = i + 1
        before = own
    if start < len(lines):
        out.append((start, len(lines)))
    return lines, out


def _sorted_rows(table: pa.Table) -> pa.Table:
    """One order in every pass, so that a row's number in its block names it."""
    return table.sort_by([("id", "ascending"), ("text", "ascending")])


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", modulus: int = 3, least_lines: int = 2, keep: list[str] | None = None) -> DataFrame:
    """Per document: id, n_lines, n_removed (lines), the text that stays and `keep`'s columns."""
    blocks = block_count(docs.select(id_col, text_col))
    keep = keep or []
    texts = in_blocks(docs, blocks, id_col, text_col, keep)
    carried = [f"carry_{i}" for i in range(len(keep))]
    digests = "block long, digest binary, n long"

    def survey(key: tuple, table: pa.Table) -> pa.Table:
        release_caches("lines")
        seen: dict[bytes, int] = {}
        for text in table.column("text").to_pylist():
            if text is not None:
                lines, chunks = chunks_of(text, modulus)
                for s, e in chunks:
                    if e - s >= least_lines:
                        d = hashlib.sha256(b"\n".join(lines[s:e])).digest()
                        seen[d] = seen.get(d, 0) + 1
        return pa.table({"block": pa.array([key[0].as_py()] * len(seen), pa.int64()), "digest": pa.array(list(seen), pa.binary()), "n": pa.array(list(seen.values()), pa.int64())})

    # a block sends a digest once, however often it holds the chunk
    found = texts.groupBy("block").applyInArrow(survey, digests)
    again = found.groupBy("digest").agg(F.sum("n").alias("total")).filter("total > 1")
    repeated = found.join(again, "digest", "left_semi").groupBy("block").agg(F.collect_list("digest").alias("digests"))
    places = "block long, id long, row long, chunk long, n long, digest binary, body binary"

    def fetch(key: tuple, table: pa.Table, known: pa.Table) -> pa.Table:
        """Each repeating chunk of the block once, with its first place here."""
        release_caches("lines")
        wanted = {d for ds in known.column("digests").to_pylist() for d in ds}
        seen: dict[bytes, list] = {}
        table = _sorted_rows(table)
        for r, (own, text) in enumerate(zip(table.column("id").to_pylist(), table.column("text").to_pylist())) if wanted else ():
            if text is None:
                continue
            lines, chunks = chunks_of(text, modulus)
            for c, (s, e) in enumerate(chunks):
                if e - s >= least_lines:
                    body = b"\n".join(lines[s:e])
                    if body in seen or hashlib.sha256(body).digest() in wanted:
                        place = (NO_ID if own is None else own, r, c)
                        got = seen.setdefault(body, [place, 0])
                        got[0], got[1] = min(got[0], place), got[1] + 1
        rows = [[key[0].as_py()] * len(seen), *([g[0][i] for g in seen.values()] for i in range(3)), [g[1] for g in seen.values()], [hashlib.sha256(x).digest() for x in seen], list(seen)]
        return _batch(places, rows)

    held = texts.groupBy("block").cogroup(repeated.groupBy("block")).applyInArrow(_with_left_key(fetch, places), places)
    held = materialise(held, "line-chunks")
    # grouped by their bytes; a block sends a chunk once, so a hot one makes a row a block
    first = held.groupBy("digest", "body").agg(F.min(F.struct("id", "block", "row", "chunk")).alias("first"), F.sum("n").alias("n")).filter("n > 1")
    gone = held.select("block", "digest", "body").join(first, ["digest", "body"]).groupBy("block").agg(F.collect_list(F.struct("digest", "first")).alias("gone"))
    schema = ", ".join(["id long, n_lines long, n_removed long, text string", *(f"{c} {docs.schema[k].dataType.simpleString()}" for c, k in zip(carried, keep))])

    def cut(key: tuple, table: pa.Table, found: pa.Table) -> pa.Table:
        release_caches("lines")
        out: list[list] = [[], [], [], []]
        stays: dict[bytes, tuple] = {}
        for g in (g for gs in found.column("gone").to_pylist() for g in gs):
            if stays.setdefault(g["digest"], place := tuple(g["first"][c] for c in ("block", "row", "chunk"))) != place:
                raise RuntimeError("two different chunks have one SHA-256")
        block = key[0].as_py()
        table = _sorted_rows(table)
        for r, (own, text) in enumerate(zip(table.column("id").to_pylist(), table.column("text").to_pylist())):
            n = removed = 0
            if text is not None:
                lines, chunks = chunks_of(text, modulus)
                n = len(lines)
                drop = []
                for c, (s, e) in enumerate(chunks) if stays else ():
                    if e - s >= least_lines:
                        place = stays.get(hashlib.sha256(b"\n".join(lines[s:e])).digest())
                        if place is not None and place != (block, r, c):
                            drop.append((s, e))
                if drop:
                    keep = np.ones(n, bool)
                    for s, e in drop:
                        keep[s:e] = False
                    removed = int(n - keep.sum())
                    text = b"\n".join(x for x, k in zip(lines, keep) if k).decode()
            for column, value in zip(out, (own, n, removed, text)):
                column.append(value)
        columns = [pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string()))]
        return pa.table([*columns, *(table.column(c) for c in carried)], names=["id", "n_lines", "n_removed", "text", *carried])

    out = texts.groupBy("block").cogroup(gone.groupBy("block")).applyInArrow(cut, schema)  # what goes is of blocks that exist
    own = [F.col(c).alias(k) for c, k in zip(carried, keep)]
    return out.select(F.col("id").alias(id_col), "n_lines", "n_removed", F.col("text").alias(text_col), *own)

