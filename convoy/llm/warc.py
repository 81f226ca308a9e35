"""Web archives: a WARC writer, a normaliser for monolithic gzip files with an offset
index, and an indexed reader (operator 8).

The writer makes archives that are one gzip stream each. The normaliser inflates such
a file once, in one pass, rewrites every record as a gzip member of its own and writes
a sidecar index (offset, length, record id) so that a reader can seek to any record.

Edge cases: a null payload is empty; payloads under `least` bytes never become
revisits; a null id is a response of its own, and nothing refers to it unless all
copies have null ids; repeated rows with one id refer to that id once and are
responses otherwise; an empty table gives no archive; extra columns are not read. All
files lie in the folder the cluster shares; a repeated task attempt writes files of
other names, and only files that a manifest names are read.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, release_caches, remove_dir, utf8, work_dir

#: Bytes read from an archive, and inflated, at a time; most bytes of a record's headers.
CHUNK, MOST_HEADERS = 1 << 20, 1 << 22
#: Rows of a digest and two ids that are broadcast at most (about 20 MB).
BROADCAST_ROWS = 200_000
MANIFEST = "archive string, index string, records long"


def _open(path: str, mode: str):
    fs, at = pyarrow.fs.FileSystem.from_uri(path)
    if mode == "w":
        fs.create_dir(at.rpartition("/")[0], recursive=True)
        return fs.open_output_stream(at, compression=None)
    return fs.open_input_file(at)


def record(kind: str, record_id: str, url: str, payload: bytes, digest: str, n_bytes: int, refers_to: str | None) -> bytes:
    """A WARC/1.1 record; a revisit has no block."""
    headers = [
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{record_id}>",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {n_bytes}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if refers_to is not None:
        headers += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = b"" if kind == "revisit" else payload
    return ("WARC/1.1\r\n" + "\r\n".join(headers) + f"\r\nContent-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    headers = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    return headers, rest[: int(headers["content-length"])]


def inflated(stream) -> Iterator[bytes]:
    """Pieces of at most CHUNK bytes of a gzip file of one or more members, however far it
    inflates; an error if its last member has no end."""
    inflate, begun = zlib.decompressobj(31), False
    while chunk := bytes(stream.read(CHUNK)):
        data, full = chunk, False
        while data or full:
            begun = True
            piece = inflate.decompress(data, CHUNK)
            data, full = inflate.unconsumed_tail, len(piece) == CHUNK  # more may be held back
            if inflate.eof:
                data, full, begun = inflate.unused_data, False, False
                inflate = zlib.decompressobj(31)
            if piece:
                yield piece
    if begun:
        raise ValueError("the archive ends inside a gzip member")


def records_of(stream) -> Iterator[bytes]:
    """The records of a gzip file, inflated once; one record and a piece are held at a time."""
    held, need = bytearray(), -1  # bytes of the record at the front, once its headers are here
    for piece in inflated(stream):
        held += piece
        at = 0
        while True:
            if need < 0:
                end = held.find(b"\r\n\r\n", at)
                if end < 0:
                    if len(held) - at > MOST_HEADERS:
                        raise ValueError("the headers of a record have no end")
                    break
                head = bytes(held[at:end]).lower()
                need = end - at + 4 + int(head.rpartition(b"\r\ncontent-length:")[2].split(b"\r\n")[0]) + 4
            if len(held) - at < need:
                break
            yield bytes(held[at : at + need])
            at, need = at + need, -1
        del held[:at]
    if held:
        raise ValueError("the archive ends inside a record")


def with_revisits(pages: DataFrame, *, id_col: str, payload_col: str, url_col: str | None, least: int) -> DataFrame:
    """id, url, payload, digest, n_bytes and refers_to. Digests and ids find the revisits,
    which are broadcast if they're few (counted before); payloads move only if they
    aren't, and then by id, so that a payload's many copies don't meet in one task."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.col(url_col).cast("string"), F.lit("")) if url_col else F.lit("")).alias("url"),
        payload.alias("payload"),
        F.sha2(payload, 256).alias("digest"),
        F.octet_length(payload).cast("long").alias("n_bytes"),
    )
    first = (
        rows.filter(F.col("n_bytes") >= least)
        .groupBy(F.col("digest").alias("d"))
        .agg(F.min("id").alias("first"), F.count("*").alias("copies"))
        .filter("copies > 1 and first is not null")
    )
    first = materialise(first.select("d", "first"), "first-copies")
    refs = rows.select(F.col("id").alias("own"), "digest").join(_few(first), F.col("digest") == F.col("d")).filter("own <> first").select("own", "d", "first").distinct()
    refs = materialise(refs, "revisits")
    rows = rows.join(_few(refs), (F.col("id") == F.col("own")) & (F.col("digest") == F.col("d")), "left")
    return rows.select("id", "url", "payload", "digest", "n_bytes", F.col("first").alias("refers_to"))


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def write_monolithic(rows: DataFrame, folder: str) -> DataFrame:
    """One whole-file gzip stream a partition; returns the manifest, which is written
    beside the archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches("warc")
        out, n, deflate, path = None, 0, zlib.compressobj(4, zlib.DEFLATED, 31), f"{folder}/mono/{uuid.uuid4().hex}.warc.gz"
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            ends = offsets.tolist()
            plain = [batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5)]
            for i, (own, url, digest, size, refers) in enumerate(zip(*plain)):
                out = _open(path, "w") if out is None else out
                kind = "response" if refers is None else "revisit"
                out.write(deflate.compress(record(kind, _id(own), _clean(url), data[ends[i] : ends[i + 1]].tobytes(), digest, size, None if refers is None else _id(refers))))
                n += 1
        if out is not None:
            out.write(deflate.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"archive": [path], "index": [None], "records": [n]}, schema=_manifest_schema())

    rows.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/mono-manifest")
    return rows.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/mono-manifest")


def _manifest_schema() -> pa.Schema:
    return pa.schema([("archive", pa.string()), ("index", pa.string()), ("records", pa.int64())])


def _id(value) -> str:
    return "null" if value is None else str(value)


def _clean(url: str) -> str:
    return url.replace("\r", "%0D").replace("\n", "%0A")


def normalise(manifest: DataFrame, folder: str) -> DataFrame:
    """Every record as a gzip member of its own, and an index of offsets beside each
    archive. A task for each archive; an archive is read once, from front to back. An archive
    that is cut off, or that holds another number of records than the manifest says
    (null: unknown), is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches("warc")
        for batch in batches:
            for path, records in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                name = f"{folder}/warc/{uuid.uuid4().hex}.warc.gz"
                at, n = 0, 0
                with _open(path, "r") as source, _open(name, "w") as out, _open(f"{name}.idx", "w") as index:
                    for raw in records_of(source):
                        deflate = zlib.compressobj(4, zlib.DEFLATED, 31)
                        member = deflate.compress(raw) + deflate.flush()
                        head = raw[: raw.find(b"\r\n\r\n")].decode()
                        own = next(line for line in head.split("\r\n") if line.startswith("WARC-Record-ID:")).partition(":")[2].strip()
                        out.write(member)
                        index.write((json.dumps([at, len(member), own]) + "\n").encode())
                        at, n = at + len(member), n + 1
                if records not in (None, n):
                    raise ValueError(f"{path} holds {n} records and should hold {records}")
                yield pa.RecordBatch.from_pydict({"archive": [name], "index": [f"{name}.idx"], "records": [n]}, schema=_manifest_schema())

    files = max(1, manifest.count())
    manifest.repartition(files, "archive").mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return manifest.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_archives(manifest: DataFrame, id_type: str = "bigint") -> DataFrame:
    """Read archives by their indexes. Per record: page_id, url, record_type,
    payload_digest and payload_bytes (a revisit's from its headers; a response's are
    computed from the block and compared with its headers), refers_to, payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches("warc")
        import hashlib

        schema = pa.schema([(c, pa.string()) for c in ("page_id", "url", "record_type", "payload_digest")] + [("payload_bytes", pa.int64()), ("refers_to", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            for name, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with _open(index, "r") as f:
                    entries = [json.loads(line) for line in bytes(f.read()).splitlines()]
                rows, held = [], 0
                with _open(name, "r") as f:
                    for offset, length, own in entries:
                        f.seek(offset)
                        headers, block = parse(zlib.decompress(bytes(f.read(length)), 31))
                        if headers["warc-record-id"] != own:
                            raise ValueError(f"the index of {name} is wrong at {offset}")
                        digest, n = headers["warc-payload-digest"].partition(":")[2], int(headers["x-payload-length"])
                        if headers["warc-type"] == "response" and (hashlib.sha256(block).hexdigest(), len(block)) != (digest, n):
                            raise ValueError(f"payload of {own} doesn't match its digest")
                        refers = headers.get("warc-refers-to")
                        rows.append((_urn(own), headers["warc-target-uri"], headers["warc-type"], digest, n, refers and _urn(refers), None if headers["warc-type"] == "revisit" else block))
                        held += len(block)
                        if held > 1 << 23 or len(rows) >= 5000:
                            yield _batch(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows, schema)

    kinds = "page_id string, url string, record_type string, payload_digest string, payload_bytes long, refers_to string, payload binary"
    files = max(1, manifest.count())
    out = manifest.repartition(files, "archive").mapInArrow(run, kinds)
    own, refers = (F.when(F.col(c) != "null", F.col(c)).cast(id_type) for c in ("page_id", "refers_to"))
    return out.withColumns({"page_id": own, "refers_to": refers})


def _urn(value: str) -> str | None:
    return value.removeprefix("<urn:page:").removesuffix(">")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def archive_pages(
    spark: SparkSession, pages: DataFrame, *, id_col: str = "page_id", payload_col: str = "html", url_col: str | None = "url", least: int = 100, folder: str | None = None
) -> DataFrame:
    """Write pages as monolithic archives, normalise them, delete the monolithic files
    and return the manifest of the normalised ones."""
    folder = folder or work_dir(spark, "warc")
    mono = write_monolithic(with_revisits(pages, id_col=id_col, payload_col=payload_col, url_col=url_col, least=least), folder)
    manifest = normalise(mono, folder)
    remove_dir(spark, f"{folder}/mono")
    return manifest
