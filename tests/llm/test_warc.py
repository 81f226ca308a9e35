"""Archives that are cut off, that lack records, or that inflate very far."""

import gzip
import io
import tracemalloc
import zlib

import pytest

from convoy.llm import warc


def archive(n, payload=b"x" * 300):
    return b"".join(warc.record("response", str(i), "u", payload, "d", len(payload), None) for i in range(n))


def test_truncated_archives_are_errors():
    whole = gzip.compress(archive(50))
    assert len(list(warc.records_of(io.BytesIO(whole)))) == 50
    for cut in (1, 5, 8, 9, 40, len(whole) // 2, len(whole) - 12):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.records_of(io.BytesIO(whole[:-cut])))
    with pytest.raises(ValueError, match="inside a record"):
        list(warc.records_of(io.BytesIO(gzip.compress(archive(2)[:-3]))))
    with pytest.raises(ValueError, match="no end"):
        list(warc.records_of(io.BytesIO(gzip.compress(b"WARC/1.1\r\n" + b"a" * 9_000_000))))
    members = gzip.compress(archive(3)) + gzip.compress(archive(2)) + gzip.compress(b"")
    assert len(list(warc.records_of(io.BytesIO(members)))) == 5
    assert list(warc.records_of(io.BytesIO(b""))) == []


@pytest.mark.parametrize("chunk", [1, 7, 1 << 16])
def test_pieces_of_any_size(monkeypatch, chunk):
    monkeypatch.setattr(warc, "CHUNK", chunk)
    monkeypatch.setattr(warc, "MOST_HEADERS", 1 << 22)
    raw = archive(3, b"ab" * 70) + archive(2, b"")
    assert b"".join(warc.records_of(io.BytesIO(gzip.compress(raw)))) == raw


def test_memory_is_bounded_however_far_an_archive_inflates():
    payload = b"y" * (1 << 20)
    deflate = zlib.compressobj(9, zlib.DEFLATED, 31)
    data = b"".join(deflate.compress(archive(1, payload)) for _ in range(200)) + deflate.flush()
    assert len(data) < 1 << 20
    tracemalloc.start()
    assert sum(1 for _ in warc.records_of(io.BytesIO(data))) == 200
    assert tracemalloc.get_traced_memory()[1] < 20 << 20
    tracemalloc.stop()


def test_records_are_counted_against_the_manifest(spark, tmp_path):
    path = f"{tmp_path}/a.warc.gz"
    with open(path, "wb") as f:
        f.write(gzip.compress(archive(4)))
    for records, good in ((4, True), (None, True), (5, False)):
        manifest = spark.createDataFrame([(f"file://{path}", None, records)], warc.MANIFEST)
        if good:
            assert warc.normalise(manifest, f"file://{tmp_path}/{records}").first()["records"] == 4
        else:
            with pytest.raises(Exception, match="should hold 5"):
                warc.normalise(manifest, f"file://{tmp_path}/{records}")
