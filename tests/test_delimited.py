"""CSV files in many blocks against the parse of the whole file by one task."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convoy.sources import delimited, tables

NAMES = ["ticket_id", "category", "text", "sender"]


def by_one_task(spark, path, sep, encoding="utf-8"):
    fields = [T.StructField(n, T.StringType()) for n in [*NAMES, "_extra", "_corrupt"]]
    raw = spark.read.csv(path, schema=T.StructType(fields), sep=sep, header=True, quote='"', escape="\\", encoding=encoding, mode="PERMISSIVE", multiLine=True, enforceSchema=True, columnNameOfCorruptRecord="_corrupt")
    return raw.filter(F.col("_extra").isNull()).select(*NAMES)


def field(rng, sep):
    words = ["olá", "5\" long", "a", "", "x y", "null", "tab\t", "\\", "é" * rng.randint(0, 30)]
    plain = " ".join(rng.choice(words) for _ in range(rng.randint(0, 4)))
    if rng.random() < 0.5:
        return plain.lstrip('"')
    inner = "".join(rng.choice(["abc ", sep, "\n", "\n\n", '\\"', "é", "\r\n", " 'q' ", "\\n"]) for _ in range(rng.randint(0, 12)))
    return f'"{inner}z"'


@pytest.fixture
def small_blocks(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", n)
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("sep,seed,end", [(";", 1, "\n"), (",", 2, "\r\n"), (";", 3, "\n")])
def test_many_blocks_equal_one_task(spark, tmp_path, small_blocks, sep, seed, end):
    rng = random.Random(seed)
    rows = [sep.join([str(i), *(field(rng, sep) for _ in range(rng.choice([1, 3, 3, 3, 3, 3, 4, 6])))]) for i in range(600)]
    if seed == 3:  # a record over many blocks, and a quote without an end
        rows.insert(100, f'big{sep}TEXT{sep}"' + ("line of text\n" * 3000) + f'"{sep}USER')
        rows.append(f'last{sep}TEXT{sep}"never closed\nand on')
    path = tmp_path / "m.csv"
    path.write_bytes(b"\xef\xbb\xbf" + (sep.join(NAMES) + end + end.join(rows) + end * (seed != 3)).encode())
    want = sorted(map(str, by_one_task(spark, str(path), sep).collect()))
    for size in (700, 5000, 1 << 20):
        small_blocks(size)
        read = delimited.read_csv(spark, str(path), NAMES, sep)
        assert size > 700 or delimited._lines(spark, str(path), "utf-8").rdd.getNumPartitions() > 10
        got = read.collect()
        assert sorted(map(str, got)) == want
        ids = [int(r["ticket_id"]) for r in got if (r["ticket_id"] or "").isdigit()]
        assert ids == sorted(ids) and len(ids) > 300  # in the order of the file


def test_several_files_and_encodings(spark, tmp_path, small_blocks):
    for n in range(3):
        (tmp_path / f"{n}.csv").write_bytes(("ticket_id,category,text,sender\n" + "".join(f'{n}{i},TEXT,"ação\n{i}",USER\n' for i in range(50))).encode("latin-1"))
    small_blocks(300)
    got = tables.read_messages(spark, f"{tmp_path}/*.csv")
    assert sorted((r["ticket_id"], r["text"]) for r in got.collect()) == sorted((f"{n}{i}", f"ação\n{i}") for n in range(3) for i in range(50))
    (tmp_path / "e.csv").write_text(";".join(NAMES) + "\n")
    assert tables.read_messages(spark, str(tmp_path / "e.csv")).count() == 0


def test_states_of_lines():
    open_ = delimited.stays_open
    assert [open_(x, False, ";") for x in ('a;b', 'a;"b', '"a";b', '"a;b";', '"a"b;c', 'a"b', '', '"', '""', '"";"', '"\\"', '"\\";x"')] == [False, True, False, False, True, False, False, True, False, True, True, False]
    assert [open_(x, True, ";") for x in ('a', 'a"', 'a";b', 'a";"b', '', '"', '";"', 'a\\"')] == [True, False, False, True, True, False, True, True]


def test_position_has_no_gaps_over_many_blocks(spark, tmp_path, small_blocks):
    skipped = lambda i: ";x;y" if i % 50 == 7 else ""  # noqa: E731  rows with fields too many
    rows = [f"{i};TEXT;" + (f'"a\n{i}"' if i % 5 == 0 else "b") + f";USER{skipped(i)}" for i in range(400)]
    (tmp_path / "m.csv").write_text("\n".join([";".join(NAMES), *rows]) + "\n")
    small_blocks(600)
    got = tables.read_messages(spark, f"{tmp_path}/m.csv", na_values=[], position="nr").orderBy("nr").collect()
    kept = [str(i) for i in range(400) if not skipped(i)]
    assert [(r["ticket_id"], r["nr"]) for r in got] == [(t, n) for n, t in enumerate(kept)]
    with pytest.raises(ValueError, match="position"):
        tables.read_messages(spark, f"{tmp_path}/m.parquet", position="nr")


def test_categorised_file_numbers_over_many_blocks(spark, small, small_blocks):
    from convoy.plans import catalogue_files

    small_blocks(600)
    got = catalogue_files.categorised_file(spark, small).orderBy("ticket_id").collect()
    assert len(got) > 100 and [r["nr"] for r in got] == list(range(1, len(got) + 1))
