"""Every operator on nulls, empty and very long texts, ties, repeated rows, extra columns
with clashing names, and empty tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from convoy.llm import decontam, fingerprints, jaccard, langid, lines, neardup, packing, substrings, token_counts, warc

pytest.importorskip("public_tokenizers")
import public_tokenizers as P  # noqa: E402

LONG = " ".join(f"w{i % 977}x{i}" for i in range(20_000))
KIND = "doc_id long, text string, lang string, block long, id string, bucket int, n_bytes int, carry_0 string, digest binary, kept string"


@pytest.fixture(scope="module")
def docs(spark):
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, LONG), (6, "tie tie tie"), (7, "tie tie tie"), (7, "tie tie tie"), (None, "no id here at all"), (8, "ünï ⭐ 日本"), (9, "\0 odd \r\n line\n\nend\n"), (10, "1234 56")]
    return spark.createDataFrame([(i, t, "en" if t and "tie" in t else "xx" if t else None, 0, "x", 1, 2, "y", b"z", "k") for i, t in texts], KIND)


def operators(spark, docs):
    bench = spark.createDataFrame([(1, "no id here at all"), (2, None), (3, ""), (4, "tie tie tie"), (4, "tie tie tie")], "item_id long, text string")
    return {
        "jaccard": lambda: jaccard.similar_groups(docs, k=4, num=85, den=100),
        "jaccard_slices": lambda: jaccard.similar_groups(docs, k=4, num=85, den=100, coarse=2, block_members=2, cell_members=2, slice_shingles=1),
        "decontam": lambda: decontam.contaminated(docs, bench),
        "packing": lambda: packing.pack(docs, P.path("byte_bpe_50k.json"), with_ids=True),
        "substrings": lambda: substrings.dedup_substrings(docs, with_text=True),
        "lines": lambda: lines.dedup_lines(docs, keep=["block", "id", "carry_0"]),
        "tokens": lambda: token_counts.token_counts(docs, P.path("piece_bpe_32k.model")),
        "langid": lambda: langid.identify(docs),
        "fingerprints": lambda: fingerprints.dedup_windows(docs, with_text=True),
        "warc": lambda: warc.read_archives(warc.archive_pages(spark, docs, id_col="doc_id", payload_col="text", url_col=None)),
    }


NAMES = ["jaccard", "jaccard_slices", "decontam", "packing", "substrings", "lines", "tokens", "langid", "fingerprints", "warc"]


@pytest.mark.parametrize("name", NAMES)
def test_hard_rows(spark, docs, name):
    got = operators(spark, docs)[name]().toPandas()
    rows = 12 if name not in ("decontam", "packing") else len(got)
    assert len(got) == rows
    if name.startswith("jaccard"):
        by = {r.doc_id: r for r in got.dropna(subset=["doc_id"]).itertuples()}
        assert by[5].component_id == 4 and by[7].component_id == 6 and by[1].component_id == 1 and by[2].n_shingles == 0
        assert by[4].n_shingles == 20_000 - 3 and got[got.doc_id.isna()].component_id.isna().all()
    if name == "decontam":
        found = sorted((-1 if np.isnan(a) else a, b) for a, b in zip(got.doc_id.astype(float), got.item_id))
        assert found == [(-1, 1), (6, 4), (6, 4), (7, 4), (7, 4), (7, 4), (7, 4)]
    if name == "packing":
        assert got.groupby("sequence_id").length.sum().max() <= 1024
        assert (got[got.doc_id == 1].doc_tokens == 1).all() and got[got.doc_id == 7].shape[0] >= 2
    if name == "substrings":
        by = got.set_index("doc_id")
        assert by.loc[5].n_removed == by.loc[5].n_bytes == len(LONG) and by.loc[4].n_removed == 0 and by.loc[1].n_bytes == 0
    if name == "lines":
        assert got[got.doc_id == 1].text.isna().all() and (got[got.doc_id == 9].text == "\0 odd \r\n line\n\nend\n").all()
    if name == "tokens":
        assert got[got.doc_id.isin([1, 2])].n_tokens.sum() == 0 and got[got.doc_id == 4].over_limit.all()
    if name == "langid":
        assert set(got[got.doc_id.isin([1, 2, 3, 10])].lang_pred) == {"und"} and got.score.between(0, 1).all()
    if name == "fingerprints":
        by = got.set_index("doc_id")
        assert by.loc[4].n_removed == by.loc[5].n_removed == 20_000 and by.loc[1].n_words == 0
    if name == "warc":
        by = got.dropna(subset=["page_id"]).set_index("page_id")
        assert by.loc[5].refers_to == 4 and by.loc[5].record_type == "revisit" and by.loc[1].payload_bytes == 0 and got.page_id.isna().sum() == 1


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, docs, name):
    assert operators(spark, docs.filter("doc_id = -1"))[name]().count() == 0


@pytest.mark.parametrize("name", NAMES)
def test_million_equal_characters(spark, docs, name):
    """A text of one long word and one of one character, beside usual ones."""
    long = docs.limit(1).select(F.lit(21).cast("long").alias("doc_id"), F.lit("a" * 1_000_000).alias("text"), *docs.columns[2:])
    spaced = docs.limit(1).select(F.lit(22).cast("long").alias("doc_id"), F.lit("- " * 300_000).alias("text"), *docs.columns[2:])
    rows = long.unionByName(spaced).unionByName(docs.filter("doc_id in (6, 8)"))
    got = operators(spark, rows)[name]().toPandas()
    assert len(got) == 4 or name in ("decontam", "packing")
    if name == "fingerprints":
        assert got.set_index("doc_id").loc[22].n_removed == 300_000


def test_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.3]), (4, [0.0, 0.0]), (5, None), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, []), (9, [1.0, 0.0, 0.0]), (10, [1.0, 0.0]), (None, [1.0, 0.0]), (11, [-1.0, 0.0]), (12, [1e308, 1e308])]
    df = spark.createDataFrame([(i, v, 0, "u") for i, v in rows], "vec_id long, embedding array<double>, id int, unit string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df).collect()}
    assert got[1] == (3, 1, True) and got[2] == (3, 1, False) and got[3] == (3, 1, False) and got[10] == (3, 1, False)
    for i in (4, 5, 6, 7, 8, 9, 11, 12):
        assert got[i] == (0, i, True)
    assert got[None] == (0, None, True)
    assert neardup.near_duplicates(df.filter("vec_id = -1")).count() == 0


def test_vectors_of_many_dimensions(spark):
    rows = [(2 * d + i, [1.0] * (d - 1) + [1.0 + i / 10]) for d in range(1, 1006) for i in (0, 1)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got.collect()} == {i: (1, i & ~1, i % 2 == 0) for i, _ in rows}


def test_no_labels(spark, docs):
    got = langid.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in got.collect()} == {"und"}
