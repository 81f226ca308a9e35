import pandas as pd
import pytest

import corpus_pipeline


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.count()
        out = stage(spark, docs, small)
        rows = out.count()
        if k < 4:
            assert out.columns == columns and 0 < rows <= before, name
            docs = spark.createDataFrame(out.toPandas(), docs.schema)
    assert {r["doc_id"] for r in out.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_decisions_take_effect(spark, small):
    result = {r["doc_id"] for r in corpus_pipeline.run(spark, small).select("doc_id").distinct().collect()}
    t, bench = pd.read_parquet(f"{small}/documents.parquet"), pd.read_parquet(f"{small}/benchmark.parquet")
    leaks = {i for i, x in zip(t.doc_id, t.text) if any(b in x for b in bench.text)}
    assert leaks and not leaks & result
    assert len(result) > 0.5 * len(t)


def test_null_ids_and_texts_stay_defined(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(30)
    odd = docs.limit(1).selectExpr("cast(null as long) as doc_id", "text", "lang", "source", "n_chars").unionByName(docs.limit(1).selectExpr("-5L as doc_id", "cast(null as string) as text", "lang", "source", "n_chars"))
    rows = docs.unionByName(odd)
    for _, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, rows, small).filter("doc_id is null").count() <= 1


HARD = "doc_id long, text string, lang string, source string, n_chars int, lang_pred int, score string, block long, own_0 string, carry_0 int, component_id string, id boolean"


@pytest.fixture(scope="module")
def hard(spark, small):
    """Nulls, blanks, ties, repeated rows and columns whose names operators use themselves."""
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(25).collect()
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs]
    rows += [(None, rows[0][1], rows[0][2]), (-5, None, None), (-6, "", None), (-7, rows[1][1], rows[1][2]), (-7, rows[1][1], rows[1][2]), (-8, "short text", None), (-9, " ".join([rows[2][1]] * 400), None)]
    return spark.createDataFrame([(i, t, lang, None, None, 7, "s", 8, "o", 9, "c", None) for i, t, lang in rows], HARD)


@pytest.mark.parametrize("n", range(5))
def test_stages_on_hard_rows(spark, small, hard, n):
    name, stage = corpus_pipeline.STAGES[n]
    got = stage(spark, hard, small).toPandas()
    if n < 4:
        assert list(got.columns) == hard.columns and 0 < len(got) <= 32, name
        assert (got.lang_pred == 7).all() and (got.score == "s").all() and (got.own_0 == "o").all() and (got.component_id == "c").all()
        assert {-5, -6} <= set(got.doc_id) or name == "language_id"
    else:
        assert (got[got.doc_id == -5].doc_tokens == 1).all() and -9 in set(got.doc_id)
    if name == "near_dup":
        assert got.doc_id.isna().sum() == 1 and (got.doc_id == -7).sum() == 2
    if name == "line_dedup":
        assert (got[got.doc_id == -8].n_chars == 10).all()


@pytest.mark.parametrize("n", range(5))
def test_stages_on_an_empty_table(spark, small, hard, n):
    assert corpus_pipeline.STAGES[n][1](spark, hard.filter("doc_id = -1"), small).count() == 0


def test_stages_need_only_id_text_and_language(spark, small, hard):
    docs = hard.select("doc_id", "text", "lang")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, small)
        assert docs.columns == ["doc_id", "text", "lang"]
    assert docs.count() > 0
