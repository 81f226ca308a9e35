"""Partial results that outlive the job."""

import pytest
from pyspark.sql import functions as F

from convoy.plans import jobs
from convoy.plans.model import CallableModel


@pytest.fixture
def model(tmp_path):
    log = f"{tmp_path}/calls"
    open(log, "w").close()

    def build():
        from convoy.plans.model import PROMPTS

        def call(prompt, text):
            if prompt == PROMPTS["map"]:
                with open(log, "a") as f:
                    f.write(text + "\n")
                if text.endswith("13"):
                    raise ValueError("no")
            return text if prompt == PROMPTS["map"] else f"({text.replace(chr(10) * 2, ' ')})"

        return call

    m = CallableModel("m", build)
    return m, lambda: open(log).read().split()


def test_a_job_that_died_goes_on_where_it_was(spark, tmp_path, model, monkeypatch):
    m, calls = model
    chunks = spark.range(40).select(F.format_string("%03d", "id").alias("chunk_id"), F.concat(F.lit("c"), "id").alias("text")).repartition(3)
    folder, plain, n = f"file://{tmp_path}/run", jobs._combined, []

    def dies(*args):
        n.append(1)
        if len(n) == 3:
            raise RuntimeError("lost")
        return plain(*args)

    with monkeypatch.context() as patch:
        patch.setattr(jobs, "_combined", dies)
        with pytest.raises(Exception, match="lost"):
            jobs.merged_as_it_goes(chunks, m, folder, every=5, at_once=1)
    before = calls()
    assert len(before) == 15  # two groups are merged, the third one was mapped
    parts = {r["nr"]: r["text"] for r in jobs.merged_as_it_goes(chunks, m, folder, every=5, at_once=1).collect()}
    want = {g: "(" + " ".join(f"c{i}" for i in range(5 * g, 5 * g + 5) if i != 13) + ")" for g in range(8)}
    assert parts == want
    again = calls()[len(before) :]
    assert len(again) == 30 and not set(again) & set(before[:10])  # merged chunks weren't called again
    assert {r["nr"]: r["text"] for r in jobs.merged_as_it_goes(chunks, m, folder, every=5).collect()} == want and len(calls()) == 45


def test_kept_and_unkept_rounds_agree(spark, tmp_path, model):
    m, _ = model
    chunks = spark.range(12).select(F.format_string("%03d", "id").alias("chunk_id"), F.concat(F.lit("c"), "id").alias("text"))
    for size in (12, 3):
        kept = jobs.map_reduce(chunks, m, fan_in=size, folder=f"file://{tmp_path}/k{size}").first()
        assert tuple(kept) == tuple(jobs.map_reduce(chunks, m, fan_in=size).first())
