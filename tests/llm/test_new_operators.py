"""Periodic runs, exact deduplication with its index, and hard negatives, against plain
versions, on hard rows, on empty tables and over several batches."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from convoy.llm import exact, fingerprints, negatives, periods, queries, repeats, substrings
from convoy.llm.spans import word_units


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_runs(words, min_words=24, min_exp=3):
    number, out = {}, []
    x = np.array([number.setdefault(w, len(number)) for w in words], int)
    for q in range(1, len(x) // min_exp + 1):
        edge = np.diff(np.concatenate([[0], (x[q:] == x[:-q]).astype(int), [0]]))
        for i, j in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
            s = x[i : j + q]
            if len(s) >= max(min_words, min_exp * q) and not any((s[r:] == s[:-r]).all() for r in range(1, q)):
                out.append((i, len(s), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapsed(words, runs):
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def looped(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a, p = g % n, 1 + (n - g % n) // (3 + g // 1 % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected_periods(doc_id, text):
    words = looped(doc_id, words_of(text))
    runs, best = plain_runs(words), None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *four, digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(plain_collapsed(words, runs)))


def test_op11(spark, small):
    got = {r["doc_id"]: tuple(r) for r in queries.op11_periodic_runs(spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    assert got == {r["doc_id"]: expected_periods(r["doc_id"], r["text"]) for r in docs}
    assert sum(r[1] > 0 for r in got.values()) > 5


def test_op11_by_ranges_of_lags(spark, small):
    docs = periods.with_loops(spark.read.parquet(f"{small}/documents.parquet"))
    whole, dealt = periods.periodic_runs(docs), periods.periodic_runs(docs, whole_bytes=300, range_bytes=100)
    assert sorted(map(str, whole.collect())) == sorted(map(str, dealt.collect()))


def loops(rng):
    words = []
    while rng.random() < 0.8 and len(words) < 200:
        piece = [rng.choice("ab" if rng.random() < 0.5 else "abc") for _ in range(rng.randint(1, 9))]
        words += piece * rng.choice([1, 1, 2, 4, 9, 20])
        if rng.random() < 0.3:
            words = words + words
    return words[:400]


def test_op11_scan():
    rng = random.Random(5)
    for _ in range(150):
        docs = [loops(rng) for _ in range(rng.randint(1, 4))]
        texts = [" ".join(w).encode() for w in docs]
        units = word_units(np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts])))
        numbers, each = periods.word_numbers(units), rng.randint(1, 40)
        found = [[tuple(r.values()) for r in own] for own in periods._lists(periods.scan(numbers, units.offsets, 1, None, 24, 3), len(docs))]
        assert found == [plain_runs(w) for w in docs]
        parts = [r for first in range(1, 140, each) for r in periods.scan(numbers, units.offsets, first, np.full(len(docs), first + each - 1), 24, 3)]
        assert [[tuple(r.values()) for r in own] for own in periods._lists(parts, len(docs))] == found


def test_op11_hard_rows(spark):
    long = "na " * 40_000
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "x " * 23), (5, "x " * 24), (5, "x " * 24), (None, "a b " * 12), (6, " " + "é ü " * 30), (7, long), (8, " ".join(map(str, range(30_000))) + " " + "tick tock " * 20)]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, runs string, name int")
    got = sorted(((r["doc_id"] or 0, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periods.periodic_runs(df).collect()), key=str)
    want = []
    for i, t in rows:
        w = words_of(t)
        runs = plain_runs(w) if i not in (7, 8) else [(0, 40_000, 1)] if i == 7 else [(30_000, 40, 2)]
        want.append((i or 0, len(w), runs, plain_collapsed(w, runs)))
    assert got == sorted(want, key=str)
    assert periods.periodic_runs(df.filter("doc_id = -1")).count() == 0
    assert periods.derived(periods.periodic_runs(periods.with_loops(df))).count() == len(rows)


def plain_exact(rows):
    """(id, keep, size, kept, digest) of each row; of repeated rows one is kept."""
    groups = {}
    for n, (i, t) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, n, i))
    out = []
    for text, own in groups.items():
        best = min(own)
        out += [(o[4], best[4], len(own), o is best, hashlib.sha256(text.encode()).hexdigest()) for o in own]
    return sorted(out, key=str)


def test_op12_brute_force(spark):
    rng = random.Random(1)
    for size, share in ((0, 1000), (1, 1000), (400, 3), (400, 1000)):
        rows = [(rng.choice([None, *range(300)]), rng.choice([None, "", " ", "a b", "ab", "a\tb\x0b", "é\x85 x", " ab", "hot " * rng.randint(1, 3), "hot hot", str(rng.randint(0, 60))])) for _ in range(size)]
        df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, digest string, n int")
        got = exact.dedup_exact(df, hot_share=share).collect()
        # of rows that agree in all, either may be the one that stays
        assert sorted((tuple(r) for r in got), key=str) == plain_exact(rows)


def test_op12_batches_of_several_sessions(spark, tmp_path):
    folder = f"file://{tmp_path}/index"
    one = spark.createDataFrame([(5, "a b"), (6, "c"), (7, "c")], "doc_id long, text string")
    two = spark.createDataFrame([(1, "a   b"), (2, "d"), (3, "d"), (4, "e")], "doc_id long, text string")
    kept = lambda df: sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in df.collect())
    first, second = [(5, 5, 1, True), (6, 6, 2, True), (7, 6, 2, False)], [(1, 5, 1, False), (2, 2, 2, True), (3, 2, 2, False), (4, 4, 1, True)]
    assert kept(exact.dedup_exact(one, folder=folder, batch="one", buckets=3)) == first
    other = spark.newSession()
    other.conf.set("spark.sql.shuffle.partitions", "5")
    rows = other.createDataFrame(two.collect(), two.schema)
    assert kept(exact.dedup_exact(rows, folder=folder, batch="two")) == second
    assert kept(exact.dedup_exact(rows, folder=folder, batch="two")) == second  # again, as after a loss
    index = exact.DigestIndex(spark, folder, fan_in=2)
    assert index.buckets == 3 and sorted(index.runs()) == ["batch-one", "batch-two", "empty"]
    index.compact()
    assert len(index.runs()) == 1 and index.read(index.runs()[0]).count() == 4
    assert kept(exact.dedup_exact(two, folder=folder, batch="two")) == second  # its entries bear its name
    assert kept(exact.dedup_exact(one, folder=folder, batch="three")) == [(5, 5, 1, False), (6, 6, 2, False), (7, 6, 2, False)]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("digests_")]


def test_op12_is_native_and_joins_by_merging(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    index = exact.DigestIndex(spark, f"file://{tmp_path}/index", 4)
    entries = spark.createDataFrame([], exact.ENTRY)
    plan = index.fresh(index.dealt(entries), "b")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and plan.count("Exchange") == 1 and "Bucketed: true" in plan
    plan = exact.dedup_exact(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def plain_negatives(ids, labels, vectors, positives=5, negatives_=3):
    out = []
    for a in range(len(ids)):
        if ids[a] % 50:
            continue
        s = [sum(int(x) * int(y) for x, y in zip(vectors[a], v)) if len(v) == len(vectors[a]) else None for v in vectors]
        order = sorted((j for j in range(len(ids)) if s[j] is not None), key=lambda j: (-s[j], ids[j], j))
        for p in [j for j in order if j != a and labels[j] == labels[a]][:positives]:
            own = [j for j in order if labels[j] != labels[a] and 50 * s[p] <= 100 * s[j] <= 95 * s[p]][:negatives_]
            out += [(ids[a], ids[p], r, ids[j], s[p], s[j]) for r, j in enumerate(own, 1)]
    return sorted(out)


def test_op13(spark, small):
    t = spark.read.parquet(f"{small}/embeddings.parquet").toPandas()
    labels = [(x + 1) % 10 if i % 7 == 0 else x for i, x in zip(t.vec_id, t.label)]
    vectors = [np.floor(256 * np.asarray(v, float)).astype(int).tolist() for v in t.embedding]
    want = plain_negatives(t.vec_id.tolist(), labels, vectors)
    assert sorted(tuple(r) for r in queries.op13_hard_negatives(spark, small).collect()) == want and want


@pytest.mark.parametrize("scale", [1, 2**24])
def test_op13_many_pivots_clusters_and_ties(spark, scale):
    """Clustered vectors with repeated ones, in two lengths; the greater scale takes the longs."""
    rng = np.random.default_rng(7)
    rows, i = [], 0
    for d in (3, 6):
        for c in rng.integers(-9, 9, (12, d)):
            for _ in range(15):
                rows.append((i * 5, (c + rng.integers(-1, 2, d)).tolist(), int(rng.integers(0, 3))))
                i += 1
    rows += [(5000 + i, rows[0][1], i % 3) for i in range(40)] + [(50, rows[3][1], rows[3][2])]
    df = spark.createDataFrame([(i, [float(x) for x in v], y) for i, v, y in rows], "vec_id long, embedding array<double>, label int")
    found = negatives.hard_negatives(df, F.col("id") % 50 == 0, scale=scale, per_pivot=20, block=16, group=8)
    got = sorted(tuple(r) for r in found.collect())
    want = plain_negatives([r[0] for r in rows], [r[2] for r in rows], [[x * scale for x in r[1]] for r in rows])
    assert got == want


def test_op13_scans_part_of_the_index(spark, monkeypatch):
    """Of well separated clusters, a search scans few blocks."""
    rng = np.random.default_rng(2)
    x = np.concatenate([c + rng.normal(scale=0.01, size=(60, 16)) for c in rng.normal(size=(20, 16))])
    df = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    vectors = negatives.vectors_of(df, "vec_id", "embedding", "label", 256)
    index, n = negatives.Index(vectors, per_pivot=60, block=16, group=4), spark.sparkContext.accumulator(0)
    plain = negatives._scan

    def counted(groups, *args):
        n.add(sum(len(w) for w in groups.column("wanted").to_pylist()))
        return plain(groups, *args)

    monkeypatch.setattr(negatives, "_scan", counted)
    own = vectors.filter("id % 50 = 0").withColumn("query", F.col("row")).withColumn("self", F.col("row")).withColumn("low", F.lit(None).cast("long")).withColumn("high", F.lit(None).cast("long"))
    assert index.top(own, 5, same_label=True).count() == 24 * 5
    assert n.value < 24 * index.blocks.count() / 4


def test_op13_hard_rows(spark):
    rows = [(50, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.75, 0.0], 2), (3, [float("nan"), 0.0], 2), (4, [None, 1.0], 2), (5, None, 2), (6, [0.75, 0.0], None), (7, [], 2), (8, [0.75], 2), (9, [1e300, 0.0], 2), (None, [0.75, 0.0], 2), (100, [0.0, 0.0], 1), (2, [0.75, 0.0], 2), (11, [float("inf"), 0.0], 2)]
    df = spark.createDataFrame([(i, v, y, "x", 1) for i, v, y in rows], "vec_id long, embedding array<double>, label int, query string, d int")
    got = sorted(tuple(r) for r in negatives.hard_negatives(df, F.col("id") % 50 == 0).collect())
    p, n = 256 * 256, 256 * 192
    want = [(50, 1, 1, 2, p, n), (50, 1, 2, 2, p, n)] + [(100, i, k, 2, 0, 0) for i in (1, 50) for k in (1, 2)]
    assert got == sorted(want)
    assert negatives.hard_negatives(df.filter("vec_id = -1"), F.col("id") % 50 == 0).count() == 0


def plain_windows(docs, length):
    """(n_words, n_removed, kept) of each document by its place."""
    seen = {}
    for n, (_, t) in enumerate(docs):
        w = words_of(t)
        for i in range(len(w) - length + 1):
            seen.setdefault(tuple(w[i : i + length]), []).append((n, i))
    gone = {(n, i + j) for places in seen.values() if len(places) > 1 for n, i in places for j in range(length)}
    out = []
    for n, (i, t) in enumerate(docs):
        w = words_of(t)
        out.append((i, len(w), sum((n, j) in gone for j in range(len(w))), " ".join(x for j, x in enumerate(w) if (n, j) not in gone)))
    return out


def test_op10_batches_over_several_sessions(spark, tmp_path):
    """After every batch, each document's last row is what all batches so far leave of it."""
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefgh") + rng.choice("xy")
    shared = [[word() for _ in range(rng.randint(10, 30))] for _ in range(4)]
    folder, every, last = f"file://{tmp_path}/index", [], {}
    for b in range(6):
        docs = []
        for i in range(12 if b != 3 else 0):
            parts = [[word() for _ in range(rng.randint(0, 40))], rng.choice([*shared, [], []]), [word() for _ in range(rng.randint(0, 9))]]
            docs.append((b * 100 + i, " ".join(sum(parts, []))))
        docs += [(900 + b, None), (950 + b, every[0][1] if every else "")]
        every += docs
        session = spark.newSession()
        rows = session.createDataFrame([(i, t, "x", 5) for i, t in docs], "doc_id long, text string, batch string, block int")
        if b == 2:  # a batch that was cut off after its run was written, and another that never comes back
            with pytest.raises(ZeroDivisionError):
                with pytest.MonkeyPatch.context() as patch:
                    patch.setattr(fingerprints, "_removed", lambda *_: 1 / 0)
                    fingerprints.dedup_batch(rows, folder, "lost", length=9, k=4, buckets=4)
        got = [tuple(r) for r in fingerprints.dedup_batch(rows, folder, f"b{b}", length=9, k=4, buckets=4).collect()]
        assert sum(r[0] == f"b{b}" for r in got) == len(docs)
        for r in got:
            assert r[0] == f"b{b}" or r[3] > last[r[1]][1]  # older documents only if they lose words
            last[r[1]] = (r[2], r[3], bytes(r[5]).decode())
            assert r[4] == hashlib.sha256(r[5]).hexdigest()
        assert last == {i: (n, gone, kept) for i, n, gone, kept in plain_windows(every, 9)}
        again = fingerprints.dedup_batch(rows, folder, f"b{b}", length=9, k=4, buckets=4).collect()
        assert sorted(map(str, again)) == sorted(map(str, fingerprints.dedup_batch(rows, folder, f"b{b}", length=9, k=4, buckets=4).collect())) and len(again) == len(got)
    index = fingerprints.FingerprintIndex(spark, f"{folder}/windows-9-4-4", 4)
    assert any(level > 0 for level, _ in index.runs())  # runs were merged on the way
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("fingerprints_")]


def test_op10_reads_marked_blocks_alone(spark, tmp_path):
    docs = spark.createDataFrame([(i, " ".join(f"{i}w{j}" for j in range(60))) for i in range(200)], "doc_id long, text string")
    folder = f"file://{tmp_path}/index"
    fingerprints.dedup_batch(docs, folder, "a")
    copy = docs.filter("doc_id = 7").withColumn("doc_id", F.lit(1000).cast("long"))
    plans, plain = [], fingerprints._removed

    def spy(texts, *args):
        plans.append(texts._jdf.queryExecution().executedPlan().toString())
        return plain(texts, *args)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(fingerprints, "_removed", spy)
        got = fingerprints.dedup_batch(copy, folder, "b").collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in got) == [(7, 60), (1000, 60)]
    assert "dynamicpruning" in plans[0]


@pytest.mark.parametrize("operator", ["words", "bytes"])
def test_a_hot_window_is_sent_once_a_block(spark, monkeypatch, operator):
    """One passage in many documents, each time between other words: each window of it is sent
    once for each block that holds it, and no bucket gathers what lies around it."""
    rng = random.Random(4)
    core = " ".join(f"core{i}" for i in range(40))
    docs = [(i, " ".join(str(rng.random()) for _ in range(9)) + f" {core} " + " ".join(str(rng.random()) for _ in range(9))) for i in range(300)]
    docs += [(900, None), (901, core), (902, "alone " * 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    module, run = (fingerprints, lambda **k: fingerprints.dedup_windows(df, **k)) if operator == "words" else (substrings, lambda **k: substrings.dedup_substrings(df, **k))
    sent, plain = {}, repeats.verdicts

    def spy(segments, *args):
        sent[len(sent)] = [(r["bucket"], x, w) for r in segments.collect() for x, w in zip(np.frombuffer(r["hash"], np.uint64).tolist(), np.frombuffer(r["windows"], np.int64).tolist())]
        return plain(segments, *args)

    with monkeypatch.context() as m:
        m.setattr(repeats, "verdicts", spy)
        m.setattr(module, "block_count", lambda docs: 3)
        rows = [sorted(map(str, run(hot_places=n).collect())) for n in (1 << 40, 20)]
    assert rows[0] == rows[1]
    if operator == "words":
        want = {i: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in plain_windows(docs, 35)}
        assert {r["doc_id"]: tuple(r)[1:] for r in run(hot_places=20).collect()} == want
    cold, hot = sent[0], sent[1]
    gathered = lambda rows: max(collections.Counter(b for b, _, _ in rows).values())
    assert max(collections.Counter(x for _, x, _ in hot).values()) <= 3  # blocks
    assert operator == "bytes" or {w for _, _, w in hot} == {1}  # digits have anchors that repeat a few times, too
    assert gathered(cold) >= 300 and gathered(hot) < len(hot) / 4
