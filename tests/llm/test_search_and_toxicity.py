"""Neighbours against brute force, toxicity on rows that were not learned from."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyhouse.llm import forest, registry, toxicity


def brute(vectors, queries, k):
    out = {}
    for q, v in queries:
        ranked = sorted(((float(np.dot(np.array(x), np.array(v))), i) for i, x in vectors if i != q), key=lambda t: (-t[0], t[1]))
        out[q] = ranked[:k]
    return out


def clean(rows):
    return [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 4]


def test_small_tables_are_searched_whole(spark):
    r = random.Random(2)
    rows = [(i, [r.choice([-1.0, 0.5, 2.0]) for _ in range(4)]) for i in range(120)]
    rows += [(200 + i, [1.0, 1.0, 0.5, -1.0]) for i in range(60)]
    rows += [(300, None), (320, [0.0] * 4), (340, [1.0, None, 0.0, 0.0]), (360, [float("nan"), 1.0, 0.0, 0.0]), (380, [float("inf"), 1.0, 0.0, 0.0]), (400, [1.0, 2.0]), (None, [1.0] * 4), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = {}
    for x in forest.search(df, df.where("vec_id % 20 = 0"), k=20).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    own = list(dict(clean(rows)).items())
    want = brute(own, [(i, v) for i, v in own if i % 20 == 0], 20)
    assert {q: [(n + 1, i, pytest.approx(s)) for n, (s, i) in enumerate(x)] for q, x in want.items()} == {q: sorted(x) for q, x in got.items()}


def test_forest_recall_and_exact_scores(spark, tmp_path):
    r = np.random.default_rng(4)
    x = r.standard_normal((6000, 64)).astype(np.float32)
    x[:3000] *= r.uniform(0.8, 1.25, (3000, 1))
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>").repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    vectors = spark.read.parquet(f"{tmp_path}/embeddings.parquet")
    found = forest.search(vectors, vectors.where("vec_id % 100 = 0"), k=20, least=100, shard_rows=2500).toPandas()
    d = x.astype(float)
    hits = 0
    for q, own in found.groupby("query_id"):
        s = d @ d[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:20]) & set(own.vec_id))
        assert np.allclose(own.score, s[own.vec_id]) and own.sort_values("rank").score.is_monotonic_decreasing and len(own) == 20
    assert hits / (60 * 20) >= 0.9


def test_few_or_no_candidates(spark):
    df = lambda rows: spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    assert forest.search(df([]), df([])).count() == 0
    assert forest.search(df([(0, [1.0])]), df([(0, [1.0])])).count() == 0
    assert [(x.query_id, x.vec_id) for x in forest.search(df([(0, [1.0]), (3, [1.0])]), df([(0, [1.0])])).collect()] == [(0, 3)]


def corpus(n, seed=1):
    r = random.Random(seed)
    common = [f"{a}{b}" for a in ("the", "an", "er", "ti", "lo", "wo") for b in ("on", "ly", "st", "ha", "nd", "re", "")]
    bad = ["grubbel", "snarfo", "idiot", "vexlit"]
    rows, labels = [], []
    for i in range(n):
        toxic = r.random() < 0.15
        words = [r.choice(common) for _ in range(r.randrange(20, 200))]
        if toxic:
            for _ in range(2 + len(words) // 40):
                words[r.randrange(len(words))] = r.choice(bad) + r.choice(["", "a", "ing", "x", "!"])
        rows.append((i, " ".join(words)))
        if r.random() < 0.8:
            labels.append((i, int(toxic)))
    return rows + [(n, None), (n + 1, ""), (n + 1, "")], labels, bad


def test_held_out_rows(spark, tmp_path):
    rows, labels, bad = corpus(1500)
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = registry.op6_toxicity(spark, str(tmp_path)).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    truth = {i: int(any(b in (t or "") for b in bad)) for i, t in rows}
    held = [r for r in out if r.held_out]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 3 == 1) == r.held_out for r in out)
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "you idiot"), (2, None)], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    got = {r.doc_id: r.score for r in toxicity.scores(docs, none, F.lit(True)).collect()}
    assert got[1] > got[2] == 0.0
    assert toxicity.scores(docs.limit(0), none, F.lit(True)).count() == 0
