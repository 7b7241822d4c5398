"""Vectors of several lengths, and the registered query's recall."""

import numpy as np
from pyspark.sql import functions as F

from tallyhouse.llm import forest, registry

SCHEMA = "vec_id bigint, embedding array<float>, name string, shard int, square double"


def rows_of(x, ids):
    return [(int(i), [float(c) for c in v], "n", 1, 2.0) for i, v in zip(ids, x, strict=True)]


def test_lengths_are_searched_apart(spark):
    r = np.random.default_rng(3)
    short, long = r.standard_normal((100, 2)), r.standard_normal((30, 3))
    rows = rows_of(short, range(100)) + rows_of(long, range(100, 130)) + rows_of([[9.0, 9.0, 9.0, 9.0]], [140])
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for x in forest.search(df, df.where("vec_id % 20 = 0"), k=5).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id))
    for own, first in ((short.astype(np.float32).astype(float), 0), (long.astype(np.float32).astype(float), 100)):
        for q in range(first, first + len(own)):
            if q % 20 == 0:
                s = own @ own[q - first]
                s[q - first] = -np.inf
                assert [i for _, i in sorted(got.pop(q))] == (first + np.argsort(-s)[:5]).tolist()
    assert got == {}


def test_a_vector_longer_than_the_rest_removes_none(spark):
    x = np.random.default_rng(1).standard_normal((100, 2))
    df = spark.createDataFrame(rows_of(x, range(100)), SCHEMA)
    more = df.unionByName(spark.createDataFrame(rows_of([[1.0, 2.0, 3.0]], [200]), SCHEMA))
    found = lambda d: sorted(map(tuple, forest.search(d, d.where("vec_id % 20 = 0")).collect()))
    assert found(more) == found(df) and len(found(df)) == 100


def test_registered_query(spark, tmp_path):
    """Recall of the query as registered, on vectors in several shards, and the share of rows that it scores."""
    r = np.random.default_rng(8)
    x = r.standard_normal((9000, 64)).astype(np.float32)
    x[::7] *= 1.2
    spark.createDataFrame(rows_of(x, range(len(x))), SCHEMA).select("vec_id", "embedding").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = registry.op8_hash_prefix_forest(spark, str(tmp_path)).where(F.col("query_id") % 100 == 0).toPandas()
    d, hits = x.astype(float), 0
    for q, own in out.groupby("query_id"):
        s = d @ d[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:20]) & set(own.vec_id))
        assert len(own) == 20 and np.allclose(own.score, s[own.vec_id])
    assert out.query_id.nunique() == 90 and hits / (90 * 20) >= 0.9
