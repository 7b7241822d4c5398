"""Each stage against brute force on its own input, and the whole."""

import random

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F
from test_copies import WS, brute_repeats, words_of
from test_similar import brute

from tallyhouse.llm import toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, words int, row string"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(11)
    vocabulary = [f"{a}{b}" for a in ("the", "an", "er", "ti", "lo", "wo") for b in ("on", "ly", "st", "ha", "nd", "re", "", "ou", "ea")]
    draw = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passage, base = draw(60), draw(500)
    texts, toxic = [], []
    for i in range(420):
        bad = r.random() < 0.2
        words = draw(r.randrange(15, 120))
        if i % 17 == 0:
            words[5:5] = passage
        if bad:
            for _ in range(3):
                words[r.randrange(len(words))] = r.choice(["grubbel", "idiot", "vexlit"])
        texts.append(" ".join(words))
        toxic.append(bad)
    for i in range(12):
        near = list(base)
        near[r.randrange(500)] = f"n{i}"
        texts += [" ".join(near), " ".join(base) + " " * i]
    texts += [None, "", "  ", texts[3], texts[3] + "\n"]
    rows = [(i, t, None if i == 4 else "en", "s", len(t or ""), i, "x") for i, t in enumerate(texts)]
    rows += [rows[7], (None, "no id here", None, None, None, None, None)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(b)) for i, b in enumerate(toxic)], "doc_id bigint, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows, toxic


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages(spark, corpus):
    path, rows, toxic = corpus
    docs = spark.createDataFrame(rows, SCHEMA)

    out = cp.drop_toxic(spark, docs, path)
    model = toxicity.fit(docs, spark.read.parquet(f"{path}/labels.parquet"), usable=F.lit(True))
    scores = {r.doc_id: r.score for r in model.score(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).collect()}
    kept = as_rows(out)
    assert kept == sorted((r for r in rows if scores[r[0]] < cp.THRESHOLD), key=str) and out.columns == docs.columns
    assert not any(toxic[r[0]] for r in kept if r[0] is not None and r[0] < len(toxic)) and len(kept) >= len(rows) - sum(toxic) - 2

    docs, rows = spark.createDataFrame(kept, SCHEMA), kept
    out = cp.drop_exact_copies(spark, docs, path)
    groups = {}
    for r in rows:
        groups.setdefault(WS.sub("", r[1] or ""), []).append(r)
    want = [min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)) for g in groups.values()]
    assert as_rows(out) == sorted(want, key=str) and out.columns == docs.columns

    docs, rows = spark.createDataFrame(want, SCHEMA), want
    out = cp.drop_near_copies(spark, docs, path)
    ids = [-1 if r[0] is None else r[0] for r in rows]
    roots = brute(ids, [r[1] for r in rows])
    want = [r for r, i, root in zip(rows, ids, roots, strict=True) if i == root]
    assert as_rows(out) == sorted(want, key=str) and out.columns == docs.columns and len(want) < len(rows)

    docs, rows = spark.createDataFrame(want, SCHEMA), want
    out = cp.cut_repeats(spark, docs, path)
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns == docs.columns and len(got) == len(rows)
    removed = 0
    for r, (words, gone) in zip(rows, brute_repeats([r[1] for r in rows]), strict=True):
        new = got[r[0]]
        assert words_of(new.text) == [w for w, g in zip(words, gone, strict=True) if not g]
        assert new.n_chars == len(new.text) and (any(gone) or new.text == (r[1] or "")) and tuple(new)[2:4] == r[2:4]
        removed += sum(gone)
    assert removed > 500


def test_whole(spark, corpus):
    path, rows, _ = corpus
    out = cp.run(spark, path).collect()
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out[0].asDict())
    assert 200 < len({r.doc_id for r in out}) < len(rows)
