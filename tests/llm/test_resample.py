"""Importance resampling against a plain reckoning over all texts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyhouse.llm import registry, resample
from tallyhouse.llm.buffers import view

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
CAPITALS = {c: c + 32 for c in range(65, 91)}


def features(text, longest=2):
    words = WORD.findall((text or "").translate(CAPITALS))
    return words, [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def brute(docs, target, percent=25, least=20, buckets=10_000, seed=7):
    own = [(d, *features(t)) for d, t in docs]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(bucket(f) for _, _, fs in own for f in fs), Counter(bucket(f) for x in target for f in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    rows = []
    for d, words, fs in own:
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, len(words), len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    order = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    ranks = Counter()
    place = {}
    for i, r in enumerate(order[: len(order) * percent // 100], 1):
        place.setdefault(r[0], []).append(i)
    out = []
    for d, words, n, weight, score in rows:
        mine = place.get(d, []) if words >= least else []
        out.append((d, n, weight, score, mine[ranks[d]] if ranks[d] < len(mine) else None))
        ranks[d] += bool(words >= least)
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "B", "é", "9", " ", "\n", ".", "zz", "Q" * 60, "😀"]), max_size=25).map("".join), min_size=1, max_size=5))
def test_words_and_their_checksums(texts):
    words = resample.Words(*view(pa.array(texts)))
    for k, (first, _, crc) in enumerate(words.runs(3), 1):
        want = [(i, zlib.crc32(" ".join(ws[j : j + k]).encode())) for i, t in enumerate(texts) for ws in [features(t)[0]] for j in range(len(ws) - k + 1)]
        assert list(zip(words.text[first].tolist(), crc.tolist(), strict=True)) == want


def test_feature_counts(spark):
    texts = ["One line\nanother LINE", "one line", None, "", "one line\n\n..\nline one line", "word" * 200_000, "a " * 100_000]
    docs = spark.createDataFrame([(t, 1, 2) for t in texts], "text string, line int, times int")
    for longest in (1, 2, 3):
        want = Counter(zlib.crc32(f.encode()) % 97 for t in texts for f in features(t, longest)[1])
        assert dict(resample.feature_counts(docs, longest, 97).collect()) == dict(want)


def test_drawn_rows(spark):
    pick = random.Random(5)
    words = ["red", "green", "blue", "Mesa", "äther", "x", "\n", "10"]
    docs = [(i, " ".join(pick.choice(words) for _ in range(pick.randrange(60)))) for i in range(300)]
    docs += [(None, "red green " * 30), (300, None), (301, ""), (7, docs[7][1]), (302, "red\n" * 50_000)]
    target = ["red green red green mesa", None]
    frame = spark.createDataFrame([(d, t, 1, 2, "r") for d, t in docs], "doc_id bigint, text string, rank int, score int, weight string")
    out = resample.resample(frame, spark.createDataFrame([(t,) for t in target], "text string"))
    found = [(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in out.collect()]
    assert ordered(found) == ordered(brute(docs, target))


def test_equal_scores_go_by_id(spark):
    rows = [(i, 20 + (i % 9 == 0) - (i % 7 == 0), 100 * (i % 3)) for i in range(90)]
    out = resample.drawn(spark.createDataFrame(rows, "doc_id bigint, n_words bigint, score bigint"), percent=50).collect()
    order = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[2], r[0]))
    want = {r[0]: i for i, r in enumerate(order[: len(order) // 2], 1)}
    assert len(out) == 90 and {r.doc_id: r["rank"] for r in out if r["rank"]} == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    some = spark.createDataFrame([(1, "a b " * 20)], "doc_id bigint, text string")
    assert resample.resample(docs, some).count() == 0
    assert resample.resample(some, docs).count() == 1
    assert (resample.gains(*[resample.feature_counts(docs)] * 2) == np.zeros(10_000)).all()


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    read = lambda name, *c: [tuple(r) for r in spark.read.parquet(f"{sf}/{name}.parquet").select(*c).collect()]
    out = registry.op12_importance_resampling(spark, sf).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert ordered(map(tuple, out)) == ordered(brute(read("documents", "doc_id", "text"), [t for (t,) in read("benchmark", "text")]))
