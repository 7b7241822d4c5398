"""Groups of similar shingle sets against brute force over all pairs."""

import random
import re

import corpus_pipeline as cp
from test_copies import SCHEMA, words_of

from tallyhouse.llm import similar


def shingle_set(text):
    words = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(ids, texts):
    """The smallest id that links of Jaccard similarity 0.8 or more reach."""
    sets, label = [shingle_set(t) for t in texts], list(ids)
    alike = lambda a, b: a == b or 5 * len(a & b) >= 4 * len(a | b) > 0
    pairs = [(i, j) for i in range(len(ids)) for j in range(i) if alike(sets[i], sets[j])]
    changed = True
    while changed:
        changed = False
        for i, j in pairs:
            if label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    return label


def corpus():
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    draw = lambda n: [r.choice(vocabulary) for _ in range(n)]

    def edited(words, edits):
        out = list(words)
        for _ in range(edits):
            out[r.randrange(len(out))] = f"e{r.random()}"
        return " ".join(out)

    texts = [None, "", "one two", "One  two", "one two three"]
    for _ in range(15):
        base = draw(r.randrange(60, 400))
        texts += [" ".join(base), *(edited(base, 1 + int(len(base) * share)) for share in (0.0, 0.005, 0.01, 0.015, 0.02, 0.03, 0.05))]
    center, passage = draw(300), draw(80)
    texts += [edited(center, r.randrange(1, 9)) for _ in range(80)]  # a large group; many pairs of it are under the threshold
    texts += [" ".join(draw(10) + passage + draw(r.randrange(5, 60))) for _ in range(40)]
    r.shuffle(texts)
    return texts


def test_near_duplicates(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, None, "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.component_id for r in similar.near_duplicates(docs).collect()}
    want = brute(range(len(texts)), texts)
    assert [got[i] for i in range(len(texts))] == want
    stage = cp.drop_near_copies(spark, docs, "")
    assert sorted(r.doc_id for r in stage.collect()) == [i for i, root in enumerate(want) if i == root]
    assert similar.near_duplicates(docs.limit(0)).collect() == []


def test_hot_texts_and_sets_named_by_128_bits(spark, monkeypatch):
    """One text in most rows, and sets whose 64-bit hashes would be equal, keep their own links."""
    from tallyhouse.llm import common, similar

    monkeypatch.setattr(common, "HOT_COPIES", 5)
    hot, near = "one text in most of all the rows here " * 3, "one text in most of all the rows here " * 3 + "now"
    rows = [(i, hot) for i in range(60)] + [(100, near), (101, "something else altogether in this one row"), (102, None), (103, "")]
    docs = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id bigint, text string, node int, set string")
    out = similar.near_duplicates(docs).collect()
    assert {r.doc_id: r.component_id for r in out} == {i: 0 for i in range(60)} | {100: 0, 101: 101, 102: 102, 103: 102}
    assert len(out) == len(rows) and len({r.node for r in out}) == 4
