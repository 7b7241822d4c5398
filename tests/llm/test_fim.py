"""Fill-in-the-middle forms against plain string slicing, and back."""

import hashlib
import random

import pytest

from tallyhouse.llm import fim, registry

SIGNS = ("<P>", "<S>", "<M>")


def expected(doc_id, text, seed=1):
    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    text = text or ""
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in SIGNS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def awkward(count=400):
    pick = random.Random(3)
    letters = ["a", "é", "€", "😀", "<", "P", "S", "M", ">", "\n", " ", "\0"]
    rows = [(i, "".join(pick.choice(letters) for _ in range(pick.randrange(40)))) for i in range(count)]
    return rows + [(None, "a text without an id"), (count, None), (count + 1, ""), (1, "again"), (1, "again"), (count + 2, "ab<M>cd"), (count + 3, "long é" * 400_000)]


def test_every_form(spark):
    rows = awkward()
    docs = spark.createDataFrame([(*r, 5, "x", "y") for r in rows], "doc_id bigint, text string, n int, form string, output string")
    out = fim.transform(docs)
    found = sorted((r.doc_id is None, r.doc_id or 0, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out.collect())
    assert found == sorted((d is None, d or 0, *expected(d, t)) for d, t in rows)
    back = fim.restore(out).collect()
    key = lambda d, t: (d is None, d or 0, t)
    assert sorted(key(r.doc_id, r.restored) for r in back) == sorted(key(d, t or "") for d, t in rows)
    assert {r.form for r in back} == {"plain", "psm", "spm"}


def test_windows_and_slabs(monkeypatch):
    """Places and shifts are the same whatever the window."""
    import pyarrow as pa

    texts = [t or "" for _, t in awkward(200)][:206]
    for window in (1, 7, 64):
        monkeypatch.setattr(fim, "WINDOW", window)
        data, offsets = fim.view(pa.array(texts[:200]))
        seen = fim.ranks(data, offsets)
        assert [len(t) for t in texts[:200]] == (seen[1:] - seen[:-1]).tolist()
        assert fim.places(data, seen).tolist() == offsets.tolist() if texts[199] else True


@pytest.mark.parametrize("output", ["", "<P>a<S>b", "<P>a<M>b<S>c", "<S>a<P>b<S>c", "no signs"])
def test_outputs_that_are_none_of_ours(spark, output):
    rows = spark.createDataFrame([("psm", output), ("plain", output), (None, None)], "form string, output string")
    assert [r.restored for r in fim.restore(rows).collect()] == [None, output, ""]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert fim.restore(fim.transform(docs)).count() == 0


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        n, form, p, m, out = expected(r.doc_id, r.text)
        want[r.doc_id] = (n, form, p, m, sha(out), sha(r.text or ""))
    assert {r[0]: tuple(r[1:]) for r in registry.op11_fill_in_middle(spark, sf).collect()} == want
