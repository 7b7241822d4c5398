"""Long texts without spaces, and the registered query against the library."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from tallyhouse.llm import bpe, registry

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def scripts(seed):
    r = random.Random(seed)
    han = lambda n: "".join(chr(r.randrange(0x4E00, 0x5000)) for _ in range(n))
    return [
        "。".join(han(r.randrange(2, 30)) for _ in range(60)),
        ",".join(str(r.randrange(10**6)) for _ in range(300)),
        "".join(r.choice(["ab", "12", "'s", "é", "é", "!", " ", "’ll", "\n", "٣", "it's"]) for _ in range(1500)),
        han(900) + "。" + han(20) + " x " + "a" * 700 + " end. " * 40,
        "a" * 1500, "7" * 1500, "!" * 1500, " " * 700 + "b" * 300 + "\n" * 400, "x's" * 500,
    ]


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 24), (200, 50), (500, 499)])
def test_scripts_without_spaces(spark, chunk, overlap):
    texts = [t for seed in range(4) for t in scripts(seed)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    e = encoding()
    got = {r.doc_id: r.ids for r in bpe.encode(docs, RANKS, public_tokenizers.PATTERN, chunk, overlap).collect()}
    assert got == {i: e.encode_ordinary(t) for i, t in enumerate(texts)}


def test_places_to_stitch():
    found = lambda t: bpe.boundaries(t, public_tokenizers.PATTERN, 1, 10**6)
    assert found("ab。cd") == {2} and found("12,3 b") == {2, 4} and found("it's") == set() and found("éx") == set() and found("a1b") == {1, 2}


def test_registered_query(spark, tmp_path):
    rows = [(1, "one two"), (2, None), (3, ""), (4, "wörd " * 20_000), (4, "again"), (None, "x" * 50_000), (6, "漢字。" * 20_000)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    e, sha = encoding(), lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in rows:
        ids = e.encode_ordinary(t or "")
        want.append((i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())))
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in registry.op9_byte_bpe(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
