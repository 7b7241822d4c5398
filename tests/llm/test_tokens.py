"""Packing and byte-level BPE against the tokenizer libraries themselves."""

import base64
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from tallyhouse.llm import bpe, packing, registry, tokens

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = [
    None, "", " ", "a", "Hello, World!", "don't we'LL I'M", "foo,bar foo, foo.", "été ÉTÉ Été İstanbul ΣΑΣ ſ K", "<|endoftext|> <|ENDOFTEXT|>", "a\x1cb\x85c d e", "“quote”, …,. x…", "汉字 かな 123456 ½ Ⅷ",
    "  \n\n  x  \t y\r\n", "naïve" * 30, "́a ́", "🙂🙃 👩‍👩‍👧", "x" * 5000, "word " * 3000, "a'b's 'tis 's,", "don't, can't. it's",
]


def mixed(n, seed=5):
    r = random.Random(seed)
    parts = ["the", "ation", "é", "ß", "Der", "'s", ",", ".\n", " ", "  ", "12", "—", "\t", "语", "don't", "\n\n", "!"]
    return "".join(r.choice(parts) + r.choice(["", " "]) for _ in range(n))


def own_ids(text):
    return Tokenizer.from_file(WORDS).encode(text or "", add_special_tokens=False).ids


def test_remembered_words_give_the_library_ids():
    t = tokens.WordTokenizer(WORDS, limit=50)
    for text in [x or "" for x in TEXTS] + [mixed(k * 50) for k in range(1, 20)]:
        assert np.frombuffer(t.ids([text.encode()])[0], "<u4").tolist() == own_ids(text), text[:80]
    many = [mixed(30, k) for k in range(40)]
    assert [np.frombuffer(x, "<u4").tolist() for x in t.ids([x.encode() for x in many])] == [own_ids(x) for x in many]


def test_pieces_and_sequences(spark, tmp_path):
    texts = TEXTS + [mixed(k * 40, k) for k in range(60)] + ["same text"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = registry.op3_best_fit_packing(spark, str(tmp_path)).collect()
    got = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows}
    want = {}
    for i, text in enumerate(texts):
        ids = np.array([*own_ids(text), 0], "<u4")
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[i, k] = (at, len(part), zlib.crc32(part.tobytes()))
    assert got == want and len(rows) == len(want)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in rows)
    assert len(bins) <= -(-total // 2048) + 1


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(rule):
    r = np.random.default_rng(3)
    n = np.sort(r.integers(1, 100, 500))[::-1]
    sizes = np.stack([n, np.ones_like(n), n * n], axis=1).astype(float)
    caps = np.array([128.0, 4.0, 10_000.0])
    bins = packing.best_fit(sizes, caps, np.array([1.0, 0.5, 0.5]), rule)
    for b in set(bins):
        assert (sizes[bins == b].sum(axis=0) <= caps + 1e-9).all()
    assert len(set(bins)) >= max(np.ceil(sizes.sum(axis=0) / caps))
    assert len(set(bins)) <= 1.15 * max(np.ceil(sizes.sum(axis=0) / caps))


def test_capacities_through_spark(spark):
    docs = spark.createDataFrame([(i, "a b c") for i in range(50)], "doc_id bigint, text string")
    out = packing.pack(docs, WORDS, capacity=64, max_docs=3).groupBy("sequence_id").count().collect()
    assert max(r["count"] for r in out) == 3 and len(out) == 17


def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 24), (1000, 100), (32_768, 1024)])
def test_chunks_give_the_library_ids(spark, chunk, overlap):
    texts = TEXTS + [mixed(k * 100, k) for k in range(30)] + [" " * 3000 + "x", "\n" * 2500 + " y" * 900, "same text again " * 20, "same text again " * 20]
    docs = spark.createDataFrame([(None if i == 7 else i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string")
    out = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN, chunk, overlap), RANKS, public_tokenizers.PATTERN).collect()
    e = encoding()
    assert {r.doc_id: (r.ids, bytes(r.data)) for r in out} == {None if i == 7 else i: (e.encode_ordinary(t or ""), (t or "").encode()) for i, t in enumerate(texts)}
    assert len(out) == len(texts)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert bpe.encode(none, RANKS, public_tokenizers.PATTERN).count() == 0
    assert packing.pack(none, WORDS).count() == 0
