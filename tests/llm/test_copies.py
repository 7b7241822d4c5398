"""Exact, near and partial copies against brute force on small tables."""

import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import Row
from pyspark.sql import functions as F

from tallyhouse.llm import exact, graph, registry, simhash, substring

WS = re.compile(r"[\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words_of(text):
    return [w for w in WS.split(text or "") if w]


def table(spark, tmp_path, texts, ids=None):
    rows = [(i, t, None, "s", len(t or "")) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def awkward(seed=1):
    """Nulls, blanks, repeated rows, long texts, near copies and passages."""
    r = random.Random(seed)
    vocabulary = ["ab", "c", "dé", "x y", "Zed,", "q1"] + [f"w{i}" for i in range(300)]
    draw = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passage, base = draw(60), draw(400)
    texts = [None, "", " \t\n", "one", "One two", "one  two", "a b c", "a b c", " ".join(passage), " ".join(draw(50) + passage + draw(20)), "\n".join(passage[5:50]), " ".join(["ha"] * 80), " ".join(draw(5000))]
    texts += [" ".join(base)] * 3 + ["\n ".join(base), " ".join(base) + " "]
    for i in range(30):
        other = list(base)
        other[r.randrange(400)] = f"new{i}"
        texts.append(" ".join(other))
    return texts + [" ".join(draw(r.randrange(1, 90))) for _ in range(40)]


def brute_fingerprint(text, width=3):
    words = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints, bits=2):
    label = dict(enumerate(ids))
    changed = True
    while changed:
        changed = False
        for i in range(len(ids)):
            for j in range(len(ids)):
                if (prints[i] ^ prints[j]).bit_count() <= bits and label[j] < label[i]:
                    label[i], changed = label[j], True
    return [label[i] for i in range(len(ids))]


def test_simhash_against_brute_force(spark, tmp_path):
    texts = awkward()
    sf = table(spark, tmp_path, texts)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in registry.op7_simhash(spark, sf).collect()}
    prints = [brute_fingerprint(t) for t in texts]
    roots = brute_components(range(len(texts)), prints)
    assert got == {i: (f"{p:016x}", c) for i, (p, c) in enumerate(zip(prints, roots, strict=True))}


@pytest.mark.parametrize("n", [40, 400])
def test_links_in_dense_lists(spark, n):
    """Fingerprints that share six bytes and more: short lists by neighbours, long ones by flipped bits."""
    r = random.Random(n)
    fps = {0xF0E1D2C3B4A59687 ^ (r.getrandbits(10) << 50) ^ (1 << r.randrange(64)) for _ in range(n)} | {0, 1, 3, 2**63, 2**64 - 1}
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    got = [tuple(sorted((a % 2**64, b % 2**64))) for a, b in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp bigint")).collect()]
    want = {tuple(sorted((a, b))) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2}
    assert len(got) == len(set(got)) and set(got) == want


def test_components_around_a_hub(spark, monkeypatch):
    from tallyhouse.llm import common

    monkeypatch.setattr(common, "HOT_COPIES", 50)
    for hub in (0, 9999):
        links = [(hub, i) for i in range(1, 400)] + [(399, 500), (600, 601)]
        got = {(r.node, r.root) for r in graph.components(spark.createDataFrame(links, "a bigint, b bigint"), "a", "b").collect()}
        least = min(hub, 1)
        assert got == {(n, least) for n in (*range(1, 400), hub, 500)} | {(600, 600), (601, 600)}


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (105, 101), (7, 7)]
    got = {(r.node, r.root) for r in graph.components(spark.createDataFrame(links, "a bigint, b bigint"), "a", "b").collect()}
    assert {(n, 0) for n in range(41)} | {(n, 100) for n in (100, 101, 105)} == got
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


def test_exact_against_brute_force(spark, tmp_path):
    texts = awkward()
    sf = table(spark, tmp_path, texts)
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(WS.sub("", t or ""), []).append(i)
    want = set()
    for norm, ids in groups.items():
        keep = min(ids, key=lambda i: (-len(texts[i] or ""), i))
        want |= {(i, keep, len(ids), i == keep, hashlib.sha256(norm.encode()).hexdigest()) for i in ids}
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in registry.op5_exact_dedup(spark, sf).collect()} == want


def test_exact_state_outlasts_batches(spark):
    frame = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string, kept string")
    state = exact.DigestState(spark)
    state.ingest(frame([(5, "a b", ""), (6, "c", "")]))
    state.ingest(frame([(4, "ab", ""), (7, "a  b", ""), (None, "c", "")]))
    got = {(r.keep_id, r.copies) for r in state.groups().collect()}
    assert got == {(7, 3), (6, 2)}


def test_exact_checks_full_bytes(spark, monkeypatch):
    """With a digest that collides, full bytes still tell texts apart."""
    monkeypatch.setattr(exact, "_digest", lambda norm: F.unhex(F.lit("00")))
    docs = spark.createDataFrame([(1, "a"), (2, " a"), (3, "b"), (4, "b"), (5, "c")], "doc_id bigint, text string")
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.deduplicate(docs).collect()}
    assert got == {(1, 2, 2, False), (2, 2, 2, True), (3, 3, 2, True), (4, 3, 2, False), (5, 5, 1, True)}


def brute_repeats(texts, width=35):
    lists, seen = [words_of(t) for t in texts], {}
    for ws in lists:
        for i in range(len(ws) - width + 1):
            key = tuple(ws[i : i + width])
            seen[key] = seen.get(key, 0) + 1
    for ws in lists:
        gone = [False] * len(ws)
        for i in range(len(ws) - width + 1):
            if seen[tuple(ws[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        yield ws, gone


def test_repeats_against_brute_force(spark, tmp_path):
    texts = awkward()
    sf = table(spark, tmp_path, texts)
    want = {(i, len(ws), sum(gone), hashlib.sha256(" ".join(w for w, g in zip(ws, gone, strict=True) if not g).encode()).hexdigest()) for i, (ws, gone) in enumerate(brute_repeats(texts))}
    assert {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in registry.op4_substring_dedup(spark, sf).collect()} == want


@pytest.mark.parametrize("width", [1, 5, 13, 35, 50])
def test_repeats_at_other_widths(spark, width):
    texts = awkward(3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = {(i, sum(gone)) for i, (_, gone) in enumerate(brute_repeats(texts, width))}
    assert {(r.doc_id, r.n_removed) for r in substring.remove_repeats(docs, width=width).collect()} == want


def test_kept_text_keeps_its_white_space(spark):
    run = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, f"  Head\n\n{run}\ttail \n end "), (2, run), (None, "as\n it  is")], "doc_id bigint, text string")
    got = {r.doc_id: r.kept_text for r in substring.remove_repeats(docs).collect()}
    assert got == {1: "  Head\n\ntail \n end ", 2: "", None: "as\n it  is"}


def test_covers():
    for width in (1, 2, 8, 35, 64):
        period, cover = substring.difference_cover(width)
        assert {(a - b) % period for a in cover for b in cover} == set(range(period)) and period <= width


@pytest.mark.parametrize("rows", [[], [(None, None), (None, None), (3, "x y z"), (3, "x y z")]])
def test_empty_tables_nulls_and_repeated_rows(spark, rows):
    docs = spark.createDataFrame([Row(doc_id=i, text=t, keep_id=1, fp="x", key="k", digest=2) for i, t in rows] or [], "doc_id bigint, text string, keep_id int, fp string, key string, digest int")
    for op in (exact.deduplicate, simhash.near_duplicates, substring.remove_repeats):
        assert op(docs).count() == len(rows)


def test_repeated_rows_have_each_place_once(spark):
    """Rows repeated in full: what moves grows with their number, not with its square."""
    text = " ".join(f"w{i}" for i in range(100))
    counted = lambda n: substring._repeated(spark.createDataFrame([(1, 7, i % 66, 1) for i in range(66 * n)], "h0 bigint, key bigint, at bigint, n tinyint"), ["h0"]).first().places
    assert sorted(counted(20)) == list(range(66))
    docs = spark.createDataFrame([(1, text)] * 300 + [(2, "short")], "doc_id bigint, text string")
    assert {(r.doc_id, r.n_removed, r["count"]) for r in substring.remove_repeats(docs).groupBy("doc_id", "n_removed").count().collect()} == {(1, 100, 300), (2, 0, 1)}


def test_colliding_row_names(spark, monkeypatch):
    """Rows that share half of their name keep their own windows."""
    monkeypatch.setattr(substring, "row_key", lambda *c: F.lit(5).cast("bigint"))
    texts = awkward(4)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = {(i, sum(gone)) for i, (_, gone) in enumerate(brute_repeats(texts))}
    assert {(r.doc_id, r.n_removed) for r in substring.remove_repeats(docs).collect()} == want
