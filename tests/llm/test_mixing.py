"""Source mixing against a plain reckoning, and how near the words taken come to their targets."""

import hashlib
import math
import re

import pytest

from tallyhouse.llm import mixing, registry

DOCS = "doc_id bigint, text string, source string, size int, target string, copies int"


def shared(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Targets by sharing again what those above their limit leave."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        rest = sum(weight[s] for s in names if s not in full)
        target = {s: most * sizes[s] if s in full else left * weight[s] / rest for s in names}
        above = {s for s in names if s not in full and target[s] >= most * sizes[s]}
        if not above:
            return target
        full |= above


def brute(rows, block_rows=50_000, seed=13):
    h = lambda x: int(hashlib.sha256(f"{seed}:{'null' if x is None else x}".encode()).hexdigest()[:8], 16)
    docs = [(d, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, t, s in rows]
    sizes = {}
    for _, s, n in docs:
        sizes[s] = sizes.get(s, 0) + n
    target, out = shared(sizes), []
    for s in sizes:
        own = [x for x in docs if x[1] == s]
        blocks = math.ceil(len(own) / block_rows)
        own.sort(key=lambda x: (h(x[0]) % blocks, x[2], x[0] is not None, x[0] or 0))
        rate = target[s] / sizes[s] if sizes[s] else 0
        crossed = [math.floor(h(s) / 2**32 + rate * k) for k in range(len(own) + 1)]
        out += [(d, n, sizes[s], round(target[s], 6), n * (crossed[k + 1] - crossed[k])) for k, (d, _, n) in enumerate(own)]
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def made(count=600):
    rows = [(i, "w " * (i * 37 % 50), f"s{'' if i % 3 else '0'}{i % 7 if i % 3 else ''}") for i in range(count)]
    return rows + [(count, None, None), (count + 1, "one two", None), (None, "x y z", "s0"), (3, "again", "s1"), (3, "again", "s1"), (count + 2, "", "empty"), (count + 3, "long " * 100_000, "\U0001f600")]


@pytest.mark.parametrize("block_rows", [7, 50_000])
def test_copies_of_every_row(spark, block_rows):
    rows = made()
    docs = spark.createDataFrame([(d, t, s, 1, "x", 2) for d, t, s in rows], DOCS)
    out = mixing.mix(docs, block_rows=block_rows)
    found = [(r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in out.collect()]
    assert ordered(found) == ordered(brute(rows, block_rows))
    assert all(n is None or t <= 2 * n for _, n, _, _, t in found)
    copies = mixing.emitted(out)
    assert copies.count() == sum(r.copies for r in out.collect()) and copies.where("copy > copies").isEmpty()


def test_targets_share_what_is_left(spark):
    for sizes in ({"a": 100, "b": 1, "c": 50, None: 9}, {"a": 0, "b": 0}, {"a": 10}, {f"s{i:03}": (i * 7919) % 101 for i in range(60)}):
        frame = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
        found = {r.source: r.target for r in mixing.targets(frame).collect()}
        assert found == pytest.approx(shared(sizes)) and sum(found.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_near_the_targets_and_the_same_again(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = mixing.mix(docs).collect()
    assert sorted(out) == sorted(mixing.mix(docs.repartition(13)).collect())
    taken, target, largest = {}, {}, {}
    for r in out:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source], largest[r.source] = r.target, max(largest.get(r.source, 0), r.size)
    for s in target:
        assert abs(taken[s] - target[s]) <= max(largest[s], 0.02 * target[s])


def test_empty_table(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]
    out = registry.op13_source_mixing(spark, sf).collect()
    assert ordered((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in out) == ordered(brute(rows))
