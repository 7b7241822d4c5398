"""SimHash near-duplicate groups through an inverted index over fingerprint byte positions.

Two 64-bit fingerprints with at most two differing bits differ in at most two of their eight bytes, so they share at
least six bytes at equal positions. The index posts every fingerprint under sets of five (position, byte) pairs: eleven
sets are enough for any six positions to hold one of them whole. Single pairs would be lists of a 256th of all
fingerprints each. In a list the shared positional bytes of each candidate pair are tallied, pairs under the guaranteed
six fall away, and the rest are verified by their differing bits, in the first list that both are in only.

Members of a list differ in three bytes, so it has 2**24 members at most, and one fingerprint has at most 300 links in
it. In longer lists a fingerprint's partners are looked up by their differing bits, which gives the same links without
going through pairs: neither lists nor links grow with the square of a group of copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import documents, meet, staged, word_blocks
from tallyhouse.llm.graph import components

@cache
def left_out(max_bits: int) -> list[tuple[int, ...]]:
    """The byte positions that each posting key leaves out, one more than may differ: any max_bits positions are in one of the sets."""
    open_, sets = set(combinations(range(8), max_bits)), list(combinations(range(8), max_bits + 1))
    chosen = []
    while open_:
        best = max(sets, key=lambda x: sum(set(y) <= set(x) for y in open_))
        chosen.append(best)
        open_ = {y for y in open_ if not set(y) <= set(best)}
    return chosen


@cache
def _first(max_bits: int) -> np.ndarray:
    """For each set of differing positions, as bits, the first posting key that leaves all of them out; -1 if none does."""
    holds = lambda x, bits: all(p in x for p in range(8) if bits >> p & 1)
    return np.array([next((k for k, x in enumerate(left_out(max_bits)) if holds(x, bits)), -1) for bits in range(256)])


#: Longer posting lists are searched by flipped bits instead of by neighbours.
SHORT_LIST = 48


def _tally(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = hashes[i : i + (1 << 15)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return counts


def fingerprint(data: bytes, width: int = 3, seed: int = 42) -> int:
    """The SimHash of a text's word shingles, A-Z in lower case. No words: 0; fewer than width: the whole sequence is the shingle."""
    digest = partial(xxhash.xxh64_intdigest, seed=seed)
    counts, total, carry = np.zeros(64, np.int64), 0, []
    for words in word_blocks(data.lower()):
        words = carry + words
        if len(words) >= width:
            shingles = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
            n = len(words) - width + 1
            counts += _tally(np.fromiter(map(digest, shingles), np.uint64, n))
            total += n
        carry = words[-(width - 1) :] if width > 1 else []
    if not total and carry:
        counts, total = _tally(np.array([digest(b" ".join(carry))], np.uint64)), 1
    return sum(1 << i for i in np.flatnonzero(2 * counts > total).tolist())


def _fingerprint_batches(batches: Iterator[pa.RecordBatch], width: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        prints = np.fromiter((fingerprint(t.as_py(), width, seed) for t in texts), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the fingerprint of every row, as a signed 64-bit integer."""
    rows = documents(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(partial(_fingerprint_batches, width=width, seed=seed), f"doc_id {kind}, fp bigint")


def postings(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """(k, key, fp): distinct fingerprints under each set of positional bytes; k tells which are left out."""
    masks = [sum(0xFF << 8 * p for p in range(8) if p not in x) for x in left_out(max_bits)]
    signed = [m - 2**64 if m >= 2**63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(k).cast("tinyint").alias("k"), F.col("fp").bitwiseAND(F.lit(m).cast("bigint")).alias("key")) for k, m in enumerate(signed)])
    return prints.select("fp", F.explode(keys).alias("p")).select("p.k", "p.key", "fp")


def _verified(a: np.ndarray, b: np.ndarray, k: np.ndarray, max_bits: int) -> np.ndarray:
    """Which candidate pairs of a list reach the guaranteed count of shared positional bytes and pass the check of their bits."""
    x = a ^ b
    differing = x.view(np.uint8).reshape(-1, 8) != 0
    reached = np.flatnonzero(8 - differing.sum(axis=1) >= 8 - max_bits)
    ok = np.zeros(len(a), bool)
    ok[reached] = np.bitwise_count(x[reached]) <= max_bits
    return ok & (_first(max_bits)[np.packbits(differing, axis=1, bitorder="little")[:, 0]] == k)


def _flips(k: int, max_bits: int) -> list[int]:
    bits = [8 * p + b for p in left_out(max_bits)[k] for b in range(8)]
    return [sum(1 << b for b in chosen) for n in range(1, max_bits + 1) for chosen in combinations(bits, n)]


def _links(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """Links within posting lists; rows come sorted by list and fingerprint. Holds one batch and one list at a time."""
    rest = [np.empty(0, np.int8), np.empty(0, np.int64), np.empty(0, np.uint64)]

    def found(k: np.ndarray, key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(k):
            return
        starts = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (key[1:] != key[:-1])])
        sizes = np.diff(np.r_[starts, len(k)])
        group = np.repeat(np.arange(len(starts)), sizes)
        short = np.repeat(sizes <= SHORT_LIST, sizes)
        pairs = []
        idx = np.flatnonzero(short & np.repeat(sizes > 1, sizes))
        for s in range(1, SHORT_LIST):
            idx = idx[idx + s < len(k)]
            idx = idx[group[idx + s] == group[idx]]
            if not len(idx):
                break
            ok = _verified(fp[idx], fp[idx + s], k[idx], max_bits)
            pairs.append((fp[idx[ok]], fp[idx[ok] + s]))
        for g in np.flatnonzero(sizes > SHORT_LIST):
            own = fp[starts[g] : starts[g] + sizes[g]]
            for mask in _flips(int(k[starts[g]]), max_bits):
                other = own ^ np.uint64(mask)
                at = np.minimum(np.searchsorted(own, other), len(own) - 1)
                hit = (own[at] == other) & (own < other)
                a, b = own[hit], other[hit]
                ok = _verified(a, b, np.full(len(a), k[starts[g]]), max_bits)
                pairs.append((a[ok], b[ok]))
        a, b = (np.concatenate([x[i] for x in pairs]) if pairs else np.empty(0, np.uint64) for i in (0, 1))
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    for batch in batches:
        new = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)]
        k, key, fp = (np.concatenate(x) for x in zip(rest, new, strict=True))
        if not len(k):
            continue
        cut = int(np.flatnonzero((k != k[-1]) | (key != key[-1]))[-1]) + 1 if (k[0] != k[-1] or key[0] != key[-1]) else 0
        yield from found(k[:cut], key[:cut], fp[:cut])
        rest = [k[cut:], key[cut:], fp[cut:]]
    yield from found(*rest)


def links(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """(a, b): pairs of distinct fingerprints with at most max_bits (up to 3) differing bits, each once."""
    if not 0 < max_bits <= 3:
        raise ValueError("beyond three differing bits the guaranteed bytes are too few for short lists: see similar")
    # fingerprints sort as unsigned numbers in a list: the sign bit is flipped for the sort
    sorted_lists = postings(prints, max_bits).repartition("k", "key").sortWithinPartitions("k", "key", F.col("fp").bitwiseXOR(F.lit(-(2**63))))
    return sorted_lists.mapInArrow(partial(_links, max_bits=max_bits), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_bits: int = 2, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id, first_copy) for every row of docs.

    component_id is the smallest doc_id that links of at most max_bits differing bits reach; first_copy is the smallest
    doc_id with the same fingerprint. Null and empty texts have fingerprint 0 and are linked like others. A null doc_id
    never names a component unless no row of it has an id. Repeated rows each come back. An empty table gives no rows.
    """
    prints = staged(fingerprints(docs, id_col, text_col, width, seed), "simhash")
    distinct = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("first_copy"), F.count("*").alias("copies")), "simhash-distinct")
    roots = components(links(distinct.select("fp"), max_bits), "a", "b")
    member = distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = member.groupBy("root").agg(F.min("first_copy").alias("component_id"))
    named = staged(member.join(smallest, "root").select("fp", "first_copy", "component_id", "copies"), "simhash-groups")
    return meet(prints, named, "fp", "inner").select("doc_id", "fp", "component_id", "first_copy")
