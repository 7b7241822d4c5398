"""SimHash near-duplicates by similarity: texts whose sets of word shingles have a Jaccard similarity of at least a threshold.

A radius of two bits of 64 holds few pairs of similarity 0.8, so fingerprints are wide here: 1536 bits, or 192 positional
bytes, over the distinct shingles of a text. Two sets of similarity s agree in a bit with probability
1 - acos(2s / (1 + s)) / pi or more, which is 0.85 at 0.8; they share 52 of the 192 positional bytes on average.

The inverted index posts a fingerprint under pairs of neighbouring byte positions (more bits where the table is large,
so that lists of unlike texts stay short). In a list the shared positional bytes of each pair are tallied; a pair goes on
if it reaches the count, and the differing bits, that a pair at the threshold keeps to but for one in a thousand,
and only from the first list that both are in. What goes on is verified by the Jaccard similarity of the sets themselves.

Large groups of copies cost no square of pairs: a first round links the members of each long list to its middle one; the
rounds that follow compare only what the verified links have not joined yet. Lists are worked off in rounds, so that the
disk holds the postings of one round at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import documents, meet, settled, staged, word_blocks
from tallyhouse.llm.graph import components

#: Positional bytes of a fingerprint.
BYTES = 192
#: A fingerprint with the size of its set, as it travels.
SKETCH = BYTES + 4
#: Lists of unlike texts have about this many members on average, at most.
LIST_MEAN = 64
#: Shorter lists are compared whole; in longer ones a first round goes from the middle member.
SHORT_LIST = 64
#: Rounds in which the lists are worked off.
ROUNDS = 6
#: Chance that a pair at the threshold shares no list, and standard deviations that its counts may lie off their means.
MISS, SLACK = 0.0005, 3.0
#: Pairs that are compared at a time.
BLOCK = 1 << 15
#: A posting key has the number of its list above this many bits.
KEY_BITS = 48
#: Sets of fewer shingles have ties among their bits, so that pairs of them may differ in more bits.
FEW = 16

_random = np.random.default_rng(20)
_TIMES = _random.integers(0, 2**64, BYTES // 8, np.uint64) | np.uint64(1)
_AGAIN = _random.integers(0, 2**64, BYTES // 8, np.uint64) | np.uint64(1)
_PLACES = (256 * np.arange(BYTES))[None]
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float32)


def shingles(data: bytes, width: int = 5) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles, A-Z in lower case. Fewer words than width: the whole sequence is the shingle."""
    parts, carry = [], []
    for words in word_blocks(data.lower()):
        words = carry + words
        if len(words) >= width:
            joined = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
            parts.append(np.unique(np.fromiter(map(xxhash.xxh64_intdigest, joined), np.uint64, len(words) - width + 1)))
        carry = words[-(width - 1) :] if width > 1 else []
    if not parts:
        return np.array([xxhash.xxh64_intdigest(b" ".join(carry))] if carry else [], np.uint64)
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


def wide_fingerprint(found: np.ndarray) -> np.ndarray:
    """The positional bytes of a set of hashes: a bit is 1 if it is set in over half of the 1536 bits that each hash gives."""
    counts = np.zeros((BYTES, 8), np.float32)
    for i in range(0, len(found), 4096):
        part = found[i : i + 4096, None] * _TIMES
        part ^= part >> np.uint64(32)
        part *= _AGAIN
        part ^= part >> np.uint64(29)
        own = part.view(np.uint8).reshape(len(part), BYTES)
        if len(own) < 128:
            counts += np.unpackbits(own, axis=1, bitorder="little").sum(axis=0, dtype=np.int32).reshape(BYTES, 8)
        else:
            counts += np.bincount((own + _PLACES).ravel(), minlength=256 * BYTES).reshape(BYTES, 256).astype(np.float32) @ _BITS
    return np.packbits(2 * counts > len(found), axis=1, bitorder="little").ravel()


def agreement(threshold: float) -> float:
    """The chance that two sets at the threshold agree in a bit."""
    return 1 - math.acos(2 * threshold / (1 + threshold)) / math.pi


def bounds(threshold: float) -> tuple[int, int, int]:
    """(fewest shared bytes, most differing bits, most of small sets) of pairs at the threshold."""
    p, n = agreement(threshold), 8 * BYTES
    byte = p**8
    few = 0.1875 * (1 - threshold) / 0.2  # sets of 4 and 5 shingles that differ in one: half of the even set's ties
    most = lambda q: int(n * q + SLACK * math.sqrt(n * q * (1 - q)))
    return max(3, int(BYTES * byte - (SLACK + 1) * math.sqrt(BYTES * byte * (1 - byte)))), most(1 - p), most(max(few, 1 - p))


def plan(rows: int, threshold: float) -> tuple[int, int]:
    """(bits of a posting key, number of lists) for a table of so many distinct sets."""
    bits = max(16, math.ceil(math.log2(max(rows, 1) / LIST_MEAN)))
    return bits, math.ceil(math.log(1 / MISS) / agreement(threshold) ** bits) + 1


def list_keys(sketches: np.ndarray, lists: range, bits: int) -> np.ndarray:
    """The posting keys (rows x lists) under the first bits of neighbouring positions; later rounds of the circle take wider steps."""
    n = -(-bits // 8)
    out = np.zeros((len(sketches), len(lists)), np.uint64)
    for at, x in enumerate(lists):
        step = 1 + x // BYTES
        for j in range(n):
            out[:, at] = (out[:, at] << np.uint64(8)) | sketches[:, (x + j * step) % BYTES]
        out[:, at] >>= np.uint64(8 * n - bits)
    return out


def _sketch_batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, sketches = [], []
        for t in batch.column(2).cast(pa.binary()):
            found = shingles(t.as_py(), width)
            names.append(xxhash.xxh3_128_digest(found.tobytes()))
            sketches.append(wide_fingerprint(found).tobytes() + len(found).to_bytes(4, "little"))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.binary()) for x in (names, sketches))], names=["doc_id", "content", "set", "sketch"])


def _posted(batches: Iterator[pa.RecordBatch], lists: range, bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 512):
            part = batch.slice(at, 512)
            sketch = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(-1, SKETCH)
            keys = list_keys(sketch[:, :BYTES], lists, bits)
            rows = pa.array(np.repeat(np.arange(len(part)), len(lists)))
            keys |= np.arange(lists.start, lists.stop, dtype=np.uint64) << np.uint64(KEY_BITS)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), *(c.take(rows) for c in part.columns)], names=["key", "node", "sketch", "root"])


class _Lists:
    """Pairs within posting lists."""

    def __init__(self, threshold: float, bits: int, star: bool):
        self.threshold, self.bits, self.star = threshold, bits, star
        self.least, self.most, self.most_of_few = bounds(threshold)

    def passing(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of sketches may be at the threshold: sizes, shared positional bytes, differing bits."""
        sizes = [np.ascontiguousarray(x[:, BYTES:]).view(np.uint32).ravel().astype(np.int64) for x in (a, b)]
        small, large = np.minimum(*sizes), np.maximum(*sizes)
        ok = np.flatnonzero(small >= self.threshold * large)
        a, b = np.ascontiguousarray(a[ok, :BYTES]), np.ascontiguousarray(b[ok, :BYTES])
        tally = np.count_nonzero(a == b, axis=1)
        few = large[ok] < FEW
        enough = np.flatnonzero((tally >= self.least) | few)
        differing = np.bitwise_count(a[enough].view(np.uint64) ^ b[enough].view(np.uint64)).sum(axis=1, dtype=np.int64)
        return ok[enough[differing <= np.where(few[enough], self.most_of_few, self.most)]]

    def first_here(self, a: np.ndarray, b: np.ndarray, band: int) -> np.ndarray:
        """Which pairs share no list before band."""
        if not band or not len(a):
            return np.ones(len(a), bool)
        x = np.arange(band)[:, None]
        n = -(-self.bits // 8)
        mask = np.full(n, 255, np.uint8)
        mask[-1] = 256 - (1 << 8 * n - self.bits)
        differing = (a[:, :BYTES] ^ b[:, :BYTES])[:, (x + np.arange(n) * (1 + x // BYTES)) % BYTES] & mask
        return differing.any(axis=2).all(axis=1)

    def pairs(self, key: np.ndarray, node: np.ndarray, sketch: np.ndarray, root: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        band = key >> KEY_BITS
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        for s, n in zip(starts[sizes > SHORT_LIST], sizes[sizes > SHORT_LIST], strict=True):
            own = slice(s, s + n)
            if self.star:
                yield from self.from_middle(node[own], sketch[own])
            else:
                yield from self.apart(band[s], node[own], sketch[own], root[own])
        if self.star:
            return
        group = np.repeat(np.arange(len(starts)), sizes)
        at = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= SHORT_LIST), sizes))
        for step in range(1, SHORT_LIST):
            at = at[at + step < len(band)]
            at = at[group[at + step] == group[at]]
            if not len(at):
                break
            for some in np.array_split(at, -(-len(at) // BLOCK)):
                some = some[root[some] != root[some + step]]
                some = some[self.passing(sketch[some], sketch[some + step])]
                for x in np.unique(band[some]):
                    own = some[band[some] == x]
                    own = own[self.first_here(sketch[own], sketch[own + step], int(x))]
                    yield node[own], node[own + step]

    def from_middle(self, node: np.ndarray, sketch: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        at = sketch[:, :BYTES] + _PLACES
        middle = int(np.bincount(at.ravel(), minlength=256 * BYTES)[at].sum(axis=1).argmax())
        for begin in range(0, len(node), BLOCK):
            part = slice(begin, begin + BLOCK)
            ok = begin + self.passing(np.broadcast_to(sketch[middle], sketch[part].shape), sketch[part])
            ok = ok[ok != middle]
            yield np.full(len(ok), node[middle]), node[ok]

    def apart(self, band: int, node: np.ndarray, sketch: np.ndarray, root: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of different roots; members of the largest one are not gone through."""
        names, inverse, counts = np.unique(root, return_inverse=True, return_counts=True)
        if len(names) == 1:
            return
        outside = inverse != counts.argmax()
        order = np.argsort(outside, kind="stable")  # the largest root first: a pair is met from its later member
        node, sketch, root = node[order], sketch[order], root[order]
        held, count = [], 0

        def block() -> tuple[np.ndarray, np.ndarray]:
            i, j = (np.concatenate(x) for x in zip(*held, strict=True))
            ok = self.passing(sketch[i], sketch[j])
            ok = ok[self.first_here(sketch[i[ok]], sketch[j[ok]], int(band))]
            return node[i[ok]], node[j[ok]]

        for i in range(int((~outside).sum()), len(node)):
            for begin in range(0, i, BLOCK):
                other = begin + np.flatnonzero(root[begin : min(i, begin + BLOCK)] != root[i])
                held.append((np.full(len(other), i), other))
                count += len(other)
                if count >= BLOCK:
                    yield block()
                    held, count = [], 0
        if count:
            yield block()


def _candidates(batches: Iterator[pa.RecordBatch], threshold: float, bits: int, star: bool) -> Iterator[pa.RecordBatch]:
    """Pairs within lists; rows come sorted by list. Holds one batch and one list at a time."""
    lists, rest = _Lists(threshold, bits, star), None

    def found(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for pair in lists.pairs(*rows):
            held.append(pair)
            count += len(pair[0])
            if count > 1 << 16:
                yield batch_of(held)
                held, count = [], 0
        if count:
            yield batch_of(held)

    def batch_of(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        a, b = (np.concatenate([x[i] for x in held]) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    for batch in batches:
        if not len(batch):
            continue
        sketch = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, SKETCH)
        new = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), sketch, batch.column(3).to_numpy()]
        rows = new if rest is None else [np.concatenate(x) for x in zip(rest, new, strict=True)]
        changes = np.flatnonzero(rows[0] != rows[0][-1])
        cut = int(changes[-1]) + 1 if len(changes) else 0
        if cut:
            yield from found([x[:cut] for x in rows])
        rest = [x[cut:] for x in rows]
    if rest is not None:
        yield from found(rest)


def candidates(nodes: DataFrame, lists: range, bits: int, threshold: float, star: bool) -> DataFrame:
    """(a, b), a < b: pairs of nodes (node, sketch, root) of these lists that may be at the threshold."""
    posted = nodes.select("node", "sketch", "root").mapInArrow(partial(_posted, lists=lists, bits=bits), "key bigint, node bigint, sketch binary, root bigint")
    ordered = posted.repartition("key").sortWithinPartitions("key")
    return ordered.mapInArrow(partial(_candidates, threshold=threshold, bits=bits, star=star), "a bigint, b bigint")


def _verified(batches: Iterator[pa.RecordBatch], width: int, threshold: float) -> Iterator[pa.RecordBatch]:
    known: dict[int, np.ndarray] = {}

    def of(node: int, text: pa.Scalar) -> np.ndarray:
        if node not in known:
            if len(known) >= 64:
                known.clear()
            known[node] = shingles(text.cast(pa.binary()).as_py(), width)
        return known[node]

    for batch in batches:
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        ok = []
        for i in range(len(a)):
            x, y = of(a[i], batch.column(2)[i]), of(b[i], batch.column(3)[i])
            both = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(both >= threshold * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def verified(pairs: DataFrame, texts: DataFrame, width: int, threshold: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets reach the threshold; texts has one (node, text) of each node."""
    one = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    two = one.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return two.select("a", "b", "text_a", "text_b").mapInArrow(partial(_verified, width=width, threshold=threshold), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, node, component_id) for every row of docs.

    component_id is the smallest doc_id that links of similarity threshold or more reach; node stands for the text's
    shingle set, which is named by 128 bits. A pair at exactly the threshold is missed about once in 400 by the chances
    of its bits, more alike ones hardly ever. Null and empty texts have the empty set, which is alike only to itself.
    Repeated rows each come back. An empty table gives no rows.
    """
    return settled(docs.sparkSession, "near", lambda: _near_duplicates(documents(docs, id_col, text_col), width, threshold))


def _near_duplicates(rows: DataFrame, width: int, threshold: float) -> DataFrame:
    kind = rows.schema["doc_id"].dataType.simpleString()
    content = F.unhex(F.md5("text"))
    prints = staged(rows.select("doc_id", content.alias("content"), "text").mapInArrow(partial(_sketch_batches, width=width), f"doc_id {kind}, content binary, set binary, sketch binary"), "similar")
    # a set's number is given once, as the table is written, so no two sets share one
    sets = prints.groupBy("set").agg(F.min("doc_id").alias("first_id"), F.any_value("sketch").alias("sketch"), F.min("content").alias("content"), F.count("*").alias("copies"))
    distinct = staged(sets.withColumn("node", F.monotonically_increasing_id()), "similar-sets")
    bits, lists = plan(distinct.count(), threshold)
    turns = [range(lists * i // ROUNDS, lists * (i + 1) // ROUNDS) for i in range(ROUNDS)]

    def links(pairs: DataFrame) -> DataFrame:
        both = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        wanted = staged(both.join(distinct.select("node", "content", "copies"), "node"), "similar-wanted")
        # a content that many rows have stays where its rows are, and one of them is taken
        texts = meet(rows.select(content.alias("content"), "text"), wanted, "content", "inner").select("node", "text").dropDuplicates(["node"])
        return staged(verified(pairs, staged(texts, "similar-texts"), width, threshold), "similar-links")

    def named(roots: DataFrame, *columns: str) -> DataFrame:
        return distinct.select("node", *columns).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    first = links(staged(candidates(distinct.withColumn("root", F.col("node")), turns[0], bits, threshold, True).distinct(), "similar-pairs"))
    rooted = staged(named(components(first, "a", "b"), "sketch"), "similar-roots")
    found = [staged(candidates(rooted, turn, bits, threshold, False), "similar-pairs") for turn in turns]
    for more in found[1:]:
        found[0] = found[0].unionByName(more)
    member = named(components(first.unionByName(links(found[0])), "a", "b"), "first_id", "set", "copies")
    smallest = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    groups = staged(member.join(smallest, "root").select("set", "node", "component_id", "copies"), "similar-groups")
    return meet(prints.select("doc_id", "set"), groups, "set", "inner").select("doc_id", "node", "component_id")
