"""Repeated word passages through difference-cover anchors.

With a set D of residues modulo P in which every difference occurs, any two equal windows of W words have, within their
first P words, positions at the same offset that both fall on D. So it is enough to hash runs of W - P + 1 words at the
cover positions: windows that are equal share one of these anchors at the same offset. Documents with a shared anchor
then extend it to the windows around it, and a window is repeated if its own hash (96 bits, over exactly W words,
from two independent hashes of each word) occurs twice. Hashes are counted inside each task before they are shuffled, so a passage that a third of all documents
hold sends a few rows per task, not one per occurrence. Anchors go by 64 bits of a row's id and text, since a
place too many only means windows that are counted in vain; windows go by 80. Rows repeated in full share a name and
their places, each place once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.llm.common import documents, row_key, staged, word_blocks

#: Hashes that a task holds before it counts and passes them on.
SLAB = 1 << 20
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


@cache
def difference_cover(width: int) -> tuple[int, tuple[int, ...]]:
    """The period and cover for windows of width words: a period q*q + q + 1 has a cover of q + 1 residues for these q."""
    period = max((p for p in (1, 3, 7, 13, 21) if width - p + 1 >= max(1, width // 3)), default=1)
    size = next(n for n in range(1, period + 1) if n * (n - 1) + 1 >= period)
    for rest in combinations(range(1, period), size - 1):
        cover = (0, *rest)
        if len({(a - b) % period for a in cover for b in cover}) == period:
            return period, cover
    raise ValueError(f"no cover of {size} residues modulo {period}")


def word_hashes(data: bytes) -> np.ndarray:
    parts = [np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) for words in word_blocks(data)]
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def double_hashes(data: bytes) -> list[np.ndarray]:
    """Two independent hashes of each word."""
    both = np.frombuffer(b"".join(b"".join(map(xxhash.xxh3_128_digest, words)) for words in word_blocks(data)), np.uint64).reshape(-1, 2)
    return [np.ascontiguousarray(both[:, i]) for i in (0, 1)]


class _Powers:
    """Powers of an odd multiplier and of its inverse modulo 2**64."""

    def __init__(self, base: int):
        self.base, self.inverse, self.up, self.down = base, pow(base, -1, 2**64), np.ones(1, np.uint64), np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 14)
            self.up = np.r_[np.uint64(1), np.cumprod(np.full(n, self.base, np.uint64))]
            self.down = np.r_[np.uint64(1), np.cumprod(np.full(n, self.inverse, np.uint64))]
        return self.up, self.down


def window_hashes(words: np.ndarray, starts: np.ndarray, width: int, powers: _Powers) -> np.ndarray:
    """Hashes of the runs of width words at starts: a polynomial over the words' hashes, from prefix sums."""
    up, down = powers.to(len(words) + 1)
    sums = np.r_[np.uint64(0), np.cumsum(words * up[: len(words)])]
    x = (sums[starts + width] - sums[starts]) * down[starts]
    x ^= x >> np.uint64(32)
    return x * np.uint64(0xD6E8FEB86659FD93)


def _counted(hashes: list[np.ndarray], keys: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    """Rows (hashes, key, at, n) of a slab; at is the place with more bits of the row's name above it. A hash that occurs once goes on as it is. Of one that occurs more often,
    every place is settled here: it goes on with n = 2 under a hash of its own, and one row without a key tells others."""
    order = np.lexsort(hashes[::-1])
    new = np.r_[True, np.any([h[order][1:] != h[order][:-1] for h in hashes], axis=0)] if len(order) else np.empty(0, bool)
    first = np.flatnonzero(new)
    sizes = np.diff(np.r_[first, len(order)])
    many = np.repeat(sizes > 1, sizes)
    told = order[first[sizes > 1]]
    once, settled = order[~many], order[many]
    columns = []
    for i, h in enumerate(hashes):
        spread = keys[settled].view(np.uint64) * np.uint64(MULTIPLIERS[i]) + places[settled].astype(np.uint64) * np.uint64(MULTIPLIERS[1 - i])
        mixed = np.r_[h[once], spread ^ (spread >> np.uint64(29)), h[told]]
        columns.append(pa.array((mixed >> np.uint64(32)).astype(np.uint32).view(np.int32) if i else mixed.view(np.int64)))
    n = np.r_[np.ones(len(once), np.int8), np.full(len(settled), 2, np.int8), np.ones(len(told), np.int8)]
    gone = np.r_[np.zeros(len(once) + len(settled), bool), np.ones(len(told), bool)]
    key = pa.array(np.r_[keys[once], keys[settled], np.zeros(len(told), np.int64)], mask=gone)
    at = pa.array(np.r_[places[once], places[settled], np.zeros(len(told), np.int64)])
    return pa.RecordBatch.from_arrays([*columns, key, at, pa.array(n)], names=[*(f"h{i}" for i in range(len(hashes))), "key", "at", "n"])


def _slabs(found: Iterator[tuple[int, list[np.ndarray], np.ndarray]]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def out() -> pa.RecordBatch:
        hashes = [np.concatenate([x[1][i] for x in held]) for i in range(len(held[0][1]))]
        keys = np.repeat(np.array([x[0] for x in held], np.int64), [len(x[2]) for x in held])
        return _counted(hashes, keys, np.concatenate([x[2] for x in held]))

    for x in found:
        held.append(x)
        size += len(x[2])
        if size >= SLAB:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def _anchors(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    period, cover = difference_cover(width)
    run, powers = width - period + 1, _Powers(MULTIPLIERS[0])

    def found():
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                words = word_hashes(text.as_py())
                if len(words) >= width:
                    starts = (np.arange(0, len(words) - run + 1, period)[:, None] + np.array(cover)).ravel()
                    starts = starts[starts <= len(words) - run]
                    yield key, [window_hashes(words, starts, run, powers)], starts

    yield from _slabs(found())


def _windows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The windows that extend shared anchors, as far as a window around an anchor reaches."""
    period, _ = difference_cover(width)
    powers = [_Powers(m) for m in MULTIPLIERS]

    def found():
        for batch in batches:
            for key, more, text, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), batch.column(3), strict=True):
                both = double_hashes(text.as_py())
                words = both[0]
                anchors = places.values.to_numpy()
                anchors = anchors[anchors < len(words)]
                edge = np.zeros(len(words) + 2, np.int32)
                np.add.at(edge, np.maximum(anchors - (period - 1), 0), 1)
                np.add.at(edge, anchors + 1, -1)
                starts = np.flatnonzero(np.cumsum(edge)[: max(0, len(words) - width + 1)] > 0)
                yield key, [window_hashes(x, starts, width, p) for x, p in zip(both, powers, strict=True)], (more << 32) + starts

    yield from _slabs(found())


def _repeated(rows: DataFrame, hashes: list[str]) -> DataFrame:
    """(key, more, places), more being the upper half of at, of the rows whose hashes occur twice or more; each place once, however often the row is repeated."""
    total = F.sum("n").over(Window.partitionBy(*hashes))
    found = rows.withColumn("total", total).where("total > 1 and key is not null")
    place = F.col("at").bitwiseAND(F.lit(2**32 - 1)).cast("int")
    return found.groupBy("key", F.shiftright("at", 32).cast("int").alias("more")).agg(F.collect_set(place).alias("places"))


def _cut(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            total, removed, kept = [], [], []
            for text, places in zip(part.column(2).cast(pa.binary()), part.column(3), strict=True):
                data = text.as_py()
                if not places.is_valid:
                    total.append(sum(map(len, word_blocks(data))))
                    removed.append(0)
                    kept.append(data)
                    continue
                raw = np.frombuffer(data, np.uint8)
                space = (raw == 32) | ((raw >= 9) & (raw <= 13))
                begins = np.flatnonzero(~space & np.r_[True, space[:-1]])
                edge = np.zeros(len(begins) + 1, np.int32)
                starts = places.values.to_numpy()
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + width, -1)
                gone = np.cumsum(edge)[:-1] > 0
                total.append(len(begins))
                removed.append(int(gone.sum()))
                # from a removed word to the next word, white space included; what stands before the first word stays
                bounds = np.r_[begins, len(raw)]
                kept.append(raw[np.repeat(np.r_[False, gone], np.diff(np.r_[0, bounds])) == 0].tobytes())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["doc_id", "key", "n_words", "n_removed", "kept_text"],
            )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 35) -> DataFrame:
    """(doc_id, key, n_words, n_removed, kept_text) for every row of docs, without the words of repeated windows.

    Every word that a repeated window of width words covers is removed, with the white space up to the next word, at
    every place, in one document or several. Texts of fewer than width words stay as they are; null text is empty. Rows
    repeated in full repeat each other's windows. key is a hash of id and text. An empty table gives no rows. Texts have
    less than 2**31 words.
    """
    rows = documents(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.select("doc_id", row_key("doc_id", "text").alias("key"), F.hash("text", "doc_id").bitwiseAND(0xFFFF).alias("more"), "text")
    anchors = rows.select("key", "text").mapInArrow(partial(_anchors, width=width), "h0 bigint, key bigint, at bigint, n tinyint")
    # each step is written before the next: the disk holds the shuffle files of one step at a time
    shared = staged(_repeated(anchors, ["h0"]), "anchors")
    around = rows.join(shared.drop("more"), "key").select("key", "more", "text", "places")
    windows = around.mapInArrow(partial(_windows, width=width), "h0 bigint, h1 int, key bigint, at bigint, n tinyint")
    repeated = staged(_repeated(windows, ["h0", "h1"]), "windows")
    return rows.join(repeated, ["key", "more"], "left").select("doc_id", "key", "text", "places").mapInArrow(
        partial(_cut, width=width), f"doc_id {kind}, key bigint, n_words bigint, n_removed bigint, kept_text string"
    )
