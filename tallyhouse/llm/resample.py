"""Importance resampling of documents towards a target text collection, by hashed word features.

Features are words and runs of consecutive words, counted in buckets of a hash. The corpus's counts come from its lines:
separator newlines cut texts into lines, equal lines are counted, and each distinct line's features are hashed once and
multiplied by how often the line occurs; the runs of words that begin in one line and end in another are added from the
texts. A bucket's gain is the log ratio of its share in the target to its share in the corpus; a document's weight is
the mean gain of its features, and the highest weights plus Gumbel noise are drawn, which is a draw without replacement
in proportion to the exponent of the weights.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.llm.buffers import slabs, view
from tallyhouse.llm.common import documents, staged
from tallyhouse.llm.fim import draws

#: Words of more bytes are hashed one by one.
LONG = 48
#: Bytes of text that are looked at together: a word takes some hundred bytes of arrays.
SLAB = 4 << 20

#: Bytes of words: digits, small letters, and all bytes beyond ASCII; capitals are made small first.
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_BLANK = zlib.crc32(b" ")


@cache
def _shifts() -> np.ndarray:
    """By length and by each byte of a CRC: what that byte turns into behind so many bytes more. CRCs are linear, so the rest is an exclusive or."""
    zeros = [zlib.crc32(bytes(n)) for n in range(LONG + 1)]
    return np.array([[[zlib.crc32(bytes(n), b << 8 * k) ^ zeros[n] for b in range(256)] for k in range(4)] for n in range(LONG + 1)], np.uint32)


@cache
def _steps() -> np.ndarray:
    """The table of one CRC step, from the library's CRC of single bytes."""
    return np.array([zlib.crc32(bytes([x ^ 0xFF])) ^ 0xFF000000 for x in range(256)], np.uint32)


def followed(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs of two texts in a row from the CRC of each and the length of the second, up to LONG."""
    table, out = _shifts(), second.copy()
    for k in range(4):
        out ^= table[length, k, (first >> np.uint32(8 * k)) & np.uint32(255)]
    return out


class Words:
    """The words of texts that lie one after the other in data: where each begins, its length, its text and its CRC-32."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = _SMALL[data]
        inside = _WORD[self.data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True  # a word ends with its text
        before = np.r_[False, inside[:-1]]
        self.begin = np.flatnonzero(inside & (~before | edge[:-1]))
        ends = np.flatnonzero(inside & np.r_[~inside[1:] | edge[1:-1], True][: len(inside)]) + 1
        self.length = ends - self.begin
        self.text = np.searchsorted(offsets, self.begin, "right") - 1
        self.crc = self._crcs()

    def _crcs(self) -> np.ndarray:
        state, table = np.full(len(self.begin), 0xFFFFFFFF, np.uint32), _steps()
        left = np.flatnonzero(self.length <= LONG)
        left = left[np.argsort(self.length[left], kind="stable")]
        at, n = self.begin[left], self.length[left]
        now = state[left]
        for k in range(int(n[-1]) if len(n) else 0):
            some = np.searchsorted(n, k, "right")  # words that have a byte more
            x = now[some:]
            now[some:] = (x >> np.uint32(8)) ^ table[(x ^ self.data[at[some:] + k]) & np.uint32(255)]
        state[left] = now
        out = ~state
        for i in np.flatnonzero(self.length > LONG).tolist():
            out[i] = zlib.crc32(self.data[self.begin[i] : self.begin[i] + self.length[i]])
        return out

    def runs(self, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(first word, last word, CRC) of all runs of 1 to longest consecutive words of one text, by number of words."""
        first = np.arange(len(self.begin))
        last, crc = first, self.crc
        yield first, last, crc
        for _ in range(1, longest):
            stay = last + 1 < len(self.begin)
            first, last, crc = first[stay], last[stay] + 1, crc[stay]
            stay = self.text[first] == self.text[last]
            first, last, crc = first[stay], last[stay], crc[stay]
            spaced = followed(crc, np.full(len(crc), _BLANK, np.uint32), np.ones(len(crc), np.int64))
            length = self.length[last]
            out = followed(spaced, self.crc[last], np.minimum(length, LONG))
            for i in np.flatnonzero(length > LONG).tolist():
                at = self.begin[last[i]]
                out[i] = zlib.crc32(self.data[at : at + length[i]], int(spaced[i]))
            crc = out
            yield first, last, crc


def _counts(total: np.ndarray) -> pa.RecordBatch:
    found = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["bucket", "features"])


def _line_counts(batches: Iterator[pa.RecordBatch], longest: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Bucket counts of distinct lines, each times its occurrences."""
    total = np.zeros(buckets, np.int64)
    for slab in slabs(batches, 0, SLAB):
        times = slab.column(1).to_numpy(zero_copy_only=False)
        words = Words(*view(slab.column(0)))
        for first, _, crc in words.runs(longest):
            np.add.at(total, (crc % np.uint32(buckets)).astype(np.int64), times[words.text[first]])
    yield _counts(total)


def _crossing_counts(batches: Iterator[pa.RecordBatch], longest: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Bucket counts of the runs of words that do not lie in one line of their text."""
    total = np.zeros(buckets, np.int64)
    for slab in slabs(batches, 0, SLAB):
        data, offsets = view(slab.column(0))
        words = Words(data, offsets)
        line = np.searchsorted(np.flatnonzero(data == 10), words.begin)
        for first, last, crc in words.runs(longest):
            across = line[first] != line[last]
            total += np.bincount((crc[across] % np.uint32(buckets)).astype(np.int64), minlength=buckets)
    yield _counts(total)


def feature_counts(docs: DataFrame, longest: int = 2, buckets: int = 10_000, text_col: str = "text") -> DataFrame:
    """(bucket, features): how many features of all texts fall into each bucket that has any. Null texts have none."""
    texts = docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    lines = texts.select(F.explode(F.split("text", "\n")).alias("line")).where("line <> ''").groupBy("line").agg(F.count("*").alias("times"))
    kind = "bucket bigint, features bigint"
    within = lines.mapInArrow(partial(_line_counts, longest=longest, buckets=buckets), kind)
    if longest > 1:
        within = within.unionByName(texts.mapInArrow(partial(_crossing_counts, longest=longest, buckets=buckets), kind))
    return within.groupBy("bucket").agg(F.sum("features").alias("features"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """The gain of each bucket in thousandths, rounded down, from feature_counts() of both; buckets is a parameter, so this is no more than that many numbers."""
    known = [dict(x.collect()) for x in (corpus, target)]
    all_ = [sum(x.values()) + buckets for x in known]
    share = lambda i, b: known[i].get(b, 0) + 1
    return np.array([math.floor(1000 * math.log(share(1, b) * all_[0] / (share(0, b) * all_[1]))) for b in range(buckets)], np.int64)


def _weights(batches: Iterator[pa.RecordBatch], gain: np.ndarray, longest: int) -> Iterator[pa.RecordBatch]:
    for slab in slabs(batches, 1, SLAB):
        words = Words(*view(slab.column(1)))
        count, total = np.zeros((2, len(slab)), np.int64)
        for first, _, crc in words.runs(longest):
            text = words.text[first]
            count += np.bincount(text, minlength=len(slab))
            # text by text, in order, so that sums of whole numbers stay whole
            edges = np.searchsorted(text, np.arange(len(slab) + 1))
            sums = np.r_[0, np.cumsum(gain[(crc % np.uint32(len(gain))).astype(np.int64)])]
            total += sums[edges[1:]] - sums[edges[:-1]]
        n_words = np.bincount(words.text, minlength=len(slab))
        yield pa.RecordBatch.from_arrays([slab.column(0), *(pa.array(x) for x in (n_words, count, total // np.maximum(count, 1)))], names=["doc_id", "n_words", "n_features", "weight"])


def weights(docs: DataFrame, gain: np.ndarray, longest: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row: the mean gain of its features, rounded down; 0 without any."""
    rows = documents(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(partial(_weights, gain=gain, longest=longest), f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")


def noise(seed: int, id_col: Column) -> Column:
    """Gumbel noise in thousandths, rounded down, from seed and id alone."""
    u = (draws(seed, id_col, 1)[0] + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u))).cast("bigint")


def drawn(scored: DataFrame, percent: int = 25, least_words: int = 20) -> DataFrame:
    """scored (doc_id, n_words, score, ...) with rank: 1, 2, 3... by falling score and rising doc_id for percent of the rows with least_words words, rounded down; null for the others.

    Rows are counted by score, a whole number in a narrow range, so the counts are a small table; places within a score
    are found apart from each other. Null ids come before others.
    """
    fit = F.col("n_words") >= least_words
    # scores lie within some 100,000 thousandths, so this window is over that many rows at most, whatever the input
    down = Window.partitionBy(F.lit(1)).orderBy(F.desc("score"))
    levels = scored.where(fit).groupBy("score").agg(F.count("*").alias("here"))
    levels = levels.select("score", (F.sum("here").over(down) - F.col("here")).alias("above"), F.floor(F.sum("here").over(Window.partitionBy(F.lit(1))) * percent / 100).alias("wanted"))
    open_ = scored.where(fit).join(F.broadcast(levels.where("above < wanted")), "score")
    ranked = open_.withColumn("rank", F.col("above") + F.row_number().over(Window.partitionBy("score").orderBy("doc_id")))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= F.col("wanted"), F.col("rank"))).drop("above", "wanted")
    rest = scored.where(~fit).unionByName(scored.where(fit).join(F.broadcast(levels.where("above >= wanted").select("score")), "score", "left_semi"))
    return ranked.unionByName(rest.withColumn("rank", F.lit(None).cast("bigint")))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, longest: int = 2, buckets: int = 10_000, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of docs, drawn towards the texts of target.

    Null texts are empty: no features, weight 0. Repeated rows each come back, and may each be drawn. An empty target or
    an empty docs gives every bucket a gain from its smoothed share alone; empty docs give no rows.
    """
    counted = [feature_counts(x, longest, buckets, text_col) for x in (docs, target)]
    gain = gains(*counted, buckets)
    scored = weights(docs, gain, longest, id_col, text_col)
    scored = staged(scored.withColumn("score", F.col("weight") + noise(seed, F.col("doc_id"))), "scored")
    return drawn(scored, percent, least_words).select("doc_id", "n_words", "n_features", "weight", "score", "rank")
