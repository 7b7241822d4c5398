"""Nearest neighbours by largest inner product through a forest of hash-prefix trees.

Vectors are extended by one component so that inner products order like cosines. A tree gives each vector a long string
of hyperplane signs and keeps the strings sorted; a prefix is then a range of the array. A query descends in every tree
to its longest matching prefix, and all trees ascend together, one sign at a time, until the ranges at the common
prefix length hold enough candidates. Candidates are scored exactly on the original vectors, in double precision.

Vectors of one length are dealt to shards of bounded size by a hash. A task builds the forest of a shard once, from rows
that come before the queries in its stream, and answers the queries as they pass; the best of all shards are merged. So
vectors move once, and queries once to each shard; shards grow with the root of the table, up to the memory of a worker.
The share of a shard that is scored decides recall: uniformly random vectors in 64 dimensions, the hardest case, need
well over half of the rows, clustered ones few.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.llm.common import staged


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the rows that take part: vectors that are not null or zero and hold finite components only."""
    v = F.col("v")
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & fine & F.exists(v, lambda x: x != 0))


def planes(trees: int, bits: int, dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((trees, bits, dim + 1))


def hash_strings(x: np.ndarray, extra: np.ndarray, hyperplanes: np.ndarray) -> np.ndarray:
    """The sign strings of each vector in each tree (trees x rows), the first sign in the highest bit."""
    bits = hyperplanes.shape[1]
    weights = np.uint64(1) << np.arange(bits - 1, -1, -1, dtype=np.uint64)
    whole = np.concatenate([x, extra[:, None]], axis=1)
    return np.stack([((whole @ h.T > 0) * weights).sum(axis=1, dtype=np.uint64) for h in hyperplanes])


class Forest:
    """Sorted arrays of hash strings over the rows of one shard."""

    def __init__(self, x: np.ndarray, norm: float, trees: int, bits: int, seed: int):
        self.x, self.bits, self.norm = x, bits, norm
        self.planes = planes(trees, bits, x.shape[1], seed)
        keys = hash_strings(x, np.sqrt(np.maximum(norm**2 - (x**2).sum(axis=1), 0)), self.planes)
        self.order = np.argsort(keys, axis=1, kind="stable")
        self.keys = np.take_along_axis(keys, self.order, axis=1)

    def ranges(self, queries: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        """For each tree and query, the range of rows under the longest common prefix length that gives wanted rows over all trees."""
        keys = hash_strings(queries, np.zeros(len(queries)), self.planes)
        low, high = np.zeros(keys.shape, np.int64), np.full(keys.shape, len(self.x), np.int64)
        open_ = np.arange(len(queries))
        for level in range(self.bits, 0, -1):
            shift = np.uint64(self.bits - level)
            own = (keys[:, open_] >> shift) << shift
            a = np.stack([np.searchsorted(s, k) for s, k in zip(self.keys, own, strict=True)])
            b = np.stack([np.searchsorted(s, k) for s, k in zip(self.keys, own + (np.uint64(1) << shift), strict=True)])
            enough = (b - a).sum(axis=0) >= wanted
            low[:, open_[enough]], high[:, open_[enough]] = a[:, enough], b[:, enough]
            open_ = open_[~enough]
            if not len(open_):
                break
        return low, high

    def search(self, queries: np.ndarray, names: np.ndarray, k: int, wanted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) of the k best candidates of each query; ties to the smaller name."""
        out = []
        for begin in range(0, len(queries), 256):
            block = queries[begin : begin + 256]
            low, high = self.ranges(block, wanted)
            for q in range(len(block)):
                mask = np.zeros(len(self.x), bool)
                for order, a, b in zip(self.order, low[:, q], high[:, q], strict=True):
                    mask[order[a:b]] = True
                rows = np.flatnonzero(mask)
                scores = self.x[rows] @ block[q]
                if len(rows) > k:
                    edge = np.partition(scores, len(rows) - k)[len(rows) - k]
                    rows, scores = rows[scores >= edge], scores[scores >= edge]
                best = np.lexsort((names[rows], -scores))[:k]
                out.append((np.full(len(best), begin + q), rows[best], scores[best]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 2 + (np.empty(0),)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _answers(batches: Iterator[pa.RecordBatch], k: int, trees: int, bits: int, share: float, least: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Rows (dim, shard, asks, id, square, v) come sorted: the vectors of a shard, then the queries to it."""
    place, held, forest, names = None, [], None, np.empty(0, np.int64)
    for batch in batches:
        table = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        starts = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in table[:3]], axis=0)]) if len(batch) else []
        for s, e in zip(starts, [*starts[1:], len(batch)], strict=True):
            if (table[0][s], table[1][s]) != place:
                place, held, forest = (table[0][s], table[1][s]), [], None
            part = batch.slice(s, e - s)
            if not table[2][s]:
                held.append((table[3][s:e], _matrix(part.column(5))))
                continue
            if forest is None and held:
                names = np.concatenate([x for x, _ in held])
                forest = Forest(np.concatenate([x for _, x in held]), float(table[4][s]) ** 0.5, trees, bits, seed)
                held = []
            if forest is not None:
                q, r, scores = forest.search(_matrix(part.column(5)), names, k, max(least, int(share * len(names))))
                yield pa.RecordBatch.from_arrays([pa.array(table[3][s:e][q]), pa.array(names[r]), pa.array(scores)], names=["first", "name", "score"])


def rows_of_shard(rows: Column) -> Column:
    """Up to 8,192 rows are one shard; a billion are shards of 262,144, whose forest takes about 0.4 GB."""
    return F.least(F.lit(262_144), F.greatest(F.lit(8192), (32 * F.sqrt(rows)).cast("int")))


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
    trees: int = 32, bits: int = 24, share: float = 1.0, least: int = 1000, shard_rows: int | None = None, seed: int = 7,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each row of queries, by inner product, nearest first.

    Every usable row of vectors is indexed, and is a candidate for every query of its length but the one with its own id.
    Trees ascend until share of a shard's rows, or least, are in their ranges (rows in several trees count several
    times). Rows with null ids, or vectors that are null, zero or hold null or non-finite components, take no part;
    vectors of different lengths have no product, and are searched apart. shard_rows fixes the size of shards. Rows that share a vector are searched as one,
    and ids break ties. Fewer candidates than k give fewer rows; an empty table gives none. Repeated rows of one id and
    vector count once.
    """
    rows = usable(vectors, id_col, vector_col)
    asked = usable(queries, id_col, vector_col)
    # more than k + 1 rows of one vector are never among the k nearest: the smallest ids come first
    turn = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    members = rows.distinct().withColumn("turn", turn).where(F.col("turn") <= k + 1)
    name = F.min("vec_id").over(Window.partitionBy("v"))
    members = members.withColumn("name", name).select("name", "vec_id", "turn", "v")
    distinct = staged(members.where("turn = 1").select(F.size("v").alias("dim"), "name", "v"), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    lengths = distinct.groupBy("dim").agg(F.count("*").alias("n"), F.max(square).alias("square"))
    lengths = staged(lengths.select("dim", "square", F.ceil(F.col("n") / (F.lit(shard_rows) if shard_rows else rows_of_shard(F.col("n")))).cast("int").alias("shards")), "lengths")
    sought = asked.groupBy("v").agg(F.min("vec_id").alias("first"))
    column = lambda shard, asks, id_: [F.col("dim"), shard.alias("shard"), F.lit(asks).alias("asks"), F.col(id_).alias("id"), "square", "v"]
    left = distinct.join(lengths, "dim").select(column(F.pmod(F.xxhash64("name"), "shards").cast("int"), False, "name"))
    right = sought.withColumn("dim", F.size("v")).join(lengths, "dim").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    stream = left.unionByName(right.select(column(F.col("shard"), True, "first"))).repartition("dim", "shard").sortWithinPartitions("dim", "shard", "asks", "id")
    found = stream.mapInArrow(partial(_answers, k=k + 1, trees=trees, bits=bits, share=share, least=least, seed=seed), "first bigint, name bigint, score double")
    best = lambda by, n: F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), n))
    nearest = found.withColumn("rank", best("first", "name")).where(F.col("rank") <= k + 1).drop("rank")
    near_rows = nearest.join(members.select("name", "vec_id"), "name").withColumn("rank", best("first", "vec_id")).where(F.col("rank") <= k + 1)
    of_query = asked.distinct().join(sought, "v").select(F.col("vec_id").alias("query_id"), "first")
    each = of_query.join(near_rows.select("first", "vec_id", "score"), "first").where("vec_id <> query_id")
    return each.withColumn("rank", best("query_id", "vec_id")).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
