"""Packing documents into training sequences by vector best fit.

Every piece of a document has three sizes: tokens, documents (one) and attention cost (tokens squared). A sequence has
a capacity of each. Pieces are taken longest first; among the open sequences in which every capacity still holds, the
one is chosen whose residual after the piece has the least weighted norm (or whose residual has the greatest weighted
dot product with the piece). Pieces are dealt to groups of about group_size by a hash, and each group is packed alone:
a group loses at most its last, partly filled sequences, and no task ever sees all pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import documents, staged
from tallyhouse.llm.tokens import word_tokenizer


#: Texts that are tokenized together.
SLAB = 64


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    pa.default_memory_pool().release_unused()  # what earlier work in this process has left
    tokenizer, end = word_tokenizer(path), np.array([end_id], "<u4").tobytes()
    for batch in batches:
        source, piece, start, length, crc = [], [], [], [], []
        texts = batch.column(1).cast(pa.binary())
        found = (ids for at in range(0, len(texts), SLAB) for ids in tokenizer.ids(texts.slice(at, SLAB).to_pylist()))
        for row, ids in enumerate(found):
            ids += end
            n = len(ids) // 4
            for k, at in enumerate(range(0, n, capacity)):
                source.append(row)
                piece.append(k)
                start.append(at)
                length.append(min(capacity, n - at))
                crc.append(zlib.crc32(ids[4 * at : 4 * (at + capacity)]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(source, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
            names=["doc_id", "piece", "start", "length", "ids_crc32"],
        )


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids and end_id, cut only where longer than capacity."""
    rows = documents(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(partial(_pieces, path=tokenizer, capacity=capacity, end_id=end_id), f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit(sizes: np.ndarray, capacities: np.ndarray, weights: np.ndarray, rule: str = "norm") -> np.ndarray:
    """The bin of each item; sizes has a row for each item, in the order in which they are packed. Each item must fit an empty bin."""
    unit, n = sizes / capacities, len(sizes)
    bins = np.empty(n, np.int64)
    free = np.empty((64, sizes.shape[1]))
    names = np.empty(64, np.int64)
    opened = used = 0
    least = np.minimum.accumulate(unit[::-1], axis=0)[::-1]
    for i, item in enumerate(unit):
        if i % 256 == 0:  # bins that none of the items to come fits into are closed
            stay = (free[:used] >= least[i] - 1e-12).all(axis=1)
            used = int(stay.sum())
            free[:used], names[:used] = free[: len(stay)][stay], names[: len(stay)][stay]
        fits = np.flatnonzero((free[:used] >= item - 1e-12).all(axis=1))
        if len(fits):
            residual = free[fits]
            at = fits[(((residual - item) ** 2) @ weights).argmin() if rule == "norm" else ((residual * item) @ weights).argmax()]
        else:
            if used == len(free):
                free, names = np.concatenate([free, np.empty_like(free)]), np.concatenate([names, np.empty_like(names)])
            at = used
            free[at], names[at] = 1.0, opened
            used, opened = used + 1, opened + 1
        free[at] -= item
        bins[i] = names[at]
    return bins


def _pack(table: pa.Table, capacity: int, max_docs: int, max_cost: int, weights: tuple[float, ...], rule: str) -> pa.Table:
    length, row = table["length"].to_numpy(), table["row"].to_numpy()
    order = np.lexsort((row, -length))
    n = length[order]
    bins = best_fit(np.stack([n, np.ones_like(n), n * n], axis=1).astype(float), np.array([capacity, max_docs, max_cost], float), np.array(weights), rule)
    by_bin = np.argsort(bins, kind="stable")
    ends = np.cumsum(n[by_bin])
    first = np.flatnonzero(np.r_[True, np.diff(bins[by_bin]) != 0])
    base = np.repeat(np.r_[0, ends[first[1:] - 1]], np.diff(np.r_[first, len(n)]))
    offset, sequence = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
    offset[order[by_bin]] = ends - n[by_bin] - base
    sequence[order] = bins + (table["part"][0].as_py() << 32)
    return table.drop_columns(["part"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, max_docs: int | None = None, max_cost: int | None = None, end_id: int = 0,
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01), rule: str = "norm", group_size: int = 16_384, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every row of docs.

    Null text is empty and gives one piece with end_id alone. Repeated rows are packed each. Without max_docs and
    max_cost these capacities are as large as tokens alone can make them, so they never open a sequence more. max_cost
    must admit a whole piece. An empty table gives no rows. A sequence never holds more than any of its capacities.
    """
    max_docs, max_cost = max_docs or capacity, max_cost or capacity * capacity
    if max_cost < capacity * capacity:
        raise ValueError("a full piece would not fit an empty sequence: cut pieces shorter or raise max_cost")
    cut = staged(pieces(docs, tokenizer, capacity, end_id, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "pieces")
    full = cut.where(F.col("length") == capacity).withColumn("sequence_id", -F.col("row") - 1).withColumn("offset", F.lit(0).cast("bigint")).drop("row")
    part = cut.where(F.col("length") < capacity)
    groups = max(1, -(-part.count() // group_size))
    kind = part.schema["doc_id"].dataType.simpleString()

    def one_group(table: pa.Table) -> pa.Table:
        return _pack(table, capacity, max_docs, max_cost, weights, rule)

    packed = (
        part.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("bigint"))
        .groupBy("part")
        .applyInArrow(one_group, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, row bigint, sequence_id bigint, offset bigint")
    )
    return full.unionByName(packed.drop("row"))
