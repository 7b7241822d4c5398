"""Byte-level BPE over whole texts, with long texts encoded in overlapping chunks.

A long text is cut into chunks that overlap. Each chunk is split into pre-tokens on its own, in parallel; where a chunk
and the start of the next one agree on a pre-token boundary inside their overlap, both splits run on alike, so the text
is stitched there, and the pieces between stitches are encoded in parallel. Chunks with an overlap without such a
boundary (a run of letters as long as the overlap, which is one pre-token) are joined to one piece, the others not.
Decoding joins the ids' raw bytes.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.llm.common import documents, staged
from tallyhouse.llm.tokens import rank_encoding


@cache
def _pattern(pattern: str):
    return regex.compile(pattern)


def boundaries(text: str, pattern: str, low: int, high: int) -> set[int]:
    """Pre-token boundaries in [low, high) at which a piece can end: where a letter or digit is followed by white space,
    punctuation or the other kind. Wherever a split begins, it has a boundary there.

    Apostrophes and marks are left out, as patterns take them to letters; so is the end of text, since more text could
    move it.
    """
    found = set()
    for m in _pattern(pattern).finditer(text):
        at = m.end()
        if at >= high:
            break
        if at >= low and at < len(text):
            before, after = unicodedata.category(text[at - 1])[0], unicodedata.category(text[at])[0]
            if before in "LN" and (text[at] in " \n" or after in "LNPS" and after != before and text[at] not in "'\u2019"):
                found.add(at)
    return found


def _encoded(texts: list[str], ranks: str, pattern: str) -> pa.Array:
    encoding = rank_encoding(ranks, pattern)
    lists = [encoding.encode_ordinary(t) for t in texts]
    flat = np.concatenate([np.array(x, np.int32) for x in lists]) if lists else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lists)]), pa.int32()), pa.array(flat))


def _whole(batches: Iterator[pa.RecordBatch], ranks: str, pattern: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 512):
            part = batch.slice(at, 512)
            yield pa.RecordBatch.from_arrays([part.column(0), _encoded(part.column(1).to_pylist(), ranks, pattern)], names=["doc_id", "ids"])


def _chunks(batches: Iterator[pa.RecordBatch], size: int, overlap: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, text in enumerate(batch.column(2)):
            text = text.as_py()
            n = len(range(0, len(text), size))
            for first in range(0, n, 64):
                own = range(first, min(n, first + 64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0)[i].as_py()] * len(own), pa.int64()), batch.column(1).take(pa.array([i] * len(own))), pa.array(own, pa.int32()), pa.array([c == n - 1 for c in own]), pa.array([text[c * size : (c + 1) * size + overlap] for c in own])],
                    names=["uid", "doc_id", "chunk", "last", "text"],
                )


def _stitches(batches: Iterator[pa.RecordBatch], pattern: str, size: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """Where each chunk but the last hands over to the next, counted from the next one's start; null if nowhere."""
    for batch in batches:
        places = []
        for last, text in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
            text = "" if last else text.as_py()
            common = {b - size for b in boundaries(text, pattern, size, size + overlap)} & boundaries(text[size:], pattern, 1, overlap) if text else set()
            places.append(min(common) if common else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(places, pa.int32())], names=["uid", "chunk", "last", "stitch"])


def _pieces(batches: Iterator[pa.RecordBatch], ranks: str, pattern: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 64):
            part = batch.slice(at, 64)
            yield pa.RecordBatch.from_arrays([*part.columns[:3], _encoded(part.column(3).to_pylist(), ranks, pattern)], names=["uid", "doc_id", "chunk", "ids"])


def encode(docs: DataFrame, ranks: str, pattern: str, chunk: int = 32_768, overlap: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>): the ids of every row's whole text, as the tiktoken library gives them, without special tokens.

    Null text is empty and has no ids. Repeated rows each come back. An empty table gives no rows.
    """
    rows = documents(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    whole = partial(_whole, ranks=ranks, pattern=pattern)
    short = rows.where(F.length("text") <= chunk).mapInArrow(whole, f"doc_id {kind}, ids array<int>")
    long = rows.where(F.length("text") > chunk).select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text")
    cut = staged(long.mapInArrow(partial(_chunks, size=chunk, overlap=overlap), f"uid bigint, doc_id {kind}, chunk int, last boolean, text string"), "chunks").repartition("uid", "chunk")
    stitches = cut.select("uid", "chunk", "last", "text").mapInArrow(partial(_stitches, pattern=pattern, size=chunk, overlap=overlap), "uid bigint, chunk int, last boolean, stitch int")
    in_order = Window.partitionBy("uid").orderBy("chunk")
    spans = stitches.withColumn("begin", F.lag("stitch").over(in_order))
    spans = spans.withColumn("piece", F.sum(F.col("begin").isNotNull().cast("int")).over(in_order)).withColumn("chunks", F.count("*").over(Window.partitionBy("uid", "piece")))
    spans = staged(spans.select("uid", "chunk", "piece", "chunks", F.coalesce("begin", F.lit(0)).alias("begin"), F.col("stitch").alias("end")), "spans")
    # a chunk's own part of its piece: up to the stitch, to the next chunk's start, or to the end of the text
    length = F.when(F.col("end").isNotNull(), F.lit(chunk) + F.col("end") - F.col("begin")).when(F.col("last"), F.lit(2**31 - 1)).otherwise(F.lit(chunk) - F.col("begin"))
    parts = cut.join(spans, ["uid", "chunk"]).select("uid", "doc_id", "chunk", "piece", "chunks", F.substring("text", F.col("begin") + 1, length).alias("text"))
    own = F.array_sort(F.collect_list(F.struct("chunk", "text")))
    joined = parts.where("chunks > 1").groupBy("uid", "piece").agg(F.first("doc_id").alias("doc_id"), F.min("chunk").alias("chunk"), F.array_join(F.transform(own, lambda x: x["text"]), "").alias("text"))
    pieces = parts.where("chunks = 1").select("uid", "doc_id", "chunk", "text").unionByName(joined.drop("piece"))
    encoded = pieces.mapInArrow(partial(_pieces, ranks=ranks, pattern=pattern), f"uid bigint, doc_id {kind}, chunk int, ids array<int>")
    ordered = F.array_sort(F.collect_list(F.struct("chunk", "ids")))
    stitched = encoded.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids")).select("doc_id", "ids")
    return short.unionByName(stitched)


def _decoded(batches: Iterator[pa.RecordBatch], ranks: str, pattern: str) -> Iterator[pa.RecordBatch]:
    encoding = rank_encoding(ranks, pattern)
    for batch in batches:
        for at in range(0, len(batch), 512):
            part = batch.slice(at, 512)
            data = [encoding.decode_bytes(x or []) for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(data, pa.binary())], names=["doc_id", "ids", "data"])


def decode(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, ids, data): the raw bytes of the ids of encode(). Null ids give no bytes."""
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(partial(_decoded, ranks=ranks, pattern=pattern), f"doc_id {kind}, ids array<int>, data binary")
