"""Texts of an Arrow column as one run of bytes, for numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that are looked at together, so that index arrays stay small beside any text.
WINDOW = 1 << 20


def slabs(batches: Iterator[pa.RecordBatch], column: int, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of batches in slices whose texts have about size bytes, a longer text alone."""
    for batch in batches:
        ends = _offsets(batch.column(column))[1:]
        at = 0
        while at < len(batch):
            begin = ends[at - 1] if at else ends[0] - len(batch.column(column)[0].as_buffer())
            to = max(at + 1, int(np.searchsorted(ends, begin + size, "right")))
            yield batch.slice(at, to - at)
            at = to


def _offsets(texts: pa.Array) -> np.ndarray:
    texts = texts.cast(pa.large_binary())
    return np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]


def view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): the texts of a column without nulls one after the other, and where each begins, with the end of the last."""
    texts = texts.cast(pa.large_binary())
    offsets = _offsets(texts)
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def strings(data: np.ndarray, offsets: np.ndarray, gone: np.ndarray | None = None) -> pa.Array:
    """The strings that lie between offsets of data; null where gone."""
    texts = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())
    return pa.array(texts.to_pylist(), pa.string(), mask=gone) if gone is not None and gone.any() else texts
