"""Fill-in-the-middle forms of documents by displacement scatter.

A text is cut at two places into prefix, middle and suffix, and written with a sign before each part: prefix, suffix,
middle (psm), or suffix, prefix, middle (spm); some texts stay as they are (plain). All texts of a batch are one run of
bytes. One scan finds the places of the cuts. Each part moves as a whole, so a difference array that holds the change of
shift at the first byte of every part, summed up along the bytes, gives each byte its shift to its place in the output,
and one scatter writes all outputs of the batch. The inverse finds the signs in the outputs, and gathers every byte of
the text from where it went.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.buffers import WINDOW, slabs, strings, view
from tallyhouse.llm.common import documents

#: The signs of prefix, suffix and middle; each is three bytes of which the first and last occur nowhere else in it.
SIGNS = (b"<P>", b"<S>", b"<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"
FORMS = np.array([PLAIN, PSM, SPM])
_LETTERS = np.frombuffer(b"".join(s[1:2] for s in SIGNS), np.uint8)


def _code_points(data: np.ndarray, at: int) -> np.ndarray:
    """Where code points begin in the window of data from at on."""
    return at + np.flatnonzero((data[at : at + WINDOW] & 0xC0) != 0x80)


def ranks(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """How many code points begin before each of the places, which are sorted."""
    out, before = np.empty(len(places), np.int64), 0
    for at in range(0, len(data), WINDOW):
        begins = _code_points(data, at)
        lo, hi = np.searchsorted(places, [at, at + WINDOW])
        out[lo:hi] = before + np.searchsorted(begins, places[lo:hi])
        before += len(begins)
    out[np.searchsorted(places, len(data)) :] = before
    return out


def places(data: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where the code point of each rank begins; ranks are sorted, and the number of all code points stands for the end."""
    out, before = np.full(len(wanted), len(data), np.int64), 0
    for at in range(0, len(data), WINDOW):
        begins = _code_points(data, at)
        lo, hi = np.searchsorted(wanted, [before, before + len(begins)])
        out[lo:hi] = begins[wanted[lo:hi] - before]
        before += len(begins)
    return out


def _signs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, row) of every sign that lies inside one text."""
    found = []
    for at in range(0, len(data), WINDOW):
        part = data[at : at + WINDOW + 2]
        if len(part) > 2:
            found.append(at + np.flatnonzero((part[:-2] == SIGNS[0][0]) & (part[2:] == SIGNS[0][2]) & np.isin(part[1:-1], _LETTERS)))
    place = np.concatenate(found) if found else np.empty(0, np.int64)
    row = np.searchsorted(offsets, place, "right") - 1
    inside = place + 3 <= offsets[row + 1] if len(place) else np.empty(0, bool)
    return place[inside], row[inside]


def _targets(starts: np.ndarray, shifts: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(place, targets) for each window of n bytes: every byte's place plus the shift of the last run that begins at it or before."""
    change, carried = np.diff(shifts, prepend=0), 0
    for at in range(0, n, WINDOW):
        steps = np.zeros(min(WINDOW, n - at), np.int64)
        lo, hi = np.searchsorted(starts, [at, at + len(steps)])
        np.add.at(steps, starts[lo:hi] - at, change[lo:hi])
        steps[0] += carried
        np.cumsum(steps, out=steps)
        carried = steps[-1]
        yield at, steps + np.arange(at, at + len(steps))


def _written(data: np.ndarray, offsets: np.ndarray, p: np.ndarray, m: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the outputs of texts whose prefixes end at p and middles at m; form is an index of FORMS."""
    first, last, cut = offsets[:-1], offsets[1:], form > 0
    ends = np.r_[0, np.cumsum(last - first + 9 * cut)]
    begin, prefix, suffix = ends[:-1], p - first, last - m
    # psm has the prefix behind one sign, spm behind the suffix and two
    to_prefix = begin + np.where(form == 2, 6 + suffix, 3 * cut)
    to_suffix = begin + np.where(form == 2, 3, np.where(cut, 6 + prefix, m - first))
    to_middle = begin + np.where(cut, 9 + prefix + suffix, prefix)
    starts = np.stack([first, p, m], axis=1).ravel()
    shifts = np.stack([to_prefix - first, to_middle - p, to_suffix - m], axis=1).ravel()
    out = np.empty(ends[-1], np.uint8)
    for at, targets in _targets(starts, shifts, len(data)):
        out[targets] = data[at : at + len(targets)]
    for sign, to in zip(SIGNS, (to_prefix, to_suffix, to_middle), strict=True):
        for k, byte in enumerate(sign):
            out[to[cut] - 3 + k] = byte
    return out, ends


def _transformed(batches: Iterator[pa.RecordBatch], plain_from: int, spm_below: int) -> Iterator[pa.RecordBatch]:
    for slab in slabs(batches, 1):
        data, offsets = view(slab.column(1))
        h = [slab.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4, 5)]
        seen = ranks(data, offsets)
        n = np.diff(seen)
        low, high = np.minimum(h[0] % (n + 1), h[1] % (n + 1)), np.maximum(h[0] % (n + 1), h[1] % (n + 1))
        cuts = places(data, np.stack([seen[:-1] + low, seen[:-1] + high], axis=1).ravel()).reshape(-1, 2)
        signed = np.zeros(len(n), bool)
        signed[_signs(data, offsets)[1]] = True
        plain = (n == 0) | signed | (h[2] % 100 >= plain_from)
        form = np.where(plain, 0, np.where(h[3] % 100 < spm_below, 2, 1))
        out = strings(*_written(data, offsets, cuts[:, 0], cuts[:, 1], form))
        chars = [pa.array(x, pa.int64(), mask=plain) for x in (low, high - low)]
        yield pa.RecordBatch.from_arrays([slab.column(0), pa.array(n), pa.array(FORMS[form]), *chars, out], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def draws(seed: int, id_col: Column, count: int) -> list[Column]:
    """The first count groups of eight hex digits of the SHA-256 of seed:id, as integers; a null id is written as null."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null"))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(count)]


def transform(docs: DataFrame, seed: int = 1, plain_from: int = 90, spm_below: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row; n counts the text's code points.

    The cuts and the form depend on seed and id alone: of 100 parts, those from plain_from on stay plain, and of the
    others those below spm_below are spm. Empty and null texts, and texts that contain a sign, are plain, with null
    lengths. Repeated rows each come back, with equal outputs. An empty table gives no rows.
    """
    rows = documents(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.select("doc_id", "text", *[h.alias(f"h{i}") for i, h in enumerate(draws(seed, F.col("doc_id"), 4))])
    return rows.mapInArrow(
        partial(_transformed, plain_from=plain_from, spm_below=spm_below), f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    )


def _gathered(data: np.ndarray, offsets: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, bad): the texts whose outputs are in data; bad outputs have not the three signs of their form."""
    place, row = _signs(data, offsets)
    first, last = offsets[:-1], offsets[1:]
    held = np.bincount(row, minlength=len(first))
    cut = (form > 0) & (held == 3)
    at = place[cut[row]].reshape(-1, 3)
    order = np.array([[1, 0, 2], [0, 1, 2], [1, 0, 2]])[form[cut]]  # where the signs of prefix and suffix are among the three
    letters = data[at + 1] if len(at) else np.empty((0, 3), np.uint8)
    cut[np.flatnonzero(cut)[(np.take_along_axis(letters, order, 1) != _LETTERS).any(axis=1)]] = False
    bad = (form > 0) & ~cut
    at, spm = place[cut[row]].reshape(-1, 3), form[cut] == 2
    p, s, m = first.copy(), last.copy(), last.copy()  # where the parts begin in the output; a plain text is all prefix
    prefix, middle, suffix = last - first, np.zeros_like(first), np.zeros_like(first)
    one, two, three = at.T + 3
    p[cut], s[cut], m[cut] = np.where(spm, two, one), np.where(spm, one, two), three
    lengths = two - 3 - one, three - 3 - two
    prefix[cut], suffix[cut], middle[cut] = np.where(spm, lengths[1], lengths[0]), np.where(spm, lengths[0], lengths[1]), last[cut] - three
    ends = np.r_[0, np.cumsum(prefix + middle + suffix)]
    starts = np.stack([ends[:-1], ends[:-1] + prefix, ends[:-1] + prefix + middle], axis=1).ravel()
    shifts = np.stack([p, m, s], axis=1).ravel() - starts
    out = np.empty(ends[-1], np.uint8)
    for at, sources in _targets(starts, shifts, len(out)):
        out[at : at + len(sources)] = data[sources]
    return out, ends, bad


def _restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for slab in slabs(batches, 2):
        data, offsets = view(slab.column(2))
        form = slab.column(1).to_numpy(zero_copy_only=False)
        out, ends, bad = _gathered(data, offsets, np.where(form == PSM, 1, np.where(form == SPM, 2, 0)))
        yield pa.RecordBatch.from_arrays([slab.column(0), strings(out, ends, bad)], names=["row", "restored"])


def restore(outputs: DataFrame, form_col: str = "form", output_col: str = "output") -> DataFrame:
    """outputs with restored, the texts, in place of output: from output and form alone.

    Null outputs are empty and null forms plain. An output without the three signs of its form, each once and in order,
    gives null.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in outputs.columns if c != output_col])
    given = outputs.select(row.alias("row"), F.coalesce(f"`{form_col}`", F.lit(PLAIN)).alias("form"), F.coalesce(f"`{output_col}`", F.lit("")).alias("output"))
    kind = given.schema["row"].dataType.simpleString()
    return given.mapInArrow(_restored, f"row {kind}, restored string").select("row.*", "restored")
