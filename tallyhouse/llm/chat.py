"""Roles of transcript lines by a hidden Markov model, and canonical turns.

A transcript is lines in order, some of which begin with a speaker marker ("User:", "AI:"). Hidden states say whose line
it is and whether it begins a turn; each line emits a symbol made of its marker and its form. Transition and emission
probabilities are counts over transcripts with known roles, smoothed by one. Viterbi recovers the most likely states.

Transcripts may be of any length, and one may hold a third of all lines, so they are solved in blocks: the best paths
through a block from each state to each other form a small matrix, matrices of neighbouring blocks are joined by
max-plus products (blocks, then runs of blocks), and with the states at its ends known each block is traced on its own.
The result is the one Viterbi path of the whole transcript. Turns are rendered in the same blocks.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.llm.common import staged

ROLES = ("system", "user", "assistant")
#: Hidden states: each role beginning a turn, then each role going on.
STATES = [*(f"{r}+" for r in ROLES), *ROLES]
#: The speaker markers that transcripts use, by role.
MARKERS = {"system": ("System", "Instructions"), "user": ("User", "Human", "Q"), "assistant": ("Assistant", "AI", "Bot", "A")}
_MARKER = re.compile(r"^\s*[*#>\[(]*(" + "|".join(m for r in ROLES for m in MARKERS[r]) + r")[*\])]*\s*[:>]\s*", re.I)
_OF = {m.lower(): r for r, own in MARKERS.items() for m in own}
#: Emitted symbols: marker's role or none, by the line's form.
FORMS = ("blank", "question", "short", "long")
SYMBOLS = [(m, f) for m in (*ROLES, "none") for f in FORMS]
BLOCK = 256


def symbol(line: str) -> int:
    found = _MARKER.match(line)
    rest = line[found.end() :].strip() if found else line.strip()
    form = "blank" if not rest else "question" if rest.endswith("?") else "short" if len(rest) < 80 else "long"
    return SYMBOLS.index((_OF[found[1].lower()] if found else "none", form))


def unmarked(line: str) -> str:
    found = _MARKER.match(line)
    return line[found.end() :] if found else line


class Model:
    """Log probabilities: start (states), step (states x states), emit (states x symbols)."""

    def __init__(self, start: np.ndarray, step: np.ndarray, emit: np.ndarray):
        self.start, self.step, self.emit = start, step, emit

    @staticmethod
    def of_counts(start: np.ndarray, step: np.ndarray, emit: np.ndarray) -> Model:
        log = lambda c: np.log((c + 1) / (c + 1).sum(axis=-1, keepdims=True))
        n = len(ROLES)
        step, start = log(step), log(start)
        for s in range(2 * n):  # a line goes on only with the role of the line before
            step[s, [n + r for r in range(n) if r != s % n]] = -np.inf
        start[n:] = -np.inf
        return Model(start, step, log(emit))

    def matrix(self, symbols: np.ndarray, first: bool) -> np.ndarray:
        """Best log probability from the state before the block to each state at its end; the first block starts the transcript."""
        n = len(STATES)
        best = np.tile(self.start, (n, 1)) + self.emit[:, symbols[0]] if first else self.step + self.emit[:, symbols[0]]
        for s in symbols[1:]:
            best = (best[:, :, None] + self.step).max(axis=1) + self.emit[:, s]
        return best

    def trace(self, symbols: np.ndarray, before: int | None, end: int) -> list[int]:
        """The best states of a block between the state before it and its last state."""
        best, back = (self.start if before is None else self.step[before]) + self.emit[:, symbols[0]], []
        for s in symbols[1:]:
            options = best[:, None] + self.step
            back.append(options.argmax(axis=0))
            best = options.max(axis=0) + self.emit[:, s]
        path = [end]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None]).max(axis=1)


def ends(matrices: list[np.ndarray], before: int | None, end: int | None) -> list[int]:
    """The state at the end of each matrix on the best path from before (None: a start) to end (None: any)."""
    best, back = matrices[0][before or 0], []
    for m in matrices[1:]:
        options = best[:, None] + m
        back.append(options.argmax(axis=0))
        best = options.max(axis=0)
    path = [int(best.argmax()) if end is None else end]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def lines(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text", role: str | None = None) -> DataFrame:
    """(conv, turn, line_no, line, role) of turns whose texts hold one or more lines. Null text is one empty line."""
    rows = turns.select(F.col(f"`{conv}`").cast("bigint").alias("conv"), F.col(f"`{turn}`").cast("bigint").alias("turn"), (F.col(f"`{role}`") if role else F.lit(None).cast("string")).alias("role"), F.posexplode(F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), "\n")).alias("line_no", "line"))
    return rows.select("conv", "turn", "line_no", "line", "role")


def learn(transcript: DataFrame) -> Model:
    """A model of lines() with known roles: counts over all of them, by turns (roles by role before) and lines.

    Lines whose role is null or unknown are not counted. Turns without a conversation or number give their lines and
    lengths, but no order. Counts are smoothed by one, so an empty table gives a model in which all is equally likely.
    """
    known = transcript.where(F.col("role").isin(*ROLES))
    coded = _coded(known.select("conv", "turn", "line_no", "line", "role"))
    n = len(ROLES)
    index = F.create_map(*[x for i, r in enumerate(ROLES) for x in (F.lit(r), F.lit(i))])
    state = index[F.col("role")] + F.when(F.col("line_no") == 0, 0).otherwise(n)
    emit, step, start = np.zeros((2 * n, len(SYMBOLS))), np.zeros((2 * n, 2 * n)), np.zeros(2 * n)
    for s, y, c in coded.groupBy(state.alias("s"), "symbol").count().collect():
        emit[s, y] += c
    turns = known.groupBy("conv", "turn").agg(F.min(index[F.col("role")]).alias("r"), (F.max("line_no") + 1).alias("n"))
    after = turns.select("conv", (F.col("turn") - 1).alias("turn"), F.col("r").alias("next"))
    first = turns.groupBy("conv").agg(F.min("turn").alias("turn")).join(turns, ["conv", "turn"]).groupBy("r").count()
    for r, c in first.collect():
        start[r] += c
    for r, long, following, lines_, c in turns.join(after, ["conv", "turn"], "left").groupBy("r", (F.col("n") > 1).alias("long"), "next").agg(F.sum("n").alias("lines"), F.count("*").alias("c")).collect():
        if following is not None:  # the last line of the turn leads on
            step[r + n * long, following] += c
        if long:
            step[r, n + r] += c
            step[n + r, n + r] += lines_ - 2 * c
    return Model.of_counts(start, step, emit)


def _coded(rows: DataFrame) -> DataFrame:
    """rows with the symbol of column line."""
    at = rows.columns.index("line")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([symbol(x or "") for x in batch.column(at).to_pylist()], pa.int32())], names=[*batch.schema.names, "symbol"])

    return rows.mapInArrow(add, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields), "symbol int"]))


def by_group(df: DataFrame, keys: list[str], order: str, job: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """The results of job over each group of rows, in order. Groups are small: a task holds one Arrow batch and one group at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]).combine_chunks() if rest is not None else table
            if not len(table):
                continue
            new = np.zeros(len(table), bool)
            for k in keys:
                for column in (table[k].is_null(), table[k].fill_null(0)):
                    x = column.to_numpy()
                    new[1:] |= x[1:] != x[:-1]
            starts = np.r_[0, np.flatnonzero(new)]
            done = [job(table.slice(a, b - a)) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
            rest = table.slice(int(starts[-1]))
            if done:
                yield from pa.concat_tables(done).combine_chunks().to_batches()
        if rest is not None and len(rest):
            yield from job(rest).to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(run, schema)


def parse(transcript: DataFrame, model: Model, block: int = BLOCK) -> DataFrame:
    """(conv, place, role, begins, line) for every line of lines(): its role, whether it begins a turn, its text without marker.

    place counts the lines of a transcript from 0. Lines at the same turn and line_no are ordered by their text; rows
    without a conversation form one transcript; lines without a turn come first. An empty table gives no rows.
    """
    # places without a window over a whole transcript: counts of lines for each turn, summed over runs of turns
    turns = transcript.groupBy("conv", "turn").agg(F.count("*").alias("n")).withColumn("run", F.floor(F.coalesce("turn", F.lit(-1)) / block))
    same = lambda a, b, *cols: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in cols]
    runs = turns.groupBy("conv", "run").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy("conv").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("conv", "run", F.coalesce(F.sum("n").over(whole), F.lit(0)).alias("base"))
    inner = Window.partitionBy("conv", "run").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("before", F.coalesce(F.sum("n").over(inner), F.lit(0)))
    offsets = turns.alias("t").join(runs.alias("r"), same("t", "r", "conv", "run")).select("t.conv", "t.turn", (F.col("before") + F.col("base")).alias("offset"))
    in_turn = F.row_number().over(Window.partitionBy("l.conv", "l.turn").orderBy("line_no", "line")) - 1
    placed = transcript.alias("l").join(offsets.alias("o"), same("l", "o", "conv", "turn")).select("l.conv", (F.col("offset") + in_turn).alias("place"), "line")
    coded = staged(_coded(placed.withColumn("block", F.floor(F.col("place") / block))), "transcript")

    def table(**columns) -> pa.Table:
        return pa.table(columns)

    flat = pa.list_(pa.float64())

    def block_matrix(t: pa.Table) -> pa.Table:
        b = t["block"][0].as_py()
        m = model.matrix(t["symbol"].to_numpy(), b == 0)
        return table(conv=t["conv"][:1], block=pa.array([b], pa.int64()), run=pa.array([b // block], pa.int64()), m=pa.array([m.ravel().tolist()], flat))

    shape = (len(STATES), len(STATES))
    square = lambda c: [np.array(x).reshape(shape) for x in c.to_pylist()]
    blocks = staged(by_group(coded.select("conv", "place", "block", "symbol"), ["conv", "block"], "place", block_matrix, "conv bigint, block bigint, run bigint, m array<double>"), "blocks")

    def run_matrix(t: pa.Table) -> pa.Table:
        out, *rest = square(t["m"])
        for m in rest:
            out = product(out, m)
        return table(conv=t["conv"][:1], run=t["run"][:1], m=pa.array([out.ravel().tolist()], flat))

    def run_ends(t: pa.Table) -> pa.Table:
        path = ends(square(t["m"]), None, None)
        return table(conv=t["conv"], run=t["run"], begin=pa.array([None, *path[:-1]], pa.int32()), end=pa.array(path, pa.int32()))

    # one row stands for block * block lines here
    runs = by_group(blocks, ["conv", "run"], "block", run_matrix, "conv bigint, run bigint, m array<double>")
    runs = by_group(runs, ["conv"], "run", run_ends, "conv bigint, run bigint, begin int, end int")

    def block_ends(t: pa.Table) -> pa.Table:
        begin, end = t["begin"][0].as_py(), t["end"][0].as_py()
        path = ends(square(t["m"]), begin, end)
        return table(conv=t["conv"], block=t["block"], begin=pa.array([begin, *path[:-1]], pa.int32()), end=pa.array(path, pa.int32()))

    inside = blocks.alias("b").join(runs.alias("r"), same("b", "r", "conv", "run")).select("b.conv", "b.block", "b.run", "m", "begin", "end")
    bounds = by_group(inside, ["conv", "run"], "block", block_ends, "conv bigint, block bigint, begin int, end int")

    def traced(t: pa.Table) -> pa.Table:
        path = model.trace(t["symbol"].to_numpy(), t["begin"][0].as_py(), t["end"][0].as_py())
        n = len(ROLES)
        return table(conv=t["conv"], place=t["place"], role=pa.array([ROLES[s % n] for s in path]), begins=pa.array([s < n for s in path]), line=pa.array([unmarked(x) if s < n else x for x, s in zip(t["line"].to_pylist(), path, strict=True)], pa.string()))

    joined = coded.alias("c").join(bounds.alias("b"), same("c", "b", "conv", "block")).select("c.conv", "c.place", "c.block", "c.symbol", "c.line", "begin", "end")
    return by_group(joined, ["conv", "block"], "place", traced, "conv bigint, place bigint, role string, begins boolean, line string")


def render(parsed: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv, place, role, part, text): canonical turns of parse(), in pieces of at most block lines.

    A piece that begins a turn opens with <|role|>, and one that ends it closes with <|end|>; place is the first line of
    the piece. The pieces of a transcript, joined in order, are its canonical text. Empty lines are kept; lines without a
    conversation are one transcript; an empty table gives no rows.
    """
    rows = parsed.withColumn("block", F.floor(F.col("place") / block))
    after = rows.groupBy("conv", "block").agg(F.min_by("begins", "place").alias("next_begins")).select(F.col("conv").alias("c"), (F.col("block") - 1).alias("b"), "next_begins")
    own = Window.partitionBy("conv", "block").orderBy("place")
    rows = rows.withColumn("piece", F.sum(F.col("begins").cast("int")).over(own)).withColumn("last_piece", F.sum(F.col("begins").cast("int")).over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    pieces = rows.groupBy("conv", "block", "piece", "last_piece", "role").agg(F.min("place").alias("place"), F.bool_or("begins").alias("opens"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("body"))
    joined = pieces.join(after, F.col("conv").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")), "left")
    closes = (F.col("piece") < F.col("last_piece")) | F.coalesce("next_begins", F.lit(True))
    text = F.concat(F.when(F.col("opens"), F.concat(F.lit("<|"), "role", F.lit("|>\n"))).otherwise(""), "body", F.when(closes, F.lit("<|end|>\n")).otherwise("\n"))
    return joined.select("conv", "place", "role", F.col("opens").alias("begins"), text.alias("text"))


def rough_transcripts(turns: DataFrame) -> DataFrame:
    """lines() of conversations with known roles, written as transcripts are: most turns begin with one of their role's
    markers, some with none, chosen by a hash of the turn."""
    pick = F.pmod(F.xxhash64("conv_id", "turn", "text"), F.lit(60))
    marker = F.lit(None).cast("string")
    for r in ROLES:
        own = F.array(*[F.lit(f"{m}: ") for m in MARKERS[r]])
        marker = F.when(F.col("role") == r, own[(pick % len(MARKERS[r])).cast("int")]).otherwise(marker)
    text = F.concat(F.when(pick < 51, F.coalesce(marker, F.lit(""))).otherwise(""), F.coalesce("text", F.lit("")))
    return lines(turns.select("conv_id", "turn", "role", text.alias("text")), role="role")
