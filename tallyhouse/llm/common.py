"""Helpers that several operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: space and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]"

_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a folder of our own where it is unset, on a local master only."""
    global _own_dir
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="tallyhouse-")
    return f"file://{_own_dir}"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that their Python finds it wherever the driver did."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="tallyhouse-")) / "tallyhouse.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(target))


#: Paths given out inside each open settled().
_open: list[list[str]] = []


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    return path


def settled(spark: SparkSession, label: str, job: Callable[[], DataFrame]) -> DataFrame:
    """What job returns, written and read back; whatever it wrote to fresh paths on the way is removed. One job at a time."""
    path = fresh_path(spark, label)
    _open.append([])
    try:
        df = job()
        _write(df, path)
        return spark.read.schema(df.schema).parquet(path)
    finally:
        for x in _open.pop():
            Folder(spark, x).drop("")


class Folder:
    """A folder of a store that Spark reaches. Names are relative to it."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = path
        self._new = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._new(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._new(f"{self._path}/{name}" if name else self._path)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def names(self, name: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._at(name))) if self.exists(name) else []

    def move(self, name: str, to: str) -> None:
        """Give a file or folder its final name, in one step. to must be free."""
        self._fs.mkdirs(self._at(to).getParent())
        if self.exists(to) or not self._fs.rename(self._at(name), self._at(to)):
            raise OSError(f"{to} is taken, or {name} could not be moved")

    def write(self, name: str, text: str) -> None:
        self._fs.mkdirs(self._at(name).getParent())
        out = self._fs.create(self._at(name), True)
        out.write(bytearray(text.encode()))
        out.close()

    def read(self, name: str) -> str:
        opened = self._fs.open(self._at(name))
        text = bytes(opened.readAllBytes()).decode()
        opened.close()
        return text

    def drop(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


#: Shuffle files of a finished write are of no further use.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows go to Python in batches of so many bytes, whatever the length of their texts; one row at least.
_BATCH, _BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def staged(df: DataFrame, label: str) -> DataFrame:
    """df, written once to the shared folder and read back: its lineage is cut and survives lost executors, and its shuffle files go."""
    path = fresh_path(df.sparkSession, label)
    _write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _write(df: DataFrame, path: str) -> None:
    spark = df.sparkSession
    own = {_CLEANUP: "true", _BATCH: str(_BATCH_BYTES)}
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator needs, under its own names, so that other columns cannot clash. Null text is empty."""
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def row_key(*cols: Column | str) -> Column:
    """64 bits of a row's content, for use with more bits beside them."""
    return F.xxhash64(*cols)


def row_digest(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """128 bits that name a row's id and text. Rows with both equal share it."""
    known = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("null"))
    return F.unhex(F.md5(F.concat(known(id_col), F.lit("\n"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")))))


def word_blocks(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of data in order, in lists cut at white space, so that a huge text never becomes one huge list."""
    start, n = 0, len(data)
    while start < n:
        end = start + size
        if end < n:
            found = _SPACE.search(data, end)
            end = found.start() if found else n
        words = data[start : min(end, n)].split()
        if words:
            yield words
        start = end


#: Groups with more than this part of all copies are broadcast, ten thousand at most, if they have so many copies.
HOT, HOT_COPIES = 10_000, 1000


def meet(rows: DataFrame, groups: DataFrame, key: str, how: str, total: int | None = None) -> DataFrame:
    """rows with the group of their key; groups have a column copies, the number of rows of the key, and each key once.

    how is inner, or left for nulls where there is no group; total is the sum of copies, if known, or more. Keys of hot groups go to the rows by broadcast, and their
    rows stay where they are; the other keys are shuffled, at any size of the groups.
    """
    added = [c for c in groups.columns if c != key]
    if total is None:
        total = groups.agg(F.sum("copies")).first()[0] or 0
    least = max(HOT_COPIES, total / HOT)
    marked = rows.join(F.broadcast(groups.where(F.col("copies") > least)), key, "left")
    rest = marked.where("copies is null").drop(*added).join(groups.where(F.col("copies") <= least).hint("merge"), key, how)
    return marked.where("copies is not null").unionByName(rest)
