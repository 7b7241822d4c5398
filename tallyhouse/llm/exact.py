"""Exact deduplication with keyed streaming state, in DataFrame and SQL functions only.

Each batch of arrivals is written once, under its name: its rows as they came, with digest, length and identifier. A
Structured Streaming aggregation over the narrow columns keeps, for each digest and without expiry, the locator and
identifier of the copy that stays and the number of copies, in RocksDB on disk with its checkpoint in the shared folder.
A locator is a batch and a row in it, and finds the whole row again at any later time. On hits full bytes are checked:
every row of a batch against the content of the copy that stays, in whichever batch that is, and earlier copies that
stayed against the present one. Digests whose texts differ are kept apart by their full text.

A digest of over a thousand copies that holds more than a ten-thousandth of all of them goes to the rows by broadcast
(there are ten thousand such digests at most); only the others are shuffled by digest. Content meets a hot group's rows in salted parts.
"""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm.common import SPACE_CLASS, Folder, fresh_path, meet, staged

#: Settings of the stateful query.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # many small stores share a disk: files take the room they need, not what might be needed
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Rows of one digest that meet its content in one part.
SALT_ROWS = 4096

_NARROW = "row bigint, doc_id bigint, digest binary, n_chars bigint, batch string"
_BEST = "struct<less: bigint, unnamed: boolean, doc_id: bigint, batch: string, row: bigint>"


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, f"{SPACE_CLASS}+", "")


def _digest(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def _best() -> Column:
    """The copy that stays: most code points, then the smallest id (a row without one comes last), then the first locator."""
    return F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "batch", "row"))


class DigestState:
    """Digest groups over any number of batches. The state lives under path and outlasts the session.

    One writer at a time. The path's store must rename folders in one step.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or fresh_path(spark, "digests")
        self._folder = Folder(spark, self.path)

    def ingest(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> str:
        """Take the rows in as a batch, and return its name.

        A name that was taken in before changes nothing, whatever the rows are; a run that was lost can be repeated
        under its name from any point, and no row counts twice. Rows of a later batch join the groups of earlier ones.
        """
        batch = batch or uuid.uuid4().hex
        if not re.fullmatch(r"[\w-]+", batch, re.ASCII):
            raise ValueError("a batch is named by letters, digits, _ and -")
        if not self._folder.exists(f"arrivals/batch={batch}"):
            text, written = F.coalesce(F.col(f"`{text_col}`"), F.lit("")), f"staging/{uuid.uuid4().hex}"
            docs.select(
                F.monotonically_increasing_id().alias("row"),
                F.col(f"`{id_col}`").cast("bigint").alias("doc_id"),
                _digest(normalised(text)).alias("digest"),
                F.length(text).cast("bigint").alias("n_chars"),
                F.col(f"`{text_col}`").alias("content"),
                F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("others") if len(docs.columns) > 1 else F.lit(None).cast("struct<none: int>").alias("others"),
            ).write.parquet(f"{self.path}/{written}")
            self._folder.move(written, f"arrivals/batch={batch}")
        self._run()
        for name in sorted(set(self._batches("arrivals")) - set(self._batches("apart"))):
            self._check(name)
        return batch

    def _batches(self, kind: str) -> list[str]:
        return [x.removeprefix("batch=") for x in self._folder.names(kind)]

    def _run(self) -> None:
        before = {k: self.spark.conf.get(k, None) for k in STATE}
        for k, v in STATE.items():
            self.spark.conf.set(k, v)
        try:
            # files keep the time at which they were written, and wait for any time until they are read
            stream = self.spark.readStream.schema(_NARROW).option("maxFileAge", "36500d").parquet(f"{self.path}/arrivals")
            groups = stream.groupBy("digest").agg(_best().alias("best"), F.count("*").alias("copies"))

            def keep(updates: DataFrame, turn: int) -> None:
                updates.write.mode("overwrite").parquet(f"{self.path}/groups/turn={turn}")

            groups.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)

    def _updates(self) -> DataFrame:
        return self.spark.read.schema(f"digest binary, best {_BEST}, copies bigint, turn bigint").parquet(f"{self.path}/groups")

    def groups(self) -> DataFrame:
        """(digest, best, keep_id, copies): the latest state of every digest."""
        latest = self._updates().groupBy("digest").agg(F.max_by(F.struct("best", "copies"), "turn").alias("x"))
        return latest.select("digest", "x.best", F.col("x.best.doc_id").alias("keep_id"), F.col("x.copies").alias("copies"))

    def arrivals(self) -> DataFrame:
        return self.spark.read.schema(_NARROW).parquet(f"{self.path}/arrivals")

    def _contents(self, batch: str) -> DataFrame:
        """(row, digest, norm) of a batch."""
        rows = self.spark.read.schema("row bigint, digest binary, content string").parquet(f"{self.path}/arrivals/batch={batch}")
        return rows.select("row", "digest", normalised(F.coalesce("content", F.lit(""))).alias("norm"))

    def rows(self, batch: str, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """(row, ...): the rows of a batch as they came, under their locator's row; docs has their columns."""
        own = self.spark.read.parquet(f"{self.path}/arrivals/batch={batch}")
        return own.select("row", F.struct(*[(F.col("content") if c == text_col else F.col(f"others.`{c}`")).alias(c) for c in docs.columns]).alias("source"))

    def found(self, pointers: DataFrame) -> DataFrame:
        """(digest, batch, row, norm): the contents that the locators (digest, batch, row) name."""
        names = [r.batch for r in pointers.select("batch").distinct().collect()]  # as many as batches, at most
        parts = [pointers.where(F.col("batch") == n).join(self._contents(n).drop("digest"), "row").select("digest", "batch", "row", "norm") for n in names]
        return reduce(DataFrame.unionByName, parts) if parts else pointers.select("digest", "batch", "row", F.lit("").alias("norm")).limit(0)

    def _hits(self) -> DataFrame:
        return staged(self.groups().where("copies > 1").select("digest", "best", "copies"), "hits")

    def _check(self, batch: str) -> None:
        """Compare the full bytes of the batch's hits, and of copies that stayed before, with the copy that stays; note digests whose texts differ."""
        hits = self._hits()
        own = staged(meet(self._contents(batch).withColumn("batch", F.lit(batch)), hits, "digest", "inner").select("digest", "batch", "row", "norm", "best", "copies"), "own")
        stays = (F.col("batch") == F.col("best.batch")) & (F.col("row") == F.col("best.row"))
        content = own.where(stays).select("digest", "norm", "copies")
        others = own.where(~stays).select("digest", "row", "norm", "copies")
        if len(self._batches("arrivals")) > 1:
            here = own.select("digest", "best", "copies").distinct()
            elsewhere = here.where(F.col("best.batch") != batch)
            stood = self._updates().select("digest", F.col("best").alias("stood")).join(here, "digest").where((F.col("stood.batch") != batch) & (F.col("stood") != F.col("best")))
            last = lambda x, c: self.found(x.select("digest", f"{c}.batch", f"{c}.row").distinct()).join(here.select("digest", "copies"), "digest")
            content = content.unionByName(last(elsewhere, "best").select("digest", "norm", "copies"))
            others = others.unionByName(last(stood, "stood").select("digest", "row", "norm", "copies"))
        parts = F.ceil(F.col("copies") / SALT_ROWS).cast("int")
        left = others.withColumn("salt", F.pmod(F.xxhash64("row"), parts).cast("int"))
        right = content.select("digest", F.col("norm").alias("content"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"))
        apart = left.join(right, ["digest", "salt"]).where("norm <> content").select("digest").distinct()
        written = f"staging/{uuid.uuid4().hex}"
        apart.write.parquet(f"{self.path}/{written}")
        self._folder.move(written, f"apart/batch={batch}")

    def results(self, batch: str) -> DataFrame:
        """(doc_id, batch, row, keep_id, keep_batch, keep_row, group_size, kept, digest) for the rows of a batch, over all batches so far."""
        hits = self._hits()
        apart = self.spark.read.schema("digest binary").parquet(f"{self.path}/apart").distinct()
        own = self.arrivals().where(F.col("batch") == batch)
        if not apart.isEmpty():
            hits = hits.join(apart, "digest", "left_anti")
        found = meet(own, hits, "digest", "left")
        out = ["doc_id", "batch", "row", "n_chars", "digest", "best", "copies"]
        if not apart.isEmpty():
            texts = reduce(DataFrame.unionByName, [self._contents(n).withColumn("batch", F.lit(n)) for n in self._batches("arrivals")]).join(apart, "digest", "left_semi")
            texts = staged(texts.join(self.arrivals().drop("digest"), ["batch", "row"]).select("digest", "norm", "doc_id", "n_chars", "batch", "row"), "texts")
            groups = texts.groupBy("digest", "norm").agg(_best().alias("best"), F.count("*").alias("copies"))
            found = found.join(apart, "digest", "left_anti").select(out).unionByName(texts.where(F.col("batch") == batch).join(groups, ["digest", "norm"]).select(out))
        alone = F.col("copies").isNull()
        stays = lambda c: F.when(alone, F.col(c)).otherwise(F.col(f"best.{c}"))
        return found.select(
            "doc_id", "batch", "row",
            stays("doc_id").alias("keep_id"), stays("batch").alias("keep_batch"), stays("row").alias("keep_row"),
            F.coalesce("copies", F.lit(1)).cast("bigint").alias("group_size"),
            (alone | (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (-F.col("n_chars") == F.col("best.less")))).alias("kept"),
            "digest",
        )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", state: DigestState | None = None, batch: str | None = None) -> DataFrame:
    """(doc_id, batch, row, keep_id, keep_batch, keep_row, group_size, kept, digest) for every row of docs; digest is binary SHA-256.

    Texts are equal if identical without white space; null text is empty and equal to other empty ones. Of equal texts
    the longest original (in code points) stays, then the smallest doc_id; rows without an id lose ties. Rows that tie
    in both carry kept = true alike, as a row repeated in full does; the locator (keep_batch, keep_row) names one of
    them. With a state, docs is a batch of it and the groups hold earlier batches too. An empty table gives no rows.
    doc_id must be an integer column; other columns may have any names.
    """
    state = state or DigestState(docs.sparkSession)
    return state.results(state.ingest(docs, id_col, text_col, batch))


def first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without those of which an equal text stays: one row of every group, all columns."""
    state = DigestState(docs.sparkSession)
    batch = state.ingest(docs, id_col, text_col)
    gone = state.results(batch).where(F.col("row") != F.col("keep_row")).select("row")
    return state.rows(batch, docs, text_col).join(gone, "row", "left_anti").select("source.*")
