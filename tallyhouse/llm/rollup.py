"""Token-count rollups that are maintained by deltas.

Changes are signed rows: +1 for a document that comes, -1 for one that goes; a revised count is the old row with -1 and
the new one with +1. A batch is aggregated to one delta row for each source, language and tokenizer version, so a hot
source costs no more than any other, and written under its batch id. A batch counts once it is committed: the delta
table is written first and its marker last, and a batch id that is committed is never applied again. Totals are sums of
committed deltas, so the order of batches does not matter. compact() folds them into one table; a manifest that names
the table and the batches in it takes effect in one step, and what it replaces is removed afterwards only.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm.common import Folder, fresh_path
from tallyhouse.llm.tokens import rank_encoding

KEYS = ["source", "lang", "tokenizer"]
DELTA = "source string, lang string, tokenizer string, documents bigint, tokens bigint"


def _counts(batches: Iterator[pa.RecordBatch], tokenizers: dict[str, str], pattern: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            texts = part.column(part.num_columns - 1).to_pylist()
            for name, path in tokenizers.items():
                encoding = rank_encoding(path, pattern)
                n = pa.array([len(encoding.encode_ordinary(t)) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([name] * len(part)), n], names=["key", "source", "lang", "tokenizer", "n_tokens"])


def token_counts(docs: DataFrame, tokenizers: dict[str, str], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, source, lang, tokenizer, n_tokens): the tokens of every whole text under each tokenizer version (name -> rank file). Null text has none."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("key"), "source", "lang", F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return rows.mapInArrow(partial(_counts, tokenizers=tokenizers, pattern=pattern), f"key {kind}, source string, lang string, tokenizer string, n_tokens bigint")


def inserts(counts: DataFrame) -> DataFrame:
    return counts.withColumn("sign", F.lit(1))


def deletes(counts: DataFrame) -> DataFrame:
    return counts.withColumn("sign", F.lit(-1))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """The signed rows that turn counts old into counts new: what is in both alike cancels in the deltas."""
    return deletes(old).unionByName(inserts(new))


class TokenRollup:
    """Totals by source, language and tokenizer version, kept under path in the shared folder."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or fresh_path(spark, "rollup")
        self._folder = Folder(spark, self.path)

    def committed(self, batch: str) -> bool:
        return self._folder.exists(f"commits/{batch}")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply the signed rows (source, lang, tokenizer, n_tokens, sign) as batch. False if it was committed before: then nothing changes.

        A null count is zero tokens; null sources, languages and tokenizers are groups of their own. A run that fails
        leaves no marker, and the batch can be given again: its delta is then written anew.
        """
        if self.committed(batch):
            return False
        n = F.coalesce(F.col("n_tokens"), F.lit(0)).cast("bigint")
        sign = F.col("sign").cast("bigint")
        delta = changes.groupBy(*KEYS).agg(F.sum(sign).alias("documents"), F.sum(sign * n).alias("tokens"))
        delta.write.mode("overwrite").parquet(f"{self.path}/deltas/{batch}")
        self._folder.write(f"commits/{batch}", "")
        return True

    def _folded(self) -> tuple[str | None, list[str]]:
        """The folded table and the batches in it, by the latest manifest."""
        manifests = self._folder.names("manifests")
        if not manifests:
            return None, []
        found = json.loads(self._folder.read(f"manifests/{manifests[-1]}"))
        return found["table"], found["batches"]

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, documents, tokens) of all committed batches; groups that have come to nothing are left out.

        A committed batch whose delta is gone is an error.
        """
        table, folded = self._folded()
        open_ = sorted(set(self._folder.names("commits")) - set(folded))
        names = [*([table] if table else []), *(f"deltas/{x}" for x in open_)]
        if lost := [x for x in names if not self._folder.exists(x)]:
            raise FileNotFoundError(f"committed, but gone: {', '.join(lost)}")
        rows = self.spark.read.schema(DELTA).parquet(*[f"{self.path}/{x}" for x in names]) if names else self.spark.createDataFrame([], DELTA)
        return rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).where("documents <> 0 or tokens <> 0")

    def compact(self, name: str) -> None:
        """Fold the committed deltas into one table. The markers stay, so that their batches are still known.

        A run that is lost at any point changes no totals and can be repeated. No reader or writer may run meanwhile.
        """
        batches = self._folder.names("commits")
        table = f"folded/{name}-{uuid.uuid4().hex}"
        self.totals().write.parquet(f"{self.path}/{table}")
        last = self._folder.names("manifests")[-1:]
        written = f"staging/{uuid.uuid4().hex}"
        self._folder.write(written, json.dumps({"table": table, "batches": batches}))
        self._folder.move(written, f"manifests/{int(last[0]) + 1 if last else 0:012d}")
        for x in self._folder.names("folded"):
            if f"folded/{x}" != table:
                self._folder.drop(f"folded/{x}")
        for x in set(self._folder.names("deltas")) & set(batches):
            self._folder.drop(f"deltas/{x}")
