"""Corpus cleaning as stages over documents: each stage works on what the one before has kept.

A stage takes (spark, docs, sf_dir), calls one operator and returns a DataFrame; all but the last return the columns of
documents. No stage samples, caps or cuts rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm import exact, packing, similar, substring, toxicity
from tallyhouse.llm.common import row_digest, settled, ship

THRESHOLD = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under THRESHOLD by a model of labelled rows. Null and empty texts are scored as empty and stay; without labels nothing is learned, and scores rest on the seed lexicon."""
    ship(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), usable=F.lit(True))
    return model.score(docs.select(F.struct("*").alias("row"))).where(F.col("score") < THRESHOLD).select("row.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of equal texts: the longest original, then the smallest doc_id. Null counts as empty."""
    ship(spark)
    return exact.first_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group linked by five-word shingle sets of Jaccard similarity 0.8 or more: the smallest doc_id.

    Rows without an id come before those with one. Texts without words are alike, null included. Rows repeated in full
    are one.
    """
    ship(spark)
    named = docs.select(F.struct("*").alias("row"), F.struct("doc_id", row_digest().alias("key")).alias("id"), "text")
    found = similar.near_duplicates(named.select("id", "text"), id_col="id", width=5, threshold=0.8)
    stays = found.where(F.col("doc_id") == F.col("component_id")).groupBy(F.col("doc_id.key").alias("key")).agg(F.count("*").alias("copies"))
    rows = named.select("row", F.col("id.key").alias("key")).join(stays, "key")
    return rows.where("copies = 1").select("row").unionByName(rows.where("copies > 1").dropDuplicates(["key"]).select("row")).select("row.*")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its text without the words of passages that occur elsewhere too; n_chars follows the text. Null text becomes empty."""
    ship(spark)
    others = [c for c in docs.columns if c != "text"]
    out = substring.remove_repeats(docs.select(F.struct(*others).alias("others"), "text"), id_col="others")
    known = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("bigint")}
    return out.select(*(known[c].alias(c) if c in known else F.col(f"doc_id.`{c}`") for c in docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and place. Empty and null texts are one piece of the end token."""
    ship(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact-dedup", drop_exact_copies),
    ("simhash-near-dedup", drop_near_copies),
    ("substring-dedup", cut_repeats),
    ("best-fit-packing", pack_sequences),
]

#: Neither the trained scores nor the tokenizer can be written as SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole documents table; each stage's rows are written before the next begins."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settled(spark, name, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
