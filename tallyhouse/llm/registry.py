"""The operators' queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm import bpe, chat, exact, fim, forest, mixing, oracles, packing, resample, rollup, simhash, substring, toxicity, warc
from tallyhouse.llm.common import SPACE_CLASS, fresh_path, ship, staged


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches, the first of them given twice: all documents come; copies of a text that came with a
    smaller id go; and every count left is revised by one, for the separator that training puts after a document."""
    docs = _table(spark, sf_dir, "documents")
    versions = {x: public_tokenizers.path(f"{x}.tiktoken") for x in ("byte_bpe_50k", "byte_bpe_multi_50k")}
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("source", "lang", "text", F.struct("doc_id", F.sha2(text, 256).alias("digest")).alias("id"))
    counts = staged(rollup.token_counts(keyed, versions, public_tokenizers.PATTERN, id_col="id"), "counts").select("key.doc_id", "key.digest", *rollup.KEYS, "n_tokens")
    first = F.min(F.struct("doc_id", "source", "lang", "n_tokens")).alias("first")
    left = staged(counts.groupBy("digest", "tokenizer").agg(first).select("first.source", "first.lang", "tokenizer", "first.n_tokens"), "left")
    totals = rollup.TokenRollup(spark)
    for _ in range(2):
        totals.commit("come", rollup.inserts(counts.select(*rollup.KEYS, "n_tokens")))
    totals.commit("copies-go", rollup.revisions(counts.select(*rollup.KEYS, "n_tokens"), left.select(*rollup.KEYS, "n_tokens")))
    totals.commit("with-separator", rollup.revisions(left, left.withColumn("n_tokens", F.col("n_tokens") + 1)))
    return totals.totals()


def op2_chat_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical turns of all conversations, from transcripts whose roles are hidden behind markers and line forms."""
    rough = staged(chat.rough_transcripts(_table(spark, sf_dir, "conversations")), "rough")
    parsed = staged(chat.parse(rough.drop("role"), chat.learn(rough)), "parsed")
    return chat.render(parsed).select(F.col("conv").alias("conv_id"), "place", "role", "begins", "text")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each piece of every document lies in sequences of at most 2,048 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the windows of 35 words that start anywhere else too."""
    out = substring.remove_repeats(_table(spark, sf_dir, "documents"), width=35)
    words = F.trim(F.regexp_replace("kept_text", f"{SPACE_CLASS}+", " "))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(words, 256).alias("kept_sha256"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row that stays for every document, of those that are equal without white space."""
    out = exact.deduplicate(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document, learned from labels of rows that are not held out."""
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3, F.lit(0))  # a row without an id is not held out, nor labelled
    out = toxicity.scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), usable=fold != 1)
    return out.select("doc_id", (fold == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and the component of fingerprints within two bits."""
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"), width=3, max_bits=2, seed=42)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for each query among all rows."""
    vectors = _table(spark, sf_dir, "embeddings")
    return forest.search(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document, and the text that they give back, as digests."""
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    decoded = bpe.decode(bpe.encode(_table(spark, sf_dir, "documents"), ranks, pattern), ranks, pattern)
    written = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return decoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(written, 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a record, read back from the written bundles."""
    archives = warc.write_bundles(warc.records(_table(spark, sf_dir, "pages")), fresh_path(spark, "warc"))
    return warc.read_bundles(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in its fill-in-middle form, and the text that its output and form give back."""
    out = fim.transform(_table(spark, sf_dir, "documents"), seed=1, plain_from=90, spm_below=20).withColumn("output_sha256", F.sha2("output", 256))
    restored = fim.restore(out)
    return restored.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", F.sha2("restored", 256).alias("restored_sha256"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn towards the benchmark's texts."""
    out = resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), percent=25, least_words=20, longest=2, buckets=10_000, seed=7)
    return out.drop("n_words")


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to weights of their sources."""
    return mixing.mix(_table(spark, sf_dir, "documents"), weights=(5.0, 2.0, 1.0), share=1.5, most=2.0, seed=13).select("doc_id", "size", "source_size", "target", "taken")


def _shipped(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: _shipped(f) for k, f in globals().items() if k.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in oracles.SQL.items() if k in queries()}
