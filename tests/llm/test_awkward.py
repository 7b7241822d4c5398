"""Clashing columns, long texts, empty tables, and quality on rows that were not learned from."""

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F
from test_rollup_and_chat import some_turns

from tallyhouse.llm import chat, packing, registry, toxicity
from tallyhouse.llm.registry import public_tokenizers

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_roles_of_unseen_transcripts(spark, tmp_path):
    """Learned on some conversations, roles of the others' lines are right for nine of ten; the query returns every transcript."""
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rough = chat.rough_transcripts(turns)
    model = chat.learn(rough.where("conv % 2 = 0"))
    told = rough.where("conv % 2 = 1")
    place = F.row_number().over(chat.Window.partitionBy("conv").orderBy("turn", "line_no", "line")) - 1
    truth = told.select("conv", place.alias("place"), "role")
    found = chat.parse(told.drop("role"), model).select("conv", "place", F.col("role").alias("found"))
    right, total = truth.join(found, ["conv", "place"]).agg(F.count_if(F.col("role") == F.col("found")), F.count("*")).first()
    assert total == told.count() and right / total > 0.9
    out = registry.op2_chat_transcripts(spark, "/root/testdata/sf0.01")
    assert out.select("conv_id").distinct().count() == turns.select("conv_id").distinct().count()


def test_chat_with_clashing_columns_and_empty_tables(spark):
    turns = some_turns(spark).limit(20).withColumns({"conv": F.lit(9), "line": F.lit("x"), "symbol": F.lit(1), "block": F.lit(2), "place": F.lit(3)})
    rough = chat.rough_transcripts(turns)
    parsed = chat.parse(rough, chat.learn(rough))
    assert parsed.count() == rough.count()
    none = chat.learn(rough.limit(0))
    assert chat.parse(rough, none).count() == rough.count() and chat.render(parsed.limit(0)).count() == 0
    assert chat.learn(rough.withColumn("role", F.lit(None).cast("string"))).start.shape == none.start.shape


def test_packing_with_clashing_columns(spark):
    rows = [(1, "a b c", 7, 8, "r", 5, 6), (1, "a b c", 7, 8, "r", 5, 6), (None, None, 7, 8, "r", 5, 6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, piece int, start int, row string, length int, part int")
    out = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=64).collect()
    assert sorted((r.doc_id or 0, r.piece, r.start) for r in out) == [(0, 0, 0), (1, 0, 0), (1, 0, 0)]


def test_scores_with_clashing_columns_and_long_texts(spark):
    rows = [(i, ("you idiot " if i % 4 == 0 else "fine words ") * (1 + i % 5), 0.5, 1, "s") for i in range(300)] + [(300, "fine words " * 200_000, 0.5, 1, "s"), (None, "you idiot", 0.5, 1, "s"), (4, rows_text := "you idiot", 0.5, 1, "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score double, toxic int, fold string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0), 0) for i in range(200)], "doc_id bigint, toxic int, fold int")
    out = toxicity.scores(docs, labels, F.lit(True)).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out) and rows_text
    scores = {r.doc_id: r.score for r in out}
    assert scores[248] > 0.7 > scores[300] and scores[None] > 0.7


@pytest.mark.parametrize("labels", [[], [(1, 0)]])
def test_pipeline_on_few_documents(spark, tmp_path, labels):
    rows = [(1, "one  two", "en", "s", 8), (2, "one two", "en", "s", 7), (3, None, None, None, None), (4, "", "en", "s", 0)]
    for i, own in enumerate(([], rows)):
        path = f"{tmp_path}/{i}"
        spark.createDataFrame(own, DOCS).write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(f"{path}/labels.parquet")
        out = cp.run(spark, path).collect()
        assert {r.doc_id for r in out} == ({1, 3} if own else set())
