"""Exact deduplication over batches: retries, collisions, hot groups, locators, awkward ids and columns."""

import pytest
from pyspark.sql import functions as F

from tallyhouse.llm import common, exact

SCHEMA = "doc_id bigint, text string"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def seen(df):
    return {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in df.collect()}


def test_a_repeated_batch_counts_once(spark):
    state, docs = exact.DigestState(spark), table(spark, [(1, "a b"), (2, "ab")])
    for _ in range(3):
        assert seen(exact.deduplicate(docs, state=state, batch="first")) == {(1, 1, 2, True), (2, 1, 2, False)}
    assert {(r.keep_id, r.copies) for r in state.groups().collect()} == {(1, 2)}


@pytest.mark.parametrize("lost", ["_run", "_check"])
def test_a_lost_run_is_repeated(spark, monkeypatch, lost):
    state, docs = exact.DigestState(spark), table(spark, [(1, "a b"), (2, "ab"), (3, "c")])
    with monkeypatch.context() as m:
        m.setattr(state, lost, lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            state.ingest(docs, batch="b")
    again = exact.DigestState(spark, state.path)
    assert seen(exact.deduplicate(docs, state=again, batch="b")) == {(1, 1, 2, True), (2, 1, 2, False), (3, 3, 1, True)}


def test_results_are_of_the_given_rows_over_all_batches(spark):
    state = exact.DigestState(spark)
    state.ingest(table(spark, [(5, "a b"), (6, "c")]))
    assert seen(exact.deduplicate(table(spark, [(4, "ab"), (7, "a  b"), (None, "c")]), state=state)) == {(4, 7, 3, False), (7, 7, 3, True), (None, 6, 2, False)}


def test_collisions_across_batches(spark, monkeypatch):
    """With a digest that always collides, texts of earlier batches are found by their locators and told apart by bytes."""
    monkeypatch.setattr(exact, "_digest", lambda norm: F.unhex(F.lit("00")))
    state = exact.DigestState(spark)
    assert seen(exact.deduplicate(table(spark, [(1, "b")]), state=state)) == {(1, 1, 1, True)}
    assert seen(exact.deduplicate(table(spark, [(2, "aaaa"), (3, "a aaa")]), state=state)) == {(2, 3, 2, False), (3, 3, 2, True)}
    assert seen(exact.deduplicate(table(spark, [(4, "b"), (0, "aaaa"), (9, "c")]), state=state)) == {(4, 1, 2, False), (0, 3, 3, False), (9, 9, 1, True)}


def test_locators_find_contents(spark):
    state = exact.DigestState(spark)
    state.ingest(table(spark, [(1, "long  one"), (2, "two")]), batch="x")
    out = exact.deduplicate(table(spark, [(3, "longone")]), state=state, batch="y")
    pointers = out.select("digest", F.col("keep_batch").alias("batch"), F.col("keep_row").alias("row"))
    assert [(r.batch, r.norm) for r in state.found(pointers).collect()] == [("x", "longone")]


def test_awkward_ids_and_columns(spark):
    least = -(2**63)
    rows = [(least, "x", 1, "q", "w"), (0, "x", 2, "q", "w"), (None, " x", 3, None, "w"), (None, None, 4, None, "w"), (5, "", 5, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, row int, digest string, best string")
    assert seen(exact.deduplicate(docs)) == {(least, None, 3, False), (0, None, 3, False), (None, None, 3, True), (None, 5, 2, False), (5, 5, 2, True)}
    stay = exact.first_copies(docs)
    assert stay.columns == docs.columns and {r.row for r in stay.collect()} == {3, 5}
    assert exact.first_copies(docs.limit(0)).collect() == []


def test_one_group_of_most_rows(spark, monkeypatch):
    """A hot group is broadcast by its digest and compared in salted parts."""
    monkeypatch.setattr(exact, "SALT_ROWS", 16)
    monkeypatch.setattr(common, "HOT_COPIES", 100)
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("same text")).otherwise(F.concat(F.lit("t"), (F.col("id") % 60).cast("string"))).alias("text"))
    got = {(r.keep_id, r.group_size, r["count"]) for r in exact.deduplicate(docs).groupBy("keep_id", "group_size").count().collect()}
    assert got == {(1, 200, 200)} | {(i, 5, 5) for i in range(0, 60, 3)}


def test_very_long_text(spark):
    docs = table(spark, [(1, "ab " * 400_000), (2, "ab" * 400_000), (3, "ab" * 399_999)])
    assert seen(exact.deduplicate(docs)) == {(1, 1, 2, True), (2, 1, 2, False), (3, 3, 1, True)}
