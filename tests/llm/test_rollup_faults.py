"""Rollups under lost runs, missing deltas, empty tables and clashing columns."""

import public_tokenizers
import pytest

from tallyhouse.llm import rollup

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def frame(spark, rows):
    return spark.createDataFrame(rows, "source string, lang string, tokenizer string, n_tokens bigint")


def totals(r):
    return {(x.source, x.lang, x.tokenizer): (x.documents, x.tokens) for x in r.totals().collect()}


def filled(spark):
    r = rollup.TokenRollup(spark)
    r.commit("b1", rollup.inserts(frame(spark, [("a", "en", "v1", 5), ("b", None, "v1", 3)])))
    r.commit("b2", rollup.deletes(frame(spark, [("b", None, "v1", 3)])))
    return r


@pytest.mark.parametrize("step", ["write", "move", "drop"])
def test_a_lost_compaction_loses_no_totals(spark, monkeypatch, step):
    r, want = filled(spark), {("a", "en", "v1"): (1, 5)}
    for turn in range(2):
        with monkeypatch.context() as m:
            m.setattr(r._folder, step, lambda *a: (_ for _ in ()).throw(OSError("lost")))
            with pytest.raises(OSError):
                r.compact("folded")
        again = rollup.TokenRollup(spark, r.path)
        assert totals(again) == want and not again.commit("b1", rollup.inserts(frame(spark, [("a", "en", "v1", 5)])))
        again.compact("folded")
        assert totals(again) == want
        again.commit(f"more{turn}", rollup.inserts(frame(spark, [("a", "en", "v1", 1)])))
        want = {("a", "en", "v1"): (2 + turn, 6 + turn)}
        assert totals(again) == want


def test_a_missing_delta_is_an_error(spark):
    r = filled(spark)
    r._folder.drop("deltas/b2")
    with pytest.raises(FileNotFoundError, match="b2"):
        r.totals()


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "one two", "en", "s", "k", 9, "t"), (1, None, None, None, "k", 9, "t")], "doc_id bigint, text string, lang string, source string, key string, n_tokens int, tokenizer string")
    counts = lambda d: rollup.token_counts(d, {"v": RANKS}, public_tokenizers.PATTERN)
    got = {(x.source, x.lang, x.tokenizer, x.n_tokens) for x in counts(docs).collect()}
    assert got == {("s", "en", "v", 2), (None, None, "v", 0)}
    r = rollup.TokenRollup(spark)
    assert r.commit("none", rollup.inserts(counts(docs.limit(0)))) and totals(r) == {}
    r.compact("folded")
    assert totals(r) == {}
