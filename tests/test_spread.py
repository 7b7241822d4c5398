"""Costly work on each row is done once a row, and by as many tasks as a shuffle has."""

import pytest

from tallyhouse.operators import cube, parsing, text_audit
from tallyhouse.operators.figures import valid
from tallyhouse.sources import raw

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_filter_on_values_parses_a_line_once(spark):
    lines = spark.createDataFrame([(1, '{"lead_time":3,"is_canceled":true}'), (2, '{"lead_time":3}'), (3, "no"), (4, '{"lead_time":"x","is_canceled":true}')], "position int, line string")
    found = valid(parsing.parse_json(lines), "lead_time", "is_canceled").select("position")
    assert _plan(found).count("parseJson") + _plan(found).count("parse_json") == 1
    assert [r.position for r in found.collect()] == [1]


def test_lines_are_dealt_over_all_tasks(spark):
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for rows in (raw.json_lines(spark, SF), raw.booking_lines(spark, SF), raw.answers(spark, SF)):
        assert rows.rdd.getNumPartitions() == wanted


@pytest.mark.parametrize(("text", "words"), [
    ('{"findings":{"a":"it \\u0062ecause"}}', ["because"]),
    ('{"Due To":[["effect", "of"], {"x":"leads to"}]}', ["due to", "leads to"]),
    ('{"a":"drives"', []),
    ('{"a":"nothing"}', []),
    (None, []),
])
def test_words_of_findings(spark, text, words):
    found = text_audit.finding_words(spark.createDataFrame([(text,)], "findings_text string"))
    assert found.first().causal_words == words
    # the walk is in the plan once, not once a word
    assert _plan(found).count("schemaOfVariant") + _plan(found).count("schema_of_variant") <= 2


def _whole_plan(spark, df):
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        return _plan(df)
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")


def test_keys_of_a_booking_are_made_once(spark):
    plan = _whole_plan(spark, cube.measure(parsing.parse_json(raw.booking_lines(spark, SF))))
    assert "filter(array(" not in plan and plan.count("kind, arrival_month") == 1
