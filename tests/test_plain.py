"""A plain line is read by type, any other as a variant; both say the same of it."""

import pytest
from pyspark.sql import functions as F

from tallyhouse.operators import parsing
from tallyhouse.sources import raw

SF = "/root/testdata/sf0.001"
PLAIN = [
    "{}",
    '{"adults":1,"agent":"44","arrival_date":"1999-12-24","is_canceled":true,"lead_time":41,"meal":" BB ","price_per_night":174.61}',
    '{"price_per_night": 10.50, "meal": "", "adults": -1, "booking_date": "2021-02-30"}',
    '{"price_per_night":1e2,"adults":9223372036854775807}',
    '{"price_per_night":"19.0","agent":"x,{"}',
    '{"price_per_night":true,"is_canceled":false,"hotel":"é"}',
    '{"adults":-0,"price_per_night":0.1234567}',
]
OTHER = [
    '{"meal":5}', '{"meal":true}', '{"meal":null}', '{"meal":["a"]}', '{"meal":{}}', '{"meal":5,"zz":"b"}', '{"meal":5,"zz":"b","agent":6}', '{"agent":17,"zz":"a"}', '{"agent":-0}', '{"agent":12345678901234567890123}',
    '{"booking_date":5}', '{"lead_time":"12"}', '{"lead_time":2.0}', '{"lead_time":""}', '{"adults":9223372036854775808}', '{"is_canceled":1}', '{"is_canceled":"true"}', '{"is_canceled":2}',
    '{"meal":"a","meal":"b"}', '{"adults":1,"adults":2}', '{"meal":"a\\"b"}', '{"m\\u0065al":"a"}', '{"meal":":x"}', '{"meal" :"a"}', '{"meal"\t:5,"zz":"b"}', '{"meal":"a"} ', '{"meal":5} ""}', '{"meal":"a"}}', '{"meal":"a"} x}',
    "{'meal':'a'}", '{"price_per_night":NaN}', '{"adults":01}', '{"meal":"a",}', '{"meal":"a"', '{"_corrupt":"a"}', '{"Meal":"a"}', '{"zz":{"a":1,"a":2},"adults":1}', '{"adults":1,"meal":x}', '[{"adults":1}]', "x", "", " ", None,
]


@pytest.fixture
def as_variants(monkeypatch):
    """parse_json() without the read by type."""

    def parse(lines):
        with monkeypatch.context() as m:
            m.setattr(parsing, "_is_plain", lambda line, plain: F.lit(False))
            return parsing.parse_json(lines, with_issue=True)

    return parse


def test_which_lines_are_plain(spark):
    lines = spark.createDataFrame([(x,) for x in PLAIN + OTHER], "line string")
    rows = lines.withColumn("plain", parsing._plain(F.col("line")))
    assert [r.line for r in rows.where(parsing._is_plain(F.col("line"), F.col("plain"))).collect()] == PLAIN


def test_both_reads_say_the_same(spark, as_variants):
    lines = spark.createDataFrame(list(enumerate(PLAIN + OTHER)), "position int, line string")
    found, wanted = parsing.parse_json(lines, with_issue=True), as_variants(lines)
    assert found.schema == wanted.schema and found.orderBy("position").collect() == wanted.orderBy("position").collect()


def test_both_reads_say_the_same_of_tables(spark, as_variants):
    for lines in (raw.booking_lines(spark, SF), raw.json_lines(spark, SF)):
        found, wanted = parsing.parse_json(lines, with_issue=True), as_variants(lines)
        assert found.orderBy("position").collect() == wanted.orderBy("position").collect()


def test_most_bookings_are_plain(spark):
    rows = raw.booking_lines(spark, SF).withColumn("plain", parsing._plain(F.col("line")))
    plain, all_ = rows.agg(F.count_if(parsing._is_plain(F.col("line"), F.col("plain"))), F.count("*")).first()
    assert plain > 0.8 * all_
