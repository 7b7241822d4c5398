"""Rules of the audit on small answers and findings."""

import json

import pytest
from pyspark.sql import functions as F

from tallyhouse.operators import text_audit

DATA = {
    "findings": {
        "records_used": 8538,
        "overall": {"group": "all", "numerator": 1691, "denominator": 8538},
        "windows_days": [1, 3, [7]],
        "median_days": 17,
        "mean_days": 4,
        "days_left_out_unavailable_years": 2,
        "holiday_days": {"events": {"numerator": 77, "denominator": 88}},
        "small_days": 2.0,
        "flag": {"numerator": True},
        "total": "91467.27",
        "share": 35.50,
        "tiny": 0.1234567,
    },
    "data_quality": {"record_count": 9000, "zero_price_count": 91},
}


def answer(summary="Shares are observed.", suggestion="Consider testing a deposit.", evidence="1691 of 8538", size=8538):
    return json.dumps({"executive_summary": summary, "improvement_suggestions": [{"suggestion": suggestion, "evidence": evidence, "sample_size": size}]})


def verdicts(spark, *answers, data=DATA, minimum=30):
    rows = spark.createDataFrame([(i, a, json.dumps(data)) for i, a in enumerate(answers)], "answer_id int, answer_text string, findings_text string")
    checked = text_audit.check(text_audit.parse(text_audit.facts(rows)), minimum)
    return [r.first_failed_rule for r in text_audit.verdict(checked).orderBy("answer_id").collect()]


def test_sizes_follow_the_structure(spark):
    other = {"findings": {"holidays": {"holiday_days": {"events": {"numerator": 77, "denominator": 88}}, "x_days": [[4, 5]]}}, "data_quality": {"record_count": 9}}
    rows = spark.createDataFrame([(json.dumps(DATA),), (json.dumps(other),), ("[]",), (None,)], "findings_text string")
    assert [r.sizes for r in text_audit.facts(rows).collect()] == [[1, 3, 7, 1691, 8538, 9000], [4, 5, 9], [], []]
    sizes = (8538, 1691, 1, 3, 7, 9000, 17, 2, 91, 77, 88, 4)
    assert verdicts(spark, *(answer(size=n) for n in sizes), minimum=1) == [None] * 6 + ["sample_size"] * 6


@pytest.mark.parametrize(
    ("text", "fine"),
    [
        ("About 35.5% of all.", True), ("About 35.50 percent.", True), ("035.5%", True), ("0.1234567%", True), ("0.123457%", False), ("0.12345670000000000000000000000000001%", False),
        ("12.5 %", False), ("1,691%", True), ("1,69%", False), ("12345,1691%", True), ("12345,691%", False), ("total of $91,467.27", True), ("$ 91467.3", False), ("91467.27€", True), ("USD 91,467.27", True), ("USD91,467.28", True),
        ("5USD", True), ("5 USD", False), ("5 USDX", True), ("usd 5", True), ("EUR 8538 and 5 eur", True), ("A count of 5 or 6,000 bookings.", True), ("99PERCENT", False), ("3% and 6%", False), ("-17%", True),
    ],
)
def test_amounts_must_be_in_the_findings(spark, text, fine):
    """Amounts are what stands beside a sign, by their one way of writing; codes are words in capitals."""
    text = text.replace("USD91,467.28", "xUSD 91,467.28")
    assert verdicts(spark, answer(summary=text)) == [None if fine else "figures"]


@pytest.mark.parametrize("word", ["guaranteed", "Guaranteeing", "ensures", "will  increase", "WILL\ngrow", "will boosted", "predictions", "forecasts", "x-certainly"])
def test_promises_with_any_ending(spark, word):
    assert verdicts(spark, answer(summary=f"It {word} here.")) == ["promise"]


def test_no_promises(spark):
    fine = ["It unensured.", "It will, increase.", "It will not grow.", "free will increases? no: freewill increase"]
    assert verdicts(spark, *(answer(summary=t) for t in fine)) == [None, None, None, "promise"]


def test_hedges_are_whole_words(spark):
    texts = ["It may help.", "MIGHT it?", "suggests", "Maybe it helps.", "consider  testing", "Consider testing.", "mayé", "could_not"]
    assert verdicts(spark, *(answer(suggestion=t) for t in texts)) == [None, None, None, "hypothesis", "hypothesis", None, "hypothesis", "hypothesis"]


def test_causal_words_anywhere_in_findings(spark):
    texts = [json.dumps(x) for x in ({"a": {"BECAUSE": 1}}, {"a": ["it drives", 5]}, {"a": "fine"}, {"a": 'say "due to"'})] + ["no json because"]
    df = spark.createDataFrame([(t,) for t in texts], "findings_text string")
    assert [r.causal_words for r in text_audit.finding_words(df).collect()] == [["because"], ["drives"], [], ["due to"], []]


@pytest.mark.parametrize(("number", "one"), [("1,234.50", "1234.5"), ("007", "7"), ("0.0", "0"), ("0", "0"), ("10", "10"), ("100.00", "100"), ("1" * 50 + ".10", "1" * 50 + ".1")])
def test_one_way_of_writing(spark, number, one):
    assert spark.range(1).select(text_audit.canonical(F.lit(number))).first()[0] == one
