"""Whole results, availability by split, share texts, facts of findings, stored results."""

import json
import os
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from test_analyses import bookings

from tallyhouse.functions.columns import ratio_text, share, share_text
from tallyhouse.operators import findings, guest_mix, holidays, results, text_audit
from tallyhouse.operators.parsing import parse_csv, parse_json
from tallyhouse.sources.bookings import calendar


def test_share_texts(spark):
    """share_text rounds the double as a formatter does, ties to even; share is half up on the exact ratio."""
    pairs = [(a, b) for b in (0, 1, 3, 7, 16, 40, 80, 160, 200, 400, 2000) for a in range(0, min(b, 60) + 1)]
    df = spark.createDataFrame(pairs, "a bigint, b bigint")
    for r in df.select("a", "b", share_text(F.col("a"), F.col("b")).alias("s")).collect():
        assert r.s == (f"{r.a / r.b:.1%}" if r.b else "n/a")
    row = spark.range(1).select(share_text(F.lit(1), F.lit(16)).alias("even"), share(F.lit(1), F.lit(16)).alias("up"), ratio_text(F.lit(1), F.lit(16)).alias("r"), ratio_text(F.lit(None).cast("int"), F.lit(2)).alias("u")).first()
    assert tuple(row) == ("6.2%", "6.3%", "1 of 16 (6.2%)", "unknown of 2 (n/a)")


def test_documents_say_what_is_unavailable(spark):
    df = bookings(spark, {"lead_time": 3, "is_canceled": True, "stays_in_week_nights": 2, "stays_in_weekend_nights": 0, "country": "PT"})
    docs = {r.analysis: json.loads(r.doc) for r in results.documents(findings.figures(df, calendar(spark)), findings.part_status(df)).collect()}
    assert {a: d["status"] for a, d in docs.items()} == {"lead_time": "available", "cancellations": "available", "seasonality": "unavailable", "room_value": "available", "guest_mix": "available", "holidays": "unavailable"}
    assert docs["seasonality"]["reason"] == "No record holds a valid value in every required field: 'arrival_date'" and "groups" not in docs["seasonality"]
    gone = {x["split"]: x["reason"] for x in docs["lead_time"]["unavailable"]}
    assert gone["by_arrival_month"].endswith("'lead_time', 'arrival_date'") and set(gone) == {"by_arrival_month", "by_market_segment", "by_customer_type", "date_comparison"}
    assert {g["split"] for g in docs["lead_time"]["groups"]} == {"overall", "by_cancellation_status"}
    assert docs["room_value"]["unavailable"] == [{"split": "values", "status": "unavailable", "reason": "No record holds a valid value in every required field: 'price_per_night'"}]
    assert {g["split"] for g in docs["guest_mix"]["groups"]} == {"country"}


def test_typed_order_and_distinct_windows(spark):
    rows = [{"total_of_special_requests": n} for n in (10, 2, 2, 0)] + [{"is_repeated_guest": True}, {"is_repeated_guest": False}]
    df = bookings(spark, *rows)
    order = lambda a: [r.group_label for r in guest_mix.positions(df, a).orderBy("position").collect()]
    assert order("total_of_special_requests") == ["0", "2", "10"] and order("is_repeated_guest") == ["not_repeated", "repeated"]
    days = bookings(spark, *[{"arrival_date": date(2021, 6, d)} for d in (9, 10, 20)])
    table = holidays.daily(days, spark.createDataFrame([(date(2021, 6, 10), "x")], "date date, name string"), "arrival_date", False, (1,))
    same = lambda w: sorted(map(str, holidays.comparison(table, w).collect()))
    assert same((1, 1)) == same((1,))


@pytest.mark.parametrize(("text", "value"), [("27.311234", Decimal("27.311234")), ("27.3112345", None), ("1e-7", None), ("1.5e2", Decimal(150)), ("27.3100000", Decimal("27.31"))])
def test_prices_beyond_six_places_are_invalid(spark, text, value):
    row = parse_json(spark.createDataFrame([(f'{{"price_per_night":{text}}}',)], "line string")).first()
    assert (row.price_per_night, row.invalid_fields) == (value, [] if value is not None else ["price_per_night"])
    row = parse_csv(spark.createDataFrame([(text,)], "price_per_night string")).first()
    assert (row.price_per_night, row.invalid_fields) == (value, [] if value is not None else ["price_per_night"])


def test_lines_that_are_no_objects(spark):
    lines = ["", "  ", "[1]", "5", '"x"', "{", '{"lead_time":1} x', '{"lead_time":NaN}', "{'lead_time':1}", '{"lead_time":1,"lead_time":2}', "null", None]
    for r in parse_json(spark.createDataFrame([(x,) for x in lines], "line string")).collect():
        assert r.lead_time is None and "lead_time" in r.missing_fields and not r.invalid_fields
    good = parse_json(spark.createDataFrame([(' \t{"lead_time" : 4, "meal": {"a": 1}}\n',)], "line string")).first()
    assert (good.lead_time, good.meal, good.invalid_fields) == (4, None, ["meal"])


def test_append_takes_unreadable_times(spark, tmp_path):
    rows = [("r1", "2024-05-06T07:08:09Z", "completed"), ("r2", "unreadable", "completed"), ("r3", None, "completed_with_warnings"), ("r4", "2024-05-06T07:08:09Z", "failed")]
    df = spark.createDataFrame(rows, "result_id string, generated_at string, status string")
    for _ in range(2):  # an append that is tried again adds nothing
        results.append(df, f"{tmp_path}/history")
    got = sorted((r.result_id, str(r.run_date)) for r in spark.read.parquet(f"{tmp_path}/history").collect())
    assert got == [("r1", "2024-05-06"), ("r2", "None"), ("r3", "None")]
    results.append(spark.createDataFrame([("r3", None, "completed"), ("r5", None, "completed"), ("r5", None, "completed"), (None, None, "completed")], df.schema), f"{tmp_path}/history")
    assert sorted(str(r.result_id) for r in spark.read.parquet(f"{tmp_path}/history").collect()) == ["None", "r1", "r2", "r3", "r5"]


def test_the_latest_results_are_kept(spark, tmp_path):
    """Two runs and a retry: dates that stay whole are not written again, the one that the limit falls into is, older ones go."""
    path = f"{tmp_path}/history"
    rows = [(f"r{d}{h}", f"2024-05-0{d}T0{h}:00:00Z", "completed") for d in (1, 2, 3) for h in range(4)] + [("old", "unreadable", "completed")]
    schema = "result_id string, generated_at string, status string"
    results.prune(spark, path, 3)
    results.append(spark.createDataFrame(rows[:7], schema), path)
    results.append(spark.createDataFrame(rows[3:], schema), path)
    newest = {os.path.join(a, f) for a, _, fs in os.walk(f"{path}/run_date=2024-05-03") for f in fs}
    for limit, want in ((20, 13), (12, 12), (7, 7), (7, 7), (6, 6), (4, 4)):
        results.prune(spark, path, limit)
        held = sorted(r.result_id for r in spark.read.parquet(path).collect())
        assert held == sorted(r[0] for r in sorted(rows, key=lambda r: (r[1] != "unreadable", r[1]), reverse=True)[:want])
    assert newest == {os.path.join(a, f) for a, _, fs in os.walk(f"{path}/run_date=2024-05-03") for f in fs}
    results.prune(spark, path, 2)
    assert sorted(r.result_id for r in spark.read.parquet(path).collect()) == ["r32", "r33"]


def test_facts_of_findings(spark):
    data = {
        "findings": {"groups": [{"figure": {"numerator": 12, "denominator": 20}, "median_days": 7.5, "mean_lead_days": 4, "window_days": [1, 3], "rate": 0.6}], "total": 8.0, "label": 'says "numerator": 99', "baseline_days": 7, "records_used": True},
        "data_quality": {"record_count": 8538},
    }
    text = json.dumps(data)
    row = text_audit.facts(spark.createDataFrame([(text,), ("no json 5",)], "findings_text string")).collect()
    assert row[0].sizes == [1, 3, 7, 12, 20, 8538] and "7.5" in row[0].figures and "0.6" in row[0].figures and "8" in row[0].figures and "6" not in row[0].figures
    assert row[1].sizes == [] and row[1].figures == ["5"]


@pytest.mark.parametrize(("fenced", "fine"), [("```json\n{}\n```", True), ("```\n{}```", True), ("```JSON \t\r\n{}\r\n```", True), ("``` sql\n{}\n```", False), ("```json {}```", False), ("{}", True), ("```", False), ("```\n```", False)])
def test_fences(spark, fenced, fine):
    answer = {"executive_summary": "Shares are observed.", "improvement_suggestions": [{"suggestion": "It may help.", "evidence": "5 of 9, a small sample", "sample_size": 9}]}
    df = spark.createDataFrame([(1, fenced.replace("{}", json.dumps(answer)))], "answer_id int, answer_text string")
    assert text_audit.parse(df).first().structure == fine


def test_inputs_that_are_refused(spark, tmp_path):
    from tallyhouse.operators.parsing import InputError, read_csv_strictly, with_valid_records

    def code(text):
        (tmp_path / "in.csv").write_text(text)
        try:
            return read_csv_strictly(spark, f"file://{tmp_path}/in.csv").count()
        except InputError as e:
            return e.code

    assert code("booking_id;meal\n1;BB\n2;\n") == 2
    assert code("booking_id;meal\n1;BB;x\n") == "INPUT_INVALID_CSV" and code("booking_id;meal\n1\n") == "INPUT_INVALID_CSV"
    assert code("booking_id;meal\n") == "INPUT_EMPTY"
    with pytest.raises(InputError, match="INPUT_NOT_FOUND"):
        read_csv_strictly(spark, f"file://{tmp_path}/none.csv")
    lines = lambda *x: parse_json(spark.createDataFrame([(i,) for i in x], "line string"))
    assert with_valid_records(lines("nothing", '{"meal":"BB"}')).count() == 2
    with pytest.raises(InputError, match="NO_VALID_RECORDS"):
        with_valid_records(lines("nothing", '{"meal":5}', '{"zz":"BB"}'))
