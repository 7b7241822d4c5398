"""Result documents of small inputs, and what is shown of stored ones."""

import hashlib
import json
from datetime import date
from decimal import Decimal

import pytest
from test_analyses import bookings
from test_findings import leaves

from tallyhouse.operators import cube, parsing, report, stored
from tallyhouse.operators.findings import ANALYSES
from tallyhouse.plans import stored as plans
from tallyhouse.sources import raw

RUNS = "run string, result_id string, generated_at string, source string, reference string, content_sha256 string"


def calendar(spark, *days):
    return spark.createDataFrame([(d, "x") for d in days], "date date, name string")


def documents(spark, frame, days=(), minimum=30, run=None, names=("",), **more):
    runs = spark.createDataFrame([(n, f"r{n}", "2024-01-01T00:00:00.000Z", "json", "in.json", "00") for n in names], RUNS)
    out = report.documents(frame, calendar(spark, *days), runs, run, minimum=minimum, **more).collect()
    return {r.run: json.loads(r.document) for r in out}


def fig(group, n, d, small=True):
    return {"group": group, "numerator": n, "denominator": d, "small_sample": small}


LEAD = [{"lead_time": n, "is_canceled": i % 2 == 1, "arrival_date": date(2021, 3, 8 + i)} for i, n in enumerate((7, 8, 30, 31, 90, 91, 180, 181))] + [{"is_canceled": True}, {"lead_time": 2, "booking_date": date(2021, 3, 1), "arrival_date": date(2021, 3, 4)}]
YEARS = [{"arrival_date": date(2021, 6, 9)}, {"arrival_date": date(2021, 6, 10)}, {"arrival_date": date(2022, 1, 2)}]
SEASONS = ((date(2021, 3, 8), "20", True), (date(2021, 4, 1), "30.5", False), (date(2021, 4, 30), "19.0", False), (date(2021, 6, 15), "27.31", None))


@pytest.fixture(scope="module")
def made(spark):
    """Documents of several small inputs, made side by side."""
    inputs = {"lead": LEAD, "years": YEARS, "no holidays": [{"booking_date": date(2022, 1, 2)}], "seasons": [{"booking_date": d, "price_per_night": Decimal(p), "is_canceled": c} for d, p, c in SEASONS]}
    frame = bookings(spark, *[r | {"agent": name} for name, rows in inputs.items() for r in rows])
    return documents(spark, frame, [date(2021, 6, 10)], run=frame["agent"], names=tuple(inputs))


def test_lead_times_and_cancellations(made):
    doc = made["lead"]
    lead = doc["analyses"]["lead_time"]["findings"]
    assert lead["records_used"] == 9 and lead["overall"]["figure"] == fig("all", 9, 9) and lead["overall"]["median_days"] == 31
    assert [b["numerator"] for b in lead["overall"]["bands"]] == [2, 2, 2, 2, 1] and lead["overall"]["bands"][0] == fig("0-7", 2, 9)
    by = {g["figure"]["group"]: g["median_days"] for g in lead["splits"]["by_cancellation_status"]["groups"]}
    assert by == {"canceled": 61, "not_canceled": 60}
    (month,) = lead["splits"]["by_arrival_month"]["groups"]
    assert month["partial_period"] is True and month["summary"] == "The median lead time was 31 days across 9 records; this describes the observed distribution."
    assert lead["splits"]["by_market_segment"] == {"status": "unavailable", "reason": "No record holds a valid value in every required field: 'lead_time', 'market_segment'"}
    assert lead["date_comparison"]["figure"] == fig("differs_from_supplied", 1, 1)
    cancel = doc["analyses"]["cancellations"]["findings"]
    assert cancel["overall"] == fig("all", 5, 9) and cancel["splits"]["by_lead_time_band"]["records_left_out"] == 1
    assert [g["figure"]["group"] for g in cancel["splits"]["by_lead_time_band"]["groups"]] == ["0-7", "8-30", "31-90", "91-180", "181+"]
    assert cancel["splits"]["by_arrival_month"]["groups"][0]["partial_period"] is True and cancel["splits"]["by_deposit_type"]["status"] == "unavailable"
    assert doc["analyses"]["room_value"]["status"] == "unavailable" and doc["analyses"]["room_value"]["findings"] == {}
    assert doc["status"] == "completed_with_warnings" and [n["code"] for n in doc["notices"]] == ["ESTIMATE_NOT_REVENUE"]
    assert doc["data_quality"]["record_count"] == 10 and doc["data_quality"]["missing_counts"]["booking_date"] == 9 and doc["data_quality"]["invalid_counts"]["lead_time"] == 0


def test_holiday_sides(spark, made):
    arrivals = [(1, False), (2, False), (9, False), (9, True), (9, False), (10, False), (16, False), (16, False), (16, False), (20, False)]
    frame = bookings(spark, *[{"arrival_date": date(2021, 6, d), "is_canceled": c, "booking_date": date(2022, 1, 2)} for d, c in arrivals])
    found = documents(spark, frame, [date(2021, 6, 10)], windows=(1, 3))[""]["analyses"]["holidays"]["findings"]
    side = found["arrival_date"]
    assert side["holiday_days"]["group"]["figure"] == fig("holiday", 1, 1) and side["holiday_days"]["window_days"] is None
    before = {w["window_days"]: w for w in side["windows"] if w["day_kind"] == "before"}
    assert before[1]["group"]["figure"] == fig("before_1_days", 3, 1) and before[1]["baseline_same_weekdays"]["figure"] == fig("baseline_same_weekdays", 4, 2)
    assert before[3]["group"]["mean_per_day"] == 1.0 and before[3]["baseline_same_weekdays"]["figure"] == fig("baseline_same_weekdays", 5, 5)
    assert before[1]["by_weekday"][0]["weekday"] == "Wednesday" and before[1]["group"]["cancellation_share"] == fig("cancellation_share", 1, 3)
    assert before[1]["statement"] == "No comparison is stated in the 1-day window before holidays; a group is a small sample."
    assert side["baseline"]["figure"] == fig("baseline", 6, 13) and side["span"] == {"first": "2021-06-01", "last": "2021-06-20"}
    assert found["booking_date"] == {"status": "unavailable", "reason": "The holiday calendar has no data for any year in 'booking_date': 2022"}
    doc = made["no holidays"]["analyses"]["holidays"]
    assert doc["status"] == "unavailable" and doc["reason"] == "No date field could be analyzed against the holiday calendar." and doc["findings"]["windows_days"] == [1, 3, 7]


def test_years_without_data(made):
    side = made["years"]["analyses"]["holidays"]["findings"]["arrival_date"]
    assert (side["records_used"], side["records_left_out_unavailable_years"], side["days_left_out_unavailable_years"], side["years_used"]) == (2, 1, 2, [2021])
    assert side["years_unavailable"] == [{"year": 2022, "status": "unavailable", "reason": "The holiday calendar has no data for 2022."}]


def test_seasons(made):
    found = made["seasons"]["analyses"]["seasonality"]["findings"]
    april = found["bookings"]["monthly"]["periods"][1]
    assert april == {"figure": fig("2021-04", 2, 4), "partial_period": False, "cancellation": fig("cancellation_share", 0, 2), "mean_price_per_night": {"value": "24.75", "count": 2, "small_sample": True}}
    assert found["bookings"]["monthly"]["periods"][2]["cancellation"] == {"status": "unavailable", "reason": "No record in the group holds a valid 'is_canceled'."}
    assert found["bookings"]["incomplete_years"] == [{"year": 2021, "months_present": 3}] and found["bookings"]["unavailable_parts"] == {}
    assert found["bookings"]["summary"].startswith("4 bookings were observed from 2021-03-08 to 2021-06-15, in 3 months and 4 ISO weeks; 3 of these periods are partial.")
    assert found["arrivals"]["reason"].endswith("'arrival_date'")


def test_stays_values_and_guests(spark):
    stays = ((1, 1, "19.0", False), (0, 1, "27.31", True), (2, 3, "10.5", False), (0, 0, "50", False), (4, 4, "0", True), (1, 2, "20", False), (1, 1, None, True))
    rows = [{"stays_in_weekend_nights": a, "stays_in_week_nights": b, "price_per_night": p and Decimal(p), "is_canceled": c, "total_of_special_requests": n, "is_repeated_guest": n == 2} for (a, b, p, c), n in zip(stays, (10, 2, 2, 0, 1, 1, 1), strict=True)]
    found = documents(spark, bookings(spark, *rows), minimum=2)[""]["analyses"]
    value = found["room_value"]["findings"]
    assert value["zero_night_records"] == 1 and value["length_of_stay"]["total_nights"] == 21 and [b["numerator"] for b in value["length_of_stay"]["buckets"]] == [1, 2, 1, 1, 1]
    groups = {g["cancellation_status"]: (g["count"], g["total"], g["mean"], g["zero_price_records"]) for g in value["estimated_value"]["groups"]}
    assert groups == {"cancelled": (2, "27.31", "13.655", 1), "not cancelled": (3, "150.5", "50.1667", 0)}
    assert (value["estimated_value"]["records_without_price"], value["estimated_value"]["records_used"]) == (1, 5)
    mix = found["guest_mix"]["findings"]["distributions"]
    assert [g["figure"]["group"] for g in mix["total_of_special_requests"]["groups"]] == ["0", "1", "2", "10"]
    assert [g["figure"]["group"] for g in mix["is_repeated_guest"]["groups"]] == ["not_repeated", "repeated"]
    assert mix["total_of_special_requests"]["groups"][0]["comparison"] == {"status": "omitted_small_sample", "statement": "No comparison is stated for group '0'; it is a small sample of 1 records."}
    assert mix["total_of_special_requests"]["groups"][2]["comparison"]["mean_length_of_stay"] == {"value": "3", "count": 2, "small_sample": False}
    assert mix["country"]["status"] == "unavailable"


def test_runs_side_by_side(spark):
    """A run's document is the same alone and beside others; records without a run have none."""
    rows = [{"hotel": h, "lead_time": n, "is_canceled": n % 2 == 0, "arrival_date": date(2021, 6, 1 + n % 20), "booking_id": str(n // 2)} for n in range(40) for h in ("a", "b")[: 1 + n % 2]] + [{"lead_time": 5}]
    frame = bookings(spark, *rows)
    both = documents(spark, frame, [date(2021, 6, 10)], run=frame["hotel"], names=("a", "b"))
    assert set(both) == {"a", "b"} and both["a"]["data_quality"]["duplicate_booking_id_count"] == 20
    alone = documents(spark, frame.where(frame["hotel"] == "b"), [date(2021, 6, 10)], run=frame["hotel"], names=("b",))
    assert alone == {"b": both["b"]}


def test_one_run_over_a_file(spark, tmp_path):
    lines = ['{"booking_id":12345678901234567890123,"lead_time":3,"zz":1}', "", '{"booking_id":1.5,"lead_time":"x","is_canceled":1}']
    path = tmp_path / "in.json"
    path.write_text("\n".join(lines))
    doc = json.loads(report.of_file(spark, f"file://{path}", calendar(spark), "r1", "2024-01-01T00:00:00.000Z").first().document)
    assert doc["input"] == {"source": "json", "reference": "in.json", "record_count": 2, "content_sha256": hashlib.sha256(path.read_bytes()).hexdigest()}
    quality = doc["data_quality"]
    assert quality["unknown_fields"] == ["zz"] and quality["invalid_counts"]["booking_id"] == 1 and quality["invalid_counts"]["lead_time"] == 1 and quality["missing_counts"]["meal"] == 2
    assert doc["status"] == "completed_with_warnings" and doc["analyses"]["cancellations"]["findings"]["overall"] == fig("all", 1, 1)
    clean = tmp_path / "clean.json"
    fields = {"lead_time": 3, "is_canceled": False, "booking_date": "2021-06-01", "arrival_date": "2021-06-04", "stays_in_weekend_nights": 1, "stays_in_week_nights": 1, "country": "PT"}
    clean.write_text(json.dumps(fields))
    of = lambda *notices: report.of_file(spark, f"file://{clean}", calendar(spark, date(2021, 6, 2)), "r", "t", notices=notices).select("status").first().status
    assert of(("OTHER", "m")) == "completed" and of(("CONFIG_UNKNOWN_KEYS", "m")) == "completed_with_warnings"


@pytest.mark.parametrize(("text", "code"), [("{}\nnot json", "INPUT_INVALID_JSON"), ("[1]\n{}", "RECORD_NOT_OBJECT"), ("\n  \n", "INPUT_EMPTY"), ('{"zz":1}\n{"meal":5}', "NO_VALID_RECORDS")])
def test_inputs_refused_by_the_pass_that_loads_them(spark, tmp_path, text, code):
    (tmp_path / "in").write_text(text)
    with pytest.raises(parsing.InputError) as e:
        parsing.load(parsing.read_json_lines(spark, f"file://{tmp_path}/in"))
    assert e.value.code == code


@pytest.mark.parametrize(("value", "read"), [("12345678901234567890123", "12345678901234567890123"), ("-5", "-5"), ("9" * 60, "9" * 60), ("12345678901234567890123.0", None), ("1e30", None), ("2.0", None), ('" 7 "', "7"), ("true", None)])
def test_identifiers_of_any_size(spark, value, read):
    row = parsing.parse_json(spark.createDataFrame([(f'{{"agent":{value}}}',)], "line string")).first()
    assert (row.agent, row.invalid_fields) == (read, [] if read else ["agent"])


def test_bookings_are_read_for_the_cube_and_their_ids(spark):
    frame = raw.table_of(bookings(spark, {"lead_time": 3, "booking_id": "1"}, {"lead_time": 4}), "bookings")
    path = frame.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:").lstrip("/")
    runs = spark.createDataFrame([("", "r", "t", "s", "f", "00")], RUNS)
    assert leaves(cube.measure(frame), path) == 1 and leaves(report.documents(frame, calendar(spark), runs), path) == 1


def test_misshapen_results(spark):
    """No part of any form stops a view; whole numbers, strings and flags must be such."""
    good = {"figure": {"group": "g", "numerator": 1, "denominator": 3, "small_sample": True}, "median_days": 60.5, "bands": [{"numerator": 1}, 5, {"x": 1}], "partial_period": "true"}
    bad = [{}, 5, {"figure": []}, {"figure": {"numerator": "1", "denominator": True, "group": 7, "small_sample": 1}}]
    found = {"lead_time": {"findings": {"overall": 5, "splits": {"a": {"groups": [good, *bad]}, "b": {"status": "unavailable"}, "c": 7}}}, "seasonality": {"findings": {"bookings": {"monthly": {"periods": [good, 4]}, "span": 5, "incomplete_years": [4, {"year": 1}]}}}, "guest_mix": {"status": "unavailable", "reason": "why"}, "holidays": 5, "room_value": {"findings": {"estimated_value": {"groups": [good]}, "length_of_stay": {"buckets": [good["figure"], good]}}}}
    docs = [json.dumps({"analyses": found, "data_quality": {"missing_counts": {"a": 1, "b": "2"}, "invalid_counts": {"c": 3}, "unknown_fields": ["u", 5]}, "notices": 4}), "5", "[]", "no json", None, "{}"]
    df = spark.createDataFrame(list(enumerate(docs)), "result_id int, document string")
    lead = stored.lead_time(df).collect()
    assert [(r.split, r.group_label, r.records, r.of, r.share, r.small_sample, r.median_days, r.partial_period) for r in lead] == [("a", "g", 1, 3, "33.3%", True, "60.5", False), ("a", "", None, None, "n/a", False, None, False)]
    assert [(r.band, r.records, r.of) for r in stored.lead_time_bands(df).collect()] == [("", 1, None)]
    assert stored.unavailable_parts(df, "lead_time").collect()[0][1:] == ("b", "No reason was recorded.")
    assert [(r.period, r.cancelled, r.mean_price) for r in stored.seasonality(df).collect()] == [("g", "n/a", "n/a")]
    assert sorted(r.line for r in stored.seasonality_lines(df).collect()) == ["Observed dates: n/a to n/a", "Year 1 is incomplete: unknown months present.", "Year unknown is incomplete: unknown months present."]
    assert [(r.cancellation_status, r.total, r.bookings, r.of) for r in stored.room_value(df).collect()] == [("g", "n/a", None, 3)] and stored.stay_lengths(df).count() == 2
    assert {(r.field, r.missing, r.invalid) for r in stored.quality_fields(df).collect()} == {("a", 1, 0), ("b", 0, 0), ("c", 0, 3)}
    assert {r.unknown_fields for r in stored.quality_headlines(df).collect()} == {"u", "none"} and [r.remark for r in stored.quality_remarks(df).collect()] == ["guest_mix: why"]
    for empty in (stored.holidays, stored.holiday_weekdays, stored.holiday_coverage, stored.cancellations, stored.cancellation_splits, stored.guest_mix):
        assert empty(df).count() == 0
    said = {(r.result_id, r.analysis): r.message for r in stored.messages(df, ANALYSES).collect()}
    assert said[0, "guest_mix"] == "Not available: why" and said[0, "lead_time"] is None and said[0, "cancellations"] == said[3, "lead_time"] == "This analysis is not part of the selected result."


def test_limitations_with_their_paths(spark):
    gone = {"status": "unavailable", "reason": "why", "below": {"small_sample": True}}
    doc = {"analyses": {"a": {"x": [{"small_sample": True}, {"status": "omitted_small_sample"}, {"small_sample": "true"}, gone, gone], "partial_period": True}, "b": {"status": "unavailable", "small_sample": True}}}
    out = stored.limitations(spark.createDataFrame([("r", json.dumps(doc)), ("s", "no json")], "result_id string, document string")).collect()
    assert {tuple(r)[1:] for r in out if r.result_id == "r"} == {("small_samples", None, None, 3), ("partial_periods", None, None, 1), ("unavailable", "a / x", "why", 1), ("unavailable", "b", "no reason was recorded", 1)}
    assert {(r.kind, r.times) for r in out if r.result_id == "s"} == {("small_samples", 0), ("partial_periods", 0)}


def test_prompt_data(spark):
    long = 'a "long" label é\n' * 6
    doc = {"analyses": {"a": {"status": "available", "findings": {"groups": [{"group": long, "numerator": 1}], "summary": f"No comparison for {long}."}}, "b": {"status": "unavailable", "reason": "x"}}, "data_quality": {"record_count": 4, "missing_counts": {"m": 1}, "unknown_fields": ["u"]}}
    (row,) = stored.prompt_data(spark.createDataFrame([("r", json.dumps(doc))], "result_id string, document string")).collect()
    assert json.loads(row.data) == {"analysis": "a", "findings": {"groups": [{"group": long[:60], "numerator": 1}], "summary": f"No comparison for {long[:60]}."}, "data_quality": {"record_count": 4, "missing_counts": {"m": 1}}}


def test_prompt_data_serves_the_audit(spark):
    data = stored.prompt_data(plans.history(spark, "/root/testdata/sf0.001").where("result_id like 'run-%'"))
    assert data.count() == 30
    for r in data.collect():
        assert set(json.loads(r.data)) == {"analysis", "findings", "data_quality"}
