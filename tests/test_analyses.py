"""Small hand-made records with known figures."""

from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tallyhouse.functions.columns import mean_half_up, plain
from tallyhouse.operators import cancellations, guest_mix, holidays, lead_time, results, room_value, seasonality
from tallyhouse.operators.parsing import InputError, parse_csv, parse_json, read_csv, read_json_array
from tallyhouse.sources.bookings import FIELDS, KINDS, TYPES

SCHEMA = ", ".join(f"{f} {TYPES[KINDS[f]]}" for f in FIELDS)


def bookings(spark, *rows):
    return spark.createDataFrame([tuple(r.get(f) for f in FIELDS) for r in rows], SCHEMA)


def figures(df, *extra):
    return {r.group_label: (r.numerator, r.denominator, *(r[x] for x in extra)) for r in df.collect()}


def test_lead_time_edges(spark):
    df = bookings(spark, *[{"lead_time": n, "is_canceled": i % 2 == 1} for i, n in enumerate((7, 8, 30, 31, 90, 91, 180, 181))], {"is_canceled": True})
    (r,) = lead_time.distribution(df).collect()
    assert (r.band_0, r.band_1, r.band_2, r.band_3, r.band_4, r.median_days) == (1, 2, 2, 2, 1, 60.5)
    by = figures(lead_time.distribution(df, "by_cancellation_status"), "median_days", "small_sample")
    assert by == {"canceled": (4, 8, 61.0, True), "not_canceled": (4, 8, 60.0, True)}


def test_date_comparison(spark):
    d = date(2021, 3, 8)
    df = bookings(spark, {"lead_time": 3, "booking_date": d, "arrival_date": d + timedelta(3)}, {"lead_time": 3, "booking_date": d, "arrival_date": d - timedelta(1)}, {"lead_time": 3, "booking_date": d})
    assert figures(lead_time.date_comparison(df)) == {"differs_from_supplied": (1, 2)}


def test_cancellation_splits(spark):
    rows = [{"is_canceled": c, "lead_time": n, "total_of_special_requests": q, "booking_changes": ch} for c, n, q, ch in ((False, 0, 0, 0), (True, 8, 3, 1), (True, 30, 7, 2), (False, 31, 2, 9), (True, 90, None, 0), (True, 181, 1, 0))]
    df = bookings(spark, *rows, {"is_canceled": None, "lead_time": 5})
    assert figures(cancellations.split(df, "by_lead_time_band"), "position") == {"0-7": (0, 1, 1), "8-30": (2, 2, 2), "31-90": (1, 2, 3), "181+": (1, 1, 5)}
    assert figures(cancellations.split(df, "by_special_requests"), "records_left_out") == {"0": (0, 1, 1), "1": (1, 1, 1), "2": (0, 1, 1), "3+": (2, 2, 1)}
    assert figures(cancellations.split(df, "by_booking_changes")) == {"0": (2, 3), "1": (1, 1), "2+": (1, 2)}
    assert figures(cancellations.overall(df)) == {"all": (4, 6)}


def test_stays_and_value(spark):
    stays = ((1, 1, "19.0", False), (0, 1, "27.31", True), (2, 3, "10.5", False), (0, 0, "50", False), (4, 4, "0", True), (1, 2, "20", False))
    df = bookings(spark, *[{"stays_in_weekend_nights": a, "stays_in_week_nights": b, "price_per_night": Decimal(p), "is_canceled": c} for a, b, p, c in stays])
    lengths = room_value.stay_lengths(df).collect()
    assert {r.group_label: r.numerator for r in lengths} == {"1": 1, "2": 1, "3": 1, "4-7": 1, "8+": 1} and {(r.total_nights, r.zero_night_records) for r in lengths} == {(19, 1)}
    assert figures(room_value.values(df), "total", "mean", "zero_price_records") == {"not_canceled": (3, 5, "150.5", "50.1667", 0), "canceled": (2, 5, "27.31", "13.655", 1)}


@pytest.mark.parametrize(("total", "n", "mean"), [("150.5", 3, "50.1667"), ("27.31", 2, "13.655"), ("0.00005", 1, "0.0001"), ("10", 2, "5"), ("0", 5, "0")])
def test_means_round_half_up(spark, total, n, mean):
    row = spark.range(1).select(mean_half_up(F.lit(Decimal(total)).cast("decimal(18,6)"), F.lit(n)).alias("m"), plain(F.lit(Decimal("100")).cast("decimal(18,6)")).alias("p")).first()
    assert (row.m, row.p) == (mean, "100")


def test_holidays(spark):
    arrivals = [(1, False), (2, False), (9, False), (9, True), (9, False), (10, False), (16, False), (16, False), (16, False), (20, False)]
    df = bookings(spark, *[{"arrival_date": date(2021, 6, d), "is_canceled": c} for d, c in arrivals])
    calendar = spark.createDataFrame([(date(2021, 6, 10), "x")], "date date, name string")
    table = holidays.daily(df, calendar, "arrival_date", True, (1, 3))
    got = {(r.kind, r.window_days): (r.events, r.days, r.base_events, r.base_days) for r in holidays.comparison(table, (1, 3)).collect()}
    assert got[("holiday", None)] == (1, 1, 0, 2) and got[("before", 1)] == (3, 1, 4, 2) and got[("before", 3)][:2] == (3, 3) and got[("before", 3)][2:] == (5, 5)
    assert holidays.baseline(table).first()[:2] == (13, 6)
    assert {r.direction for r in holidays.direction(table, (1, 3)).collect()} == {"withheld"}
    assert {r.direction for r in holidays.direction(table, (1, 3), 1).collect() if (r.kind, r.window_days) == ("before", 1)} == {"higher"}


def test_tie_days_and_years_without_data(spark):
    df = bookings(spark, {"arrival_date": date(2021, 6, 9)}, {"arrival_date": date(2021, 6, 10)}, {"arrival_date": date(2022, 1, 2)})
    calendar = spark.createDataFrame([(date(2021, 6, 10), "a"), (date(2021, 6, 14), "b"), (date(2023, 1, 3), "not in the data")], "date date, name string")
    classes = {r.day: (r.kind, r.distance) for r in holidays.day_classes(df, calendar, "arrival_date").collect()}
    assert classes[date(2021, 6, 12)] == ("holiday", 2) and classes[date(2021, 6, 13)] == ("before", 1) and classes[date(2021, 6, 11)] == ("after", 1) and classes[date(2022, 1, 2)] == ("baseline", None)
    cover = {r.year: (r.has_data, r.records, r.days) for r in holidays.coverage(df, calendar, "arrival_date").collect()}
    assert cover[2021][:2] == (True, 2) and cover[2022] == (False, 1, 2)


def test_week_53_and_months(spark):
    df = bookings(spark, *[{"arrival_date": d} for d in (date(2020, 12, 31), date(2021, 1, 3), date(2021, 1, 4))])
    assert figures(seasonality.series(df, "arrival_date", "week"), "partial_period") == {"2020-W53": (2, 3, True), "2021-W01": (1, 3, True)}
    rows = ((date(2021, 3, 8), "20", True), (date(2021, 4, 1), "30.5", False), (date(2021, 4, 30), "19.0", False), (date(2021, 6, 15), "27.31", None))
    df = bookings(spark, *[{"booking_date": d, "price_per_night": Decimal(p), "is_canceled": c} for d, p, c in rows])
    months = {r.group_label: (r.canceled, r.known, r.mean_price, r.partial_period) for r in seasonality.series(df, "booking_date", "month").collect()}
    assert months["2021-04"] == (0, 2, "24.75", False) and months["2021-03"][3] and months["2021-06"] == (0, 0, "27.31", True)
    assert {(r.year, r.months_present) for r in seasonality.incomplete_years(df, "booking_date").collect()} == {(2021, 3)}


def test_guest_mix(spark):
    rows = [("PT", 1, 1, True, 20), ("PT", 2, 1, False, 30), ("FR", 1, 1, False, 40)]
    df = bookings(spark, *[{"country": c, "stays_in_weekend_nights": a, "stays_in_week_nights": b, "is_canceled": x, "price_per_night": Decimal(p)} for c, a, b, x, p in rows])
    got = {r.group_label: (r.numerator, r.denominator, r.mean_nights, r.canceled, r.known, r.mean_price) for r in guest_mix.distribution(df, "country", 2).collect()}
    assert got == {"PT": (2, 3, "2.5", 1, 2, "25"), "FR": (1, 3, None, None, None, None)}


BAD = {
    "is_canceled": ["2", "-1", '"true"', '"1"', "1.0", "[]"], "arrival_date": ['"2022-13-01"', '"01-02-2022"', '"2022-01-01T10:00:00"', '"20220101"', "5", '"0000-01-01"'],
    "lead_time": ['"12"', "3.5", "true", "-1", "2.0"], "price_per_night": ['"19.0"', "true", "-1"], "meal": ["5"], "booking_id": ["true", "1.5"],
}
GOOD = [("is_canceled", "1", True), ("is_canceled", "false", False), ("arrival_date", '"2024-02-29"', date(2024, 2, 29)), ("lead_time", "0", 0), ("price_per_night", "0", Decimal(0)), ("meal", '"\\t BB\\n"', "BB"), ("booking_id", "17", "17"), ("price_per_night", "1e2", Decimal(100))]


def test_cells(spark):
    lines = [(f"{f}:{v}", f'{{"{f}":{v}}}') for f, own in BAD.items() for v in own]
    for r in parse_json(spark.createDataFrame(lines, "position string, line string")).collect():
        field = r.position.split(":")[0]
        assert r.invalid_fields == [field] and r[field] is None, r.position
    lines = [(f"{f}", f'{{"{f}":{v}}}') for f in FIELDS for v in ("null", '""', '"   "')] + [("", "{}"), ("", "not json"), ("", "[1]")]
    for r in parse_json(spark.createDataFrame(lines, "position string, line string")).collect():
        assert r.invalid_fields == [] and r.missing_fields == FIELDS
    for field, text, value in GOOD:
        (r,) = parse_json(spark.createDataFrame([(f'{{"{field}":{text}}}',)], "line string")).collect()
        assert r[field] == value and field not in r.missing_fields + r.invalid_fields


def test_csv(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("booking_id;is_canceled;lead_time;booking_date;arrival_date;meal;price_per_night;extra\n1;0;348;08-03-2021;19-02-2022;BB;19.0;x\n1;0;abc;31-02-2021;2022/01/01;;5;x\n")
    good, bad = parse_csv(read_csv(spark, str(path))).collect()
    assert (good.is_canceled, good.lead_time, good.booking_date, good.arrival_date, good.meal, good.price_per_night) == (False, 348, date(2021, 3, 8), date(2022, 2, 19), "BB", Decimal("19.000000")) and good.invalid_fields == []
    assert bad.invalid_fields == ["arrival_date", "booking_date", "lead_time"] and "meal" in bad.missing_fields


@pytest.mark.parametrize(("text", "code"), [('{"records":[]}', "INPUT_NOT_ARRAY"), ("5", "INPUT_NOT_ARRAY"), ("[{", "INPUT_INVALID_JSON"), ("not json", "INPUT_INVALID_JSON"), ("[]", "INPUT_EMPTY"), ("[1]", "RECORD_NOT_OBJECT"), (None, "INPUT_NOT_FOUND")])
def test_rejected_inputs(spark, tmp_path, text, code):
    path = tmp_path / "in.json"
    if text is not None:
        path.write_text(text)
    with pytest.raises(InputError) as e:
        read_json_array(spark, str(path))
    assert e.value.code == code


def test_json_array(spark, tmp_path):
    path = tmp_path / "in.json"
    path.write_text('[{"booking_id": 1},\n {"booking_id": "b", "lead_time": 4}]')
    assert [(r.position, r.booking_id, r.lead_time) for r in parse_json(read_json_array(spark, str(path))).orderBy("position").collect()] == [(0, "1", None), (1, "b", 4)]


def test_history(spark):
    ok = lambda i, at="2024-01-01T00:00:00Z", version="1.0": f'{{"schema_version":"{version}","result_id":"{i}","generated_at":"{at}","status":"completed","input":{{}},"data_quality":{{}},"analyses":{{}},"notices":[]}}'
    lines = ["garbage-1", ok("a"), "garbage-2", ok("b"), ok("c", "soon", "2.1"), "{", "  "]
    df = spark.createDataFrame([Row(history_id=1, position=i, line=x) for i, x in enumerate(lines)])
    assert [r.line for r in results.retain(df, 2).orderBy("position").collect()] == ["garbage-1", "garbage-2", lines[3], lines[4], "{", "  "]
    assert [(r.result_id, r.supported) for r in results.listing(df).orderBy("place").collect()] == [("b", True), ("a", True), ("c", False)]
    assert results.readout_counts(df).first()[1:] == (3, 3)
