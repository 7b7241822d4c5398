"""The long table of all figures, from one pass, and its limitations."""

from tallyhouse.operators import cube, findings, results, views
from tallyhouse.plans import catalog, stored, whole  # noqa: F401  each registers its queries
from tallyhouse.plans.registry import QUERIES
from tallyhouse.sources import bookings, raw

SF = "/root/testdata/sf0.001"
#: Figures' tables by analysis and split, as queries of their own.
SAME = {
    ("lead_time", "by_arrival_month"): "lead_time_by_month",
    ("cancellations", "by_market_segment"): "cancel_by_market_segment",
    ("cancellations", "overall"): "cancel_overall",
    ("seasonality", "bookings_weekly"): "season_bookings_weekly",
    ("room_value", "stay_lengths"): "stay_length",
    ("guest_mix", "meal"): "guest_mix_meal",
}


def leaves(df, path):
    """How often the plan of df reads files of a path."""
    plan = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(path in str(plan.apply(i).relation().location().rootPaths()) for i in range(plan.size()) if plan.apply(i).getClass().getSimpleName() == "LogicalRelation")


def test_every_split_and_side(spark):
    rows = findings.figures(bookings.from_orders(spark, SF), bookings.calendar(spark)).collect()
    splits = {}
    for r in rows:
        splits.setdefault(r.analysis, set()).add(r.split)
    assert {a: len(s) for a, s in splits.items()} == {"lead_time": 6, "cancellations": 8, "seasonality": 4, "room_value": 2, "guest_mix": 7, "holidays": 6}
    for (analysis, split), name in SAME.items():
        got = {(r.group_label, r.numerator, r.denominator, r.small_sample) for r in rows if (r.analysis, r.split) == (analysis, split)}
        assert got == {(r.group_label, r.numerator, r.denominator, r.small_sample) for r in QUERIES[name](spark, SF).collect()}


def test_bookings_are_read_once(spark):
    b = raw.table_of(bookings.from_orders(spark, SF), "bookings")
    path = b.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:").lstrip("/")
    assert leaves(cube.measure(b), path) == 1
    whole_ = results.documents(findings.figures(b, bookings.calendar(spark)))
    assert leaves(whole_, path) == 0 and leaves(whole_, "/cube-") > 1


def test_limitations(spark):
    rows = {r.analysis: r for r in QUERIES["limitations_whole"](spark, SF).collect()}
    figures = findings.figures(bookings.from_orders(spark, SF), bookings.calendar(spark)).collect()
    for analysis, row in rows.items():
        own = [r for r in figures if r.analysis == analysis]
        if row.reason is None:
            assert (row.figures, row.small_samples, row.partial_periods) == (len(own), sum(r.small_sample for r in own), sum(bool(r.partial_period) for r in own))
    figures = spark.createDataFrame([("a", True, None), ("a", False, True), ("b", True, None)], "analysis string, small_sample boolean, partial_period boolean")
    state = spark.createDataFrame([("a", "available", None), ("b", "unavailable", "no field"), ("c", "available", None)], "analysis string, status string, reason string")
    assert sorted(map(tuple, views.whole_limitations(figures, state).collect())) == [("a", 2, 1, 1, None), ("b", 0, 0, 0, "no field"), ("c", 0, 0, 0, None)]
