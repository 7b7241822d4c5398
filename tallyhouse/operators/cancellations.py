"""Cancellation shares, over all records and by attribute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.functions.columns import BOOKING_CHANGE_CAP, LEAD_TIME_BANDS, MIN_GROUP_SIZE, SPECIAL_REQUEST_CAP, band, capped, capped_labels, is_small, month_bounds, month_key, rank_in
from tallyhouse.operators.figures import partial, rates, span, valid, with_span


#: The field that each split needs.
SPLIT_FIELDS = {
    "by_lead_time_band": "lead_time", "by_deposit_type": "deposit_type", "by_market_segment": "market_segment", "by_customer_type": "customer_type", "by_arrival_month": "arrival_date",
    "by_special_requests": "total_of_special_requests", "by_booking_changes": "booking_changes",
}


def splits() -> dict[str, tuple[str, Column, list[str] | None]]:
    """Split name -> (field, label, fixed order of labels or None for label order)."""
    plain = lambda c: c
    labels = {
        "by_lead_time_band": (lambda c: band(c, LEAD_TIME_BANDS), [x for x, _, _ in LEAD_TIME_BANDS]),
        "by_arrival_month": (month_key, None),
        "by_special_requests": (lambda c: capped(c, SPECIAL_REQUEST_CAP), capped_labels(SPECIAL_REQUEST_CAP)),
        "by_booking_changes": (lambda c: capped(c, BOOKING_CHANGE_CAP), capped_labels(BOOKING_CHANGE_CAP)),
    }
    return {s: (f, labels.get(s, (plain, None))[0](F.col(f)), labels.get(s, (plain, None))[1]) for s, f in SPLIT_FIELDS.items()}


def overall(bookings: DataFrame, minimum: int = MIN_GROUP_SIZE) -> DataFrame:
    out = valid(bookings, "is_canceled").agg(F.count_if("is_canceled").alias("numerator"), F.count("*").alias("denominator"))
    return out.select(F.lit("all").alias("group_label"), "numerator", "denominator", is_small(F.col("denominator"), minimum).alias("small_sample"))


def split(bookings: DataFrame, name: str, minimum: int = MIN_GROUP_SIZE) -> DataFrame:
    """(group_label, numerator, denominator, small_sample, records_used, records_left_out, position[, partial_period]).

    Records without the field are left out and counted; they are one more group of the aggregation, not another scan.
    """
    field, label, order = splits()[name]
    rows = valid(bookings, "is_canceled")
    measures = span(field) if field == "arrival_date" else []
    groups = rates(rows, F.when(F.col(field).isNotNull(), label), F.col("is_canceled"), *measures, minimum=minimum)
    whole = Window.partitionBy(F.lit(1))
    out = groups.withColumn("all", F.sum("denominator").over(whole)).withColumn("records_used", F.sum(F.when(F.col("group_label").isNotNull(), F.col("denominator"))).over(whole))
    out = out.where(F.col("group_label").isNotNull()).withColumn("records_left_out", F.col("all") - F.col("records_used")).drop("all")
    place = rank_in(F.col("group_label"), order) if order else F.row_number().over(whole.orderBy("group_label"))
    out = out.withColumn("position", place.cast("bigint"))
    if measures:
        out = with_span(out).withColumn("partial_period", partial(month_bounds(F.col("first_in")))).drop("first_in", "last_in", "first_day", "last_day")
    return out


def all_splits(bookings: DataFrame, minimum: int = MIN_GROUP_SIZE) -> DataFrame:
    """(split, group_label, numerator, denominator, small_sample) of every split in one pass: records are unpivoted before one aggregation."""
    rows = valid(bookings, "is_canceled")
    long = F.explode(F.array(*[F.struct(F.lit(name).alias("split"), label.alias("group_label"), F.col(field).isNotNull().alias("known")) for name, (field, label, _) in splits().items()]))
    long_rows = rows.select("is_canceled", long.alias("x")).where("x.known")
    out = long_rows.groupBy("x.split", "x.group_label").agg(F.count_if("is_canceled").alias("numerator"), F.count("*").alias("denominator"))
    return out.withColumn("small_sample", is_small(F.col("denominator"), minimum))
