"""Lead times: count, exact median and bands, over all records and by attribute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.columns import LEAD_TIME_BANDS, MIN_GROUP_SIZE, band, is_small, month_bounds, month_key, status_label
from tallyhouse.operators.figures import counts, partial, span, valid, with_span


#: The field that each split needs.
SPLIT_FIELDS = {"by_cancellation_status": "is_canceled", "by_arrival_month": "arrival_date", "by_market_segment": "market_segment", "by_customer_type": "customer_type"}


def splits() -> dict[str, tuple[str, Column]]:
    """Split name -> (field it needs, label)."""
    labels = {"by_cancellation_status": status_label, "by_arrival_month": month_key}
    return {s: (f, labels.get(s, lambda c: c)(F.col(f))) for s, f in SPLIT_FIELDS.items()}


def distribution(bookings: DataFrame, split: str | None = None, minimum: int = MIN_GROUP_SIZE) -> DataFrame:
    """(group_label, numerator, denominator, small_sample, median_days, band_0..band_4[, partial_period]).

    The denominator counts the records that have both a lead time and the split's field.
    """
    field, label = splits()[split] if split else (None, F.lit("all"))
    rows = valid(bookings, "lead_time", *([field] if field else [])).withColumn("band", band(F.col("lead_time"), LEAD_TIME_BANDS))
    bands = [F.count_if(F.col("band") == name).alias(f"band_{i}") for i, (name, _, _) in enumerate(LEAD_TIME_BANDS)]
    extra = span(field) if field == "arrival_date" else []
    out = counts(rows, label, F.median("lead_time").alias("median_days"), *bands, *extra, minimum=minimum)
    if extra:
        out = with_span(out).withColumn("partial_period", partial(month_bounds(F.col("first_in")))).drop("first_in", "last_in", "first_day", "last_day")
    return out


def date_comparison(bookings: DataFrame, minimum: int = MIN_GROUP_SIZE) -> DataFrame:
    """One figure: records whose lead time differs from arrival minus booking date."""
    rows = valid(bookings, "lead_time", "booking_date", "arrival_date")
    differs = F.datediff("arrival_date", "booking_date") != F.col("lead_time")
    out = rows.agg(F.count_if(differs).alias("numerator"), F.count("*").alias("denominator"))
    return out.select(F.lit("differs_from_supplied").alias("group_label"), "numerator", "denominator", is_small(F.col("denominator"), minimum).alias("small_sample"))
