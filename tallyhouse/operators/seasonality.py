"""Counts per month and ISO week, by booking date and by arrival date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.functions.columns import MIN_GROUP_SIZE, mean_half_up, month_bounds, month_key, week_bounds, week_key
from tallyhouse.operators.figures import counts, partial, span, valid, with_span

GRAINS = {"month": (month_key, month_bounds), "week": (week_key, week_bounds)}


def series(bookings: DataFrame, day: str, grain: str, minimum: int = MIN_GROUP_SIZE) -> DataFrame:
    """(group_label, numerator, denominator, small_sample, known, canceled, priced, mean_price, partial_period) of each period with records."""
    key, bounds = GRAINS[grain]
    rows = valid(bookings, day)
    out = counts(
        rows, key(F.col(day)), F.count("is_canceled").alias("known"), F.count_if("is_canceled").alias("canceled"), F.count("price_per_night").alias("priced"),
        F.sum("price_per_night").alias("price_total"), *span(day), minimum=minimum,
    )
    out = with_span(out).withColumn("partial_period", partial(bounds(F.col("first_in"))))
    return out.withColumn("mean_price", mean_half_up(F.col("price_total"), F.col("priced"))).drop("price_total", "first_in", "last_in", "first_day", "last_day")


def incomplete_years(bookings: DataFrame, day: str) -> DataFrame:
    """(year, months_present) of the years with records in fewer than twelve months."""
    months = valid(bookings, day).groupBy(F.year(day).alias("year"), F.month(day).alias("month")).agg(F.count("*"))
    return months.groupBy("year").agg(F.count("*").alias("months_present")).where("months_present < 12")


def summary(bookings: DataFrame, day: str) -> DataFrame:
    """One row: records, first_day, last_day, months, weeks, partial_periods."""
    # one pass over the records; periods are made of days
    days = valid(bookings, day).groupBy(F.col(day).alias("day")).agg(F.count("*").alias("n"))
    whole = Window.partitionBy(F.lit(1))
    days = days.withColumn("first_day", F.min("day").over(whole)).withColumn("last_day", F.max("day").over(whole))
    fraction = {g: partial(bounds(F.col("day"))) for g, (_, bounds) in GRAINS.items()}
    keys = {g: key(F.col("day")) for g, (key, _) in GRAINS.items()}
    cut = [F.size(F.collect_set(F.when(fraction[g], keys[g]))) for g in GRAINS]
    return days.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.min("day").alias("first_day"), F.max("day").alias("last_day"),
        F.count_distinct(keys["month"]).alias("months"), F.count_distinct(keys["week"]).alias("weeks"), (cut[0] + cut[1]).cast("bigint").alias("partial_periods"),
    )
