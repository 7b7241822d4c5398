"""Stay lengths and estimated value of stays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.columns import MIN_GROUP_SIZE, STAY_BUCKETS, band, full_status_label, is_small, mean_half_up, plain, rank_in
from tallyhouse.operators.figures import counts, valid

def with_nights(bookings: DataFrame) -> DataFrame:
    return valid(bookings, "stays_in_weekend_nights", "stays_in_week_nights").withColumn("nights", F.col("stays_in_weekend_nights") + F.col("stays_in_week_nights"))


def stay_lengths(bookings: DataFrame, minimum: int = MIN_GROUP_SIZE) -> DataFrame:
    """(group_label, numerator, denominator, small_sample, total_nights, zero_night_records): every bucket, empty ones too; zero nights are left out."""
    rows = with_nights(bookings)
    facts = rows.agg(
        *[F.count_if((F.col("nights") >= 1) & (band(F.col("nights"), STAY_BUCKETS) == label)).alias(f"b{i}") for i, (label, _, _) in enumerate(STAY_BUCKETS)],
        F.count_if(F.col("nights") >= 1).alias("denominator"), F.coalesce(F.sum("nights"), F.lit(0)).alias("total_nights"), F.count_if(F.col("nights") < 1).alias("zero_night_records"),
    )
    buckets = F.explode(F.array(*[F.struct(F.lit(label).alias("group_label"), F.col(f"b{i}").alias("numerator")) for i, (label, _, _) in enumerate(STAY_BUCKETS)]))
    out = facts.select(buckets.alias("b"), "denominator", "total_nights", "zero_night_records")
    return out.select("b.group_label", "b.numerator", "denominator", is_small(F.col("b.numerator"), minimum).alias("small_sample"), "total_nights", "zero_night_records")


def values(bookings: DataFrame, minimum: int = MIN_GROUP_SIZE) -> DataFrame:
    """(group_label, numerator, denominator, small_sample, total, mean, zero_price_records) by cancellation status, never combined.

    total and mean are plain decimal strings: price per night times nights, an estimate.
    """
    rows = with_nights(bookings).where("nights >= 1 and price_per_night is not null")
    value = (F.col("price_per_night").cast("decimal(18,6)") * F.col("nights").cast("decimal(9,0)")).cast("decimal(28,6)")
    out = counts(rows, full_status_label(F.col("is_canceled")), F.sum(value).alias("sum"), F.count_if(F.col("price_per_night") == 0).alias("zero_price_records"), minimum=minimum)
    return out.withColumn("total", plain(F.col("sum"))).withColumn("mean", mean_half_up(F.col("sum"), F.col("numerator"))).drop("sum")


#: The order in which groups are shown.
STATUSES = ["not_canceled", "canceled", "cancellation_status_unknown"]


def priced(bookings: DataFrame) -> DataFrame:
    """(records_used, records_without_price) of the stays of a night or more."""
    rows = with_nights(bookings).where("nights >= 1")
    return rows.agg(F.count("price_per_night").alias("records_used"), F.count_if(F.col("price_per_night").isNull()).alias("records_without_price"))


def ordered_values(bookings: DataFrame, minimum: int = MIN_GROUP_SIZE) -> DataFrame:
    """values() with position, the place of a status in STATUSES, and records_without_price."""
    out = values(bookings, minimum).withColumn("position", rank_in(F.col("group_label"), STATUSES))
    return out.join(F.broadcast(priced(bookings).select("records_without_price")))
