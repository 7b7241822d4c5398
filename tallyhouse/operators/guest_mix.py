"""How bookings are spread over guest attributes, with comparisons of groups that are not small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.functions.columns import MIN_GROUP_SIZE, mean_half_up
from tallyhouse.operators.figures import counts, valid
from tallyhouse.sources.bookings import KINDS

ATTRIBUTES = ("total_guests", "country", "meal", "assigned_room_type", "is_repeated_guest", "required_car_parking_spaces", "total_of_special_requests")


def needed(attribute: str) -> tuple[str, ...]:
    return ("adults", "children", "babies") if attribute == "total_guests" else (attribute,)


def label(attribute: str) -> Column:
    if attribute == "is_repeated_guest":
        return F.when(F.col(attribute), "repeated").otherwise("not_repeated")
    value = F.col("adults") + F.col("children") + F.col("babies") if attribute == "total_guests" else F.col(attribute)
    return value.cast("string")


def distribution(bookings: DataFrame, attribute: str, minimum: int = MIN_GROUP_SIZE) -> DataFrame:
    """(group_label, numerator, denominator, small_sample, nights_known, mean_nights, known, canceled, priced, mean_price).

    The means and shares of small groups are null: no comparison is stated for them.
    """
    rows = valid(bookings, *needed(attribute)).withColumn("nights", F.col("stays_in_weekend_nights") + F.col("stays_in_week_nights"))
    out = counts(
        rows, label(attribute), F.count("nights").alias("nights_known"), F.sum("nights").alias("nights_total"), F.count("is_canceled").alias("known"),
        F.count_if("is_canceled").alias("canceled"), F.count("price_per_night").alias("priced"), F.sum("price_per_night").alias("price_total"), minimum=minimum,
    )
    out = out.withColumn("mean_nights", mean_half_up(F.col("nights_total"), F.col("nights_known"))).withColumn("mean_price", mean_half_up(F.col("price_total"), F.col("priced")))
    stated = lambda c: F.when(~F.col("small_sample"), F.col(c)).alias(c)
    return out.select("group_label", "numerator", "denominator", "small_sample", *map(stated, ("nights_known", "mean_nights", "known", "canceled", "priced", "mean_price")))


def positions(bookings: DataFrame, attribute: str, minimum: int = MIN_GROUP_SIZE) -> DataFrame:
    """distribution() with position, from 1: groups in the order of the attribute's own type, whole numbers by value, false before true."""
    numeric = attribute == "total_guests" or KINDS[attribute] == "integer"
    key = F.col("group_label").try_cast("bigint") if numeric else F.col("group_label")
    whole = Window.partitionBy(F.lit(1)).orderBy(key)  # over groups, not records
    return distribution(bookings, attribute, minimum).withColumn("position", F.row_number().over(whole).cast("bigint"))
