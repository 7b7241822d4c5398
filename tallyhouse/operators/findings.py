"""The figures of all six analyses, every split and side, as one long table, from one pass over the bookings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.columns import is_small
from tallyhouse.operators import cancellations, cube, guest_mix, holidays, lead_time, seasonality
from tallyhouse.operators.cube import SIDES

_COMMON = ("run", "split", "group_label", "numerator", "denominator", "small_sample", "partial_period")


def _part(analysis: str, split: Column, figures: DataFrame) -> DataFrame:
    """Figures of one or more splits in the long form; columns of their own become details."""
    own = [c for c in figures.columns if c not in _COMMON]
    pairs = [x for c in own for x in (F.lit(c), F.col(c).cast("string"))]
    details = F.create_map(*pairs) if pairs else F.lit(None)
    partial = F.col("partial_period") if "partial_period" in figures.columns else F.lit(None).cast("boolean")
    counts = [F.col(c).cast("bigint").alias(c) for c in ("numerator", "denominator")]
    return figures.select(F.lit(analysis).alias("analysis"), split.alias("split"), "group_label", *counts, "small_sample", partial.alias("partial_period"), details.cast("map<string,string>").alias("details"))


def group_name() -> Column:
    """The name of a group of holidays.tallies(): its kind, with its window."""
    return F.concat("kind", F.coalesce(F.concat(F.lit("_"), F.col("window_days").cast("string"), F.lit("_days")), F.lit("")))


def _holidays(table: DataFrame, calendar: DataFrame, side: str) -> DataFrame:
    sums = holidays.tallies(holidays.usable_days(holidays.classified(cube.per_day(table, side), calendar)))
    part = F.when(F.col("kind") == "baseline", "baseline").when(F.col("weekday").isNull(), "comparison").otherwise("by_weekday")
    label = F.concat_ws("_", group_name(), F.when(F.col("weekday").isNotNull(), holidays.weekday_name(F.col("weekday"))))
    own = [c for c in sums.columns if c not in ("run", "events", "days")]
    rows = sums.where("kind <> 'baseline' or weekday is null").select(part.alias("part"), label.alias("group_label"), F.col("events").alias("numerator"), F.col("days").alias("denominator"), is_small(F.col("days")).alias("small_sample"), *own)
    return _part("holidays", F.concat(F.lit(f"{side}_"), F.col("part")), rows).withColumn("details", F.map_filter("details", lambda k, _: k != "part"))


def _parts(table: DataFrame, calendar: DataFrame, analysis: str) -> list[DataFrame]:
    split = F.col("split")
    if analysis == "lead_time":
        return [_part(analysis, split, cube.lead_times(table)), _part(analysis, F.lit("date_comparison"), cube.date_comparison(table))]
    if analysis == "cancellations":
        return [_part(analysis, split, cube.cancellations(table))]
    if analysis == "seasonality":
        return [_part(analysis, F.concat("side", F.lit("s_"), "grain", F.lit("ly")), cube.seasons(table))]
    if analysis == "room_value":
        return [_part(analysis, F.lit("values"), cube.values(table)), _part(analysis, F.lit("stay_lengths"), cube.stay_lengths(table))]
    if analysis == "guest_mix":
        return [_part(analysis, F.col("attribute"), cube.guests(table))]
    return [_holidays(table, calendar, side) for side in SIDES]


ANALYSES = ("lead_time", "cancellations", "seasonality", "room_value", "guest_mix", "holidays")


def figures(bookings: DataFrame, calendar: DataFrame, analyses: tuple[str, ...] = ANALYSES) -> DataFrame:
    """(analysis, split, group_label, numerator, denominator, small_sample, partial_period, details) of the analyses.

    partial_period is null where groups are not periods; details holds a split's further columns as text. The bookings
    are read once, whatever the number of analyses.
    """
    table = cube.measured(bookings)
    return reduce(DataFrame.unionByName, [p for a in analyses for p in _parts(table, calendar, a)])


def needs() -> list[tuple[str, str, tuple[str, ...], tuple[str, ...]]]:
    """(analysis, split, fields that a record must have, fields that the reason names) of every split."""
    stay = ("stays_in_weekend_nights", "stays_in_week_nights")
    out = [("lead_time", "overall", ("lead_time",)), *(("lead_time", s, ("lead_time", f)) for s, f in lead_time.SPLIT_FIELDS.items())]
    out += [("lead_time", "date_comparison", ("lead_time", *SIDES.values())), ("cancellations", "overall", ("is_canceled",))]
    out += [("cancellations", s, ("is_canceled", f)) for s, f in cancellations.SPLIT_FIELDS.items()]
    out += [("seasonality", f"{side}s_{g}ly", (day,)) for side, day in SIDES.items() for g in seasonality.GRAINS]
    out += [("room_value", "stay_lengths", stay)] + [("guest_mix", a, guest_mix.needed(a)) for a in guest_mix.ATTRIBUTES]
    out += [("holidays", f"{side}_{x}", (day,)) for side, day in SIDES.items() for x in ("comparison", "by_weekday", "baseline")]
    return [*((a, s, f, f) for a, s, f in out), ("room_value", "values", (*stay, "price_per_night"), ("price_per_night",))]


def part_status(bookings: DataFrame) -> DataFrame:
    """(analysis, split, status, reason): a split is unavailable if no record holds a value in every field that it needs. One pass."""
    parts = needs()
    sets = list(dict.fromkeys(f for _, _, f, _ in parts))
    every = lambda fields: reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in fields])
    counted = bookings.agg(*[F.count_if(every(f)).alias(f"n{i}") for i, f in enumerate(sets)])
    quoted = lambda fields: ", ".join(f"'{f}'" for f in fields)
    rows = [F.struct(F.lit(a).alias("analysis"), F.lit(s).alias("split"), F.col(f"n{sets.index(f)}").alias("n"), F.lit(f"No record holds a valid value in every required field: {quoted(named)}").alias("reason")) for a, s, f, named in parts]
    out = counted.select(F.inline(F.array(*rows)))
    none = F.col("n") == 0
    return out.select("analysis", "split", F.when(none, "unavailable").otherwise("available").alias("status"), F.when(none, F.col("reason")).alias("reason"))
