"""Labels, bands, periods and exact means as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values: (label, lowest, highest or None) of lead times in days and of stays in nights.
LEAD_TIME_BANDS = (("0-7", 0, 7), ("8-30", 8, 30), ("31-90", 31, 90), ("91-180", 91, 180), ("181+", 181, None))
STAY_BUCKETS = (("1", 1, 1), ("2", 2, 2), ("3", 3, 3), ("4-7", 4, 7), ("8+", 8, None))
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
SPECIAL_REQUEST_CAP, BOOKING_CHANGE_CAP = 3, 2
MIN_GROUP_SIZE = 30


def band(value: Column, bands: tuple) -> Column:
    """The label of the band that holds value; '' outside all of them, null for null."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for label, low, high in bands:
        out = out.when((value >= low) if high is None else value.between(low, high), label)
    return out.otherwise("")


def rank_in(label: Column, labels: list[str]) -> Column:
    """The place of a label in a fixed order."""
    return F.array_position(F.array(*map(F.lit, labels)), label)


def capped(value: Column, cap: int) -> Column:
    return F.when(value >= cap, f"{cap}+").otherwise(value.cast("string"))


def capped_labels(cap: int) -> list[str]:
    return [*map(str, range(cap)), f"{cap}+"]


def status_label(canceled: Column) -> Column:
    return F.when(canceled, "canceled").when(~canceled, "not_canceled")


def full_status_label(canceled: Column) -> Column:
    return F.coalesce(status_label(canceled), F.lit("cancellation_status_unknown"))


def month_key(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def week_key(day: Column) -> Column:
    return F.format_string("%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), day), F.weekofyear(day))


def month_bounds(day: Column) -> tuple[Column, Column]:
    return F.trunc(day, "month"), F.last_day(day)


def week_bounds(day: Column) -> tuple[Column, Column]:
    monday = F.date_trunc("week", day).cast("date")
    return monday, F.date_add(monday, 6)


def is_small(size: Column, minimum: int = MIN_GROUP_SIZE) -> Column:
    return size < minimum


def plain(value: Column) -> Column:
    """An exact decimal as a string without trailing zeros."""
    text = value.cast("string")
    return F.when(text.contains("."), F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")).otherwise(text)


def mean_half_up(total: Column, count: Column) -> Column:
    """total / count rounded half up to four places, as a plain string; null where count is 0. total is an exact decimal of at most six places."""
    n = count.cast("decimal(18,0)")
    units = F.floor((total.cast("decimal(26,6)") * F.lit(20000).cast("decimal(5,0)") + n) / (n * 2))
    return F.when(count > 0, plain((units.cast("decimal(24,0)") * F.lit("0.0001").cast("decimal(5,4)"))))


def share(numerator: Column, denominator: Column) -> Column:
    """A share as text: n/a, or per cent with one decimal, half up on the exact ratio, unlike share_text()."""
    tenths = F.floor((numerator * 2000 + denominator) / (denominator * 2))
    return F.when(denominator > 0, F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("%"))).otherwise("n/a")


def share_text(numerator: Column, denominator: Column) -> Column:
    """A share as per cent with one decimal, n/a without a denominator: the ratio as a double, ties to even on its exact value."""
    per_cent = F.call_function("format_number", numerator.cast("double") / denominator * 100, F.lit("0.0"))
    return F.when(denominator > 0, F.concat(per_cent, F.lit("%"))).otherwise("n/a")


def ratio_text(numerator: Column, denominator: Column) -> Column:
    """n of d (share); counts that are not known are called so."""
    known = lambda c: F.coalesce(c.cast("string"), F.lit("unknown"))
    return F.concat(known(numerator), F.lit(" of "), known(denominator), F.lit(" ("), F.coalesce(F.when(numerator.isNotNull(), share_text(numerator, denominator)), F.lit("n/a")), F.lit(")"))
