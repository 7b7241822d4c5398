"""Finding sentences: fixed wording, filled from figures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The wording, as printf templates.
LEAD_TIME_MEDIAN = "The median lead time was %s days across %d records; this describes the observed distribution."
LEAD_TIME_DIFFERENCE = "The supplied lead time differed from the days between booking date and arrival date in %d of %d records."
CANCELLATION_SPLIT = "Cancellation share by %s: %d of %d bookings were cancelled overall; groups are shown with their counts and small groups are flagged."
GUEST_MIX_OMITTED = "No comparison is stated for group '%s'; it is a small sample of %d records."
ROOM_VALUE_GROUP = "Estimated value of %d %s bookings: total %s, mean %s in the price units of the input (an estimate, not realized revenue)."
HOLIDAY_COMPARED = {
    "higher": "Mean %s per day was higher %s (%s) than on baseline days of the same weekdays (%s); this is an observed association only.",
    "lower": "Mean %s per day was lower %s (%s) than on baseline days of the same weekdays (%s); this is an observed association only.",
    "same": "Mean %s per day was the same %s (%s) as on baseline days of the same weekdays (%s); this is an observed association only.",
}
HOLIDAY_WITHHELD = "No comparison is stated %s; a group is a small sample."
HOLIDAY_WINDOW, HOLIDAY_ITSELF = "in the %d-day window %s holidays", "on holidays"
HOLIDAY_NOTE = (
    "Holiday figures describe associations between dates and activity; other factors are not adjusted for. Holidays are taken only for the years present in the data, "
    "so days at the start or end of the date span may lie near a holiday of a neighbouring year that is not considered."
)
SEASON_NOTE = (
    "Bookings are counted by booking date and arrivals by arrival date, as separate series. "
    "Figures describe observed counts per period; no seasons are defined, and a partial period is not fully covered by the observed dates."
)
CANCELLATION_NOTE = "Cancellation shares are observed associations between a booking attribute and cancellation status; other factors are not adjusted for, and nothing is predicted."
ROOM_VALUE_LABEL = (
    "Estimate in the price units of the input: price per night times total nights. It is not realized revenue; payments, taxes, discounts and adjustments are not supplied."
)
STATUS_WORDS = {"canceled": "cancelled", "not_canceled": "not cancelled", "cancellation_status_unknown": "cancellation status unknown"}
STATUS_UNKNOWN_NOTE = (
    "Cancellation status is not available, so one group labelled 'cancellation status unknown' is reported; cancelled and other bookings are never combined into one figure."
)
GUEST_MIX_NOTE = (
    "Distributions show how bookings are spread over each attribute. A comparison is stated only for groups that are not small samples; it describes an observed association only."
)
SEASON_SUMMARY = (
    "%d %s were observed from %s to %s, in %d months and %d ISO weeks; %d of these periods are partial. This describes the observed data only."
)


def holiday_comparison(measure: str | Column, kind: Column, window: Column, direction: Column, mean: Column, baseline: Column) -> Column:
    """The sentence of a group of holidays.direction(); means have two places, ties to even."""
    mean, baseline = (F.call_function("format_number", x, F.lit("0.00")) for x in (mean, baseline))
    subject = F.when(kind == "holiday", HOLIDAY_ITSELF).otherwise(F.format_string(HOLIDAY_WINDOW, window, kind))
    out = F.when(direction == "withheld", F.format_string(HOLIDAY_WITHHELD, subject))
    measure = F.lit(measure) if isinstance(measure, str) else measure
    for word, template in HOLIDAY_COMPARED.items():
        out = out.when(direction == word, F.format_string(template, measure, subject, mean, baseline))
    return out


def season_summary(measure: str | Column, row: str = "") -> Column:
    """The sentence of a row of seasonality.summary()."""
    c = lambda n: F.col(f"{row}{n}")
    measure = F.lit(measure) if isinstance(measure, str) else measure
    return F.format_string(SEASON_SUMMARY, c("records"), measure, c("first_day").cast("string"), c("last_day").cast("string"), c("months"), c("weeks"), c("partial_periods"))


def lead_time_median(median: Column, count: Column) -> Column:
    whole = median == F.floor(median)
    return F.format_string(LEAD_TIME_MEDIAN, F.when(whole, median.cast("bigint").cast("string")).otherwise(median.cast("string")), count)


def lead_time_difference(differing: Column, total: Column) -> Column:
    return F.format_string(LEAD_TIME_DIFFERENCE, differing, total)


def cancellation_split(name: str | Column, canceled: Column, total: Column) -> Column:
    name = F.lit(name) if isinstance(name, str) else name
    return F.format_string(CANCELLATION_SPLIT, F.replace(F.regexp_replace(name, "^by_", ""), F.lit("_"), F.lit(" ")), canceled, total)


def guest_mix_omitted(group: Column, count: Column) -> Column:
    return F.format_string(GUEST_MIX_OMITTED, group, count)


def status_words(status: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in STATUS_WORDS.items() for x in pair]), status)


def room_value_group(count: Column, status: Column, total: Column, mean: Column) -> Column:
    return F.format_string(ROOM_VALUE_GROUP, count, status_words(status), total, mean)
