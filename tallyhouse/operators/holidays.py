"""Activity around holidays, against days of the same weekdays that lie near none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.functions.columns import MIN_GROUP_SIZE, WEEKDAYS, is_small
from tallyhouse.operators.figures import valid

WINDOWS = (1, 3, 7)


def _per_day(bookings: DataFrame, day: str, with_status: bool) -> DataFrame:
    """(run, day, events, known, canceled) of one run: the one pass over the records."""
    none = F.max(F.lit(0).cast("bigint"))
    known, canceled = (F.count("is_canceled"), F.count_if("is_canceled")) if with_status else (none, none)
    days = valid(bookings, day).groupBy(F.col(day).alias("day")).agg(F.count("*").alias("events"), known.alias("known"), canceled.alias("canceled"))
    return days.withColumn("run", F.lit(""))


def classified(per_day: DataFrame, calendar: DataFrame, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """(run, day, kind, distance, year, events, known, canceled, year_records, has_data) for every day of each run's observed span.

    per_day is (run, day, events, known, canceled). Holidays of a year count if the run has records in it. Windows run
    over a run's days, not records.
    """
    counted = [F.col(c).cast("bigint").alias(c) for c in ("events", "known", "canceled")]
    nothing = [F.lit(None).cast("bigint").alias(c) for c in ("events", "known", "canceled")]
    years = per_day.select("run", F.year("day").alias("year")).distinct()
    holidays = years.join(calendar.select(F.col("date").alias("day"), F.year("date").alias("year")).distinct(), "year").select("run", "day", *nothing, F.lit(True).alias("marked"))
    marks = per_day.select("run", "day", *counted, F.lit(False).alias("marked")).unionByName(holidays)
    marks = marks.groupBy("run", "day").agg(*[F.max(c).alias(c) for c in ("events", "known", "canceled")], F.bool_or("marked").alias("marked"))
    whole = Window.partitionBy("run")
    of_year = Window.partitionBy("run", F.year("day"))
    seen = F.when(F.col("events").isNotNull(), F.col("day"))
    marks = marks.withColumn("first_day", F.min(seen).over(whole)).withColumn("last_day", F.max(seen).over(whole)).withColumn("next", F.lead("day").over(whole.orderBy("day")))
    # each mark with the days up to the next one
    days = marks.withColumn("each", F.explode(F.sequence("day", F.coalesce(F.date_sub("next", 1), F.col("day")))))
    own = F.col("each") == F.col("day")
    days = days.select("run", F.col("each").alias("day"), *[F.when(own, F.col(c)).alias(c) for c in ("events", "known", "canceled")], (own & F.col("marked")).alias("marked"), "first_day", "last_day")
    days = days.withColumn("year", F.year("day")).withColumn("year_records", F.sum("events").over(of_year)).withColumn("has_data", F.bool_or("marked").over(of_year))
    order = whole.orderBy("day")
    holiday = F.when(F.col("marked"), F.col("day"))
    last = F.last(holiday, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    following = F.first(holiday, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    near = days.withColumn("since", F.datediff("day", last)).withColumn("until", F.datediff(following, "day")).where(F.col("day").between(F.col("first_day"), F.col("last_day")))
    distance = F.least("since", "until")
    inside = distance <= max(windows)
    kind = F.when(~inside | distance.isNull(), "baseline").when((distance == 0) | F.coalesce(F.col("since") == F.col("until"), F.lit(False)), "holiday").when(distance == F.col("until"), "before").otherwise("after")
    return near.select("run", "day", kind.alias("kind"), F.when(inside, distance).cast("bigint").alias("distance"), "year", "events", "known", "canceled", "year_records", "has_data")


def day_classes(bookings: DataFrame, calendar: DataFrame, day: str, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """(day, kind, distance) for every day of the observed span.

    kind is holiday, before, after or baseline; distance is to the nearest holiday. A day as far from a holiday before
    it as from one after it counts as a holiday; beyond the largest window a day is baseline, with a null distance.
    """
    return classified(_per_day(bookings, day, False), calendar, windows).select("day", "kind", "distance")


def usable_days(days: DataFrame) -> DataFrame:
    """(run, day, kind, distance, weekday, events, known, canceled) of classified(): days of years with a calendar; days without records have zeros."""
    usable = days.where("has_data or year_records is null")
    return usable.select("run", "day", "kind", "distance", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("events", "known", "canceled")], (F.weekday("day") + 1).alias("weekday"))


def daily(bookings: DataFrame, calendar: DataFrame, day: str, with_status: bool, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """usable_days() of one run, without run."""
    return usable_days(classified(_per_day(bookings, day, with_status), calendar, windows)).drop("run")


_SUMS = ("days", "events", "known", "canceled")


def tallies(table: DataFrame, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """(run, kind, window_days, weekday, days, events, known, canceled, and base_ of each) of usable_days(): for every group of days a row per weekday, and its total with a null weekday.

    Groups are holidays, each window before and after them (a window given twice is one), and the baseline, which has
    nulls under base_. base_ is the baseline of the same weekday; a total has that of the weekdays that are in the group.
    A weekday's days are summed once, for all groups and the baseline together, and the totals come from the same rows by
    grouping sets, so nothing is joined.
    """
    inside = [("holiday", None), *((k, w) for w in sorted(set(windows)) for k in ("before", "after"))]
    member = lambda k, w: (F.col("kind") == k) & (F.lit(True) if w is None else F.col("distance") <= w)
    sums = lambda test: F.struct(F.count_if(test).alias("days"), *[F.sum(F.when(test, F.col(c)).otherwise(0)).alias(c) for c in _SUMS[1:]])
    groups = [F.struct(F.lit(k).alias("kind"), F.lit(w).cast("int").alias("window_days"), sums(member(k, w)).alias("own")) for k, w in inside]
    per_weekday = table.groupBy("run", "weekday").agg(sums(F.col("kind") == "baseline").alias("base"), F.array(*groups).alias("groups"))
    base = F.struct(F.lit("baseline").alias("kind"), F.lit(None).cast("int").alias("window_days"), F.col("base").alias("own"))
    each = per_weekday.select("run", "weekday", "base", F.explode(F.concat("groups", F.array(base))).alias("g")).where("g.own.days > 0")
    flat = each.select("run", "g.kind", "g.window_days", "weekday", "g.own.*", *[F.when(F.col("g.kind") != "baseline", F.col(f"base.{c}")).alias(f"base_{c}") for c in _SUMS])
    key = [F.col(c) for c in ("run", "kind", "window_days")]
    return flat.groupingSets([[*key, F.col("weekday")], key], *key, F.col("weekday")).agg(*[F.sum(c).alias(c) for c in [*_SUMS, *(f"base_{c}" for c in _SUMS)]])


def _of_one_run(table: DataFrame, windows: tuple[int, ...]) -> DataFrame:
    return tallies(table.withColumn("run", F.lit("")), windows).drop("run")


def by_weekday(table: DataFrame, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """(kind, window_days, weekday, the group's days, events, known, canceled, and the baseline's under base_*), from daily()."""
    return _of_one_run(table, windows).where("kind <> 'baseline' and weekday is not null")


def comparison(table: DataFrame, windows: tuple[int, ...] = WINDOWS, minimum: int = MIN_GROUP_SIZE) -> DataFrame:
    """(kind, window_days, sums, base_ sums, small_sample, base_small_sample): each group against the baseline days of its own weekdays."""
    out = _of_one_run(table, windows).where("kind <> 'baseline' and weekday is null").drop("weekday")
    return out.withColumn("small_sample", is_small(F.col("days"), minimum)).withColumn("base_small_sample", is_small(F.col("base_days"), minimum))


def mean_per_day(events: Column, days: Column) -> Column:
    """Events per day to four places, half to even; null without days."""
    return F.when(days > 0, F.bround(events / days, 4))


def direction_word(minimum: int = MIN_GROUP_SIZE) -> Column:
    """higher, lower or same mean per day than the baseline, over the sums of tallies(); withheld if either side is small."""
    ours, theirs = F.col("events") * F.col("base_days"), F.col("base_events") * F.col("days")
    small = is_small(F.col("days"), minimum) | is_small(F.col("base_days"), minimum)
    return F.when(small, "withheld").when(ours > theirs, "higher").when(ours < theirs, "lower").otherwise("same")


def direction(table: DataFrame, windows: tuple[int, ...] = WINDOWS, minimum: int = MIN_GROUP_SIZE) -> DataFrame:
    """(kind, window_days, direction) of each group of comparison()."""
    return comparison(table, windows, minimum).select("kind", "window_days", direction_word(minimum).alias("direction"))


def years_covered(days: DataFrame) -> DataFrame:
    """(run, year, has_data, records, days) of classified(): every year in the data, with its records and its days inside the span."""
    return days.where("year_records is not null").groupBy("run", "year").agg(F.bool_or("has_data").alias("has_data"), F.max("year_records").alias("records"), F.count("*").alias("days"))


def coverage(bookings: DataFrame, calendar: DataFrame, day: str) -> DataFrame:
    """years_covered() of one run."""
    return years_covered(classified(_per_day(bookings, day, False), calendar)).drop("run")


def baseline(table: DataFrame, minimum: int = MIN_GROUP_SIZE) -> DataFrame:
    """One row of sums over all baseline days."""
    out = _of_one_run(table, WINDOWS).where("kind = 'baseline' and weekday is null").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _SUMS])
    return out.withColumn("small_sample", is_small(F.col("days"), minimum))


def listing(years: DataFrame, calendar: DataFrame) -> DataFrame:
    """(year, status, reason, holidays): the calendar of each requested year, or why there is none. years has one column year."""
    days = calendar.groupBy(F.year("date").alias("year")).agg(F.sort_array(F.collect_list(F.struct("date", "name"))).alias("holidays"))
    has = F.col("holidays").isNotNull()
    return years.join(days, "year", "left").select("year", F.when(has, "available").otherwise("unavailable").alias("status"), F.when(~has, "NO_CALENDAR_DATA").alias("reason"), "holidays")


def weekday_name(number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, WEEKDAYS)), number)
