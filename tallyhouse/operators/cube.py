"""One pass over bookings that all six analyses are made from.

Every booking gives one row for each thing that it is counted under: its days, its attributes, its stay, each with what
it must be told apart by (a day or a number of days or nights). These rows are summed by one aggregation into a small
table, the cube: its size goes with days, groups and lead times, not with bookings. Splits, bands, exact medians,
months, weeks and days around holidays all follow from it. Bookings of several runs are measured side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.functions.columns import (
    BOOKING_CHANGE_CAP, LEAD_TIME_BANDS, MIN_GROUP_SIZE, SPECIAL_REQUEST_CAP, STAY_BUCKETS, band, capped, full_status_label, is_small, mean_half_up, month_bounds, month_key, plain, week_bounds, week_key,
)
from tallyhouse.operators import guest_mix
from tallyhouse.sources.bookings import FIELDS, KINDS
from tallyhouse.sources.raw import table_of

SIDES = {"booking": "booking_date", "arrival": "arrival_date"}
#: The sums of the cube.
SUMS = ("n", "known", "canceled", "priced", "price_total", "zero_prices", "nights_known", "nights_total", "comparable", "differing")


def _keys() -> dict[str, tuple[Column, Column]]:
    """Kind -> (label, number); a booking is counted under a kind where the label, or without one the number, is known."""
    none, lead = F.lit(None), F.col("lead_time")
    days = {side: (none, F.unix_date(day)) for side, day in SIDES.items()}
    nights = F.col("stays_in_weekend_nights") + F.col("stays_in_week_nights")
    own = {"deposit_type": F.col("deposit_type"), "booking_changes": F.col("booking_changes").cast("string")}
    own |= {a: guest_mix.label(a) if a == "total_guests" else F.when(F.col(a).isNotNull(), guest_mix.label(a)) for a in guest_mix.ATTRIBUTES}
    return (
        {"status": (full_status_label(F.col("is_canceled")), lead), "arrival_month": (month_key(F.col("arrival_date")), lead)}
        | {f: (F.col(f), lead) for f in ("market_segment", "customer_type")}
        | {k: (c, none) for k, c in own.items()}
        | days
        | {"stay": (F.when(nights.isNotNull(), full_status_label(F.col("is_canceled"))), nights)}
    )


def measure(bookings: DataFrame, run: Column | None = None) -> DataFrame:
    """(run, kind, label, number, the sums, first_arrival, last_arrival) of all bookings, by run.

    The kinds missing, invalid and unknown count fields of parsed records that are so; without their lists a null is
    missing.
    """
    price, nights = F.col("price_per_night"), F.col("stays_in_weekend_nights") + F.col("stays_in_week_nights")
    gap = F.datediff("arrival_date", "booking_date")
    one = lambda c: F.coalesce(c.cast("bigint"), F.lit(0).cast("bigint"))
    values = {
        "n": F.lit(1).cast("bigint"), "known": one(F.col("is_canceled").isNotNull()), "canceled": one(F.col("is_canceled")), "priced": one(price.isNotNull()), "price_total": price,
        "zero_prices": one(price == 0), "nights_known": one(nights.isNotNull()), "nights_total": nights, "comparable": one(gap.isNotNull() & F.col("lead_time").isNotNull()), "differing": one(gap != F.col("lead_time")),
    }
    keys = [F.struct(F.lit(k).alias("kind"), label.cast("string").alias("label"), number.cast("bigint").alias("number")) for k, (label, number) in _keys().items()]
    listed = [c for c in ("missing", "invalid", "unknown") if f"{c}_fields" in bookings.columns]
    names = {c: F.col(f"{c}_fields") for c in listed}
    if "missing" not in names:
        names["missing"] = F.filter(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in FIELDS]), lambda x: x.isNotNull())
    of = lambda kind, c: F.transform(c, lambda f: F.struct(F.lit(kind).alias("kind"), f.alias("label"), F.lit(None).cast("bigint").alias("number")))
    counted = F.concat(F.array(*keys), *[of(k, c) for k, c in names.items()])
    # a booking's values and keys are made once, outer so that no filter makes them again; keys that it lacks fall away after the explode
    rows = bookings.select((F.lit("") if run is None else run).alias("run"), "arrival_date", *[c.alias(n) for n, c in values.items()], counted.alias("keys"))
    rows = rows.select("run", "arrival_date", *values, F.explode_outer("keys").alias("k")).where(F.col("k.label").isNotNull() | (F.col("k.kind").isin(*SIDES) & F.col("k.number").isNotNull()))
    return rows.groupBy("run", "k.kind", "k.label", "k.number").agg(*[F.sum(c).alias(c) for c in SUMS], F.min("arrival_date").alias("first_arrival"), F.max("arrival_date").alias("last_arrival"))


def measured(bookings: DataFrame, run: Column | None = None) -> DataFrame:
    """measure(), written once, so that whatever is made from it reads the small table and not the bookings.

    The table is dealt out by run: all that follows is grouped by run and more, and needs no other shuffle.
    """
    return table_of(measure(bookings, run), "cube").repartition("run")


def _over(*by: str):
    return Window.partitionBy("run", *by)  # over groups, not bookings


def _small(figures: DataFrame, size: str, minimum: int) -> DataFrame:
    return figures.withColumn("small_sample", is_small(F.col(size), minimum))


def _partial(bounds: tuple[Column, Column]) -> Column:
    return (F.col("first_day") > bounds[0]) | (F.col("last_day") < bounds[1])


def _first_of(month: Column) -> Column:
    return F.to_date(F.concat(month, F.lit("-01")))


def lead_times(cube: DataFrame, minimum: int = MIN_GROUP_SIZE) -> DataFrame:
    """(run, split, group_label, numerator, denominator, small_sample, median_days, band_0.., partial_period) of every split of lead times.

    Medians are exact: the middle of the counts by number of days.
    """
    rows = cube.where("number is not null")
    splits = {"market_segment": "by_market_segment", "customer_type": "by_customer_type", "arrival_month": "by_arrival_month"}
    status = F.array(F.struct(F.lit("overall").alias("split"), F.lit("all").alias("group_label")), F.when(F.col("label") != "cancellation_status_unknown", F.struct(F.lit("by_cancellation_status").alias("split"), F.col("label").alias("group_label"))))
    named = F.array(F.struct(F.element_at(F.create_map(*[F.lit(x) for pair in splits.items() for x in pair]), F.col("kind")).alias("split"), F.col("label").alias("group_label")))
    of_kind = rows.where(F.col("kind").isin("status", *splits)).withColumn("x", F.explode(F.filter(F.when(F.col("kind") == "status", status).otherwise(named), lambda x: x.isNotNull())))
    by_days = of_kind.groupBy("run", "x.split", "x.group_label", "number").agg(F.sum("n").alias("n"), F.min("first_arrival").alias("first_arrival"), F.max("last_arrival").alias("last_arrival"))
    group = _over("split", "group_label")
    by_days = by_days.withColumn("upto", F.sum("n").over(group.orderBy("number"))).withColumn("all", F.sum("n").over(group))
    reached = lambda place: F.min(F.when(F.col("upto") > place, F.col("number")))
    bands = [F.sum(F.when(band(F.col("number"), LEAD_TIME_BANDS) == label, F.col("n")).otherwise(0)).alias(f"band_{i}") for i, (label, _, _) in enumerate(LEAD_TIME_BANDS)]
    median = (reached(F.floor((F.col("all") - 1) / 2)) + reached(F.floor(F.col("all") / 2))) / 2
    out = by_days.groupBy("run", "split", "group_label").agg(F.sum("n").alias("numerator"), median.alias("median_days"), *bands, F.min("first_arrival").alias("a"), F.max("last_arrival").alias("b"))
    split = _over("split")
    out = out.withColumns({"denominator": F.sum("numerator").over(split), "first_day": F.min("a").over(split), "last_day": F.max("b").over(split)})
    partial = F.when(F.col("split") == "by_arrival_month", _partial(month_bounds(_first_of(F.when(F.col("split") == "by_arrival_month", F.col("group_label"))))))
    return _small(out.withColumn("partial_period", partial), "numerator", minimum).drop("a", "b", "first_day", "last_day")


def date_comparison(cube: DataFrame, minimum: int = MIN_GROUP_SIZE) -> DataFrame:
    """(run, group_label, numerator, denominator, small_sample): records whose lead time differs from the days between their dates; no row without such records."""
    out = cube.where("kind = 'status'").groupBy("run").agg(F.sum("differing").alias("numerator"), F.sum("comparable").alias("denominator")).where("denominator > 0")
    return _small(out.withColumn("group_label", F.lit("differs_from_supplied")), "denominator", minimum)


def cancellations(cube: DataFrame, minimum: int = MIN_GROUP_SIZE) -> DataFrame:
    """(run, split, group_label, numerator, denominator, small_sample, records_used, records_left_out, position, partial_period) of every split and overall."""
    label, number = F.col("label"), F.col("number")
    day = F.date_from_unix_date(number.cast("int"))
    parts = {
        "overall": ("status", F.lit("all"), None),
        "by_lead_time_band": ("status", F.when(number.isNotNull(), band(number, LEAD_TIME_BANDS)), [x for x, _, _ in LEAD_TIME_BANDS]),
        "by_special_requests": ("total_of_special_requests", capped(label.cast("bigint"), SPECIAL_REQUEST_CAP), None),
        "by_booking_changes": ("booking_changes", capped(label.cast("bigint"), BOOKING_CHANGE_CAP), None),
        "by_arrival_month": ("arrival", month_key(day), None),
    } | {f"by_{f}": (f, label, None) for f in ("deposit_type", "market_segment", "customer_type")}
    entries = [F.when(F.col("kind") == kind, F.struct(F.lit(split).alias("split"), to.alias("group_label"))) for split, (kind, to, _) in parts.items()]
    kinds = {kind for kind, _, _ in parts.values()}
    rows = cube.where(F.col("kind").isin(*kinds) & (F.col("known") > 0)).withColumn("x", F.explode(F.filter(F.array(*entries), lambda x: x["group_label"].isNotNull())))
    out = rows.groupBy("run", "x.split", "x.group_label").agg(F.sum("canceled").alias("numerator"), F.sum("known").alias("denominator"), F.min(F.when(F.col("kind") == "arrival", day)).alias("a"), F.max(F.when(F.col("kind") == "arrival", day)).alias("b"))
    split = _over("split")
    out = out.withColumns({"records_used": F.sum("denominator").over(split), "records_left_out": F.max(F.when(F.col("split") == "overall", F.col("denominator"))).over(_over()), "first_day": F.min("a").over(split), "last_day": F.max("b").over(split)})
    order = F.coalesce(F.array_position(F.array(*[F.lit(x) for x, _, _ in LEAD_TIME_BANDS]), F.col("group_label")), F.lit(0))
    place = F.row_number().over(split.orderBy(F.when(F.col("split") == "by_lead_time_band", order).otherwise(0), "group_label"))
    partial = F.when(F.col("split") == "by_arrival_month", _partial(month_bounds(_first_of(F.when(F.col("split") == "by_arrival_month", F.col("group_label"))))))
    out = out.withColumns({"records_left_out": F.col("records_left_out") - F.col("records_used"), "position": place.cast("bigint"), "partial_period": partial})
    return _small(out, "denominator", minimum).drop("a", "b", "first_day", "last_day")


def seasons(cube: DataFrame, minimum: int = MIN_GROUP_SIZE) -> DataFrame:
    """(run, side, grain, group_label, numerator, denominator, small_sample, known, canceled, priced, mean_price, partial_period, first_day, last_day, with_status, with_price) of every month and week; the last two say whether any record of the side has a status or price."""
    day = F.date_from_unix_date(F.col("number").cast("int"))
    grains = {"month": (month_key, month_bounds), "week": (week_key, week_bounds)}
    each = F.explode(F.array(*[F.struct(F.lit(g).alias("grain"), key(F.col("day")).alias("group_label")) for g, (key, _) in grains.items()]))
    rows = cube.where(F.col("kind").isin(*SIDES)).withColumn("day", day).select("run", F.col("kind").alias("side"), "day", "n", "known", "canceled", "priced", "price_total", each.alias("x"))
    out = rows.groupBy("run", "side", "x.grain", "x.group_label").agg(
        F.sum("n").alias("numerator"), *[F.sum(c).alias(c) for c in ("known", "canceled", "priced", "price_total")], F.min("day").alias("a"), F.max("day").alias("b")
    )
    series = _over("side", "grain")
    total = lambda c: F.sum(c).over(series)
    out = out.withColumns({"denominator": total("numerator"), "with_status": total("known") > 0, "with_price": total("priced") > 0, "first_day": F.min("a").over(series), "last_day": F.max("b").over(series), "mean_price": mean_half_up(F.col("price_total"), F.col("priced"))})
    partial = F.when(F.col("grain") == "month", _partial(month_bounds(F.col("a")))).otherwise(_partial(week_bounds(F.col("a"))))
    return _small(out.withColumn("partial_period", partial), "numerator", minimum).drop("price_total", "a", "b")


def stay_lengths(cube: DataFrame, minimum: int = MIN_GROUP_SIZE) -> DataFrame:
    """(run, group_label, numerator, denominator, small_sample, total_nights, zero_night_records, records_used): every bucket, empty ones too."""
    nights, n = F.col("number"), F.col("n")
    counted = lambda test: F.sum(F.when(test, n).otherwise(0))
    sums = cube.where("kind = 'stay'").groupBy("run").agg(
        *[counted((nights >= 1) & (band(nights, STAY_BUCKETS) == label)).alias(f"b{i}") for i, (label, _, _) in enumerate(STAY_BUCKETS)],
        counted(nights >= 1).alias("denominator"), F.sum(nights * n).alias("total_nights"), counted(nights < 1).alias("zero_night_records"), F.sum("n").alias("records_used"),
    )
    buckets = F.explode(F.array(*[F.struct(F.lit(label).alias("group_label"), F.col(f"b{i}").alias("numerator")) for i, (label, _, _) in enumerate(STAY_BUCKETS)]))
    return _small(sums.select("run", buckets.alias("b"), "denominator", "total_nights", "zero_night_records", "records_used").select("run", "b.*", "denominator", "total_nights", "zero_night_records", "records_used"), "numerator", minimum)


def values(cube: DataFrame, minimum: int = MIN_GROUP_SIZE) -> DataFrame:
    """(run, group_label, numerator, denominator, small_sample, total, mean, zero_price_records, records_without_price) by cancellation status, never combined."""
    stays = cube.where("kind = 'stay' and number >= 1")
    value = (F.col("price_total").cast("decimal(28,6)") * F.col("number").cast("decimal(9,0)")).cast("decimal(38,6)")
    out = stays.groupBy("run", F.col("label").alias("group_label")).agg(F.sum("priced").alias("numerator"), F.sum(value).cast("decimal(28,6)").alias("sum"), F.sum("zero_prices").alias("zero_price_records"), F.sum("n").alias("stays"))
    out = out.withColumns({"denominator": F.sum("numerator").over(_over()), "records_without_price": F.sum(F.col("stays") - F.col("numerator")).over(_over())}).where("numerator > 0")
    return _small(out.withColumns({"total": plain(F.col("sum")), "mean": mean_half_up(F.col("sum"), F.col("numerator"))}), "numerator", minimum).drop("sum", "stays")


def guests(cube: DataFrame, minimum: int = MIN_GROUP_SIZE) -> DataFrame:
    """(run, attribute, group_label, position, numerator, denominator, small_sample, nights_known, mean_nights, known, canceled, priced, mean_price) of every attribute; position is by the attribute's own type."""
    rows = cube.where(F.col("kind").isin(*guest_mix.ATTRIBUTES)).select("run", F.col("kind").alias("attribute"), F.col("label").alias("group_label"), *SUMS)
    numeric = [a for a in guest_mix.ATTRIBUTES if a == "total_guests" or KINDS[a] == "integer"]
    key = F.when(F.col("attribute").isin(*numeric), F.col("group_label").try_cast("bigint"))
    attribute = _over("attribute")
    out = rows.withColumns({"numerator": F.col("n"), "denominator": F.sum("n").over(attribute), "position": F.row_number().over(attribute.orderBy(key, "group_label")).cast("bigint")})
    out = out.withColumns({"mean_nights": mean_half_up(F.col("nights_total"), F.col("nights_known")), "mean_price": mean_half_up(F.col("price_total"), F.col("priced"))})
    stated = ("nights_known", "mean_nights", "known", "canceled", "priced", "mean_price")
    out = _small(out, "numerator", minimum)
    return out.select("run", "attribute", "group_label", "position", "numerator", "denominator", "small_sample", *[F.when(~F.col("small_sample"), F.col(c)).alias(c) for c in stated])


def per_day(cube: DataFrame, side: str) -> DataFrame:
    """(run, day, events, known, canceled): what holidays.classified() takes; the booking side has no cancellations."""
    shown = lambda c: (F.col(c) if side == "arrival" else F.lit(0).cast("bigint")).alias(c)
    return cube.where(F.col("kind") == side).select("run", F.date_from_unix_date(F.col("number").cast("int")).alias("day"), F.col("n").alias("events"), shown("known"), shown("canceled"))


def field_counts(cube: DataFrame) -> DataFrame:
    """(run, field, missing, invalid, valid, records) of every field, zeros too."""
    n = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0))
    records = cube.groupBy("run").agg(n("status").alias("records"))
    counted = cube.where("kind in ('missing', 'invalid')").groupBy("run", F.col("label").alias("field")).agg(n("missing").alias("missing"), n("invalid").alias("invalid"))
    every = records.withColumn("field", F.explode(F.array(*map(F.lit, FIELDS))))
    out = every.join(counted, ["run", "field"], "left").fillna(0, ["missing", "invalid"])
    return out.select("run", "field", "missing", "invalid", (F.col("records") - F.col("missing") - F.col("invalid")).alias("valid"), "records")
