"""Data quality of typed bookings, and which analyses they allow."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.sources.bookings import FIELDS

#: What each analysis needs: all of the first fields, and one of the second if there are any.
REQUIREMENTS = (
    ("lead_time", ("lead_time",), ()),
    ("holidays", (), ("booking_date", "arrival_date")),
    ("seasonality", (), ("booking_date", "arrival_date")),
    ("cancellations", ("is_canceled",), ()),
    ("room_value", ("stays_in_weekend_nights", "stays_in_week_nights"), ()),
    ("guest_mix", (), ("adults", "children", "babies", "country", "meal", "assigned_room_type", "is_repeated_guest", "required_car_parking_spaces", "total_of_special_requests")),
)
WARNING_NOTICES = ("CONFIG_UNKNOWN_KEYS", "INSIGHTS_UNAVAILABLE")


def field_counts(parsed: DataFrame) -> DataFrame:
    """(field, missing, invalid, valid, records) for every field, zeros too, by one pass over the records.

    Only the cells that are not as they should be are counted one by one; every other cell is a valid one.
    """
    of = lambda kind: F.transform(f"{kind}_fields", lambda f: F.struct(f.alias("field"), F.lit(kind).alias("kind")))
    record = F.array(F.struct(F.lit("").alias("field"), F.lit("record").alias("kind")))
    seen = parsed.select(F.explode(F.concat(record, of("missing"), of("invalid"))).alias("x")).groupBy("x.field").agg(*[F.count_if(F.col("x.kind") == k).alias(k) for k in ("record", "missing", "invalid")])
    # a row per field, so these two steps are over two dozen rows
    all_ = seen.groupBy().agg(F.coalesce(F.sum("record"), F.lit(0)).alias("records"), F.map_from_entries(F.collect_list(F.struct("field", F.struct("missing", "invalid")))).alias("counts"))
    rows = all_.select("records", "counts", F.explode(F.array(*map(F.lit, FIELDS))).alias("field"))
    count = lambda kind: F.coalesce(F.try_element_at("counts", F.col("field"))[kind], F.lit(0).cast("bigint"))
    return rows.select("field", count("missing").alias("missing"), count("invalid").alias("invalid"), (F.col("records") - count("missing") - count("invalid")).alias("valid"), "records")


def duplicate_ids(df: DataFrame) -> DataFrame:
    """(duplicates): ids beyond the first of each. Counted by id in two steps, so that a hot id is summed before it moves."""
    per_id = df.where("booking_id is not null").groupBy("booking_id").agg(F.count("*").alias("n"))
    return per_id.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def summary(parsed: DataFrame) -> DataFrame:
    """One row: records, date spans, duplicate ids, zero prices, missing and invalid cells. One pass: sums by id, then over all."""
    days = {"booking": "booking_date", "arrival": "arrival_date"}
    per_id = parsed.groupBy("booking_id").agg(
        F.count("*").alias("n"), *[f(day).alias(f"{word}_{name}") for name, day in days.items() for word, f in (("first", F.min), ("last", F.max))],
        F.count_if(F.col("price_per_night") == 0).alias("zero"), F.sum(F.size("missing_fields")).alias("missing"), F.sum(F.size("invalid_fields")).alias("invalid"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return per_id.agg(
        total("n").alias("records"), *[f(f"{word}_{name}").alias(f"{word}_{name}") for name in days for word, f in (("first", F.min), ("last", F.max))],
        total("zero").alias("zero_prices"), total("missing").alias("missing_cells"), total("invalid").alias("invalid_cells"),
        total(F.when(F.col("booking_id").isNotNull(), F.col("n") - 1)).alias("duplicates"),
    )


def usable_fields(parsed: DataFrame) -> DataFrame:
    return field_counts(parsed).where("valid > 0").select("field", "valid")


def availability(parsed: DataFrame) -> DataFrame:
    """(analysis, status, reason, missing_fields) of the six analyses, from the counts per field."""
    return _availability(parsed).drop("invalid")


def _availability(parsed: DataFrame) -> DataFrame:
    """availability() with the invalid values of all fields on every row."""
    return assessed(field_counts(parsed).withColumn("run", F.lit(""))).drop("run")


def assessed(counts: DataFrame) -> DataFrame:
    """(run, analysis, status, reason, missing_fields, invalid) of each run's counts per field (run, field, missing, invalid, valid, records); invalid is over all fields."""
    needs = [(a, n, f, kind) for a, all_of, any_of in REQUIREMENTS for kind, fields in ((True, all_of), (False, any_of)) for n, f in enumerate(fields)]
    table = counts.sparkSession.createDataFrame(needs, "analysis string, place int, field string, all_of boolean")
    whole = F.sum("invalid").over(Window.partitionBy("run"))  # over fields
    state = counts.select("run", "field", (F.col("valid") == 0).alias("unusable"), (F.col("missing") == F.col("records")).alias("absent"), whole.alias("invalid"))
    joined = state.join(F.broadcast(table), "field")
    gone = F.sort_array(F.collect_list(F.when(F.col("unusable"), F.struct(~F.col("all_of"), "place", "field", "absent", "all_of"))))
    grouped = joined.groupBy("run", "analysis").agg(F.max("invalid").alias("invalid"), gone.alias("gone"), F.count_if(~F.col("all_of")).alias("options"), F.count_if(~F.col("all_of") & F.col("unusable")).alias("options_gone"))
    required = F.filter("gone", lambda x: x["all_of"])
    unmet = (F.col("options") > 0) & (F.col("options") == F.col("options_gone"))
    fails = (F.size(required) > 0) | unmet
    named = F.when(F.size(required) > 0, required).otherwise(F.filter("gone", lambda x: ~x["all_of"]))
    state_word = F.when(F.forall(named, lambda x: x["absent"]), "missing").otherwise("missing or invalid")
    quoted = F.array_join(F.transform(named, lambda x: F.concat(F.lit("'"), x["field"], F.lit("'"))), ", ")
    one = F.concat(F.lit("Required field is "), state_word, F.lit(": "), quoted)
    every = F.concat(F.lit("At least one of these fields is required and all are "), state_word, F.lit(": "), quoted)
    return grouped.select(
        "run", "analysis", F.when(fails, "unavailable").otherwise("available").alias("status"), F.when(fails, F.when(F.size(required) > 0, one).otherwise(every)).alias("reason"),
        F.transform("gone", lambda x: x["field"]).alias("missing_fields"), "invalid",
    )


def result_status(parsed: DataFrame, notices: tuple[str, ...] = ()) -> DataFrame:
    """(status): completed, or completed_with_warnings if an analysis is unavailable, a value invalid, or a notice warns."""
    out = _availability(parsed).agg(F.count_if(F.col("status") == "unavailable").alias("unavailable"), F.max("invalid").alias("invalid"))
    noticed = any(n in WARNING_NOTICES for n in notices)
    warns = (F.col("unavailable") > 0) | (F.col("invalid") > 0) | F.lit(noticed)
    return out.select(F.when(warns, "completed_with_warnings").otherwise("completed").alias("status"), "unavailable", "invalid")
