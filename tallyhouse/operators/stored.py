"""Tables from stored results, many runs at once.

The input is a table of result documents (result_id, document). Each view takes parts of the documents apart by
exploding their objects and lists in the row's own task, so a history of any length is one narrow job. A part that is
missing or of another shape gives nulls or no rows, never an error: a whole number must be one, a string must be one, a
flag must be true itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions import descent
from tallyhouse.functions.columns import ratio_text, share_text
from tallyhouse.functions.descent import flag, text, whole

NO_REASON = "No reason was recorded."


def _object(value: Column, *path: str) -> Column:
    """A part as map<string,variant>; empty where it is no object."""
    for name in path:
        value = F.try_variant_get(value, f"$.{name}", "variant")
    return F.coalesce(F.try_variant_get(value, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))


def _items(value: Column, *path: str) -> Column:
    """A part as array<variant>; empty where it is no list."""
    for name in path:
        value = F.try_variant_get(value, f"$.{name}", "variant")
    return F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array().cast("array<variant>"))


def _get(value: Column, *path: str) -> Column:
    for name in path:
        value = F.try_variant_get(value, f"$.{name}", "variant")
    return value


def _records(results: DataFrame) -> DataFrame:
    return results.select("result_id", F.try_parse_json("document").alias("doc"))


def _findings(results: DataFrame, analysis: str) -> DataFrame:
    """(result_id, findings) of the results in which an analysis is available."""
    rows = _records(results).select("result_id", _get(F.col("doc"), "analyses", analysis).alias("entry"))
    return rows.where(F.coalesce(text(F.col("entry"), "status"), F.lit("")) != "unavailable").select("result_id", _get(F.col("entry"), "findings").alias("findings"))


def _is_figure(value: Column) -> Column:
    """Whether a part has the shape of a figure: an object with a numerator, whatever it is."""
    return F.coalesce(F.array_contains(F.map_keys(_object(value)), "numerator"), F.lit(False))


def _figure(value: Column, label: str = "group_label") -> list[Column]:
    """(label, records, of, share, small_sample) of a figure."""
    records, of = whole(value, "numerator"), whole(value, "denominator")
    share = F.when(records.isNull() | of.isNull(), "n/a").otherwise(share_text(records, of))
    return [F.coalesce(text(value, "group"), F.lit("")).alias(label), records.alias("records"), of.alias("of"), share.alias("share"), flag(value, "small_sample").alias("small_sample")]


def _ratio(value: Column) -> Column:
    """numerator of denominator (share) of a figure; n/a where there is none."""
    return F.when(_is_figure(value), ratio_text(whole(value, "numerator"), whole(value, "denominator"))).otherwise("n/a")


def _mean(value: Column) -> Column:
    """value (n=count) of a mean; n/a where there is none."""
    return F.coalesce(F.concat(text(value, "value"), F.lit(" (n="), F.coalesce(whole(value, "count").cast("string"), F.lit("unknown")), F.lit(")")), F.lit("n/a"))


def messages(results: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(result_id, analysis, message): why a result shows nothing of an analysis; null where it does."""
    rows = _records(results).select("result_id", "doc", F.explode(F.array(*map(F.lit, names))).alias("analysis"))
    entry = rows.withColumn("entry", F.try_element_at(_object(F.col("doc"), "analyses"), F.col("analysis")))
    gone = F.size(_object(F.col("entry"))) == 0
    reason = F.when(text(F.col("entry"), "status") == "unavailable", F.concat(F.lit("Not available: "), F.coalesce(text(F.col("entry"), "reason"), F.lit(NO_REASON))))
    nothing = F.when(F.size(_object(F.col("entry"), "findings")) == 0, "This analysis has no findings in the selected result.")
    return entry.select("result_id", "analysis", F.when(gone, "This analysis is not part of the selected result.").otherwise(F.coalesce(reason, nothing)).alias("message"))


def quality_fields(results: DataFrame) -> DataFrame:
    """(result_id, field, missing, invalid) of the fields that either map names; a count that is none is 0."""
    rows = _records(results).select("result_id", *[_object(F.col("doc"), "data_quality", f"{c}_counts").alias(c) for c in ("missing", "invalid")])
    rows = rows.withColumn("field", F.explode(F.array_union(F.map_keys("missing"), F.map_keys("invalid"))))
    count = lambda c: F.coalesce(F.when(descent.is_integer(F.try_element_at(c, F.col("field"))), F.try_variant_get(F.try_element_at(c, F.col("field")), "$", "bigint")), F.lit(0)).alias(c)
    return rows.select("result_id", "field", count("missing"), count("invalid"))


def quality_headlines(results: DataFrame) -> DataFrame:
    """(result_id, records, booking_dates, arrival_dates, duplicate_ids, zero_prices, unknown_fields) of every result; null counts are unknown."""
    q = _get(F.col("doc"), "data_quality")
    span = lambda side: F.concat_ws(" to ", *[F.coalesce(text(q, f"{w}_{side}_date"), F.lit("not supplied")) for w in ("earliest", "latest")])
    names = F.filter(F.transform(_items(q, "unknown_fields"), lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))), lambda x: x.isNotNull())
    unknown = F.when(F.size(names) == 0, "none").otherwise(F.array_join(names, ", "))
    return _records(results).select(
        "result_id", whole(q, "record_count").alias("records"), span("booking").alias("booking_dates"), span("arrival").alias("arrival_dates"), whole(q, "duplicate_booking_id_count").alias("duplicate_ids"),
        whole(q, "zero_price_count").alias("zero_prices"), unknown.alias("unknown_fields"),
    )


def quality_remarks(results: DataFrame) -> DataFrame:
    """(result_id, kind, remark): analyses that are unavailable, with their reasons, and notices."""
    gone = F.transform(
        F.filter(F.map_entries(_object(F.col("doc"), "analyses")), lambda e: text(e["value"], "status") == "unavailable"),
        lambda e: F.struct(F.lit("unavailable").alias("kind"), F.concat(e["key"], F.lit(": "), F.coalesce(text(e["value"], "reason"), F.lit(NO_REASON))).alias("remark")),
    )
    said = F.transform(_items(F.col("doc"), "notices"), lambda n: F.struct(F.lit("notice").alias("kind"), F.concat(F.coalesce(text(n, "code"), F.lit("NOTICE")), F.lit(": "), F.coalesce(text(n, "message"), F.lit(""))).alias("remark")))
    return _records(results).select("result_id", F.inline(F.concat(gone, said)))


def _split_groups(results: DataFrame, analysis: str, part: str = "splits", overall: bool = False) -> DataFrame:
    """(result_id, split, entry) of the groups of every split; overall is the findings' own entry of that name."""
    of_split = lambda e: F.transform(F.when(text(e["value"], "status") == "unavailable", F.array().cast("array<variant>")).otherwise(_items(e["value"], "groups")), lambda g: F.struct(e["key"].alias("split"), g.alias("entry")))
    groups = F.flatten(F.transform(F.map_entries(_object(F.col("findings"), part)), of_split))
    if overall:
        groups = F.concat(F.array(F.struct(F.lit("overall").alias("split"), _get(F.col("findings"), "overall").alias("entry"))), groups)
    return _findings(results, analysis).select("result_id", F.inline(groups))


def unavailable_parts(results: DataFrame, analysis: str, part: str = "splits") -> DataFrame:
    """(result_id, split, reason) of the splits that a result could not give."""
    gone = F.filter(F.map_entries(_object(F.col("findings"), part)), lambda e: text(e["value"], "status") == "unavailable")
    return _findings(results, analysis).select("result_id", F.inline(F.transform(gone, lambda e: F.struct(e["key"].alias("split"), F.coalesce(text(e["value"], "reason"), F.lit(NO_REASON)).alias("reason")))))


def lead_time(results: DataFrame) -> DataFrame:
    """(result_id, split, group_label, records, of, share, small_sample, median_days, partial_period); median_days as text, so that whole and half days both show."""
    rows = _split_groups(results, "lead_time", overall=True).withColumn("figure", _get(F.col("entry"), "figure")).where(_is_figure(F.col("figure")))
    median = F.try_variant_get("entry", "$.median_days", "variant")
    days = F.when(F.schema_of_variant(median).rlike("^(BIGINT|DECIMAL|DOUBLE)"), F.to_json(median))
    return rows.select("result_id", "split", *_figure(F.col("figure")), days.alias("median_days"), flag(F.col("entry"), "partial_period").alias("partial_period"))


def lead_time_bands(results: DataFrame) -> DataFrame:
    """(result_id, split, group_label, band, records, of, share, small_sample): the bands of each group, of the group."""
    rows = _split_groups(results, "lead_time", overall=True).where(_is_figure(_get(F.col("entry"), "figure")))
    rows = rows.select("result_id", "split", F.coalesce(text(_get(F.col("entry"), "figure"), "group"), F.lit("")).alias("group_label"), F.explode(_items(F.col("entry"), "bands")).alias("b")).where(_is_figure(F.col("b")))
    return rows.select("result_id", "split", "group_label", *_figure(F.col("b"), "band"))


def seasonality(results: DataFrame) -> DataFrame:
    """(result_id, series, grain, period, records, of, share, small_sample, partial_period, cancelled, mean_price) of every period."""
    grains = ("monthly", "iso_week")
    each = [F.struct(F.lit(s).alias("series"), F.lit(g).alias("grain"), _items(F.col("findings"), s, g, "periods").alias("periods")) for s in ("bookings", "arrivals") for g in grains]
    rows = _findings(results, "seasonality").select("result_id", F.inline(F.array(*each))).select("result_id", "series", "grain", F.explode("periods").alias("p"))
    rows = rows.withColumn("figure", _get(F.col("p"), "figure")).where(_is_figure(F.col("figure")))
    return rows.select(
        "result_id", "series", "grain", *_figure(F.col("figure"), "period"), flag(F.col("p"), "partial_period").alias("partial_period"), _ratio(_get(F.col("p"), "cancellation")).alias("cancelled"),
        _mean(_get(F.col("p"), "mean_price_per_night")).alias("mean_price"),
    )


def seasonality_lines(results: DataFrame) -> DataFrame:
    """(result_id, series, line): summary, observed dates, incomplete years, and what is unavailable, of each series."""
    rows = _findings(results, "seasonality").select("result_id", F.explode(F.filter(F.map_entries(_object(F.col("findings"))), lambda e: e["key"].isin("bookings", "arrivals"))).alias("e")).select("result_id", F.col("e.key").alias("series"), F.col("e.value").alias("s"))
    s = F.col("s")
    span = F.concat(F.lit("Observed dates: "), F.coalesce(text(_get(s, "span"), "first"), F.lit("n/a")), F.lit(" to "), F.coalesce(text(_get(s, "span"), "last"), F.lit("n/a")))
    shown = lambda v, n: F.coalesce(whole(v, n).cast("string"), F.lit("unknown"))
    years = F.transform(_items(s, "incomplete_years"), lambda y: F.concat(F.lit("Year "), shown(y, "year"), F.lit(" is incomplete: "), shown(y, "months_present"), F.lit(" months present.")))
    parts = F.transform(F.map_entries(_object(s, "unavailable_parts")), lambda e: F.concat(e["key"], F.lit(": not available - "), F.coalesce(text(e["value"], "reason"), F.lit("no reason was recorded"))))
    gone = F.when(text(s, "status") == "unavailable", F.concat(F.lit("Not available: "), F.coalesce(text(s, "reason"), F.lit(NO_REASON))))
    lines = F.concat(F.array(text(s, "summary"), span), years, parts, F.array(gone))
    return rows.select("result_id", "series", F.explode(F.filter(lines, lambda x: x.isNotNull())).alias("line"))


def _comparisons(results: DataFrame) -> DataFrame:
    """(result_id, side, c): holidays and every window of each side."""
    sides = ("booking_date", "arrival_date")
    windows = lambda s: F.filter(_items(F.col("findings"), s, "windows"), lambda w: whole(w, "window_days").isNotNull())
    own = lambda s: F.filter(F.array(_get(F.col("findings"), s, "holiday_days")), lambda c: F.size(_object(c)) > 0)
    each = [F.struct(F.lit(s).alias("side"), F.concat(own(s), windows(s)).alias("cs")) for s in sides]
    return _findings(results, "holidays").select("result_id", F.inline(F.array(*each))).select("result_id", "side", F.explode("cs").alias("c"))


def _label(c: Column) -> Column:
    window = whole(c, "window_days")
    return F.when(window.isNull(), "On holidays").otherwise(F.concat(window.cast("string"), F.lit("-day window "), F.coalesce(text(c, "day_kind"), F.lit("holiday")), F.lit(" holidays")))


def _days(side: Column, name: str) -> list[Column]:
    """Days, records, mean per day and small sample of a group of days; a mean per day is text, n/a where there is none."""
    own = _get(side, "figure")
    mean = F.try_variant_get(side, "$.mean_per_day", "double")
    return [
        F.when(_is_figure(own), whole(own, "denominator")).alias(f"{name}days"), F.when(_is_figure(own), whole(own, "numerator")).alias(f"{name}records"), mean.alias(f"{name}mean_per_day"),
        (_is_figure(own) & flag(own, "small_sample")).alias(f"{name}small_sample"),
    ]


def holidays(results: DataFrame) -> DataFrame:
    """(result_id, side, comparison, days, records, mean_per_day, small_sample, the baseline's under base_, cancelled, base_cancelled, statement); cancelled is null where a side has none."""
    group, base = _get(F.col("c"), "group"), _get(F.col("c"), "baseline_same_weekdays")
    share = lambda side: F.when(_is_figure(_get(side, "cancellation_share")), _ratio(_get(side, "cancellation_share")))
    return _comparisons(results).select(
        "result_id", "side", _label(F.col("c")).alias("comparison"), *_days(group, ""), *_days(base, "base_"), share(group).alias("cancelled"), share(base).alias("base_cancelled"), text(F.col("c"), "statement").alias("statement")
    )


def holiday_weekdays(results: DataFrame) -> DataFrame:
    """(result_id, side, comparison, weekday, days, records, mean_per_day, small_sample, the baseline's under base_)."""
    rows = _comparisons(results).select("result_id", "side", _label(F.col("c")).alias("comparison"), F.explode(_items(F.col("c"), "by_weekday")).alias("w"))
    return rows.select("result_id", "side", "comparison", F.coalesce(text(F.col("w"), "weekday"), F.lit("?")).alias("weekday"), *_days(_get(F.col("w"), "group"), ""), *_days(_get(F.col("w"), "baseline"), "base_"))


def holiday_coverage(results: DataFrame) -> DataFrame:
    """(result_id, side, observed, years_used, years_unavailable, records_used, records_left_out, days_left_out, unavailable) of each side that a result has."""
    rows = _findings(results, "holidays").select("result_id", F.explode(F.filter(F.map_entries(_object(F.col("findings"))), lambda e: e["key"].isin("booking_date", "arrival_date"))).alias("e"))
    rows = rows.select("result_id", F.col("e.key").alias("side"), F.col("e.value").alias("s"))
    s = F.col("s")
    observed = F.concat_ws(" to ", *[F.coalesce(text(_get(s, "span"), w), F.lit("n/a")) for w in ("first", "last")])
    number = lambda v: F.when(descent.is_integer(v), F.try_variant_get(v, "$", "string"))
    years = lambda name, of: F.coalesce(F.nullif(F.array_join(F.transform(_items(s, name), of), ", "), F.lit("")), F.lit("none"))
    lacking = years("years_unavailable", lambda v: F.coalesce(number(v), whole(v, "year").cast("string")))
    return rows.select(
        "result_id", "side", observed.alias("observed"), years("years_used", number).alias("years_used"), lacking.alias("years_unavailable"), whole(s, "records_used").alias("records_used"),
        whole(s, "records_left_out_unavailable_years").alias("records_left_out"), whole(s, "days_left_out_unavailable_years").alias("days_left_out"),
        F.when(text(s, "status") == "unavailable", F.coalesce(text(s, "reason"), F.lit(NO_REASON))).alias("unavailable"),
    )


def cancellations(results: DataFrame) -> DataFrame:
    """(result_id, split, group_label, records, of, share, small_sample, partial_period): all bookings under the split overall, then the groups of every split."""
    rows = _split_groups(results, "cancellations", overall=True)
    rows = rows.withColumn("figure", F.when(F.col("split") == "overall", F.col("entry")).otherwise(_get(F.col("entry"), "figure"))).where(_is_figure(F.col("figure")))
    label, *rest = _figure(F.col("figure"))
    return rows.select("result_id", "split", F.when(F.col("split") == "overall", "All bookings").otherwise(label).alias("group_label"), *rest, flag(F.col("entry"), "partial_period").alias("partial_period"))


def cancellation_splits(results: DataFrame) -> DataFrame:
    """(result_id, split, records_used, records_left_out, summary) of every split that is available."""
    there = F.filter(F.map_entries(_object(F.col("findings"), "splits")), lambda e: F.coalesce(text(e["value"], "status"), F.lit("")) != "unavailable")
    return _findings(results, "cancellations").select("result_id", F.explode(there).alias("e")).select(
        "result_id", F.col("e.key").alias("split"), whole(F.col("e.value"), "records_used").alias("records_used"), whole(F.col("e.value"), "records_left_out").alias("records_left_out"), text(F.col("e.value"), "summary").alias("summary")
    )


def room_value(results: DataFrame) -> DataFrame:
    """(result_id, cancellation_status, total, mean, bookings, of, zero_price_bookings, small_sample): the estimate of each status, never combined."""
    rows = _findings(results, "room_value").select("result_id", F.explode(_items(F.col("findings"), "estimated_value", "groups")).alias("g")).withColumn("figure", _get(F.col("g"), "figure")).where(_is_figure(F.col("figure")))
    g = F.col("g")
    return rows.select(
        "result_id", F.coalesce(text(g, "cancellation_status"), text(F.col("figure"), "group"), F.lit("")).alias("cancellation_status"), F.coalesce(text(g, "total"), F.lit("n/a")).alias("total"),
        F.coalesce(text(g, "mean"), F.lit("n/a")).alias("mean"), whole(g, "count").alias("bookings"), whole(F.col("figure"), "denominator").alias("of"), whole(g, "zero_price_records").alias("zero_price_bookings"),
        flag(F.col("figure"), "small_sample").alias("small_sample"),
    )


def stay_lengths(results: DataFrame) -> DataFrame:
    """(result_id, nights, records, of, share, small_sample): bare figures, or such under the name figure."""
    rows = _findings(results, "room_value").select("result_id", F.explode(_items(F.col("findings"), "length_of_stay", "buckets")).alias("b"))
    rows = rows.withColumn("b", F.when(_is_figure(_get(F.col("b"), "figure")), _get(F.col("b"), "figure")).otherwise(F.col("b"))).where(_is_figure(F.col("b")))
    return rows.select("result_id", *_figure(F.col("b"), "nights"))


def room_value_totals(results: DataFrame) -> DataFrame:
    """(result_id, zero_night_bookings, zero_price_bookings, without_price, total_nights, unit, unavailable) of every result with the analysis."""
    f, value = F.col("findings"), _get(F.col("findings"), "estimated_value")
    return _findings(results, "room_value").where(F.size(_object(f)) > 0).select(
        "result_id", whole(f, "zero_night_records").alias("zero_night_bookings"), whole(value, "zero_price_records").alias("zero_price_bookings"), whole(value, "records_without_price").alias("without_price"),
        whole(_get(f, "length_of_stay"), "total_nights").alias("total_nights"), F.coalesce(text(_get(f, "estimate"), "unit"), F.lit("price units of the input")).alias("unit"),
        F.when(text(value, "status") == "unavailable", F.coalesce(text(value, "reason"), F.lit(NO_REASON))).alias("unavailable"),
    )


#: What a comparison that a result leaves out shows.
OMITTED = "omitted: small sample"


def guest_mix(results: DataFrame) -> DataFrame:
    """(result_id, attribute, group_label, records, of, share, small_sample, mean_nights, cancelled, mean_price, omitted): omitted is the statement of a comparison left out."""
    rows = _split_groups(results, "guest_mix", "distributions").withColumn("figure", _get(F.col("entry"), "figure")).where(_is_figure(F.col("figure")))
    c = _get(F.col("entry"), "comparison")
    given = F.coalesce(text(c, "status") == "available", F.lit(False))
    shown = lambda x: F.when(given, x).otherwise(OMITTED)
    return rows.select(
        "result_id", F.col("split").alias("attribute"), *_figure(F.col("figure")), shown(_mean(_get(c, "mean_length_of_stay"))).alias("mean_nights"), shown(_ratio(_get(c, "cancellation_share"))).alias("cancelled"),
        shown(_mean(_get(c, "mean_price_per_night"))).alias("mean_price"), F.when(~given, text(c, "statement")).alias("omitted"),
    )


def _flagged(value: Column) -> Column:
    return F.coalesce(text(value, "status"), F.lit(""))


def limitations(results: DataFrame) -> DataFrame:
    """(result_id, kind, path, reason, times): what limits the figures of each result.

    One row small_samples and one partial_periods with how often they occur anywhere in the analyses, 0 too, and one row
    unavailable for each path and reason. The walk does not go below a part that is unavailable.
    """
    parts = _records(results).select("result_id", F.to_json(_get(F.col("doc"), "analyses")).alias("json"), _get(F.col("doc"), "analyses").alias("analyses"))
    seen = descent.nodes(F.col("analyses"), F.coalesce(descent.levels(F.col("json")), F.lit(1)), lambda n: _flagged(n["value"]) == "unavailable")
    small = lambda v: flag(v, "small_sample") | (_flagged(v) == "omitted_small_sample")
    rows = parts.select("result_id", F.transform(seen, lambda n: F.struct(n["path"].alias("path"), small(n["value"]).alias("small"), flag(n["value"], "partial_period").alias("partial"), F.when(_flagged(n["value"]) == "unavailable", F.coalesce(text(n["value"], "reason"), F.lit("no reason was recorded"))).alias("reason"))).alias("seen"))
    count = lambda c: F.size(F.filter("seen", lambda n: n[c])).cast("bigint")
    none = F.lit(None).cast("string")
    counted = F.array(*[F.struct(F.lit(kind).alias("kind"), none.alias("path"), none.alias("reason"), count(c).alias("times")) for kind, c in (("small_samples", "small"), ("partial_periods", "partial"))])
    gone = F.array_distinct(F.transform(F.filter("seen", lambda n: n["reason"].isNotNull()), lambda n: F.struct(F.lit("unavailable").alias("kind"), n["path"].alias("path"), n["reason"].alias("reason"), F.lit(1).cast("bigint").alias("times"))))
    return rows.select("result_id", F.inline(F.concat(counted, gone)))


#: Labels longer than this are cut where results are shown to others.
MAX_LABEL = 60


def prompt_data(results: DataFrame, longest: int = MAX_LABEL) -> DataFrame:
    """(result_id, analysis, data): of every analysis that is available, its findings and the counts of quality, as JSON; labels taken from data are cut to longest characters, also inside sentences."""
    rows = _records(results).select("result_id", _get(F.col("doc"), "data_quality").alias("q"), F.explode(F.map_entries(_object(F.col("doc"), "analyses"))).alias("e"))
    rows = rows.where(F.coalesce(text(F.col("e.value"), "status"), F.lit("")) != "unavailable").select("result_id", F.col("e.key").alias("analysis"), "q", F.coalesce(F.to_json(_get(F.col("e.value"), "findings")), F.lit("{}")).alias("json"))
    seen = descent.nodes(F.try_parse_json("json"), descent.levels(F.col("json")), lambda n: F.lit(False))
    labels = F.filter(F.transform(seen, lambda n: F.when((n["key"] == "group") & (F.schema_of_variant(n["value"]) == "STRING"), F.try_variant_get(n["value"], "$", "string"))), lambda x: F.length(x) > longest)
    by_length = F.array_sort(F.array_distinct(labels), lambda a, b: F.length(b) - F.length(a))
    inside = lambda x: F.substr(F.to_json(F.array(x)), F.lit(3), F.length(F.to_json(F.array(x))) - 4)  # noqa: E731  a label as it stands in JSON text
    cut = F.aggregate(by_length, F.col("json"), lambda json, x: F.replace(json, inside(x), inside(F.left(x, F.lit(longest)))))
    names = ("record_count", "duplicate_booking_id_count", "zero_price_count", "missing_counts", "invalid_counts")
    counts = F.concat_ws(",", *[F.concat(F.lit(f'"{n}":'), F.to_json(_get(F.col("q"), n))) for n in names])
    data = F.concat(F.lit('{"analysis":"'), F.col("analysis"), F.lit('","findings":'), cut, F.lit(',"data_quality":{'), counts, F.lit("}}"))
    return rows.select("result_id", "analysis", data.alias("data"))
