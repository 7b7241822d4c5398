"""The result of a run as one JSON document: input, quality, status, the findings of six analyses, notices.

Everything comes from one cube of the run's own records, and from one more reading of their ids. Documents of many runs
are made side by side: every step is grouped by run. Documents are put together as text, part by part, so a part that
does not apply is absent.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions.columns import LEAD_TIME_BANDS, MIN_GROUP_SIZE, STAY_BUCKETS
from tallyhouse.operators import cancellations, cube, findings, guest_mix, holidays, lead_time, parsing, quality, sentences
from tallyhouse.operators.cube import SIDES
from tallyhouse.operators.results import SCHEMA_VERSION

#: Notices and reasons of a result.
ESTIMATE = ("ESTIMATE_NOT_REVENUE", "Room value is an estimate (price per night times total nights), not realized revenue.")
UNIT = "price units of the input"
MEASURES = {"booking": "bookings", "arrival": "arrivals"}
GRAINS = {"month": "monthly", "week": "iso_week"}


# ---- JSON as text, by SQL expressions: a document has hundreds of parts, and a text is one expression to build


def constant(value: object) -> str:
    """A value known beforehand, as JSON."""
    text = json.dumps(value, separators=(",", ":"), ensure_ascii=False)
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def string(value: str) -> str:
    """A JSON string; null for null."""
    return f"IF({value} IS NULL, NULL, substr(to_json(array({value})), 2, length(to_json(array({value}))) - 2))"


def number(value: str) -> str:
    return f"CAST({value} AS STRING)"


def listed(items: str) -> str:
    return f"concat('[', array_join({items}, ','), ']')"


def record(**fields: str) -> str:
    """A JSON object of the fields that are not null."""
    return "concat('{', concat_ws(',', " + ", ".join(f"concat('\"{k}\":', {v})" for k, v in fields.items()) + "), '}')"


def small(size: str, minimum: int) -> str:
    return number(f"({size} < {minimum})")


def figure(label: str, numerator: str, denominator: str, is_small: str = "CAST(small_sample AS STRING)") -> str:
    """A figure; label is JSON already."""
    return record(group=label, numerator=number(numerator), denominator=number(denominator), small_sample=is_small)


_LABELLED = figure(string("group_label"), "numerator", "denominator")


def unavailable(reason: str) -> str:
    return constant({"status": "unavailable", "reason": reason})


def _missing(*fields: str) -> str:
    return unavailable("No record holds a valid value in every required field: " + ", ".join(f"'{f}'" for f in fields))


def _or(part: str, default: str) -> str:
    return f"coalesce({part}, {default})"


def _part(name: str) -> str:
    return f"try_element_at(parts, '{name}')"


def _named(words: dict[str, str], key: str) -> str:
    """The word for a key, from a fixed list."""
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in words.items()) + " END"


def _gathered(rows: DataFrame, key: list[str], order: list[str], entry: str, *more: Column) -> DataFrame:
    """(run, key..., entries array<string>, more...): the entries of each part in order; they are groups, not records."""
    ordered = F.expr(f"transform(sort_array(collect_list(struct({', '.join(order)}, entry))), x -> x.entry)").alias("entries")
    return rows.withColumn("entry", F.expr(entry)).groupBy("run", *key).agg(ordered, *more)


def _parts(rows: DataFrame, key: str, part: str) -> DataFrame:
    """(run, parts map<string,string>): JSON by the name of the part."""
    return rows.groupBy("run").agg(F.expr(f"map_from_entries(collect_list(struct({key}, {part})))").alias("parts"))


def _firsts(*columns: str) -> list[Column]:
    return [F.expr(f"first({c})").alias(c) for c in columns]


# ---- the analyses


def lead_time_findings(table: DataFrame, minimum: int) -> DataFrame:
    bands = ", ".join(figure(constant(label), f"band_{i}", "numerator", small(f"band_{i}", minimum)) for i, (label, _, _) in enumerate(LEAD_TIME_BANDS))
    rows = cube.lead_times(table, minimum).withColumn("sentence", sentences.lead_time_median(F.col("median_days"), F.col("numerator")))
    entry = record(
        figure=_LABELLED, median_days="IF(median_days = floor(median_days), CAST(CAST(median_days AS BIGINT) AS STRING), CAST(median_days AS STRING))", bands=listed(f"array({bands})"),
        summary=string("sentence"), partial_period=number("partial_period"),
    )
    splits = _gathered(rows, ["split"], ["group_label"], entry)
    parts = _parts(splits, "split", f"IF(split = 'overall', entries[0], {record(status=constant('available'), groups=listed('entries'))})")
    both = table.where("kind = 'status'").groupBy("run").agg(F.expr("sum(IF(number IS NULL, 0, n))").alias("used"), F.sum("differing").alias("numerator"), F.sum("comparable").alias("denominator"))
    both = both.withColumn("sentence", sentences.lead_time_difference(F.col("numerator"), F.col("denominator")))
    compared = record(
        status=constant("available"), difference_definition=constant("arrival date minus booking date, in days"),
        figure=figure(constant("differs_from_supplied"), "numerator", "denominator", small("denominator", minimum)), summary=string("sentence"),
    )
    body = record(
        unit=constant("days"), bands=constant([x for x, _, _ in LEAD_TIME_BANDS]), records_used=number("used"), overall=_part("overall"),
        splits=record(**{s: _or(_part(s), _missing("lead_time", f)) for s, f in lead_time.SPLIT_FIELDS.items()}),
        date_comparison=f"IF(denominator > 0, {compared}, {_missing('lead_time', *SIDES.values())})",
    )
    return parts.join(both, "run", "left").select("run", F.expr(body).alias("findings"))


def cancellation_findings(table: DataFrame, minimum: int) -> DataFrame:
    entry = f"IF(split = 'overall', {_LABELLED}, {record(figure=_LABELLED, partial_period=number('partial_period'))})"
    sums = [F.sum("numerator").alias("canceled"), *_firsts("records_used", "records_left_out")]
    splits = _gathered(cube.cancellations(table, minimum), ["split"], ["position"], entry, *sums)
    splits = splits.withColumn("sentence", sentences.cancellation_split(F.col("split"), F.col("canceled"), F.col("records_used")))
    whole = record(status=constant("available"), records_used=number("records_used"), records_left_out=number("records_left_out"), groups=listed("entries"), summary=string("sentence"))
    parts = splits.groupBy("run").agg(
        F.expr(f"map_from_entries(collect_list(struct(split, IF(split = 'overall', entries[0], {whole}))))").alias("parts"), F.expr("max(IF(split = 'overall', records_used, NULL))").alias("used")
    )
    body = record(
        note=constant(sentences.CANCELLATION_NOTE), records_used=number("used"), overall=_part("overall"),
        splits=record(**{s: _or(_part(s), _missing("is_canceled", f)) for s, f in cancellations.SPLIT_FIELDS.items()}),
    )
    return parts.select("run", F.expr(body).alias("findings"))


_STATUS_HELD = "No record in the group holds a valid 'is_canceled'."


def _share(minimum: int) -> str:
    """The cancellation share of a group, or why there is none."""
    found = figure(constant("cancellation_share"), "canceled", "known", small("known", minimum))
    return f"IF(known > 0, {found}, {unavailable(_STATUS_HELD)})"


def _mean(value: str, count: str, minimum: int, held: str) -> str:
    """The mean of a group as a decimal string with its count, or why there is none."""
    return f"IF({count} > 0, {record(value=string(value), count=number(count), small_sample=small(count, minimum))}, {unavailable(f'No record in the group holds {held}.')})"


_PRICE_HELD, _NIGHTS_HELD = "a valid 'price_per_night'", "valid night counts"


def seasonality_findings(table: DataFrame, minimum: int) -> DataFrame:
    entry = record(
        figure=_LABELLED, partial_period=number("partial_period"), cancellation=f"IF(with_status, {_share(minimum)}, NULL)",
        mean_price_per_night=f"IF(with_price, {_mean('mean_price', 'priced', minimum, _PRICE_HELD)}, NULL)",
    )
    once = ("denominator", "first_day", "last_day", "with_status", "with_price")
    months = F.expr("collect_list(IF(grain = 'month', left(group_label, 4), NULL))").alias("years")
    series = _gathered(cube.seasons(table, minimum), ["side", "grain"], ["group_label"], entry, *_firsts(*once), months, F.expr("count_if(partial_period)").alias("partials"))
    of = lambda grain, c: F.expr(f"first(IF(grain = '{grain}', {c}, NULL), true)")
    sides = series.groupBy("run", "side").agg(
        *_firsts(*once), F.sum("partials").alias("partial_periods"), of("month", "years").alias("years"), *[of(g, record(periods=listed("entries"))).alias(name) for g, name in GRAINS.items()],
        *[of(g, "size(entries)").alias(f"{g}s") for g in GRAINS], F.expr("first(denominator)").alias("records"),
    )
    sides = sides.withColumn("sentence", sentences.season_summary(F.expr(_named(MEASURES, "side"))))
    incomplete = "transform(filter(transform(array_sort(array_distinct(years)), y -> struct(y AS year, size(filter(years, x -> x = y)) AS months)), y -> y.months < 12), y -> " + record(year=number("CAST(y.year AS INT)"), months_present=number("y.months")) + ")"
    lacks = lambda f: f"CASE side {' '.join(f'WHEN {s!r} THEN {_missing(day, f)}' for s, day in SIDES.items())} END"
    body = record(
        status=constant("available"), measure=string(_named(MEASURES, "side")), date_field=string(_named(SIDES, "side")), span=record(first=string("CAST(first_day AS STRING)"), last=string("CAST(last_day AS STRING)")),
        records_used=number("denominator"), summary=string("sentence"),
        unavailable_parts=record(cancellation_share=f"IF(with_status, NULL, {lacks('is_canceled')})", mean_price_per_night=f"IF(with_price, NULL, {lacks('price_per_night')})"),
        monthly="monthly", iso_week="iso_week", incomplete_years=listed(incomplete),
    )
    whole = record(note=constant(sentences.SEASON_NOTE), **{f"{s}s": _or(_part(s), _missing(f)) for s, f in SIDES.items()})
    return _parts(sides, "side", body).select("run", F.expr(whole).alias("findings"))


def _holiday_side(table: DataFrame, calendar: DataFrame, side: str, windows: tuple[int, ...], minimum: int) -> DataFrame:
    """(run, side JSON) of the runs that have days on this side."""
    days = holidays.classified(cube.per_day(table, side), calendar, windows)
    sums = holidays.tallies(holidays.usable_days(days), windows).withColumn("name", findings.group_name())
    statement = sentences.holiday_comparison(MEASURES[side], F.col("kind"), F.col("window_days"), holidays.direction_word(minimum), F.try_divide("events", "days"), F.try_divide("base_events", "base_days"))
    means = {f"{p}mean": holidays.mean_per_day(F.col(f"{p}events"), F.col(f"{p}days")) for p in ("", "base_")}
    sums = sums.withColumns({"sentence": statement, "day_name": holidays.weekday_name(F.col("weekday"))} | means)
    share = lambda p: {"cancellation_share": figure(constant("cancellation_share"), f"{p}canceled", f"{p}known", small(f"{p}known", minimum))} if side == "arrival" else {}
    block = lambda label, p: record(figure=figure(label, f"{p}events", f"{p}days", small(f"{p}days", minimum)), mean_per_day=number(f"{p}mean"), **share(p))
    base_name = f"IF(weekday IS NULL, {constant('baseline_same_weekdays')}, {constant('baseline')})"
    sums = sums.withColumns({"own": F.expr(block(string("name"), "")), "base": F.expr(block(base_name, "base_"))})
    total = record(group="own", baseline_same_weekdays="base", statement=string("sentence"))
    per_weekday = record(weekday=string("day_name"), group="own", baseline="base")
    entry = f"CASE WHEN kind = 'baseline' THEN own WHEN weekday IS NULL THEN {total} ELSE {per_weekday} END"
    groups = _gathered(sums, ["name"], ["weekday"], entry)  # the total is first, as its weekday is null
    parts = _parts(groups, "name", f"IF(name = 'baseline', entries[0], concat(left(entries[0], length(entries[0]) - 1), ',\"by_weekday\":', {listed('slice(entries, 2, size(entries))')}, '}}'))")
    nothing = lambda label: {"group": label, "numerator": 0, "denominator": 0, "small_sample": True}
    empty = lambda label: {"figure": nothing(label)} | ({"cancellation_share": nothing("cancellation_share")} if side == "arrival" else {})

    def group(kind: str, window: int | None) -> str:
        name = kind if window is None else f"{kind}_{window}_days"
        subject = sentences.HOLIDAY_ITSELF if window is None else sentences.HOLIDAY_WINDOW % (window, kind)
        none = {"group": empty(name), "baseline_same_weekdays": empty("baseline_same_weekdays"), "statement": sentences.HOLIDAY_WITHHELD % subject, "by_weekday": []}
        head = json.dumps({"day_kind": kind, "window_days": window}, separators=(",", ":"))
        return f"concat('{head[:-1]},', substr({_or(_part(name), constant(none))}, 2))"

    years = days.where("year_records IS NOT NULL").groupBy("run", "year").agg(F.expr("bool_or(has_data)").alias("has_data"), F.max("year_records").alias("records"), F.count("*").alias("days"), F.min("day").alias("a"), F.max("day").alias("z"))
    sum_of = lambda c, test: F.expr(f"sum(IF({test}, {c}, 0))")
    years = years.groupBy("run").agg(
        F.expr("array_sort(collect_list(IF(has_data, year, NULL)))").alias("used"), F.expr("array_sort(collect_list(IF(has_data, NULL, year)))").alias("lacking"), sum_of("records", "has_data").alias("records_used"),
        sum_of("records", "NOT has_data").alias("records_left"), sum_of("days", "NOT has_data").alias("days_left"), F.expr("CAST(min(a) AS STRING)").alias("first"), F.expr("CAST(max(z) AS STRING)").alias("last"),
    )
    text = lambda ys: f"transform({ys}, y -> CAST(y AS STRING))"
    lacking = "transform(lacking, y -> " + record(year=number("y"), status=constant("unavailable"), reason=string("concat('The holiday calendar has no data for ', CAST(y AS STRING), '.')")) + ")"
    body = record(
        status=constant("available"), measure=constant(MEASURES[side]), date_field=constant(SIDES[side]), span=record(first=string("first"), last=string("last")), years_used=listed(text("used")),
        years_unavailable=listed(lacking), records_used=number("records_used"), records_left_out_unavailable_years=number("records_left"), days_left_out_unavailable_years=number("days_left"),
        holiday_days=group("holiday", None), windows=listed("array(" + ", ".join(group(k, w) for w in sorted(set(windows)) for k in ("before", "after")) + ")"), baseline=_or(_part("baseline"), constant(empty("baseline"))),
    )
    reason = f"concat('The holiday calendar has no data for any year in \\'{SIDES[side]}\\': ', array_join({text('lacking')}, ', '))"
    none = record(status=constant("unavailable"), reason=string(reason))
    return years.join(parts, "run", "left").select("run", F.expr("size(used) > 0").alias(f"{side}_works"), F.expr(f"IF(size(used) > 0, {body}, {none})").alias(side))


def holiday_findings(table: DataFrame, calendar: DataFrame, windows: tuple[int, ...], minimum: int) -> DataFrame:
    """(run, findings, reason): reason is set if neither side can be analyzed."""
    sides = [_holiday_side(table, calendar, s, windows, minimum) for s in SIDES]
    body = record(
        calendar=constant("calendar table"), windows_days=constant(sorted(set(windows))), note=constant(sentences.HOLIDAY_NOTE), **{f: _or(s, _missing(f)) for s, f in SIDES.items()}
    )
    works = " OR ".join(f"coalesce({s}_works, false)" for s in SIDES)
    reason = f"IF({works}, NULL, 'No date field could be analyzed against the holiday calendar.')"
    return sides[0].join(sides[1], "run", "full").select("run", F.expr(body).alias("findings"), F.expr(reason).alias("reason"))


def room_value_findings(table: DataFrame, minimum: int) -> DataFrame:
    place = lambda labels: F.expr(f"array_position(array({', '.join(map(repr, labels))}), group_label)")
    buckets = cube.stay_lengths(table, minimum).withColumn("place", place([x for x, _, _ in STAY_BUCKETS]))
    stays = _gathered(buckets, [], ["place"], _LABELLED, *_firsts("denominator", "total_nights", "zero_night_records", "records_used"))
    values = cube.values(table, minimum).withColumns(
        {"place": place(["canceled", "not_canceled", "cancellation_status_unknown"]), "words": sentences.status_words(F.col("group_label")), "sentence": sentences.room_value_group(F.col("numerator"), F.col("group_label"), F.col("total"), F.col("mean"))}
    )
    entry = record(
        figure=_LABELLED, cancellation_status=string("words"), count=number("numerator"), total=string("total"), mean=string("mean"), zero_price_records=number("zero_price_records"), summary=string("sentence")
    )
    sums = [F.expr("first(denominator)").alias("priced"), F.expr("first(records_without_price)").alias("without"), F.sum("zero_price_records").alias("zero"), F.expr("bool_or(group_label = 'cancellation_status_unknown')").alias("unknown")]
    value = _gathered(values, [], ["place"], entry, *sums).withColumnRenamed("entries", "value_entries")
    any_price = table.where("kind = 'status'").groupBy("run").agg(F.sum("priced").alias("any_price"))
    estimated = record(
        status=constant("available"), unit=constant(UNIT), label=constant(sentences.ROOM_VALUE_LABEL), records_used=number("coalesce(priced, 0)"), records_without_price=number("coalesce(without, denominator)"),
        zero_price_records=number("coalesce(zero, 0)"), groups=f"coalesce({listed('value_entries')}, '[]')", note=f"IF(unknown, {constant(sentences.STATUS_UNKNOWN_NOTE)}, NULL)",
    )
    body = record(
        estimate=constant({"notice_code": ESTIMATE[0], "label": sentences.ROOM_VALUE_LABEL, "unit": UNIT}), records_used=number("records_used"), zero_night_records=number("zero_night_records"),
        length_of_stay=record(unit=constant("nights"), records_used=number("denominator"), total_nights=number("total_nights"), buckets=listed("entries")),
        estimated_value=f"IF(any_price = 0, {_missing('price_per_night')}, {estimated})",
    )
    return stays.join(value, "run", "left").join(any_price, "run").select("run", F.expr(body).alias("findings"))


def guest_mix_findings(table: DataFrame, minimum: int) -> DataFrame:
    rows = cube.guests(table, minimum).withColumn("sentence", sentences.guest_mix_omitted(F.col("group_label"), F.col("numerator")))
    omitted = record(status=constant("omitted_small_sample"), statement=string("sentence"))
    stated = record(
        status=constant("available"), mean_length_of_stay=_mean("mean_nights", "nights_known", minimum, _NIGHTS_HELD), cancellation_share=_share(minimum),
        mean_price_per_night=_mean("mean_price", "priced", minimum, _PRICE_HELD),
    )
    groups = _gathered(rows, ["attribute"], ["position"], record(figure=_LABELLED, comparison=f"IF(small_sample, {omitted}, {stated})"), *_firsts("denominator"))
    parts = _parts(groups, "attribute", record(status=constant("available"), records_used=number("denominator"), groups=listed("entries")))
    body = record(note=constant(sentences.GUEST_MIX_NOTE), distributions=record(**{a: _or(_part(a), _missing(*guest_mix.needed(a))) for a in guest_mix.ATTRIBUTES}))
    return parts.select("run", F.expr(body).alias("findings"))


# ---- the whole


def analyses(table: DataFrame, calendar: DataFrame, windows: tuple[int, ...] = holidays.WINDOWS, minimum: int = MIN_GROUP_SIZE) -> DataFrame:
    """(run, analysis, findings, reason) of what each run's records allow; reason where the findings themselves say that an analysis is unavailable."""
    none = F.lit(None).cast("string").alias("reason")
    found = {
        "lead_time": lead_time_findings(table, minimum), "holidays": holiday_findings(table, calendar, windows, minimum), "seasonality": seasonality_findings(table, minimum),
        "cancellations": cancellation_findings(table, minimum), "room_value": room_value_findings(table, minimum), "guest_mix": guest_mix_findings(table, minimum),
    }
    return reduce(DataFrame.unionByName, [x.select("run", F.lit(a).alias("analysis"), "findings", "reason" if "reason" in x.columns else none) for a, x in found.items()])


def quality_part(table: DataFrame, duplicates: DataFrame) -> DataFrame:
    """(run, record_count, invalid, data_quality JSON); duplicates is (run, duplicates)."""
    day = lambda f, side: F.expr(f"CAST(date_from_unix_date(CAST({f}(IF(kind = '{side}', number, NULL)) AS INT)) AS STRING)")
    facts = table.groupBy("run").agg(
        F.expr("sum(IF(kind = 'status', n, 0))").alias("record_count"), F.expr("sum(IF(kind = 'status', zero_prices, 0))").alias("zero_prices"),
        *[day(f, side).alias(f"{word}_{side}") for side in SIDES for word, f in (("earliest", "min"), ("latest", "max"))], F.expr("array_sort(collect_set(IF(kind = 'unknown', label, NULL)))").alias("unknown"),
    )
    pairs = lambda c: F.expr(f"concat('{{', array_join(array_sort(collect_list(concat({string('field')}, ':', CAST({c} AS STRING)))), ','), '}}')").alias(c)
    counted = cube.field_counts(table).groupBy("run").agg(pairs("missing"), pairs("invalid"), F.sum("invalid").alias("invalid_cells"))
    body = record(
        record_count=number("record_count"), **{f"{word}_{side}_date": string(f"{word}_{side}") for side in SIDES for word in ("earliest", "latest")},
        duplicate_booking_id_count=number("coalesce(duplicates, 0)"), missing_counts="missing", invalid_counts="invalid", zero_price_count=number("zero_prices"),
        unknown_fields=listed(f"transform(unknown, f -> {string('f')})"),
    )
    rows = facts.join(counted, "run").join(duplicates, "run", "left")
    return rows.select("run", "record_count", F.col("invalid_cells").alias("invalid"), F.expr(body).alias("data_quality"))


def duplicate_ids(bookings: DataFrame, run: Column) -> DataFrame:
    """(run, duplicates): ids beyond the first of each, by run; a hot id is summed before it moves."""
    per_id = bookings.where("booking_id is not null").groupBy(run.alias("run"), "booking_id").agg(F.count("*").alias("n"))
    return per_id.groupBy("run").agg(F.sum(F.col("n") - 1).alias("duplicates"))


def documents(
    bookings: DataFrame, calendar: DataFrame, runs: DataFrame, run: Column | None = None, notices: tuple[tuple[str, str], ...] = (), windows: tuple[int, ...] = holidays.WINDOWS, minimum: int = MIN_GROUP_SIZE,
) -> DataFrame:
    """(run, result_id, generated_at, status, document): one result document per run that has records.

    bookings are typed records, with missing_fields, invalid_fields and unknown_fields if they were parsed. runs is
    (run, result_id, generated_at, source, reference, content_sha256), one row per run. Input, quality, status and
    analyses of a document come from the records of its run alone. The bookings are read twice: for the cube, and for
    their ids.
    """
    run = F.lit("") if run is None else run
    table = cube.measured(bookings, run)
    quality_ = quality_part(table, duplicate_ids(bookings, run))
    state = quality.assessed(cube.field_counts(table)).select("run", "analysis", F.col("status").alias("own"), F.col("reason").alias("own_reason"))
    parts = state.join(analyses(table, calendar, windows, minimum), ["run", "analysis"], "left")
    fails = "(own = 'unavailable' OR reason IS NOT NULL)"
    body = record(
        status=f"IF({fails}, {constant('unavailable')}, {constant('available')})", reason=string("coalesce(own_reason, reason)"), findings="IF(own = 'unavailable', '{}', coalesce(findings, '{}'))"
    )
    entries = f"concat('{{', array_join(array_sort(collect_list(concat({string('analysis')}, ':', {body}))), ','), '}}')"
    whole = parts.groupBy("run").agg(F.expr(entries).alias("analyses"), F.expr(f"bool_or({fails})").alias("lacking"))
    said = [*notices, ESTIMATE]
    warned = any(code in quality.WARNING_NOTICES for code, _ in said)
    status = F.when(F.col("lacking") | (F.col("invalid") > 0) | F.lit(warned), "completed_with_warnings").otherwise("completed")
    rows = quality_.join(whole, "run").join(runs, "run").withColumn("status", status)
    document = record(
        schema_version=constant(SCHEMA_VERSION), result_id=string("result_id"), generated_at=string("generated_at"), status=string("status"),
        input=record(source=string("source"), reference=string("reference"), record_count=number("record_count"), content_sha256=string("content_sha256")),
        data_quality="data_quality", analyses="analyses", notices=constant([{"code": c, "message": m} for c, m in said]),
    )
    return rows.select("run", "result_id", "generated_at", "status", F.expr(document).alias("document"))


def of_file(
    spark: SparkSession, path: str, calendar: DataFrame, result_id: str, generated_at: str, source: str = "json", notices: tuple[tuple[str, str], ...] = (), windows: tuple[int, ...] = holidays.WINDOWS, minimum: int = MIN_GROUP_SIZE,
) -> DataFrame:
    """documents() of the one run over a file or folder of JSON lines; an input that is refused raises parsing.InputError."""
    records = parsing.load(parsing.read_json_lines(spark, path))
    run = [("", result_id, generated_at, source, path.rstrip("/").rsplit("/", 1)[-1], parsing.input_digest(spark, path))]
    runs = spark.createDataFrame(run, "run string, result_id string, generated_at string, source string, reference string, content_sha256 string")
    return documents(records, calendar, runs, None, notices, windows, minimum)
