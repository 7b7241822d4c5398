"""All registered queries of the reservation analytics, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions.columns import STAY_BUCKETS
from tallyhouse.operators import cancellations, findings, guest_mix, holidays, lead_time, parsing, quality, results, room_value, seasonality, sentences, text_audit, views
from tallyhouse.operators.figures import valid
from tallyhouse.plans import oracles as o
from tallyhouse.plans.registry import BOTH_DATES, ORACLES, on_bookings, on_history, on_lines, query, with_calendar
from tallyhouse.sources import arrays, bookings, raw

# ---- lead times

on_bookings("lead_time_overall", o.lead_time("'all'"), lambda b: lead_time.distribution(b))
for _name, _split, _field in (("status", "by_cancellation_status", "is_canceled"), ("month", "by_arrival_month", "arrival_date"), ("segment", "by_market_segment", "market_segment"), ("customer", "by_customer_type", "customer_type")):
    _label = {"is_canceled": "CASE WHEN is_canceled THEN 'canceled' ELSE 'not_canceled' END", "arrival_date": o.MONTH.format("arrival_date")}.get(_field, _field)
    on_bookings(f"lead_time_by_{_name}", o.lead_time(_label, f"AND {_field} IS NOT NULL", _name == "month"), lambda b, s=_split: lead_time.distribution(b, s))
on_bookings(
    "lead_time_date_comparison",
    f"WITH {o.BOOKINGS}, r AS (SELECT * FROM b WHERE lead_time IS NOT NULL AND booking_date IS NOT NULL AND arrival_date IS NOT NULL) SELECT 'differs_from_supplied' AS group_label, count(*) FILTER (WHERE arrival_date - booking_date <> lead_time) AS numerator, count(*) AS denominator, count(*) < 30 AS small_sample FROM r",
    lead_time.date_comparison,
)

# ---- cancellations

on_bookings("cancel_overall", f"WITH {o.BOOKINGS} SELECT 'all' AS group_label, count(*) FILTER (WHERE is_canceled) AS numerator, count(*) AS denominator, count(*) < 30 AS small_sample FROM b WHERE is_canceled IS NOT NULL", cancellations.overall)
for _split in o.SPLITS:
    on_bookings(f"cancel_{_split}", o.cancel_split(_split), lambda b, s=_split: cancellations.split(b, s))
on_bookings(
    "cancel_all_splits",
    " UNION ALL ".join(f"SELECT '{s}' AS split, group_label, numerator, denominator, small_sample FROM ({o.cancel_split(s)})" for s in o.SPLITS),
    cancellations.all_splits,
)

# ---- seasonality

for _side, _day in BOTH_DATES.items():
    for _grain in ("month", "week"):
        on_bookings(f"season_{_side}s_{_grain}ly", o.season(_day, _grain), lambda b, d=_day, g=_grain: seasonality.series(b, d, g))
_YEARS = "SELECT '{0}' AS side, year, months_present FROM (SELECT CAST(year({1}) AS INTEGER) AS year, count(DISTINCT month({1})) AS months_present FROM b WHERE {1} IS NOT NULL GROUP BY 1) WHERE months_present < 12"
on_bookings(
    "incomplete_years",
    f"WITH {o.BOOKINGS} " + " UNION ALL ".join(_YEARS.format(s, d) for s, d in BOTH_DATES.items()),
    lambda b: seasonality.incomplete_years(b, "booking_date").withColumn("side", F.lit("booking")).unionByName(seasonality.incomplete_years(b, "arrival_date").withColumn("side", F.lit("arrival"))),
)
on_bookings(
    "season_summary",
    f"""WITH m AS ({o.season("arrival_date", "month")}), w AS ({o.season("arrival_date", "week")}), x AS (WITH {o.BOOKINGS} SELECT count(*) AS records, min(arrival_date) AS first_day, max(arrival_date) AS last_day FROM b WHERE arrival_date IS NOT NULL)
SELECT x.*, (SELECT count(*) FROM m) AS months, (SELECT count(*) FROM w) AS weeks, (SELECT count(*) FROM m WHERE partial_period) + (SELECT count(*) FROM w WHERE partial_period) AS partial_periods FROM x""",
    lambda b: seasonality.summary(b, "arrival_date"),
)

# ---- stays and value

_NIGHTS = f"WITH {o.BOOKINGS}, r AS (SELECT *, stays_in_weekend_nights + stays_in_week_nights AS nights FROM b WHERE stays_in_weekend_nights IS NOT NULL)"
_BUCKET = "CASE WHEN nights IN (1, 2, 3) THEN CAST(nights AS VARCHAR) WHEN nights BETWEEN 4 AND 7 THEN '4-7' WHEN nights >= 8 THEN '8+' END"
on_bookings(
    "stay_length",
    f"""{_NIGHTS}, k AS (SELECT unnest({[x for x, _, _ in STAY_BUCKETS]!r}) AS g), n AS (SELECT {_BUCKET} AS g, count(*) AS n FROM r GROUP BY 1)
SELECT k.g AS group_label, coalesce(n, 0) AS numerator, (SELECT count(*) FROM r WHERE nights >= 1) AS denominator, coalesce(n, 0) < 30 AS small_sample, (SELECT CAST(sum(nights) AS BIGINT) FROM r) AS total_nights, (SELECT count(*) FROM r WHERE nights < 1) AS zero_night_records FROM k LEFT JOIN n ON k.g = n.g""",
    room_value.stay_lengths,
)
_VALUE = f"""{_NIGHTS}, p AS (SELECT *, CASE WHEN is_canceled THEN 'canceled' WHEN NOT is_canceled THEN 'not_canceled' ELSE 'cancellation_status_unknown' END AS g FROM r WHERE nights >= 1 AND cents IS NOT NULL),
s AS (SELECT g, count(*) AS n, CAST(sum(cents * nights) AS BIGINT) AS t, count(*) FILTER (WHERE cents = 0) AS z FROM p GROUP BY g)"""
_TOTAL = o.plain("(CAST(t // 100 AS VARCHAR) || '.' || lpad(CAST(t % 100 AS VARCHAR), 2, '0'))")
_VALUES = f"SELECT g AS group_label, n AS numerator, (SELECT count(*) FROM p) AS denominator, n < 30 AS small_sample, {_TOTAL} AS total, {o.mean4('t', 'n', 100)} AS mean, z AS zero_price_records FROM s"
on_bookings("room_value", f"{_VALUE} {_VALUES}", room_value.values)

# ---- guest mix

for _attribute, (_label, _where) in o.MIX.items():
    on_bookings(f"guest_mix_{_attribute}", o.guest_mix(_label, _where), lambda b, a=_attribute: guest_mix.distribution(b, a))

# ---- holidays

with_calendar("holiday_day_classes", o.days("arrival_date", True) + "SELECT day, kind, distance FROM classes", lambda b, c: holidays.day_classes(b, c, "arrival_date"))
with_calendar("holiday_daily", o.days("arrival_date", True) + "SELECT day, kind, distance, CAST(weekday AS INTEGER) AS weekday, events, known, CAST(canceled AS BIGINT) AS canceled FROM daily", lambda b, c: holidays.daily(b, c, "arrival_date", True))
for _side, _day in BOTH_DATES.items():
    with_calendar(f"holiday_comparison_{_side}", o.comparison(_day, _side == "arrival"), lambda b, c, d=_day, s=_side: holidays.comparison(holidays.daily(b, c, d, s == "arrival")))
with_calendar(
    "holiday_by_weekday",
    o.days("arrival_date", True) + f"SELECT kind, CAST(window_days AS INTEGER) AS window_days, CASE weekday WHEN 1 THEN 'Monday' WHEN 2 THEN 'Tuesday' WHEN 3 THEN 'Wednesday' WHEN 4 THEN 'Thursday' WHEN 5 THEN 'Friday' WHEN 6 THEN 'Saturday' ELSE 'Sunday' END AS weekday, {o._SUMS} FROM byday",
    lambda b, c: holidays.by_weekday(holidays.daily(b, c, "arrival_date", True)).withColumn("weekday", holidays.weekday_name(F.col("weekday"))),
)
with_calendar(
    "holiday_statement",
    o.days("booking_date", False) + "SELECT kind, CAST(window_days AS INTEGER) AS window_days, CASE WHEN days < 30 OR base_days < 30 THEN 'withheld' WHEN events * base_days > base_events * days THEN 'higher' WHEN events * base_days < base_events * days THEN 'lower' ELSE 'same' END AS direction FROM cmp",
    lambda b, c: holidays.direction(holidays.daily(b, c, "booking_date", False)),
)
with_calendar(
    "holiday_coverage",
    o.days("arrival_date", True) + "SELECT CAST(y AS INTEGER) AS year, has_data, records, (SELECT count(*) FROM spine WHERE year(day) = y) AS days FROM yr",
    lambda b, c: holidays.coverage(b, c, "arrival_date"),
)
with_calendar(
    "holiday_baseline",
    o.days("arrival_date", True) + "SELECT count(*) AS days, CAST(sum(events) AS BIGINT) AS events, CAST(sum(known) AS BIGINT) AS known, CAST(sum(canceled) AS BIGINT) AS canceled, count(*) < 30 AS small_sample FROM daily WHERE kind = 'baseline'",
    lambda b, c: holidays.baseline(holidays.daily(b, c, "arrival_date", True)),
)


@query(
    "holiday_listing",
    f"""WITH {o.CALENDAR}, y AS (SELECT DISTINCT CAST(year(CAST(o_orderdate AS DATE)) AS INTEGER) + 1 AS year FROM orders UNION SELECT DISTINCT CAST(year(CAST(o_orderdate AS DATE)) AS INTEGER) FROM orders),
n AS (SELECT year(h) AS year, string_agg(strftime(h, '%Y-%m-%d'), ',' ORDER BY h) AS holidays FROM cal GROUP BY 1)
SELECT y.year, CASE WHEN holidays IS NULL THEN 'unavailable' ELSE 'available' END AS status, CASE WHEN holidays IS NULL THEN 'NO_CALENDAR_DATA' END AS reason, holidays FROM y LEFT JOIN n USING (year)""",
)
def _holiday_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing of every year with orders and the year after."""
    years = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.explode(F.array(F.year("o_orderdate"), F.year("o_orderdate") + 1)).alias("year")).distinct()
    return holidays.listing(years, bookings.calendar(spark)).withColumn("holidays", F.array_join(F.transform("holidays", lambda h: h["date"].cast("string")), ","))


# ---- typed parsing

for _name, _field in (("text", "meal"), ("identifier", "agent"), ("integer", "lead_time"), ("boolean", "is_canceled"), ("date", "arrival_date"), ("decimal", "price_per_night")):

    def _typed(lines: DataFrame, field: str = _field) -> DataFrame:
        value, missing, invalid = parsing.cell(F.try_parse_json("line"), field, F.col("line"))
        return lines.select("position", value.alias("value"), missing.alias("missing"), invalid.alias("invalid"))

    on_lines(f"typed_{_name}", o.typed(_field), _typed)


def _flat(parsed: DataFrame) -> DataFrame:
    return parsed.select("position", *o.SOME, F.array_join("missing_fields", ",").alias("missing_fields"), F.array_join("invalid_fields", ",").alias("invalid_fields"))


on_lines("parse_records", f"WITH {o.LINES} {o.RECORDS}", lambda x: _flat(parsing.parse_json(x)))
on_lines("valid_records", f"WITH {o.LINES} SELECT position FROM ({o.RECORDS}) WHERE lead_time IS NOT NULL AND is_canceled IS NOT NULL", lambda x: valid(parsing.parse_json(x), "lead_time", "is_canceled").select("position"))
on_lines("unknown_fields", f"WITH {o.LINES} SELECT DISTINCT field FROM (SELECT unnest(json_keys(j)) AS field FROM raw WHERE json_type(j) = 'OBJECT') WHERE field NOT IN ({', '.join(repr(f) for f in bookings.FIELDS)})", parsing.unknown_fields)
on_lines("load_issues", f"WITH {o.LINES} SELECT position, CASE WHEN j IS NULL THEN 'RECORD_INVALID_JSON' ELSE 'RECORD_NOT_OBJECT' END AS code FROM raw WHERE trim(line) <> '' AND (j IS NULL OR json_type(j) <> 'OBJECT')", parsing.load_issues)
on_lines("quality_fields", f"WITH {o.LINES}, {o.COUNTS} SELECT * FROM fc", lambda x: quality.field_counts(parsing.parse_json(x)))
on_lines("usable_fields", f"WITH {o.LINES}, {o.COUNTS} SELECT field, valid FROM fc WHERE valid > 0", lambda x: quality.usable_fields(parsing.parse_json(x)))
on_lines("analysis_availability", o.availability(), lambda x: quality.availability(parsing.parse_json(x)).withColumn("missing_fields", F.array_join("missing_fields", ",")))
on_lines(
    "result_status",
    f"WITH {o.LINES}, {o.COUNTS}, v AS ({o.availability()}) SELECT 'completed_with_warnings' AS status, (SELECT count(*) FROM v WHERE status = 'unavailable') AS unavailable, (SELECT CAST(sum(invalid) AS BIGINT) FROM fc) AS invalid",
    lambda x: quality.result_status(parsing.parse_json(x)),
)
on_bookings("duplicate_ids", f"WITH {o.BOOKINGS} SELECT count(booking_id) - count(DISTINCT booking_id) AS duplicates FROM b", quality.duplicate_ids)
on_lines(
    "quality_summary",
    f"""WITH {o.LINES}, p AS ({o.RECORDS}), {o.COUNTS} SELECT count(*) AS records, CAST(NULL AS DATE) AS first_booking, CAST(NULL AS DATE) AS last_booking, min(arrival_date) AS first_arrival, max(arrival_date) AS last_arrival,
count(*) FILTER (WHERE price_per_night = 0) AS zero_prices, (SELECT CAST(sum(missing) AS BIGINT) FROM fc) AS missing_cells, (SELECT CAST(sum(invalid) AS BIGINT) FROM fc) AS invalid_cells, count(booking_id) - count(DISTINCT booking_id) AS duplicates FROM p""",
    lambda x: quality.summary(parsing.parse_json(x)),
)


@query("scan_json_records", f"WITH {o.LINES} SELECT {', '.join(o.SOME)} FROM ({o.RECORDS})")
def _scan_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw lines through a text file and back."""
    path = raw.scratch(spark, "json-lines")
    raw.json_lines(spark, sf_dir).select("line").write.text(path)
    return parsing.parse_json(parsing.read_json_lines(spark, path)).select(*o.SOME)


def _csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = raw.scratch(spark, "csv")
    rows = F.split("line", ";")
    names = raw.CSV_HEADER.split(";")
    raw.csv_lines(spark, sf_dir).select(*[rows[i].alias(n) for i, n in enumerate(names)]).write.option("sep", ";").option("header", True).option("emptyValue", "").csv(path)
    return parsing.read_csv(spark, path)


query("scan_csv_records", f"WITH {o.CSV} SELECT c[1] AS booking_id, nullif(c[2], '') AS is_canceled, nullif(c[3], '') AS lead_time, c[4] AS booking_date, nullif(c[5], '') AS meal, c[6] AS price_per_night, c[7] AS extra FROM cs")(_csv)
query("parse_csv_records", o.CSV_ROWS)(
    lambda spark, sf_dir: parsing.parse_csv(_csv(spark, sf_dir)).select("booking_id", "is_canceled", "lead_time", "booking_date", "meal", "price_per_night", F.array_join("invalid_fields", ",").alias("invalid_fields"))
)


@query("json_array_records", o.ARRAYS)
def _arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The objects of the raw lines, stored as JSON arrays in one file per 100,000 keys, as an export is, and read back by byte ranges."""
    path = raw.scratch(spark, "arrays")
    objects = raw.json_lines(spark, sf_dir).where(F.startswith("line", F.lit("{"))).withColumn("shard", F.floor(F.col("position") / 100000))
    arrays.write_arrays(objects, "shard", path)
    found, _ = arrays.array_objects(spark, path)
    shard = F.regexp_extract("file", r"shard=(\d+)/", 1).cast("bigint")
    return found.select(shard.alias("shard"), "position", "line", F.get_json_object("line", "$.booking_id").cast("bigint").alias("booking_id"))


query("input_fingerprint")(lambda spark, sf_dir: parsing.input_fingerprint(spark, f"{sf_dir}/orders.parquet"))

# ---- results and history

on_history("history_readout", f"WITH {o.HISTORY} SELECT history_id, count(*) FILTER (WHERE is_valid) AS results, count(*) FILTER (WHERE NOT is_valid AND NOT is_blank) AS malformed FROM hist GROUP BY history_id", results.readout_counts)
on_history(
    "history_storable",
    f"WITH {o.HISTORY} SELECT history_id, position, json_extract_string(j, '$.status') AS status FROM hist WHERE is_valid AND json_extract_string(j, '$.status') IN ('completed', 'completed_with_warnings')",
    lambda h: results.storable(results.readout(h).where("is_valid")).select("history_id", "position", "status"),
)
on_history("history_retention", f"WITH {o.HISTORY} SELECT history_id, position, line FROM hist QUALIFY NOT is_valid OR row_number() OVER (PARTITION BY history_id, is_valid ORDER BY position DESC) <= 2", lambda h: results.retain(h, 2))
on_history(
    "history_list",
    f"""WITH {o.HISTORY}, v AS (SELECT *, json_extract_string(j, '$.generated_at') AS generated_at, TRY_CAST(json_extract_string(j, '$.generated_at') AS TIMESTAMPTZ) AS tm FROM hist WHERE is_valid)
SELECT history_id, row_number() OVER (PARTITION BY history_id ORDER BY tm DESC NULLS LAST, position DESC) AS place, position, json_extract_string(j, '$.result_id') AS result_id, generated_at, split_part(json_extract_string(j, '$.schema_version'), '.', 1) = '1' AS supported FROM v""",
    results.listing,
)
on_lines(
    "result_json_failed",
    f"WITH {o.LINES} SELECT position, '{{\"schema_version\":\"1.0\",\"status\":\"failed\",\"error\":{{\"code\":\"' || CASE WHEN j IS NULL THEN 'RECORD_INVALID_JSON' ELSE 'RECORD_NOT_OBJECT' END || '\"}}}}' AS document FROM raw WHERE trim(line) <> '' AND (j IS NULL OR json_type(j) <> 'OBJECT')",
    lambda x: results.failed(parsing.load_issues(x)),
)


def _view(name: str, analysis: str, figures: Callable[[DataFrame], DataFrame], sql: str, extra: tuple[tuple[str, str], ...] = ()) -> None:
    names = ", ".join(n for n, _ in extra)
    text = f"SELECT '{analysis}' AS analysis, group_label AS label, numerator AS records, denominator AS \"of\", {o.share('numerator', 'denominator')} AS share, small_sample{', ' + names if names else ''} FROM ({sql})"
    on_bookings(name, text, lambda b: views.figure_rows(results.document(analysis, figures(b), tuple(n for n, _ in extra)), extra))


_view("view_lead_time", "lead_time", lambda b: lead_time.distribution(b, "by_market_segment"), o.lead_time("market_segment", "AND market_segment IS NOT NULL"), (("median_days", "double"),))
_view("view_seasonality", "seasonality", lambda b: seasonality.series(b, "arrival_date", "month"), o.season("arrival_date", "month"), (("partial_period", "boolean"), ("mean_price", "string")))
_view("view_cancellations", "cancellations", lambda b: cancellations.split(b, "by_arrival_month"), o.cancel_split("by_arrival_month"), (("partial_period", "boolean"),))
_view("view_room_value", "room_value", room_value.values, f"{_VALUE} {_VALUES}", (("total", "string"), ("mean", "string")))
_view("view_guest_mix", "guest_mix", lambda b: guest_mix.distribution(b, "country"), o.guest_mix(*o.MIX["country"]), (("mean_nights", "string"), ("mean_price", "string")))


@query(
    "view_holidays",
    o.days("arrival_date", True) + f"SELECT 'holidays' AS analysis, kind || coalesce('_' || CAST(window_days AS VARCHAR) || '_days', '') AS label, CAST(events AS BIGINT) AS records, CAST(days AS BIGINT) AS \"of\", {o.share('CAST(events AS BIGINT)', 'CAST(days AS BIGINT)')} AS share, days < 30 AS small_sample FROM cmp",
)
def _view_holidays(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = holidays.comparison(holidays.daily(bookings.from_orders(spark, sf_dir), bookings.calendar(spark), "arrival_date", True))
    label = F.concat("kind", F.coalesce(F.concat(F.lit("_"), F.col("window_days").cast("string"), F.lit("_days")), F.lit("")))
    figures = table.select(label.alias("group_label"), F.col("events").alias("numerator"), F.col("days").alias("denominator"), "small_sample")
    return views.figure_rows(results.document("holidays", figures))


on_lines(
    "view_quality",
    f"WITH {o.LINES}, {o.COUNTS} SELECT 'quality' AS analysis, field AS label, valid AS records, records AS \"of\", {o.share('valid', 'records')} AS share, valid < 30 AS small_sample, missing, invalid FROM fc",
    lambda x: views.figure_rows(
        results.document("quality", quality.field_counts(parsing.parse_json(x)).select(F.col("field").alias("group_label"), F.col("valid").alias("numerator"), F.col("records").alias("denominator"), (F.col("valid") < 30).alias("small_sample"), "missing", "invalid"), ("missing", "invalid")),
        (("missing", "bigint"), ("invalid", "bigint")),
    ),
)


def _limitations(b: DataFrame) -> DataFrame:
    none = F.lit(None).cast("boolean").alias("partial_period")
    parts = [
        lead_time.distribution(b, "by_arrival_month").select(F.lit("lead_time").alias("analysis"), "small_sample", "partial_period"),
        seasonality.series(b, "arrival_date", "week").select(F.lit("seasonality").alias("analysis"), "small_sample", "partial_period"),
        guest_mix.distribution(b, "country").select(F.lit("guest_mix").alias("analysis"), "small_sample", none),
    ]
    return views.limitations(parts[0].unionByName(parts[1]).unionByName(parts[2]))


on_bookings(
    "limitations",
    "SELECT analysis, count(*) AS figures, count(*) FILTER (WHERE small_sample) AS small_samples, count(*) FILTER (WHERE partial_period) AS partial_periods FROM ("
    + f"SELECT 'lead_time' AS analysis, small_sample, partial_period FROM ({o.lead_time(o.MONTH.format('arrival_date'), 'AND arrival_date IS NOT NULL', True)}) UNION ALL SELECT 'seasonality', small_sample, partial_period FROM ({o.season('arrival_date', 'week')}) UNION ALL SELECT 'guest_mix', small_sample, NULL FROM ({o.guest_mix(*o.MIX['country'])})) GROUP BY analysis",
    _limitations,
)


@query("limitations_whole")
def _whole_limitations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limitations of every figure of the whole result, and why analyses are unavailable."""
    found = findings.figures(bookings.from_orders(spark, sf_dir, costly=True), bookings.calendar(spark))
    return views.whole_limitations(found, quality.availability(parsing.parse_json(raw.json_lines(spark, sf_dir))))

# ---- sentences and audit


def _sentences(b: DataFrame) -> DataFrame:
    differ = lead_time.date_comparison(b).select(sentences.lead_time_difference(F.col("numerator"), F.col("denominator")).alias("text"))
    median = lead_time.distribution(b, "by_market_segment").select(sentences.lead_time_median(F.col("median_days"), F.col("numerator")).alias("text"))
    value = room_value.values(b).select(sentences.room_value_group(F.col("numerator"), F.col("group_label"), F.col("total"), F.col("mean")).alias("text"))
    split = cancellations.split(b, "by_deposit_type").agg(F.sum("numerator").alias("a"), F.sum("denominator").alias("n")).select(sentences.cancellation_split("by_deposit_type", F.col("a"), F.col("n")).alias("text"))
    omitted = guest_mix.distribution(b, "country").where("small_sample").select(sentences.guest_mix_omitted(F.col("group_label"), F.col("numerator")).alias("text"))
    return differ.unionByName(median).unionByName(value).unionByName(split).unionByName(omitted)


def _printf(template: str, *values: str) -> str:
    """A template as SQL concatenation."""
    parts = [p.replace("'", "''") for p in template.replace("%d", "%s").split("%s")]
    return " || ".join([f"'{parts[0]}'", *(f"CAST({v} AS VARCHAR) || '{p}'" for v, p in zip(values, parts[1:], strict=True))])


_SENTENCES = " UNION ALL ".join(
    [
        f"SELECT {_printf(sentences.LEAD_TIME_DIFFERENCE, 'numerator', 'denominator')} AS text FROM ({ORACLES['lead_time_date_comparison']})",
        f"SELECT {_printf(sentences.LEAD_TIME_MEDIAN, 'CASE WHEN median_days = floor(median_days) THEN CAST(CAST(median_days AS BIGINT) AS VARCHAR) ELSE CAST(median_days AS VARCHAR) END', 'numerator')} FROM ({ORACLES['lead_time_by_segment']})",
        f"SELECT {_printf(sentences.ROOM_VALUE_GROUP, 'numerator', "CASE group_label WHEN 'canceled' THEN 'cancelled' WHEN 'not_canceled' THEN 'not cancelled' ELSE 'cancellation status unknown' END", 'total', 'mean')} FROM ({ORACLES['room_value']})",
        f"SELECT {_printf(sentences.CANCELLATION_SPLIT, 'chr(39)', 'CAST(sum(numerator) AS BIGINT)', 'CAST(sum(denominator) AS BIGINT)').replace('CAST(chr(39) AS VARCHAR)', repr('deposit type'))} FROM ({ORACLES['cancel_by_deposit_type']})",
        f"SELECT {_printf(sentences.GUEST_MIX_OMITTED, 'group_label', 'numerator')} FROM ({ORACLES['guest_mix_country']}) WHERE small_sample",
    ]
)
on_bookings("finding_sentences", _SENTENCES, _sentences)
on_bookings("findings_wording", f"SELECT text, CAST(NULL AS VARCHAR) AS causal_word FROM ({_SENTENCES})", lambda b: text_audit.causal_words(_sentences(b)))


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_audit.check(text_audit.parse(text_audit.facts(raw.answers(spark, sf_dir))))


for _name, _flag in (("structure", "structure"), ("causal", "causal"), ("promise", "promise"), ("figures", "figures_known"), ("sample_size", "sample_size"), ("small_sample", "small_sample"), ("hypothesis", "hypothesis")):
    query(f"audit_{_name}", f"WITH {o.ANSWERS} SELECT answer_id, {_flag} AS holds FROM audit")(lambda spark, sf_dir, f=_flag: _audit(spark, sf_dir).select("answer_id", F.col(f).alias("holds")))
query("audit_verdict", f"WITH {o.ANSWERS} SELECT answer_id, {o.VERDICT} IS NULL AS accepted, {o.VERDICT} AS first_failed_rule FROM audit")(lambda spark, sf_dir: text_audit.verdict(_audit(spark, sf_dir)))
_STATUS = f"WITH {o.ANSWERS}, v AS (SELECT answer_id, {o.VERDICT} AS rule FROM audit) SELECT answer_id, CASE WHEN rule IS NULL THEN 'available' ELSE 'unavailable' END AS status, CASE rule WHEN 'structure' THEN 'BAD_STRUCTURE' ELSE CASE WHEN rule IS NOT NULL THEN 'GUARDRAIL_REJECTED' END END AS reason FROM v"
query("insight_status", _STATUS)(lambda spark, sf_dir: text_audit.insight_status(_audit(spark, sf_dir)))


@query(
    "view_insights",
    f"WITH {o.ANSWERS}, v AS (SELECT answer_id, {o.VERDICT} AS rule FROM audit) SELECT answer_id, CASE WHEN rule IS NULL THEN 'available' ELSE 'unavailable' END AS state, CASE WHEN rule IS NULL THEN g END AS suggestion, CASE WHEN rule IS NULL THEN z END AS sample_size FROM v JOIN a5 USING (answer_id)",
)
def _view_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = text_audit.insight_status(_audit(spark, sf_dir), "suggestions")
    shown = F.explode_outer(F.when(F.col("status") == "available", F.col("suggestions")))
    return rows.select("answer_id", F.col("status").alias("state"), shown.alias("s")).select("answer_id", "state", "s.suggestion", "s.sample_size")


on_bookings(
    "prompt_context",
    "SELECT 'cancellations' AS analysis, '[' || string_agg('{\"group\":\"' || group_label || '\",\"numerator\":' || numerator || ',\"denominator\":' || denominator || ',\"small_sample\":' || small_sample || '}', ',' ORDER BY group_label) || ']' AS context FROM (" + o.cancel_split("by_market_segment") + ")",
    lambda b: text_audit.prompt_context(cancellations.split(b, "by_market_segment").withColumn("analysis", F.lit("cancellations"))),
)
