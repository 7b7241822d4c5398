"""Queries over whole results: every split of each analysis, availability by split, and what answers are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.operators import findings, guest_mix, holidays, results, room_value, seasonality, sentences, text_audit, views
from tallyhouse.plans import catalog  # noqa: F401  the queries here are based on those there
from tallyhouse.plans import oracles as o
from tallyhouse.plans.registry import BOTH_DATES, ORACLES, QUERIES, on_bookings, query, with_calendar
from tallyhouse.sources import bookings, raw

# ---- views of every split

_SHARE = "CASE WHEN d > 0 THEN printf('%.1f%%', CAST(n AS DOUBLE) / d * 100) ELSE 'n/a' END"


def _rows(analysis: str, split: str, sql: str, partial: bool = False, label: str = "group_label", counts: tuple[str, str] = ("numerator", "denominator"), small: str = "small_sample") -> str:
    inner = f"SELECT {label} AS label, CAST({counts[0]} AS BIGINT) AS n, CAST({counts[1]} AS BIGINT) AS d, {small} AS small_sample, {'partial_period' if partial else 'CAST(NULL AS BOOLEAN)'} AS partial_period FROM ({sql})"
    return f"""SELECT '{analysis}' AS analysis, '{split}' AS split, label, n AS records, d AS "of", {_SHARE} AS share, n || ' of ' || d || ' (' || {_SHARE} || ')' AS ratio, small_sample, partial_period FROM ({inner})"""


_WINDOW = "kind || coalesce('_' || window_days || '_days', '')"
_WEEKDAY = "CASE weekday WHEN 1 THEN 'Monday' WHEN 2 THEN 'Tuesday' WHEN 3 THEN 'Wednesday' WHEN 4 THEN 'Thursday' WHEN 5 THEN 'Friday' WHEN 6 THEN 'Saturday' ELSE 'Sunday' END"


def _holiday_rows(side: str) -> list[str]:
    day, status = BOTH_DATES[side], side == "arrival"
    days = lambda tail: o.days(day, status) + tail
    return [
        _rows("holidays", f"{side}_comparison", o.comparison(day, status), label=_WINDOW, counts=("events", "days")),
        _rows("holidays", f"{side}_by_weekday", days("SELECT kind, window_days, weekday, events, days FROM byday"), label=f"{_WINDOW} || '_' || {_WEEKDAY}", counts=("events", "days"), small="days < 30"),
        _rows("holidays", f"{side}_baseline", days("SELECT sum(events) AS events, count(*) AS days FROM daily WHERE kind = 'baseline'"), label="'baseline'", counts=("events", "days"), small="days < 30"),
    ]


_LEAD = {"overall": "overall", "by_cancellation_status": "by_status", "by_arrival_month": "by_month", "by_market_segment": "by_segment", "by_customer_type": "by_customer", "date_comparison": "date_comparison"}
_TABLES = {
    "lead_time": [_rows("lead_time", s, ORACLES[f"lead_time_{q}"], s == "by_arrival_month") for s, q in _LEAD.items()],
    "cancellations": [_rows("cancellations", s, ORACLES[f"cancel_{s}"], s == "by_arrival_month") for s in ("overall", *o.SPLITS)],
    "seasonality": [_rows("seasonality", f"{side}s_{g}ly", ORACLES[f"season_{side}s_{g}ly"], True) for side in BOTH_DATES for g in ("month", "week")],
    "room_value": [_rows("room_value", "values", ORACLES["room_value"]), _rows("room_value", "stay_lengths", ORACLES["stay_length"])],
    "guest_mix": [_rows("guest_mix", a, ORACLES[f"guest_mix_{a}"]) for a in o.MIX],
    "holidays": [x for side in BOTH_DATES for x in _holiday_rows(side)],
}
for _analysis, _sql in _TABLES.items():
    with_calendar(f"view_whole_{_analysis}", " UNION ALL ".join(_sql), lambda b, c, a=_analysis: views.split_rows(results.documents(findings.figures(b, c, (a,)))))

# ---- order and prices of groups

_INTEGERS = ("total_guests", "required_car_parking_spaces", "total_of_special_requests")
_POSITIONS = " UNION ALL ".join(
    f"SELECT '{a}' AS attribute, group_label, row_number() OVER (ORDER BY {'TRY_CAST(group_label AS BIGINT)' if a in _INTEGERS else 'group_label'}) AS position FROM ({ORACLES[f'guest_mix_{a}']})" for a in o.MIX
)


def _positions(b: DataFrame) -> DataFrame:
    parts = [guest_mix.positions(b, a).select(F.lit(a).alias("attribute"), "group_label", "position") for a in guest_mix.ATTRIBUTES]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


on_bookings("guest_mix_positions", _POSITIONS, _positions)
_STAYS = f"WITH {o.BOOKINGS} SELECT count(*) FILTER (WHERE cents IS NULL) AS records_without_price FROM b WHERE stays_in_weekend_nights + stays_in_week_nights >= 1"
on_bookings(
    "room_value_ordered",
    f"SELECT group_label, numerator, total, mean, list_position(['not_canceled', 'canceled', 'cancellation_status_unknown'], group_label)::BIGINT AS position, w.records_without_price FROM ({ORACLES['room_value']}) v, ({_STAYS}) w",
    lambda b: room_value.ordered_values(b).select("group_label", "numerator", "total", "mean", F.col("position").cast("bigint").alias("position"), "records_without_price"),
)

# ---- availability of splits

#: The fields that the query below takes away.
_TAKEN = ("arrival_date", "price_per_night")


def _part_sql() -> str:
    column = lambda f: "CAST(NULL AS INTEGER)" if f in _TAKEN else f
    rows = []
    for analysis, split, fields, named in findings.needs():
        holds = " AND ".join(f"{column(f)} IS NOT NULL" for f in fields)
        reason = "No record holds a valid value in every required field: " + ", ".join(f"''{f}''" for f in named)
        none = f"count(*) FILTER (WHERE {holds}) = 0"
        rows.append(f"SELECT '{analysis}' AS analysis, '{split}' AS split, CASE WHEN {none} THEN 'unavailable' ELSE 'available' END AS status, CASE WHEN {none} THEN '{reason}' END AS reason FROM b")
    return f"WITH {o.BOOKINGS} " + " UNION ALL ".join(rows)


def _without(b: DataFrame) -> DataFrame:
    """Bookings whose files lack some fields."""
    return b.withColumns({f: F.lit(None).cast(b.schema[f].dataType) for f in _TAKEN})


on_bookings("part_status", _part_sql(), lambda b: findings.part_status(_without(b)))


@query(
    "result_parts",
    f"WITH s AS ({_part_sql()}) SELECT analysis, CASE WHEN bool_and(status = 'unavailable') THEN 'unavailable' ELSE 'available' END AS status, count(*) FILTER (WHERE status = 'unavailable') AS unavailable FROM s GROUP BY analysis",
)
def _result_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the result documents say of bookings without some fields: status and number of unavailable splits of each analysis."""
    b = _without(bookings.from_orders(spark, sf_dir))
    docs = results.documents(findings.figures(b, bookings.calendar(spark)), findings.part_status(b))
    record = F.try_parse_json("doc")
    return docs.select("analysis", F.try_variant_get(record, "$.status", "string").alias("status"), F.size(F.try_variant_get(record, "$.unavailable", "array<variant>")).cast("bigint").alias("unavailable"))


# ---- sentences of holidays and seasons

_MEASURES = {"booking": "bookings", "arrival": "arrivals"}


def _more_sentences(b: DataFrame, c: DataFrame) -> DataFrame:
    parts = []
    for side, day in BOTH_DATES.items():
        table = holidays.daily(b, c, day, False)
        known = holidays.comparison(table).join(holidays.direction(table).withColumnsRenamed({"kind": "k", "window_days": "w"}), (F.col("kind") == F.col("k")) & F.col("window_days").eqNullSafe(F.col("w")))
        text = sentences.holiday_comparison(_MEASURES[side], F.col("kind"), F.col("window_days"), F.col("direction"), F.col("events") / F.col("days"), F.col("base_events") / F.col("base_days"))
        parts += [known.select(text.alias("text")), seasonality.summary(b, day).select(sentences.season_summary(_MEASURES[side]).alias("text"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


with_calendar("finding_sentences_more", None, _more_sentences)

# ---- what answers are checked against


def _flat_facts(found: DataFrame) -> DataFrame:
    text = lambda c: F.array_join(F.array_sort(c), ",")
    return found.select("answer_id", text(F.transform("sizes", lambda x: x.cast("string"))).alias("sizes"), text("figures").alias("figures"))


query("answer_facts", f"WITH {o.FOUND} SELECT answer_id, array_to_string(list_sort(list_distinct(list_transform([c, n, 1, 3, n + 7], lambda x: CAST(x AS VARCHAR)))), ',') AS sizes, array_to_string(list_sort(list_distinct(numbers)), ',') AS figures FROM found")(
    lambda spark, sf_dir: _flat_facts(text_audit.facts(raw.answers(spark, sf_dir)))
)
query("findings_causal_words", f"WITH {o.FOUND} SELECT answer_id, CASE t WHEN 3 THEN 'due to' WHEN 5 THEN 'because,drives' WHEN 6 THEN 'drives' ELSE '' END AS causal_words FROM found")(
    lambda spark, sf_dir: text_audit.finding_words(raw.answers(spark, sf_dir)).select("answer_id", F.array_join("causal_words", ",").alias("causal_words"))
)


query("insight_counts", f"SELECT status, reason, count(*) AS answers FROM ({ORACLES['insight_status']}) GROUP BY ALL")(
    lambda spark, sf_dir: text_audit.status_counts(QUERIES["insight_status"](spark, sf_dir))
)
