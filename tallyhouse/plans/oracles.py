"""DuckDB SQL of the registered queries."""

from __future__ import annotations

from tallyhouse.operators.quality import REQUIREMENTS
from tallyhouse.operators.results import ENVELOPE
from tallyhouse.sources.bookings import CALENDAR_YEARS, FIELDS, HOLIDAYS, KINDS
from tallyhouse.sources.raw import ANSWER, CSV_LINE, HISTORY_LINE, JSON_LINE

BOOKINGS = """
b AS (
  SELECT k, CAST(CASE WHEN k % 97 = 0 AND k > 0 THEN k - 1 ELSE k END AS VARCHAR) AS booking_id,
    CASE WHEN k % 53 <> 0 THEN o_orderstatus = 'F' END AS is_canceled,
    CASE WHEN k % 43 <> 0 THEN lt + CASE WHEN k % 17 = 0 THEN 1 ELSE 0 END END AS lead_time,
    CASE WHEN k % 41 <> 0 THEN d END AS booking_date,
    CASE WHEN k % 47 <> 0 THEN d + CAST(lt AS INTEGER) END AS arrival_date,
    CASE WHEN k % 59 <> 0 THEN k % 3 END AS stays_in_weekend_nights, (k // 3) % 6 AS stays_in_week_nights, 1 + k % 3 AS adults,
    CASE WHEN k % 61 <> 0 THEN CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END END AS children, CASE WHEN k % 11 = 0 THEN 1 ELSE 0 END AS babies,
    CASE WHEN k % 23 <> 0 THEN CASE k % 4 WHEN 0 THEN 'BB' WHEN 1 THEN 'HB' WHEN 2 THEN 'FB' ELSE 'SC' END END AS meal,
    n_name AS country, c_mktsegment AS market_segment, o_orderpriority AS customer_type, k % 10 = 0 AS is_repeated_guest,
    CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END AS previous_cancellations, chr(CAST(65 + k % 8 AS INTEGER)) AS assigned_room_type,
    CASE k % 3 WHEN 0 THEN 'No Deposit' WHEN 1 THEN 'Non Refund' ELSE 'Refundable' END AS deposit_type,
    k % 4 AS booking_changes, k % 5 AS total_of_special_requests, CASE WHEN k % 6 = 0 THEN 1 ELSE 0 END AS required_car_parking_spaces,
    CAST(k % 50 AS VARCHAR) AS agent, 'H1' AS hotel,
    CASE WHEN k % 67 = 0 THEN NULL WHEN k % 89 = 0 THEN 0::BIGINT ELSE CAST(round(o_totalprice * 100) AS BIGINT) % 50000 END AS cents
  FROM (SELECT *, o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, (o_orderkey * 7 + (o_orderkey % 13) * 11) % 260 AS lt
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey))
"""
BAND = "CASE WHEN lead_time <= 7 THEN '0-7' WHEN lead_time <= 30 THEN '8-30' WHEN lead_time <= 90 THEN '31-90' WHEN lead_time <= 180 THEN '91-180' WHEN lead_time > 180 THEN '181+' END"
SPLITS = {
    "by_lead_time_band": (BAND, ["0-7", "8-30", "31-90", "91-180", "181+"]),
    "by_deposit_type": ("deposit_type", None),
    "by_market_segment": ("market_segment", None),
    "by_customer_type": ("customer_type", None),
    "by_arrival_month": ("strftime(arrival_date, '%Y-%m')", None),
    "by_special_requests": ("CASE WHEN total_of_special_requests >= 3 THEN '3+' ELSE CAST(total_of_special_requests AS VARCHAR) END", ["0", "1", "2", "3+"]),
    "by_booking_changes": ("CASE WHEN booking_changes >= 2 THEN '2+' ELSE CAST(booking_changes AS VARCHAR) END", ["0", "1", "2+"]),
}
#: A label of a month or ISO week back to its first and last day.
MONTH_START, MONTH_END = "CAST(g || '-01' AS DATE)", "last_day(CAST(g || '-01' AS DATE))"
MONTH = "strftime({0}, '%Y-%m')"
WEEK = "strftime({0}, '%G-W%V')"


def plain(value: str) -> str:
    return f"CASE WHEN contains({value}, '.') THEN rtrim(rtrim({value}, '0'), '.') ELSE {value} END"


def mean4(total: str, n: str, scale: int = 1) -> str:
    """The mean of integers in units of 1/scale, half up to four places, as a plain string."""
    units = f"(({total}) * {20000 // scale} + ({n})) // (2 * ({n}))"
    text = f"CAST({units} // 10000 AS VARCHAR) || '.' || lpad(CAST({units} % 10000 AS VARCHAR), 4, '0')"
    return f"CASE WHEN ({n}) > 0 THEN {plain(f'({text})')} END"


def share(a: str, n: str) -> str:
    t = f"(({a}) * 2000 + ({n})) // (2 * ({n}))"
    return f"CASE WHEN ({n}) > 0 THEN CAST({t} // 10 AS VARCHAR) || '.' || CAST({t} % 10 AS VARCHAR) || '%' ELSE 'n/a' END"


def cancel_split(name: str) -> str:
    label, order = SPLITS[name]
    place = f"list_position({order!r}, g)" if order else "row_number() OVER (ORDER BY g)"
    extra = f", (SELECT min(arrival_date) FROM r) > {MONTH_START} OR (SELECT max(arrival_date) FROM r) < {MONTH_END} AS partial_period" if name == "by_arrival_month" else ""
    return f"""WITH {BOOKINGS}, r AS (SELECT *, {label} AS g FROM b WHERE is_canceled IS NOT NULL),
s AS (SELECT g, CAST(sum(CAST(is_canceled AS INT)) AS BIGINT) AS numerator, count(*) AS denominator FROM r WHERE g IS NOT NULL GROUP BY g)
SELECT g AS group_label, numerator, denominator, denominator < 30 AS small_sample, CAST((SELECT sum(denominator) FROM s) AS BIGINT) AS records_used,
CAST((SELECT count(*) FROM r WHERE g IS NULL) AS BIGINT) AS records_left_out, CAST({place} AS BIGINT) AS position{extra} FROM s"""


def lead_time(label: str, where: str = "", month: bool = False) -> str:
    bands = ", ".join(f"count(*) FILTER (WHERE {BAND} = '{x}') AS band_{i}" for i, x in enumerate(SPLITS["by_lead_time_band"][1]))
    extra = f", (SELECT min(arrival_date) FROM r) > {MONTH_START} OR (SELECT max(arrival_date) FROM r) < {MONTH_END} AS partial_period" if month else ""
    return f"""WITH {BOOKINGS}, r AS (SELECT *, {label} AS g FROM b WHERE lead_time IS NOT NULL {where})
SELECT g AS group_label, count(*) AS numerator, (SELECT count(*) FROM r) AS denominator, count(*) < 30 AS small_sample, median(lead_time) AS median_days, {bands}{extra} FROM r GROUP BY g"""


def season(day: str, grain: str) -> str:
    label = (MONTH if grain == "month" else WEEK).format(day)
    start, end = ("date_trunc('month', a)", "last_day(a)") if grain == "month" else ("date_trunc('week', a)", "date_trunc('week', a) + INTERVAL 6 DAY")
    return f"""WITH {BOOKINGS}, r AS (SELECT *, {label} AS g FROM b WHERE {day} IS NOT NULL),
s AS (SELECT g, count(*) AS numerator, count(is_canceled) AS known, CAST(coalesce(sum(CAST(is_canceled AS INT)), 0) AS BIGINT) AS canceled, count(cents) AS priced, CAST(sum(cents) AS BIGINT) AS t, min({day}) AS a FROM r GROUP BY g)
SELECT g AS group_label, numerator, (SELECT count(*) FROM r) AS denominator, numerator < 30 AS small_sample, known, canceled, priced, {mean4("t", "priced", 100)} AS mean_price,
(SELECT min({day}) FROM r) > {start} OR (SELECT max({day}) FROM r) < {end} AS partial_period FROM s"""


def guest_mix(label: str, where: str) -> str:
    return f"""WITH {BOOKINGS}, r AS (SELECT *, {label} AS g, stays_in_weekend_nights + stays_in_week_nights AS nights FROM b WHERE {where}),
s AS (SELECT g, count(*) AS n, count(nights) AS nk, CAST(sum(nights) AS BIGINT) AS nt, count(is_canceled) AS k, CAST(coalesce(sum(CAST(is_canceled AS INT)), 0) AS BIGINT) AS c, count(cents) AS p, CAST(sum(cents) AS BIGINT) AS t FROM r GROUP BY g)
SELECT g AS group_label, n AS numerator, (SELECT count(*) FROM r) AS denominator, n < 30 AS small_sample, CASE WHEN n >= 30 THEN nk END AS nights_known, CASE WHEN n >= 30 THEN {mean4("nt", "nk")} END AS mean_nights,
CASE WHEN n >= 30 THEN k END AS known, CASE WHEN n >= 30 THEN c END AS canceled, CASE WHEN n >= 30 THEN p END AS priced, CASE WHEN n >= 30 THEN {mean4("t", "p", 100)} END AS mean_price FROM s"""


MIX = {
    "total_guests": ("CAST(adults + children + babies AS VARCHAR)", "adults + children + babies IS NOT NULL"),
    "country": ("country", "country IS NOT NULL"),
    "meal": ("meal", "meal IS NOT NULL"),
    "assigned_room_type": ("assigned_room_type", "assigned_room_type IS NOT NULL"),
    "is_repeated_guest": ("CASE WHEN is_repeated_guest THEN 'repeated' ELSE 'not_repeated' END", "is_repeated_guest IS NOT NULL"),
    "required_car_parking_spaces": ("CAST(required_car_parking_spaces AS VARCHAR)", "required_car_parking_spaces IS NOT NULL"),
    "total_of_special_requests": ("CAST(total_of_special_requests AS VARCHAR)", "total_of_special_requests IS NOT NULL"),
}

CALENDAR = "cal AS (SELECT make_date(y, m, d) AS h FROM (VALUES " + ", ".join(f"({m}, {d})" for m, d in HOLIDAYS) + f") t(m, d), generate_series({CALENDAR_YEARS.start}, {CALENDAR_YEARS.stop - 1}) s(y))"


def days(day: str, with_status: bool) -> str:
    """CTEs up to daily: classified days with their events."""
    known = "count(is_canceled)" if with_status else "0"
    canceled = "coalesce(sum(CAST(is_canceled AS INT)), 0)" if with_status else "0"
    return f"""WITH {BOOKINGS}, {CALENDAR}, r AS (SELECT *, {day} AS day FROM b WHERE {day} IS NOT NULL),
yr AS (SELECT year(day) AS y, count(*) AS records, year(day) IN (SELECT year(h) FROM cal) AS has_data FROM r GROUP BY ALL),
hol AS (SELECT h FROM cal WHERE year(h) IN (SELECT y FROM yr WHERE has_data)),
spine AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM r), (SELECT max(day) FROM r), INTERVAL 1 DAY)) AS DATE) AS day),
near AS (SELECT day, min(CASE WHEN h <= day THEN day - h END) AS since, min(CASE WHEN h >= day THEN h - day END) AS until FROM spine LEFT JOIN hol ON true GROUP BY day),
dist AS (SELECT *, least(coalesce(since, 9999), coalesce(until, 9999)) AS x FROM near),
classes AS (SELECT day, CASE WHEN x > 7 THEN 'baseline' WHEN x = 0 OR since = until THEN 'holiday' WHEN x = until THEN 'before' ELSE 'after' END AS kind, CASE WHEN x <= 7 THEN CAST(x AS BIGINT) END AS distance FROM dist),
ev AS (SELECT day, count(*) AS events, {known} AS known, {canceled} AS canceled FROM r GROUP BY day),
daily AS (SELECT c.day, kind, distance, isodow(c.day) AS weekday, coalesce(events, 0) AS events, coalesce(known, 0) AS known, coalesce(canceled, 0) AS canceled
  FROM classes c LEFT JOIN ev ON ev.day = c.day WHERE year(c.day) IN (SELECT y FROM yr WHERE has_data)),
g AS (SELECT kind, NULL AS window_days, weekday, events, known, canceled FROM daily WHERE kind = 'holiday'
  UNION ALL SELECT kind, w, weekday, events, known, canceled FROM daily, (VALUES (1), (3), (7)) t(w) WHERE kind IN ('before', 'after') AND distance <= w),
base AS (SELECT weekday, count(*) AS d, sum(events) AS e, sum(known) AS k, sum(canceled) AS c FROM daily WHERE kind = 'baseline' GROUP BY weekday),
bw AS (SELECT kind, window_days, weekday, count(*) AS days, sum(events) AS events, sum(known) AS known, sum(canceled) AS canceled FROM g GROUP BY ALL),
byday AS (SELECT bw.*, coalesce(d, 0) AS base_days, coalesce(e, 0) AS base_events, coalesce(k, 0) AS base_known, coalesce(c, 0) AS base_canceled FROM bw LEFT JOIN base USING (weekday)),
cmp AS (SELECT kind, window_days, sum(days) AS days, sum(events) AS events, sum(known) AS known, sum(canceled) AS canceled, sum(base_days) AS base_days, sum(base_events) AS base_events, sum(base_known) AS base_known, sum(base_canceled) AS base_canceled FROM byday GROUP BY ALL)
"""


_SUMS = ", ".join(f"CAST({p}{c} AS BIGINT) AS {p}{c}" for p in ("", "base_") for c in ("days", "events", "known", "canceled"))


def comparison(day: str, with_status: bool) -> str:
    return days(day, with_status) + f"SELECT kind, CAST(window_days AS INTEGER) AS window_days, {_SUMS}, days < 30 AS small_sample, base_days < 30 AS base_small_sample FROM cmp"


LINES = f"raw AS (SELECT o_orderkey AS position, line, TRY_CAST(CASE WHEN json_valid(line) THEN line END AS JSON) AS j FROM (SELECT o_orderkey, ({JSON_LINE.replace('k %', 'o_orderkey %').replace('cast(k ', 'cast(o_orderkey ')}) AS line FROM orders))"

ARRAYS = f"WITH {LINES} SELECT position // 100000 AS shard, row_number() OVER (PARTITION BY position // 100000 ORDER BY position) - 1 AS position, line, CAST(json_extract_string(j, '$.booking_id') AS BIGINT) AS booking_id FROM raw WHERE json_type(j) = 'OBJECT'"


def json_cell(name: str) -> tuple[str, str]:
    """(value, is missing) of a field of the raw JSON lines."""
    t, x = f"json_type(j, '$.{name}')", f"regexp_replace(json_extract_string(j, '$.{name}'), '^\\s+|\\s+$', '', 'g')"
    value = {
        "text": f"CASE WHEN {t} = 'VARCHAR' AND {x} <> '' THEN {x} END",
        "identifier": f"CASE WHEN {t} IN ('VARCHAR', 'UBIGINT', 'BIGINT') AND {x} <> '' THEN {x} END",
        "integer": f"CASE WHEN {t} = 'UBIGINT' THEN TRY_CAST({x} AS BIGINT) END",
        "boolean": f"CASE WHEN {t} = 'BOOLEAN' OR ({t} = 'UBIGINT' AND {x} IN ('0', '1')) THEN {x} IN ('true', '1') END",
        "date": f"CASE WHEN {t} = 'VARCHAR' AND regexp_full_match({x}, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN TRY_CAST({x} AS DATE) END",
        "decimal": f"CASE WHEN {t} IN ('UBIGINT', 'DOUBLE') AND TRY_CAST({x} AS DOUBLE) >= 0 THEN CAST(TRY_CAST({x} AS DOUBLE) AS DECIMAL(18,6)) END",
    }[KINDS[name]]
    return value, f"coalesce({t} IS NULL OR {t} = 'NULL' OR ({t} = 'VARCHAR' AND {x} = ''), true)"


def typed(name: str) -> str:
    value, missing = json_cell(name)
    return f"WITH {LINES} SELECT position, {value} AS value, {missing} AS missing, NOT {missing} AND {value} IS NULL AS invalid FROM raw"


def _names(which: str) -> str:
    cells = {n: json_cell(n) for n in FIELDS}
    flag = lambda n: cells[n][1] if which == "missing" else f"NOT {cells[n][1]} AND {cells[n][0]} IS NULL"
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {flag(n)} THEN '{n}' END" for n in FIELDS) + ")"


SOME = ("booking_id", "lead_time", "arrival_date", "is_canceled", "price_per_night", "agent", "meal")
RECORDS = "SELECT position, " + ", ".join(f"{json_cell(n)[0]} AS {n}" for n in SOME) + f", {_names('missing')} AS missing_fields, {_names('invalid')} AS invalid_fields FROM raw"

#: Per field of the raw lines: missing, invalid, valid counts.
COUNTS = "fc AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS field, count(*) FILTER (WHERE {json_cell(n)[1]}) AS missing, count(*) FILTER (WHERE NOT {json_cell(n)[1]} AND {json_cell(n)[0]} IS NULL) AS invalid, count({json_cell(n)[0]}) AS valid, count(*) AS records FROM raw" for n in FIELDS
) + ")"

CSV = f"cs AS (SELECT string_split(line, ';') AS c FROM (SELECT ({CSV_LINE.replace('k %', 'o_orderkey %').replace('cast(k ', 'cast(o_orderkey ')}) AS line FROM orders))"
CSV_ROWS = f"""WITH {CSV}, v AS (SELECT c[1] AS booking_id, CASE lower(c[2]) WHEN '1' THEN true WHEN 'true' THEN true WHEN '0' THEN false WHEN 'false' THEN false END AS is_canceled,
CASE WHEN regexp_full_match(c[3], '\\d+') THEN CAST(c[3] AS BIGINT) END AS lead_time, CAST(try_strptime(CASE WHEN regexp_full_match(c[4], '\\d{{2}}-\\d{{2}}-\\d{{4}}') THEN c[4] END, '%d-%m-%Y') AS DATE) AS booking_date,
CASE WHEN c[5] <> '' THEN c[5] END AS meal, CASE WHEN TRY_CAST(c[6] AS DECIMAL(18,6)) >= 0 THEN TRY_CAST(c[6] AS DECIMAL(18,6)) END AS price_per_night, c FROM cs)
SELECT booking_id, is_canceled, lead_time, booking_date, meal, price_per_night,
concat_ws(',', CASE WHEN booking_date IS NULL THEN 'booking_date' END, CASE WHEN is_canceled IS NULL AND c[2] <> '' THEN 'is_canceled' END, CASE WHEN lead_time IS NULL THEN 'lead_time' END, CASE WHEN price_per_night IS NULL THEN 'price_per_night' END) AS invalid_fields FROM v"""

HISTORY = f"""h0 AS (SELECT o_custkey AS history_id, o_orderkey AS position, ({HISTORY_LINE.replace('k %', 'o_orderkey %').replace('cast(k ', 'cast(o_orderkey ')}) AS line FROM orders),
h1 AS (SELECT *, TRY_CAST(CASE WHEN json_valid(line) THEN line END AS JSON) AS j FROM h0),
hist AS (SELECT *, trim(line) = '' AS is_blank, coalesce(json_type(j) = 'OBJECT' AND """ + " AND ".join(f"json_exists(j, '$.{f}')" for f in ENVELOPE) + ", false) AS is_valid FROM h1)"

#: The findings of raw.FINDINGS by customer, with their numbers as one way of writing each.
FOUND = """n AS (SELECT o_custkey AS answer_id, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS c, o_custkey % 16 AS t FROM orders GROUP BY o_custkey),
found AS (SELECT *, list_transform([c, n, 1, 3, 61, 2, n + 1000, n + 7], lambda x: CAST(x AS VARCHAR)) || [CASE WHEN n % 2 = 0 THEN '0.1234567' ELSE '0.123457' END, CASE WHEN c % 2 = 0 THEN '1234.5' ELSE '1234.51' END] AS numbers FROM n)"""

ANSWERS = f"""n AS (SELECT o_custkey AS answer_id, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS c, o_custkey % 16 AS t FROM orders GROUP BY o_custkey),
a0 AS (SELECT *, trim({ANSWER}, ' ' || chr(10)) AS raw FROM n),
a1 AS (SELECT *, CASE WHEN regexp_matches(raw, '^```(json)?[ \\t]*\\n') THEN regexp_extract(raw, '(?s)^```(?:json)?[ \\t]*\\n(.*)\\n```$', 1) ELSE raw END AS body FROM a0),
a2 AS (SELECT *, TRY_CAST(CASE WHEN json_valid(body) THEN body END AS JSON) AS j FROM a1),
a3 AS (SELECT *, trim(json_extract_string(j, '$.executive_summary')) AS s, trim(json_extract_string(j, '$.improvement_suggestions[0].suggestion')) AS g, trim(json_extract_string(j, '$.improvement_suggestions[0].evidence')) AS e,
  CASE WHEN json_type(j, '$.improvement_suggestions[0].sample_size') = 'UBIGINT' THEN CAST(json_extract_string(j, '$.improvement_suggestions[0].sample_size') AS BIGINT) END AS z FROM a2),
a4 AS (SELECT *, coalesce(length(s) BETWEEN 1 AND 600 AND json_type(j, '$.improvement_suggestions') = 'ARRAY' AND json_array_length(j, '$.improvement_suggestions') BETWEEN 1 AND 5
  AND length(g) BETWEEN 1 AND 400 AND length(e) BETWEEN 1 AND 400 AND z >= 1, false) AS structure FROM a3),
a5 AS (SELECT answer_id, n, c, structure, CASE WHEN structure THEN s || chr(1) || g || chr(1) || e END AS texts, CASE WHEN structure THEN g END AS g, CASE WHEN structure THEN e END AS e, CASE WHEN structure THEN z END AS z FROM a4),
nums AS (SELECT answer_id, regexp_extract(x, '[0-9][0-9,.]*') AS x FROM (SELECT answer_id, unnest(regexp_extract_all(texts, '[0-9][0-9,.]* ?(%|percent)|EUR [0-9][0-9,.]*[0-9]')) AS x FROM a5)),
bad AS (SELECT DISTINCT answer_id FROM nums JOIN n USING (answer_id) WHERE CAST(replace(x, ',', '') AS DECIMAL(30,12)) NOT IN (c, n, n + 7, n + 1000, 1, 3, 2, 61, CASE n % 2 WHEN 0 THEN 0.1234567 ELSE 0.123457 END, CASE c % 2 WHEN 0 THEN 1234.5 ELSE 1234.51 END)),
audit AS (SELECT answer_id, structure,
  CASE WHEN structure THEN len(list_filter(['caused', 'because', 'due to', 'effect of', 'leads to', 'drives'], lambda w: contains(lower(texts), w))) = 0 END AS causal,
  CASE WHEN structure THEN len(list_filter(['will increase', 'will grow', 'will raise', 'will boost', 'guarantee', 'ensure', 'certainly', 'definitely', 'forecast', 'predict'], lambda w: contains(' ' || lower(regexp_replace(texts, '\\s+|\x01', ' ', 'g')), ' ' || regexp_replace(w, 'e$', '')))) = 0 END AS promise,
  CASE WHEN structure THEN answer_id NOT IN (SELECT answer_id FROM bad) END AS figures_known, z IN (c, n, n + 7, 1, 3) AS sample_size,
  z >= 30 OR contains(lower(e), 'small sample') AS small_sample,
  CASE WHEN structure THEN len(list_filter(['may', 'might', 'could', 'suggests', 'consider testing'], lambda w: contains(' ' || lower(regexp_replace(g, '[.;]', ' ', 'g')) || ' ', ' ' || w || ' '))) > 0 END AS hypothesis FROM a5)"""
VERDICT = """CASE WHEN NOT structure THEN 'structure' WHEN NOT causal THEN 'causal' WHEN NOT promise THEN 'promise' WHEN NOT figures_known THEN 'figures'
WHEN NOT sample_size THEN 'sample_size' WHEN NOT small_sample THEN 'small_sample' WHEN NOT hypothesis THEN 'hypothesis' END"""


def availability() -> str:
    parts = []
    for name, all_of, any_of in REQUIREMENTS:
        quoted = lambda fields: "[" + ", ".join(f"'{f}'" for f in fields) + "]"
        parts.append(f"SELECT '{name}' AS analysis, {quoted(all_of)}::VARCHAR[] AS a, {quoted(any_of)}::VARCHAR[] AS o")
    return f"""WITH {LINES}, {COUNTS}, req AS ({" UNION ALL ".join(parts)}),
u AS (SELECT analysis, x.f, x.req, x.i, valid = 0 AS gone, missing = records AS absent FROM (
  SELECT analysis, unnest(a) AS f, true AS req, generate_subscripts(a, 1) AS i FROM req UNION ALL SELECT analysis, unnest(o), false, generate_subscripts(o, 1) FROM req) x JOIN fc ON fc.field = x.f),
s AS (SELECT analysis, count(*) FILTER (WHERE req AND gone) AS ga, count(*) FILTER (WHERE NOT req) AS no, count(*) FILTER (WHERE NOT req AND gone) AS go,
  string_agg('''' || f || '''', ', ' ORDER BY i) FILTER (WHERE req AND gone) AS qa, string_agg('''' || f || '''', ', ' ORDER BY i) FILTER (WHERE NOT req AND gone) AS qo,
  bool_and(absent) FILTER (WHERE req AND gone) AS aa, bool_and(absent) FILTER (WHERE NOT req AND gone) AS ao, string_agg(f, ',' ORDER BY NOT req, i) FILTER (WHERE gone) AS m FROM u GROUP BY analysis)
SELECT analysis, CASE WHEN ga > 0 OR (no > 0 AND no = go) THEN 'unavailable' ELSE 'available' END AS status,
CASE WHEN ga > 0 THEN 'Required field is ' || CASE WHEN aa THEN 'missing' ELSE 'missing or invalid' END || ': ' || qa
     WHEN no > 0 AND no = go THEN 'At least one of these fields is required and all are ' || CASE WHEN ao THEN 'missing' ELSE 'missing or invalid' END || ': ' || qo END AS reason,
coalesce(m, '') AS missing_fields FROM s"""
