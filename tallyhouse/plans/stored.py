"""Queries over one run's result and over a stored history of several runs, with their SQL.

A run is a market segment's bookings, read from raw JSON lines. The history holds the documents of all runs, two copies
with misshapen figures, a document of another version, and a line that is no JSON.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.operators import parsing, report, stored
from tallyhouse.operators.findings import ANALYSES
from tallyhouse.plans import oracles as o
from tallyhouse.plans.registry import query
from tallyhouse.sources import bookings, raw

#: Copies of two runs' documents: without any numerators, and without denominators or true flags.
NO_FIGURES, NO_DENOMINATORS = ("run-MACHINERY", "no-figures"), ("run-BUILDING", "no-denominators")
OLD = '{"schema_version":"0.9","analyses":{"lead_time":5,"cancellations":{"status":"unavailable"},"guest_mix":{"findings":{}}},"notices":[{"code":"X"},4]}'


def run_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, result_id, generated_at, status, document) of every market segment's bookings, from raw lines."""
    records = raw.table_of(parsing.parse_json(raw.booking_lines(spark, sf_dir)).drop("position", "line"), "records")
    run = F.col("market_segment")
    runs = records.select(run.alias("run")).where("run is not null").distinct()
    named = runs.select("run", F.concat(F.lit("run-"), "run").alias("result_id"), F.lit("2024-01-01T00:00:00.000Z").alias("generated_at"), F.lit("table").alias("source"), F.lit("orders").alias("reference"), F.lit(None).cast("string").alias("content_sha256"))
    return report.documents(records, bookings.calendar(spark), named, run)


_written: dict[tuple[str, str], str] = {}


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(result_id, document): the stored history; written once per application and read by every view."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _written or not raw.there(spark, _written[key]):
        path = raw.scratch(spark, "history")
        run_documents(spark, sf_dir).select("result_id", "document").write.parquet(path)
        _written[key] = path
    runs = spark.read.schema("result_id string, document string").parquet(_written[key])
    changed = lambda of, f: runs.where(F.col("result_id") == of[0]).select(F.lit(of[1]).alias("result_id"), f(F.col("document")).alias("document"))
    bare = changed(NO_FIGURES, lambda d: F.replace(d, F.lit('"numerator":'), F.lit('"counted":')))
    flags = lambda d: F.replace(d, F.lit('"small_sample":true'), F.lit('"small_sample":"true"'))
    loose = changed(NO_DENOMINATORS, lambda d: flags(F.replace(d, F.lit('"denominator":'), F.lit('"was":'))))
    others = spark.createDataFrame([("old", OLD), ("garbage", "not json")], "result_id string, document string")
    return runs.unionByName(bare).unionByName(loose).unionByName(others)


#: Lines of one exported file: some 110 MB, below the size up to which a file's digest is one value.
LINES_A_FILE = 200_000


@query("result_json")
def _result_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(result_id, document): the whole result of one run over a folder of raw lines, in files of a bounded size, as an export is."""
    path = raw.scratch(spark, "bookings")
    raw.booking_lines(spark, sf_dir).select("line").write.option("maxRecordsPerFile", LINES_A_FILE).text(path)
    return report.of_file(spark, path, bookings.calendar(spark), "run-1", "2024-01-01T00:00:00.000Z").select("result_id", "document")


# ---- SQL

RUNS = (
    o.BOOKINGS.replace("b AS (", "b0 AS (", 1)
    + """, b AS (SELECT * REPLACE (CASE WHEN k % 29 <> 0 THEN lead_time END AS lead_time, CASE WHEN k % 31 <> 0 THEN arrival_date END AS arrival_date),
  market_segment AS run, 'run-' || market_segment AS result_id FROM b0)"""
)


def pct(n: str, d: str) -> str:
    return f"CASE WHEN {d} > 0 THEN printf('%.1f%%', CAST({n} AS DOUBLE) / {d} * 100) ELSE 'n/a' END"


def ratio(n: str, d: str) -> str:
    return f"{n} || ' of ' || {d} || ' (' || {pct(n, d)} || ')'"


def rows(cte: str, select: str, unknown: dict[str, str] | None = None, figures: bool = True) -> str:
    """SQL of a view: v is the view of the runs; copies follow by what they lack. unknown says how columns of the copy without denominators look; figures, whether rows are figures."""
    bare = "" if figures else f" UNION ALL SELECT * REPLACE ('{NO_FIGURES[1]}' AS result_id) FROM v WHERE result_id = '{NO_FIGURES[0]}'"
    changes = ", ".join(f'{x} AS "{c}"' for c, x in ({"result_id": f"'{NO_DENOMINATORS[1]}'"} | (unknown or {})).items())
    return f"WITH {RUNS}, {cte + ', ' if cte else ''}v AS ({select}) SELECT * FROM v{bare} UNION ALL SELECT * REPLACE ({changes}) FROM v WHERE result_id = '{NO_DENOMINATORS[0]}'"


FIGURE = {"of": "CAST(NULL AS BIGINT)", "share": "'n/a'", "small_sample": "false"}

LEAD = """x AS (
  SELECT result_id, 'overall' AS split, 'all' AS g, lead_time, arrival_date FROM b WHERE lead_time IS NOT NULL
  UNION ALL SELECT result_id, 'by_cancellation_status', CASE WHEN is_canceled THEN 'canceled' ELSE 'not_canceled' END, lead_time, arrival_date FROM b WHERE lead_time IS NOT NULL AND is_canceled IS NOT NULL
  UNION ALL SELECT result_id, 'by_arrival_month', strftime(arrival_date, '%Y-%m'), lead_time, arrival_date FROM b WHERE lead_time IS NOT NULL AND arrival_date IS NOT NULL
  UNION ALL SELECT result_id, 'by_market_segment', market_segment, lead_time, arrival_date FROM b WHERE lead_time IS NOT NULL AND market_segment IS NOT NULL
  UNION ALL SELECT result_id, 'by_customer_type', customer_type, lead_time, arrival_date FROM b WHERE lead_time IS NOT NULL AND customer_type IS NOT NULL),
s AS (SELECT result_id, split, g, count(*) AS n, median(lead_time) AS m, min(arrival_date) AS first_in, max(arrival_date) AS last_in FROM x GROUP BY ALL),
t AS (SELECT *, CAST(sum(n) OVER w AS BIGINT) AS d, min(first_in) OVER w AS first_day, max(last_in) OVER w AS last_day FROM s WINDOW w AS (PARTITION BY result_id, split))"""
LEAD_ROWS = f"""SELECT result_id, split, g AS group_label, n AS records, d AS "of", {pct('n', 'd')} AS share, n < 30 AS small_sample,
  CASE WHEN m = floor(m) THEN CAST(CAST(m AS BIGINT) AS VARCHAR) ELSE CAST(m AS VARCHAR) END AS median_days,
  split = 'by_arrival_month' AND (first_day > CAST(CASE WHEN split = 'by_arrival_month' THEN g || '-01' END AS DATE) OR last_day < last_day(CAST(CASE WHEN split = 'by_arrival_month' THEN g || '-01' END AS DATE))) AS partial_period FROM t"""
BAND_ROWS = f"""SELECT result_id, split, g AS group_label, band, n AS records, d AS "of", {pct('n', 'd')} AS share, n < 30 AS small_sample FROM (
  SELECT x.result_id, x.split, x.g, k.band, count(*) FILTER (WHERE {o.BAND} = k.band) AS n, count(*) AS d FROM x, (SELECT unnest(['0-7', '8-30', '31-90', '91-180', '181+']) AS band) k GROUP BY ALL)"""

SEASON = """days AS (SELECT result_id, 'bookings' AS series, booking_date AS day, is_canceled, cents FROM b WHERE booking_date IS NOT NULL
  UNION ALL SELECT result_id, 'arrivals', arrival_date, is_canceled, cents FROM b WHERE arrival_date IS NOT NULL),
x AS (SELECT *, 'monthly' AS grain, strftime(day, '%Y-%m') AS period, date_trunc('month', day) AS a, last_day(day) AS z FROM days
  UNION ALL SELECT *, 'iso_week', strftime(day, '%G-W%V'), date_trunc('week', day), date_trunc('week', day) + INTERVAL 6 DAY FROM days),
s AS (SELECT result_id, series, grain, period, a, z, count(*) AS n, count(is_canceled) AS known, count(*) FILTER (WHERE is_canceled) AS c, count(cents) AS priced, CAST(sum(cents) AS BIGINT) AS cents,
  min(day) AS first_in, max(day) AS last_in FROM x GROUP BY ALL),
t AS (SELECT *, CAST(sum(n) OVER w AS BIGINT) AS d, min(first_in) OVER w AS first_day, max(last_in) OVER w AS last_day FROM s WINDOW w AS (PARTITION BY result_id, series, grain))"""
SEASON_ROWS = f"""SELECT result_id, series, grain, period, n AS records, d AS "of", {pct('n', 'd')} AS share, n < 30 AS small_sample, first_day > a OR last_day < z AS partial_period,
  CASE WHEN known > 0 THEN {ratio('c', 'known')} ELSE 'n/a' END AS cancelled, CASE WHEN priced > 0 THEN {o.mean4('cents', 'priced', 100)} || ' (n=' || priced || ')' ELSE 'n/a' END AS mean_price FROM t"""
SEASON_LINES = """SELECT result_id, any_value(series) AS series, CAST(CAST(sum(n) FILTER (WHERE grain = 'monthly') AS BIGINT) AS VARCHAR) || ' ' || any_value(series) || ' were observed from ' || min(first_day) || ' to ' || max(last_day) || ', in ' || count(*) FILTER (WHERE grain = 'monthly')
  || ' months and ' || count(*) FILTER (WHERE grain = 'iso_week') || ' ISO weeks; ' || count(*) FILTER (WHERE first_day > a OR last_day < z) || ' of these periods are partial. This describes the observed data only.' AS line FROM t GROUP BY result_id, t.series
  UNION ALL SELECT result_id, series, 'Observed dates: ' || min(first_day) || ' to ' || max(last_day) FROM t GROUP BY result_id, series
  UNION ALL SELECT result_id, series, 'Year ' || y || ' is incomplete: ' || months || ' months present.' FROM (SELECT result_id, series, period[1:4] AS y, count(*) AS months FROM t WHERE grain = 'monthly' GROUP BY ALL) WHERE months < 12"""

CANCEL = "x AS (\n" + "\n  UNION ALL ".join(
    [f"SELECT result_id, '{s}' AS split, g AS group_label, is_canceled, arrival_date FROM (SELECT *, {label} AS g FROM b WHERE is_canceled IS NOT NULL) WHERE g IS NOT NULL" for s, (label, _) in {"overall": ("'All bookings'", None), **o.SPLITS}.items()]
) + """),
s AS (SELECT result_id, split, group_label, count(*) FILTER (WHERE is_canceled) AS n, count(*) AS d, min(arrival_date) AS first_in, max(arrival_date) AS last_in FROM x GROUP BY ALL),
t AS (SELECT *, min(first_in) OVER w AS first_day, max(last_in) OVER w AS last_day FROM s WINDOW w AS (PARTITION BY result_id, split))"""  # fmt: skip
_MONTH_OF = "CAST(CASE WHEN split = 'by_arrival_month' THEN group_label || '-01' END AS DATE)"
CANCEL_ROWS = f"""SELECT result_id, split, group_label, n AS records, d AS "of", {pct('n', 'd')} AS share, d < 30 AS small_sample,
  coalesce(split = 'by_arrival_month' AND (first_day > {_MONTH_OF} OR last_day < last_day({_MONTH_OF})), false) AS partial_period FROM t"""
CANCEL_SPLITS = """SELECT result_id, split, CAST(sum(d) AS BIGINT) AS records_used, CAST(any_value(whole) - sum(d) AS BIGINT) AS records_left_out,
  'Cancellation share by ' || replace(split[4:], '_', ' ') || ': ' || CAST(sum(n) AS BIGINT) || ' of ' || CAST(sum(d) AS BIGINT) || ' bookings were cancelled overall; groups are shown with their counts and small groups are flagged.' AS summary
  FROM t JOIN (SELECT result_id, d AS whole FROM t WHERE split = 'overall') USING (result_id) WHERE split <> 'overall' GROUP BY result_id, split"""

STAYS = """x AS (SELECT *, stays_in_weekend_nights + stays_in_week_nights AS nights FROM b WHERE stays_in_weekend_nights IS NOT NULL AND stays_in_week_nights IS NOT NULL),
p AS (SELECT result_id, CASE WHEN is_canceled THEN 'cancelled' WHEN NOT is_canceled THEN 'not cancelled' ELSE 'cancellation status unknown' END AS g, count(*) AS n, CAST(sum(cents * nights) AS BIGINT) AS t, count(*) FILTER (WHERE cents = 0) AS z
  FROM x WHERE nights >= 1 AND cents IS NOT NULL GROUP BY ALL)"""
_TOTAL = o.plain("(CAST(t // 100 AS VARCHAR) || '.' || lpad(CAST(t % 100 AS VARCHAR), 2, '0'))")
VALUE_ROWS = f"""SELECT result_id, g AS cancellation_status, {_TOTAL} AS total, {o.mean4('t', 'n', 100)} AS mean, n AS bookings, CAST(sum(n) OVER (PARTITION BY result_id) AS BIGINT) AS "of", z AS zero_price_bookings, n < 30 AS small_sample FROM p"""
STAY_ROWS = f"""SELECT result_id, nights, n AS records, d AS "of", {pct('n', 'd')} AS share, n < 30 AS small_sample FROM (SELECT result_id, k.nights, count(*) FILTER (WHERE k.nights = CASE WHEN x.nights <= 3 THEN CAST(x.nights AS VARCHAR)
  WHEN x.nights <= 7 THEN '4-7' ELSE '8+' END) AS n, count(*) AS d FROM x, (SELECT unnest(['1', '2', '3', '4-7', '8+']) AS nights) k WHERE x.nights >= 1 GROUP BY ALL)"""
VALUE_TOTALS = """SELECT result_id, count(*) FILTER (WHERE nights < 1) AS zero_night_bookings, count(*) FILTER (WHERE nights >= 1 AND cents = 0) AS zero_price_bookings,
  count(*) FILTER (WHERE nights >= 1 AND cents IS NULL) AS without_price, CAST(sum(nights) AS BIGINT) AS total_nights, 'price units of the input' AS unit, CAST(NULL AS VARCHAR) AS unavailable FROM x GROUP BY ALL"""

MIX = "x AS (\n" + "\n  UNION ALL ".join(f"SELECT result_id, '{a}' AS attribute, {label} AS g, stays_in_weekend_nights + stays_in_week_nights AS nights, is_canceled, cents FROM b WHERE {where}" for a, (label, where) in o.MIX.items()) + """),
s AS (SELECT result_id, attribute, g, count(*) AS n, count(nights) AS nk, CAST(sum(nights) AS BIGINT) AS nt, count(is_canceled) AS known, count(*) FILTER (WHERE is_canceled) AS c, count(cents) AS p, CAST(sum(cents) AS BIGINT) AS t FROM x GROUP BY ALL)"""  # fmt: skip
_OMITTED = "'omitted: small sample'"
MIX_ROWS = f"""SELECT result_id, attribute, g AS group_label, n AS records, d AS "of", {pct('n', 'd')} AS share, n < 30 AS small_sample,
  CASE WHEN n < 30 THEN {_OMITTED} WHEN nk > 0 THEN {o.mean4('nt', 'nk')} || ' (n=' || nk || ')' ELSE 'n/a' END AS mean_nights,
  CASE WHEN n < 30 THEN {_OMITTED} WHEN known > 0 THEN {ratio('c', 'known')} ELSE 'n/a' END AS cancelled,
  CASE WHEN n < 30 THEN {_OMITTED} WHEN p > 0 THEN {o.mean4('t', 'p', 100)} || ' (n=' || p || ')' ELSE 'n/a' END AS mean_price,
  CASE WHEN n < 30 THEN 'No comparison is stated for group ''' || g || '''; it is a small sample of ' || n || ' records.' END AS omitted
  FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY result_id, attribute) AS BIGINT) AS d FROM s)"""

HOLIDAYS = f"""{o.CALENDAR}, r AS (SELECT result_id, 'booking_date' AS side, booking_date AS day, NULL AS is_canceled FROM b WHERE booking_date IS NOT NULL
  UNION ALL SELECT result_id, 'arrival_date', arrival_date, is_canceled FROM b WHERE arrival_date IS NOT NULL),
yr AS (SELECT result_id, side, year(day) AS y, count(*) AS records, year(day) IN (SELECT year(h) FROM cal) AS has_data FROM r GROUP BY ALL),
ends AS (SELECT result_id, side, min(day) AS a, max(day) AS z FROM r GROUP BY ALL),
spine AS (SELECT result_id, side, CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS day FROM ends),
near AS (SELECT s.result_id, s.side, s.day, min(CASE WHEN h <= day THEN day - h END) AS since, min(CASE WHEN h >= day THEN h - day END) AS until
  FROM spine s LEFT JOIN (SELECT result_id, side, h FROM yr JOIN cal ON year(h) = y) c ON c.result_id = s.result_id AND c.side = s.side AND h BETWEEN day - 8 AND day + 8 GROUP BY ALL),
kinds AS (SELECT *, least(coalesce(since, 9999), coalesce(until, 9999)) AS x,
  CASE WHEN x > 7 THEN 'baseline' WHEN x = 0 OR since = until THEN 'holiday' WHEN x = until THEN 'before' ELSE 'after' END AS kind FROM near),
ev AS (SELECT result_id, side, day, count(*) AS events, count(is_canceled) AS known, count(*) FILTER (WHERE is_canceled) AS canceled FROM r GROUP BY ALL),
daily AS (SELECT k.*, isodow(k.day) AS weekday, coalesce(events, 0) AS events, coalesce(known, 0) AS known, coalesce(canceled, 0) AS canceled FROM kinds k LEFT JOIN ev USING (result_id, side, day)
  JOIN (SELECT result_id, side, y FROM yr WHERE has_data) u ON u.result_id = k.result_id AND u.side = k.side AND u.y = year(k.day)),
g AS (SELECT result_id, side, 'On holidays' AS comparison, NULL AS w, kind, weekday, events, known, canceled FROM daily WHERE kind = 'holiday'
  UNION ALL SELECT result_id, side, w || '-day window ' || kind || ' holidays', w, kind, weekday, events, known, canceled FROM daily, (VALUES (1), (3), (7)) q(w) WHERE kind IN ('before', 'after') AND x <= w),
base AS (SELECT result_id, side, weekday, count(*) AS d, sum(events) AS e, sum(known) AS k, sum(canceled) AS c FROM daily WHERE kind = 'baseline' GROUP BY ALL),
bw AS (SELECT g.result_id, g.side, comparison, w, kind, g.weekday, count(*) AS days, CAST(sum(events) AS BIGINT) AS events, CAST(sum(known) AS BIGINT) AS known, CAST(sum(canceled) AS BIGINT) AS canceled,
  CAST(coalesce(any_value(d), 0) AS BIGINT) AS bd, CAST(coalesce(any_value(e), 0) AS BIGINT) AS be, CAST(coalesce(any_value(base.k), 0) AS BIGINT) AS bk, CAST(coalesce(any_value(base.c), 0) AS BIGINT) AS bc
  FROM g LEFT JOIN base ON base.result_id = g.result_id AND base.side = g.side AND base.weekday = g.weekday GROUP BY g.result_id, g.side, comparison, w, kind, g.weekday),
cmp AS (SELECT result_id, side, comparison, w, kind, CAST(sum(days) AS BIGINT) AS days, CAST(sum(events) AS BIGINT) AS events, CAST(sum(known) AS BIGINT) AS known, CAST(sum(canceled) AS BIGINT) AS canceled,
  CAST(sum(bd) AS BIGINT) AS bd, CAST(sum(be) AS BIGINT) AS be, CAST(sum(bk) AS BIGINT) AS bk, CAST(sum(bc) AS BIGINT) AS bc FROM bw GROUP BY ALL)"""
_MEANS = """days, events AS records, round_even(events / days, 4) AS mean_per_day, days < 30 AS small_sample,
  bd AS base_days, be AS base_records, CASE WHEN bd > 0 THEN round_even(be / bd, 4) END AS base_mean_per_day, bd < 30 AS base_small_sample"""
_DIRECTION = "CASE WHEN events * bd > be * days THEN 'higher' WHEN events * bd < be * days THEN 'lower' ELSE 'the same' END"
_SUBJECT = "CASE WHEN w IS NULL THEN 'on holidays' ELSE 'in the ' || w || '-day window ' || kind || ' holidays' END"
HOLIDAY_ROWS = f"""SELECT result_id, side, comparison, {_MEANS}, CASE WHEN side = 'arrival_date' THEN {ratio('canceled', 'known')} END AS cancelled, CASE WHEN side = 'arrival_date' THEN {ratio('bc', 'bk')} END AS base_cancelled,
  CASE WHEN days < 30 OR bd < 30 THEN 'No comparison is stated ' || {_SUBJECT} || '; a group is a small sample.' ELSE 'Mean ' || CASE side WHEN 'arrival_date' THEN 'arrivals' ELSE 'bookings' END || ' per day was ' || {_DIRECTION} || ' ' || {_SUBJECT}
    || ' (' || printf('%.2f', events / days) || ') ' || CASE WHEN events * bd = be * days THEN 'as' ELSE 'than' END || ' on baseline days of the same weekdays (' || printf('%.2f', be / bd) || '); this is an observed association only.' END AS statement FROM cmp"""
WEEKDAY_ROWS = f"""SELECT result_id, side, comparison, ['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday'][weekday] AS weekday, {_MEANS} FROM bw"""
COVERAGE_ROWS = """SELECT e.result_id, e.side, a || ' to ' || z AS observed, coalesce(string_agg(CASE WHEN has_data THEN y END, ', ' ORDER BY y), 'none') AS years_used, coalesce(string_agg(CASE WHEN NOT has_data THEN y END, ', ' ORDER BY y), 'none') AS years_unavailable,
  CAST(coalesce(sum(records) FILTER (WHERE has_data), 0) AS BIGINT) AS records_used, CAST(coalesce(sum(records) FILTER (WHERE NOT has_data), 0) AS BIGINT) AS records_left_out,
  CAST(coalesce(sum(date_diff('day', greatest(a, make_date(y, 1, 1)), least(z, make_date(y, 12, 31))) + 1) FILTER (WHERE NOT has_data), 0) AS BIGINT) AS days_left_out, CAST(NULL AS VARCHAR) AS unavailable
  FROM ends e JOIN yr ON yr.result_id = e.result_id AND yr.side = e.side GROUP BY e.result_id, e.side, a, z"""

FIELDS = "fc AS (\n" + "\n  UNION ALL ".join(
    f"SELECT result_id, '{f}' AS field, count(*) FILTER (WHERE {missing}) AS missing, count(*) FILTER (WHERE {invalid}) AS invalid FROM b GROUP BY 1"
    for f in o.FIELDS
    for own in ["cents" if f == "price_per_night" else f]
    for bad in [{"lead_time": "k % 29 = 0", "arrival_date": "k % 31 = 0"}.get(f, "false")]
    for missing, invalid in [(f"{own} IS NULL AND NOT ({bad})", bad)]
) + ")"
HEADLINES = """SELECT result_id, count(*) AS records, min(booking_date) || ' to ' || max(booking_date) AS booking_dates, min(arrival_date) || ' to ' || max(arrival_date) AS arrival_dates,
  count(booking_id) - count(DISTINCT booking_id) AS duplicate_ids, count(*) FILTER (WHERE cents = 0) AS zero_prices, CASE WHEN count(*) FILTER (WHERE k % 19 = 0) > 0 THEN 'zz' ELSE 'none' END AS unknown_fields FROM b GROUP BY result_id"""
_NONE_OF = "SELECT x.result_id, NULL, 'not supplied to not supplied', 'not supplied to not supplied', NULL, NULL, 'none' FROM (VALUES ('old'), ('garbage')) x(result_id)"
REMARKS = "SELECT result_id, 'notice' AS kind, 'ESTIMATE_NOT_REVENUE: Room value is an estimate (price per night times total nights), not realized revenue.' AS remark FROM b GROUP BY result_id"
_OLD_REMARKS = "SELECT 'old', x.kind, x.remark FROM (VALUES ('unavailable', 'cancellations: No reason was recorded.'), ('notice', 'X: '), ('notice', 'NOTICE: ')) x(kind, remark)"
_GONE, _EMPTY = "This analysis is not part of the selected result.", "This analysis has no findings in the selected result."
MESSAGES = f"""WITH {RUNS}, a AS (SELECT unnest({list(ANALYSES)!r}) AS analysis), r AS (SELECT DISTINCT result_id FROM b UNION ALL VALUES ('{NO_FIGURES[1]}'), ('{NO_DENOMINATORS[1]}'), ('old'), ('garbage'))
SELECT result_id, analysis, CASE WHEN result_id = 'old' AND analysis = 'cancellations' THEN 'Not available: No reason was recorded.' WHEN result_id = 'old' AND analysis = 'guest_mix' THEN '{_EMPTY}' WHEN result_id IN ('old', 'garbage') THEN '{_GONE}' END AS message FROM r, a"""


def _limits() -> str:
    """Small samples and partial periods of whole documents, from the tables above; every figure of a document is counted where it stands."""
    small = {
        "lead": (LEAD, f"SELECT result_id, small_sample AS small, coalesce(partial_period, false) AS part FROM ({LEAD_ROWS})"),
        "bands": (LEAD, f"SELECT result_id, small_sample, false FROM ({BAND_ROWS})"),
        "compared": ("", "SELECT result_id, count(*) < 30, false FROM b WHERE lead_time IS NOT NULL AND booking_date IS NOT NULL AND arrival_date IS NOT NULL GROUP BY result_id"),
        "cancel": (CANCEL, f"SELECT result_id, small_sample, partial_period FROM ({CANCEL_ROWS})"),
        "season": (SEASON, "SELECT result_id, n < 30, first_day > a OR last_day < z FROM t UNION ALL SELECT result_id, known < 30, false FROM t WHERE known > 0 UNION ALL SELECT result_id, priced < 30, false FROM t WHERE priced > 0"),
        "value": (STAYS, f"SELECT result_id, small_sample, false FROM ({VALUE_ROWS}) UNION ALL SELECT result_id, small_sample, false FROM ({STAY_ROWS})"),
        "mix": (MIX, "SELECT result_id, n < 30, false FROM s UNION ALL SELECT result_id, n < 30, false FROM s WHERE n < 30 UNION ALL SELECT result_id, unnest([nk, known, p]) < 30, false FROM (SELECT * FROM s WHERE n >= 30)"),
        "days": (HOLIDAYS, """SELECT result_id, unnest([days, bd] || CASE side WHEN 'arrival_date' THEN [known, bk] ELSE [] END) < 30, false FROM (SELECT * FROM cmp)
  UNION ALL SELECT result_id, unnest([days, bd] || CASE side WHEN 'arrival_date' THEN [known, bk] ELSE [] END) < 30, false FROM bw
  UNION ALL SELECT result_id, unnest([count(*), CASE side WHEN 'arrival_date' THEN CAST(sum(known) AS BIGINT) END]) < 30, false FROM daily WHERE kind = 'baseline' GROUP BY result_id, side"""),
    }
    parts = " UNION ALL ".join(f"SELECT * FROM (WITH {cte + ', ' if cte else ''}out_{name} AS ({sql}) SELECT * FROM out_{name})" for name, (cte, sql) in small.items())
    held = {"cancellation_share": "a valid ''is_canceled''", "mean_price_per_night": "a valid ''price_per_night''", "mean_length_of_stay": "valid night counts"}
    says = lambda part: f"'No record in the group holds {held[part]}.' AS reason"
    period = "SELECT DISTINCT result_id, 'seasonality / findings / ' || series || ' / ' || grain || ' / periods / {0}' AS path, {1} FROM t WHERE {2} = 0"
    group = "SELECT DISTINCT result_id, 'guest_mix / findings / distributions / ' || attribute || ' / groups / comparison / {0}' AS path, {1} FROM s WHERE n >= 30 AND {2} = 0"
    gone = [
        (HOLIDAYS, "SELECT DISTINCT result_id, 'holidays / findings / ' || side || ' / years_unavailable' AS path, 'The holiday calendar has no data for ' || y || '.' AS reason FROM yr WHERE NOT has_data"),
        (SEASON, period.format("cancellation", says("cancellation_share"), "known")),
        (SEASON, period.format("mean_price_per_night", says("mean_price_per_night"), "priced")),
        *((MIX, group.format(part, says(part), c)) for part, c in (("mean_length_of_stay", "nk"), ("cancellation_share", "known"), ("mean_price_per_night", "p"))),
    ]
    bare = " UNION ALL ".join(f"SELECT result_id, 'unavailable' AS kind, path, reason, 1 AS times FROM (WITH {cte}, g{i} AS ({sql}) SELECT * FROM g{i})" for i, (cte, sql) in enumerate(gone))
    return f"""WITH {RUNS}, f AS ({parts}), u AS ({bare}),
c AS (SELECT result_id, 'small_samples' AS kind, count(*) FILTER (WHERE small) AS times FROM f GROUP BY result_id UNION ALL SELECT result_id, 'partial_periods', count(*) FILTER (WHERE part) FROM f GROUP BY result_id)
SELECT result_id, kind, path, reason, CAST(times AS BIGINT) AS times FROM u UNION ALL SELECT result_id, kind, NULL, NULL, times FROM c"""


def view(name: str, sql: str | None, job: Callable[[DataFrame], DataFrame]) -> None:
    query(f"stored_{name}", sql)(lambda spark, sf_dir: job(history(spark, sf_dir)))


view("lead_time", rows(LEAD, LEAD_ROWS, FIGURE), stored.lead_time)
view("lead_time_bands", rows(LEAD, BAND_ROWS, FIGURE), stored.lead_time_bands)
_SEEN = "CASE WHEN {0} = 'n/a' THEN 'n/a' ELSE split_part({0}, ' of ', 1) || ' of unknown (n/a)' END"
view("seasonality", rows(SEASON, SEASON_ROWS, FIGURE | {"cancelled": _SEEN.format("cancelled")}), stored.seasonality)
view("seasonality_lines", rows(SEASON, SEASON_LINES, figures=False), stored.seasonality_lines)
_NO_DAYS = {"days": "CAST(NULL AS BIGINT)", "small_sample": "false", "base_days": "CAST(NULL AS BIGINT)", "base_small_sample": "false"}
_UNKNOWN_SHARE = {c: f"split_part({c}, ' of ', 1) || ' of unknown (n/a)'" for c in ("cancelled", "base_cancelled")}
_BARE = {"days": "CAST(NULL AS BIGINT)", "records": "CAST(NULL AS BIGINT)", "base_days": "CAST(NULL AS BIGINT)", "base_records": "CAST(NULL AS BIGINT)", "small_sample": "false", "base_small_sample": "false"}


def _with_bare(sql: str, changes: dict[str, str]) -> str:
    """The rows of the copy without numerators, where rows are more than a figure."""
    return f"{sql} UNION ALL SELECT * REPLACE ({', '.join(f'{x} AS {c}' for c, x in ({'result_id': repr(NO_FIGURES[1])} | changes).items())}) FROM v WHERE result_id = '{NO_FIGURES[0]}'"


view("holidays", _with_bare(rows(HOLIDAYS, HOLIDAY_ROWS, _NO_DAYS | _UNKNOWN_SHARE), _BARE | {"cancelled": "NULL", "base_cancelled": "NULL"}), stored.holidays)
view("holiday_weekdays", _with_bare(rows(HOLIDAYS, WEEKDAY_ROWS, _NO_DAYS), _BARE), stored.holiday_weekdays)
view("holiday_coverage", rows(HOLIDAYS, COVERAGE_ROWS, figures=False), stored.holiday_coverage)
view("cancellations", rows(CANCEL, CANCEL_ROWS, FIGURE), stored.cancellations)
view("cancellation_splits", rows(CANCEL, CANCEL_SPLITS, figures=False), stored.cancellation_splits)
view("room_value", rows(STAYS, VALUE_ROWS, {"of": FIGURE["of"], "small_sample": "false"}), stored.room_value)
view("stay_lengths", rows(STAYS, STAY_ROWS, FIGURE), stored.stay_lengths)
view("room_value_totals", rows(STAYS, VALUE_TOTALS, figures=False), stored.room_value_totals)
view("guest_mix", rows(MIX, MIX_ROWS, FIGURE | {"cancelled": f"CASE WHEN cancelled = {_OMITTED} THEN cancelled ELSE {_SEEN.format('cancelled')} END"}), stored.guest_mix)
view("quality_fields", rows(FIELDS, "SELECT * FROM fc", figures=False), stored.quality_fields)
view("quality_headlines", rows("", HEADLINES, figures=False) + f" UNION ALL {_NONE_OF}", stored.quality_headlines)
view("quality_remarks", rows("", REMARKS, figures=False) + f" UNION ALL {_OLD_REMARKS}", stored.quality_remarks)
view("messages", MESSAGES, lambda h: stored.messages(h, ANALYSES))
view("limitations", _limits(), lambda h: stored.limitations(h).where(~F.col("result_id").isin("old", "garbage", NO_FIGURES[1], NO_DENOMINATORS[1])))
view("prompt_data", None, stored.prompt_data)
