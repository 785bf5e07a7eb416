"""SQL building blocks for the DuckDB oracle.

Each registered query has an ANSI-SQL twin that DuckDB runs over the driver
tables.  The derived domain tables are common table expressions that mirror
``aqlens.sources.tables`` line for line.  Literals come from the same
constants; the logic is written independently in SQL.
"""

from __future__ import annotations

from aqlens import constants as K
from aqlens.sources import tables as T


def q(s: str) -> str:
    return "'" + str(s).replace("'", "''") + "'"


def dbl(x: float) -> str:
    """An exact double literal (parsed from its shortest repr)."""
    return f"CAST({q(repr(float(x)))} AS DOUBLE)"


def case(expr: str, mapping: dict, default: str | None = None, raw_values: bool = False) -> str:
    def val(v):
        return v if raw_values or not isinstance(v, str) else q(v)

    parts = " ".join(f"WHEN {expr} = {q(k) if isinstance(k, str) else k} THEN {val(v)}" for k, v in mapping.items())
    return f"CASE {parts} ELSE {default if default is not None else 'NULL'} END"


def rnd(expr: str, digits: int = 6) -> str:
    scale = 10**digits
    return f"(floor(({expr}) * {scale} + 0.5) / {scale})"


def fmt_ts(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"


def strip(expr: str) -> str:
    return f"trim(replace(replace({expr}, chr(8203), ''), chr(65279), ''))"


def finite(expr: str) -> str:
    return f"(CASE WHEN isfinite({expr}) THEN {expr} END)"


def parse_float(expr: str) -> str:
    t = strip(expr)
    return f"(CASE WHEN {t} IN ('', 'NA', 'N/A') THEN NULL ELSE {finite(f'TRY_CAST({t} AS DOUBLE)')} END)"


def canonical(expr: str) -> str:
    t = strip(expr)
    return f"coalesce({case(f'upper({t})', K.POLLUTANT_ALIASES)}, {t})"


def category(expr: str, pick: int = 0) -> str:
    parts = []
    for upper, *labels in K.AQI_CATEGORIES:
        if upper is None:
            parts.append(f"WHEN {expr} IS NOT NULL THEN {q(labels[pick])}")
        else:
            parts.append(f"WHEN {expr} <= {upper} THEN {q(labels[pick])}")
    return "CASE " + " ".join(parts) + " END"


def sub_index_for(p: str, c: str) -> str:
    bins = K.AQI_BREAKPOINTS[p]
    parts = [f"WHEN {c} IS NULL OR {c} <= 0 THEN NULL"]
    for lo, hi, alo, ahi in bins:
        slope = (ahi - alo) / (hi - lo)
        parts.append(f"WHEN {c} <= {dbl(hi)} THEN CAST(trunc({dbl(slope)} * ({c} - {dbl(lo)}) + {dbl(alo)}) AS INTEGER)")
    return "CASE " + " ".join(parts) + f" ELSE {K.TOP_BIN_AQI} END"


def sub_index(pcol: str, c: str) -> str:
    parts = [f"WHEN {pcol} = {q(p)} THEN {sub_index_for(p, c)}" for p in K.AQI_BREAKPOINTS]
    return "CASE " + " ".join(parts) + " ELSE NULL END"


def season_index(month: str) -> str:
    return f"CAST((({month}) % 12 + 3) // 3 AS INTEGER)"


def season_name(month: str) -> str:
    return case(season_index(month), K.SEASON_NAMES)


def season_code(month: str) -> str:
    order = {name: i for i, name in enumerate(sorted(K.SEASON_NAMES.values()))}
    return f"CAST({case(season_name(month), order)} AS INTEGER)"


def expected(pm25: str, pick: int) -> str:
    parts = []
    for upper, lo, hi in K.SANITY_RANGES:
        v = (lo, hi)[pick]
        parts.append(f"ELSE {v}" if upper is None else f"WHEN {pm25} <= {upper} THEN {v}")
    return "CASE " + " ".join(parts) + " END"


# ---------------------------------------------------------------------------
# Derived tables (mirror aqlens.sources.tables)
# ---------------------------------------------------------------------------
_cities = "[" + ", ".join(q(c) for c in T.TEST_CITIES) + "]"

GEO = f"""geo AS (
  SELECT n.n_nationkey, n.n_regionkey,
         CASE WHEN n.n_nationkey < {T.NAMED_NATIONS} THEN {_cities}[n.n_nationkey + 1] ELSE n.n_name END AS city,
         r.r_name AS state
  FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey)"""

READINGS = f"""readings AS (
  SELECT e.event_id AS reading_id, g.state, g.city,
         CAST(e.user_id AS VARCHAR) AS station,
         strftime(e.ts, '%d-%m-%Y %H:%M:%S') AS last_update,
         {case('e.event_type', T.EVENT_POLLUTANT)} AS pollutant_id,
         CAST(e.value * {dbl(0.8)} AS VARCHAR) AS pollutant_min,
         CAST(e.value * {dbl(1.25)} AS VARCHAR) AS pollutant_max,
         CASE WHEN e.event_id % {T.MISSING_EVERY} = 0 THEN 'NA' ELSE CAST(e.value AS VARCHAR) END AS pollutant_avg,
         CASE WHEN g.n_nationkey = {T.UNPLACED_NATION} THEN 'NA' ELSE CAST(g.n_nationkey + 8 AS VARCHAR) END AS latitude,
         CAST(g.n_regionkey * 4 + 70 + e.user_id % 4 AS VARCHAR) AS longitude
  FROM events e JOIN geo g ON e.user_id % {T.NATION_COUNT} = g.n_nationkey)"""

NORM = f"""norm AS (
  SELECT reading_id, state, city, station, pollutant_id, last_update, latitude, longitude,
         {canonical('pollutant_id')} AS pollutant,
         {parse_float('pollutant_avg')} AS value,
         {parse_float('pollutant_min')} AS value_min,
         {parse_float('pollutant_max')} AS value_max,
         try_strptime(last_update, '%d-%m-%Y %H:%M:%S') AS datetime,
         CAST(try_strptime(last_update, '%d-%m-%Y %H:%M:%S') AS DATE) AS date,
         {finite('TRY_CAST(latitude AS DOUBLE)')} AS lat,
         {finite('TRY_CAST(longitude AS DOUBLE)')} AS lon
  FROM readings)"""

VALID = """valid AS (
  SELECT * FROM norm WHERE length(pollutant) > 0 AND value IS NOT NULL AND value >= 0)"""

CONC = """conc AS (
  SELECT city, date, pollutant, CAST(avg(CAST(value AS DECIMAL(38,10))) AS DOUBLE) AS value FROM valid GROUP BY city, date, pollutant)"""

SUBS = f"""subs AS (
  SELECT city, date, pollutant, value, {sub_index('pollutant', 'value')} AS sub_index FROM conc)"""

_tie = {p: i for i, p in enumerate(K.TARGET_POLLUTANTS)}
OVERALL = f"""ranked AS (
  SELECT *, row_number() OVER (PARTITION BY city, date
             ORDER BY sub_index DESC NULLS LAST, {case('pollutant', _tie, str(len(_tie)))}) AS rk
  FROM subs),
overall AS (
  SELECT city, date,
         coalesce(max(sub_index), {K.AQI_WHEN_NO_POLLUTANT}) AS aqi,
         max(CASE WHEN rk = 1 AND sub_index IS NOT NULL THEN pollutant END) AS driving_pollutant,
         max(CASE WHEN rk = 1 THEN sub_index END) AS driving_sub_index,
         count(sub_index) AS n_pollutants
  FROM ranked GROUP BY city, date)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def final(ctes, select: str, dates=("date",)) -> str:
    """WITH <ctes> <select>, with date columns returned as yyyy-MM-dd text."""
    if not dates:
        return with_ctes(*ctes) + select
    rep = ", ".join(f"strftime({d}, '%Y-%m-%d') AS {d}" for d in dates)
    return with_ctes(*ctes) + f"SELECT * REPLACE ({rep}) FROM ({select}) AS _q"


BASE = (GEO, READINGS, NORM)
DAILY = (GEO, READINGS, NORM, VALID, CONC, SUBS, OVERALL)


def complete_cte(source: str = "conc", name: str = "wide") -> str:
    cols = ",\n         ".join(
        f"coalesce(max(CASE WHEN pollutant = {q(p)} AND value >= 0 THEN value END), {dbl(K.UNIVERSAL_DEFAULTS[p])}) AS {c}"
        for p, c in K.POLLUTANTS
    )
    return f"""{name} AS (
  SELECT city, date,
         {cols}
  FROM {source} GROUP BY city, date)"""


REPAIRED = """repaired AS (
  SELECT city, date, pm25, CASE WHEN pm10 < pm25 THEN pm25 * CAST('1.2' AS DOUBLE) ELSE pm10 END AS pm10,
         no, no2, nox, nh3, co, so2, o3, benzene, toluene, xylene, pm10 < pm25 AS pm_repaired
  FROM wide)"""


def round1_half_even(x: str) -> str:
    """SQL twin of operators.weather.round1_half_even (same IEEE steps)."""
    a, b = f"(({x}) * CAST(8 AS DOUBLE))", f"(({x}) * CAST(2 AS DOUBLE))"
    s = f"({a} + {b})"
    bb = f"({s} - {a})"
    e = f"(({a} - ({s} - {bb})) + ({b} - {bb}))"
    fl = f"floor({s})"
    tie = f"({s} - {fl} = 0.5)"
    even = f"(CASE WHEN {fl} % 2 = 0 THEN {fl} ELSE {fl} + 1 END)"
    r = f"(CASE WHEN {tie} AND {e} > 0 THEN {fl} + 1 WHEN {tie} AND {e} < 0 THEN {fl} WHEN {tie} THEN {even} ELSE round({s}) END)"
    return f"({r} / CAST(10 AS DOUBLE))"


def weather_ctes() -> tuple[str, ...]:
    stats = """wstats AS (
  SELECT city, date, min(value) AS vmin, max(value) AS vmax, CAST(avg(CAST(value AS DECIMAL(38,10))) AS DOUBLE) AS vavg, count(*) AS n
  FROM valid GROUP BY city, date)"""
    cols = ", ".join(f"CAST({f} AS DOUBLE) AS {k}" for k, f in T.WEATHER_FORMULAS.items())
    daily = f"wdaily AS (SELECT city, date, {cols} FROM wstats)"
    return (stats, daily)


def forecast_match_ctes() -> tuple[str, ...]:
    d = K.WEATHER_KEY_DEFAULTS
    return (
        f"""req AS (
  SELECT DISTINCT city, date, CAST(date_trunc('week', date + INTERVAL {T.REQUEST_SHIFT_DAYS} DAY) AS DATE) AS doc_key FROM valid)""",
        "wk AS (SELECT *, CAST(date_trunc('week', date) AS DATE) AS doc_key FROM wdaily)",
        "firstday AS (SELECT * FROM wk QUALIFY row_number() OVER (PARTITION BY city, doc_key ORDER BY date) = 1)",
        f"""six AS (
  SELECT r.city, r.date,
         coalesce((m.temperature_2m_max + m.temperature_2m_min) / 2, (f.temperature_2m_max + f.temperature_2m_min) / 2, {dbl(d['T'])}) AS T,
         coalesce(m.relative_humidity_2m_max, f.relative_humidity_2m_max, {dbl(d['RH'])}) AS RH,
         coalesce(m.wind_speed_10m_max, f.wind_speed_10m_max, {dbl(d['WS'])}) AS WS,
         {dbl(d['WD'])} AS WD,
         coalesce(m.precipitation_sum, f.precipitation_sum, {dbl(d['RF'])}) AS RF,
         {dbl(d['BP'])} AS BP,
         m.city IS NOT NULL AS weather_matched
  FROM req r
  LEFT JOIN wk m ON m.city = r.city AND m.doc_key = r.doc_key AND m.date = r.date
  LEFT JOIN firstday f ON f.city = r.city AND f.doc_key = r.doc_key)""",
    )


def overall_wide(prefix: str = "") -> str:
    subs = ", ".join(sub_index_for(p, f"{prefix}{K.COLUMN_OF[p]}") for p in K.AQI_BREAKPOINTS)
    return f"coalesce(greatest({subs}), {K.AQI_WHEN_NO_POLLUTANT})"


DAILY_ROWS = f"""drows AS (SELECT *, {overall_wide()} AS aqi FROM repaired)"""


def daily_rows_ctes() -> tuple[str, ...]:
    return (*BASE, VALID, CONC, complete_cte(), REPAIRED, DAILY_ROWS)


def linear(pm25: str) -> str:
    return f"({dbl(K.LINEAR_SLOPE)} * {pm25} + {dbl(K.LINEAR_INTERCEPT)})"


def split_bucket(key: str) -> str:
    return f"CAST(CAST(('0x' || substr(md5({key}), 1, 8)) AS BIGINT) % 100 AS INTEGER)"


def current_ctes(today: str) -> tuple[str, ...]:
    d = K.WEATHER_KEY_DEFAULTS
    cols = ", ".join(f"CAST({f} AS DOUBLE) AS {k}" for k, f in T.CURRENT_FORMULAS.items())
    return (
        f"""cstats AS (SELECT city, min(value) AS vmin, CAST(avg(CAST(value AS DECIMAL(38,10))) AS DOUBLE) AS vavg FROM valid
  WHERE date = DATE '{today}' GROUP BY city)""",
        f"cur AS (SELECT city, vmin, {cols} FROM cstats)",
        f"""six_all AS (
  SELECT city, date, T, RH, WS, WD, RF, BP, weather_matched, 'forecast' AS source FROM six WHERE date <> DATE '{today}'
  UNION ALL
  SELECT r.city, r.date, coalesce(c.temperature_2m, {dbl(d['T'])}), coalesce(c.relative_humidity_2m, {dbl(d['RH'])}),
         coalesce(c.wind_speed_10m, {dbl(d['WS'])}), {dbl(d['WD'])}, coalesce(c.vmin, {dbl(d['RF'])}),
         coalesce(c.surface_pressure, {dbl(d['BP'])}), false, 'current'
  FROM (SELECT DISTINCT city, date FROM valid WHERE date = DATE '{today}') r LEFT JOIN cur c ON r.city = c.city)""",
    )
