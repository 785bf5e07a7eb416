"""Registered queries: one per operator of the inventory.

Each query is a callable ``(spark, sf_dir) -> DataFrame`` over the driver
tables (through the derivations of ``aqlens.sources.tables``), paired with
an SQL twin for DuckDB when the operator is expressible in SQL.  Derived
doubles are rounded the same way on both sides (``rnd``); counts are
bigint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aqlens import constants as K
from aqlens.functions import exprs as X
from aqlens.operators import activity as Ac
from aqlens.operators import aqi as A
from aqlens.operators import dashboard as D
from aqlens.operators import features as Fe
from aqlens.operators import quality as Q
from aqlens.operators import readings as R
from aqlens.operators import weather as W
from aqlens.plans import daily as Dy
from aqlens.plans import models as M
from aqlens.plans import oracle as O
from aqlens.plans import training as Tr
from aqlens.session import scratch_path, written
from aqlens.sources import files as Fs
from aqlens.sources import tables as T
from aqlens.streaming import ingest as Sx

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def finish(df: DataFrame) -> DataFrame:
    """Dates and timestamps leave as text, so both engines hash them alike."""
    out = []
    for f in df.schema.fields:
        t = f.dataType.typeName()
        if t == "date":
            out.append(F.date_format(F.col(f.name), "yyyy-MM-dd").alias(f.name))
        elif t.startswith("timestamp"):
            out.append(F.date_format(F.col(f.name), "yyyy-MM-dd HH:mm:ss").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return finish(fn(spark, sf))

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run

    return deco


def _readings(spark: SparkSession, sf: str) -> DataFrame:
    return T.readings(spark, sf)


def _valid(spark: SparkSession, sf: str) -> DataFrame:
    return R.valid(R.normalise(_readings(spark, sf)))


# ---------------------------------------------------------------------------
# AQI (O-M12, O-J4, O-F14, O-F17..F21, O-A13, O-A14)
# ---------------------------------------------------------------------------
@query(
    "city_air_quality",
    O.final(
        O.DAILY,
        f"""SELECT city, date, aqi, {O.category('aqi')} AS category, driving_pollutant, driving_sub_index,
       n_pollutants FROM overall""",
    ),
)
def city_air_quality(spark, sf):
    """Daily AQI per city with category and driving pollutant (flagship)."""
    return A.city_air_quality(_readings(spark, sf))


_SUB_SQL = O.final(
    O.DAILY[:-1],
    f"SELECT city, date, pollutant, {O.rnd('value')} AS value, sub_index FROM subs WHERE sub_index IS NOT NULL",
)


@query("aqi_sub_index", _SUB_SQL)
def aqi_sub_index(spark, sf):
    s = A.sub_indices(_readings(spark, sf)).filter(F.col("sub_index").isNotNull())
    return s.select("city", "date", "pollutant", X.rnd(F.col("value")).alias("value"), "sub_index")


@query("aqi_sub_index_join", _SUB_SQL)
def aqi_sub_index_join(spark, sf):
    conc = A.daily_concentrations(_readings(spark, sf))
    s = A.with_sub_index_join(conc).filter(F.col("sub_index").isNotNull())
    return s.select("city", "date", "pollutant", X.rnd(F.col("value")).alias("value"), "sub_index")


@query("aqi_overall", O.final(O.DAILY, "SELECT city, date, aqi, n_pollutants FROM overall"))
def aqi_overall(spark, sf):
    return A.city_air_quality(_readings(spark, sf)).select("city", "date", "aqi", "n_pollutants")


@query(
    "aqi_category_counts",
    O.final(
        O.DAILY,
        f"""SELECT category, n_days, {O.rnd('100.0 * n_days / sum(n_days) OVER ()')} AS share_pct
FROM (SELECT {O.category('aqi')} AS category, count(*) AS n_days FROM overall GROUP BY 1)""",
        dates=(),
    ),
)
def aqi_category_counts(spark, sf):
    counts = A.city_air_quality(_readings(spark, sf)).groupBy("category").agg(F.count(F.lit(1)).alias("n_days"))
    # At most six category rows reach this window.
    total = F.sum("n_days").over(Window.partitionBy())
    return counts.select("category", "n_days", X.rnd(F.lit(100.0) * F.col("n_days") / total).alias("share_pct"))


@query(
    "driving_pollutant",
    O.final(
        O.DAILY,
        """SELECT driving_pollutant, count(*) AS n_days, max(driving_sub_index) AS max_sub_index
FROM overall GROUP BY driving_pollutant""",
        dates=(),
    ),
)
def driving_pollutant(spark, sf):
    return (
        A.city_air_quality(_readings(spark, sf))
        .groupBy("driving_pollutant")
        .agg(F.count(F.lit(1)).alias("n_days"), F.max("driving_sub_index").alias("max_sub_index"))
    )


@query(
    "health_message",
    O.final(
        O.DAILY,
        f"""SELECT city, date, aqi, {O.category('aqi', 1)} AS health_message, {O.category('aqi', 2)} AS colour
FROM overall""",
    ),
)
def health_message(spark, sf):
    d = A.city_air_quality(_readings(spark, sf))
    return d.select(
        "city",
        "date",
        "aqi",
        X.health_message(F.col("aqi")).alias("health_message"),
        X.category_colour(F.col("aqi")).alias("colour"),
    )


# ---------------------------------------------------------------------------
# Cleaning and completion (O-M13: O-F10, F11, J3, A15/b/c, J5, F22)
# ---------------------------------------------------------------------------
@query(
    "alias_normalise",
    O.final(O.BASE, "SELECT pollutant_id, pollutant, count(*) AS n_readings FROM norm GROUP BY 1, 2", dates=()),
)
def alias_normalise(spark, sf):
    n = R.normalise(_readings(spark, sf))
    return n.groupBy("pollutant_id", "pollutant").agg(F.count(F.lit(1)).alias("n_readings"))


@query(
    "numeric_coerce",
    O.final(
        O.BASE,
        f"""SELECT pollutant, count(*) AS n_readings, count(value) AS n_numeric,
       count(*) - count(value) AS n_missing, {O.rnd('min(value)')} AS min_value, {O.rnd('max(value)')} AS max_value,
       {O.rnd('sum(value_min)')} AS sum_min, {O.rnd('sum(value_max)')} AS sum_max
FROM norm GROUP BY pollutant""",
        dates=(),
    ),
)
def numeric_coerce(spark, sf):
    n = R.normalise(_readings(spark, sf))
    return n.groupBy("pollutant").agg(
        F.count(F.lit(1)).alias("n_readings"),
        F.count("value").alias("n_numeric"),
        (F.count(F.lit(1)) - F.count("value")).alias("n_missing"),
        X.rnd(F.min("value")).alias("min_value"),
        X.rnd(F.max("value")).alias("max_value"),
        X.rnd(F.sum("value_min")).alias("sum_min"),
        X.rnd(F.sum("value_max")).alias("sum_max"),
    )


@query(
    "pairwise_fold",
    O.final(
        (*O.BASE, O.VALID),
        f"""SELECT city, date, pollutant,
       {O.rnd('sum(value * pow(2.0, -r)) + arg_min(value, reading_id) * pow(2.0, -count(*))')} AS value
FROM (SELECT *, row_number() OVER (PARTITION BY city, date, pollutant ORDER BY reading_id DESC) AS r FROM valid)
GROUP BY city, date, pollutant""",
    ),
)
def pairwise_fold(spark, sf):
    f = R.pair_fold(_valid(spark, sf), ["city", "date"])
    return f.select("city", "date", "pollutant", X.rnd(F.col("value")).alias("value"))


@query(
    "station_mean",
    O.final((*O.BASE, O.VALID, O.CONC), f"SELECT city, date, pollutant, {O.rnd('value')} AS value FROM conc"),
)
def station_mean(spark, sf):
    m = R.station_mean(_valid(spark, sf), ["city", "date"])
    return m.select("city", "date", "pollutant", X.rnd(F.col("value")).alias("value"))


@query(
    "first_value",
    O.final(
        (*O.BASE, O.VALID),
        f"SELECT city, date, pollutant, {O.rnd('arg_min(value, reading_id)')} AS value FROM valid GROUP BY 1, 2, 3",
    ),
)
def first_value(spark, sf):
    m = R.first_value(_valid(spark, sf), ["city", "date"])
    return m.select("city", "date", "pollutant", X.rnd(F.col("value")).alias("value"))


_WIDE_COLS = ", ".join(f"{O.rnd(c)} AS {c}" for c in K.POLLUTANT_COLUMNS)


@query(
    "complete_defaults",
    O.final((*O.BASE, O.VALID, O.CONC, O.complete_cte()), f"SELECT city, date, {_WIDE_COLS} FROM wide"),
)
def complete_defaults(spark, sf):
    w = R.complete(R.station_mean(_valid(spark, sf), ["city", "date"]), ["city", "date"])
    return w.select("city", "date", *[X.rnd(F.col(c)).alias(c) for c in K.POLLUTANT_COLUMNS])


@query(
    "pm_repair",
    O.final(
        (*O.BASE, O.VALID, O.CONC, O.complete_cte(), O.REPAIRED),
        f"SELECT city, date, {O.rnd('pm25')} AS pm25, {O.rnd('pm10')} AS pm10, pm_repaired FROM repaired",
    ),
)
def pm_repair(spark, sf):
    w = R.pollutant_rows(_readings(spark, sf))
    return w.select("city", "date", X.rnd(F.col("pm25")).alias("pm25"), X.rnd(F.col("pm10")).alias("pm10"), "pm_repaired")


# ---------------------------------------------------------------------------
# Dashboard (O-A1..A9, O-T1..T6, O-P2..P10)
# ---------------------------------------------------------------------------
_good = [f"good_{y}" for y in T.ORDER_YEARS]
_bad = [f"bad_{y}" for y in T.ORDER_YEARS]
_year_cols = ",\n         ".join(
    f"CAST(count(*) FILTER (WHERE year(o.o_orderdate) = {y} AND o.o_totalprice {op} {O.dbl(T.ORDER_PRICE_CUT)}) AS INTEGER) AS {k}_{y}"
    for y in T.ORDER_YEARS
    for k, op in (("good", "<="), ("bad", ">"))
)
YEARLY = f"""yearly AS (
  SELECT g.n_nationkey + 1 AS sl_no, g.state, g.city, {", ".join(f"p.{k}_{y}" for y in T.ORDER_YEARS for k in ("good", "bad"))}
  FROM (SELECT c.c_nationkey AS nk,
         {_year_cols}
        FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY c.c_nationkey) p
  JOIN geo g ON p.nk = g.n_nationkey)"""
YEARLY_M = f"""ym AS (
  SELECT *, CAST({" + ".join(f"coalesce({c}, 0)" for c in _good)} AS BIGINT) AS total_good_days,
         CAST({" + ".join(f"coalesce({c}, 0)" for c in _bad)} AS BIGINT) AS total_bad_days
  FROM yearly),
ym2 AS (
  SELECT *, total_good_days + total_bad_days AS total_days,
         coalesce(CAST(total_good_days AS DOUBLE) / nullif(total_good_days + total_bad_days, 0) * 100, 0.0) AS good_pct
  FROM ym)"""
STATE_M = """city_state AS (SELECT DISTINCT city, state FROM geo),
sdays AS (
  SELECT s.state, o.city, CAST(count(*) FILTER (WHERE o.aqi <= 200) AS INTEGER) AS good_days,
         CAST(count(*) FILTER (WHERE o.aqi > 200) AS INTEGER) AS bad_days
  FROM overall o JOIN city_state s ON o.city = s.city GROUP BY s.state, o.city),
sm AS (
  SELECT *, coalesce(good_days, 0) + coalesce(bad_days, 0) AS total_days,
         coalesce(CAST(coalesce(good_days, 0) AS DOUBLE) / nullif(coalesce(good_days, 0) + coalesce(bad_days, 0), 0) * 100, 0.0) AS good_pct,
         50.0 + coalesce(CAST(coalesce(bad_days, 0) AS DOUBLE) / nullif(coalesce(good_days, 0) + coalesce(bad_days, 0), 0) * 300, 0.0) AS estimated_aqi
  FROM sdays)"""


def _yearly(spark, sf):
    return D.yearly_metrics(T.yearly_counts(spark, sf))


def _state(spark, sf):
    return D.state_metrics(D.state_day_counts(_readings(spark, sf)))


@query(
    "city_good_bad",
    O.final(
        (O.GEO, YEARLY, YEARLY_M),
        "SELECT city, CAST(sum(total_good_days) AS BIGINT) AS total_good_days, CAST(sum(total_bad_days) AS BIGINT) AS total_bad_days FROM ym2 GROUP BY city",
        dates=(),
    ),
)
def city_good_bad(spark, sf):
    return D.city_totals(_yearly(spark, sf)).select(
        "city", F.col("total_good_days").cast("bigint").alias("total_good_days"), F.col("total_bad_days").cast("bigint").alias("total_bad_days")
    )


@query(
    "row_percentage",
    O.final(
        (O.GEO, YEARLY, YEARLY_M),
        f"SELECT sl_no, city, total_good_days, total_bad_days, total_days, {O.rnd('good_pct')} AS good_pct FROM ym2",
        dates=(),
    ),
)
def row_percentage(spark, sf):
    y = _yearly(spark, sf)
    return y.select("sl_no", "city", "total_good_days", "total_bad_days", "total_days", X.rnd(F.col("good_pct")).alias("good_pct"))


@query(
    "yearly_stats",
    O.final(
        (O.GEO, YEARLY, YEARLY_M),
        f"""SELECT {O.rnd('avg(good_pct)')} AS mean_good_pct, CAST(sum(total_good_days) AS BIGINT) AS total_good_days,
       CAST(sum(total_bad_days) AS BIGINT) AS total_bad_days FROM ym2""",
        dates=(),
    ),
)
def yearly_stats(spark, sf):
    s = D.overall_stats(_yearly(spark, sf))
    return s.select(
        X.rnd(F.col("mean_good_pct")).alias("mean_good_pct"),
        F.col("total_good_days").cast("bigint").alias("total_good_days"),
        F.col("total_bad_days").cast("bigint").alias("total_bad_days"),
    )


@query(
    "state_metrics",
    O.final(
        (*O.DAILY, STATE_M),
        f"""SELECT state, city, good_days, bad_days, total_days, {O.rnd('good_pct')} AS good_pct,
       {O.rnd('estimated_aqi')} AS estimated_aqi FROM sm""",
        dates=(),
    ),
)
def state_metrics(spark, sf):
    s = _state(spark, sf)
    return s.select(
        "state", "city", "good_days", "bad_days", "total_days",
        X.rnd(F.col("good_pct")).alias("good_pct"), X.rnd(F.col("estimated_aqi")).alias("estimated_aqi"),
    )


@query(
    "estimated_aqi_state_top10",
    O.final(
        (*O.DAILY, STATE_M),
        f"""SELECT state, {O.rnd('m')} AS mean_estimated_aqi FROM
(SELECT state, avg(estimated_aqi) AS m FROM sm GROUP BY state ORDER BY m DESC, state LIMIT 10)""",
        dates=(),
    ),
)
def estimated_aqi_state_top10(spark, sf):
    t = D.top_by_mean(_state(spark, sf), "state", "estimated_aqi", 10)
    return t.select("state", X.rnd(F.col("mean_estimated_aqi")).alias("mean_estimated_aqi"))


@query(
    "good_pct_state_top10",
    O.final(
        (*O.DAILY, STATE_M),
        f"""SELECT state, {O.rnd('m')} AS mean_good_pct FROM
(SELECT state, avg(good_pct) AS m FROM sm GROUP BY state ORDER BY m DESC, state LIMIT 10)""",
        dates=(),
    ),
)
def good_pct_state_top10(spark, sf):
    t = D.top_by_mean(_state(spark, sf), "state", "good_pct", 10)
    return t.select("state", X.rnd(F.col("mean_good_pct")).alias("mean_good_pct"))


@query(
    "national_tiles",
    O.final(
        O.BASE,
        f"""SELECT count(*) AS n_rows, count(DISTINCT station) AS n_stations, count(DISTINCT state) AS n_states,
       count(DISTINCT city) AS n_cities, {O.rnd('avg(value)')} AS mean_aqi, {O.rnd('max(value)')} AS max_aqi,
       {O.fmt_ts('max(datetime)')} AS latest_update FROM norm""",
        dates=(),
    ),
)
def national_tiles(spark, sf):
    t = D.tiles(R.normalise(_readings(spark, sf)))
    return t.withColumns({"mean_aqi": X.rnd(F.col("mean_aqi")), "max_aqi": X.rnd(F.col("max_aqi"))})


@query(
    "pollutant_frequency",
    O.final(
        O.BASE,
        f"""SELECT pollutant_id, n, {O.rnd('100.0 * n / sum(n) OVER ()')} AS share_pct
FROM (SELECT pollutant_id, count(*) AS n FROM norm GROUP BY pollutant_id)""",
        dates=(),
    ),
)
def pollutant_frequency(spark, sf):
    f = D.frequency(R.normalise(_readings(spark, sf)), "pollutant_id")
    return f.select("pollutant_id", "n", X.rnd(F.col("share_pct")).alias("share_pct"))


@query(
    "latest_50",
    O.final(
        O.BASE,
        f"""SELECT reading_id, state, city, station, pollutant_id, {O.rnd('value')} AS value, last_update
FROM norm ORDER BY datetime DESC NULLS LAST, reading_id DESC LIMIT 50""",
        dates=(),
    ),
)
def latest_50(spark, sf):
    return D.latest(R.normalise(_readings(spark, sf)), 50).withColumn("value", X.rnd(F.col("value")))


@query(
    "distinct_options",
    O.final(
        O.BASE,
        f"""SELECT DISTINCT 'state' AS kind, {O.strip('state')} AS value FROM readings WHERE length({O.strip('state')}) > 0
UNION ALL
SELECT DISTINCT 'city' AS kind, {O.strip('city')} AS value FROM readings WHERE length({O.strip('city')}) > 0""",
        dates=(),
    ),
)
def distinct_options(spark, sf):
    return D.distinct_options(_readings(spark, sf))


FILTER_STATE = "ASIA"


@query(
    "filter_state_city",
    O.final(
        O.BASE,
        f"""SELECT reading_id, state, city, station, pollutant, {O.rnd('value')} AS value
FROM norm WHERE state = {O.q(FILTER_STATE)}""",
        dates=(),
    ),
)
def filter_state_city(spark, sf):
    f = D.filter_state_city(R.normalise(_readings(spark, sf)), state=FILTER_STATE, city=D.ALL)
    return f.select("reading_id", "state", "city", "station", "pollutant", X.rnd(F.col("value")).alias("value"))


@query(
    "map_points",
    O.final(
        O.BASE,
        f"""SELECT reading_id, lat, lon, state, city, station, pollutant_id, {O.rnd('value')} AS value,
       {O.rnd('coalesce(value, 10.0)')} AS marker_value
FROM norm WHERE lat IS NOT NULL AND lon IS NOT NULL""",
        dates=(),
    ),
)
def map_points(spark, sf):
    m = D.map_points(R.normalise(_readings(spark, sf)))
    return m.withColumns({"value": X.rnd(F.col("value")), "marker_value": X.rnd(F.col("marker_value"))})


# ---------------------------------------------------------------------------
# Weather (O-S7, O-S8, O-J1, O-J2, O-J6, O-F25, O-F27, O-F28)
# ---------------------------------------------------------------------------

_W = (*O.BASE, O.VALID, *O.weather_ctes())
_WCOLS = ", ".join(f"{O.rnd(k)} AS weather_{k}" for k in K.DAILY_WEATHER_VARS)


@query("weather_parse", O.final(_W, f"SELECT city, date, {_WCOLS} FROM wdaily"))
def weather_parse(spark, sf):
    p = W.parse_daily(T.daily_weather_docs(spark, sf))
    return p.select("city", "date", *[X.rnd(F.col(c)).alias(c) for c in W.WEATHER_COLUMNS])


@query(
    "weather_join",
    O.final(
        (*_W, O.CONC, O.complete_cte()),
        f"SELECT city, date, {_WIDE_COLS}, {_WCOLS} FROM wide JOIN wdaily USING (city, date)",
    ),
)
def weather_join(spark, sf):
    pol = R.complete(R.station_mean(_valid(spark, sf), ["city", "date"]), ["city", "date"])
    wx = W.parse_daily(T.daily_weather_docs(spark, sf))
    j = pol.join(wx, ["city", "date"], "inner")
    return j.select("city", "date", *[X.rnd(F.col(c)).alias(c) for c in K.POLLUTANT_COLUMNS + W.WEATHER_COLUMNS])


def _six(spark, sf):
    return W.match_forecast_day(T.weather_requests(spark, sf), T.forecast_docs(spark, sf))


_SIX = (*_W, *O.forecast_match_ctes())


@query(
    "weather_date_match",
    O.final(
        _SIX,
        f"""SELECT city, date, {O.rnd('T')} AS T, {O.rnd('RH')} AS RH, {O.rnd('WS')} AS WS, {O.rnd('WD')} AS WD,
       {O.rnd('RF')} AS RF, {O.rnd('BP')} AS BP, weather_matched FROM six""",
    ),
)
def weather_date_match(spark, sf):
    s = _six(spark, sf)
    return s.select("city", "date", *[X.rnd(F.col(k)).alias(k) for k in K.WEATHER_KEY_DEFAULTS], "weather_matched")


_SYN = {
    "weather_temperature_2m_max": f"T + {O.dbl(K.SYNTH_TEMP_SPREAD)}",
    "weather_temperature_2m_min": f"T - {O.dbl(K.SYNTH_TEMP_SPREAD)}",
    "weather_temperature_2m_mean": "T",
    "weather_relative_humidity_2m_max": f"least(CAST(100 AS DOUBLE), RH + {O.dbl(K.SYNTH_RH_SPREAD)})",
    "weather_relative_humidity_2m_min": f"greatest(CAST(0 AS DOUBLE), RH - {O.dbl(K.SYNTH_RH_SPREAD)})",
    "weather_relative_humidity_2m_mean": "RH",
    "weather_precipitation_sum": "RF",
    "weather_rain_sum": "RF",
    "weather_snowfall_sum": "CAST(0 AS DOUBLE)",
    "weather_wind_speed_10m_max": f"WS + {O.dbl(K.SYNTH_WIND_SPREAD)}",
    "weather_wind_speed_10m_mean": "WS",
    "weather_wind_direction_10m_dominant": "WD",
    "weather_wind_gusts_10m_max": f"WS + {O.dbl(K.SYNTH_WIND_SPREAD)} + {O.dbl(K.SYNTH_GUST_EXTRA)}",
    "weather_pressure_msl_mean": "BP",
    "weather_sunshine_duration": O.dbl(K.SYNTH_SUNSHINE),
}


@query(
    "weather_synth",
    O.final(_SIX, "SELECT city, date, " + ", ".join(f"{O.rnd(v)} AS {k}" for k, v in _SYN.items()) + " FROM six"),
)
def weather_synth(spark, sf):
    s = W.synthesise_daily(_six(spark, sf))
    return s.select("city", "date", *[X.rnd(F.col(c)).alias(c) for c in _SYN])


_unpivot = "\nUNION ALL\n".join(
    f"SELECT city, date, {O.q(k)} AS key, {O.q(K.WEATHER_KEY_LABELS[k])} AS label, CAST({k} AS DOUBLE) AS value FROM six"
    for k in K.WEATHER_KEY_DEFAULTS
)


@query(
    "weather_display_map",
    O.final(
        _SIX,
        f"SELECT city, date, key, label, {O.round1_half_even('value')} AS value FROM ({_unpivot}) WHERE value <> 0 OR key = 'T'",
    ),
)
def weather_display_map(spark, sf):
    return W.display_entries(_six(spark, sf))


_city_rows = ", ".join(
    "({}, {}, {}, {}, {})".format(
        O.q(c), O.dbl(lat), O.dbl(lon),
        O.q(K.CITY_INFO[c][2]) if c in K.CITY_INFO else "NULL",
        O.q(K.CITY_INFO[c][3]) if c in K.CITY_INFO else "NULL",
    )
    for c, (lat, lon) in K.CITY_COORDINATES.items()
)
_dlat, _dlon = K.CITY_COORDINATES[K.DEFAULT_CITY]


@query(
    "city_lookup_default",
    O.final(
        (O.GEO, O.READINGS, f"dim(dim_city, dim_lat, dim_lon, dim_region, dim_population) AS (VALUES {_city_rows})"),
        f"""SELECT c.city, coalesce(d.dim_lat, {O.dbl(_dlat)}) AS latitude, coalesce(d.dim_lon, {O.dbl(_dlon)}) AS longitude,
       coalesce(d.dim_region, {O.q(K.CITY_INFO_DEFAULT[2])}) AS region, d.dim_population AS population,
       d.dim_city IS NOT NULL AS known_city
FROM (SELECT DISTINCT city FROM readings) c LEFT JOIN dim d ON c.city = d.dim_city""",
        dates=(),
    ),
)
def city_lookup_default(spark, sf):
    cities = _readings(spark, sf).select("city").distinct()
    return W.with_city_lookup(cities)


TODAY = "2024-01-15"


@query(
    "date_class",
    O.final(
        (*O.BASE, O.VALID),
        f"""SELECT date, CASE WHEN date < DATE '{TODAY}' THEN 'past' WHEN date = DATE '{TODAY}' THEN 'today' ELSE 'future' END AS date_class,
       date BETWEEN DATE '{TODAY}' - INTERVAL 7 DAY AND DATE '{TODAY}' + INTERVAL 7 DAY AS in_window, count(*) AS n_readings
FROM valid GROUP BY date""",
    ),
)
def date_class(spark, sf):
    v = _valid(spark, sf).groupBy("date").agg(F.count(F.lit(1)).alias("n_readings"))
    cls, inside = W.date_class(F.col("date"), TODAY)
    return v.select("date", cls.alias("date_class"), inside.alias("in_window"), "n_readings")


# ---------------------------------------------------------------------------
# Quality (O-A10, O-A12, O-A23, O-P15, O-F13, O-F23, O-F24)
# ---------------------------------------------------------------------------

_PROFILE_COLS = ["pollutant_id", "pollutant", "value", "value_min", "value_max", "datetime", "lat", "lon"]


@query(
    "null_profile",
    O.final(
        O.BASE,
        "\nUNION ALL\n".join(
            f"SELECT {O.q(c)} AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS n_null, count(*) AS n_rows FROM norm"
            for c in _PROFILE_COLS
        ),
        dates=(),
    ),
)
def null_profile(spark, sf):
    return Q.null_profile(R.normalise(_readings(spark, sf)), _PROFILE_COLS)


_bounds = O.case("pollutant", {p: O.dbl(v) for p, v in K.INPUT_BOUNDS.items()}, raw_values=True)


@query(
    "bounds_check",
    O.final(
        O.BASE,
        f"""SELECT pollutant, count(*) AS n,
       count(*) FILTER (WHERE value BETWEEN 0 AND {_bounds}) AS n_in_bounds,
       count(*) FILTER (WHERE NOT (value BETWEEN 0 AND {_bounds})) AS n_out_of_bounds
FROM norm GROUP BY pollutant""",
        dates=(),
    ),
)
def bounds_check(spark, sf):
    return Q.bounds_summary(R.normalise(_readings(spark, sf)))


def _sanity_sql() -> str:
    lo, hi = O.expected("pm25", 0), O.expected("pm25", 1)
    tol = K.SANITY_TOLERANCE
    est = O.linear("pm25")
    issues = [
        f"CASE WHEN aqi < ({lo}) - {tol} THEN 'AQI_FAR_BELOW' WHEN aqi > ({hi}) + {tol} THEN 'AQI_FAR_ABOVE' END",
    ]
    warns = [
        f"CASE WHEN aqi >= ({lo}) - {tol} AND aqi <= ({hi}) + {tol} AND NOT (aqi BETWEEN ({lo}) AND ({hi})) THEN 'AQI_OUTSIDE_TYPICAL' END",
        "CASE WHEN pm10 > 0 AND pm25 > 0 AND pm10 < pm25 THEN 'PM10_BELOW_PM25' END",
        f"CASE WHEN no2 > {K.NO2_WARN} THEN 'NO2_HIGH' END",
        f"CASE WHEN so2 > {K.SO2_WARN} THEN 'SO2_HIGH' END",
        f"CASE WHEN pm25 > 0 AND abs(aqi - {est}) > {K.LINEAR_MAX_DIFF} THEN 'LINEAR_GAP' END",
    ]
    n_i = " + ".join(f"(CASE WHEN ({x}) IS NOT NULL THEN 1 ELSE 0 END)" for x in issues)
    n_w = " + ".join(f"(CASE WHEN ({x}) IS NOT NULL THEN 1 ELSE 0 END)" for x in warns)
    return f"""SELECT city, date, {O.rnd('pm25')} AS pm25, aqi, {lo} AS expected_lo, {hi} AS expected_hi,
       CAST({n_i} AS INTEGER) AS n_issues, CAST({n_w} AS INTEGER) AS n_warnings, ({n_i}) = 0 AS is_reasonable,
       concat_ws(',', {", ".join(issues + warns)}) AS codes
FROM drows"""


@query("sanity_check", O.final(O.daily_rows_ctes(), _sanity_sql()))
def sanity_check(spark, sf):
    s = Q.sanity(Dy.daily_rows(spark, sf))
    return s.select(
        "city", "date", X.rnd(F.col("pm25")).alias("pm25"), "aqi", "expected_lo", "expected_hi", "n_issues", "n_warnings",
        "is_reasonable", F.concat_ws(",", F.concat("issues", "warnings")).alias("codes"),
    )


@query(
    "linear_estimate",
    O.final(
        O.daily_rows_ctes(),
        f"""SELECT city, date, {O.rnd('pm25')} AS pm25, aqi, {O.rnd(O.linear('pm25'))} AS estimate,
       {O.rnd(f"abs(aqi - {O.linear('pm25')})")} AS gap, pm25 > 0 AND abs(aqi - {O.linear('pm25')}) > {K.LINEAR_MAX_DIFF} AS gap_flag
FROM drows""",
    ),
)
def linear_estimate(spark, sf):
    s = Q.linear_check(Dy.daily_rows(spark, sf))
    return s.select(
        "city", "date", X.rnd(F.col("pm25")).alias("pm25"), "aqi", X.rnd(F.col("estimate")).alias("estimate"),
        X.rnd(F.col("gap")).alias("gap"), "gap_flag",
    )


# ---------------------------------------------------------------------------
# Features (O-F7..F9, O-W1, O-F26, O-A11, O-P12, O-A18, O-M4)
# ---------------------------------------------------------------------------
@query(
    "calendar_features",
    O.final(
        O.daily_rows_ctes(),
        f"""SELECT city, date, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month,
       CAST(dayofyear(date) AS INTEGER) AS day_of_year, {O.season_name('month(date)')} AS season,
       {O.season_code('month(date)')} AS season_encoded FROM drows""",
    ),
)
def calendar_features(spark, sf):
    c = Fe.calendar(Dy.daily_rows(spark, sf))
    return c.select("city", "date", "year", "month", "day_of_year", "season", "season_encoded")


@query(
    "reading_time_parts",
    O.final(
        O.BASE,
        """SELECT reading_id, CAST(hour(datetime) AS INTEGER) AS hour, CAST(day(datetime) AS INTEGER) AS day,
       CAST(month(datetime) AS INTEGER) AS month FROM norm""",
        dates=(),
    ),
)
def reading_time_parts(spark, sf):
    return R.normalise(_readings(spark, sf)).select("reading_id", "hour", "day", "month")


@query(
    "category_codes",
    O.final(
        (*O.daily_rows_ctes(), "codes AS (SELECT city AS c, CAST(dense_rank() OVER (ORDER BY city) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT city FROM drows))"),
        "SELECT city, date, coalesce(code, -1) AS city_encoded FROM drows LEFT JOIN codes ON city = c",
    ),
)
def category_codes(spark, sf):
    return Fe.with_codes(Dy.daily_rows(spark, sf), ["city"]).select("city", "date", "city_encoded")


_raw_ids = sorted(set(T.EVENT_POLLUTANT.values()))


@query(
    "one_hot",
    O.final(
        O.BASE,
        "SELECT reading_id, "
        + ", ".join(f"coalesce(pollutant_id = {O.q(v)}, false) AS {Fe.one_hot_name('pollutant', v)}" for v in _raw_ids)
        + " FROM norm",
        dates=(),
    ),
)
def one_hot(spark, sf):
    n = R.normalise(_readings(spark, sf))
    values = Fe.distinct_values(n, "pollutant_id")
    oh = Fe.one_hot(n, "pollutant_id", "pollutant", values)
    return oh.select("reading_id", *[Fe.one_hot_name("pollutant", v) for v in values])


_OBS = [K.COLUMN_OF[p] for p in sorted(set(K.POLLUTANT_ALIASES[v.upper()] for v in T.EVENT_POLLUTANT.values()))]
_OBS_SQL = ", ".join(f"max(CASE WHEN pollutant = {O.q(p)} THEN value END) AS {K.COLUMN_OF[p]}" for p in K.POLLUTANT_NAMES if K.COLUMN_OF[p] in _OBS)
_OBS_CTE = f"obs AS (SELECT city, date, {_OBS_SQL} FROM conc GROUP BY city, date)"


def _obs(spark, sf):
    pols = [p for p in K.POLLUTANT_NAMES if K.COLUMN_OF[p] in _OBS]
    return R.pivot_wide(R.station_mean(_valid(spark, sf), ["city", "date"]), ["city", "date"], pols)


@query(
    "median_impute",
    O.final(
        (*O.BASE, O.VALID, O.CONC, _OBS_CTE),
        "SELECT city, date, " + ", ".join(f"{O.rnd(f'coalesce({c}, (SELECT median({c}) FROM obs))')} AS {c}" for c in _OBS) + " FROM obs",
    ),
)
def median_impute(spark, sf):
    m = Fe.median_impute(_obs(spark, sf), _OBS)
    return m.select("city", "date", *[X.rnd(F.col(c)).alias(c) for c in _OBS])


@query(
    "mean_impute",
    O.final(
        (*O.BASE, O.VALID, O.CONC, _OBS_CTE),
        "SELECT city, date, " + ", ".join(f"{O.rnd(f'coalesce({c}, (SELECT avg({c}) FROM obs))')} AS {c}" for c in _OBS) + " FROM obs",
    ),
)
def mean_impute(spark, sf):
    m = Fe.mean_impute(_obs(spark, sf), _OBS, K.TARGET_DEFAULTS)
    return m.select("city", "date", *[X.rnd(F.col(c)).alias(c) for c in _OBS])


def _aligned(spark, sf):
    return Fe.align(Dy.scoring_table(spark, sf), Dy.FEATURES_AQI, keep=["city", "date"])


_ALIGN_CTES = (
    *O.daily_rows_ctes(), *O.weather_ctes(), *O.forecast_match_ctes(),
    "syn AS (SELECT city, date, " + ", ".join(f"{v} AS {k}" for k, v in _SYN.items()) + " FROM six)",
    f"""aligned AS (
  SELECT d.city, d.date, {", ".join(f"CAST(d.{c} AS DOUBLE) AS {c}" for c in K.POLLUTANT_COLUMNS)},
         {", ".join(f"CAST(s.{c} AS DOUBLE) AS {c}" for c in W.WEATHER_COLUMNS)},
         CAST(year(d.date) AS DOUBLE) AS year, CAST(month(d.date) AS DOUBLE) AS month,
         CAST(dayofyear(d.date) AS DOUBLE) AS day_of_year, CAST({O.season_code('month(d.date)')} AS DOUBLE) AS season_encoded,
         CAST(0 AS DOUBLE) AS city_encoded
  FROM drows d JOIN syn s ON d.city = s.city AND d.date = s.date)""",
)


@query(
    "feature_align",
    O.final(_ALIGN_CTES, "SELECT city, date, " + ", ".join(f"{O.rnd(c)} AS {c}" for c in Dy.FEATURES_AQI) + " FROM aligned"),
)
def feature_align(spark, sf):
    a = _aligned(spark, sf)
    return a.select("city", "date", *[X.rnd(F.col(c)).alias(c) for c in Dy.FEATURES_AQI])


@query(
    "zero_feature_count",
    O.final(
        _ALIGN_CTES,
        "SELECT city, date, CAST(" + " + ".join(f"(CASE WHEN {c} = 0 THEN 1 ELSE 0 END)" for c in Dy.FEATURES_AQI)
        + f" AS INTEGER) AS n_zero, CAST({len(Dy.FEATURES_AQI)} - ("
        + " + ".join(f"(CASE WHEN {c} = 0 THEN 1 ELSE 0 END)" for c in Dy.FEATURES_AQI) + ") AS INTEGER) AS n_nonzero FROM aligned",
    ),
)
def zero_feature_count(spark, sf):
    a = _aligned(spark, sf)
    z = Fe.zero_count(Dy.FEATURES_AQI)
    return a.select("city", "date", z.cast("int").alias("n_zero"), (F.lit(len(Dy.FEATURES_AQI)) - z).cast("int").alias("n_nonzero"))


_KEY_SQL = "city || '|' || strftime(date, '%Y-%m-%d')"


@query(
    "hash_split",
    O.final(
        O.daily_rows_ctes(),
        f"SELECT city, date, {O.split_bucket(_KEY_SQL)} AS bucket, {O.split_bucket(_KEY_SQL)} < 20 AS is_test FROM drows",
    ),
)
def hash_split(spark, sf):
    d = Dy.daily_rows(spark, sf)
    return d.select("city", "date", Fe.split_bucket("city", "date").alias("bucket"), (Fe.split_bucket("city", "date") < 20).alias("is_test"))


# ---------------------------------------------------------------------------
# Metrics (O-A21, O-A22): the PM2.5-only estimate judged on the test split
# ---------------------------------------------------------------------------

_TEST = f"scored AS (SELECT CAST(aqi AS DOUBLE) AS y, {O.linear('pm25')} AS p FROM drows WHERE {O.split_bucket(_KEY_SQL)} < 20)"


@query(
    "regression_metrics",
    O.final(
        (*O.daily_rows_ctes(), _TEST),
        f"""SELECT count(*) AS n,
       {O.rnd('1 - sum((y - p) * (y - p)) / (sum(y * y) - sum(y) * sum(y) / count(*))')} AS r2,
       {O.rnd('avg(abs(y - p))')} AS mae FROM scored""",
        dates=(),
    ),
)
def regression_metrics(spark, sf):
    d = Fe.with_split(Dy.daily_rows(spark, sf), ["city", "date"]).filter("is_test")
    s = d.select(F.col("aqi").cast("double").alias("y"), X.linear_estimate(F.col("pm25")).alias("p"))
    m = M.regression_metrics(s, "y", "p")
    return m.select("n", X.rnd(F.col("r2")).alias("r2"), X.rnd(F.col("mae")).alias("mae"))


@query(
    "classification_metrics",
    O.final(
        (
            *O.daily_rows_ctes(),
            _TEST,
            f"cats AS (SELECT {O.category('y')} AS yc, {O.category('p')} AS pc FROM scored)",
            """per_class AS (
  SELECT c, sum(is_true) AS support, sum(1 - is_true) AS predicted, sum(is_true * hit) AS tp FROM (
    SELECT yc AS c, 1 AS is_true, CASE WHEN yc = pc THEN 1 ELSE 0 END AS hit FROM cats
    UNION ALL SELECT pc AS c, 0 AS is_true, CASE WHEN yc = pc THEN 1 ELSE 0 END AS hit FROM cats) GROUP BY c)""",
        ),
        f"""SELECT (SELECT count(*) FROM cats) AS n,
       {O.rnd('(SELECT avg(CASE WHEN yc = pc THEN 1.0 ELSE 0.0 END) FROM cats)')} AS accuracy,
       {O.rnd('sum(support * (2.0 * tp / (support + predicted))) / sum(support)')} AS f1_weighted FROM per_class""",
        dates=(),
    ),
)
def classification_metrics(spark, sf):
    d = Fe.with_split(Dy.daily_rows(spark, sf), ["city", "date"]).filter("is_test")
    c = d.select(X.aqi_category(F.col("aqi")).alias("y"), X.aqi_category(X.linear_estimate(F.col("pm25"))).alias("p"))
    m = M.classification_metrics(c, "y", "p")
    return m.select("n", X.rnd(F.col("accuracy")).alias("accuracy"), X.rnd(F.col("f1_weighted")).alias("f1_weighted"))


# ---------------------------------------------------------------------------
# Activity (O-A16, O-W2, O-F31, O-F33) and fills (O-P17)
# ---------------------------------------------------------------------------
_ACT = f"""act AS (
  SELECT 'S' || CAST(user_id AS VARCHAR) AS session_id, ts AS timestamp, {O.case('event_type', T.EVENT_ACTIVITY)} AS event_type,
         event_id AS seq, CASE WHEN event_type = 'error' THEN 'E' || CAST(event_id AS VARCHAR) END AS error
  FROM events)"""


@query(
    "session_summary",
    O.final(
        (_ACT,),
        "SELECT session_id, "
        + ", ".join(f"count(*) FILTER (WHERE event_type = {O.q(k)}) AS n_{k.lower()}" for k in K.EVENT_KINDS)
        + f""", count(*) AS n_total, count(error) AS n_error_records, {O.fmt_ts('min(timestamp)')} AS start_time,
       {O.fmt_ts('max(timestamp)')} AS end_time,
       {O.rnd('(epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1000000.0')} AS duration_seconds
FROM act GROUP BY session_id""",
        dates=(),
    ),
)
def session_summary(spark, sf):
    s = Ac.session_summary(T.activity_log(spark, sf))
    return s.withColumn("duration_seconds", X.rnd(F.col("duration_seconds")))


@query(
    "last_five",
    O.final(
        (_ACT,),
        f"""SELECT session_id, seq, {O.fmt_ts('timestamp')} AS timestamp, event_type, CAST(rk AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY timestamp DESC, seq DESC) AS rk FROM act)
WHERE rk <= {K.LAST_N_PREDICTIONS}""",
        dates=(),
    ),
)
def last_five(spark, sf):
    return Ac.last_n(T.activity_log(spark, sf)).select("session_id", "seq", "timestamp", "event_type", "rank")


@query(
    "constant_fill",
    O.final(
        O.BASE,
        f"""SELECT reading_id, {O.rnd('coalesce(value, 0)')} AS aqi,
       coalesce({O.category('value')}, {O.q(K.CATEGORY_FILL)}) AS category FROM norm""",
        dates=(),
    ),
)
def constant_fill(spark, sf):
    n = R.normalise(_readings(spark, sf)).select("reading_id", F.col("value").alias("aqi"))
    n = n.withColumn("category", X.aqi_category(F.col("aqi")))
    f = n.fillna({"aqi": 0.0, "category": K.CATEGORY_FILL})
    return f.select("reading_id", X.rnd(F.col("aqi")).alias("aqi"), "category")


# ---------------------------------------------------------------------------
# Models (O-M1..M11, O-A17, O-A19, O-T3, O-S10): forests get a rows-only check
# ---------------------------------------------------------------------------


@query("forest_aqi")
def forest_aqi(spark, sf):
    """Single-target AQI forest on features A; R^2 and MAE on the test split."""
    m = Tr.aqi_forest(spark, sf).metrics
    return m.select("target", "n", X.rnd(F.col("r2")).alias("r2"), X.rnd(F.col("mae")).alias("mae"))


@query("forest_six_targets")
def forest_six_targets(spark, sf):
    """One forest per target pollutant; per-target and macro-mean metrics."""
    m = Tr.with_overall(Tr.six_target_forest(spark, sf).metrics)
    return m.select("target", "n", X.rnd(F.col("r2")).alias("r2"), X.rnd(F.col("mae")).alias("mae"))


@query("forest_category")
def forest_category(spark, sf):
    """AQI regressor and category classifier on the live-reading features."""
    m = Tr.category_models(spark, sf)
    return m.select("n", *[X.rnd(F.col(c)).alias(c) for c in ("reg_r2", "reg_mae", "clf_f1", "clf_acc")])


@query("feature_importance")
def feature_importance(spark, sf):
    """Top 10 features by importance averaged over the six targets."""
    fit = Tr.six_target_forest(spark, sf)
    top = M.mean_importance(M.importance_table(spark, fit), 10)
    return top.select("feature", X.rnd(F.col("avg_importance")).alias("avg_importance"))


@query("batch_score")
def batch_score(spark, sf):
    """Saved, reloaded six-target model scoring every city-day."""
    s = Tr.batch_score(spark, sf)
    return s.select(*[X.rnd(F.col(c)).alias(c) if c.startswith("pred_") else F.col(c) for c in s.columns])


# ---------------------------------------------------------------------------
# Sources, sinks and streaming (O-S4, O-S6, O-S9, O-U1, O-X1, O-X2)
# ---------------------------------------------------------------------------


@query(
    "union_pages",
    O.final(O.BASE, f"SELECT reading_id, state, city, station, pollutant, {O.rnd('value')} AS value FROM norm", dates=()),
)
def union_pages(spark, sf):
    """Readings landed as JSON pages (many files), read back as one table."""
    path = scratch_path(spark, "pages")
    Fs.write_pages(_readings(spark, sf), path)
    n = R.normalise(Fs.read_pages(spark, path))
    return n.select("reading_id", "state", "city", "station", "pollutant", X.rnd(F.col("value")).alias("value"))


def _land_live(spark, sf, path: str) -> None:
    """Pages in the live feed's own shape: no arrival id, half of the records
    with the other value names, padded ids, four time layouts."""
    r = _readings(spark, sf)
    odd = F.pmod("reading_id", F.lit(2)) == 1
    t = F.to_timestamp("last_update", T.READING_TS_FORMAT)
    layouts = [T.READING_TS_FORMAT, "d/M/yyyy H:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss"]
    when = F.col("last_update")
    for k, layout in enumerate(layouts):
        when = F.when(F.pmod("reading_id", F.lit(len(layouts))) == k, F.date_format(t, layout)).otherwise(when)
    live = {f"{n}_value": F.when(odd, F.col(f"pollutant_{n}")) for n in ("min", "max", "avg")}
    own = {f"pollutant_{n}": F.when(~odd, F.col(f"pollutant_{n}")) for n in ("min", "max", "avg")}
    padded = F.concat(F.lit(" \u200b"), "pollutant_id", F.lit("\ufeff "))
    r = r.withColumn("last_update", when).withColumns({**live, **own, "pollutant_id": padded})
    Fs.write_pages(r, path, with_ids=False)


def _live(spark, sf) -> DataFrame:
    path = scratch_path(spark, "live")
    _land_live(spark, sf, path)
    return R.normalise(Fs.read_pages(spark, path, number=True))


@query(
    "live_feed",
    O.final(
        O.BASE,
        f"""SELECT state, city, station, pollutant, date, {O.rnd('value')} AS value, {O.rnd('value_min')} AS value_min,
       {O.rnd('value_max')} AS value_max FROM norm""",
    ),
)
def live_feed(spark, sf):
    """Readings landed as the live feed sends them lose no value."""
    n = _live(spark, sf)
    return n.select("state", "city", "station", "pollutant", "date", *[X.rnd(F.col(c)).alias(c) for c in ("value", "value_min", "value_max")])


@query(
    "live_feed_combined",
    O.final(
        (*O.BASE, O.VALID),
        f"""SELECT city, date, pollutant, {O.rnd('arg_min(value, reading_id)')} AS first_value,
       {O.rnd('sum(value * pow(2.0, -r)) + arg_min(value, reading_id) * pow(2.0, -count(*))')} AS folded
FROM (SELECT *, row_number() OVER (PARTITION BY city, date, pollutant ORDER BY reading_id DESC) AS r FROM valid)
GROUP BY city, date, pollutant""",
    ),
)
def live_feed_combined(spark, sf):
    """First value and ordered pair fold of live pages, by their arrival."""
    # written, as both results would clean the pages again
    rows = written(R.valid(_live(spark, sf)).select("reading_id", "city", "date", "pollutant", "value"), "live-valid")
    keys = ["city", "date", "pollutant"]
    first = R.first_value(rows, keys[:2]).select(*keys, X.rnd(F.col("value")).alias("first_value"))
    return first.join(R.pair_fold(rows, keys[:2]).select(*keys, X.rnd(F.col("value")).alias("folded")), keys)


@query(
    "csv_map_points",
    O.final(
        O.BASE,
        f"""SELECT lat, lon, state, city, station, pollutant_id, {O.rnd('value')} AS value,
       {O.rnd('coalesce(value, 10.0)')} AS marker_value
FROM norm WHERE lat IS NOT NULL AND lon IS NOT NULL""",
        dates=(),
    ),
)
def csv_map_points(spark, sf):
    """Map points of the CSV fallback: no pages, a snapshot without ids."""
    path = scratch_path(spark, "snapshot")
    Fs.write_table(_readings(spark, sf).drop("reading_id"), f"{path}/csv", fmt="csv")
    m = D.map_points(R.normalise(Fs.load_readings(spark, f"{path}/none", f"{path}/csv"))).drop("reading_id")
    return m.withColumns({"value": X.rnd(F.col("value")), "marker_value": X.rnd(F.col("marker_value"))})


@query(
    "city_day_csv",
    O.final(
        O.daily_rows_ctes(),
        f"SELECT city, date, {_WIDE_COLS}, CAST(aqi AS DOUBLE) AS aqi FROM drows",
    ),
)
def city_day_csv(spark, sf):
    """Daily city table written as CSV with the application's headers, read
    back with its schema, incomplete rows dropped."""
    d = Dy.daily_rows(spark, sf)
    out = d.select(
        F.col("city").alias("City"), F.date_format("date", "yyyy-MM-dd").alias("Date"),
        *[F.col(K.COLUMN_OF[p]).alias(p) for p in K.POLLUTANT_NAMES], F.col("aqi").cast("double").alias("AQI"),
    )
    path = scratch_path(spark, "city_day_csv")
    Fs.write_table(out, path, fmt="csv")
    back = Fs.read_city_day_csv(spark, path)
    return back.select("city", "date", *[X.rnd(F.col(c)).alias(c) for c in K.POLLUTANT_COLUMNS], "aqi")


@query(
    "stream_dedupe",
    O.final(O.BASE, "SELECT DISTINCT station, pollutant_id, last_update FROM readings", dates=()),
)
def stream_dedupe(spark, sf):
    """Every page delivered twice; the stream keeps one row per key."""
    root = scratch_path(spark, "stream")
    readings = _readings(spark, sf)
    Fs.write_pages(readings, f"{root}/landing/copy1")
    Fs.write_pages(readings, f"{root}/landing/copy2")
    Sx.run_deduplicated(Sx.page_stream(spark, f"{root}/landing/*", files_per_trigger=16), f"{root}/out", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/out").select(*Sx.DEDUPE_KEYS)


@query(
    "stream_tiles",
    O.final(
        O.BASE,
        f"""SELECT count(*) AS n_rows, count(DISTINCT station) AS n_stations, count(DISTINCT state) AS n_states,
       count(DISTINCT city) AS n_cities, {O.rnd('avg(value)')} AS mean_aqi, {O.rnd('max(value)')} AS max_aqi,
       {O.fmt_ts('max(datetime)')} AS latest_update
FROM (SELECT * FROM norm QUALIFY row_number() OVER (PARTITION BY station, pollutant_id, last_update ORDER BY reading_id) = 1)""",
        dates=(),
    ),
)
def stream_tiles(spark, sf):
    """Dashboard tiles over the records that a stream of several triggers has
    landed once each, merged from the states of the dates."""
    root = scratch_path(spark, "tiles")
    Fs.write_pages(_readings(spark, sf), f"{root}/landing", by_state=True)
    Sx.run_tiles(Sx.page_stream(spark, f"{root}/landing", files_per_trigger=2), f"{root}/out", f"{root}/tiles", f"{root}/checkpoint")
    t = Sx.latest_tiles(spark, f"{root}/tiles")
    return t.select(
        "n_rows", "n_stations", "n_states", "n_cities", X.rnd(F.col("mean_aqi")).alias("mean_aqi"), X.rnd(F.col("max_aqi")).alias("max_aqi"),
        "latest_update",
    )


# ---------------------------------------------------------------------------
# Breakdown and display (O-J7, O-F16, O-F20), pairs (O-A20), sample (O-T4),
# default weather (O-F29)
# ---------------------------------------------------------------------------
def _breakdown_sql() -> str:
    parts = []
    for p in K.AQI_BREAKPOINTS:
        c = K.COLUMN_OF[p]
        unit = O.q(K.POLLUTANT_UNITS.get(p, ""))
        si = O.sub_index_for(p, f"CAST({c} AS DOUBLE)")
        parts.append(
            f"SELECT city, date, {O.q(p)} AS pollutant, {O.rnd(c)} AS concentration, {si} AS sub_index, {unit} AS unit, "
            f"concat_ws(' ', CAST({O.round1_half_even(c)} AS VARCHAR), {unit}) AS display, {O.category(si)} AS category FROM drows"
        )
    return "\nUNION ALL\n".join(parts)


@query("pollutant_breakdown", O.final(O.daily_rows_ctes(), _breakdown_sql()))
def pollutant_breakdown(spark, sf):
    b = A.breakdown(Dy.daily_rows(spark, sf))
    return b.select("city", "date", "pollutant", X.rnd(F.col("concentration")).alias("concentration"), "sub_index", "unit", "display", "category")


@query("city_date_pairs", O.final((*O.BASE, O.VALID), "SELECT DISTINCT city, date FROM valid"))
def city_date_pairs(spark, sf):
    return _valid(spark, sf).select("city", "date").distinct()


@query(
    "sample_rows",
    O.final(O.daily_rows_ctes(), f"SELECT city, date, {O.rnd('pm25')} AS pm25, aqi FROM drows ORDER BY city, date LIMIT 5"),
)
def sample_rows(spark, sf):
    d = Dy.daily_rows(spark, sf).orderBy("city", "date").limit(5)
    return d.select("city", "date", X.rnd(F.col("pm25")).alias("pm25"), "aqi")


_NEXT = "nxt AS (SELECT DISTINCT city, CAST(date + INTERVAL 1 DAY AS DATE) AS date FROM valid)"


@query(
    "weather_with_defaults",
    O.final(
        (*_W, _NEXT),
        "SELECT n.city, n.date, w.city IS NOT NULL AS weather_available, "
        + ", ".join(f"{O.rnd(f'coalesce(w.{v}, {O.dbl(d)})')} AS weather_{v}" for v, d in K.DAILY_WEATHER_DEFAULTS.items())
        + " FROM nxt n LEFT JOIN wdaily w ON n.city = w.city AND n.date = w.date",
    ),
)
def weather_with_defaults(spark, sf):
    """Next-day requests: days without a landed document take the defaults."""
    req = _valid(spark, sf).select("city", F.date_add("date", 1).alias("date")).distinct()
    wx = W.parse_daily(T.daily_weather_docs(spark, sf))
    j = W.with_default_weather(req.join(wx, ["city", "date"], "left"))
    return j.select("city", "date", "weather_available", *[X.rnd(F.col(c)).alias(c) for c in W.WEATHER_COLUMNS])


PAGES_STATE = "MIDDLE EAST"


@query(
    "pages_state_filter",
    O.final(
        O.BASE,
        f"SELECT reading_id, state, city, pollutant, {O.rnd('value')} AS value FROM norm WHERE state = {O.q(PAGES_STATE)}",
        dates=(),
    ),
)
def pages_state_filter(spark, sf):
    """Pages landed per state key; the state filter prunes folders."""
    path = scratch_path(spark, "pages-by-state")
    Fs.write_pages(_readings(spark, sf), path, by_state=True)
    n = R.normalise(Fs.read_pages(spark, path, state=PAGES_STATE))
    return n.select("reading_id", "state", "city", "pollutant", X.rnd(F.col("value")).alias("value"))


@query("batch_score_aqi")
def batch_score_aqi(spark, sf):
    """Single-target AQI model scoring every city-day."""
    s = Tr.batch_score_aqi(spark, sf)
    return s.select("city", "date", X.rnd(F.col("predicted_aqi")).alias("predicted_aqi"), "category")


@query(
    "weather_for_dates",
    O.final(
        (*_SIX, *O.current_ctes(TODAY)),
        f"""SELECT city, date, source, {O.rnd('T')} AS T, {O.rnd('RH')} AS RH, {O.rnd('WS')} AS WS, {O.rnd('WD')} AS WD,
       {O.rnd('RF')} AS RF, {O.rnd('BP')} AS BP, weather_matched FROM six_all""",
    ),
)
def weather_for_dates(spark, sf):
    """Today's requests read current conditions, other dates the forecast day."""
    six = W.six_keys_for_dates(T.weather_requests(spark, sf), T.forecast_docs(spark, sf), T.current_docs(spark, sf, TODAY), TODAY)
    return six.select("city", "date", "source", *[X.rnd(F.col(k)).alias(k) for k in K.WEATHER_KEY_DEFAULTS], "weather_matched")


def _city_default_sql(p: str) -> str:
    i = R.CITY_DEFAULT_POLLUTANTS.index(p)
    fb = K.CITY_DEFAULTS[K.CITY_DEFAULT_FALLBACK][i]
    return O.case("city", {c: O.dbl(v[i]) for c, v in K.CITY_DEFAULTS.items()}, O.dbl(fb), raw_values=True)


_CITY_WIDE = ",\n         ".join(
    f"coalesce(max(CASE WHEN pollutant = {O.q(p)} AND value >= 0 THEN value END), "
    f"{_city_default_sql(p) if p in R.CITY_DEFAULT_POLLUTANTS else O.dbl(K.UNIVERSAL_DEFAULTS[p])}) AS {c}"
    for p, c in K.POLLUTANTS
)


@query(
    "complete_city_defaults",
    O.final(
        (*O.BASE, O.VALID, O.CONC, f"cwide AS (SELECT city, date, {_CITY_WIDE} FROM conc GROUP BY city, date)"),
        f"SELECT city, date, {_WIDE_COLS} FROM cwide",
    ),
)
def complete_city_defaults(spark, sf):
    """Completion with the city-specific defaults option switched on."""
    w = R.complete(R.station_mean(_valid(spark, sf), ["city", "date"]), ["city", "date"], city_defaults=True)
    return w.select("city", "date", *[X.rnd(F.col(c)).alias(c) for c in K.POLLUTANT_COLUMNS])
