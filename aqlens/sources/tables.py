"""Driver tables and the domain tables derived from them.

The application reads air-quality readings, daily city tables, yearly and
state day counts and an activity log.  The driver ships TPC-H-like tables
instead, so the domain tables are *derived* from them with one fixed
projection, written here with the DataFrame API and mirrored in SQL by
``aqlens.plans.oracle`` (the two must stay in step).

TEST DATA MAPPING (ours, not the application's):

* ``events`` is the stream of readings: ``event_type`` picks the raw
  pollutant id (mixed aliases and case on purpose), ``value`` is the average
  concentration, ``user_id`` the station, ``ts`` the update time and
  ``event_id`` the arrival order.  Every 17th event carries the text ``NA``.
* A station belongs to nation ``user_id mod 25``; the nation's region is the
  state.  Nations 0-19 are named after the first twenty cities of the
  coordinate table (alphabetical), the rest keep their own name, so look-ups
  meet both known and unknown cities.
* ``orders`` gives yearly good/bad counts per (region, nation): an order at
  or below ``ORDER_PRICE_CUT`` is a good day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aqlens import constants as K
from aqlens.functions.exprs import exact_avg, lookup

# TEST DATA MAPPING constants (shared with the SQL oracle).
EVENT_POLLUTANT = {"click": "PM2.5", "view": "pm10", "purchase": "NO2", "signup": "SO2", "error": "OZONE"}
EVENT_ACTIVITY = {
    "click": "USER_ACTION",
    "view": "API_CALL",
    "purchase": "MODEL_RUN",
    "signup": "CALCULATION",
    "error": "ERROR",
}
NATION_COUNT = 25
MISSING_EVERY = 17
NAMED_NATIONS = 20
UNPLACED_NATION = 24
TEST_CITIES = list(K.CITY_COORDINATES)[:NAMED_NATIONS]
ORDER_PRICE_CUT = 250000.0
ORDER_YEARS = list(range(1995, 2002))
READING_TS_FORMAT = "dd-MM-yyyy HH:mm:ss"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def nation_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(n_nationkey, n_regionkey, city, state): one row per nation.

    Both inputs are small files; the planner broadcasts them by their scan
    statistics (below the broadcast threshold), so no hint or job is needed."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    named = F.array(*[F.lit(c) for c in TEST_CITIES])
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        "n_nationkey",
        "n_regionkey",
        F.when(F.col("n_nationkey") < NAMED_NATIONS, F.element_at(named, F.col("n_nationkey") + 1))
        .otherwise(F.col("n_name"))
        .alias("city"),
        F.col("r_name").alias("state"),
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long-form live readings, all values as text, like a landed API page.

    Columns: reading_id, state, city, station, last_update (day-first text),
    pollutant_id (raw), pollutant_min, pollutant_max, pollutant_avg (text),
    latitude, longitude (text).
    """
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    geo = nation_geo(spark, sf_dir)
    joined = ev.join(geo, F.pmod(ev.user_id, F.lit(NATION_COUNT)) == geo.n_nationkey)
    value_text = F.col("value").cast("string")
    return joined.select(
        F.col("event_id").alias("reading_id"),
        "state",
        "city",
        F.col("user_id").cast("string").alias("station"),
        F.date_format("ts", READING_TS_FORMAT).alias("last_update"),
        lookup(F.col("event_type"), EVENT_POLLUTANT).alias("pollutant_id"),
        (F.col("value") * 0.8).cast("string").alias("pollutant_min"),
        (F.col("value") * 1.25).cast("string").alias("pollutant_max"),
        F.when(F.pmod(F.col("event_id"), F.lit(MISSING_EVERY)) == 0, F.lit("NA")).otherwise(value_text).alias("pollutant_avg"),
        F.when(F.col("n_nationkey") == UNPLACED_NATION, F.lit("NA"))
        .otherwise((F.col("n_nationkey") + 8).cast("string"))
        .alias("latitude"),
        (F.col("n_regionkey") * 4 + 70 + F.pmod(F.col("user_id"), F.lit(4))).cast("string").alias("longitude"),
    )


def activity_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity events: session_id, timestamp, event_type, seq, error."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    kind = lookup(F.col("event_type"), EVENT_ACTIVITY)
    return ev.select(
        F.concat(F.lit("S"), F.col("user_id").cast("string")).alias("session_id"),
        F.col("ts").alias("timestamp"),
        kind.alias("event_type"),
        F.col("event_id").alias("seq"),
        F.when(kind == "ERROR", F.concat(F.lit("E"), F.col("event_id").cast("string"))).alias("error"),
    )


def yearly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide yearly good/bad counts per (state, city), like the yearly CSV.

    Columns: sl_no, state, city, then good_<year>, bad_<year> per year.
    """
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", "o_orderdate")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    geo = nation_geo(spark, sf_dir)
    yr = F.year("o_orderdate")
    good = F.col("o_totalprice") <= ORDER_PRICE_CUT
    names = [f"{kind}_{y}" for y in ORDER_YEARS for kind in ("good", "bad")]
    conds = [(yr == y) & (good if kind == "good" else ~good) for y in ORDER_YEARS for kind in ("good", "bad")]
    # Pre-aggregate per customer before the join shuffle (one row per customer
    # instead of one per order), then sum per nation.
    per_customer = orders.groupBy("o_custkey").agg(*[F.count_if(c).alias(n) for n, c in zip(names, conds)])
    per_nation = (
        per_customer.join(customer, per_customer.o_custkey == customer.c_custkey)
        .groupBy(F.col("c_nationkey").alias("n_nationkey"))
        .agg(*[F.sum(n).cast("int").alias(n) for n in names])
    )
    return per_nation.join(geo, "n_nationkey").select(
        (F.col("n_nationkey") + 1).alias("sl_no"), "state", "city", *[a for y in ORDER_YEARS for a in (f"good_{y}", f"bad_{y}")]
    )


# TEST DATA MAPPING: daily weather per (city, date) from the statistics of
# that day's valid readings (vmin, vmax, vavg, n).  Written as SQL text so
# the Spark derivation and the oracle use the very same formulas.
WEATHER_FORMULAS = {
    "temperature_2m_max": "20 + vmax / 50",
    "temperature_2m_min": "10 + vmin / 50",
    "temperature_2m_mean": "15 + vavg / 50",
    "relative_humidity_2m_max": "least(100, 40 + vmax / 10)",
    "relative_humidity_2m_min": "20 + vmin / 10",
    "relative_humidity_2m_mean": "30 + vavg / 10",
    "precipitation_sum": "vmin",
    "rain_sum": "vmin",
    "snowfall_sum": "CAST(0 AS DOUBLE)",
    "wind_speed_10m_max": "vmax / 20",
    "wind_speed_10m_mean": "vavg / 20",
    "wind_direction_10m_dominant": "CAST((n * 10) % 360 AS DOUBLE)",
    "wind_gusts_10m_max": "vmax / 15",
    "pressure_msl_mean": "1000 + vavg / 20",
    "sunshine_duration": "CAST(3600 * n AS DOUBLE)",
}
# A forecast document covers one city-week (Monday start); a request for a
# date reads the document of the week that starts nearest to it, so dates
# late in a week miss and fall back to the document's first day.
REQUEST_SHIFT_DAYS = 3


def daily_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(city, date, <15 variables>) derived from the readings."""
    from aqlens.operators.readings import normalise, valid

    v = valid(normalise(readings(spark, sf_dir)))
    stats = v.groupBy("city", "date").agg(
        F.min("value").alias("vmin"), F.max("value").alias("vmax"), exact_avg("value").alias("vavg"), F.count(F.lit(1)).alias("n")
    )
    return stats.select("city", "date", *[F.expr(f).cast("double").alias(k) for k, f in WEATHER_FORMULAS.items()])


def daily_weather_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed archive documents: (city, date, payload JSON text)."""
    w = daily_weather(spark, sf_dir)
    daily = F.struct(
        F.array(F.date_format("date", "yyyy-MM-dd")).alias("time"), *[F.array(F.col(k)).alias(k) for k in WEATHER_FORMULAS]
    )
    return w.select("city", "date", F.to_json(F.struct(daily.alias("daily"))).alias("payload"))


def forecast_docs(spark: SparkSession, sf_dir: str, variables=None) -> DataFrame:
    """Landed forecast documents, one per (city, week): (city, doc_key, payload).
    A document holds at most seven days, so the grouped list is bounded."""
    from aqlens.operators.weather import FORECAST_VARS

    variables = variables or FORECAST_VARS
    w = daily_weather(spark, sf_dir).withColumn("doc_key", F.to_date(F.date_trunc("week", F.col("date"))))
    days = w.groupBy("city", "doc_key").agg(
        F.array_sort(F.collect_list(F.struct(F.date_format("date", "yyyy-MM-dd").alias("time"), *[F.col(v) for v in variables]))).alias("d")
    )
    def field(name):
        return lambda x: x[name]

    daily = F.struct(*[F.transform("d", field(v)).alias(v) for v in ["time", *variables]])
    return days.select("city", "doc_key", F.to_json(F.struct(daily.alias("daily"))).alias("payload"))


def weather_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (city, date) pairs of the readings, with the document they name."""
    from aqlens.operators.readings import normalise, valid

    v = valid(normalise(readings(spark, sf_dir))).select("city", "date").distinct()
    return v.select(
        "city",
        "date",
        F.date_format("date", "yyyy-MM-dd").alias("date_text"),
        F.to_date(F.date_trunc("week", F.date_add("date", REQUEST_SHIFT_DAYS))).alias("doc_key"),
    )


# TEST DATA MAPPING: current conditions per city from one day's readings.
CURRENT_FORMULAS = {
    "temperature_2m": "15 + vavg / 50",
    "relative_humidity_2m": "30 + vavg / 10",
    "wind_speed_10m": "vavg / 20",
    "surface_pressure": "1000 + vavg / 20",
}


def current_docs(spark: SparkSession, sf_dir: str, day: str) -> DataFrame:
    """Landed current-conditions documents (city, payload) built from the
    valid readings of ``day``; precipitation is the day's minimum."""
    from aqlens.operators.readings import normalise, valid

    v = valid(normalise(readings(spark, sf_dir))).filter(F.col("date") == F.to_date(F.lit(day)))
    stats = v.groupBy("city").agg(F.min("value").alias("vmin"), exact_avg("value").alias("vavg"))
    current = F.struct(*[F.expr(f).cast("double").alias(k) for k, f in CURRENT_FORMULAS.items()])
    daily = F.struct(F.array(F.col("vmin")).alias("precipitation_sum"))
    return stats.select("city", F.to_json(F.struct(daily.alias("daily"), current.alias("current"))).alias("payload"))
