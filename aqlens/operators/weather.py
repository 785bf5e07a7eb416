"""Weather: landed daily documents, forecast date matching, the six-key
summary, synthesised daily features, display entries and city look-ups.

Documents arrive as JSON text (one per request).  They are parsed with an
explicit schema by ``from_json``; no Python touches a record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aqlens import constants as K

DAILY_SCHEMA = T.StructType(
    [
        T.StructField(
            "daily",
            T.StructType(
                [T.StructField("time", T.ArrayType(T.StringType()))]
                + [T.StructField(v, T.ArrayType(T.DoubleType())) for v in K.DAILY_WEATHER_VARS]
            ),
        ),
        T.StructField("current", T.StructType([T.StructField(v, T.DoubleType()) for v in K.CURRENT_VARS])),
    ]
)

LANDED_SCHEMA_FIELDS = ["city", "date"]

FORECAST_VARS = K.FORECAST_VARS
WEATHER_COLUMNS = [f"weather_{v}" for v in K.DAILY_WEATHER_VARS]


def _daily(docs: DataFrame, payload: str):
    """The ``daily`` struct of a document: a parsed struct column when the
    documents were read with the landed schema, else parsed from JSON text."""
    if "daily" in docs.columns:
        return F.col("daily")
    return F.from_json(F.col(payload), DAILY_SCHEMA)["daily"]


def _kept(docs: DataFrame, payload: str) -> list[str]:
    return [c for c in docs.columns if c not in (payload, "daily", "current", "landed_at")]


def newest(docs: DataFrame, keys) -> DataFrame:
    """One document per key: the one landed last (where that is known), ties
    by content.  Grouped by the keys that a join on them then reuses."""
    own = [c for c in docs.columns if c not in keys]
    order = [c for c in ("landed_at",) if c in own] + [c for c in own if c != "landed_at"]
    best = docs.groupBy(*keys).agg(F.max(F.struct(*order)).alias("_doc"))
    return best.select(*keys, *[F.col(f"_doc.{c}").alias(c) for c in own])


def parse_daily(docs: DataFrame, payload: str = "payload") -> DataFrame:
    """Daily archive documents -> one row per request with ``weather_<var>``
    columns holding the first element of each array (null when absent); of
    documents for the same request the newest.
    The ``time`` key is dropped rather than turned into a feature."""
    docs = newest(docs, _kept(docs, payload))
    d = _daily(docs, payload)
    return docs.select(
        *_kept(docs, payload), *[F.try_element_at(d[v], F.lit(1)).alias(f"weather_{v}") for v in K.DAILY_WEATHER_VARS]
    )


def explode_daily(docs: DataFrame, payload: str = "payload", variables=FORECAST_VARS) -> DataFrame:
    """Forecast documents -> one row per (document, day): ``arrays_zip`` of
    the parallel arrays then ``inline``; adds ``pos`` (0-based)."""
    d = F.from_json(F.col(payload), DAILY_SCHEMA)
    keep = [c for c in docs.columns if c != payload]
    # A missing variable would null the whole zip: take it as empty, so the
    # zip pads it with nulls instead.
    zipped = F.arrays_zip(
        F.coalesce(d["daily"]["time"], F.array().cast("array<string>")).alias("time"),
        *[F.coalesce(d["daily"][v], F.array().cast("array<double>")).alias(v) for v in variables],
    )
    return docs.select(*keep, F.posexplode_outer(zipped).alias("pos", "day")).select(*keep, "pos", "day.*")


def match_forecast_day(requests: DataFrame, docs: DataFrame, keys=("city", "doc_key"), payload: str = "payload") -> DataFrame:
    """Six-key weather for each (city, date) request from the document it
    names: the day whose ``time`` starts with the date, else the first day;
    a missing value (short array, no document) takes the key's default.
    ``weather_matched`` says whether the date was found.

    A request joins one document on its keys (equi-join; AQE picks broadcast
    or sort-merge by the runtime size), and the day is picked by array
    position, so no per-day explode is needed.

    As in the application, ``RH`` is the day's *maximum* relative humidity
    and ``WS`` the day's *maximum* wind speed (forecasts carry no means);
    ``T`` is the mean of the day's maximum and minimum temperature.
    """
    docs = newest(docs, list(keys))
    d = _daily(docs, payload)
    joined = requests.join(docs, list(keys), "left")
    hits = F.filter(F.transform(d["time"], lambda t, i: F.when(F.startswith(t, F.col("date_text")), i + 1)), lambda x: x.isNotNull())
    pos = F.try_element_at(hits, F.lit(1))
    idx = F.coalesce(pos, F.lit(1))

    def pick(v):
        return F.try_element_at(d[v], idx)

    dflt = K.WEATHER_KEY_DEFAULTS
    tmean = F.coalesce(pick("temperature_2m_mean"), (pick("temperature_2m_max") + pick("temperature_2m_min")) / 2, F.lit(dflt["T"]))
    out = joined.select(
        *[c for c in requests.columns],
        tmean.alias("T"),
        F.coalesce(pick("relative_humidity_2m_max"), F.lit(dflt["RH"])).alias("RH"),
        F.coalesce(pick("wind_speed_10m_max"), F.lit(dflt["WS"])).alias("WS"),
        F.lit(dflt["WD"]).alias("WD"),
        F.coalesce(pick("precipitation_sum"), F.lit(dflt["RF"])).alias("RF"),
        F.lit(dflt["BP"]).alias("BP"),
        pos.isNotNull().alias("weather_matched"),
    )
    return out


def covering_days(docs: DataFrame, payload: str = "payload") -> DataFrame:
    """(city, date, daily): for each date of a city the newest document that
    covers it (a document holds at most some 16 days)."""
    d = _daily(docs, payload)
    landed = F.col("landed_at") if "landed_at" in docs.columns else F.lit(None).cast("timestamp")
    days = docs.select("city", F.explode(d["time"]).alias("t"), landed.alias("landed_at"), d.alias("daily"))
    days = days.withColumn("date", F.substring("t", 1, 10).try_cast("date")).drop("t").filter("date is not null")
    return newest(days, ["city", "date"]).drop("landed_at")


def current_weather(docs: DataFrame, payload: str = "payload") -> DataFrame:
    """Current-conditions documents -> six keys with defaults."""
    d = F.from_json(F.col(payload), DAILY_SCHEMA)
    dflt = K.WEATHER_KEY_DEFAULTS
    cur = d["current"]
    keep = [c for c in docs.columns if c != payload]
    return docs.select(
        *keep,
        F.coalesce(cur["temperature_2m"], F.lit(dflt["T"])).alias("T"),
        F.coalesce(cur["relative_humidity_2m"], F.lit(dflt["RH"])).alias("RH"),
        F.coalesce(cur["wind_speed_10m"], F.lit(dflt["WS"])).alias("WS"),
        F.lit(dflt["WD"]).alias("WD"),
        F.coalesce(F.try_element_at(d["daily"]["precipitation_sum"], F.lit(1)), F.lit(dflt["RF"])).alias("RF"),
        F.coalesce(cur["surface_pressure"], F.lit(dflt["BP"])).alias("BP"),
    )


def synthesise_daily(six: DataFrame) -> DataFrame:
    """Fifteen daily features from the six keys (fixed spreads; humidity
    clamped to [0, 100])."""
    t, rh, ws = F.col("T"), F.col("RH"), F.col("WS")
    feats = {
        "weather_temperature_2m_max": t + K.SYNTH_TEMP_SPREAD,
        "weather_temperature_2m_min": t - K.SYNTH_TEMP_SPREAD,
        "weather_temperature_2m_mean": t,
        "weather_relative_humidity_2m_max": F.least(F.lit(100.0), rh + K.SYNTH_RH_SPREAD),
        "weather_relative_humidity_2m_min": F.greatest(F.lit(0.0), rh - K.SYNTH_RH_SPREAD),
        "weather_relative_humidity_2m_mean": rh,
        "weather_precipitation_sum": F.col("RF"),
        "weather_rain_sum": F.col("RF"),
        "weather_snowfall_sum": F.lit(0.0),
        "weather_wind_speed_10m_max": ws + K.SYNTH_WIND_SPREAD,
        "weather_wind_speed_10m_mean": ws,
        "weather_wind_direction_10m_dominant": F.col("WD"),
        "weather_wind_gusts_10m_max": ws + K.SYNTH_WIND_SPREAD + K.SYNTH_GUST_EXTRA,
        "weather_pressure_msl_mean": F.col("BP"),
        "weather_sunshine_duration": F.lit(K.SYNTH_SUNSHINE),
    }
    return six.withColumns(feats)


def round1_half_even(x):
    """Round to one decimal, half to even, on the exact binary value (as
    Python's ``round(x, 1)``).  x*10 is formed as x*8 + x*2 with its exact
    rounding error (two-sum), so a product that lands on .5 only by rounding
    is resolved by the error's sign."""
    a, b = x * 8.0, x * 2.0
    s = a + b
    bb = s - a
    e = (a - (s - bb)) + (b - bb)
    fl = F.floor(s).cast("double")
    tie = (s - fl) == 0.5
    even = F.when(F.pmod(fl, F.lit(2.0)) == 0, fl).otherwise(fl + 1)
    r = F.when(tie & (e > 0), fl + 1).when(tie & (e < 0), fl).when(tie, even).otherwise(F.rint(s))
    return r / 10.0


def display_entries(six: DataFrame, keys=("city", "date")) -> DataFrame:
    """Readable (label, value) entries: zero values dropped except
    temperature, values rounded to one decimal."""
    entries = F.array(
        *[F.struct(F.lit(k).alias("key"), F.lit(K.WEATHER_KEY_LABELS[k]).alias("label"), F.col(k).cast("double").alias("value")) for k in K.WEATHER_KEY_DEFAULTS]
    )
    kept = F.filter(entries, lambda e: (e["value"] != 0) | (e["key"] == "T"))
    return (
        six.select(*keys, F.inline(kept))
        .select(*keys, "key", "label", round1_half_even(F.col("value")).alias("value"))
    )


def city_dimension(spark: SparkSession) -> DataFrame:
    """City coordinates and information (constant, 27 rows)."""
    rows = []
    for city, (lat, lon) in K.CITY_COORDINATES.items():
        info = K.CITY_INFO.get(city)
        rows.append((city, lat, lon, info[2] if info else None, info[3] if info else None))
    return spark.createDataFrame(rows, "dim_city string, dim_lat double, dim_lon double, dim_region string, dim_population string")


def with_city_lookup(df: DataFrame, city: str = "city") -> DataFrame:
    """Coordinates (default Delhi) and region/population (default 'India')
    by a left join on the broadcast 27-row dimension."""
    dim = F.broadcast(city_dimension(df.sparkSession))
    dlat, dlon = K.CITY_COORDINATES[K.DEFAULT_CITY]
    j = df.join(dim, F.col(city) == dim.dim_city, "left")
    return j.select(
        *df.columns,
        F.coalesce("dim_lat", F.lit(dlat)).alias("latitude"),
        F.coalesce("dim_lon", F.lit(dlon)).alias("longitude"),
        F.coalesce("dim_region", F.lit(K.CITY_INFO_DEFAULT[2])).alias("region"),
        F.col("dim_population").alias("population"),
        F.col("dim_city").isNotNull().alias("known_city"),
    )


def date_class(date_col, today: str, window_days: int = 7):
    """(class, in_window): past / today / future against ``today``, and
    whether the date lies within +-window days."""
    t = F.to_date(F.lit(today))
    cls = F.when(date_col < t, "past").when(date_col == t, "today").otherwise("future")
    inside = date_col.between(F.date_sub(t, window_days), F.date_add(t, window_days))
    return cls, inside


def with_default_weather(df: DataFrame) -> DataFrame:
    """Missing daily weather (no document, failed request) takes the fixed
    default of each of the fifteen variables; ``weather_available`` says
    whether a document was found."""
    present = F.col(WEATHER_COLUMNS[0]).isNotNull()
    filled = {f"weather_{v}": F.coalesce(F.col(f"weather_{v}"), F.lit(d)) for v, d in K.DAILY_WEATHER_DEFAULTS.items()}
    return df.withColumn("weather_available", present).withColumns(filled)


def six_keys_for_dates(requests: DataFrame, forecast_docs: DataFrame, current_docs: DataFrame, today: str, keys=("city", "doc_key")) -> DataFrame:
    """Six-key weather by date class: a request for ``today`` reads the
    city's current-conditions document, any other date the forecast day
    (``match_forecast_day``); no document means the defaults.  The two paths
    are two equi-joins on disjoint request sets, united by name."""
    is_today = F.col("date") == F.to_date(F.lit(today))
    cur = current_weather(current_docs).select("city", *K.WEATHER_KEY_DEFAULTS)
    today_rows = requests.filter(is_today).join(cur, "city", "left")
    dflt = K.WEATHER_KEY_DEFAULTS
    today_rows = today_rows.select(
        *requests.columns,
        *[F.coalesce(F.col(k), F.lit(v)).alias(k) for k, v in dflt.items()],
        F.lit(False).alias("weather_matched"),
    ).withColumn("source", F.lit("current"))
    other = match_forecast_day(requests.filter(~is_today), forecast_docs, keys).withColumn("source", F.lit("forecast"))
    return other.unionByName(today_rows)
