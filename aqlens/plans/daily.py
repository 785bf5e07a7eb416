"""The daily city table (pollutants, AQI, weather, calendar, codes) that the
models train on, built from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aqlens import constants as K
from aqlens.functions import exprs as X
from aqlens.operators import features as Fe
from aqlens.operators import readings as R
from aqlens.operators import weather as W
from aqlens.sources import tables as T

AQI_COLUMNS = {p: K.COLUMN_OF[p] for p in K.AQI_BREAKPOINTS}
TIME_FEATURES = ["year", "month", "day_of_year", "season_encoded", "city_encoded"]
# Features of the single-target AQI model: pollutants + weather + time/codes.
FEATURES_AQI = K.POLLUTANT_COLUMNS + W.WEATHER_COLUMNS + TIME_FEATURES
# Features of the six-target model: weather + the six other pollutants + time/codes.
FEATURES_SIX = W.WEATHER_COLUMNS + [K.COLUMN_OF[p] for p in K.OTHER_POLLUTANTS] + TIME_FEATURES
TARGETS_SIX = [K.COLUMN_OF[p] for p in K.TARGET_POLLUTANTS]


def daily_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(city, date, 12 pollutants completed and repaired, aqi)."""
    rows = R.pollutant_rows(T.readings(spark, sf_dir))
    return rows.withColumn("aqi", X.overall_aqi_wide(dict(AQI_COLUMNS)))


def daily_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily rows joined with the landed daily weather on (city, date), with
    calendar features and city codes."""
    wx = W.parse_daily(T.daily_weather_docs(spark, sf_dir))
    d = daily_rows(spark, sf_dir).join(wx, ["city", "date"], "inner")
    return Fe.with_codes(Fe.calendar(d), ["city"])


def scoring_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to score: completed pollutant rows with weather synthesised from
    the forecast six keys, and calendar features (codes come from the
    training dimension at scoring time).  The weather requests are the rows'
    own (city, date) keys."""
    rows = daily_rows(spark, sf_dir)
    requests = rows.select(
        "city",
        "date",
        F.date_format("date", "yyyy-MM-dd").alias("date_text"),
        F.to_date(F.date_trunc("week", F.date_add("date", T.REQUEST_SHIFT_DAYS))).alias("doc_key"),
    )
    six = W.synthesise_daily(W.match_forecast_day(requests, T.forecast_docs(spark, sf_dir)))
    six = six.select("city", "date", *W.WEATHER_COLUMNS)
    return Fe.calendar(rows.join(six, ["city", "date"], "inner"))
