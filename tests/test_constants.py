"""Constants pinned by literal values, written out here and not taken from the
constants module, so that a wrong or missing value fails."""

import pytest

from aqlens import constants as K
from aqlens.functions import exprs as X
from aqlens.operators import readings as R


@pytest.mark.parametrize(
    ("pollutant", "uppers"),
    [
        ("PM2.5", [30, 60, 90, 120, 250]),
        ("PM10", [50, 100, 250, 350, 430]),
        ("NO2", [40, 80, 180, 280, 400]),
        ("SO2", [40, 80, 380, 800, 1600]),
        ("CO", [1, 2, 10, 17, 34]),
        ("O3", [50, 100, 168, 208, 748]),
    ],
)
def test_breakpoints(pollutant, uppers):
    bins = K.AQI_BREAKPOINTS[pollutant]
    assert [b[1] for b in bins] == uppers
    assert [b[0] for b in bins] == [0, *uppers[:-1]]
    assert [(b[2], b[3]) for b in bins] == [(0, 50), (51, 100), (101, 200), (201, 300), (301, 400)]


def test_categories(spark):
    rows = [(0.0, "Good"), (50.0, "Good"), (50.5, "Satisfactory"), (100.0, "Satisfactory"), (150.0, "Moderate"), (250.0, "Poor"), (350.0, "Very Poor"), (401.0, "Severe")]
    from pyspark.sql import functions as F

    got = spark.createDataFrame(rows, "aqi double, want string").select("want", X.aqi_category(F.col("aqi")).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_aliases_and_defaults():
    assert K.POLLUTANT_ALIASES["OZONE"] == "O3" and K.POLLUTANT_ALIASES["NOX"] == "NOx"
    assert {k: K.POLLUTANT_ALIASES[k] for k in ("C6H6", "C7H8", "C8H10")} == {"C6H6": "Benzene", "C7H8": "Toluene", "C8H10": "Xylene"}
    assert list(K.UNIVERSAL_DEFAULTS.values()) == [50.0, 80.0, 20.0, 40.0, 60.0, 25.0, 1.5, 30.0, 80.0, 2.0, 5.0, 3.0]
    assert K.CITY_DEFAULTS["Kanpur"] == (125.0, 190.0, 44.0, 29.0) and len(K.CITY_DEFAULTS) == 12


def test_seasons(spark):
    from pyspark.sql import functions as F

    months = spark.range(1, 13).select(F.col("id").cast("int").alias("m"))
    got = {r.m: r.s for r in months.select("m", X.season_index(F.col("m")).alias("s")).collect()}
    assert got == {1: 1, 2: 1, 3: 2, 4: 2, 5: 2, 6: 3, 7: 3, 8: 3, 9: 4, 10: 4, 11: 4, 12: 1}


def test_pm_repair_factor(spark):
    df = spark.createDataFrame([(100.0, 50.0), (50.0, 100.0)], "pm25 double, pm10 double")
    repaired = R.pm_repair(df)
    assert [round(r.pm10, 9) for r in repaired.collect()] == [120.0, 100.0]
