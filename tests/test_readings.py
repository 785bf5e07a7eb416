"""Cleaning: aliases, numeric parsing, fold / mean / first, completion, repair."""

import random

from pyspark.sql import functions as F

from aqlens import constants as K
from aqlens.functions import exprs as X
from aqlens.operators import readings as R


def seq_fold(values):
    acc = None
    for v in values:
        acc = v if acc is None else (acc + v) / 2
    return acc


def test_pair_fold_chunks_match_sequential(spark):
    rnd = random.Random(7)
    rows, expected = [], {}
    rid = 0
    for g in range(6):
        n = rnd.randint(1, 40)
        vals = [round(rnd.uniform(0, 500), 2) for _ in range(n)]
        for v in vals:
            rid += rnd.randint(1, 5)
            rows.append((f"c{g}", "PM2.5", v, rid))
        expected[f"c{g}"] = seq_fold(vals)
    df = spark.createDataFrame(rows, "city string, pollutant string, value double, reading_id long")
    for chunk in (3, 7, 1 << 20):
        got = {r.city: r.value for r in R.pair_fold(df, ["city"], chunk=chunk).collect()}
        for k, v in expected.items():
            assert abs(got[k] - v) < 1e-9 * max(1, abs(v)), (chunk, k)


def test_fold_example():
    assert seq_fold([10, 20, 40]) == 27.5


def test_mean_order_invariant(spark):
    rows = [("x", "NO2", float(v), i) for i, v in enumerate([5, 1, 9, 3])]
    a = R.station_mean(spark.createDataFrame(rows, "city string, pollutant string, value double, reading_id long"), ["city"]).first().value
    b = R.station_mean(spark.createDataFrame(rows[::-1], "city string, pollutant string, value double, reading_id long"), ["city"]).first().value
    assert a == b == 4.5


def test_parse_float_and_alias(spark):
    rows = [("12.5", "pm2.5"), ("NA", "ozone"), ("", "C6H6"), ("N/A", "nox"), ("abc", " so2 "), (" 7 ", "unknown"), ("NaN", "CO")]
    df = spark.createDataFrame(rows, "v string, p string")
    got = df.select(X.parse_float(F.col("v")).alias("x"), X.canonical_pollutant(F.col("p")).alias("c")).collect()
    assert [r.x for r in got] == [12.5, None, None, None, None, 7.0, None]
    assert [r.c for r in got] == ["PM2.5", "O3", "Benzene", "NOx", "SO2", "unknown", "CO"]
    z = df.select(X.parse_float(F.col("v"), missing_as_zero=True).alias("x")).collect()
    assert [r.x for r in z] == [12.5, 0.0, 0.0, 0.0, 0.0, 7.0, 0.0]


def test_complete_and_repair(spark):
    rows = [("a", "PM2.5", 100.0), ("a", "PM10", 50.0), ("b", "NO2", 10.0)]
    c = spark.createDataFrame(rows, "city string, pollutant string, value double")
    w = {r.city: r for r in R.pm_repair(R.complete(c, ["city"])).collect()}
    assert w["a"].pm10 == 120.0 and w["a"].pm_repaired
    assert w["b"].pm25 == K.UNIVERSAL_DEFAULTS["PM2.5"] and w["b"].no2 == 10.0
    for r in w.values():
        assert r.pm10 >= r.pm25
        assert all(getattr(r, col) is not None for col in K.POLLUTANT_COLUMNS)


def test_pollutant_rows_end_to_end(spark, sf_small):
    from aqlens.sources import tables as T

    rows = R.pollutant_rows(T.readings(spark, sf_small), method="fold")
    assert rows.count() > 0
    assert rows.filter(F.col("pm10") < F.col("pm25")).count() == 0


def test_reading_time_and_proxy(spark):
    from aqlens.operators import dashboard as D
    from aqlens.operators import quality as Q

    df = spark.createDataFrame([("05-03-2024 14:30:00", "12"), ("2024-03-05 14:30:00", "NA"), ("garbage", "x")], "t string, pollutant_avg string")
    got = df.select(X.parse_reading_time(F.col("t")).alias("ts")).collect()
    assert str(got[0].ts) == "2024-03-05 14:30:00" and str(got[1].ts) == "2024-03-05 14:30:00" and got[2].ts is None
    p = D.aqi_proxy(df).collect()
    assert [r.aqi for r in p] == [12.0, None, None] and p[0].aqi_category == "Good" and p[1].aqi_category is None
    assert [r.aqi for r in D.aqi_proxy(df.drop("pollutant_avg")).collect()] == [100.0] * 3
    assert Q.all_null(D.aqi_proxy(df).filter("aqi IS NULL"), ["aqi"]) == {"aqi": True}
    assert D.select_available(df, ["x", "pollutant_avg", "t"]).columns == ["pollutant_avg", "t"]


def test_pair_fold_sparse_large_ids(spark):
    # snowflake-like ids: one row per 2^21-wide range, so every level matters
    vals = [float(i % 13) + 0.25 for i in range(300)]
    rows = [("hot", "PM10", v, (1 << 60) + i * (1 << 40) + (i % 3)) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "city string, pollutant string, value double, reading_id long")
    got = R.pair_fold(df, ["city"]).first().value
    assert abs(got - seq_fold(vals)) < 1e-9


def test_city_defaults_option(spark):
    rows = [("Mumbai", "NO2", 10.0), ("Atlantis", "NO2", 10.0)]
    c = spark.createDataFrame(rows, "city string, pollutant string, value double")
    off = {r.city: r for r in R.complete(c, ["city"]).collect()}
    on = {r.city: r for r in R.complete(c, ["city"], city_defaults=True).collect()}
    assert off["Mumbai"].pm25 == K.UNIVERSAL_DEFAULTS["PM2.5"]
    assert (on["Mumbai"].pm25, on["Mumbai"].pm10, on["Mumbai"].so2) == K.CITY_DEFAULTS["Mumbai"][:2] + (K.CITY_DEFAULTS["Mumbai"][3],)
    assert on["Mumbai"].no2 == 10.0 and on["Mumbai"].co == K.UNIVERSAL_DEFAULTS["CO"]
    assert on["Atlantis"].pm25 == K.CITY_DEFAULTS["Delhi"][0]


def test_zero_as_missing_option(spark):
    c = spark.createDataFrame([("a", "NO2", 0.0)], "city string, pollutant string, value double")
    assert R.complete(c, ["city"]).first().no2 == 0.0
    assert R.complete(c, ["city"], zero_as_missing=True).first().no2 == K.UNIVERSAL_DEFAULTS["NO2"]
