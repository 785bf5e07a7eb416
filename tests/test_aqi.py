"""Golden edges and properties of the AQI sub-index and overall index."""

import math

import pytest
from pyspark.sql import functions as F

from aqlens import constants as K
from aqlens.functions import exprs as X
from aqlens.operators import aqi as A


def brute_sub_index(p, c):
    """Straight loop over the bins, first match wins, as the formula reads."""
    if c is None or c <= 0:
        return None
    bins = K.AQI_BREAKPOINTS[p] + [(K.AQI_BREAKPOINTS[p][-1][1], math.inf, K.TOP_BIN_AQI, K.TOP_BIN_AQI)]
    for lo, hi, alo, ahi in bins:
        if lo <= c <= hi:
            if hi == math.inf:
                return K.TOP_BIN_AQI
            return int(((ahi - alo) / (hi - lo)) * (c - lo) + alo)
    return 500


def edge_cases():
    cases = []
    for p, bins in K.AQI_BREAKPOINTS.items():
        for lo, hi, _, _ in bins:
            for c in (lo, hi, hi + 1e-9, hi * 1.0001, (lo + hi) / 2):
                cases.append((p, float(c)))
        cases += [(p, 0.0), (p, -1.0), (p, None), (p, float(bins[-1][1] * 10)), (p, 1e-6)]
    return cases


def test_sub_index_golden_edges(spark):
    cases = edge_cases()
    df = spark.createDataFrame(cases, "pollutant string, value double")
    got = A.with_sub_index(df).collect()
    for r in got:
        assert r.sub_index == brute_sub_index(r.pollutant, r.value), (r.pollutant, r.value, r.sub_index)


def test_join_plan_equals_case(spark):
    df = spark.createDataFrame(edge_cases(), "pollutant string, value double").withColumn("id", F.monotonically_increasing_id())
    a = {r.id: r.sub_index for r in A.with_sub_index(df).collect()}
    b = {r.id: r.sub_index for r in A.with_sub_index_join(df).collect()}
    assert a == b


def test_join_is_broadcast_hash(spark):
    df = spark.createDataFrame([("PM2.5", 10.0)], "pollutant string, value double")
    plan = A.with_sub_index_join(df)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan


def test_sub_index_monotone(spark):
    rows = [(p, float(c)) for p in K.AQI_BREAKPOINTS for c in [x * 0.5 for x in range(1, 4000)]]
    got = A.with_sub_index(spark.createDataFrame(rows, "pollutant string, value double")).orderBy("pollutant", "value").collect()
    last = {}
    for r in got:
        assert r.sub_index >= last.get(r.pollutant, 0)
        last[r.pollutant] = r.sub_index


def test_overall_and_driver(spark):
    rows = [("a", "PM2.5", 95.0), ("a", "PM10", 20.0), ("a", "NH3", 500.0), ("b", "NH3", 3.0), ("c", "SO2", 10.0), ("c", "NO2", 10.0)]
    df = A.with_sub_index(spark.createDataFrame(rows, "city string, pollutant string, value double"))
    out = {r.city: r for r in A.overall(df, ["city"]).collect()}
    assert out["a"].aqi == brute_sub_index("PM2.5", 95.0) and out["a"].driving_pollutant == "PM2.5"
    assert out["b"].aqi == K.AQI_WHEN_NO_POLLUTANT and out["b"].driving_pollutant is None
    # tie (12 and 12): first in target order wins (NO2 before SO2)
    assert out["c"].driving_pollutant == "NO2"
    subs = df.groupBy("city").agg(F.max("sub_index").alias("m")).collect()
    for r in subs:
        if r.m is not None:
            assert out[r.city].aqi >= r.m


@pytest.mark.parametrize("aqi,cat", [(0, "Good"), (50, "Good"), (51, "Satisfactory"), (200, "Moderate"), (301, "Very Poor"), (401, "Severe"), (None, None)])
def test_category(spark, aqi, cat):
    df = spark.createDataFrame([(aqi,)], "aqi int")
    assert df.select(X.aqi_category(F.col("aqi")).alias("c")).first().c == cat


def test_wide_overall_matches_long(spark):
    row = {"pm25": 130.0, "pm10": 60.0, "no2": 10.0, "so2": 900.0, "co": 0.5, "o3": 20.0}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} double" for k in row))
    cols = {p: F.col(K.COLUMN_OF[p]) for p in K.AQI_BREAKPOINTS}
    got = df.select(X.overall_aqi_wide(cols).alias("a")).first().a
    assert got == max(brute_sub_index(p, row[K.COLUMN_OF[p]]) for p in K.AQI_BREAKPOINTS)
