"""Stream = batch; forecast date matching; model guards, save/load."""

import pytest
from pyspark.sql import functions as F

from aqlens import constants as K
from aqlens.operators import weather as W
from aqlens.plans import models as M
from aqlens.session import scratch_path
from aqlens.sources import files as Fs
from aqlens.sources import tables as T
from aqlens.streaming import ingest as Sx


def test_stream_equals_batch(spark, sf_small):
    root = scratch_path(spark, "test-stream")
    readings = T.readings(spark, sf_small)
    Fs.write_pages(readings, f"{root}/landing/a", page_size=200)
    Fs.write_pages(readings, f"{root}/landing/b", page_size=200)
    # one file per micro-batch: duplicates arrive in later batches
    Sx.run_deduplicated(Sx.page_stream(spark, f"{root}/landing/*", files_per_trigger=1), f"{root}/out", f"{root}/ckpt")
    got = spark.read.parquet(f"{root}/out").select(*Sx.DEDUPE_KEYS)
    want = readings.select(*Sx.DEDUPE_KEYS).distinct()
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_forecast_match_paths(spark):
    doc = '{"daily": {"time": ["2024-01-01", "2024-01-02"], "temperature_2m_max": [30.0, 20.0], "temperature_2m_min": [10.0, 0.0], "relative_humidity_2m_max": [70.0], "precipitation_sum": [1.5, 2.5]}}'
    docs = spark.createDataFrame([("A", "w1", doc)], "city string, doc_key string, payload string")
    req = spark.createDataFrame(
        [("A", "2024-01-02", "w1"), ("A", "2024-01-09", "w1"), ("B", "2024-01-02", "w1")],
        "city string, date_text string, doc_key string",
    )
    out = {(r.city, r.date_text): r for r in W.match_forecast_day(req, docs).collect()}
    m = out[("A", "2024-01-02")]
    assert (m.T, m.RF, m.weather_matched) == (10.0, 2.5, True)
    assert m.RH == K.WEATHER_KEY_DEFAULTS["RH"]  # short array -> default
    f = out[("A", "2024-01-09")]
    assert (f.T, f.RH, f.weather_matched) == (20.0, 70.0, False)  # first day
    d = out[("B", "2024-01-02")]
    assert (d.T, d.WS, d.BP, d.weather_matched) == (25.0, 5.0, 1013.0, False)  # no document


def test_display_entries_drop_zero(spark):
    six = spark.createDataFrame([("A", "d", 0.0, 65.0, 0.0, 180.0, 0.0, 1013.26)], "city string, date string, T double, RH double, WS double, WD double, RF double, BP double")
    got = {r.key: r.value for r in W.display_entries(six).collect()}
    assert got == {"T": 0.0, "RH": 65.0, "WD": 180.0, "BP": 1013.3}


def test_city_lookup_default(spark):
    df = spark.createDataFrame([("Mumbai",), ("Nowhere",)], "city string")
    got = {r.city: r for r in W.with_city_lookup(df).collect()}
    assert got["Mumbai"].region == "West India" and got["Mumbai"].known_city
    assert (got["Nowhere"].latitude, got["Nowhere"].region) == (K.CITY_COORDINATES["Delhi"][0], "India")


def test_training_guards(spark):
    df = spark.createDataFrame([(1.0, None)] * 5, "x double, aqi double")
    with pytest.raises(M.TrainingError):
        M.guard(df, "aqi", ["x"])
    with pytest.raises(M.TrainingError):
        M.guard(df.fillna(1.0), "aqi", ["x"])
    with pytest.raises(M.TrainingError):
        M.guard(df, "aqi", [])


def test_fit_save_load_score(spark):
    rows = [(f"c{i % 3}", f"2024-01-{i % 28 + 1:02d}", float(i), float(i % 7), 2.0 * i + 1) for i in range(200)]
    df = spark.createDataFrame(rows, "city string, date string, a double, b double, y double")
    fit = M.fit_targets(df, ["a", "b"], ["y"], M.ForestSettings(trees=5, depth=4))
    m = fit.metrics.first()
    assert m.target == "y" and m.r2 > 0.8
    path = scratch_path(spark, "test-model")
    M.save_models(fit, path)
    loaded = M.load_models(spark, path)
    assert loaded.features == ["a", "b"] and loaded.targets == ["y"]
    s = M.score(loaded, df.drop("b"), keep=["city", "date"])  # missing feature -> 0
    assert s.count() == 200 and "pred_y" in s.columns
    assert M.load_models(spark, path + "-absent") is None
    imp = M.mean_importance(M.importance_table(spark, fit)).collect()
    assert abs(sum(r.avg_importance for r in imp) - 1.0) < 1e-6


def test_metric_formulas(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (3.0, 2.0)], "y double, p double")
    r = M.regression_metrics(df, "y", "p").first()
    assert r.n == 3 and abs(r.mae - 0.5) < 1e-12 and abs(r.r2 - (1 - 1.25 / 2.0)) < 1e-12
    c = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "y string, p string")
    m = M.classification_metrics(c, "y", "p").first()
    # sklearn: f1 a=2/3 (w .5), b=2/3*... computed by hand: a: tp1 sup2 pred1 -> 2/3; b: tp1 sup1 pred3 -> .5; c: 0
    assert abs(m.accuracy - 0.5) < 1e-12 and abs(m.f1_weighted - (2 * (2 / 3) + 0.5 + 0) / 4) < 1e-12


def test_current_weather_defaults(spark):
    docs = spark.createDataFrame(
        [("A", '{"current": {"temperature_2m": 31.5, "surface_pressure": 1001.0}, "daily": {"precipitation_sum": [4.0]}}'), ("B", "{}")],
        "city string, payload string",
    )
    got = {r.city: r for r in W.current_weather(docs).collect()}
    assert (got["A"].T, got["A"].RH, got["A"].RF, got["A"].BP) == (31.5, 65.0, 4.0, 1001.0)
    assert (got["B"].T, got["B"].WS, got["B"].WD) == (25.0, 5.0, 180.0)


def test_explode_daily_positions(spark):
    doc = '{"daily": {"time": ["d1", "d2"], "temperature_2m_max": [1.0, 2.0]}}'
    rows = W.explode_daily(spark.createDataFrame([("A", doc)], "city string, payload string")).collect()
    assert [(r.pos, r.time, r.temperature_2m_max, r.precipitation_sum) for r in rows] == [(0, "d1", 1.0, None), (1, "d2", 2.0, None)]


def test_pages_state_partition_pruning(spark, sf_small):
    path = scratch_path(spark, "test-pages-state")
    readings = T.readings(spark, sf_small)
    Fs.write_pages(readings, path, page_size=100, by_state=True)
    got = Fs.read_pages(spark, path, state="MIDDLE EAST")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(state_key" in plan and "MIDDLE_EAST" in plan
    assert got.count() == readings.filter(F.col("state") == "MIDDLE EAST").count() > 0


def test_forests_are_deterministic(spark, sf_small):
    from aqlens.plans import training as Tr

    few = M.ForestSettings(trees=8, depth=6)  # only the repetition is tested here
    fit = [Tr.with_overall(Tr.six_target_forest(spark, sf_small, few).metrics) for _ in range(2)]
    a, b = (sorted(tuple(r) for r in f.collect()) for f in fit)
    assert a == b and [r[0] for r in a] == sorted([*[K.COLUMN_OF[p] for p in K.TARGET_POLLUTANTS], "Overall"])


def test_late_unique_row_is_kept(spark, tmp_path):
    import json
    import os
    import time

    land = tmp_path / "landing"
    land.mkdir()

    def rec(i, ts):
        return {"reading_id": i, "state": "S", "city": "C", "station": f"s{i}", "last_update": ts, "pollutant_id": "NO2", "pollutant_avg": "1"}

    (land / "a.json").write_text(json.dumps({"total": 3, "records": [rec(1, "10-01-2024 10:00:00")]}) + "\n")
    time.sleep(1.1)
    (land / "b.json").write_text(json.dumps({"total": 3, "records": [rec(2, "01-01-2024 10:00:00"), rec(1, "10-01-2024 10:00:00")]}) + "\n")
    os.utime(land / "b.json")
    root = scratch_path(spark, "test-late")
    # a third file in a run of its own: days late, a bad time, and repeats of both
    for name in ("first", "second"):
        if name == "second":
            late = [rec(3, "05-01-2024 10:00:00"), rec(4, "no time"), rec(4, "no time"), rec(2, "01-01-2024 10:00:00")]
            (land / "c.json").write_text(json.dumps({"total": 4, "records": late}) + "\n")
            (land / "d.json").write_text(json.dumps({"total": 1, "records": late[1:2]}) + "\n")
        Sx.run_deduplicated(Sx.page_stream(spark, str(land), files_per_trigger=1), f"{root}/o", f"{root}/c")
    got = sorted(r.station for r in spark.read.parquet(f"{root}/o").collect())
    assert got == ["s1", "s2", "s3", "s4"]


def test_tiles_count_repeated_pages_once(spark, tmp_path):
    import json

    land = tmp_path / "tiles"
    land.mkdir()
    recs = [
        {"state": "S", "city": c, "station": f"s{i}", "last_update": "10-01-2024 10:00:00", "pollutant_id": "NO2", "avg_value": str(10 * i)}
        for i, c in ((1, "A"), (2, "B"), (3, "B"))
    ]
    for name in ("a", "b"):
        (land / f"{name}.json").write_text(json.dumps({"total": 3, "records": recs}) + "\n")
    root = scratch_path(spark, "test-tiles")
    stream = Sx.page_stream(spark, str(land), files_per_trigger=1)
    Sx.run_tiles(stream, f"{root}/o", f"{root}/t", f"{root}/c")
    t = Sx.latest_tiles(spark, f"{root}/t").first()
    assert (t.n_rows, t.n_states, t.n_cities, t.n_stations, t.mean_aqi, t.max_aqi) == (3, 1, 2, 3, 20.0, 30.0)


def test_newest_document_counts(spark):
    import datetime

    doc = '{"daily": {"time": ["2024-01-01"], "temperature_2m_max": [%s], "temperature_2m_min": [%s]}}'
    rows = [("A", "w1", doc % (30.0, 10.0), datetime.datetime(2024, 1, 1)), ("A", "w1", doc % (50.0, 50.0), datetime.datetime(2024, 1, 2))]
    docs = spark.createDataFrame(rows, "city string, doc_key string, payload string, landed_at timestamp")
    req = spark.createDataFrame([("A", "2024-01-01", "w1")], "city string, date_text string, doc_key string")
    assert [r.T for r in W.match_forecast_day(req, docs).collect()] == [50.0]


def test_covering_document_of_any_weekday(spark):
    import datetime

    days = [datetime.date(2024, 1, 1) + datetime.timedelta(d) for d in range(14)]
    doc = lambda own: '{"daily": {"time": %s, "temperature_2m_max": %s, "temperature_2m_min": %s}}' % (
        str([str(d) for d in own]).replace("'", '"'), [float(d.day) for d in own], [float(d.day) for d in own],
    )
    docs = spark.createDataFrame([("A", doc(days[:7])), ("A", doc(days[7:]))], "city string, payload string")
    req = spark.createDataFrame([("A", d, str(d)) for d in days] + [("A", datetime.date(2024, 3, 1), "2024-03-01")], "city string, date date, date_text string")
    got = {r.date: (r.T, r.weather_matched) for r in W.match_forecast_day(req, W.covering_days(docs), keys=("city", "date")).collect()}
    assert all(got[d] == (float(d.day), True) for d in days)
    assert got[datetime.date(2024, 3, 1)] == (K.WEATHER_KEY_DEFAULTS["T"], False)


def test_weather_for_dates_routes_by_date_class(spark):
    fdoc = '{"daily": {"time": ["2024-01-15", "2024-01-16"], "temperature_2m_max": [30.0, 20.0], "temperature_2m_min": [10.0, 10.0]}}'
    cdoc = '{"current": {"temperature_2m": 17.5, "surface_pressure": 999.0}, "daily": {"precipitation_sum": [2.0]}}'
    forecast = spark.createDataFrame([("A", "w", fdoc)], "city string, doc_key string, payload string")
    current = spark.createDataFrame([("A", cdoc)], "city string, payload string")
    req = spark.createDataFrame(
        [("A", "2024-01-15", "2024-01-15", "w"), ("A", "2024-01-16", "2024-01-16", "w"), ("B", "2024-01-15", "2024-01-15", "w")],
        "city string, d string, date_text string, doc_key string",
    ).withColumn("date", F.to_date("d")).drop("d")
    got = {(r.city, r.date_text): r for r in W.six_keys_for_dates(req, forecast, current, "2024-01-15").collect()}
    t = got[("A", "2024-01-15")]
    assert (t.source, t.T, t.BP, t.RF) == ("current", 17.5, 999.0, 2.0)
    f = got[("A", "2024-01-16")]
    assert (f.source, f.T, f.weather_matched) == ("forecast", 15.0, True)
    b = got[("B", "2024-01-15")]
    assert (b.source, b.T, b.BP) == ("current", 25.0, 1013.0)
