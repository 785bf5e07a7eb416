"""Hand fixtures: CSV with BOM header, NA, a 0/0 city, varied headers, a bad
date; landed pages and the fallback chain; sinks."""

import json
import os

import pytest
from pyspark.sql import functions as F

from aqlens.operators import dashboard as D
from aqlens.sources import files as Fs

STATE_CSV = (
    "﻿State/UTs,City,2021 - Good Days (AQI - 0-200),2021 - Bad Days (Poor/ Very-Poor/ Severe) (AQI>200)\n"
    "Alpha,One,300,65\n"
    "Alpha,Two,NA,NA\n"
    "Beta,Three,0,0\n"
    "Beta,Four,100,265\n"
)
YEAR_CSV = (
    "Sl. No.,State,City Name,2022 - Good Days (AQI< =200),2022 - Bad Days (AQI> 200),"
    "​2023 - Good Days (AQI<=200) ,2023 - Bad Days (AQI >200)\n"
    "1,S,Alpha,300,65,280,85\n"
    "2,S,Beta,0,0,200,165\n"
    "3,S,Alpha,10,x,5,5\n"
)
CITY_DAY_CSV = (
    "City,Date,PM2.5,PM10,NO,NO2,NOx,NH3,CO,SO2,O3,Benzene,Toluene,Xylene,AQI\n"
    "A,2020-01-01,50,80,1,2,3,4,1.1,5,6,0.1,0.2,0.3,120\n"
    "A,2020-01-02,,80,1,2,3,4,1.1,5,6,0.1,0.2,0.3,110\n"
    "B,not-a-date,50,80,1,2,3,4,1.1,5,6,0.1,0.2,0.3,100\n"
)


def _write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text, encoding="utf-8")
    return str(p)


def test_state_csv_na_and_zero(spark, tmp_path):
    df = Fs.read_state_csv(spark, _write(tmp_path, "s.csv", STATE_CSV))
    m = {r.city: r for r in D.state_metrics(df).collect()}
    assert m["Two"].good_days is None and m["Two"].total_days == 0 and m["Two"].good_pct == 0.0
    assert m["Three"].estimated_aqi == 50.0 and m["Three"].good_pct == 0.0
    assert abs(m["Four"].estimated_aqi - (50 + 265 / 365 * 300)) < 1e-9
    top = D.top_by_mean(D.state_metrics(df), "state", "estimated_aqi").collect()
    assert [r.state for r in top] == ["Beta", "Alpha"]


def test_yearly_csv_headers(spark, tmp_path):
    df = Fs.read_yearly_csv(spark, _write(tmp_path, "y.csv", YEAR_CSV))
    assert "2023 - Good Days (AQI<=200)" in df.columns  # zero-width and blanks stripped
    y = D.yearly_metrics(df, lambda c: "Good Days" in c, lambda c: "Bad Days" in c)
    rows = y.orderBy("`Sl. No.`").collect()
    assert rows[0].total_good_days == 580 and rows[0].total_bad_days == 150
    assert rows[1].good_pct == pytest.approx(200 / 365 * 100)
    assert rows[2].total_bad_days == 5  # unparsable 'x' counts as 0
    totals = {r["City Name"]: r.total_good_days for r in D.city_totals(y, "City Name").collect()}
    assert totals["Alpha"] == 595


def test_city_day_csv_drops_incomplete(spark, tmp_path):
    df = Fs.read_city_day_csv(spark, _write(tmp_path, "c.csv", CITY_DAY_CSV))
    rows = df.collect()
    assert len(rows) == 1 and rows[0].pm25 == 50.0 and str(rows[0].date) == "2020-01-01"


def test_pages_fallback_chain(spark, tmp_path):
    recs = [{"reading_id": i, "state": "S", "city": "C", "station": "st", "last_update": "01-01-2024 10:00:00",
             "latitude": "1", "longitude": "2", "pollutant_id": "PM2.5", "pollutant_min": "1", "pollutant_max": "3",
             "pollutant_avg": str(i)} for i in range(5)]
    d = tmp_path / "pages"
    d.mkdir()
    (d / "p0.json").write_text(json.dumps({"total": 5, "records": recs[:3]}) + "\n")
    (d / "p1.json").write_text(json.dumps({"total": 5, "records": recs[3:]}) + "\n")
    assert Fs.read_pages(spark, str(d)).count() == 5
    assert [r.reading_id for r in Fs.read_pages(spark, str(d), limit=2).collect()] == [0, 1]
    csv = _write(tmp_path, "snap.csv", "state,city,station,last_update,pollutant_id,pollutant_avg\nS,C,x,01-01-2024 10:00:00,NO2,5\n")
    assert Fs.load_readings(spark, str(d), csv).count() == 5
    assert Fs.load_readings(spark, str(tmp_path / "missing"), csv).count() == 1
    assert Fs.load_readings(spark, str(tmp_path / "missing"), str(tmp_path / "none.csv")).count() == 0


def test_read_required_missing(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        Fs.read_required(spark, str(tmp_path / "aqi_weather_merged.csv"), header=True)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 2021), ("b", 2022)], "k string, year int")
    Fs.write_table(df, str(tmp_path / "t"), ["year"])
    assert {"year=2021", "year=2022"} <= set(os.listdir(tmp_path / "t"))
    s = spark.createDataFrame([("S1", "2024-01-02 10:00:00", 3)], "session_id string, end_time string, n_total int")
    Fs.write_session_log(s.withColumn("end_time", F.to_timestamp("end_time")), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 1
