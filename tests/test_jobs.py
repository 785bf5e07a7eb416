"""End to end: land files derived from sf0.001, then run the three jobs."""

from pyspark.sql import functions as F

from aqlens import constants as K
from aqlens.plans import daily as Dy
from aqlens.plans import jobs as J
from aqlens.session import scratch_path
from aqlens.sources import files as Fs
from aqlens.sources import tables as T
from tests.test_sources import STATE_CSV, YEAR_CSV


def test_three_jobs(spark, sf_small, tmp_path):
    root = scratch_path(spark, "test-jobs")
    readings = T.readings(spark, sf_small)
    Fs.write_pages(readings, f"{root}/pages", page_size=250)
    d = Dy.daily_rows(spark, sf_small)
    csv = d.select(
        F.col("city").alias("City"), F.date_format("date", "yyyy-MM-dd").alias("Date"),
        *[F.col(K.COLUMN_OF[p]).alias(p) for p in K.POLLUTANT_NAMES], F.col("aqi").cast("double").alias("AQI"),
    )
    Fs.write_table(csv, f"{root}/city_day", fmt="csv")
    Fs.write_weather_docs(T.daily_weather_docs(spark, sf_small), f"{root}/weather")
    Fs.write_weather_docs(T.forecast_docs(spark, sf_small), f"{root}/forecast", key="doc_key")

    metrics = J.offline_training(spark, f"{root}/city_day", f"{root}/weather", f"{root}/out")
    assert sorted(r.target for r in metrics.collect())[-1] == "so2" and metrics.count() == 7
    assert spark.read.parquet(f"{root}/out/merged").count() == d.count()

    (tmp_path / "y.csv").write_text(YEAR_CSV, encoding="utf-8")
    (tmp_path / "s.csv").write_text(STATE_CSV, encoding="utf-8")
    tables = J.dashboard(spark, str(tmp_path / "y.csv"), str(tmp_path / "s.csv"), f"{root}/pages", f"{root}/dash")
    assert tables["tiles"].first().n_rows == readings.count()
    assert tables["latest_50"].count() == 50 and tables["state_estimated_aqi_top10"].count() == 2

    pred = J.predict(spark, f"{root}/pages", f"{root}/forecast", f"{root}/out/models", f"{root}/pred")
    assert pred.count() == d.count()
    assert pred.filter(F.col("predicted_aqi").isNull() | F.col("driving_pollutant").isNull()).count() == 0
