"""User-level jobs over landed files, one per lifecycle of the application:
offline training, dashboard tables and batch prediction.  Each reads files,
runs lazily planned Spark work and writes its results; the only actions are
the writes, the training guards and the forest fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
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
from aqlens.plans import training as Tr
from aqlens.session import written
from aqlens.sources import files as Fs
from aqlens.sources import versions as V


def offline_training(
    spark: SparkSession, city_day_path: str, weather_path: str, out_dir: str, s: M.ForestSettings = M.FULL
) -> DataFrame:
    """City-day CSV (incomplete rows dropped) joined with the landed daily
    weather on (city, date), written as Parquet partitioned by year; the
    six-target forest is trained on it and saved with its metrics and the
    training city codes.  Returns the metrics."""
    days = Fs.read_city_day_csv(spark, city_day_path)
    wx = W.parse_daily(Fs.read_weather_docs(spark, weather_path))
    merged = Fe.calendar(days.join(wx, ["city", "date"], "inner"))
    # the write counts what the guards and the imputation need
    known = [c for c in [*Dy.FEATURES_SIX, *Dy.TARGETS_SIX] if c != "city_encoded"]
    publish = lambda df: V.publish_table(df, f"{out_dir}/merged", ["year"])
    base, profile = Q.profiled(merged, publish, known, Dy.TARGETS_SIX)
    M.guard(profile, Dy.TARGETS_SIX[0], Dy.FEATURES_SIX)
    codes = written(Fe.code_dimension(base, "city"), "city-codes")
    table = Tr.six_target_table(Fe.attach_codes(base, codes, "city"), profile)
    fit = M.fit_targets(table, Dy.FEATURES_SIX, Dy.TARGETS_SIX, s)
    fit.metrics = Tr.with_overall(fit.metrics)
    fit.tables["city_codes"] = codes
    M.save_models(fit, f"{out_dir}/models")
    return fit.metrics


def retrain(spark: SparkSession, merged_path: str, out_dir: str, s: M.ForestSettings = M.FULL) -> DataFrame:
    """Train the six-target forest again from the merged table of an earlier
    ``offline_training``; a missing table ends the run with a message."""
    base = V.read_table(spark, merged_path)
    known = [c for c in [*Dy.FEATURES_SIX, *Dy.TARGETS_SIX] if c != "city_encoded"]
    table, profile = Q.profiled(base, lambda df: written(df, "merged"), known, Dy.TARGETS_SIX)
    M.guard(profile, Dy.TARGETS_SIX[0], Dy.FEATURES_SIX)
    codes = written(Fe.code_dimension(table, "city"), "city-codes")
    fit = M.fit_targets(Tr.six_target_table(Fe.attach_codes(table, codes, "city"), profile), Dy.FEATURES_SIX, Dy.TARGETS_SIX, s)
    fit.metrics = Tr.with_overall(fit.metrics)
    fit.tables["city_codes"] = codes
    M.save_models(fit, f"{out_dir}/models")
    return fit.metrics


def train_live(spark: SparkSession, pages_path: str, model_dir: str, s: M.ForestSettings = M.LIVE) -> DataFrame:
    """Fit the live regressor and classifier on landed reading pages and
    publish them with their encoders, code tables and categories.  Returns the
    metrics."""
    fit = Tr.live_models(R.normalise(Fs.read_pages(spark, pages_path, number=True)), s)
    M.save_live(fit, model_dir)
    return fit.metrics


def score_live(spark: SparkSession, pages_path: str, model_dir: str, out_path: str) -> DataFrame:
    """Predicted AQI and category of every landed reading, by the live models
    published last."""
    fit = M.load_live(spark, model_dir)
    if fit is None:
        raise M.TrainingError("live models are not available")
    norm = R.normalise(Fs.read_pages(spark, pages_path, number=True))
    return V.publish_table(Tr.live_score(fit, norm, ["reading_id", "state", "city", "station", "pollutant", "date", "value"]), out_path)


def session_log(spark: SparkSession, events: DataFrame, out_path: str) -> DataFrame:
    """Summaries of the sessions in an activity log, written as JSON by day."""
    Fs.write_session_log(Ac.session_summary(events), out_path)
    return spark.read.json(out_path)


def dashboard(spark: SparkSession, yearly_csv: str, state_csv: str, pages_path: str, out_dir: str) -> dict[str, DataFrame]:
    """Dashboard tables from the two day-count CSVs and landed reading pages,
    written as Parquet under ``out_dir``; returns the written tables."""
    yearly = D.yearly_metrics(Fs.read_yearly_csv(spark, yearly_csv), lambda c: "Good Days" in c, lambda c: "Bad Days" in c)
    state = D.state_metrics(Fs.read_state_csv(spark, state_csv))
    # the pages are parsed once; the tables read what was written
    norm = V.publish_table(R.normalise(Fs.read_pages(spark, pages_path, number=True)), f"{out_dir}/readings")
    city_col = "City Name" if "City Name" in yearly.columns else "city"
    tables = {
        "city_good_bad": D.city_totals(yearly, city_col),
        "yearly_stats": D.overall_stats(yearly),
        "state_estimated_aqi_top10": D.top_by_mean(state, "state", "estimated_aqi"),
        "state_good_pct_top10": D.top_by_mean(state, "state", "good_pct"),
        "tiles": D.tiles(norm),
        "pollutant_frequency": D.frequency(norm),
        "latest_50": D.latest(norm),
        "map_points": D.map_points(norm),
        "city_air_quality": A.overall(A.with_sub_index(R.station_mean(R.valid(norm), ["city", "date"]))),
    }
    tables["page_rejects"] = Fs.read_page_rejects(spark, pages_path)
    return {name: V.publish_table(df, f"{out_dir}/{name}") for name, df in tables.items()}


def predict(spark: SparkSession, pages_path: str, forecast_path: str, model_dir: str, out_path: str) -> DataFrame:
    """Batch prediction: landed readings -> one completed pollutant row per
    (city, date) -> the six keys of the day, from the newest forecast that
    covers it (``weather_matched`` says whether there is one) -> synthesised weather
    features -> saved six-target forest -> sub-indices, AQI, category,
    driving pollutant and plausibility, written as Parquet."""
    fit = M.load_models(spark, model_dir)
    if fit is None:
        raise M.TrainingError("weather AQI model is not available")
    rows = R.pollutant_rows(Fs.read_pages(spark, pages_path, number=True))
    requests = rows.select(
        "city",
        "date",
        F.date_format("date", "yyyy-MM-dd").alias("date_text"),
    )
    docs = W.covering_days(Fs.read_weather_docs(spark, forecast_path, "doc_key"))
    six = W.synthesise_daily(W.match_forecast_day(requests, docs, keys=("city", "date")))
    table = Fe.calendar(rows.join(six.select("city", "date", "weather_matched", *W.WEATHER_COLUMNS), ["city", "date"]))
    codes = fit.tables.get("city_codes")
    if codes is not None:
        table = Fe.attach_scoring_codes(table, codes, "city")
    keep = ["city", "date", "pm25", "pm10", "no2", "so2"]
    scored = M.score(fit, table.select(*[c for c in table.columns if c not in ("pm25", "pm10", "no2", "so2")], *[F.col(c).alias(f"in_{c}") for c in keep[2:]]), keep=["city", "date", "weather_matched", *[f"in_{c}" for c in keep[2:]]])
    preds = {p: f"pred_{K.COLUMN_OF[p]}" for p in K.TARGET_POLLUTANTS}
    out = scored.select(
        "city", "date", "weather_matched", *[F.col(f"pred_{K.COLUMN_OF[p]}") for p in K.TARGET_POLLUTANTS],
        X.overall_aqi_wide(preds).alias("predicted_aqi"),
        A.driving_wide(preds).alias("driving_pollutant"),
        *[F.col(f"in_{c}").alias(c) for c in keep[2:]],
    ).withColumn("category", X.aqi_category(F.col("predicted_aqi")))
    out = Q.sanity(out, "predicted_aqi").drop("issues", "warnings")
    return V.publish_table(out, out_path)
