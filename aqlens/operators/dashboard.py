"""Dashboard aggregates: day-count tables, rankings, tiles, frequencies,
latest rows, option lists, filters and map points.

Every tile is a lazy plan; tiles over the same input share one ``agg``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aqlens import constants as K
from aqlens.functions import exprs as X
from aqlens.operators import aqi as A

ALL = K.ALL
MARKER_FILL = K.MARKER_FILL


def columns_where(df: DataFrame, pred: Callable[[str], bool]) -> list[str]:
    """Pick columns by a name predicate (substring, prefix); resolved from the
    schema on the driver, no job runs."""
    return [c for c in df.columns if pred(c)]


def select_available(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Project the listed columns that exist, in the listed order."""
    return df.select(*[c for c in wanted if c in df.columns])


def yearly_metrics(
    df: DataFrame,
    is_good: Callable[[str], bool] = lambda c: c.startswith("good_"),
    is_bad: Callable[[str], bool] = lambda c: c.startswith("bad_"),
) -> DataFrame:
    """Row totals over the yearly good/bad columns and the good share."""
    good, bad = columns_where(df, is_good), columns_where(df, is_bad)
    if not good or not bad:
        return df
    out = df.withColumns(
        {
            "total_good_days": X.hsum([F.col(c) for c in good]).cast("bigint"),
            "total_bad_days": X.hsum([F.col(c) for c in bad]).cast("bigint"),
        }
    )
    out = out.withColumn("total_days", F.col("total_good_days") + F.col("total_bad_days"))
    return out.withColumn("good_pct", X.safe_pct(F.col("total_good_days"), F.col("total_days")))


def state_metrics(df: DataFrame, good: str = "good_days", bad: str = "bad_days") -> DataFrame:
    """Total days, good share and estimated AQI ``50 + bad/total * 300``
    (0/0 -> share 0, AQI 50)."""
    g, b = F.coalesce(F.col(good), F.lit(0)), F.coalesce(F.col(bad), F.lit(0))
    out = df.withColumn("total_days", g + b)
    return out.withColumns(
        {
            "good_pct": X.safe_pct(g, F.col("total_days")),
            "estimated_aqi": F.lit(50.0) + F.coalesce(F.try_divide(b, F.col("total_days")) * 300, F.lit(0.0)),
        }
    )


def state_day_counts(readings: DataFrame, cut: int = 200) -> DataFrame:
    """Good (daily AQI <= cut) and bad days per (state, city)."""
    daily = A.city_air_quality(readings, ["state", "city", "date"])
    return daily.groupBy("state", "city").agg(
        F.count_if(F.col("aqi") <= cut).cast("int").alias("good_days"),
        F.count_if(F.col("aqi") > cut).cast("int").alias("bad_days"),
    )


def city_totals(yearly: DataFrame, city: str = "city") -> DataFrame:
    """Good and bad days summed per city."""
    return yearly.groupBy(city).agg(
        F.sum("total_good_days").alias("total_good_days"), F.sum("total_bad_days").alias("total_bad_days")
    )


def top_by_mean(df: DataFrame, key: str, metric: str, n: int = 10, name: str | None = None) -> DataFrame:
    """Mean of ``metric`` per ``key``, highest first, ties by key; top ``n``
    (a TakeOrdered plan: each partition keeps n rows)."""
    name = name or f"mean_{metric}"
    return df.groupBy(key).agg(F.avg(metric).alias(name)).orderBy(F.col(name).desc(), F.col(key)).limit(n)


def overall_stats(yearly: DataFrame) -> DataFrame:
    """Mean good share and total good/bad days over all rows (one pass)."""
    return yearly.agg(
        F.avg("good_pct").alias("mean_good_pct"),
        F.sum("total_good_days").alias("total_good_days"),
        F.sum("total_bad_days").alias("total_bad_days"),
    )


def tiles(norm: DataFrame, approx: bool = False) -> DataFrame:
    """National tiles in one aggregation: rows ("monitoring stations" as the
    application counts them), distinct stations, states, cities, mean and max
    AQI (the reading value as proxy) and the latest update.

    Exact distinct counts would expand each row once per counted column, so
    the rows are first reduced to one per (state, city, station); ``approx``
    uses HyperLogLog sketches instead (one pass, fixed-size buffers, about 5 %
    relative error)."""
    distinct = F.approx_count_distinct if approx else F.count_distinct
    places = norm.groupBy("state", "city", "station").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("value").alias("s"),
        F.count("value").alias("n_values"),
        F.max("value").alias("high"),
        F.max("datetime").alias("last"),
    )
    return places.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        distinct("station").alias("n_stations"),
        distinct("state").alias("n_states"),
        distinct("city").alias("n_cities"),
        F.try_divide(F.sum("s"), F.sum("n_values")).alias("mean_aqi"),
        F.max("high").alias("max_aqi"),
        F.max("last").alias("latest_update"),
    )


def frequency(df: DataFrame, key: str = "pollutant_id") -> DataFrame:
    """Rows per value, with the share of all rows."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    # the total is one row, so it goes to every task
    total = counts.agg(F.sum("n").alias("_total"))
    return counts.crossJoin(F.broadcast(total)).select(key, "n", (F.lit(100.0) * F.col("n") / F.col("_total")).alias("share_pct"))


def latest(norm: DataFrame, n: int = 50, cols: Sequence[str] = ("state", "city", "station", "pollutant_id", "value", "last_update")) -> DataFrame:
    """Latest ``n`` rows by parsed time (ties by reading id, newest first)."""
    order = [F.col("datetime").desc_nulls_last()] + ([F.col("reading_id").desc()] if "reading_id" in norm.columns else [])
    return norm.orderBy(*order).limit(n).select(*[c for c in ("reading_id", *cols) if c in norm.columns])


def distinct_options(df: DataFrame, cols: Sequence[str] = ("state", "city")) -> DataFrame:
    """Sorted distinct non-blank values per column, as (kind, value)."""
    combos = df.select(*[X.strip_text(F.col(c)).alias(c) for c in cols]).distinct()  # one scan
    each = F.inline(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in cols]))
    return combos.select(each).filter(F.length("value") > 0).distinct().orderBy("kind", "value")


def filter_state_city(df: DataFrame, state: str = ALL, city: str = ALL) -> DataFrame:
    """Equality filter; 'All' means no filter (pushed to the scan by Catalyst)."""
    if state != ALL:
        df = df.filter(F.col("state") == state)
    if city != ALL:
        df = df.filter(F.col("city") == city)
    return df


def map_points(norm: DataFrame) -> DataFrame:
    """Rows with numeric coordinates, for a map."""
    return norm.select(
        *[c for c in ("reading_id",) if c in norm.columns], "lat", "lon", "state", "city", "station", "pollutant_id", "value", F.coalesce("value", F.lit(MARKER_FILL)).alias("marker_value")
    ).dropna(subset=["lat", "lon"])



def aqi_proxy(df: DataFrame) -> DataFrame:
    """``aqi``: the average reading (``avg_value``, else ``pollutant_avg``,
    numeric), else the constant 100 when neither column exists; plus its
    category.  The column choice is made from the schema on the driver."""
    if "avg_value" in df.columns:
        v = X.parse_float(F.col("avg_value"))
    elif "pollutant_avg" in df.columns:
        v = X.parse_float(F.col("pollutant_avg"))
    else:
        v = F.lit(K.AQI_WITHOUT_VALUES)
    return df.withColumn("aqi", v).withColumn("aqi_category", X.aqi_category(F.col("aqi")))
