"""Cleaning live readings into one pollutant row per entity.

Long readings (one row per station and pollutant) are typed, mapped to the
canonical pollutant names, filtered to valid values, combined per entity and
pollutant (ordered pair fold, plain mean or first value), completed with
defaults and repaired (PM10 >= PM2.5).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aqlens import constants as K
from aqlens.functions import exprs as X

FOLD_CHUNK = 1 << 21


def normalise(readings: DataFrame, missing_as_zero: bool = False) -> DataFrame:
    """Type the text columns of landed readings.

    Adds ``pollutant`` (canonical), ``value`` / ``value_min`` / ``value_max``
    (double), ``datetime`` (parsed day-first time), ``date``, ``hour``,
    ``day``, ``month``, ``lat`` and ``lon`` (double).  The average is taken
    from ``avg_value`` where the row has one, else from ``pollutant_avg``.
    """
    cols = set(readings.columns)

    def number(*names: str, zero: bool = False):
        """The first of the columns that the row has a value in."""
        held = [F.col(n).cast("string") for n in names if n in cols]
        return X.parse_float(F.coalesce(*held), zero) if held else F.lit(None).cast("double")

    out = readings.withColumns(
        {
            "pollutant": X.canonical_pollutant(F.col("pollutant_id")),
            "value": number("avg_value", "pollutant_avg", zero=missing_as_zero),
            "value_min": number("min_value", "pollutant_min"),
            "value_max": number("max_value", "pollutant_max"),
            "datetime": X.parse_reading_time(F.col("last_update")),
        }
    )
    out = out.withColumns(
        {
            "date": F.to_date("datetime"),
            "hour": F.hour("datetime"),
            "day": F.dayofmonth("datetime"),
            "month": F.month("datetime"),
        }
    )
    if "latitude" in cols:
        out = out.withColumns({"lat": X.to_number(F.col("latitude")), "lon": X.to_number(F.col("longitude"))})
    return out


def valid(df: DataFrame) -> DataFrame:
    """Mapped id non-empty and value >= 0 (null values are not readings)."""
    return df.filter((F.length("pollutant") > 0) & F.col("value").isNotNull() & (F.col("value") >= 0))


def station_mean(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Plain mean per (keys, pollutant): what the averaging option promises."""
    return df.groupBy(*keys, "pollutant").agg(X.exact_avg("value").alias("value"))


def first_value(df: DataFrame, keys: Sequence[str], order: str = "reading_id") -> DataFrame:
    """First value by arrival order per (keys, pollutant).  ``min_by`` is a
    partial aggregate, so a hot group costs no more than any other."""
    return df.groupBy(*keys, "pollutant").agg(F.min_by("value", order).alias("value"))


def pair_fold(df: DataFrame, keys: Sequence[str], order: str = "reading_id", chunk: int = FOLD_CHUNK, levels: int = 3) -> DataFrame:
    """Ordered running pair mean ``acc = (acc + v) / 2`` seeded by the first
    value, per (keys, pollutant).

    A run x_1..x_m is summarised as (cnt = m, S = sum x_i * 2^-(m-i+1),
    first); the fold result is S + first * 2^-cnt.  Summaries combine
    associatively in order (A then B: cnt_A + cnt_B, S_A * 2^-cnt_B + S_B,
    first_A), so a group is reduced bottom-up over ranges of the order key:
    at each level the rows of one ``chunk``-wide key range are combined by a
    window (rows after each one) and an aggregation, and the range number
    becomes the next level's key.  With unique integer keys no window
    partition ever holds more than ``chunk`` rows, however hot the group and
    however sparse the keys; ``levels`` levels of width 2^21 cover any
    non-negative 64-bit key, and a last step combines the few remaining
    summaries per group.
    """
    g = [*keys, "pollutant"]
    shift = max(1, (chunk - 1).bit_length())
    cur = df.select(
        *g,
        F.col(order).cast("long").alias("_k"),
        F.lit(1).cast("long").alias("_cnt"),
        (F.col("value") / 2).alias("_s"),
        F.col(order).cast("long").alias("_fo"),
        F.col("value").alias("_fv"),
    )

    def combine_level(rows: DataFrame, bucket) -> DataFrame:
        part = [*g, "_b"] if bucket is not None else g
        rows = rows.withColumn("_b", bucket) if bucket is not None else rows
        w = Window.partitionBy(*part).orderBy(F.col("_k").desc()).rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("_later", F.coalesce(F.sum("_cnt").over(w), F.lit(0)))
        out = rows.groupBy(*part).agg(
            F.sum("_cnt").alias("_cnt"),
            F.sum(F.col("_s") * F.pow(F.lit(2.0), -F.col("_later"))).alias("_s"),
            F.min("_fo").alias("_fo2"),
            F.min_by("_fv", "_fo").alias("_fv"),
        )
        out = out.withColumnRenamed("_fo2", "_fo")
        return out.withColumnRenamed("_b", "_k") if bucket is not None else out

    for _ in range(levels):
        cur = combine_level(cur, F.shiftright(F.col("_k"), shift))
    final = combine_level(cur, None)
    return final.select(*g, (F.col("_s") + F.col("_fv") * F.pow(F.lit(2.0), -F.col("_cnt"))).alias("value"))


def combine(df: DataFrame, keys: Sequence[str], method: str = "mean", order: str = "reading_id") -> DataFrame:
    """One value per (keys, pollutant): ``mean`` (default), ``fold`` or ``first``."""
    if method == "mean":
        return station_mean(df, keys)
    if method == "fold":
        return pair_fold(df, keys, order)
    if method == "first":
        return first_value(df, keys, order)
    raise ValueError(f"unknown method {method!r}")


CITY_DEFAULT_POLLUTANTS = ["PM2.5", "PM10", "NO2", "SO2"]


def city_default(pollutant: str, city) -> "Column":
    """The city-specific default of one of PM2.5/PM10/NO2/SO2 (unknown
    cities take the fallback city's value)."""
    i = CITY_DEFAULT_POLLUTANTS.index(pollutant)
    fallback = K.CITY_DEFAULTS[K.CITY_DEFAULT_FALLBACK][i]
    return X.lookup(city, {c: v[i] for c, v in K.CITY_DEFAULTS.items()}, default=fallback)


def complete(
    combined: DataFrame,
    keys: Sequence[str],
    defaults: dict | None = None,
    city_defaults: bool = False,
    city: str = "city",
    zero_as_missing: bool = False,
) -> DataFrame:
    """Wide row per entity with all twelve pollutants: the combined value
    when present and >= 0, else the default.  A fixed-list pivot is one
    aggregation, no extra job to discover values.  ``city_defaults`` (off by
    default) fills PM2.5, PM10, NO2 and SO2 from the city's own defaults;
    ``zero_as_missing`` also replaces values equal to 0 (the stricter of the
    two scoring paths)."""
    defaults = defaults or K.UNIVERSAL_DEFAULTS
    wide = combined.groupBy(*keys).agg(
        *[F.max(F.when(F.col("pollutant") == p, F.col("value"))).alias(c) for p, c in K.POLLUTANTS]
    )

    def fallback(p):
        if city_defaults and p in CITY_DEFAULT_POLLUTANTS and city in keys:
            return city_default(p, F.col(city))
        return F.lit(float(defaults[p]))

    return wide.select(
        *keys,
        *[
            F.when(F.col(c).isNotNull() & ((F.col(c) > 0) if zero_as_missing else (F.col(c) >= 0)), F.col(c))
            .otherwise(fallback(p))
            .alias(c)
            for p, c in K.POLLUTANTS
        ],
    )


def pm_repair(wide: DataFrame) -> DataFrame:
    """PM10 below PM2.5 is replaced by 1.2 x PM2.5."""
    bad = F.col("pm10") < F.col("pm25")
    return wide.withColumns({"pm10": F.when(bad, F.col("pm25") * 1.2).otherwise(F.col("pm10")), "pm_repaired": bad})


def pollutant_rows(
    readings: DataFrame,
    keys: Sequence[str] = ("city", "date"),
    method: str = "mean",
    missing_as_zero: bool = False,
    city_defaults: bool = False,
    zero_as_missing: bool = False,
) -> DataFrame:
    """Clean live readings to one complete, repaired 12-pollutant row per entity."""
    v = valid(normalise(readings, missing_as_zero))
    combined = combine(v, list(keys), method)
    return pm_repair(complete(combined, list(keys), city_defaults=city_defaults, zero_as_missing=zero_as_missing))


def pivot_wide(combined: DataFrame, keys: Sequence[str], pollutants: Sequence[str] = tuple(K.POLLUTANT_NAMES)) -> DataFrame:
    """Wide row per entity with the listed pollutants, null where absent."""
    return combined.groupBy(*keys).agg(
        *[F.max(F.when(F.col("pollutant") == p, F.col("value"))).alias(K.COLUMN_OF[p]) for p in pollutants]
    )
