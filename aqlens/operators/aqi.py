"""Air Quality Index: sub-index per pollutant, overall index, category and the
pollutant that drives it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aqlens import constants as K
from aqlens.functions import exprs as X
from aqlens.operators.readings import normalise, station_mean, valid

# Order used to break ties between equal sub-indices (first listed wins).
TIE_ORDER = {p: i for i, p in enumerate(K.TARGET_POLLUTANTS)}


def breakpoints_frame(spark: SparkSession) -> DataFrame:
    """Breakpoint dimension (30 finite bins + 6 open top bins, hi null)."""
    rows = []
    for p, bins in K.AQI_BREAKPOINTS.items():
        for lo, hi, alo, ahi in bins:
            rows.append((p, float(lo), float(hi), float(alo), float(ahi), (ahi - alo) / (hi - lo)))
        rows.append((p, float(bins[-1][1]), None, float(K.TOP_BIN_AQI), float(K.TOP_BIN_AQI), 0.0))
    schema = "bp_pollutant string, bp_lo double, bp_hi double, aqi_lo double, aqi_hi double, slope double"
    return spark.createDataFrame(rows, schema)


def with_sub_index(df: DataFrame, pollutant: str = "pollutant", conc: str = "value") -> DataFrame:
    """Adds ``sub_index`` (int) by a generated CASE: no join, stays in codegen."""
    return df.withColumn("sub_index", X.sub_index_by_name(pollutant, conc))


def with_sub_index_join(df: DataFrame, pollutant: str = "pollutant", conc: str = "value") -> DataFrame:
    """Same result by a range join on the breakpoint dimension.

    The 36-row dimension is broadcast (size known by construction) and
    joined with an equi key on the pollutant plus ``lo < c <= hi`` as the
    residual, so the plan is a broadcast hash join, not a nested loop.  For
    c > 0 exactly one bin matches.  Rows without a bin keep a null index.
    """
    bp = F.broadcast(breakpoints_frame(df.sparkSession))
    c = F.col(conc)
    cond = (
        (F.col(pollutant) == bp.bp_pollutant)
        & (c > bp.bp_lo)
        & (bp.bp_hi.isNull() | (c <= bp.bp_hi))
    )
    joined = df.join(bp, cond, "left")
    sub = F.when(c > 0, (F.col("slope") * (c - F.col("bp_lo")) + F.col("aqi_lo")).cast("int"))
    return joined.withColumn("sub_index", sub).drop(*bp.columns)


def daily_concentrations(readings: DataFrame, keys: Sequence[str] = ("city", "date")) -> DataFrame:
    """Mean valid concentration per (entity, canonical pollutant)."""
    return station_mean(valid(normalise(readings)), list(keys))


def sub_indices(readings: DataFrame, keys: Sequence[str] = ("city", "date")) -> DataFrame:
    """(keys, pollutant, value, sub_index); sub_index is null for pollutants
    without breakpoints and for c <= 0."""
    return with_sub_index(daily_concentrations(readings, keys))


def overall(sub: DataFrame, keys: Sequence[str] = ("city", "date")) -> DataFrame:
    """Overall AQI = max sub-index per entity (50 when none), its category and
    the driving pollutant (highest sub-index, ties to the first in
    ``TIE_ORDER``).  ``max`` of a struct is a partial aggregate: no window,
    no sort of a whole group."""
    tie = X.lookup(F.col("pollutant"), TIE_ORDER, default=len(TIE_ORDER))
    best = F.max(
        F.when(F.col("sub_index").isNotNull(), F.struct(F.col("sub_index"), (-tie).alias("neg_order"), F.col("pollutant")))
    )
    agg = sub.groupBy(*keys).agg(
        F.max("sub_index").alias("_max"),
        best.alias("_best"),
        F.count("sub_index").alias("n_pollutants"),
    )
    aqi = F.coalesce(F.col("_max"), F.lit(K.AQI_WHEN_NO_POLLUTANT))
    return agg.select(
        *keys,
        aqi.alias("aqi"),
        X.aqi_category(aqi).alias("category"),
        F.col("_best.pollutant").alias("driving_pollutant"),
        F.col("_best.sub_index").alias("driving_sub_index"),
        "n_pollutants",
    )


def city_air_quality(readings: DataFrame, keys: Sequence[str] = ("city", "date")) -> DataFrame:
    """Daily AQI per city with category and driving pollutant."""
    return overall(sub_indices(readings, keys), keys)


def breakdown(wide: DataFrame, keys: Sequence[str] = ("city", "date")) -> DataFrame:
    """Long form of the AQI pollutants of a wide row: names and values are
    zipped by position (``arrays_zip`` + ``inline``), then each gets its
    sub-index, category, unit and a display text (one decimal + unit)."""
    names = list(K.AQI_BREAKPOINTS)
    zipped = F.arrays_zip(
        F.array(*[F.lit(p) for p in names]).alias("pollutant"),
        F.array(*[F.col(K.COLUMN_OF[p]).cast("double") for p in names]).alias("concentration"),
    )
    long = wide.select(*keys, F.inline(zipped))
    from aqlens.operators.weather import round1_half_even

    unit = X.pollutant_unit(F.col("pollutant"))
    return with_sub_index(long, "pollutant", "concentration").withColumns(
        {
            "unit": unit,
            "display": F.concat_ws(" ", round1_half_even(F.col("concentration")).cast("string"), unit),
        }
    ).withColumn("category", X.aqi_category(F.col("sub_index")))


def driving_wide(cols) -> "Column":
    """Wide form of the driving pollutant: the pollutant with the highest
    sub-index among ``cols`` ({name: concentration column}), ties to the
    first in ``TIE_ORDER``; null when no sub-index exists."""
    if all(isinstance(c, str) for c in cols.values()):
        cands = []
        for p, c in cols.items():
            if p in K.AQI_BREAKPOINTS:
                si = X.sub_index_sql(p, c)
                cands.append(f"CASE WHEN ({si}) IS NOT NULL THEN named_struct('s', {si}, 'o', {-TIE_ORDER.get(p, len(TIE_ORDER))}, 'p', '{p}') END")
        return F.expr(f"greatest({', '.join(cands)}).p")
    cands = [
        F.when(
            X.sub_index_for(p, c).isNotNull(),
            F.struct(X.sub_index_for(p, c).alias("s"), F.lit(-TIE_ORDER.get(p, len(TIE_ORDER))).alias("o"), F.lit(p).alias("p")),
        )
        for p, c in cols.items()
        if p in K.AQI_BREAKPOINTS
    ]
    return F.greatest(*cands)["p"]
