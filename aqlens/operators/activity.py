"""Activity log: per-session summary and the latest entries per session."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aqlens import constants as K


def with_error_split(log: DataFrame) -> DataFrame:
    """Events carrying an ``error`` value are error records."""
    return log.withColumn("is_error", F.col("error").isNotNull())


def session_summary(log: DataFrame) -> DataFrame:
    """Per session: events per kind, total, error records, first/last time
    and duration in seconds.  All partial aggregates: a huge session costs
    the same as a small one."""
    kinds = [F.count_if(F.col("event_type") == k).alias(f"n_{k.lower()}") for k in K.EVENT_KINDS]
    agg = log.groupBy("session_id").agg(
        *kinds,
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(F.col("error").isNotNull()).alias("n_error_records"),
        F.min("timestamp").alias("start_time"),
        F.max("timestamp").alias("end_time"),
    )
    # Microsecond difference without any time-zone conversion.
    dur = F.timestamp_diff("MICROSECOND", F.col("start_time"), F.col("end_time")) / 1e6
    return agg.withColumn("duration_seconds", dur)


def last_n(log: DataFrame, n: int = K.LAST_N_PREDICTIONS, order: str = "timestamp", tie: str = "seq") -> DataFrame:
    """The latest ``n`` events per session.  ``row_number() <= n`` lets Spark
    insert a per-partition group limit before the shuffle, so at most n rows
    per session and partition travel."""
    w = Window.partitionBy("session_id").orderBy(F.col(order).desc(), F.col(tie).desc())
    return log.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
