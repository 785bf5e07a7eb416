"""Ranks and running totals over a global order, without a global window: rows
are dealt by ranges of the order and written, each range adds up its own rows,
and what lies before a range is added from one number a range."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aqlens.session import written


def running_total(df: DataFrame, order: Sequence[str], value: str, out: str, name: str = "ordered") -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over all rows that come before
    in ``order`` (nulls first; rows that tie in it come in any one order).

    The ranges are written first, so that a recomputation after a lost executor
    can't draw other bounds."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = written(rows.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), name)
    parts = rows.groupBy("_part").agg(F.sum(value).alias("_sum"))
    # one row a range
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_carry"))
    within = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_own", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return rows.join(F.broadcast(parts), "_part").withColumn(out, F.col("_own") + F.col("_carry")).drop("_part", "_row", "_own", "_carry")


def rank(values: DataFrame, col: str, out: str, name: str = "ranked") -> DataFrame:
    """``values`` with ``out``: the 0-based place of each row in the order of ``col``."""
    return running_total(values.withColumn("_one", F.lit(1).cast("long")), [col], "_one", out, name).drop("_one")
