"""Session helpers: building a local session, the shared scratch folder and
size-checked broadcasting."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A dimension is broadcast only when its row count is proven to be at most this.
BROADCAST_MAX_ROWS = 200_000


def build_session(master: str | None = None, shuffle_partitions: int = 8, app: str = "aqlens") -> SparkSession:
    """Session for tests and local runs (the UI stays off)."""
    master = master or os.environ.get("AQLENS_MASTER", "local[8]")
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names a shared file system; it is read from the
    session.  Only when it is unset under a local master (tests) a folder is
    created here; on a cluster every node would write its own, so it must be set.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="aqlens-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint root."""
    return f"{checkpoint_root(spark).rstrip('/')}/aqlens/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared scratch folder and read it back: what
    follows survives lost executors without computing ``df`` again, and nothing
    stays in memory."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("errorifexists").parquet(path)
    # an empty table has no files to read the schema from
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_bounded(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, derived: bool = False) -> DataFrame:
    """Broadcast a dimension only behind a size check, with a shuffle join
    beyond it.

    * A dimension read from files is left unhinted: the planner sizes it from
      the scan statistics and broadcasts it only below
      ``spark.sql.autoBroadcastJoinThreshold``, else plans a sort-merge join.
    * A ``derived`` dimension (an aggregate of the data, whose estimate is
      not a bound) is written to the shared folder and counted there, and
      hinted only when within ``max_rows``.

    Frames built from the constants module have a known size and use
    ``F.broadcast`` directly.
    """
    if not derived:
        return df
    df = written(df, "dimension")
    return F.broadcast(df) if df.count() <= max_rows else df
