"""Incremental ingest of landed reading pages with Structured Streaming.

New page files are picked up by a file stream source, read as lines and parsed
as in batch (any JSON layout, with a list of rejects); of each (station,
pollutant, update time) the first record is kept.  A micro-batch is compared
with what has landed on the dates that it holds, and only their folders are
read, so a record is recognised however late it comes while the cost of a batch
follows its own rows.  A batch that is run again after a failure finds its own
rows landed and adds none twice.

Dashboard tiles are kept as partial states by date: counts, sums, maxima and
sketches, next to the distinct places of the date.  A batch adds its new rows
to the newest state of each date that it touched, and their places to those of
the batches before; the tiles merge the newest state of every date.  The new
rows of a batch are written before they land, so that a batch that is run again
states the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aqlens.functions import exprs as X
from aqlens.operators import readings as R
from aqlens.sources import pages as P

DEDUPE_KEYS = ["station", "pollutant_id", "last_update"]
# Dates of a batch that are named one by one in the filter on the sink; a batch
# of more is compared with all that lies between its first and last.
MAX_DATES = 400
# Rows of a batch up to which the hashes of their keys go to all tasks, which
# then pick the landed rows to compare with, so that what has landed is read in
# place and not shuffled.
BROADCAST_KEYS = 2_000_000
PLACE = ["state", "city", "station"]
# Superseded states of this many last batches stay, for readers still at them.
KEEP_BATCHES = 8


def page_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Lines of the page files landing under ``path``."""
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return P.read_lines(reader, path)


def timed(records: DataFrame) -> DataFrame:
    """Records with their parsed update time (null where it is bad)."""
    return records.withColumn("event_time", X.parse_reading_time(F.col("last_update")).cast("timestamp"))


def landed(spark: SparkSession, sink: str) -> DataFrame | None:
    """What a sink holds; None before its first write."""
    try:
        return spark.read.parquet(sink)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def written_whole(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` has ended."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def on_dates(dates: list) -> Column:
    """Filter on the date folders of a sink for the given dates (null among
    them is the folder of bad times)."""
    known = sorted(d for d in dates if d is not None)
    same = F.col("date").isin(*known) if len(known) <= MAX_DATES else F.col("date").between(known[0], known[-1])
    return (same | F.col("date").isNull()) if None in dates else same


def batch_dates(batch: DataFrame) -> list:
    """The dates of a batch; of more than MAX_DATES the first and last, and
    enough between them to say so."""
    dates = [r[0] for r in batch.select("date").distinct().limit(MAX_DATES + 2).collect()]
    if len(dates) > MAX_DATES + 1:
        ends = batch.agg(F.min("date"), F.max("date"), F.count_if(F.col("date").isNull())).first()
        dates = [*dates, ends[0], ends[1], *([None] if ends[2] else [])]
    return dates


def unseen(batch: DataFrame, known: DataFrame | None, dates: list) -> DataFrame:
    """Rows of ``batch`` whose key hasn't landed: an anti join with the keys in
    the folders of the batch's dates."""
    if known is None:
        return batch
    keys = [*DEDUPE_KEYS, "date"]
    known = known.filter(on_dates(dates)).select(*[F.col(k).alias(f"_{k}") for k in keys])
    if batch.count() <= BROADCAST_KEYS:
        hashes = batch.select(F.xxhash64(*keys).alias("_h"))
        known = known.join(F.broadcast(hashes), F.xxhash64(*[f"_{k}" for k in keys]) == F.col("_h"), "left_semi")
    return batch.join(known, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left_anti")


def land_new(batch: DataFrame, sink: str, fresh_path: str | None = None) -> list:
    """Append the records of a batch whose key has not landed, partitioned by
    date; records with a bad time share the null date.  Of a batch's repeats
    the one that arrived first stays.  Returns the dates of the batch.

    With ``fresh_path`` the records to append are written there first; when the
    batch is run again they are those, less what of them has landed.  A task
    writes whole dates, or a large part of one, not a file for each."""
    spark = batch.sparkSession
    order = [c for c in ("reading_id",) if c in batch.columns] + [c for c in batch.columns if c != "reading_id"]
    fresh = batch.groupBy(*DEDUPE_KEYS).agg(F.min(F.struct(*order)).alias("_r")).select(*[F.col(f"_r.{c}").alias(c) for c in batch.columns])
    fresh = fresh.withColumn("date", F.to_date("event_time")).persist()
    try:
        dates = batch_dates(fresh)
        if dates:
            new = unseen(fresh, landed(spark, sink), dates)
            if fresh_path and not written_whole(spark, fresh_path):
                new.write.mode("overwrite").parquet(fresh_path)
                new = spark.read.schema(fresh.schema).parquet(fresh_path)
            new.hint("rebalance", "date").write.mode("append").partitionBy("date").parquet(sink)
        return dates
    finally:
        fresh.unpersist()


def _run(
    lines: DataFrame, sink: str, checkpoint: str, rejects: str | None, then: Callable[[SparkSession, list, int], None], fresh: str | None = None
) -> None:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            dates = land_new(timed(P.records(batch).select("r.*")), sink, f"{fresh}/batch={batch_id}" if fresh else None)
            if rejects:
                # a batch that runs again replaces its own list
                P.rejects(batch).write.mode("overwrite").parquet(f"{rejects}/batch={batch_id}")
            then(batch.sparkSession, dates, batch_id)
        finally:
            batch.unpersist()

    q = lines.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    q.trigger(availableNow=True).start().awaitTermination()


def run_deduplicated(lines: DataFrame, sink: str, checkpoint: str, rejects: str | None = None) -> None:
    """Land everything available now, in one or more micro-batches; what can't
    be read goes to the folder ``rejects``."""
    _run(lines, sink, checkpoint, rejects, lambda spark, dates, batch_id: None)


def run_tiles(lines: DataFrame, sink: str, tiles: str, checkpoint: str, rejects: str | None = None) -> None:
    """Land new records in ``sink`` and keep the states of the dashboard tiles
    below ``tiles``."""

    def update(spark: SparkSession, dates: list, batch_id: int) -> None:
        if dates:
            state_dates(spark, sink, tiles, dates, batch_id)
            drop_superseded(spark, tiles)

    _run(lines, sink, checkpoint, rejects, update, f"{tiles}/fresh")


def state_dates(spark: SparkSession, sink: str, tiles: str, dates: list, batch_id: int) -> None:
    """State the given dates anew: the newest state of an earlier batch and the
    batch's own new rows, or where there is none, all that has landed.  The
    places come first: a date counts once its state is there, and then they
    are."""
    rows = landed(spark, sink)
    if rows is None:
        return
    before = landed(spark, f"{tiles}/days")
    if before is not None:
        before = before.filter(on_dates(dates) & (F.col("batch") < batch_id))
        stated = F.broadcast(before.select(F.col("date").alias("_stated")).distinct())  # one row a date
        known = F.col("date").eqNullSafe(F.col("_stated"))
        unstated = rows.filter(on_dates(dates)).join(stated, known, "left_anti")
        rows = unstated.unionByName(spark.read.schema(rows.schema).parquet(f"{tiles}/fresh/batch={batch_id}").join(stated, known, "left_semi"))
    else:
        rows = rows.filter(on_dates(dates))
    norm = R.normalise(rows.withColumn("_date", F.col("date")).drop("date", "event_time"))
    places = norm.groupBy("_date", *PLACE).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("value").alias("s"),
        F.count("value").alias("n_values"),
        F.max("value").alias("high"),
        F.max("datetime").alias("last"),
    )
    places = places.withColumnRenamed("_date", "date").persist()
    try:
        places.select("date", *PLACE).write.mode("overwrite").parquet(f"{tiles}/places/batch={batch_id}")
        sketches = [F.hll_sketch_agg(F.coalesce(F.col(c), F.lit("")), F.lit(12)).alias(f"sketch_{c}") for c in PLACE]
        counts = [
            F.sum("n").alias("n"),
            F.sum("s").alias("s"),
            F.sum("n_values").alias("n_values"),
            F.max("high").alias("high"),
            F.max("last").alias("last"),
        ]
        days = places.groupBy("date").agg(*counts, *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in PLACE], *sketches)
        if before is not None:
            newest = before.groupBy("date").agg(F.max("batch").alias("_newest")).withColumnRenamed("date", "_date")
            last = before.join(F.broadcast(newest), F.col("date").eqNullSafe(F.col("_date")) & (F.col("batch") == F.col("_newest")), "left_semi")
            merged = [*[F.sum(f"null_{c}").alias(f"null_{c}") for c in PLACE], *[F.hll_union_agg(f"sketch_{c}").alias(f"sketch_{c}") for c in PLACE]]
            days = days.unionByName(last.select(*days.columns)).groupBy("date").agg(*counts, *merged)
        days.write.mode("overwrite").parquet(f"{tiles}/days/batch={batch_id}")
    finally:
        places.unpersist()


def _newest(spark: SparkSession, tiles: str) -> DataFrame:
    """The newest state of every date: one short row a date."""
    return spark.read.parquet(f"{tiles}/days").groupBy("date").agg(F.max("batch").alias("newest"))


def _of_newest(spark: SparkSession, tiles: str, part: str, earlier: bool = False) -> DataFrame:
    """Rows of the newest state of every date, with ``earlier`` those of the
    batches before it too."""
    newest = _newest(spark, tiles).withColumnRenamed("date", "_date")
    rows = spark.read.parquet(f"{tiles}/{part}")
    upto = F.col("batch") <= F.col("newest") if earlier else F.col("batch") == F.col("newest")
    return rows.join(newest, F.col("date").eqNullSafe(F.col("_date")) & upto, "left_semi")


def latest_tiles(spark: SparkSession, tiles: str, approx: bool = False) -> DataFrame:
    """The tiles over all that has landed, merged from the states of the dates.
    Distinct counts are exact, from the places of each date, or with ``approx``
    from the sketches alone (about 1.6 % standard error)."""
    days = _of_newest(spark, tiles, "days")
    sums = [
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.try_divide(F.sum("s"), F.sum("n_values")).alias("mean_aqi"),
        F.max("high").alias("max_aqi"),
        F.max("last").alias("latest_update"),
    ]
    names = {"station": "n_stations", "state": "n_states", "city": "n_cities"}
    if approx:
        # the sketches hold nulls as the empty text
        seen = [F.hll_sketch_estimate(F.hll_union_agg(f"sketch_{c}")) - F.max((F.col(f"null_{c}") > 0).cast("long")) for c in names]
        out = days.agg(*sums, *[F.coalesce(e, F.lit(0)).alias(n) for e, n in zip(seen, names.values())])
    else:
        places = _of_newest(spark, tiles, "places", earlier=True).select(*PLACE).distinct()
        counts = places.agg(*[F.count_distinct(c).alias(n) for c, n in names.items()])
        out = days.agg(*sums).crossJoin(F.broadcast(counts))  # one row each
    return out.select("n_rows", *names.values(), "mean_aqi", "max_aqi", "latest_update")


def drop_superseded(spark: SparkSession, tiles: str) -> None:
    """Delete the states of batches whose dates were all stated again since, but
    for the last KEEP_BATCHES, and the new rows of all batches before the last."""
    states = spark.read.parquet(f"{tiles}/days").select("date", "batch").distinct()
    newest = states.groupBy("date").agg(F.max("batch").alias("batch")).select("batch").distinct()
    last = states.agg(F.max("batch")).first()[0]
    old = states.select("batch").distinct().filter(F.col("batch") <= last - KEEP_BATCHES)
    superseded = [f"days/batch={row[0]}" for row in old.join(newest, "batch", "left_anti").collect()]  # one row a folder
    conf = spark._jsc.hadoopConfiguration()
    path = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{tiles}/{name}")
    fs = path("fresh").getFileSystem(conf)
    if fs.exists(path("fresh")):
        superseded += [f"fresh/{f.getPath().getName()}" for f in fs.listStatus(path("fresh")) if f.getPath().getName() != f"batch={last}"]
    for name in superseded:
        fs.delete(path(name), True)
