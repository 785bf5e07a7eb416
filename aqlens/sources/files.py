"""File sources and sinks: CSV day-count tables, reading snapshots and daily
city tables; landed JSON reading pages; Parquet / JSON sinks.

Every reader takes an explicit schema or cleans and casts a header-typed
string table, so no inference pass runs over large inputs.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aqlens import constants as K
from aqlens.functions import exprs as X
from aqlens.sources import pages as P
from aqlens.sources.pages import READING_FIELDS, RECORD_SCHEMA

READING_CSV_SCHEMA = T.StructType([T.StructField(f, T.StringType()) for f in READING_FIELDS])

STATE_SCHEMA = T.StructType(
    [
        T.StructField("state", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("good_days", T.IntegerType()),
        T.StructField("bad_days", T.IntegerType()),
    ]
)

CITY_DAY_SCHEMA = T.StructType(
    [T.StructField("City", T.StringType()), T.StructField("Date", T.StringType())]
    + [T.StructField(p, T.DoubleType()) for p in K.POLLUTANT_NAMES]
    + [T.StructField("AQI", T.DoubleType())]
)


def clean_header(df: DataFrame) -> DataFrame:
    """Strip blanks and zero-width characters from every column name."""
    return df.toDF(*[X.clean_name(c) for c in df.columns])


def read_yearly_csv(spark: SparkSession, path: str) -> DataFrame:
    """Yearly good/bad day counts (wide); count columns are picked by the
    substrings 'Good Days' / 'Bad Days' and cast to int (bad text -> null)."""
    df = clean_header(spark.read.option("header", True).option("inferSchema", False).csv(path))
    counts = [c for c in df.columns if "Good Days" in c or "Bad Days" in c]
    return df.withColumns({c: F.col(f"`{c}`").try_cast("int") for c in counts})


def read_state_csv(spark: SparkSession, path: str) -> DataFrame:
    """State/city counts for one year; 'NA' is null."""
    return spark.read.schema(STATE_SCHEMA).option("header", True).option("nullValue", "NA").csv(path)


def read_readings_csv(spark: SparkSession, path: str) -> DataFrame:
    """A snapshot of live readings (all text), header cleaned, numbered in
    file order (``reading_id``) where the snapshot has no such column."""
    df = clean_header(spark.read.option("header", True).option("inferSchema", False).csv(path))
    if "reading_id" in df.columns:
        return df
    place = [F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block")]
    return P.numbered(df.select("*", *place), "reading_id", ["_path", "_block"], "snapshot").drop("_path", "_block")


def read_city_day_csv(spark: SparkSession, path: str, drop_incomplete: bool = True) -> DataFrame:
    """Daily city pollutant table with internal column names; rows with any
    missing value dropped; ``date`` parsed."""
    df = spark.read.schema(CITY_DAY_SCHEMA).option("header", True).csv(path)
    df = df.select(
        F.col("City").alias("city"),
        F.col("Date").try_cast("date").alias("date"),  # bad text -> null -> dropped below
        *[F.col(f"`{p}`").alias(K.COLUMN_OF[p]) for p in K.POLLUTANT_NAMES],
        F.col("AQI").alias("aqi"),
    )
    return df.dropna("any") if drop_incomplete else df


def _missing(e: AnalysisException) -> bool:
    return "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e)


def read_required(spark: SparkSession, path: str, fmt: str = "csv", **options) -> DataFrame:
    """Read a table that must exist; a missing path raises FileNotFoundError
    with a message instead of an analysis error deep in a plan."""
    try:
        return spark.read.format(fmt).options(**options).load(path)
    except AnalysisException as e:
        if _missing(e):
            raise FileNotFoundError(f"{path} not found: run the step that produces it first") from e
        raise


def state_key(state: str) -> str:
    """Folder key of a state: spaces become '_' (as the source's filter)."""
    return state.replace(" ", "_")


def page_lines(spark: SparkSession, path: str, state: str | None = None) -> DataFrame:
    """Lines of landed page files; for pages landed by state (``state_key=``
    folders) a state filter prunes whole folders before any file is opened."""
    lines = P.read_lines(spark.read, path)
    if state is not None and "state_key" in lines.columns:
        lines = lines.filter(F.col("state_key") == state_key(state))
    return lines


def read_pages(
    spark: SparkSession,
    path: str,
    limit: int | None = None,
    state: str | None = None,
    city: str | None = None,
    number: bool = False,
) -> DataFrame:
    """Landed reading pages ``{total, records: [...]}`` in any JSON layout (one
    a line, printed over lines, arrays; see ``aqlens.sources.pages``): records
    of all pages are concatenated (bag union, no dedupe) and optionally cut to
    ``limit`` records in a stable order.  What can't be read is listed by
    ``read_page_rejects``.

    Live records carry no arrival id: with ``number`` those without one are
    numbered by file path and position (pages printed over lines behind the
    others of their file), which the order-dependent operators and the cut to
    ``limit`` need."""
    rows = P.records(page_lines(spark, path, state))
    if number:
        rows = P.numbered(rows, "_number", ["path", "block", "kind"], "pages")
        rows = rows.withColumn("r", F.col("r").withField("reading_id", F.coalesce("r.reading_id", "_number")))
    recs = rows.select("r.*")
    if state is not None:
        recs = recs.filter(F.col("state") == state)
    if city is not None:
        recs = recs.filter(F.col("city") == city)
    if limit is not None:
        recs = recs.orderBy("reading_id").limit(limit)
    return recs


def read_page_rejects(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, reason, text) of what the files of ``path`` hold that
    isn't a readable page."""
    return P.rejects(page_lines(spark, path))


def empty_readings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], RECORD_SCHEMA)


def load_readings(spark: SparkSession, pages_path: str | None, csv_path: str | None) -> DataFrame:
    """Fallback chain: landed pages, else the CSV snapshot, else empty.  A
    source counts as absent when its path does not exist or it holds no
    record (``isEmpty`` reads at most one row)."""
    if pages_path:
        try:
            pages = read_pages(spark, pages_path, number=True)
            if not pages.isEmpty():
                return pages
        except AnalysisException as e:
            if not _missing(e):
                raise
    if csv_path:
        try:
            return read_readings_csv(spark, csv_path)
        except AnalysisException as e:
            if not _missing(e):
                raise
    return empty_readings(spark)


def write_pages(
    readings: DataFrame, path: str, page_size: int = 1000, by_state: bool = False, with_ids: bool = True
) -> None:
    """Land readings as JSON pages of ``page_size`` records (by reading id),
    optionally in one folder per state key.  Files and the pages within them
    follow the reading id; without ``with_ids`` the records, like those of the
    live feed, carry none.

    A page groups at most ``page_size`` ids, so the grouped list is bounded."""
    total = readings.count()
    page = F.floor(F.col("reading_id") / F.lit(page_size))
    names = [f.name for f in RECORD_SCHEMA.fields if f.name in readings.columns and (with_ids or f.name != "reading_id")]
    rec = F.struct("reading_id", F.struct(*names).alias("rec"))
    keys = [page.alias("page")]
    if by_state:
        keys.append(F.regexp_replace(F.col("state"), " ", "_").alias("state_key"))
    pages = readings.groupBy(*keys).agg(F.array_sort(F.collect_list(rec)).alias("records"))
    # by state first: else every task would write a file for every state
    pages = pages.withColumn("records", F.col("records.rec")).orderBy(*(["state_key"] if by_state else []), "page")
    out = pages.select(F.lit(total).cast("long").alias("total"), "records", *(["state_key"] if by_state else []))
    w = out.write.mode("overwrite")
    (w.partitionBy("state_key") if by_state else w).json(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, fmt: str = "parquet") -> None:
    """Sink: Parquet (default) or CSV, partitioned when asked."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def write_session_log(summary: DataFrame, path: str) -> None:
    """Session summaries as JSON, partitioned by the day the session ended."""
    out = summary.withColumn("date", F.to_date("end_time"))
    out.write.mode("overwrite").partitionBy("date").json(path)


def landed_weather_schema(key: str = "date") -> T.StructType:
    """Landed weather document: the request key (city and date, or city and
    forecast key) next to the response's ``daily`` and ``current`` parts."""
    from aqlens.operators.weather import DAILY_SCHEMA

    return T.StructType(
        [T.StructField("city", T.StringType()), T.StructField(key, T.StringType())] + list(DAILY_SCHEMA.fields)
    )


def write_weather_docs(docs: DataFrame, path: str, key: str = "date", payload: str = "payload") -> None:
    """Land weather documents (city, key, JSON payload) as JSON lines."""
    from aqlens.operators.weather import DAILY_SCHEMA

    d = F.from_json(F.col(payload), DAILY_SCHEMA)
    docs.select("city", F.col(key).cast("string").alias(key), d["daily"].alias("daily"), d["current"].alias("current")).write.mode(
        "overwrite"
    ).json(path)


def read_weather_docs(spark: SparkSession, path: str, key: str = "date") -> DataFrame:
    """Landed weather documents with their key parsed as a date and the time
    their file landed."""
    df = spark.read.schema(landed_weather_schema(key)).json(path)
    df = df.withColumn("landed_at", F.col("_metadata.file_modification_time"))
    return df.withColumn(key, F.col(key).try_cast("date"))
