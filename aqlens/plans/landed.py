"""Registered queries over files landed from the driver tables in the shapes
that the application meets (broken and printed pages, CSV headers with stray
characters, missing counts, any time layout), and over operators whose result
doesn't need a trained model."""

from __future__ import annotations

from pyspark.sql import functions as F

from aqlens import constants as K
from aqlens.functions import exprs as X
from aqlens.operators import dashboard as D
from aqlens.operators import features as Fe
from aqlens.operators import quality as Q
from aqlens.operators import readings as R
from aqlens.operators import selection as Se
from aqlens.plans import catalog as C
from aqlens.plans import daily as Dy
from aqlens.plans import jobs as J
from aqlens.plans import models as M
from aqlens.plans import oracle as O
from aqlens.plans import training as Tr
from aqlens.plans.catalog import query
from aqlens.session import scratch_path, written
from aqlens.sources import files as Fs
from aqlens.sources import tables as T
from aqlens.sources import versions as V
from aqlens.streaming import ingest as Sx

PAGE = 250
# Pages over lines, or broken ones, in a file: a response is no larger than
# ``pages.DOCUMENT_BYTES``, above which such lines aren't joined.
PAGES_PER_FILE = 300


def land_mixed(spark, sf, path: str) -> None:
    """Every reading on one good page: a third of the pages one a line, a third
    printed over lines, a third in arrays; beside them broken copies."""
    record = F.struct("reading_id", F.struct("reading_id", *Fs.READING_FIELDS).alias("rec"))
    page = F.floor(F.col("reading_id") / PAGE)
    pages = written(T.readings(spark, sf).groupBy(page.alias("page")).agg(F.array_sort(F.collect_list(record)).alias("r")), "mixed-pages")
    doc = F.struct(F.lit(0).alias("total"), F.transform("r", lambda x: x["rec"]).alias("records"))
    line, printed = F.to_json(doc), F.to_json(doc, {"pretty": "true"})
    cut = lambda text: F.regexp_replace(F.substr(text, F.lit(1), F.length(text) - 40), r"[,\[:\s]+$", "")
    parts = {
        "lines": (F.col("page") % 3 == 0, line),
        "printed": (F.col("page") % 3 == 1, printed),
        "arrays": (F.col("page") % 3 == 2, F.concat(F.lit("["), line, F.lit("]"))),
        "broken": (F.col("page") % 5 == 0, cut(line)),
        "broken-printed": (F.col("page") % 5 == 1, cut(printed)),
    }
    for name, (which, text) in parts.items():
        most = 0 if name in ("lines", "arrays") else PAGES_PER_FILE  # 0: any number
        pages.filter(which).select(text.alias("text")).write.option("maxRecordsPerFile", most).text(f"{path}/{name}")


@query(
    "pages_any_layout",
    O.final(O.BASE, f"SELECT reading_id, state, city, station, pollutant, {O.rnd('value')} AS value FROM norm", dates=()),
)
def pages_any_layout(spark, sf):
    """One-line, printed, wrapped and broken pages: every good record arrives."""
    path = scratch_path(spark, "mixed")
    land_mixed(spark, sf, path)
    n = R.normalise(Fs.read_pages(spark, f"{path}/*"))
    return n.select("reading_id", "state", "city", "station", "pollutant", X.rnd(F.col("value")).alias("value"))


@query(
    "page_rejects",
    O.final(
        O.BASE,
        f"""SELECT 'malformed' AS reason, count(*) AS n
FROM (SELECT DISTINCT reading_id // {PAGE} AS page FROM readings) WHERE page % 5 IN (0, 1)""",
        dates=(),
    ),
)
def page_rejects(spark, sf):
    """What the broken pages of the same landing leave in the list of rejects."""
    path = scratch_path(spark, "mixed")
    land_mixed(spark, sf, path)
    return Fs.read_page_rejects(spark, f"{path}/*").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "stream_any_layout",
    O.final(O.BASE, "SELECT DISTINCT station, pollutant_id, last_update FROM readings", dates=()),
)
def stream_any_layout(spark, sf):
    """The mixed landing as a stream of several triggers."""
    root = scratch_path(spark, "mixed-stream")
    land_mixed(spark, sf, f"{root}/landing")
    lines = Sx.page_stream(spark, f"{root}/landing/*", files_per_trigger=4)
    Sx.run_deduplicated(lines, f"{root}/out", f"{root}/checkpoint", f"{root}/rejects")
    return spark.read.parquet(f"{root}/out").select(*Sx.DEDUPE_KEYS)


@query(
    "pages_limit",
    O.final(O.BASE, "SELECT station, pollutant_id, last_update FROM readings ORDER BY reading_id LIMIT 100", dates=()),
)
def pages_limit(spark, sf):
    """The first records by arrival of pages whose records carry no id."""
    path = scratch_path(spark, "cut")
    Fs.write_pages(T.readings(spark, sf), path, with_ids=False)
    return Fs.read_pages(spark, path, limit=100, number=True).select("station", "pollutant_id", "last_update")


# layout of the text -> (Spark pattern, what of the time the text holds)
LAYOUTS = [
    ("dd-MM-yyyy HH:mm:ss", "second"),
    ("d-MMM-yyyy HH:mm", "minute"),
    ("dd-MM-yy HH:mm", "minute"),
    ("dd/MM/yyyy hh:mm:ss a", "second"),
    ("dd.MM.yyyy", "day"),
    ("yyyy-MM-dd'T'HH:mm:ss'Z'", "second"),
    ("yyyy-MM-dd'T'HH:mm:ss'+05:30'", "zone"),
    ("d MMMM yyyy, HH:mm", "minute"),
    ("dd-MM-yyyy hh:mm a", "minute"),
    ("dd.MM.yyyy HH.mm", "minute"),
    ("'on' yyyy", "none"),
]
_HELD = O.case(f"reading_id % {len(LAYOUTS)}", {k: h for k, (_, h) in enumerate(LAYOUTS)})


@query(
    "reading_times",
    O.final(
        O.BASE,
        f"""SELECT reading_id, {O.fmt_ts('parsed')} AS parsed, parsed IS NULL AS rejected
FROM (SELECT reading_id, CASE held WHEN 'second' THEN date_trunc('second', datetime) WHEN 'minute' THEN date_trunc('minute', datetime)
        WHEN 'day' THEN date_trunc('day', datetime) WHEN 'zone' THEN date_trunc('second', datetime) - INTERVAL 330 MINUTE END AS parsed
      FROM (SELECT *, {_HELD} AS held FROM norm))""",
        dates=(),
    ),
)
def reading_times(spark, sf):
    """Update times in every day-first layout, with those that are no times."""
    r = T.readings(spark, sf)
    t = F.to_timestamp("last_update", T.READING_TS_FORMAT)
    text = F.lit(None).cast("string")
    for k, (pattern, _) in enumerate(LAYOUTS):
        text = F.when(F.pmod("reading_id", F.lit(len(LAYOUTS))) == k, F.date_format(t, pattern)).otherwise(text)
    n = R.normalise(r.withColumn("last_update", text))
    return n.select("reading_id", F.col("datetime").alias("parsed"), F.col("datetime").isNull().alias("rejected"))


_MEDIAN_COLS = ["value", "value_min", "value_max", "lat", "lon"]


@query(
    "reading_medians",
    O.final(
        O.BASE,
        "\nUNION ALL\n".join(f"SELECT {O.q(c)} AS \"column\", {O.rnd(f'median({c})')} AS median FROM norm" for c in _MEDIAN_COLS),
        dates=(),
    ),
)
def reading_medians(spark, sf):
    """Exact medians over all readings, a table that grows with the data."""
    found = Se.medians(R.normalise(T.readings(spark, sf)), _MEDIAN_COLS)
    # one row a column
    out = spark.createDataFrame(list(found.items()), "column string, median double")
    return out.select("column", X.rnd(F.col("median")).alias("median"))


@query(
    "reading_median_impute",
    O.final(
        O.BASE,
        f"SELECT reading_id, {O.rnd('coalesce(value, (SELECT median(value) FROM norm))')} AS value FROM norm",
        dates=(),
    ),
)
def reading_median_impute(spark, sf):
    n = R.normalise(T.readings(spark, sf)).select("reading_id", "value")
    return Fe.median_impute(n, ["value"]).select("reading_id", X.rnd(F.col("value")).alias("value"))


@query(
    "one_hot_vector",
    O.final(
        (*O.BASE, "ids AS (SELECT station AS s, row_number() OVER (ORDER BY station) - 1 AS place FROM (SELECT DISTINCT station FROM norm))"),
        "SELECT reading_id, (SELECT count(*) FROM ids) AS size, place FROM norm JOIN ids ON station = s",
        dates=(),
    ),
)
def one_hot_vector(spark, sf):
    """Stations as one sparse vector each: its size and the place of the one."""
    n = R.normalise(T.readings(spark, sf)).select("reading_id", "station")
    v = F.unwrap_udt("v")  # as it is: an array of all places would be as long as there are stations
    place = F.coalesce(F.get(v["indices"], F.lit(0)), F.lit(-1))
    return Fe.one_hot_vector(n, "station", "v").select("reading_id", v["size"].cast("long").alias("size"), place.cast("long").alias("place"))


@query(
    "yearly_csv",
    O.final(
        (O.GEO, C.YEARLY, C.YEARLY_M),
        f"""SELECT city, CAST(sum(total_good_days) AS BIGINT) AS total_good_days, CAST(sum(total_bad_days) AS BIGINT) AS total_bad_days,
       {O.rnd('avg(good_pct)')} AS good_pct FROM ym2 GROUP BY city""",
        dates=(),
    ),
)
def yearly_csv(spark, sf):
    """Yearly counts landed as CSV with stray characters in the header."""
    y = T.yearly_counts(spark, sf)
    names = ["Sl. No.", "State", "City Name"]
    names += [n for year in T.ORDER_YEARS for n in (f"​{year} - Good Days (AQI<=200) ", f"{year} - Bad Days (AQI>200)﻿")]
    path = scratch_path(spark, "yearly")
    Fs.write_table(y.toDF(*names), path, fmt="csv")
    good, bad = (lambda c: "Good Days" in c), (lambda c: "Bad Days" in c)
    m = D.yearly_metrics(Fs.read_yearly_csv(spark, path), good, bad)
    return m.groupBy(F.col("City Name").alias("city")).agg(
        F.sum("total_good_days").cast("bigint").alias("total_good_days"),
        F.sum("total_bad_days").cast("bigint").alias("total_bad_days"),
        X.rnd(F.avg("good_pct")).alias("good_pct"),
    )


_STATE_DAYS, _STATE_METRICS = C.STATE_M.split("sm AS (")
_UNKNOWN = "CASE WHEN good_days % 7 <> 0 THEN {0} END AS {0}"


@query(
    "state_csv",
    O.final(
        (
            *O.DAILY,
            _STATE_DAYS
            + f"sdn AS (SELECT state, city, {_UNKNOWN.format('good_days')}, {_UNKNOWN.format('bad_days')} FROM sdays),\nsm AS ("
            + _STATE_METRICS.replace("FROM sdays", "FROM sdn"),
        ),
        f"""SELECT state, city, good_days IS NULL AS missing, CAST(total_days AS INTEGER) AS total_days, {O.rnd('good_pct')} AS good_pct,
       {O.rnd('estimated_aqi')} AS estimated_aqi FROM sm""",
        dates=(),
    ),
)
def state_csv(spark, sf):
    """State counts landed as CSV, every seventh count missing as NA."""
    days = D.state_day_counts(T.readings(spark, sf))
    text = lambda c: F.when(F.col("good_days") % 7 == 0, F.lit("NA")).otherwise(F.col(c).cast("string"))
    path = scratch_path(spark, "states")
    Fs.write_table(days.select("state", "city", text("good_days").alias("good_days"), text("bad_days").alias("bad_days")), path, fmt="csv")
    m = D.state_metrics(Fs.read_state_csv(spark, path))
    return m.select(
        "state", "city", F.col("good_days").isNull().alias("missing"), F.col("total_days").cast("int").alias("total_days"),
        X.rnd(F.col("good_pct")).alias("good_pct"), X.rnd(F.col("estimated_aqi")).alias("estimated_aqi"),
    )


@query("published_table", O.final(O.daily_rows_ctes(), f"SELECT city, date, {O.rnd('pm25')} AS pm25, aqi FROM drows"))
def published_table(spark, sf):
    """The daily table published twice: readers see the last version alone."""
    path = scratch_path(spark, "published")
    d = Dy.daily_rows(spark, sf).withColumn("year", F.year("date"))
    V.publish_table(d.filter("aqi > 100"), path, ["year"])
    V.publish_table(d, path, ["year"])
    return V.read_table(spark, path).select("city", "date", X.rnd(F.col("pm25")).alias("pm25"), "aqi")


@query("session_log", C.ORACLE["session_summary"])
def session_log(spark, sf):
    """Session summaries written as JSON by day and read back."""
    s = J.session_log(spark, T.activity_log(spark, sf), scratch_path(spark, "sessions"))
    counts = [f"n_{k.lower()}" for k in K.EVENT_KINDS] + ["n_total", "n_error_records"]
    times = [F.date_format(F.to_timestamp(c), "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("start_time", "end_time")]
    return s.select("session_id", *[F.col(c).cast("long").alias(c) for c in counts], *times, X.rnd(F.col("duration_seconds")).alias("duration_seconds"))


_CHECKED = ["station", "value", "benzene"]


@query(
    "column_checks",
    O.final(
        O.BASE,
        "\nUNION ALL\n".join(
            f"SELECT {O.q(c)} AS \"column\", count({c}) = 0 AS all_null, count({c}) = count(*) AS complete FROM (SELECT *, NULL AS benzene FROM norm)"
            for c in _CHECKED
        ),
        dates=(),
    ),
)
def column_checks(spark, sf):
    """All-null test and null assertion of some columns."""
    n = R.normalise(T.readings(spark, sf)).withColumn("benzene", F.lit(None).cast("double"))
    empty = Q.all_null(n, _CHECKED)

    def complete(c: str) -> bool:
        try:
            Q.assert_no_nulls(n, [c])
        except AssertionError:
            return False
        return True

    return spark.createDataFrame([(c, empty[c], complete(c)) for c in _CHECKED], "column string, all_null boolean, complete boolean")


_PAIRS = {"aqi": ("CAST(aqi AS DOUBLE)", O.linear("pm25")), "pm10": ("pm10", "pm25 * 1.2"), "no2": ("no2", "pm25")}
_EACH = "\nUNION ALL\n".join(
    f"SELECT {O.q(t)} AS target, count(*) AS n, 1 - sum(({y} - {p}) * ({y} - {p})) / (var_pop({y}) * count(*)) AS r2, avg(abs({y} - {p})) AS mae FROM drows"
    for t, (y, p) in _PAIRS.items()
)


@query(
    "target_metrics",
    O.final(
        (*O.daily_rows_ctes(), f"m AS ({_EACH})"),
        f"""SELECT target, n, {O.rnd('r2', 4)} AS r2, {O.rnd('mae', 4)} AS mae FROM m
UNION ALL SELECT 'Overall', CAST(sum(n) AS BIGINT), {O.rnd('avg(r2)', 4)}, {O.rnd('avg(mae)', 4)} FROM m""",
        dates=(),
    ),
)
def target_metrics(spark, sf):
    """Metrics of several targets in one aggregation, and their macro mean."""
    d = Dy.daily_rows(spark, sf).withColumns({"aqi": F.col("aqi").cast("double"), "p_aqi": X.linear_estimate(F.col("pm25"))})
    d = d.withColumns({"p_pm10": F.col("pm25") * 1.2, "p_no2": F.col("pm25")})
    m = Tr.with_overall(M.target_metrics(d, [(t, t, f"p_{t}") for t in _PAIRS]))
    return m.select("target", F.col("n").cast("long").alias("n"), X.rnd(F.col("r2"), 4).alias("r2"), X.rnd(F.col("mae"), 4).alias("mae"))


@query(
    "mean_importance",
    O.final(
        (
            *O.BASE,
            "shares AS (SELECT station, pollutant, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY pollutant) AS importance FROM norm GROUP BY station, pollutant)",
        ),
        f"SELECT station AS feature, {O.rnd('avg(importance)')} AS avg_importance FROM shares GROUP BY station ORDER BY avg(importance) DESC, station LIMIT 10",
        dates=(),
    ),
)
def mean_importance(spark, sf):
    """Top 10 of a (feature, target, importance) table by mean importance: the
    stations' shares in the readings of each pollutant."""
    n = R.normalise(T.readings(spark, sf)).groupBy("station", "pollutant").agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("pollutant").agg(F.sum("n").alias("total"))
    table = n.join(total, "pollutant").select(F.col("station").alias("feature"), F.col("pollutant").alias("target"), (F.col("n") / F.col("total")).alias("importance"))
    return M.mean_importance(table).select("feature", X.rnd(F.col("avg_importance")).alias("avg_importance"))


_KNOWN = "known AS (SELECT city AS c, CAST(row_number() OVER (ORDER BY city) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT city FROM drows WHERE city < 'K'))"


@query(
    "scoring_codes",
    O.final(
        (*O.daily_rows_ctes(), _KNOWN),
        f"""SELECT city, date, coalesce(code, (SELECT code FROM known WHERE c = {O.q(K.DEFAULT_CITY)}), -1) AS city_encoded
FROM drows LEFT JOIN known ON city = c""",
    ),
)
def scoring_codes(spark, sf):
    """Codes at scoring come from the cities of training; others take the
    default city's."""
    d = Dy.daily_rows(spark, sf).select("city", "date")
    codes = Fe.code_dimension(d.filter("city < 'K'"), "city")
    return Fe.attach_scoring_codes(d, codes, "city").select("city", "date", "city_encoded")


@query(
    "reading_proxy",
    O.final(O.BASE, f"SELECT reading_id, station, {O.rnd('coalesce(value, 0)')} AS aqi FROM norm", dates=()),
)
def reading_proxy(spark, sf):
    """The columns that a reading has of those asked for, and its AQI proxy."""
    n = D.aqi_proxy(R.normalise(T.readings(spark, sf)))
    n = D.select_available(n, ["reading_id", "station", "aqi", "not_there"])
    return n.select("reading_id", "station", X.rnd(F.coalesce("aqi", F.lit(0.0))).alias("aqi"))
