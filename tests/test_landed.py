"""Pages in any layout, arrival numbers, pruned stream look-ups, mergeable
tiles, published versions, pruned forests, saved live models."""

import json
import os
import re

import pytest
from pyspark.sql import functions as F

from aqlens.functions import exprs as X
from aqlens.operators import ordering as Or
from aqlens.operators import quality as Q
from aqlens.operators import readings as R
from aqlens.plans import jobs as J
from aqlens.plans import models as M
from aqlens.plans import training as Tr
from aqlens.session import scratch_path
from aqlens.sources import files as Fs
from aqlens.sources import pages as P
from aqlens.sources import tables as T
from aqlens.sources import versions as V
from aqlens.streaming import ingest as Sx


def rec(i, **more):
    return {"state": "S", "city": "C", "station": f"s{i}", "pollutant_id": "NO2", "last_update": "10-01-2024 10:00:00", "avg_value": str(i), **more}


def page(*ids):
    return {"total": 9, "records": [rec(i) for i in ids]}


@pytest.fixture
def mixed(tmp_path):
    files = {
        "a": json.dumps(page(1, 2)) + "\n" + json.dumps(page(3)) + "\n",
        "b": json.dumps(page(4, 5), indent=2),
        "c": json.dumps(page(6), indent=0) + "\n" + json.dumps(page(7), indent=2) + "\n",
        "d": json.dumps(page(8), indent=2)[:-40],
        "e": json.dumps(page(9)) + "\n" + json.dumps(page(10))[:-30] + "\n" + json.dumps(page(11)) + "\n",
        "f": "[\n" + json.dumps(page(12)) + ",\n" + json.dumps(page(13)) + "\n]\n",
        "g": json.dumps(page(14)) + json.dumps(page(15)),
        "h": json.dumps([page(16), page(17)], indent=1),
        "i": json.dumps({"error": "quota"}) + "\n",
        "j": json.dumps(page(18), indent=2)[:-40] + "\n" + json.dumps(page(19), indent=2),
        "k": json.dumps({"total": "x", "records": [rec(20, reading_id="none", avg_value=1.5), rec(21, avg_value=None)]}),
        "l": "\n  \n",
        "m": json.dumps([page(22), page(23)]) + "\n",
        "n": json.dumps({"total": 1, "records": "none"}) + "\n",
        "o": "<html>busy</html>\n",
    }
    folder = tmp_path / "mixed"
    folder.mkdir()
    for name, text in files.items():
        (folder / f"{name}.json").write_text(text)
    return str(folder)


GOOD = [i for i in range(1, 24) if i not in (8, 10, 18)]


def test_every_good_record_of_any_layout(spark, mixed):
    assert sorted(int(r.station[1:]) for r in Fs.read_pages(spark, mixed).collect()) == GOOD
    numbered = Fs.read_pages(spark, mixed, number=True).orderBy("reading_id").collect()
    # by file; within a file pages over many lines come after the others
    assert [int(r.station[1:]) for r in numbered] == GOOD
    assert [r.reading_id for r in numbered] == list(range(len(GOOD)))
    assert {r.station: r.avg_value for r in numbered}["s20"] == "1.5"


def test_rejects_are_listed(spark, mixed):
    rows = Fs.read_page_rejects(spark, mixed).collect()
    got = sorted((os.path.basename(r.path)[0], r.reason) for r in rows)
    assert got == [("d", "malformed"), ("e", "malformed"), ("i", "no records"), ("j", "malformed"), ("n", "no records"), ("o", "malformed")]
    texts = {os.path.basename(r.path)[0]: r.text for r in rows}
    assert texts["e"] == json.dumps(page(10))[:-30] and texts["j"].startswith("{") and "s19" not in texts["j"]


def test_a_large_file_rejects_its_broken_lines(spark, mixed, monkeypatch):
    monkeypatch.setattr(P, "DOCUMENT_BYTES", 10)
    assert {int(r.station[1:]) for r in Fs.read_pages(spark, mixed).collect()} == {1, 2, 3, 9, 11, 12, 13, 14, 15, 20, 21, 22, 23}
    reasons = {r.reason for r in Fs.read_page_rejects(spark, mixed).collect()}
    assert reasons == {"broken line of a large file", "no records"}


def test_records_are_numbered_without_a_sort(spark, mixed):
    plan = Fs.read_pages(spark, mixed, number=True)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan.lower()
    # three parses in each of the two branches: the text, its parts, their parts
    plan = Fs.read_pages(spark, mixed)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning") == 0 and plan.count("from_json") <= 2 * 3


def test_csv_rows_are_numbered_in_file_order(spark, tmp_path):
    for k in range(3):
        lines = [f"S,C,x{100 * k + i},NO2" for i in range(100)]
        (tmp_path / f"{k}.csv").write_text("state,city,station,pollutant_id\n" + "\n".join(lines) + "\n")
    rows = Fs.read_readings_csv(spark, str(tmp_path)).orderBy("reading_id").collect()
    assert [r.station for r in rows] == [f"x{i}" for i in range(300)] and [r.reading_id for r in rows] == list(range(300))


def test_running_total(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"), (F.col("id") % 5).alias("v")).repartition(7)
    rows = Or.running_total(df, ["k"], "v", "before").orderBy("k").collect()
    total = 0
    for r in rows:
        assert r.before == total
        total += r.v
    none = spark.createDataFrame([], "k long, v long")
    assert Or.running_total(none, ["k"], "v", "before").collect() == []


def test_only_the_dates_of_a_batch_are_read(spark):
    sink = scratch_path(spark, "test-sink")
    days = [f"{d:02d}-01-2024 10:00:00" for d in range(1, 21)] + ["no time"]
    all_ = Sx.timed(spark.createDataFrame([("s", "NO2", d) for d in days], "station string, pollutant_id string, last_update string"))
    assert len(Sx.land_new(all_, sink)) == 21
    batch = all_.filter(F.col("last_update").isin(days[4], days[20])).unionByName(all_.limit(1).withColumn("station", F.lit("new")))
    batch = batch.withColumn("date", F.to_date("event_time"))
    dates = Sx.batch_dates(batch)
    fresh = Sx.unseen(batch, Sx.landed(spark, sink), dates)
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    filters = re.search(r"PartitionFilters: \[([^\]]*)\]", plan).group(1)
    assert "date" in filters and "isnull" in filters
    assert [r.station for r in fresh.collect()] == ["new"]
    files = Sx.landed(spark, sink).filter(Sx.on_dates(dates)).select(F.input_file_name().alias("f")).distinct().count()
    assert files == 3
    # many dates: first to last, and the result stays exact
    Sx_max, Sx.MAX_DATES = Sx.MAX_DATES, 1
    try:
        dates = Sx.batch_dates(batch)
        assert [r.station for r in Sx.unseen(batch, Sx.landed(spark, sink), dates).collect()] == ["new"]
    finally:
        Sx.MAX_DATES = Sx_max


def test_tiles_state_only_touched_dates(spark, tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    root = scratch_path(spark, "test-states")

    def run(name, *records):
        (land / f"{name}.json").write_text(json.dumps({"total": 0, "records": list(records)}) + "\n")
        Sx.run_tiles(Sx.page_stream(spark, str(land)), f"{root}/o", f"{root}/t", f"{root}/c", f"{root}/r")
        return Sx.latest_tiles(spark, f"{root}/t").first()

    t = run("a", rec(1), rec(2, last_update="11-01-2024 10:00:00"), rec(3, last_update="bad"))
    assert (t.n_rows, t.n_stations, t.n_cities, t.mean_aqi, t.max_aqi) == (3, 3, 1, 2.0, 3.0)
    t = run("b", rec(2, last_update="11-01-2024 12:00:00", city="D"), rec(1))
    assert (t.n_rows, t.n_stations, t.n_cities, t.mean_aqi, str(t.latest_update)) == (4, 3, 2, 2.0, "2024-01-11 12:00:00")
    states = spark.read.parquet(f"{root}/t/days")
    assert states.filter("batch = 0").count() == 3 and states.filter("batch = 1").count() == 2
    near = Sx.latest_tiles(spark, f"{root}/t", approx=True).first()
    assert (near.n_rows, near.n_stations, near.n_cities, near.n_states) == (4, 3, 2, 1)
    (land / "c.json").write_text("{broken\n")
    run("d", rec(9))
    assert [r.text for r in spark.read.parquet(f"{root}/r").collect()] == ["{broken"]
    # folders that nothing reads any more go
    for k in range(Sx.KEEP_BATCHES + 1):
        t = run(f"e{k}", rec(100 + k))
    kept = {r.batch for r in spark.read.parquet(f"{root}/t/days").select("batch").distinct().collect()}
    assert 1 in kept and 0 in kept and 2 not in kept and t.n_rows == 5 + Sx.KEEP_BATCHES + 1


def test_a_failed_write_leaves_the_last_version(spark):
    root = scratch_path(spark, "test-versions")
    with pytest.raises(FileNotFoundError, match="run the step"):
        V.read_table(spark, root)
    V.publish_table(spark.range(3), root)

    def dies(folder):
        spark.range(5).write.parquet(f"{folder}/table")
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        V.publish(spark, root, dies)
    assert V.read_table(spark, root).count() == 3
    V.publish_table(spark.range(7), root)
    V.publish_table(spark.range(8), root)
    assert V.read_table(spark, root).count() == 8
    assert [done for _, done in V.versions(spark, root)] == [True, True]


def test_profile_rides_on_the_write(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None), (None, None)], "a double, b double")
    out, p = Q.profiled(df, lambda d: V.publish_table(d, scratch_path(spark, "test-profile")), ["a", "b"], ["a", "b"])
    assert out.count() == 3 and (p.rows, p.values, p.means) == (3, {"a": 2, "b": 0}, {"a": 2.0, "b": None})
    assert p.nulls(["a", "b"]) == {"a": 1, "b": 3}
    with pytest.raises(M.TrainingError):
        M.guard(p, "b", ["a"])
    with pytest.raises(M.TrainingError):
        M.guard(p, "a", ["a"])


def _nodes(spark, model):
    path = scratch_path(spark, "test-forest")
    model.write().save(path)
    return {(r.treeID, r.nodeData.id): r.nodeData for r in spark.read.parquet(f"{path}/data").collect()}


@pytest.mark.parametrize("kind", ["regression", "classification"])
def test_no_split_below_the_minimum(spark, kind):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    df = spark.range(200).select((F.rand(1) * 10).alias("a"), (F.rand(2) * 10).alias("b"))
    df = df.withColumn("y", F.floor(F.col("a") * F.col("b") / 20).cast("double"))
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df).cache()
    forest = RandomForestRegressor if kind == "regression" else RandomForestClassifier
    grown = forest(labelCol="y", numTrees=4, maxDepth=12, minInstancesPerNode=1, seed=5).fit(df)
    cut = M.pruned(spark, grown, 7)
    before, after = _nodes(spark, grown), _nodes(spark, cut)
    assert any(n.leftChild >= 0 and n.rawCount < 7 for n in before.values())
    assert all(n.rawCount >= 7 for n in after.values() if n.leftChild >= 0)
    assert cut.totalNumNodes < grown.totalNumNodes and cut.getNumTrees == 4

    # the same walk down the grown trees, stopped at the first small node
    def walk(tree, features, nodes, stop):
        n = nodes[tree, 0]
        while n.leftChild >= 0 and n.rawCount >= stop:
            left = features[n.split.featureIndex] <= n.split.leftCategoriesOrThreshold[0]
            n = nodes[tree, n.leftChild if left else n.rightChild]
        return n

    for r in cut.transform(df).limit(40).collect():
        ends = [walk(t, r.features, before, 7) for t in range(4)]
        assert [walk(t, r.features, after, 0).prediction for t in range(4)] == [n.prediction for n in ends]
        if kind == "regression":
            assert abs(r.prediction - sum(n.prediction for n in ends) / 4) < 1e-9


def test_live_models_saved_and_applied(spark, sf_small):
    root = scratch_path(spark, "test-live")
    readings = T.readings(spark, sf_small)
    Fs.write_pages(readings, f"{root}/pages", page_size=250, with_ids=False)
    with pytest.raises(M.TrainingError):
        J.score_live(spark, f"{root}/pages", f"{root}/models", f"{root}/out")
    few = M.ForestSettings(trees=6, depth=30, min_leaf=1, min_split=2)
    m = J.train_live(spark, f"{root}/pages", f"{root}/models", few).first()
    assert m.reg_r2 > 0.8 and m.clf_acc > 0.8 and m.n > 0
    fit = M.load_live(spark, f"{root}/models")
    assert fit.features == Tr.LIVE_FEATURES and set(fit.tables) == set(Tr.LIVE_CODED)
    assert set(fit.categories) <= {"Good", "Satisfactory", "Moderate", "Poor", "Very Poor", "Severe"}
    out = J.score_live(spark, f"{root}/pages", f"{root}/models", f"{root}/out")
    rows = out.collect()
    assert len(rows) == readings.count() and all(r.predicted_aqi is not None for r in rows)
    right = sum(r.predicted_category == c for r, c in zip(rows, [r.c for r in out.select(X.aqi_category(F.col("value")).alias("c")).collect()]) if c)
    assert right > 0.8 * sum(r.value is not None for r in rows)
    # values that training never met
    new = R.normalise(spark.createDataFrame([{**rec(1), "pollutant_id": "XYZ", "state": "none", "reading_id": 1}]))
    assert Tr.live_score(fit, new, ["station"]).first().predicted_category in fit.categories


def test_retraining_without_a_table(spark):
    with pytest.raises(FileNotFoundError, match="run the step"):
        J.retrain(spark, scratch_path(spark, "absent"), scratch_path(spark, "out"))


TIMES = {
    "10-01-2024 10:00:00": "2024-01-10 10:00:00",
    "1/2/2024 11:00": "2024-02-01 11:00:00",
    "10-Jan-2024 10:00": "2024-01-10 10:00:00",
    "10-01-24 10:00": "2024-01-10 10:00:00",
    "10-Sept-99": "1999-09-10 00:00:00",
    "10-01-2024 02:30 PM": "2024-01-10 14:30:00",
    "10-01-2024 12:00 a.m.": "2024-01-10 00:00:00",
    "10.01.2024": "2024-01-10 00:00:00",
    "10.01.2024 10.05": "2024-01-10 10:05:00",
    "10 January 2024, 10:00": "2024-01-10 10:00:00",
    "2024-01-10T10:00:00Z": "2024-01-10 10:00:00",
    "2024-01-10T10:00:00+05:30": "2024-01-10 04:30:00",
    "10-01-2024 10:00 +0530": "2024-01-10 04:30:00",
    "2024-01-10 10:00:00.123456": "2024-01-10 10:00:00.123456",
    "31-02-2024": None,
    "10-Foo-2024": None,
    "10-01-2024 13:00 PM": None,
    "10-01-2024 10:00 +99:00": None,
    "1-1-5": None,
    "12:00": None,
    "no time": None,
    "": None,
}


def test_times_in_any_layout(spark):
    df = spark.createDataFrame([(t,) for t in TIMES], "t string")
    assert {r.t: r.p for r in df.select("t", X.parse_reading_time(F.col("t")).cast("string").alias("p")).collect()} == TIMES


def test_an_empty_version_is_published(spark):
    """The first version of ``published_table`` holds no row where no day is bad."""
    root = scratch_path(spark, "test-empty-version")
    df = spark.range(6).select("id", F.lit("x").alias("v"), (F.col("id") % 2).cast("int").alias("year"))
    assert V.publish_table(df.filter("id > 9"), root, ["year"]).count() == 0
    assert V.read_table(spark, root).dtypes == df.dtypes
    V.publish_table(df, root, ["year"])
    assert sorted(map(tuple, V.read_table(spark, root).collect())) == sorted(map(tuple, df.collect()))


def test_places_of_stations_are_read_from_sparse_vectors(spark, tmp_path):
    """An array with a place for each station would be rows times stations."""
    from aqlens.plans import landed as L

    rows = [(i, f"2024-01-01 00:00:{i:02d}", 7 * i, "click", 1.0) for i in range(30)] + [(30, None, 7, None, None)]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double")
    events.withColumn("ts", F.to_timestamp("ts")).write.parquet(f"{tmp_path}/events.parquet")
    for name in ("nation", "region"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    got = L.one_hot_vector(spark, str(tmp_path))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "array_position" not in plan
    places = {s: k for k, s in enumerate(sorted(str(7 * i) for i in range(30)))}
    assert {r.reading_id: (r.size, r.place) for r in got.collect()} == {r[0]: (30, places[str(r[2])]) for r in rows}


def test_a_batch_writes_one_file_a_date(spark):
    sink = scratch_path(spark, "test-few-files")
    rows = [(f"s{i}", "NO2", f"{i % 5 + 1:02d}-01-2024 10:00:00") for i in range(400)]
    conf = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "false")
    try:
        Sx.land_new(Sx.timed(spark.createDataFrame(rows, "station string, pollutant_id string, last_update string")), sink)
    finally:
        spark.conf.set(conf, before)
    landed = Sx.landed(spark, sink)
    assert landed.count() == 400 and landed.select(F.input_file_name()).distinct().count() == 5


def test_tiles_read_the_new_rows_of_a_batch_alone(spark, tmp_path, monkeypatch):
    land = tmp_path / "land"
    land.mkdir()
    root = scratch_path(spark, "test-own-rows")
    read = []
    normalise = R.normalise
    monkeypatch.setattr(R, "normalise", lambda rows: read.append(rows.count()) or normalise(rows))

    def run(name, *records):
        (land / f"{name}.json").write_text(json.dumps({"total": 0, "records": list(records)}) + "\n")
        Sx.run_tiles(Sx.page_stream(spark, str(land)), f"{root}/o", f"{root}/t", f"{root}/c")
        return Sx.latest_tiles(spark, f"{root}/t").first()

    run("a", rec(1), rec(2), rec(3), rec(4, last_update="bad"))
    t = run("b", rec(5, city="D"), rec(1), rec(6, last_update="11-01-2024 10:00:00"), rec(7, last_update="bad"))
    assert read == [4, 3]
    want = (7, 7, 2, 4.0, 7.0)
    assert (t.n_rows, t.n_stations, t.n_cities, t.mean_aqi, t.max_aqi) == want
    near = Sx.latest_tiles(spark, f"{root}/t", approx=True).first()
    assert (near.n_rows, near.n_stations, near.n_cities) == want[:3]
    # the last batch again, as after a failure behind its landing
    dates = [r.date for r in Sx.landed(spark, f"{root}/o").select("date").distinct().collect()]
    Sx.state_dates(spark, f"{root}/o", f"{root}/t", dates, 1)
    t = Sx.latest_tiles(spark, f"{root}/t").first()
    assert (t.n_rows, t.n_stations, t.n_cities, t.mean_aqi, t.max_aqi) == want


def test_landed_keys_are_compared_in_place(spark):
    """The keys of a batch go to the landed rows; those aren't shuffled."""
    sink = scratch_path(spark, "test-in-place")
    kind = "station string, pollutant_id string, last_update string"
    Sx.land_new(Sx.timed(spark.createDataFrame([("a", None, "10-01-2024 10:00:00"), ("b", "NO2", "bad")], kind)), sink)
    batch = Sx.timed(spark.createDataFrame([("a", None, "10-01-2024 10:00:00"), ("c", "NO2", "bad"), ("b", "NO2", "bad")], kind))
    batch = batch.withColumn("date", F.to_date("event_time"))
    fresh = Sx.unseen(batch, Sx.landed(spark, sink), Sx.batch_dates(batch))
    assert "LeftSemi" in fresh._jdf.queryExecution().optimizedPlan().toString()
    assert [r.station for r in fresh.collect()] == ["c"]


def test_live_pages_are_cleaned_once(spark, sf_small):
    from aqlens.plans import catalog

    out = catalog.live_feed_combined(spark, sf_small)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "last_update" not in plan and out.count() > 0


def test_files_of_printed_pages_stay_small(spark, sf_small, monkeypatch):
    """Lines of a larger file than a response aren't joined, and would be lost."""
    from aqlens.plans import landed as L

    monkeypatch.setattr(L, "PAGES_PER_FILE", 1, raising=False)
    path = scratch_path(spark, "test-mixed")
    L.land_mixed(spark, sf_small, path)
    pages = T.readings(spark, sf_small).select(F.floor(F.col("reading_id") / L.PAGE).alias("p")).distinct()
    for name, which in (("printed", F.col("p") % 3 == 1), ("broken", F.col("p") % 5 == 0), ("broken-printed", F.col("p") % 5 == 1)):
        files = spark.read.text(f"{path}/{name}").select(F.input_file_name()).distinct().count()
        assert files == pages.filter(which).count() > 0, name
    assert L.PAGES_PER_FILE == 1
