"""The feed as it comes: other field names, no arrival ids, several time
layouts, values beyond the exact sum; constants pinned by literal values."""

import json

import pytest
from pyspark.sql import functions as F

from aqlens import constants as K
from aqlens import session
from aqlens.functions import exprs as X
from aqlens.operators import dashboard as D
from aqlens.operators import features as Fe
from aqlens.operators import readings as R
from aqlens.operators import weather as W
from aqlens.plans import models as M
from aqlens.sources import files as Fs


def rec(station, pollutant, when, **values):
    return {"state": "Uttar Pradesh", "city": "Agra", "station": station, "pollutant_id": pollutant, "last_update": when, **values}


@pytest.fixture
def pages(tmp_path):
    folder = tmp_path / "pages"
    folder.mkdir()
    first = [
        rec("s1", " PM2.5\u200b", "01-02-2024 10:00:00", avg_value="10", min_value="1", max_value="20"),
        rec("s1", "PM2.5", "1/2/2024 11:00", pollutant_avg="20"),
    ]
    second = [rec("s1", "pm2.5", "2024-02-01", avg_value="40"), rec("s1", "NO2", "01-02-2024", avg_value="NA", pollutant_avg="7")]
    for name, records in (("a", first), ("b", second)):
        (folder / f"{name}.json").write_text(json.dumps({"total": 4, "records": records}) + "\n")
    return str(folder)


def test_live_pages_keep_every_value(spark, pages):
    norm = R.normalise(Fs.read_pages(spark, pages, number=True)).cache()
    rows = norm.orderBy("reading_id").collect()
    assert [r.value for r in rows] == [10.0, 20.0, 40.0, None]
    assert [r.pollutant for r in rows] == ["PM2.5"] * 3 + ["NO2"]
    assert (rows[0].value_min, rows[0].value_max) == (1.0, 20.0)
    assert {str(r.date) for r in rows} == {"2024-02-01"}
    assert len({r.reading_id for r in rows}) == 4 and None not in {r.reading_id for r in rows}
    own = R.valid(norm)
    assert [r.value for r in R.first_value(own, ["station"]).collect()] == [10.0]
    assert [r.value for r in R.pair_fold(own, ["station"]).collect()] == [27.5]
    assert Fs.read_pages(spark, pages, limit=2, number=True).count() == 2


def test_state_filter_without_state_folders(spark, pages):
    assert Fs.read_pages(spark, pages, state="Uttar Pradesh").count() == 4
    assert Fs.read_pages(spark, pages, state="Goa").count() == 0


def test_csv_fallback_reaches_the_map(spark, tmp_path):
    path = tmp_path / "snapshot.csv"
    path.write_text("state,city,station,latitude,longitude,pollutant_id,pollutant_avg,last_update\nS,C,x,1.5,2.5,NO2,3,01-01-2024 10:00:00\nS,C,y,NA,2.5,NO2,4,01-01-2024 10:00:00\n")
    rows = D.map_points(R.normalise(Fs.load_readings(spark, str(tmp_path / "none"), str(path)))).collect()
    assert [(r.station, r.lat, r.value) for r in rows] == [("x", 1.5, 3.0)]


def test_a_huge_value_does_not_abort_the_mean(spark):
    df = spark.createDataFrame([("a", 1e30), ("a", 3e30), ("b", 0.1), ("b", 0.2)], "k string, v double")
    got = {r.k: r.m for r in df.groupBy("k").agg(X.exact_avg("v").alias("m")).collect()}
    assert got == {"a": 2e30, "b": 0.15}


def test_one_hot_names_stay_apart(spark):
    df = spark.createDataFrame([("PM2.5",), ("PM2_5",), (None,)], "p string")
    rows = Fe.one_hot(df, "p").collect()
    assert [tuple(r)[1:] for r in rows] == [(True, False), (False, True), (False, False)]
    many = spark.range(1500).select(F.col("id").cast("string").alias("p"))
    assert len(Fe.distinct_values(many, "p")) == 1500


def test_r2_with_a_large_offset(spark):
    df = spark.createDataFrame([(1e9 + i, 1e9 + i + (0.5 if i % 2 else -0.5)) for i in range(1000)], "y double, p double")
    want = 1 - 1000 * 0.25 / (1000 * (1000**2 - 1) / 12)
    assert abs(M.regression_metrics(df, "y", "p").first().r2 - want) < 1e-9


def test_forest_defaults_are_the_specified_ones():
    assert (M.FULL.trees, M.FULL.depth, M.FULL.min_leaf) == (100, 20, 2)
    assert M.fit_targets.__defaults__[0] is M.FULL


def test_known_cities(spark):
    df = spark.createDataFrame([("Agra",), ("Kanpur",), ("Nagpur",), ("Varanasi",), ("Delhi",), ("Atlantis",)], "city string")
    got = {r.city: (r.latitude, r.longitude) for r in W.with_city_lookup(df).collect()}
    assert len(K.CITY_COORDINATES) == 54
    assert got["Agra"] == (27.1767, 78.0081) and got["Kanpur"] == (26.4499, 80.3319)
    assert got["Nagpur"] == (21.1458, 79.0882) and got["Varanasi"] == (25.3176, 82.9739)
    assert got["Atlantis"] == got["Delhi"]


def test_no_local_scratch_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Cluster:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            @staticmethod
            def getCheckpointDir():
                return None

            @staticmethod
            def getConf():
                return Conf()

        conf = Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_root(Cluster())
