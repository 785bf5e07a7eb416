"""Property checks on the derived tables and on random inputs."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from aqlens import constants as K
from aqlens.operators import aqi as A
from aqlens.operators import dashboard as D
from aqlens.operators import readings as R
from aqlens.plans import daily as Dy
from aqlens.sources import tables as T


@settings(max_examples=12, deadline=None)
@given(
    st.lists(st.floats(min_value=0, max_value=1000, allow_nan=False), min_size=1, max_size=60),
    st.integers(min_value=1, max_value=9),
    st.integers(min_value=1, max_value=4),
)
def test_fold_any_chunk_width(spark, values, chunk, gap):
    rows = [("g", "O3", v, i * gap) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "city string, pollutant string, value double, reading_id long")
    got = R.pair_fold(df, ["city"], chunk=chunk).first().value
    acc = values[0]
    for v in values[1:]:
        acc = (acc + v) / 2
    assert abs(got - acc) <= 1e-9 * max(1.0, abs(acc))


def test_overall_not_below_any_sub_index(spark, sf_small):
    sub = A.sub_indices(T.readings(spark, sf_small))
    overall = A.overall(sub)
    j = sub.join(overall, ["city", "date"])
    assert j.filter(F.col("sub_index") > F.col("aqi")).count() == 0
    assert overall.filter(F.col("driving_sub_index") != F.col("aqi")).count() == 0


def test_good_plus_bad_is_total(spark, sf_small):
    s = D.state_metrics(D.state_day_counts(T.readings(spark, sf_small)))
    assert s.filter(F.col("good_days") + F.col("bad_days") != F.col("total_days")).count() == 0
    y = D.yearly_metrics(T.yearly_counts(spark, sf_small))
    assert y.filter(F.col("total_good_days") + F.col("total_bad_days") != F.col("total_days")).count() == 0
    assert y.filter((F.col("good_pct") < 0) | (F.col("good_pct") > 100)).count() == 0


def test_daily_rows_complete(spark, sf_small):
    d = Dy.daily_rows(spark, sf_small)
    cond = None
    for c in K.POLLUTANT_COLUMNS + ["aqi"]:
        cond = F.col(c).isNull() if cond is None else cond | F.col(c).isNull()
    assert d.count() > 0 and d.filter(cond).count() == 0
    assert d.filter(F.col("pm10") < F.col("pm25")).count() == 0


def test_tiles_approx_close_to_exact(spark, sf_small):
    n = R.normalise(T.readings(spark, sf_small))
    exact, approx = D.tiles(n).first(), D.tiles(n, approx=True).first()
    assert exact.n_rows == approx.n_rows
    for c in ("n_stations", "n_states", "n_cities"):
        assert abs(exact[c] - approx[c]) <= max(1, 0.1 * exact[c])


def test_exact_mean_independent_of_partitioning(spark):
    import random

    from aqlens.functions import exprs as X

    rnd = random.Random(9)
    rows = [("g", round(rnd.uniform(0, 500), 2)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {
        n: df.repartition(n).groupBy("k").agg(X.exact_avg("v").alias("m")).first().m
        for n in (1, 7, 64)
    }
    assert len(set(got.values())) == 1
    exact = sum(round(v * 100) for _, v in rows) / 100 / len(rows)
    assert abs(got[1] - exact) < 1e-12
