"""Physical plan properties that matter at scale."""

import re

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def plan_of(spark, name):
    df = E.queries()[name](spark, SF)
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def test_state_filter_reaches_region_scan(spark):
    p = plan_of(spark, "filter_state_city")
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(r_name,ASIA\)", p)


def test_scans_read_only_needed_columns(spark):
    p = plan_of(spark, "national_tiles")
    events = [m for m in re.findall(r"ReadSchema: (struct<[^>]*>)", p) if "event_id" in m]
    assert events and all("props" not in m for m in events)


def test_last_five_limits_before_shuffle(spark):
    p = plan_of(spark, "last_five")
    assert p.count("WindowGroupLimit") >= 2  # partial (map side) and final


def test_no_python_no_nested_loops(spark):
    for name in ["city_air_quality", "aqi_sub_index_join", "pairwise_fold", "weather_date_match", "sanity_check", "session_summary"]:
        p = plan_of(spark, name)
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p, name
        assert "BroadcastNestedLoopJoin" not in p and "CartesianProduct" not in p, name


def test_weather_join_reuses_aggregate_partitioning(spark):
    p = plan_of(spark, "weather_join")
    # two aggregations on the pollutant side, one on the weather side; the join adds none
    assert len(re.findall(r"Exchange hashpartitioning", p)) <= 3
