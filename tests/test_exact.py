"""Sums whose floating-point errors would decide a result."""

import datetime

import __spark_entry__ as entry
from evigrid.plans import bindings


def _store(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_a_mean_at_its_cap_passes_in_every_order(spark, tmp_path):
    # the mean of equal values is the value; as doubles some of these sums lie above it
    rows = [(n, 10.0, 0.0405) for n in range(1, 121) for _ in range(n)]
    _store(spark, tmp_path, "lineitem", rows, "l_suppkey bigint, l_quantity double, l_tax double")
    got = entry.queries()["inf22_budget_checks"](spark, str(tmp_path)).collect()
    assert {(r["l_suppkey"], r["state"]) for r in got} == {(n, "PASSED") for n in range(1, 121)}


def test_unusable_values_keep_the_plain_mean(spark, tmp_path):
    rows = [(1, 1.0, float("nan")), (1, 1.0, 0.01), (2, 1.0, 1e30), (3, 1.0, None)]
    _store(spark, tmp_path, "lineitem", rows, "l_suppkey bigint, l_quantity double, l_tax double")
    got = entry.queries()["inf22_budget_checks"](spark, str(tmp_path)).where("check = 'tax'").collect()
    assert {(r["l_suppkey"], repr(r["observed"]), r["passed"]) for r in got} == {(1, "nan", False), (2, "1e+30", False), (3, "None", False)}


def test_positions_keep_what_a_large_step_swallows(spark, tmp_path):
    # 7e-9 is less than half the last place of 1e8
    begin = datetime.datetime(2024, 1, 1)
    rows = [(i, begin + datetime.timedelta(seconds=i), 1, 1e8 if i == 0 else 7e-9, '{"k": 0}') for i in range(201)]
    _store(spark, tmp_path, "events", rows, "event_id bigint, ts timestamp, user_id bigint, value double, props string")
    got = bindings.points(spark, str(tmp_path)).orderBy("idx").collect()
    assert [r["x"] for r in got] == [1e8 if i * 7e-9 < 5e-7 else 100000000.000001 for i in range(201)]


def test_positions_of_values_that_are_no_decimals(spark, tmp_path):
    begin = datetime.datetime(2024, 1, 1)
    values = [1e30, 2.5, None, float("nan")]
    rows = [(i, begin + datetime.timedelta(seconds=i), 1, v, '{"k": 0}') for i, v in enumerate(values)]
    _store(spark, tmp_path, "events", rows, "event_id bigint, ts timestamp, user_id bigint, value double, props string")
    got = [r["x"] for r in bindings.points(spark, str(tmp_path)).orderBy("idx").collect()]
    assert got[:3] == [1e30] * 3 and got[3] != got[3]
