"""What queries move and store, in proportion to what they read."""

import glob
import os

import __spark_entry__ as entry
from evigrid.plans import documents

SF = "/root/testdata/sf0.01"


def test_rows_of_a_fit_are_not_shuffled_to_their_configuration(spark):
    # smaller than the planner's guess for the coefficients, larger than they are
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        plan = entry.queries()["trj15_fit_error"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_records_are_stored_compressed(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "records")
    monkeypatch.setattr(documents, "fresh", lambda spark: path)
    rows = entry.queries()["src1_run_records"](spark, SF).count()
    stored = sum(os.path.getsize(f) for f in glob.glob(f"{path}/part-*"))
    assert stored < 150 * rows
