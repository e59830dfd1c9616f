"""Readers and writers on small files."""

import gzip
import hashlib
import json
import threading
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from evigrid.sources import readers, sinks


def record(i):
    return {"run_id": f"r{i}", "arm_id": i, "metrics": {"m": 1.5}, "mechanism_gates": [{"statistic": "s", "value": 1.0, "passed": True}]}


def test_three_forms_of_records(spark, tmp_path):
    for i in (1, 2):
        folder = tmp_path / f"run{i}"
        folder.mkdir()
        (folder / "run_record.json").write_text(json.dumps(record(i), indent=1))
    (tmp_path / "list.json").write_text(json.dumps([record(3), record(4)], indent=1))
    (tmp_path / "wrapped.json").write_text(json.dumps({"records": [record(5)]}, indent=1))
    rows = readers.read_records(spark, str(tmp_path)).collect()
    assert sorted(r["run_id"] for r in rows) == ["r1", "r2", "r3", "r4", "r5"]
    assert all(r["metrics"]["m"] == 1.5 and r["mechanism_gates"][0]["passed"] for r in rows)


def test_predictions_keep_sample_order(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"predictions": [{"segment_id": "s", "target": [1, 2], "samples": [[9, 8], [7, 6], [5, 4]]}]}))
    raw = spark.read.schema(readers.PREDICTIONS).option("multiLine", True).json(str(tmp_path))
    rows = readers.explode_predictions(raw, []).orderBy("sample_idx").collect()
    assert [(r["sample_idx"], r["x"], r["y"], r["tx"]) for r in rows] == [(0, 9, 8, 1), (1, 7, 6, 1), (2, 5, 4, 1)]


def test_bundle(spark, tmp_path):
    cell = {"cell_hash": "h", "arm_id": "a", "block_id": "b", "seed": 1, "status": "SUCCEEDED", "metrics": {"error": 2.0}}
    bundle = {"study_id": "s", "expected_cells": [{"cell_hash": "h", "arm_id": "a", "block_id": "b", "seed": 1}], "cells": [cell]}
    (tmp_path / "b.json").write_text(json.dumps(bundle, indent=1))
    header, expected, cells = readers.read_bundle(spark, str(tmp_path / "b.json"))
    assert header.first()["study_id"] == "s" and expected.count() == 1 and cells.first()["metrics"] == {"error": 2.0}


@pytest.mark.parametrize("text,parsed", [('{"a": 1}', True), ('{"a": 1, "a": 2}', False), ('{"a": NaN}', False)])
def test_pinned_document(spark, tmp_path, text, parsed):
    path = tmp_path / "d.json"
    path.write_text(text)
    sha = hashlib.sha256(text.encode()).hexdigest()
    row = readers.read_pinned(spark, str(path), 1000, sha).select("pinned", F.col("document").isNotNull().alias("ok")).first()
    assert row["pinned"] and row["ok"] == parsed
    assert readers.read_pinned(spark, str(path), 1000, "0" * 64).select("pinned").first()["pinned"] is False
    assert readers.read_pinned(spark, str(path), 3).first()["state"] == "oversized"


def test_sharded_scan_refuses_bad_entries(spark, tmp_path):
    entries = []
    for name in ("a", "b", "c"):
        content = json.dumps([{"v": f"{name}{i}"} for i in range(2)])
        (tmp_path / f"{name}.json").write_text(content)
        entries.append((f"{name}.json", hashlib.sha256(content.encode()).hexdigest()))
    entries[1] = ("b.json", "0" * 64)
    entries += [entries[2], ("../x.json", "1"), ("gone.json", "2")]
    index = spark.createDataFrame(entries, "path string, sha256 string")
    rows, refused = readers.read_sharded(spark, str(tmp_path), index, "v string")
    assert sorted(r["v"] for r in rows.collect()) == ["a0", "a1"]
    assert dict(refused.collect()) == {"b.json": "changed", "c.json": "duplicate", "../x.json": "escapes_root", "gone.json": "absent"}


def test_compressed_rows_and_contract(spark, tmp_path):
    with gzip.open(tmp_path / "export.json.gz", "wt") as out:
        out.write("\n".join(json.dumps({"status": s}) for s in ("success", "success", "failed")))
    df = readers.read_compressed(spark, str(tmp_path), "status string")
    assert readers.row_contract(df, 3).first()["kept"] and not readers.row_contract(df, 4).first()["kept"]


def test_test_report(spark, tmp_path):
    (tmp_path / "r.xml").write_text(
        '<testsuites><testsuite><testcase classname="c" name="a"/><testcase classname="c" name="b"><failure message="m">x</failure></testcase>'
        '<testcase classname="c" name="d"><skipped message="s"/></testcase></testsuite></testsuites>'
    )
    assert dict(readers.read_test_report(spark, str(tmp_path / "r.xml")).collect()) == {"c::a": "passed", "c::b": "failure", "c::d": "skipped"}


def test_package_is_written_once(spark, tmp_path):
    path = str(tmp_path / "package")
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, v string")
    assert sinks.write_package(rows, path) and not sinks.write_package(rows.orderBy(F.desc("k")), path)
    with pytest.raises(ValueError):
        sinks.write_package(rows.distinct(), path)


def test_package_content_is_names_types_and_rows(spark, tmp_path):
    path = str(tmp_path / "package")
    empty = spark.createDataFrame([], "k int, v string")
    assert sinks.package_record(spark, path) is None
    with pytest.raises(ValueError):
        sinks.read_package(spark, path)
    assert sinks.write_package(empty, path) and not sinks.write_package(empty.select("v", "k"), path)
    assert sinks.read_package(spark, path).count() == 0
    for other in (spark.createDataFrame([], "k bigint, v string"), spark.createDataFrame([(None, None)], "k int, v string")):
        with pytest.raises(ValueError):
            sinks.write_package(other, path)


@pytest.mark.parametrize("same", [True, False])
def test_one_of_two_writers_at_once_wins(spark, tmp_path, same):
    path = str(tmp_path / "package")
    contents = [spark.createDataFrame([(i if same else i + n,) for i in range(3)], "k int") for n in (0, 1)]
    claims = [sinks.stage_package(df, path) for df in contents]
    assert sinks.package_record(spark, path) is None
    start = threading.Barrier(2)

    def publish(claim):
        start.wait()
        try:
            return sinks.publish_package(spark, path, claim)
        except ValueError:
            return "refused"

    with ThreadPoolExecutor(2) as pool:
        states = list(pool.map(publish, claims))
    assert sorted(map(str, states)) == (["False", "True"] if same else ["True", "refused"])
    won = contents[states.index(True)]
    assert sorted(sinks.read_package(spark, path).collect()) == sorted(won.collect())
    # a third writer that staged before and comes late
    late = sinks.stage_package(won, path)
    assert sinks.publish_package(spark, path, late) is False


def test_ordered_and_nested_csv(spark, tmp_path):
    rows = spark.createDataFrame([(i, {"b": "1", "a": "2"} if i else None) for i in (3, 0, 2, 1)], "k int, m map<string,string>")
    path = str(tmp_path / "nested")
    sinks.write_nested_csv(rows, path, ["k"])
    lines = [line for part in sorted((tmp_path / "nested").glob("part-*")) for line in part.read_text().splitlines() if not line.startswith('"k"')]
    assert [line.split(",")[0].strip('"') for line in lines] == ["0", "1", "2", "3"]
    assert spark.read.option("header", True).option("escape", '"').csv(path).where("k = 0").first()["m"] is None


def test_artifact_states(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    files = sinks.file_manifest(spark, str(tmp_path))
    good = files.first()
    register = spark.createDataFrame(
        [(good["name"], good["bytes"], good["sha256"]), ("gone", 1, "0"), ("../a.txt", 1, "0")], "name string, bytes bigint, sha256 string"
    )
    assert dict(readers.artifact_states(register, files).collect()) == {"a.txt": "ok", "gone": "missing", "../a.txt": "outside"}
