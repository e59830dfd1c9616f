"""Scores against brute force, and skewed or oversized groups."""

import math
import random

import pytest
from pyspark.sql import functions as F

from evigrid.operators import conditioning, ensemble, pairing, quality, ranking, trajectory

SCHEMA = "method string, forecast_id string, slot int, sample_idx bigint, x double, y double, tx double, ty double"


@pytest.fixture(scope="module")
def cloud():
    """One forecast with more particles than a tile holds, one small one."""
    rng = random.Random(3)
    return [
        ("m", name, slot, i, rng.gauss(0, 500), rng.gauss(0, 300), 10.0 + slot, -5.0)
        for name, size in (("big", 1100), ("small", 5)) for slot in (0, 1) for i in range(size)
    ]


@pytest.fixture(scope="module")
def samples(spark, cloud):
    return spark.createDataFrame(cloud, SCHEMA).repartition(7).persist()


def groups(cloud):
    out = {}
    for r in cloud:
        out.setdefault((r[1], r[2]), []).append(r)
    return out


def test_unbiased_energy_equals_all_pairs(samples, cloud):
    got = {(r["forecast_id"], r["slot"]): r["energy"] for r in ensemble.energy_unbiased(samples).collect()}
    for key, rows in groups(cloud).items():
        n = len(rows)
        pairs = sum(math.dist(a[4:6], b[4:6]) for i, a in enumerate(rows) for b in rows[:i])
        want = sum(math.dist(r[4:6], r[6:8]) for r in rows) / n - pairs / (n * (n - 1))
        assert math.isclose(got[key], want, rel_tol=1e-10), key


def test_pair_term_of_a_forecast_of_several_blocks(spark):
    """Three blocks a side, an uneven split, and a repeated point."""
    rng = random.Random(5)
    points = [(rng.gauss(0, 3), rng.gauss(1, 2)) for _ in range(2_599)]
    points.append(points[0])
    df = spark.createDataFrame([("k", i, x, y) for i, (x, y) in enumerate(points)], "g string, sample_idx int, x double, y double")
    got = ensemble.pair_distance_sums(df, ["g"], F.array("x", "y"), 2).first().pair_sum
    want = sum(math.dist(a, b) for i, a in enumerate(points) for b in points[:i])
    assert math.isclose(got, want, rel_tol=1e-10)


@pytest.mark.parametrize("bounded", [True, False])
def test_cyclic_energy(samples, cloud, bounded):
    got = {(r["forecast_id"], r["slot"]): r["energy"] for r in ensemble.energy_cyclic(samples, bounded=bounded).collect()}
    for key, rows in groups(cloud).items():
        rows = sorted(rows, key=lambda r: r[3])
        steps = sum(math.dist(r[4:6], rows[i - 1][4:6]) for i, r in enumerate(rows)) / len(rows)
        want = sum(math.dist(r[4:6], r[6:8]) for r in rows) / len(rows) - 0.5 * steps
        assert math.isclose(got[key], want, rel_tol=1e-10), key


@pytest.mark.parametrize("bounded", [True, False])
def test_rank_crps_equals_pairs(samples, cloud, bounded):
    got = {(r["forecast_id"], r["slot"], r["axis"]): r["crps"] for r in ensemble.coordinate_crps(samples, bounded=bounded).collect()}
    for (name, slot), rows in groups(cloud).items():
        for axis, v, t in (("east", 4, 6), ("north", 5, 7)):
            n = len(rows)
            pairs = sum(abs(a[v] - b[v]) for i, a in enumerate(rows) for b in rows[:i])
            want = sum(abs(r[v] - r[t]) for r in rows) / n - pairs / (n * (n - 1))
            assert math.isclose(got[name, slot, axis], want, rel_tol=1e-9, abs_tol=1e-9)


@pytest.mark.parametrize("bounded", [True, False])
def test_disks_use_order_statistics(samples, cloud, bounded):
    levels = {"a": 0.5, "b": 0.9, "c": 0.95}
    got = ensemble.radial_disks(samples, levels, bounded=bounded).collect()
    assert len(got) == 12
    for r in got:
        rows = groups(cloud)[r["forecast_id"], r["slot"]]
        cx, cy = (sum(q[i] for q in rows) / len(rows) for i in (4, 5))
        radii = sorted(math.dist(q[4:6], (cx, cy)) for q in rows)
        want = radii[math.ceil(r["level"] * len(rows) - 1e-9) - 1]
        assert math.isclose(r["radius"], want, rel_tol=1e-9) and math.isclose(r["area"], math.pi * want**2, rel_tol=1e-9)
        assert r["covered"] == (math.dist((cx, cy), rows[0][6:8]) <= want)


def test_path_energy_of_one_path_is_undefined_and_deterministic_is_distance(spark):
    one = spark.createDataFrame([("m", "f", s, 0, 3.0, 4.0, 0.0, 0.0) for s in (0, 1)], SCHEMA)
    assert ensemble.path_energy(one, [0.5, 0.5]).first()["path_energy"] is None
    assert ensemble.energy_cyclic(one).first()["energy"] == 5


def test_incomplete_slots_have_no_weighted_score(spark):
    df = spark.createDataFrame([("f", 0, 1.0), ("f", 1, 3.0), ("g", 0, 1.0)], "forecast_id string, slot int, s double")
    got = {r["forecast_id"]: r["weighted_score"] for r in ensemble.weighted_score(df, "s", [0.5, 0.5], ["forecast_id"]).collect()}
    assert got == {"f": 2.0, "g": None}


def test_entropy(spark):
    rows = [("m", "f", 0, i, x, 0.0, 0.0, 0.0) for i, x in enumerate((1.0, 2.0, 300.0, 20000.0))]
    out = ensemble.position_entropy(spark.createDataFrame(rows, SCHEMA)).first()
    want = -(0.5 * math.log(0.5) + 2 * 0.25 * math.log(0.25))
    assert out["bins"] == 3 and math.isclose(out["entropy"], want)


def test_nearest_prefers_earlier_on_a_tie(spark):
    targets = spark.createDataFrame([("k", 0, 100), ("k", 1, 500)], "k string, slot int, nominal bigint")
    seen = spark.createDataFrame([("k", 95, 1), ("k", 105, 2), ("k", 140, 3)], "k string, t bigint, id int")
    got = pairing.nearest_match(targets, seen, "k", "nominal", "t", 30, ["k", "slot"], ["id"]).collect()
    assert [(r["slot"], r["t"], r["id"]) for r in got] == [(0, 95, 1)]


def test_overlap_counts_equal_pairs(spark):
    rng = random.Random(9)
    left = [(i, s, s + rng.randrange(0, 40)) for i, s in enumerate(rng.randrange(1000) for _ in range(200))]
    right = [(s, s + rng.randrange(1, 60)) for s in (rng.randrange(1000) for _ in range(150))]
    got = dict(
        pairing.overlap_counts(
            spark.createDataFrame(left, "id bigint, a0 bigint, a1 bigint"), spark.createDataFrame(right, "b0 bigint, b1 bigint"),
            "id", ("a0", "a1"), ("b0", "b1"),
        ).collect()
    )
    for i, a0, a1 in left:
        if a0 < a1:
            assert got[i] == sum(a0 < b1 and b0 < a1 for b0, b1 in right), i


def test_lineage_cycle_and_depth(spark):
    chain = [(i, i - 1 if i else None, "shared" if i == 2 else "public") for i in range(40)]
    df = spark.createDataFrame([*chain, (100, 101, "public"), (101, 100, "public")], "child bigint, parent bigint, visibility string")
    rank = F.when(F.col("visibility") == "shared", 1).otherwise(0)
    got = {r["node"]: r for r in pairing.ancestor_closure(df, rank, 32).collect()}
    assert got[32]["root"] == 0 and got[32]["depth"] == 32 and got[1]["strictest"] == 0 and got[5]["strictest"] == 1
    assert not got[33]["resolved"] and not got[100]["resolved"] and got[0]["resolved"]


def test_segments_equal_plain_rule(spark):
    rng = random.Random(1)
    rows, t = [], 0
    for i in range(500):
        t += rng.choice([1, 5, 30, 61, 400])
        rows.append(("hot", i, t, 1.0))
    df = spark.createDataFrame(rows, "u string, id bigint, t bigint, d double")
    out = trajectory.segment_points(df, "u", [F.col("t"), F.col("id")], F.floor(F.col("t") / 100), "t", 60, {"x": F.col("d")})
    got = {r["id"]: (r["seg"], r["idx"], r["n"], r["x"]) for r in out.collect()}
    seg, start, sizes, want = 0, 0, {}, {}
    for i, (_, key, at, _) in enumerate(rows):
        if i == 0 or at - rows[i - 1][2] > 60:
            seg, start = seg + 1, i
        sizes[seg] = sizes.get(seg, 0) + 1
        want[key] = (seg, i - start, i + 1.0)
    assert all(got[k] == (s, idx, sizes[s], x) for k, (s, idx, x) in want.items())


def test_retry_chains(spark):
    flags = [True, True, True, False, True, False]
    df = spark.createDataFrame([("c", i, f) for i, f in enumerate(flags)], "c string, t bigint, failed boolean")
    got = {r["chain"]: (r["attempts"], r["allowed"]) for r in ranking.retry_chains(df, ["c"], [F.col("t")], F.floor(F.col("t") / 2), "failed").collect()}
    assert got == {1: (4, False), 2: (2, True)}


def test_long_bundles_are_hashed_as_trees(spark):
    files = spark.range(3000).select(F.lit("b").alias("k"), F.format_string("f%06d", "id").alias("p"), F.md5(F.col("id").cast("string")).alias("d"))
    one = quality.bundle_hashes(files, ["k"], "p", "d").first()["bundle_sha256"]
    again = quality.bundle_hashes(files.repartition(5), ["k"], "p", "d").first()["bundle_sha256"]
    changed = quality.bundle_hashes(files.withColumn("d", F.when(F.col("p") == "f002999", "x").otherwise(F.col("d"))), ["k"], "p", "d")
    assert one == again and one != changed.first()["bundle_sha256"]


def test_mixture_identity_and_weights(spark):
    rows = [(i, i % 3 == 0, float(i % 7) * 100, 0.0) for i in range(60)]
    paths = spark.createDataFrame(rows, "id int, hit boolean, end_x double, end_y double")
    total = conditioning.class_weights(paths, 4.0).agg(F.sum("weight"), F.max("prior"), F.max("posterior")).first()
    assert math.isclose(total[0], 1) and math.isclose(total[1], 1 / 3) and math.isclose(total[2], 4 / 3 / (4 / 3 + 2 / 3))
    prior = conditioning.cell_mass(paths, 100, F.lit(1.0))
    assert conditioning.total_variation(prior, prior).first()["distance"] == 0


@pytest.mark.parametrize("bad,rule", [(None, "absent"), (float("nan"), "not_finite"), (float("inf"), "not_finite"), (-1.0, "negative")])
def test_one_bad_number_is_one_violation(spark, bad, rule):
    df = spark.createDataFrame([(1, 2.0), (2, bad), (3, 0.0)], "id int, v double")
    assert [(r["id"], r["rule"]) for r in quality.number_violations(df, ["id"], ["v"]).collect()] == [(2, rule)]


def test_sensitive_text_names_the_line(spark):
    text = "plain\nsee C:\\\\data and\nkey sk-" + "a" * 24 + "\n-----BEGIN RSA PRIVATE KEY-----"
    df = spark.createDataFrame([(1, text), (2, "nothing")], "id int, text string")
    got = {(r["id"], r["line"], r["rule"]) for r in quality.sensitive_lines(df, ["id"], "text").collect()}
    assert got == {(1, 2, "workstation path"), (1, 3, "common access token"), (1, 4, "private key")}


def test_forbidden_fields_at_any_depth(spark):
    rows = [
        (1, '{"a": {"hostname": 1}}'), (2, '{"a": [{"b": {"latitude" : 2}}]}'), (3, '{"a": "hostname"}'),
        (4, '{"note": "x \\"hostname\\": y"}'), (5, '{"hostname": "latitude"}'),
    ]
    df = spark.createDataFrame(rows, "id int, doc string")
    got = sorted((r["id"], r["field"]) for r in quality.forbidden_fields(df, ["id"], "doc", ["hostname", "latitude"]).collect())
    assert got == [(1, "hostname"), (2, "latitude"), (5, "hostname")]


def test_track_fingerprints_ignore_signed_zero_but_not_order(spark):
    nan = float("nan")
    rows = [("a", 0, 0.0), ("a", 1, nan), ("b", 0, -0.0), ("b", 1, nan), ("c", 0, nan), ("c", 1, 0.0)]
    df = spark.createDataFrame(rows, "s string, i int, v double").withColumn("t", F.col("i") + F.when(F.col("s") == "b", 5).otherwise(0))
    plain = dict(trajectory.track_fingerprints(df, ["s"], "i", ["v"]).collect())
    timed = dict(trajectory.track_fingerprints(df, ["s"], "i", ["v"], "t").collect())
    assert plain["a"] == plain["b"] != plain["c"] and timed["a"] != timed["b"]
