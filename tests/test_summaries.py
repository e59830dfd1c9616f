"""Summaries on a schema of their own, rows with null keys and clocks, unusable metrics and weights, edge sizes."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evigrid.functions.ordered import PIECE, previous, row_numbers, running_sums, with_piece
from evigrid.functions.quantiles import exact_quantiles
from evigrid.operators import inference, pairing, quality, ranking, resample, rollup, summaries, trajectory
from evigrid.session import shared_folder
from evigrid.sources import readers, sinks


@pytest.fixture(scope="module")
def tracks(spark):
    rows = [(1, None, "a"), (1, 5, "b"), (1, 7, "c"), (None, 3, "d"), (None, None, "e"), (2, 5, "f"), (2, 5, "g")]
    return spark.createDataFrame(rows, "k int, t bigint, x string")


def test_no_row_with_a_null_key_or_clock_is_lost(tracks):
    order, chunk = [F.col("t"), F.col("x")], F.floor(F.col("t") / 4)
    numbered = row_numbers(tracks, ["k"], order, chunk, "r", total="n")
    w = W.partitionBy("k").orderBy("t", "x")
    plain = tracks.select("*", F.row_number().over(w).alias("r"), F.count("*").over(W.partitionBy("k")).alias("n"))
    assert sorted(map(str, numbered.collect())) == sorted(map(str, plain.collect()))
    linked = previous(tracks, ["k"], order, chunk, {"p": "x"})
    assert sorted(map(str, linked.collect())) == sorted(map(str, tracks.select("*", F.lag("x").over(w).alias("p")).collect()))
    segments = trajectory.segment_points(tracks, "k", order, chunk, "t", 1)
    assert sorted((str(r.k), r.x, r.seg, r.idx, r.n) for r in segments.collect()) == [
        ("1", "a", 1, 0, 2), ("1", "b", 1, 1, 2), ("1", "c", 2, 0, 1), ("2", "f", 1, 0, 2), ("2", "g", 1, 1, 2),
        ("None", "d", 1, 1, 2), ("None", "e", 1, 0, 2),
    ]


@pytest.fixture(scope="module")
def offset_values(spark):
    """Microsecond-like values: a large offset, heavy ties, nulls, a group of nulls only."""
    rng = random.Random(2)
    rows = [
        (rng.choice([1, 1, 1, 2, None]), rng.choice([None, 1.7e15 + rng.randint(0, 10**5), 1.7e15 + 5.0, 1.7e15 + 5.0]), i)
        for i in range(20_000)
    ]
    return spark.createDataFrame([*rows, (9, None, -1)], "k int, v double, i bigint")


def test_pieces_follow_the_data(offset_values):
    sizes = with_piece(offset_values, "v", "i").groupBy(PIECE).count().agg(F.max("count")).first()[0]
    assert sizes < 400


def test_quantiles_of_offset_values_and_null_groups(offset_values):
    got = {r.k: (r.a, r.m) for r in exact_quantiles(offset_values, ["k"], "v", {"a": 0.1, "m": 0.77}).collect()}
    assert set(got) == {1, 2, None, 9} and got[9] == (None, None)
    for key in (1, 2, None):
        values = [r.v for r in offset_values.where(F.col("k").eqNullSafe(F.lit(key))).collect() if r.v is not None]
        assert got[key] == pytest.approx(tuple(np.quantile(values, [0.1, 0.77])), rel=1e-15)


def test_ranks_of_tied_values(offset_values):
    bands = ranking.rank_bands(offset_values, ["k"], "v", "i", 3)
    w = W.partitionBy("k").orderBy("v", "i")
    assert bands.count() == 20_001
    assert bands.withColumn("o", F.row_number().over(w) - 1).where("o <> rank").count() == 0
    falling = W.partitionBy("k").orderBy(F.col("v").desc(), "i")
    ranked = ranking.mass_order(offset_values.withColumn("v", F.col("v") - 1.7e15), ["k"], "v", ["i"], 0.5)
    assert ranked.withColumn("o", F.row_number().over(falling)).where("o <> rank").count() == 0


def test_text_ranges_are_monotone(spark):
    df = spark.createDataFrame([(f"block-{i:05d}",) for i in range(3000)] + [(None,)], "b string")
    cut = with_piece(df, "b").withColumnRenamed(PIECE, "c")
    assert cut.groupBy("c").count().agg(F.max("count")).first()[0] < 300
    sums = running_sums(with_piece(df, "b"), [], [F.col("b")], F.col(PIECE), {"n": F.lit(1)})
    assert {r.n for r in sums.collect()} == set(range(1, 3002))


def test_a_lacking_metric_is_not_averaged_away(spark):
    cells = spark.createDataFrame(
        [("A", 1, 1, s, "SUCCEEDED", v) for s, v in ((1, 1.0), (2, None))] + [("A", 1, 2, s, "SUCCEEDED", 3.0) for s in (1, 2)],
        "arm_id string, horizon int, block_id int, seed int, status string, m double",
    )
    blocks = rollup.block_means(cells, ["m"])
    assert {r.block_id: (r.complete, r.m) for r in blocks.collect()} == {1: (True, None), 2: (True, 3.0)}
    assert rollup.arm_means(blocks, ["m"]).first().m is None
    expected = cells.select("arm_id", "block_id", "seed")
    gated = rollup.gated_group_means(
        cells.drop("horizon"), expected, ["arm_id"], ["block_id", "seed"], [["arm_id", "block_id"], ["arm_id"]], ["m"], success="SUCCEEDED"
    ).first()
    assert gated.m is None and gated.success_rows == 4
    policy = inference.Policy(metric="m", minimum_seeds=2, seed_pairing="independent-within-block")
    assert {r.block_id: r.complete for r in inference.policy_blocks(cells, policy).collect()} == {1: False, 2: True}
    barred = inference.policy_blocks(cells, policy, F.col("seed") == 1)
    assert not any(r.complete for r in barred.collect())
    with pytest.raises(ValueError, match="registered word"):
        inference.Policy(seed_pairing="by-luck")


def test_no_partial_interval(spark):
    rows = [(1, f"block-{i}", float(i), 1.0, None if i == 3 else 2.0, 1.0) for i in range(8)]
    df = spark.createDataFrame(rows, "k int, u string, a double, b double, c double, d double")
    out = inference.segment_bootstrap(df, ["k"], "u", [("ok", "a", "b")], [("no", "c", "d")], draws=60).first()
    assert out.no_low is None and out.no_high is None and out.ok_low < out.ok_high


@pytest.mark.parametrize("offset", [-900.0, -700.0, 0.0, 700.0, 900.0])
def test_weights_beyond_a_double(spark, offset):
    rng = random.Random(3)
    rows = [(k % 3, offset + rng.uniform(-300, 300) * (k % 2), k % 4 == 0, float(k)) for k in range(60)]
    df = spark.createDataFrame(rows, "chunk int, log_weight double, hit boolean, x double").withColumn("s", F.lit("s"))
    merged = inference.merge_moments(inference.chunk_moments(df, ["s", "chunk"]), ["s"])
    row = inference.importance_estimate(merged).first()

    def log_sum(values):
        top = max(values)
        return top + math.log(sum(math.exp(v - top) for v in values))

    weights = [w for _, w, _, _ in rows]
    assert row.log_w == pytest.approx(log_sum(weights)) and row.log_w2 == pytest.approx(log_sum([2 * w for w in weights]))
    assert row.log_event == pytest.approx(log_sum([w for _, w, h, _ in rows if h]))
    assert row.ess == pytest.approx(math.exp(2 * log_sum(weights) - log_sum([2 * w for w in weights])))
    xs = [x for *_, x in rows]
    assert row["mean"] == pytest.approx(np.mean(xs)) and row.m2 == pytest.approx(np.var(xs) * len(xs))


def test_unusable_weights_and_single_draws(spark):
    df = spark.createDataFrame([("a", 1, None, True, 1.0), ("a", 2, 0.5, True, 2.0), ("b", 1, 0.1, True, 3.0)], "s string, chunk int, log_weight double, hit boolean, x double")
    merged = inference.merge_moments(inference.chunk_moments(df, ["s", "chunk"]), ["s"])
    states = {r.s: (r.state, r.ess, r.se) for r in inference.importance_estimate(merged).collect()}
    assert states["a"][0] == "UNAVAILABLE" and states["a"][1] is None and states["b"][0] == "LOW_ESS" and states["b"][2] is None
    assert {r.s: r.se for r in inference.mean_interval(merged).collect()}["b"] is None
    levels = spark.createDataFrame([("s", 0, 4.0, 1.0), ("s", 1, 1e-9, 2.0), ("s", 2, 1e-9, 0.0)], "s string, level int, variance double, cost double")
    out = {r.level: r for r in inference.level_allocation(levels, ["s"], "level", 0.5).collect()}
    assert out[1].samples == 2 and out[2].samples is None and out[1].variance_ratio is None and out[2].variance_ratio == 1.0


def test_cost_of_attempts_with_two_events(spark):
    history = spark.createDataFrame([(1, 10), (1, 11), (2, 12)], "cell_id int, attempt_id int")
    events = spark.createDataFrame(
        [(10, False, None, 5), (10, True, 7, 5), (11, False, None, 4), (99, True, 1, 1), (12, True, 2, 2), (12, True, 2, 2)],
        "attempt_id int, settled boolean, elapsed_ms int, reserved_ms int",
    )
    costs = {r.cell_id: r for r in rollup.cell_costs(history, events).collect()}
    assert (costs[1].attempts, costs[1].pending_attempts, costs[1].charged_ms, costs[1].reserved_ms) == (2, 1, 7, 4)
    assert (costs[2].attempts, costs[2].measured_ms) == (1, 2)
    found = {r.attempt_id: r.violation for r in rollup.ledger_violations(history, events).collect()}
    assert found == {99: "foreign_attempt", 12: "duplicate_settlement"}
    states = rollup.attempt_cost_states(events.withColumn("is_event", F.lit(True)), F.col("is_event"))
    assert {r.attempt_id: r.cost_state for r in states.collect()} == {10: "measured", 11: "pending", 99: "measured", 12: "measured"}


def test_selected_attempt_is_the_first_success(spark):
    df = spark.createDataFrame(
        [(1, 1, "a", "F", False), (1, 2, "b", "S", True), (1, 3, "c", "S", False), (2, 1, "d", "S", False), (2, 2, "e", "S", True), (3, 1, "f", "F", True)],
        "cell int, o int, a string, s string, used boolean",
    )
    got = ranking.first_success(df, ["cell"], "o", "a", F.col("s") == "S", F.col("used")).collect()
    assert {r.cell: (r.first_success, r.only_first_used) for r in got} == {1: ("b", True), 2: ("d", False)}


def test_dangling_parents_are_not_roots(spark):
    edges = spark.createDataFrame([(1, None), (2, 1), (5, 9), (6, 5)], "child int, parent int")
    got = {r.node: (r.root, r.resolved) for r in pairing.ancestor_closure(edges, F.lit(0)).collect()}
    assert got == {1: (1, True), 2: (1, True), 5: (None, False), 6: (None, False)}


def test_hits_across_lines_and_one_list_hash(spark):
    text = "ok\nx C:\\a\n-----BEGIN RSA PRIVATE KEY-----\nhome /home/\nuser/x and C:\\b C:\\c"
    got = quality.sensitive_lines(spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, t string"), ["id"], "t")
    assert sorted((r.line, r.rule) for r in got.collect()) == [
        (2, "workstation path"), (3, "private key"), (4, "workstation path"), (5, "workstation path"),
    ]
    files = spark.range(1500).select(F.lit(1).alias("k"), F.format_string("f%06d", "id").alias("p"), F.lit("d").alias("d"))
    import hashlib

    listed = "[" + ",".join(f'{{"path":"f{i:06d}","sha256":"d"}}' for i in range(1500)) + "]"
    assert quality.bundle_hashes(files, ["k"], "p", "d").first().bundle_sha256 == hashlib.sha256(listed.encode()).hexdigest()


def test_oversized_and_crooked_files_are_reported(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "m.json").write_text('[{"v": 1}]')
    (tmp_path / "m.json").write_text("[" + '{"v": 2},' * 50 + '{"v": 3}]')
    manifest = {r.name: r.bytes for r in sinks.file_manifest(spark, str(tmp_path), "*.json").collect()}
    assert set(manifest) == {"a/m.json", "m.json"}
    import hashlib

    digest = hashlib.sha256((tmp_path / "a" / "m.json").read_bytes()).hexdigest()
    paths = ["a/m.json", "m.json", "gone.json", "a//m.json", "C:\\m.json", "../x"]
    rows, refused = readers.read_sharded(spark, str(tmp_path), spark.createDataFrame([(p, digest) for p in paths], "path string, sha256 string"), "v int", size_limit=100)
    assert [(r.path, r.v) for r in rows.collect()] == [("a/m.json", 1)]
    assert {r.path: r.state for r in refused.collect()} == {
        "m.json": "oversized", "gone.json": "absent", "a//m.json": "escapes_root", "C:\\m.json": "escapes_root", "../x": "escapes_root",
    }
    pinned = {r.state: r.document is not None for r in readers.read_pinned(spark, f"{tmp_path}/*.json", 100).collect()}
    assert pinned == {"oversized": False}


def test_shared_folder_is_asked_for_on_a_cluster(spark):
    class Session:
        class conf:
            @staticmethod
            def get(key, default=None):
                return {"spark.master": "spark://host:1"}.get(key, default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session)


def test_summaries_of_another_schema(spark):
    runs = spark.createDataFrame([("x", 1, "ok", 5.0), ("x", 1, "bad", None), ("x", 2, "ok", 7.0), ("y", 3, None, None)], "fam string, cell int, st string, ms double")
    counts = summaries.attempt_and_cell_counts(runs, "cell", F.col("fam"), "st", "ok", "bad", "open")
    assert {r.family: (r.expected_cells, r.successful_attempts, r.complete_history) for r in counts.collect()} == {"x": (2, 2, True), "y": (1, 0, False)}
    cost = {r.fam: (r.planned, r.missing, r.total_ms) for r in summaries.recorded_cost(runs, [F.col("fam")], "ms").collect()}
    assert cost == {"x": (3, 1, 12.0), "y": (1, 1, None)}
    assert {r.fam: r.best for r in summaries.best_by(runs, ["fam"], "cell", "ms").collect()} == {"x": 1, "y": None}
    caps = spark.createDataFrame([(None, "d", "e", 1), ("m", "d", "l", 2), ("m", "d", "e", 5)], "m string, d string, c string, n int")
    totals = {(r.m, r.d): r.net for r in summaries.capture_totals(caps, ["m", "d"], "c", "n", "e", "l").collect()}
    assert totals == {(None, "d"): -1, (None, "all"): -1, ("m", "d"): -3, ("m", "all"): -3, ("all", "all"): -4}
    cover = summaries.exact_cover(spark.createDataFrame([(1,), (2,), (3,)], "c int"), spark.createDataFrame([(1,), (3,), (3,), (4,)], "c int"), "c")
    assert {r.c: r.state for r in cover.collect()} == {1: "covered", 2: "uncovered", 3: "duplicate", 4: "not_executable"}
    uses = spark.createDataFrame([(1, "a", 3), (1, "a", 3), (2, "a", 3), (2, None, 3)], "s int, g string, c int")
    assert {r.s: (r.conflict, r.charged_ms) for r in summaries.shared_source_cost(uses, "s", "g", F.col("c")).collect()} == {1: (False, 3), 2: (True, None)}
    reps = spark.createDataFrame([("p", 1, True), ("p", 2, True), ("q", 1, True), ("q", 1, True)], "k string, r int, ok boolean")
    aligned = summaries.replicate_alignment(reps, ["k"], "r", [1, 2], F.col("ok"))
    assert {r.k: r.aligned for r in aligned.collect()} == {"p": True, "q": False}
    guard = rollup.weighting_guard(spark.createDataFrame([("a", 1, 0.0), ("a", 1, 0.0), ("a", 2, 3.0)], "g string, b int, v double"), ["g"], "b", "v").first()
    assert (guard.block_mean, guard.pooled_mean, guard.differs) == (1.5, 1.0, True)


def test_one_median_for_every_number_of_units(spark):
    df = spark.createDataFrame([(1, i, float(i * i)) for i in range(9)], "k int, u int, v double")
    slots = resample.block_slots(df, ["k"], "u")
    assert sorted(r.slot for r in slots.collect()) == list(range(9)) and slots.first()["size"] == 9
    drawn = resample.bootstrap_both(slots, ["k"], [], ["v"], 30, "s")
    assert drawn.count() == 30 and all(0 <= r.v <= 64 for r in drawn.collect())


def test_draws_as_vectors_equal_draws_as_rows(spark, monkeypatch):
    rows = [(g, "p", i, None if i % 7 == 3 else float((i * 37) % 11), float(i), i % 2) for g in (1, None) for i in range(23)]
    rows += [(5, None, 0, None, 1.0, 0), (6, "k0", 0, 2.0, float("inf"), 0)]
    df = spark.createDataFrame(rows, "g int, prefix string, u int, v double, k0 double, draw int")
    slots = resample.block_slots(df, ["g", "prefix"], "u")

    def both():
        means = resample.bootstrap_means(slots, ["g", "prefix"], ["v", "k0"], 60, "s", deviations=True).collect()
        mixed = resample.bootstrap_both(slots, ["g", "prefix"], ["v"], ["k0"], 130, "s").collect()
        labelled = resample.bootstrap_means(slots, ["g", "prefix"], ["v"], 7, "s", label=["prefix"]).collect()
        named = [[tuple(sorted(r.asDict().items())) for r in part] for part in (means, mixed, labelled)]
        return [sorted(part, key=repr) for part in named]

    vectors = both()
    monkeypatch.setattr(resample, "VECTOR_UNITS", 0)
    for left, right in zip(vectors, both(), strict=True):
        assert len(left) == len(right)
        for a, b in zip(left, right, strict=True):
            assert [n for n, _ in a] == [n for n, _ in b]
            for (_, x), (_, y) in zip(a, b, strict=True):
                assert x == y or x == pytest.approx(y, rel=1e-12, nan_ok=True)


def test_coverage_is_compared_for_every_seed(spark):
    from evigrid.plans import catalog

    sf = "/root/testdata/sf0.001"
    rows = catalog.queries()["jon3_coverage_matched_reference_by_seed"](spark, sf).collect()
    assert {r.seed for r in rows} == set(range(1, 8))
    seventh = sorted((r.arm_id, r.horizon, r.same_coverage, r.delta) for r in rows if r.seed == 7)
    assert seventh == sorted(map(tuple, catalog.queries()["jon3_coverage_matched_reference"](spark, sf).collect()))


def test_whole_sample_dump_holds_every_slot_and_method(spark):
    from evigrid.plans import catalog

    sf = "/root/testdata/sf0.001"
    whole = catalog.queries()["src13_parquet_samples_whole"](spark, sf)
    assert whole.select("slot", "method").distinct().count() == 8
    one = catalog.queries()["src13_parquet_samples"](spark, sf).collect()
    assert sorted(map(tuple, whole.where("slot = 3 and method = 'raw'").collect())) == sorted(map(tuple, one))


def test_lineage_states_with_several_references(spark):
    # a diamond, a missing reference, a ring of two with something above it, a chain one too long, an object of its own
    pairs = [(2, 1), (3, 1), (4, 2), (4, 3), (4, 3), (5, 99), (6, 5), (7, 8), (8, 7), (9, 8), (10, 9), (11, 11), (4, None)]
    pairs += [(100 + i, 99 + i) for i in range(1, 36)]
    nodes = [(n, 2 if n == 2 else 0) for n in [*range(1, 12), *range(100, 136)]] + [(None, 1)]
    objects = spark.createDataFrame(nodes, "node int, v int")
    references = spark.createDataFrame(pairs, "child int, parent int")
    got = {r.node: tuple(r)[1:] for r in pairing.lineage_states(objects, references, F.col("v"), 32).collect()}
    assert len(got) == len(nodes)
    assert got[1] == ("resolved", 0, 1, 0) and got[4] == ("resolved", 2, 5, 2) and got[2] == ("resolved", 1, 2, 2)
    assert {n: got[n][0] for n in range(5, 12)} == {5: "dangling", 6: "dangling", **dict.fromkeys(range(7, 12), "cycle")}
    assert got[132] == ("resolved", 32, 33, 0) and got[133] == ("too_long", None, None, None) and got[135][0] == "too_long"
    assert got[None] == ("resolved", 0, 1, 1)
    few = {r.node: r.state for r in pairing.lineage_states(objects, references, F.col("v"), 32, max_visits=4).collect()}
    assert few[4] == "too_many" and few[2] == "resolved"
    assert pairing.lineage_states(objects.limit(0), references, F.col("v")).count() == 0


def test_resource_states_of_all_four_kinds(spark):
    cells = spark.createDataFrame(
        [(1, "a", True), (2, "a", True), (3, "b", False), (4, "b", True), (5, "c", True), (6, "d", None), (7, "e", True)],
        "cell_id int, g string, has_record boolean",
    )
    attempts = spark.createDataFrame(
        [(1, 1, "RECORDED", 5, 4, 100), (1, 2, "RECORDED", 7, 6, 50), (3, 3, "RECORDED", 9, 9, 900), (4, 4, "RECORDED", 1, 1, 10),
         (5, 5, "LOST", None, None, None), (5, 6, "RECORDED", 2, 2, None), (7, 7, None, 1, 1, 1)],
        "cell_id int, attempt_id int, resource_status string, wall_ns bigint, cpu_ns bigint, peak_bytes bigint",
    )
    states = rollup.resource_states(cells, attempts)
    assert states.count() == 7
    got = {r.g: r for r in rollup.resource_summary(rollup.merge_resources(states, ["g"])).collect()}
    assert (got["a"].duration_complete, got["a"].wall_ns, got["a"].maximum_peak_bytes, got["a"].unattempted_cells) == (True, 12, 100, 1)
    # a legacy cell leaves the whole group unknown, and its attempts are not observed
    assert (got["b"].legacy_cells, got["b"].duration_complete, got["b"].wall_ns, got["b"].observed_wall_ns) == (1, False, None, 1)
    assert (got["c"].unavailable_attempts, got["c"].memory_unknown_attempts, got["c"].duration_complete) == (1, 1, False)
    assert (got["d"].legacy_cells, got["e"].unavailable_attempts, got["e"].observed_wall_ns) == (1, 1, None)
    # the state merges: all at once equals by way of the groups
    whole = rollup.merge_resources(states, []).collect()
    assert rollup.merge_resources(rollup.merge_resources(states, ["g"]), []).collect() == whole
    assert sorted(map(tuple, rollup.resource_unknowns(attempts).collect())) == [(5, "unavailable"), (6, "memory"), (7, "unavailable")]


def test_an_unregistered_policy_returns_the_same_record(spark):
    cells = spark.createDataFrame(
        [(a, 1, b, s, "SUCCEEDED", float(b + s)) for a in ("A", "B") for b in range(6) for s in (1, 2)],
        "arm_id string, horizon int, block_id int, seed int, status string, m double",
    )
    contrasts = spark.createDataFrame([("c", "A", "B", 1, 1.0)], "comparison_id string, reference string, candidate string, horizon int, weight double")
    whole = inference.Policy(
        metric="m", direction="minimize", minimum_seeds=2, minimum_paired_blocks=2, seed_pairing="identical", confidence=0.95, replicates=50, seed="s",
        multiplicity="bonferroni", practical_threshold=0.1,
    )
    known = inference.adjudicate(cells, contrasts, whole)
    for policy in (inference.Policy(metric="m", minimum_seeds=2), inference.Policy()):
        unknown = inference.adjudicate(cells, contrasts, policy)
        assert {f.name: f.dataType for f in unknown.schema} == {f.name: f.dataType for f in known.schema}
        assert unknown.unionByName(known).count() == 2 and unknown.first().verdict == "NEEDS_PREREGISTRATION"


def test_tied_events_have_one_charge(spark):
    rows = [(1, True, 30, 90), (1, True, 70, 80), (2, False, None, 10), (2, True, None, 20)]
    schema = "attempt_id int, settled boolean, elapsed_ms bigint, reserved_ms bigint"
    for order in (rows, rows[::-1]):
        got = {r.attempt_id: r.elapsed_ms for r in rollup.latest_events(spark.createDataFrame(order, schema)).collect()}
        assert got == {1: 70, 2: None}


def test_replicate_matrices_name_every_kind_of_difference(spark):
    base = [(k, "A", "ok", "S") for k in (1, 2, None)]
    rows = [(1, *r) for r in base] + [(2, *r) for r in base] + [(3, *r) for r in base[:2]] + [(4, *r) for r in [*base, (9, "A", "ok", "S")]]
    rows += [(5, *r) for r in [*base, base[0]]] + [(6, 1, "B", "ok", "S"), *[(6, *r) for r in base[1:]]]
    rows += [(7, 1, None, "ok", "S"), *[(7, *r) for r in base[1:]]] + [(8, *r) for r in base]
    df = spark.createDataFrame(rows, "seed int, k int, reference string, comparison string, status string")
    got = summaries.replicate_matrices(df, ["k"], "seed", [1, 2, 3, 4, 5, 6, 7, 10], ["reference", "comparison"])
    assert {r.seed: (r.executions, r.state) for r in got.collect()} == {
        1: (3, "aligned"), 2: (3, "aligned"), 3: (2, "matrix_differs"), 4: (4, "matrix_differs"), 5: (4, "repeated_execution"),
        6: (3, "contract_differs"), 7: (3, "contract_differs"), 8: (3, "unregistered"), 10: (0, "absent"),
    }
    empty = summaries.replicate_matrices(df.where("seed < 0"), ["k"], "seed", [1, 2], ["reference"])
    assert {r.seed: r.state for r in empty.collect()} == {1: "absent", 2: "absent"}
    late = summaries.replicate_matrices(df, ["k"], "seed", [10, 1], ["reference"]).where("seed = 1").first()
    assert late.state == "matrix_differs"


def test_replicate_contracts_per_key(spark):
    rows = [(k, s, "A", "S") for k in "abcde" for s in (1, 2)]
    rows = [r for r in rows if r[:2] != ("b", 2)] + [("c", 2, "A", "S")]
    rows = [(k, s, "B" if (k, s) == ("d", 2) else ref, "F" if (k, s) == ("e", 1) else st) for k, s, ref, st in rows] + [("f", 9, "A", "S")]
    df = spark.createDataFrame(rows, "k string, seed int, reference string, status string")
    got = summaries.replicate_contracts(df, ["k"], "seed", [1, 2], ["reference"], "status").collect()
    assert {r.k: (r.replicates, r.state, r.replicate_status) for r in got} == {
        "a": (2, "aligned", "S"), "b": (1, "missing_replicate", "S"), "c": (2, "repeated_execution", "S"),
        "d": (2, "contract_differs", "S"), "e": (2, "aligned", "mixed"),
    }


def test_a_second_row_of_an_arm_stops_the_pairing(spark):
    df = spark.createDataFrame([(1, "A", 1.0), (1, "B", 2.0), (2, "A", 1.0), (2, "A", 1.0), (2, "B", 2.0)], "k int, arm string, v double")
    fine = pairing.arms_together(df.where("k = 1"), ["k"], "arm", "A", ["v"]).collect()
    assert [(r.ref.v, r.cand.v) for r in fine] == [(1.0, 2.0)]
    with pytest.raises(Exception, match="several rows"):
        pairing.arms_together(df, ["k"], "arm", "A", ["v"]).collect()
    twice = spark.createDataFrame([(1, "A", 1.0), (1, "B", 2.0), (1, "B", 3.0)], "k int, arm string, v double")
    with pytest.raises(Exception, match="several rows"):
        pairing.arms_together(twice, ["k"], "arm", "A", ["v"]).collect()
