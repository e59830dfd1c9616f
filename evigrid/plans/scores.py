"""Forecast scores and their profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigrid.functions.quantiles import exact_quantiles
from evigrid.functions.scalars import micros, seal
from evigrid.operators import ensemble, pairing, rollup, summaries
from evigrid.plans.bindings import CELLS, SAMPLES, cells, samples, table
from evigrid.plans.registry import query
from evigrid.session import materialise

LEVELS = {"p50": 0.5, "p80": 0.8, "p90": 0.9, "p95": 0.95}
WEIGHTS = [0.25] * 4
# a forecast of the binding has at most 500 particles, so its groups are bounded
G = "method, forecast_id, slot"

CENTRES = f"""{SAMPLES},
centres as (select {G}, count(*) as n, avg(x) as cx, avg(y) as cy, max(tx) as tx, max(ty) as ty,
            sqrt(pow(avg(x) - max(tx), 2) + pow(avg(y) - max(ty), 2)) as target_radius from samples group by {G}),
radii as (select {G}, sqrt(pow(s.x - c.cx, 2) + pow(s.y - c.cy, 2)) as radius from samples s join centres c using ({G}))"""
CYCLIC = f"""{SAMPLES},
linked as (select *, coalesce(lag(x) over w, last_value(x) over a) as px, coalesce(lag(y) over w, last_value(y) over a) as py
           from samples window w as (partition by {G} order by sample_idx),
           a as (partition by {G} order by sample_idx rows between unbounded preceding and unbounded following)),
energy as (select {G}, count(*) as particles,
           avg(sqrt(pow(x - tx, 2) + pow(y - ty, 2))) - 0.5 * avg(sqrt(pow(x - px, 2) + pow(y - py, 2))) as energy from linked group by {G})"""
DISKS = f"""{CENTRES},
ranked as (select {G}, radius, row_number() over (partition by {G} order by radius) as r, count(*) over (partition by {G}) as n from radii),
disks as (select {G}, level, radius, pi() * radius * radius as area, target_radius <= radius as covered
          from (select {G}, l.level, max(radius) filter (where r = greatest(ceil(l.level * n - 1e-9), 1)) as radius
                from ranked cross join (select unnest([0.5, 0.8, 0.9, 0.95])::double as level) l group by {G}, l.level)
          join centres using ({G}))"""


@query("src13_parquet_samples", f"with {SAMPLES} select {G}, sample_idx, round(x, 6) as x, round(y, 6) as y from samples where slot = 3 and method = 'raw'")
def src13_parquet_samples(spark, sf):
    return samples(spark, sf).where((F.col("slot") == 3) & (F.col("method") == "raw")).select(
        "method", "forecast_id", "slot", "sample_idx", F.round("x", 6).alias("x"), F.round("y", 6).alias("y")
    )


@query("src13_parquet_samples_whole", f"with {SAMPLES} select {G}, sample_idx, round(x, 6) as x, round(y, 6) as y from samples")
def src13_parquet_samples_whole(spark, sf):
    """The whole dump; ``src13_parquet_samples`` reads one segment of it."""
    return samples(spark, sf).select(
        "method", "forecast_id", "slot", "sample_idx", F.round("x", 6).alias("x"), F.round("y", 6).alias("y")
    )


@query("ens1_energy_cyclic", f"with {CYCLIC} select {G}, particles, round(energy, 6) as energy from energy")
def ens1_energy_cyclic(spark, sf):
    return ensemble.energy_cyclic(samples(spark, sf), bounded=True).withColumn("energy", F.round("energy", 6))


@query(
    "ens2_energy_unbiased",
    f"""with {SAMPLES}, p as (select {G}, sum(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) as d from samples a join samples b using ({G})
         where a.sample_idx < b.sample_idx group by {G}),
    m as (select {G}, count(*) as particles, avg(sqrt(pow(x - tx, 2) + pow(y - ty, 2))) as acc from samples group by {G})
    select {G}, particles, round(acc - d / (particles * (particles - 1)), 6) as energy from m join p using ({G})""",
)
def ens2_energy_unbiased(spark, sf):
    return ensemble.energy_unbiased(samples(spark, sf)).withColumn("energy", F.round("energy", 6))


@query(
    "ens3_deterministic_energy",
    f"""with {SAMPLES} select method, slot, count(*) as forecasts, round(avg(sqrt(pow(x - tx, 2) + pow(y - ty, 2))), 6) as score
        from samples group by method, slot""",
)
def ens3_deterministic_energy(spark, sf):
    """Every sample taken as a point forecast of its own."""
    return samples(spark, sf).groupBy("method", "slot").agg(
        F.count(F.lit(1)).alias("forecasts"), F.round(F.avg(ensemble.distance("x", "y", "tx", "ty")), 6).alias("score")
    )


@query(
    "ens4_coordinate_crps",
    f"""with {SAMPLES}, l as (select {G}, sample_idx, 'east' as axis, x as v, tx as t from samples union all select {G}, sample_idx, 'north', y, ty from samples),
    p as (select {G}, axis, sum(abs(a.v - b.v)) as d from l a join l b using ({G}, axis) where a.sample_idx < b.sample_idx group by {G}, axis),
    m as (select {G}, axis, count(*) as particles, avg(abs(v - t)) as acc from l group by {G}, axis)
    select {G}, axis, particles, round(acc - d / (particles * (particles - 1)), 6) as crps from m join p using ({G}, axis)""",
)
def ens4_coordinate_crps(spark, sf):
    return ensemble.coordinate_crps(samples(spark, sf), bounded=True).withColumn("crps", F.round("crps", 6))


@query(
    "ens5_point_errors",
    f"""with {CENTRES} select method, forecast_id, count(*) as slots, round(avg(target_radius), 6) as ade,
        round(arg_max(target_radius, slot), 6) as fde from centres group by method, forecast_id""",
)
def ens5_point_errors(spark, sf):
    out = ensemble.displacement_errors(samples(spark, sf))
    return out.withColumn("ade", F.round("ade", 6)).withColumn("fde", F.round("fde", 6))


@query(
    "ens6_centre_coverage",
    f"""with {CENTRES}, q as (select {G}, quantile_cont(radius, 0.9) as radius_q from radii group by {G})
    select {G}, round(target_radius, 6) as target_radius, round(radius_q, 6) as radius_q, target_radius <= radius_q as covered
    from centres join q using ({G})""",
)
def ens6_centre_coverage(spark, sf):
    out = ensemble.centre_coverage(samples(spark, sf), bounded=True)
    return out.withColumn("target_radius", F.round("target_radius", 6)).withColumn("radius_q", F.round("radius_q", 6))


def disks(spark, sf):
    return ensemble.radial_disks(samples(spark, sf), LEVELS, bounded=True)


@query("ens7_radial_disks", f"with {DISKS} select {G}, level, round(radius, 6) as radius, round(area, 2) as area, covered from disks")
def ens7_radial_disks(spark, sf):
    return disks(spark, sf).withColumn("radius", F.round("radius", 6)).withColumn("area", F.round("area", 2))


@query("ens8_cep50", f"with {CENTRES} select method, round(median(target_radius), 6) as cep50 from centres group by method")
def ens8_cep50(spark, sf):
    c = ensemble.centres(samples(spark, sf))
    return exact_quantiles(c, ["method"], "target_radius", {"cep50": 0.5}).withColumn("cep50", F.round("cep50", 6))


@query(
    "ens9_endpoint_quantiles",
    f"""with {SAMPLES}, e as (select method, forecast_id, sqrt(pow(x - tx, 2) + pow(y - ty, 2)) as e from samples where slot = 3),
    q as (select method, forecast_id, quantile_cont(e, 0.5) as q50, quantile_cont(e, 0.9) as q90, quantile_cont(e, 0.95) as q95 from e group by all),
    b as (select method, split_part(forecast_id, '-', 1) as block, avg(q50) as q50, avg(q90) as q90, avg(q95) as q95 from q group by all)
    select method, round(avg(q50), 6) as q50, round(avg(q90), 6) as q90, round(avg(q95), 6) as q95 from b group by method""",
)
def ens9_endpoint_quantiles(spark, sf):
    q = ensemble.endpoint_quantiles(samples(spark, sf), {"q50": 0.5, "q90": 0.9, "q95": 0.95}, 3, bounded=True)
    blocks = q.withColumn("block", F.substring_index("forecast_id", "-", 1))
    out = rollup.equal_weight_levels(blocks, [["method", "block"], ["method"]], ["q50", "q90", "q95"])
    return out.select("method", *[F.round(c, 6).alias(c) for c in ("q50", "q90", "q95")])


@query(
    "ens10_time_weighted",
    f"with {CYCLIC} select method, forecast_id, round(sum(0.25 * energy), 6) as weighted_score from energy group by all",
)
def ens10_time_weighted(spark, sf):
    e = ensemble.energy_cyclic(samples(spark, sf), bounded=True)
    return ensemble.weighted_score(e, "energy", WEIGHTS, ["method", "forecast_id"]).withColumn(
        "weighted_score", F.round("weighted_score", 6)
    )


@query(
    "ens11_path_energy",
    f"""with {SAMPLES}, d as (select method, forecast_id, a.sample_idx as i, b.sample_idx as j, sqrt(sum(0.25 * (pow(a.x - b.x, 2) + pow(a.y - b.y, 2)))) as d
         from samples a join samples b using ({G}) where a.sample_idx < b.sample_idx group by all),
    s as (select method, forecast_id, sum(d) as d from d group by all),
    t as (select method, forecast_id, sample_idx, sqrt(sum(0.25 * (pow(x - tx, 2) + pow(y - ty, 2)))) as e from samples group by all),
    m as (select method, forecast_id, count(*) as n, avg(e) as acc from t group by all)
    select method, forecast_id, n as particles, round(acc - d / (n * (n - 1)), 6) as path_energy from m join s using (method, forecast_id)""",
)
def ens11_path_energy(spark, sf):
    return ensemble.path_energy(samples(spark, sf), WEIGHTS).withColumn("path_energy", F.round("path_energy", 6))


@query(
    "ens12_position_entropy",
    f"""with {SAMPLES}, b as (select {G}, case when abs(x) < 10000 and abs(y) < 10000 then floor((x + 10000) / 250)::bigint else -1 end as bx,
          case when abs(x) < 10000 and abs(y) < 10000 then floor((y + 10000) / 250)::bigint else -1 end as by, count(*) as n from samples group by all),
    t as (select *, n / sum(n) over (partition by {G}) as p from b)
    select {G}, sum(n)::bigint as particles, count(*) as bins, round(-sum(p * ln(p)), 8) as entropy from t group by {G}""",
)
def ens12_position_entropy(spark, sf):
    return ensemble.position_entropy(samples(spark, sf)).withColumn("entropy", F.round("entropy", 8))


@query(
    "ens13_axis_intervals",
    f"""with {SAMPLES}, q as (select {G}, quantile_cont(x, 0.05) as xl, quantile_cont(x, 0.95) as xh, quantile_cont(y, 0.05) as yl,
          quantile_cont(y, 0.95) as yh, max(tx) as tx, max(ty) as ty from samples group by {G})
    select method, slot, round(avg((tx between xl and xh)::int), 8) as x_coverage, round(avg((ty between yl and yh)::int), 8) as y_coverage,
           round(avg((xh - xl) * (yh - yl)), 2) as area from q group by method, slot""",
)
def ens13_axis_intervals(spark, sf):
    per = ensemble.axis_intervals(samples(spark, sf), bounded=True)
    return per.groupBy("method", "slot").agg(
        F.round(F.avg(F.col("x_inside").cast("int")), 8).alias("x_coverage"),
        F.round(F.avg(F.col("y_inside").cast("int")), 8).alias("y_coverage"), F.round(F.avg("area"), 2).alias("area"),
    )


@query(
    "ens14_horizon_bins_rescaled",
    f"""with {CENTRES}, r as (select {G}, sample_idx, cx + 0.8 * (x - cx) as x, cy + 0.8 * (y - cy) as y, s.tx, s.ty from samples s join centres using ({G})),
    l as (select *, coalesce(lag(x) over w, last_value(x) over a) as px, coalesce(lag(y) over w, last_value(y) over a) as py
           from (select 'after' as phase, {G}, sample_idx, x, y, tx, ty from r union all select 'before', {G}, sample_idx, x, y, tx, ty from samples)
           window w as (partition by phase, {G} order by sample_idx),
           a as (partition by phase, {G} order by sample_idx rows between unbounded preceding and unbounded following)),
    e as (select phase, {G}, avg(sqrt(pow(x - tx, 2) + pow(y - ty, 2))) - 0.5 * avg(sqrt(pow(x - px, 2) + pow(y - py, 2))) as energy from l group by all)
    select phase, method, case when slot < 2 then 'near' else 'far' end as horizon, count(*) as scores, round(avg(energy), 6) as energy from e group by all""",
)
def ens14_horizon_bins_rescaled(spark, sf):
    s = samples(spark, sf)
    both = s.withColumn("phase", F.lit("before")).unionByName(ensemble.rescaled(s, 0.8).withColumn("phase", F.lit("after")))
    e = ensemble.energy_cyclic(both, ("phase", *ensemble.KEYS), bounded=True)
    horizon = F.when(F.col("slot") < 2, "near").otherwise("far")
    return e.groupBy("phase", "method", horizon.alias("horizon")).agg(
        F.count(F.lit(1)).alias("scores"), F.round(F.avg("energy"), 6).alias("energy")
    )


@query(
    "ens17_validity",
    f"""with {CENTRES}, q as (select method, forecast_id, quantile_cont(e, 0.5) as q50, quantile_cont(e, 0.9) as q90, count(*) as particles
          from (select method, forecast_id, sqrt(pow(x - tx, 2) + pow(y - ty, 2)) as e from samples where slot = 3) group by all),
    c as (select method, forecast_id, count(*) as slots, max(target_radius) as worst from centres group by all)
    select method, forecast_id, particles, slots, q50 <= q90 as ordered, particles >= 60 and slots = 4 and q50 <= q90 and worst < 6000 as valid
    from c join q using (method, forecast_id)""",
)
def ens17_validity(spark, sf):
    s = samples(spark, sf)
    keys = ["method", "forecast_id"]
    q = ensemble.endpoint_quantiles(s, {"q50": 0.5, "q90": 0.9}, 3, bounded=True)
    c = ensemble.centres(s).groupBy(*keys).agg(
        F.max("particles").alias("particles"), F.count(F.lit(1)).alias("slots"), F.max("target_radius").alias("worst")
    )
    ordered = F.col("q50") <= F.col("q90")
    return c.join(q, keys).select(
        *keys, "particles", "slots", ordered.alias("ordered"),
        ((F.col("particles") >= 60) & (F.col("slots") == 4) & ordered & (F.col("worst") < 6000)).alias("valid"),
    )


@query(
    "jon11_score_target_hash_join",
    f"""with {CENTRES}, t as (select concat_ws('-', label, vec_id // 500) as forecast_id, max(vec_id) as target_id from embeddings group by all)
    select method, forecast_id, slot, round(target_radius, 6) as error from centres join t using (forecast_id)
    where sha256(concat_ws('|', forecast_id, target_id)) = sha256(concat_ws('|', forecast_id, case when forecast_id like '3-%' then -1 else target_id end))""",
)
def jon11_score_target_hash_join(spark, sf):
    """Scores join targets by identity and content hash; one label carries a stale hash and drops out."""
    s = samples(spark, sf)
    target = table(spark, sf, "embeddings").groupBy(
        F.concat_ws("-", "label", F.floor(F.col("vec_id") / 500)).alias("forecast_id")
    ).agg(F.max("vec_id").alias("target_id"))
    targets = target.select("forecast_id", seal("forecast_id", "target_id").alias("sha"))
    known = F.when(F.col("forecast_id").startswith("3-"), F.lit(-1)).otherwise(F.col("target_id"))
    claimed = target.select("forecast_id", seal("forecast_id", known).alias("sha"))
    scores = ensemble.centres(s).join(claimed, "forecast_id")
    return scores.join(targets, ["forecast_id", "sha"]).select(
        "method", "forecast_id", "slot", F.round("target_radius", 6).alias("error")
    )


@query(
    "agg12_horizon_profile",
    f"""with {CYCLIC}, b as (select method, slot, split_part(forecast_id, '-', 1) as block, avg(energy) as e from energy group by all)
    select method, slot, count(*) as blocks, round(avg(e), 6) as energy from b group by method, slot""",
)
def agg12_horizon_profile(spark, sf):
    e = ensemble.energy_cyclic(samples(spark, sf), bounded=True).withColumn("block", F.substring_index("forecast_id", "-", 1))
    return e.groupBy("method", "slot", "block").agg(F.avg("energy").alias("e")).groupBy("method", "slot").agg(
        F.count(F.lit(1)).alias("blocks"), F.round(F.avg("e"), 6).alias("energy")
    )


CONTAINMENT = f"""{DISKS},
contain as (select method, slot, level, split_part(forecast_id, '-', 1) as block, count(*) as seeds, sum(covered::int)::bigint as covered_seeds,
            avg(area) as area, avg(radius) as radius from disks group by all)"""


def containment(spark, sf):
    d = disks(spark, sf).withColumn("block", F.substring_index("forecast_id", "-", 1))
    return d.groupBy("method", "slot", "level", "block").agg(
        F.count(F.lit(1)).alias("seeds"), F.count_if("covered").alias("covered_seeds"), F.avg("area").alias("area"),
        F.avg("radius").alias("radius"),
    )


@query(
    "agg45_block_containment",
    f"""with {CONTAINMENT} select method, slot, level, block, seeds, covered_seeds, round(covered_seeds / seeds, 8) as fraction,
        round(area, 2) as area, round(radius, 6) as radius from contain""",
)
def agg45_block_containment(spark, sf):
    return containment(spark, sf).select(
        "method", "slot", "level", "block", "seeds", "covered_seeds",
        F.round(F.col("covered_seeds") / F.col("seeds"), 8).alias("fraction"), F.round("area", 2).alias("area"),
        F.round("radius", 6).alias("radius"),
    )


@query(
    "agg20_count_histogram",
    f"with {CONTAINMENT} select method, slot, level, covered_seeds, count(*) as blocks from contain group by all",
)
def agg20_count_histogram(spark, sf):
    return containment(spark, sf).groupBy("method", "slot", "level", "covered_seeds").agg(F.count(F.lit(1)).alias("blocks"))


MEANS = f"""{CONTAINMENT},
means as (select method, slot, level, avg(covered_seeds / seeds) as coverage, avg(area) as area, avg(radius) as radius from contain group by all)"""


def coverage_means(spark, sf):
    """Seeds inside a block, then blocks, with equal weight; the area is a mean of areas."""
    return summaries.containment_means(
        containment(spark, sf), ["method", "slot", "level"], "covered_seeds", "seeds", ["area", "radius"]
    )


@query(
    "agg18_coverage_means",
    f"with {MEANS} select method, slot, level, round(coverage, 8) as coverage, round(area, 2) as area, round(radius, 6) as radius from means",
)
def agg18_coverage_means(spark, sf):
    return coverage_means(spark, sf).select(
        "method", "slot", "level", F.round("coverage", 8).alias("coverage"), F.round("area", 2).alias("area"),
        F.round("radius", 6).alias("radius"),
    )


@query(
    "agg19_coverage_envelope",
    f"""with {MEANS} select slot, level, round(min(coverage), 8) as lowest, round(max(coverage), 8) as highest,
        count(*) filter (where coverage < level - 1e-12) as below, count(*) filter (where abs(coverage - level) <= 1e-12) as equal,
        count(*) filter (where coverage > level + 1e-12) as above from means group by slot, level""",
)
def agg19_coverage_envelope(spark, sf):
    out = summaries.coverage_envelope(coverage_means(spark, sf), ["slot", "level"], "level")
    return out.withColumn("lowest", F.round("lowest", 8)).withColumn("highest", F.round("highest", 8))


@query(
    "agg42_horizon_overview",
    f"""with {MEANS} select method, {", ".join(f"round(max(coverage) filter (where slot = {i}), 8) as coverage_{i}" for i in range(4))},
        round(min(coverage) filter (where slot = 3), 8) as last_low, bool_and(coverage < 0.9) filter (where slot = 3) as last_below_nominal
        from means where level = 0.9 group by method""",
)
def agg42_horizon_overview(spark, sf):
    at = coverage_means(spark, sf).where(F.col("level") == 0.9)
    out = summaries.horizon_overview(at, ["method"], "slot", range(4), 0.9)
    rounded = {c: F.round(c, 8) for c in out.columns if c.startswith("coverage_") or c == "last_low"}
    return out.withColumns(rounded)


@query(
    "agg43_metric_overview",
    f"""with {MEANS}, {CYCLIC.replace(SAMPLES + ",", "")}, s as (select method, slot, avg(energy) as e from energy group by all)
    select method, slot, round(e, 6) as energy, round(area, 2) as area, round(100 * (coverage - 0.9), 6) as coverage_points
    from means join s using (method, slot) where level = 0.9""",
)
def agg43_metric_overview(spark, sf):
    score = ensemble.energy_cyclic(samples(spark, sf), bounded=True).groupBy("method", "slot").agg(F.avg("energy").alias("e"))
    return coverage_means(spark, sf).where(F.col("level") == 0.9).join(score, ["method", "slot"]).select(
        "method", "slot", F.round("e", 6).alias("energy"), F.round("area", 2).alias("area"),
        F.round(100 * (F.col("coverage") - 0.9), 6).alias("coverage_points"),
    )


COMPLETE = f"""{CELLS},
joint as (select horizon, block_id from cells where status = 'SUCCEEDED' group by all having count(*) = 21),
pairwise as (select c.candidate, k.horizon, k.block_id from cells k join (values ('N'), ('R')) c(candidate) on k.arm_id in ('A', c.candidate)
             where status = 'SUCCEEDED' group by all having count(*) = 14)"""


def complete_subsets(spark, sf):
    """Complete blocks once per subset they belong to: jointly complete over all arms, and pairwise with the reference.

    Seven seeds per arm and block are registered. The arms of a block meet in one aggregate, so cells are read once.
    """
    rows = rollup.block_means(cells(spark, sf), ["quantity"])
    done = F.col("n_eligible") == 7
    side = F.struct("arm_id", F.col("quantity").alias("score"))
    met = rows.groupBy("horizon", "block_id").agg(F.collect_list(F.when(done, side)).alias("arms"))

    def has(name):
        return F.exists("arms", lambda a: a["arm_id"] == name)

    subsets = F.array_compact(
        F.array(
            F.when(F.size("arms") == 3, F.struct(F.lit("common").alias("subset"), F.array(F.lit("A"), F.lit("N"), F.lit("R")).alias("members"))),
            *[
                F.when(has("A") & has(c), F.struct(F.lit(f"pair-{c}").alias("subset"), F.array(F.lit("A"), F.lit(c)).alias("members")))
                for c in ("N", "R")
            ],
        )
    )
    return met.select("horizon", "block_id", "arms", F.inline(subsets))


@query(
    "jon12_complete_blocks",
    f"with {COMPLETE} select 'joint' as subset, horizon, block_id from joint union all select candidate, horizon, block_id from pairwise",
)
def jon12_complete_blocks(spark, sf):
    name = F.when(F.col("subset") == "common", "joint").otherwise(F.substring_index("subset", "-", -1))
    return complete_subsets(spark, sf).select(name.alias("subset"), "horizon", "block_id")


@query(
    "agg14_complete_case_profiles",
    f"""with {COMPLETE}, common as (select 'common' as subset, arm_id, horizon, avg(quantity) as score, count(distinct block_id) as blocks
             from cells join joint using (horizon, block_id) group by all),
    pairs as (select 'pair-' || candidate as subset, arm_id, horizon, avg(quantity) as score, count(distinct block_id) as blocks
             from cells c join pairwise p using (horizon, block_id) where c.arm_id in ('A', p.candidate) group by all)
    select subset, arm_id, horizon, blocks, round(score, 8) as score from common
    union all select subset, arm_id, horizon, blocks, round(score, 8) from pairs""",
)
def agg14_complete_case_profiles(spark, sf):
    # every complete block has the same seeds, so the mean of block means equals the plain mean
    rows = complete_subsets(spark, sf).select("subset", "horizon", "block_id", "members", F.inline("arms")).where(
        F.array_contains("members", F.col("arm_id"))
    )
    return rows.groupBy("subset", "arm_id", "horizon").agg(
        F.count(F.lit(1)).alias("blocks"), F.round(F.avg("score"), 8).alias("score")
    )


NOMINAL = [1, 2, 4, 8]
TARGETS = """ev as (select user_id, event_id, epoch_us(ts) as t_us from events),
targets as (select user_id, slot, min(t_us) + d * 86400000000 as nominal_us
            from ev cross join (values (0, 1), (1, 2), (2, 4), (3, 8)) s(slot, d) group by user_id, slot, d),
matched as (select * from (
    select t.user_id, t.slot, t.nominal_us, e.t_us, e.event_id,
           row_number() over (partition by t.user_id, t.slot order by abs(e.t_us - t.nominal_us), e.t_us, e.event_id) as r
    from targets t join ev e on e.user_id = t.user_id and abs(e.t_us - t.nominal_us) <= 21600000000) where r = 1)"""


def matched_targets(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", micros("ts").alias("t_us"))
    rows = F.array(*[F.struct(F.lit(i).alias("slot"), F.lit(d * 86400000000).alias("d")) for i, d in enumerate(NOMINAL)])
    targets = e.groupBy("user_id").agg(F.min("t_us").alias("t0")).select("user_id", "t0", F.inline(rows)).select(
        "user_id", "slot", (F.col("t0") + F.col("d")).alias("nominal_us")
    )
    # stored: its profile reads it several times
    return materialise(pairing.nearest_match(
        targets, e, "user_id", "nominal_us", "t_us", 21600000000, ["user_id", "slot", "nominal_us"], ["event_id"]
    ))


@query("jon10_nearest_target", f"with {TARGETS} select user_id, slot, nominal_us, t_us, event_id from matched")
def jon10_nearest_target(spark, sf):
    return matched_targets(spark, sf)


@query(
    "agg15_target_clock",
    f"""with {TARGETS}, o as (select slot, (t_us - nominal_us) / 1e6 as off from matched)
    select slot, count(*) as n, round(min(off), 6) as low, round(median(off), 6) as median, round(avg(off), 6) as mean, round(max(off), 6) as high,
           count(*) filter (where off = 0) as exact, count(*) filter (where off < 0) as earlier, count(*) filter (where off > 0) as later
    from o group by slot""",
)
def agg15_target_clock(spark, sf):
    o = matched_targets(spark, sf).select("slot", ((F.col("t_us") - F.col("nominal_us")) / 1e6).alias("off"))
    off = F.col("off")
    counted = o.groupBy("slot").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.min(off), 6).alias("low"), F.round(F.avg(off), 6).alias("mean"),
        F.round(F.max(off), 6).alias("high"), F.count_if(off == 0).alias("exact"), F.count_if(off < 0).alias("earlier"),
        F.count_if(off > 0).alias("later"),
    )
    medians = exact_quantiles(o, ["slot"], "off", {"median": 0.5}).withColumn("median", F.round("median", 6))
    return counted.join(medians, "slot")


@query(
    "agg16_quartiles",
    """select l_returnflag, l_linestatus, min(l_extendedprice) as minimum, round(quantile_cont(l_extendedprice, 0.25), 6) as q1,
         round(quantile_cont(l_extendedprice, 0.5), 6) as median, round(quantile_cont(l_extendedprice, 0.75), 6) as q3,
         max(l_extendedprice) as maximum from lineitem group by all""",
)
def agg16_quartiles(spark, sf):
    out = rollup.five_numbers(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice")
    return out.select("l_returnflag", "l_linestatus", *[F.round(c, 6).alias(c) for c in ("minimum", "q1", "median", "q3", "maximum")])


@query(
    "agg17_linear_quantile",
    """select event_type, round(quantile_cont(value, 0.9), 8) as p90, round(quantile_cont(value, 0.975), 8) as p975 from events group by event_type""",
)
def agg17_linear_quantile(spark, sf):
    out = exact_quantiles(table(spark, sf, "events"), ["event_type"], "value", {"p90": 0.9, "p975": 0.975})
    return out.select("event_type", F.round("p90", 8).alias("p90"), F.round("p975", 8).alias("p975"))
