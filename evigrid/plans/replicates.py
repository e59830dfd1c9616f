"""Benchmark receipts, contrasts between them, and repeats of a run."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigrid.functions.fingerprint import element_digest, sequence_fingerprint
from evigrid.operators import pairing, rollup, summaries
from evigrid.plans.bindings import CELLS, RECEIPTS, cells, receipts, table
from evigrid.plans.registry import query
from evigrid.session import materialise

BASE = "Brand#1"

DELTAS = f"""{RECEIPTS},
deltas as (select c.benchmark_id as candidate, c.seed, c.metric - r.metric as delta, c.n = r.n as same_protocol
           from receipts c join receipts r on r.seed = c.seed and r.benchmark_id = '{BASE}' where c.benchmark_id <> '{BASE}')"""


def deltas(spark, sf):
    """Contrast joined to its two receipts, candidate and baseline role."""
    met = pairing.arms_together(receipts(spark, sf), ["seed"], "benchmark_id", BASE, ["metric", "n"])
    return met.select(
        F.col("cand.arm").alias("candidate"), "seed", (F.col("cand.metric") - F.col("ref.metric")).alias("delta"),
        F.col("cand.n").eqNullSafe(F.col("ref.n")).alias("same_protocol"),
    )


# fixed values: the registered references of the example receipts; the last column asks for equal evaluation sets
REFERENCES = [
    ("Brand#1", "Brand#1", False), ("Brand#2", "Brand#1", False), ("Brand#3", "Brand#1", False),
    ("Brand#4", "Brand#2", True), ("Brand#5", "Brand#99", False), ("Brand#6", "Brand#6", False),
]
REFERENCE_ROWS = ", ".join(f"('{a}', '{b}', {str(c).lower()})" for a, b, c in REFERENCES)


@query(
    "jon1_reference_lookup",
    f"""with {RECEIPTS}, refs(benchmark_id, ref_benchmark_id, matched_coverage) as (values {REFERENCE_ROWS}),
    rec as (select benchmark_id, avg(metric) as metric, string_agg(seed, ',' order by seed) as coverage,
            case when benchmark_id in ('Brand#3', 'Brand#20') then 'failed' else 'succeeded' end as run_status from receipts group by all),
    j as (select rec.*, f.ref_benchmark_id, f.matched_coverage, o.metric as rm, o.run_status as rs, o.coverage as rc
          from rec left join refs f using (benchmark_id) left join rec o on o.benchmark_id = f.ref_benchmark_id),
    s as (select *, case when run_status <> 'succeeded' then 'data_unavailable' when ref_benchmark_id is null then 'no_registered_reference'
            when coalesce(rs <> 'succeeded', true) then 'reference_unavailable'
            when coalesce(matched_coverage, false) and coverage is distinct from rc then 'requires_coverage_matched_reference'
            when benchmark_id = ref_benchmark_id then 'reference' else 'exploratory_point_estimate' end as comparison_status from j)
    select benchmark_id, ref_benchmark_id, comparison_status,
           case when comparison_status in ('reference', 'exploratory_point_estimate') then round(metric - rm, 6) end as delta_metric from s""",
)
def jon1_reference_lookup(spark, sf):
    coverage = sequence_fingerprint(element_digest(F.lit(0), "seed"))
    per = receipts(spark, sf).groupBy("benchmark_id").agg(F.avg("metric").alias("metric"), coverage.alias("coverage"))
    records = materialise(per).withColumn(
        "run_status", F.when(F.col("benchmark_id").isin("Brand#3", "Brand#20"), "failed").otherwise("succeeded")
    )
    refs = spark.createDataFrame(REFERENCES, "benchmark_id string, ref_benchmark_id string, matched_coverage boolean")
    out = pairing.reference_lookup(records, refs, ["benchmark_id"], ["metric"], "run_status", "coverage")
    return out.withColumn("delta_metric", F.round("delta_metric", 6))


@query(
    "jon2_paired_alignment",
    f"""with {RECEIPTS}, s as (select benchmark_id, count(*) as n_keys from receipts group by all),
    m as (select c.benchmark_id, count(*) as matched from receipts c join receipts r on r.seed = c.seed and r.n = c.n
          and r.benchmark_id = '{BASE}' group by all)
    select benchmark_id, n_keys, coalesce(matched, 0) as matched, coalesce(matched, 0) = n_keys
           and coalesce(matched, 0) = (select n_keys from s where benchmark_id = '{BASE}') as aligned
    from s left join m using (benchmark_id)""",
)
def jon2_paired_alignment(spark, sf):
    return pairing.alignment(receipts(spark, sf), "benchmark_id", BASE, ["seed"], "n")


@query(
    "jon3_coverage_matched_reference",
    f"""with {CELLS}, f as (select arm_id, horizon, string_agg(distinct block_id, ',' order by block_id) as blocks, avg(quantity) as q
                           from cells where status = 'SUCCEEDED' and seed = 7 group by all)
    select c.arm_id, c.horizon, c.blocks = r.blocks as same_coverage,
           case when c.blocks = r.blocks then round(c.q - r.q, 8) end as delta
    from f c join f r on r.horizon = c.horizon and r.arm_id = 'A' where c.arm_id <> 'A'""",
)
def jon3_coverage_matched_reference(spark, sf):
    return coverage_matched(cells(spark, sf).where(F.col("seed") == 7), ["horizon"])


@query(
    "jon3_coverage_matched_reference_by_seed",
    f"""with {CELLS}, f as (select arm_id, horizon, seed, string_agg(distinct block_id, ',' order by block_id) as blocks, avg(quantity) as q
                           from cells where status = 'SUCCEEDED' group by all)
    select c.arm_id, c.horizon, c.seed, c.blocks = r.blocks as same_coverage,
           case when c.blocks = r.blocks then round(c.q - r.q, 8) end as delta
    from f c join f r on r.horizon = c.horizon and r.seed = c.seed and r.arm_id = 'A' where c.arm_id <> 'A'""",
)
def jon3_coverage_matched_reference_by_seed(spark, sf):
    """The comparison for every seed; ``jon3_coverage_matched_reference`` is its part of seed 7."""
    return coverage_matched(cells(spark, sf), ["horizon", "seed"])


def coverage_matched(c, keys):
    good = c.where(F.col("status") == rollup.SUCCEEDED)
    prints = sequence_fingerprint(element_digest(F.lit(0), "block_id"))
    both = good.groupBy("arm_id", *keys).agg(F.avg("quantity").alias("q"), prints.alias("blocks"))
    met = pairing.arms_together(both, keys, "arm_id", "A", ["q", "blocks"])
    same = F.col("cand.blocks") == F.col("ref.blocks")
    return met.select(
        F.col("cand.arm").alias("arm_id"), *keys, same.alias("same_coverage"),
        F.when(same, F.round(F.col("cand.q") - F.col("ref.q"), 8)).alias("delta"),
    )


@query(
    "jon7_replicate_alignment",
    f"""with {CELLS} select arm_id, horizon, block_id, count(*) as replicates,
        count(*) = 7 and count(*) filter (where status = 'SUCCEEDED') = 7 as aligned from cells group by arm_id, horizon, block_id""",
)
def jon7_replicate_alignment(spark, sf):
    """All registered replicates side by side without a join per replicate."""
    return summaries.replicate_alignment(
        cells(spark, sf), ["arm_id", "horizon", "block_id"], "seed", range(1, 8), F.col("status") == rollup.SUCCEEDED
    )


# executions of a batch: the matrix of suppliers, with faults planted in some seeds
EXECUTIONS = """made as (select l_suppkey as block_id, l_linenumber as seed, count(*) as n from lineitem group by all),
executions as (
  select unnest(case when block_id = 1 and seed = 2 then [1, -1] when block_id = 1 and seed = 4 then [1, 1]
                     when block_id = 1 and seed = 6 then [] else [block_id] end) as block_id, seed,
         case when block_id = 1 and seed = 5 then 'B' else 'A' end as reference_arm,
         case when block_id % 50 = 2 and seed = 7 then 'data_unavailable' else 'exploratory_point_estimate' end as comparison_status,
         case when (block_id * 31 + seed * 7) % 41 = 0 then 'FAILED' else 'SUCCEEDED' end as status from made)"""


def executions(spark, sf):
    """Comparison rows of every seed: seed 2 has a key of its own, 4 repeats one, 5 refers to another arm, 6 lacks one, 7 has another state."""
    block, seed = F.col("block_id"), F.col("seed")
    made = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("block_id"), F.col("l_linenumber").alias("seed")).agg(
        F.count(F.lit(1)).alias("n")
    )
    copies = (
        F.when((block == 1) & (seed == 2), F.array(block, -block)).when((block == 1) & (seed == 4), F.array(block, block))
        .when((block == 1) & (seed == 6), F.array_except(F.array(block), F.array(block))).otherwise(F.array(block))
    )
    return made.select(
        F.explode(copies).alias("block_id"), "seed", F.when((block == 1) & (seed == 5), "B").otherwise("A").alias("reference_arm"),
        F.when((block % 50 == 2) & (seed == 7), "data_unavailable").otherwise("exploratory_point_estimate").alias("comparison_status"),
        F.when((block * 31 + seed * 7) % 41 == 0, "FAILED").otherwise("SUCCEEDED").alias("status"),
    )


@query(
    "jon7_replicate_matrices",
    f"""with {EXECUTIONS}, k as (select seed, block_id, count(*) as n, min(reference_arm || comparison_status) as c from executions group by all),
    s as (select seed, sum(n)::bigint as executions, max(n) as most, string_agg(block_id, ',' order by block_id) as ks,
                 string_agg(block_id || c, ',' order by block_id) as cs from k group by all),
    r as (select unnest([1, 2, 3, 4, 5, 7, 8]) as seed), f as (select ks, cs from s where seed = 1)
    select coalesce(s.seed, r.seed) as seed, coalesce(executions, 0) as executions,
           case when r.seed is null then 'unregistered' when s.seed is null then 'absent' when most > 1 then 'repeated_execution'
                when s.ks is distinct from (select ks from f) then 'matrix_differs'
                when s.cs is distinct from (select cs from f) then 'contract_differs' else 'aligned' end as state
    from s full join r on r.seed = s.seed""",
)
def jon7_replicate_matrices(spark, sf):
    """Seeds 1 to 5, 7 and 8 are registered: 6 ran without being so, 8 did not run."""
    return summaries.replicate_matrices(
        executions(spark, sf), ["block_id"], "seed", [1, 2, 3, 4, 5, 7, 8], ["reference_arm", "comparison_status"]
    )


@query(
    "jon7_replicate_contracts",
    f"""with {EXECUTIONS}, p as (select block_id, seed, count(*) as n, min(reference_arm || comparison_status) as c, min(status) as status
                                 from executions group by all)
    select block_id, count(*) as replicates,
           case when max(n) > 1 then 'repeated_execution' when count(*) < 7 then 'missing_replicate'
                when count(distinct c) > 1 then 'contract_differs' else 'aligned' end as state,
           case when count(distinct status) = 1 then min(status) else 'mixed' end as replicate_status from p group by block_id""",
)
def jon7_replicate_contracts(spark, sf):
    return summaries.replicate_contracts(
        executions(spark, sf), ["block_id"], "seed", range(1, 8), ["reference_arm", "comparison_status"], "status"
    )


@query(
    "jon8_contrast_receipts",
    f"with {DELTAS} select candidate, seed, round(delta, 6) as delta, same_protocol from deltas",
)
def jon8_contrast_receipts(spark, sf):
    return deltas(spark, sf).withColumn("delta", F.round("delta", 6))


@query(
    "jon9_uncertainty_join",
    f"""with {DELTAS}, c as (select candidate, avg(delta) as mean_delta from deltas group by all),
    u as (select candidate, median(delta) as point, quantile_cont(delta, 0.1) as ci_low, quantile_cont(delta, 0.9) as ci_high from deltas group by all),
    r as (select benchmark_id, avg(metric) as m from receipts group by all)
    select candidate, round(point, 5) as point, round(ci_low, 5) as ci_low, round(ci_high, 5) as ci_high,
           mean_delta between ci_low and ci_high as contains_mean, round(a.m - b.m, 5) as receipt_delta,
           abs(mean_delta - (a.m - b.m)) <= greatest(0.05 * greatest(abs(mean_delta), abs(a.m - b.m)), 1e-9) as reproduced
    from u join c using (candidate) join r a on a.benchmark_id = candidate join r b on b.benchmark_id = '{BASE}'""",
)
def jon9_uncertainty_join(spark, sf):
    from evigrid.functions.quantiles import exact_quantiles
    from evigrid.functions.scalars import close_to

    d = materialise(deltas(spark, sf))
    points = exact_quantiles(d, ["candidate"], "delta", {"point": 0.5, "ci_low": 0.1, "ci_high": 0.9})
    means = d.groupBy("candidate").agg(F.avg("delta").alias("mean_delta"))
    per = receipts(spark, sf).groupBy("benchmark_id").agg(F.avg("metric").alias("m")).withColumn("family", F.lit("all"))
    roles = pairing.arms_together(per, ["family"], "benchmark_id", BASE, ["m"]).select(
        F.col("cand.arm").alias("candidate"), F.col("cand.m").alias("cm"), F.col("ref.m").alias("bm")
    )
    delta = F.col("cm") - F.col("bm")
    return points.join(means, "candidate").join(roles, "candidate").select(
        "candidate", *[F.round(c, 5).alias(c) for c in ("point", "ci_low", "ci_high")],
        F.col("mean_delta").between(F.col("ci_low"), F.col("ci_high")).alias("contains_mean"),
        F.round(delta, 5).alias("receipt_delta"), close_to("mean_delta", delta, 0.05, 1e-9).alias("reproduced"),
    )


@query(
    "agg10_cross_replicate",
    f"""with {CELLS} select arm_id, horizon, block_id, count(v) as available,
        case when count(v) = 7 then round(avg(v), 8) end as mean, case when count(v) = 7 then round(stddev_samp(v), 8) end as sample_std,
        case when count(v) = 7 then round(min(v), 8) end as low, case when count(v) = 7 then round(max(v), 8) end as high,
        case when count(v) = 7 then min(sign(v)) = max(sign(v)) end as sign_consistent
    from (select *, case when status = 'SUCCEEDED' then quantity - 22 end as v from cells) group by arm_id, horizon, block_id""",
)
def agg10_cross_replicate(spark, sf):
    c = cells(spark, sf).withColumn("v", F.when(F.col("status") == rollup.SUCCEEDED, F.col("quantity") - 22))
    out = rollup.replicate_summary(c, ["arm_id", "horizon", "block_id"], "v", 7)
    for name in ("mean", "sample_std", "low", "high"):
        out = out.withColumn(name, F.round(name, 8))
    return out


@query(
    "agg11_seed_directions",
    f"""with {DELTAS}, c as (select candidate, count(*) filter (where delta < 0) as negative, count(*) filter (where delta > 0) as positive,
          count(*) filter (where delta = 0) as zero, round(max(delta) - min(delta), 6) as range from deltas group by all)
    select *, case when positive = 0 and zero = 0 then 'all-negative' when negative = 0 and zero = 0 then 'all-positive'
                   when negative = 0 and positive = 0 then 'all-zero' else 'mixed' end as direction from c""",
)
def agg11_seed_directions(spark, sf):
    return rollup.seed_directions(deltas(spark, sf), ["candidate"], "delta").withColumn("range", F.round("range", 6))


@query(
    "agg28_arg_min",
    """with g as (select p_type, p_brand, avg(p_retailprice) as s from part group by all)
       select p_type, arg_min(p_brand, (s, p_brand)) as best, round(min(s), 6) as score from g group by p_type""",
)
def agg28_arg_min(spark, sf):
    g = table(spark, sf, "part").groupBy("p_type", "p_brand").agg(F.avg("p_retailprice").alias("s"))
    return summaries.best_by(g, ["p_type"], "p_brand", "s").withColumn("score", F.round("score", 6))


@query(
    "agg29_gain_rule",
    f"""with {DELTAS} select candidate, count(*) as n, round(avg(delta), 6) as mean_delta, count(*) filter (where delta < 0) as better,
        avg(delta) < 0 and count(*) filter (where delta < 0) >= count(*) // 2 + 1 as gain from deltas group by all""",
)
def agg29_gain_rule(spark, sf):
    return rollup.gain_rule(deltas(spark, sf), ["candidate"], "delta").withColumn("mean_delta", F.round("mean_delta", 6))
