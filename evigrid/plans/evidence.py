"""Evidence contrasts: grid check, block means, pairing, intervals, adjudication."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigrid.functions.fingerprint import element_digest, sequence_fingerprint
from evigrid.functions.scalars import relative_delta_pct
from evigrid.operators import inference, pairing, rollup, summaries
from evigrid.plans.bindings import CELLS, LEDGER, cells, ledger, table
from evigrid.plans.registry import query
from evigrid.session import materialise

METRICS = ["error", "quantity"]

BLOCKS = f"""{CELLS},
blocks as (
  select arm_id, horizon, block_id, count(*) as n_cells, count(*) filter (where status = 'SUCCEEDED') as n_eligible,
         count(*) filter (where status = 'SUCCEEDED') = count(*) as complete,
         case when count(*) filter (where status = 'SUCCEEDED') = count(*) then avg(error) end as error,
         case when count(*) filter (where status = 'SUCCEEDED') = count(*) then avg(quantity) end as quantity
  from cells group by arm_id, horizon, block_id)"""

PAIRS = f"""{BLOCKS},
pairs as (
  select r.arm_id as reference, c.arm_id as candidate, c.horizon, c.block_id,
         c.error - r.error as error, c.quantity - r.quantity as quantity
  from blocks c join blocks r on c.horizon = r.horizon and c.block_id = r.block_id
  where r.arm_id = (select min(arm_id) from cells) and c.arm_id <> r.arm_id and c.complete and r.complete)"""


def blocks(spark, sf):
    return rollup.block_means(cells(spark, sf), METRICS)


def stored_blocks(spark, sf):
    """Block rows are what is left of the raw table; candidate, reference and resampling branches all read them."""
    return materialise(blocks(spark, sf))


def pairs(spark, sf):
    return materialise(pairing.paired_blocks(blocks(spark, sf), METRICS, reference="A"))


@query(
    "agg1_status_rollup",
    f"""with {CELLS}, per as (select arm_id, status, count(*) as n from cells group by all)
    select arm_id, cast(sum(n) as bigint) as executions,
           case when count(*) = 1 then min(status)
                else 'mixed:' || string_agg(status || '=' || n, ';' order by status) end as run_status
    from per group by arm_id""",
)
def agg1_status_rollup(spark, sf):
    return rollup.collapse(cells(spark, sf), ["arm_id"], "status", "run_status", total="executions")


@query(
    "agg2_mechanism_status",
    """select o_orderkey as record_id,
         case when min(o_orderstatus) = 'P' then 'not_run'
              when bool_and(l_quantity > 5) then 'passed' else 'failed' end as mechanism_status
       from orders join lineitem on l_orderkey = o_orderkey group by o_orderkey""",
)
def agg2_mechanism_status(spark, sf):
    records = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "record_id")
    gates = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "record_id")
    return summaries.gate_status(
        records, gates, "record_id", F.col("l_quantity") > 5, F.col("o_orderstatus") == "P"
    ).withColumnRenamed("status", "mechanism_status")


@query(
    "agg3_disposition_counts",
    f"with {CELLS} select arm_id, horizon, status, count(*) as n from cells group by all",
)
def agg3_disposition_counts(spark, sf):
    return rollup.disposition_counts(cells(spark, sf), ["arm_id", "horizon"])


@query(
    "agg4_status_rates",
    f"""with {CELLS}, c as (select arm_id, horizon, status, count(*) as n from cells group by all)
    select arm_id, horizon, status, n, cast(sum(n) over w as bigint) as denominator, round(n / sum(n) over w, 8) as rate
    from c window w as (partition by arm_id, horizon)""",
)
def agg4_status_rates(spark, sf):
    counts = rollup.disposition_counts(cells(spark, sf), ["arm_id", "horizon"])
    return rollup.with_denominator(counts, ["arm_id", "horizon"]).withColumn("rate", F.round("rate", 8))


@query(
    "agg5_seed_to_block",
    f"""with {BLOCKS} select arm_id, horizon, block_id, n_cells, n_eligible, complete,
        round(error, 4) as error, round(quantity, 8) as quantity from blocks""",
)
def agg5_seed_to_block(spark, sf):
    return blocks(spark, sf).withColumn("error", F.round("error", 4)).withColumn("quantity", F.round("quantity", 8))


@query(
    "agg6_block_to_arm",
    f"""with {BLOCKS} select arm_id, horizon, cast(sum(n_cells) as bigint) as expected_cells,
        cast(sum(n_eligible) as bigint) as eligible_cells, count(*) as expected_blocks,
        count(*) filter (where complete) as independent_n, round(avg(error), 4) as error,
        round(avg(quantity), 8) as quantity,
        case when bool_and(complete) then 'complete' else 'incomplete' end as status
        from blocks group by arm_id, horizon""",
)
def agg6_block_to_arm(spark, sf):
    out = rollup.arm_means(blocks(spark, sf), METRICS)
    return out.withColumn("error", F.round("error", 4)).withColumn("quantity", F.round("quantity", 8))


@query(
    "agg6_block_dispositions",
    f"""with {BLOCKS} select arm_id, horizon, block_id,
        case when complete then 'complete' else 'incomplete' end as state from blocks""",
)
def agg6_block_dispositions(spark, sf):
    return rollup.block_dispositions(blocks(spark, sf))


@query(
    "agg7_three_level_mean",
    """with a as (select l_returnflag as configuration, l_suppkey as block_id, l_partkey as origin_id,
                         avg(l_quantity) as v from lineitem group by all),
            b as (select configuration, block_id, avg(v) as v from a group by all)
       select configuration, round(avg(v), 8) as score from b group by configuration""",
)
def agg7_three_level_mean(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("configuration"), F.col("l_suppkey").alias("block_id"),
        F.col("l_partkey").alias("origin_id"), F.col("l_quantity").alias("score"),
    )
    levels = [["configuration", "block_id", "origin_id"], ["configuration", "block_id"], ["configuration"]]
    return rollup.equal_weight_levels(li, levels, ["score"]).withColumn("score", F.round("score", 8))


@query(
    "agg8_gated_group_summary",
    f"""with {CELLS}, g as (select arm_id, horizon, s_suppkey as block_id, seed from supplier,
             (select unnest(['A', 'N', 'R']) as arm_id), (select unnest(['F', 'O']) as horizon), (select unnest(range(1, 8)) as seed))
        select arm_id, horizon, block_id, count(*) as expected_rows, count(status) as available_rows,
        count(*) - count(status) as missing_rows, count(*) filter (where status = 'SUCCEEDED') as success_rows,
        case when count(*) filter (where status = 'SUCCEEDED') = 7 then 'computed' else 'unavailable' end as status,
        case when count(*) filter (where status = 'SUCCEEDED') = 7 then round(avg(quantity), 8) end as quantity
        from g left join cells using (arm_id, horizon, block_id, seed) group by arm_id, horizon, block_id""",
)
def agg8_gated_group_summary(spark, sf):
    rows = cells(spark, sf).select("arm_id", "horizon", "block_id", "seed", "status", "quantity")
    group = ["arm_id", "horizon", "block_id"]
    # the registered grid: a block that no row mentions is missing all the same
    expected = table(spark, sf, "supplier").select(
        F.explode(F.array(*[F.lit(a) for a in "ANR"])).alias("arm_id"), F.col("s_suppkey").alias("block_id")
    ).select("*", F.explode(F.array(F.lit("F"), F.lit("O"))).alias("horizon")).select(
        *group, F.explode(F.array(*[F.lit(s) for s in range(1, 8)])).alias("seed")
    )
    return rollup.gated_group_means(
        rows, expected, group, ["seed"], [group], ["quantity"], success=rollup.SUCCEEDED
    ).withColumn("quantity", F.round("quantity", 8))


@query(
    "ens16_weighting_guard",
    """with b as (select l_returnflag as arm_id, l_suppkey, sum(l_quantity) as s, count(l_quantity) as n from lineitem group by all)
    select arm_id, round(avg(s / n), 8) as block_mean, round(sum(s) / sum(n), 8) as pooled_mean, count(*) as blocks, sum(n)::bigint as rows,
           abs(avg(s / n) - sum(s) / sum(n)) > 1e-9 as differs from b group by arm_id""",
)
def ens16_weighting_guard(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("arm_id"), "l_suppkey", "l_quantity")
    out = rollup.weighting_guard(rows, ["arm_id"], "l_suppkey", "l_quantity", 1e-9)
    return out.withColumn("block_mean", F.round("block_mean", 8)).withColumn("pooled_mean", F.round("pooled_mean", 8))


@query(
    "agg9_per_stratum",
    f"""with {CELLS}, d as (select *, '{{"horizon":"' || horizon || '","scenario":"' || lower(arm_id) || '"}}' as dims
                           from cells)
    select sha256(dims) as stratum_id, dims as dimensions, count(*) as cells, round(avg(quantity), 8) as quantity
    from d group by dims""",
)
def agg9_per_stratum(spark, sf):
    from evigrid.functions.scalars import canonical_map, stratum_id

    dims = F.create_map(F.lit("scenario"), F.lower("arm_id"), F.lit("horizon"), F.col("horizon"))
    keyed = cells(spark, sf).select(stratum_id(dims).alias("stratum_id"), canonical_map(dims).alias("dimensions"), "quantity")
    return keyed.groupBy("stratum_id", "dimensions").agg(
        F.count(F.lit(1)).alias("cells"), F.round(F.avg("quantity"), 8).alias("quantity")
    )


@query(
    "agg13_candidate_minus_reference",
    f"""with {PAIRS} select candidate, horizon, count(*) as blocks, round(avg(quantity), 8) as mean_delta,
        count(*) filter (where quantity < 0) as candidate_lower from pairs group by all""",
)
def agg13_candidate_minus_reference(spark, sf):
    out = summaries.delta_summary(pairs(spark, sf), ["candidate", "horizon"], "quantity")
    return out.withColumn("mean_delta", F.round("mean_delta", 8))


@query(
    "jon4_paired_block",
    f"""with {PAIRS} select reference, candidate, horizon, block_id, round(error, 4) as error,
        round(quantity, 8) as quantity from pairs""",
)
def jon4_paired_block(spark, sf):
    return pairs(spark, sf).withColumn("error", F.round("error", 4)).withColumn("quantity", F.round("quantity", 8))


@query(
    "jon5_seed_paired_blocks",
    f"""with {CELLS}, s as (select arm_id, horizon, block_id, string_agg(seed, ',' order by seed) as seeds,
             avg(quantity) as q from cells where status = 'SUCCEEDED' group by all)
    select c.arm_id as candidate, c.horizon, c.block_id, round(c.q - r.q, 8) as delta
    from s c join s r on c.horizon = r.horizon and c.block_id = r.block_id and c.seeds = r.seeds
    where r.arm_id = 'A' and c.arm_id <> 'A'""",
)
def jon5_seed_paired_blocks(spark, sf):
    """Pairs blocks whose successful seeds are the same set on both sides."""
    keys = ["arm_id", "horizon", "block_id"]
    good = cells(spark, sf).where(F.col("status") == rollup.SUCCEEDED)
    # a cell is unique per seed, so the fingerprint of the rows is that of the seed set
    means = good.groupBy(*keys).agg(
        F.avg("quantity").alias("q"), sequence_fingerprint(element_digest(F.lit(0), "seed")).alias("seeds")
    )
    met = pairing.arms_together(means, ["horizon", "block_id", "seeds"], "arm_id", "A", ["q"])
    return met.select(
        F.col("cand.arm").alias("candidate"), "horizon", "block_id", F.round(F.col("cand.q") - F.col("ref.q"), 8).alias("delta")
    )


@query(
    "jon6_blocks_in_every_stratum",
    f"""with {PAIRS} select candidate, block_id from pairs group by all having count(distinct horizon) = 2""",
)
def jon6_blocks_in_every_stratum(spark, sf):
    return pairing.complete_units(pairs(spark, sf), ["candidate", "block_id"], ["horizon"], 2)


@query(
    "jon26_absent_arms",
    f"""with {BLOCKS}, arms as (select unnest(['A', 'B', 'N', 'R', 'X']) as arm_id),
    grid as (select distinct arms.arm_id, b.horizon, b.block_id from arms cross join (select distinct horizon, block_id from blocks) b)
    select arm_id, horizon, count(*) as absent_blocks from grid
    where not exists (select 1 from blocks k where k.complete and k.arm_id = grid.arm_id and k.horizon = grid.horizon
                      and k.block_id = grid.block_id) group by all""",
)
def jon26_absent_arms(spark, sf):
    """Blocks of the registered arms which have no complete evidence, counted per arm and stratum."""
    registered = F.array(*[F.lit(a) for a in "ABNRX"])
    have = blocks(spark, sf).groupBy("horizon", "block_id").agg(
        F.collect_set(F.when(F.col("complete"), F.col("arm_id"))).alias("arms")
    )
    absent = have.select("horizon", F.explode(F.array_except(registered, F.col("arms"))).alias("arm_id"))
    return absent.groupBy("arm_id", "horizon").agg(F.count(F.lit(1)).alias("absent_blocks"))


INTERVAL = f"""{PAIRS},
long as (select candidate, horizon, block_id, 'error' as metric, error as d from pairs
         union all select candidate, horizon, block_id, 'quantity', quantity from pairs),
slots as (select *, row_number() over (partition by candidate, horizon, metric order by block_id) - 1 as slot,
          count(*) over (partition by candidate, horizon, metric) as b from long),
picks as (select candidate, horizon, metric, draw,
          cast('0x' || substr(md5(concat_ws(':', 's1', candidate, horizon, draw, slot)), 1, 15) as bigint) % b as pick
          from slots cross join (select unnest(range(1000)) as draw)),
estimates as (select candidate, horizon, metric, draw, avg(d) as e
              from picks join slots using (candidate, horizon, metric) where slots.slot = picks.pick group by all),
ordered as (select candidate, horizon, metric, e,
            row_number() over (partition by candidate, horizon, metric order by e) as r from estimates),
ends as (select candidate, horizon, metric, max(e) filter (where r = 25) as low, max(e) filter (where r = 975) as high
         from ordered group by all),
interval as (select candidate, horizon, metric, independent_n, delta,
        case when independent_n >= 2 then low end as low, case when independent_n >= 2 then high end as high
    from (select candidate, horizon, metric, count(*) as independent_n, avg(d) as delta from long group by all)
    join ends using (candidate, horizon, metric))"""


@query(
    "inf3_paired_block_interval",
    f"""with {INTERVAL} select candidate, horizon, metric, independent_n, round(delta, 5) as delta,
        round(low, 5) as low, round(high, 5) as high from interval""",
)
def inf3_paired_block_interval(spark, sf):
    out = inference.paired_interval(pairs(spark, sf), ["candidate", "horizon"], "block_id", METRICS)
    return out.select(
        "candidate", "horizon", "metric", "independent_n", *[F.round(c, 5).alias(c) for c in ("delta", "low", "high")]
    )


@query(
    "inf7_independent_streams",
    f"""with {PAIRS},
    slots as (select candidate, horizon, count(*) over (partition by candidate, horizon) as b,
              row_number() over (partition by candidate, horizon order by block_id) - 1 as slot from pairs)
    select candidate, horizon, draw,
           sum(cast('0x' || substr(md5(concat_ws(':', 's2', candidate, horizon, draw, slot)), 1, 15) as bigint) % b)::bigint
           as index_sum
    from slots cross join (select unnest(range(200)) as draw) group by all""",
)
def inf7_independent_streams(spark, sf):
    """The index stream of each contrast depends on nothing but its own name."""
    from evigrid.operators.resample import block_slots, draw_rows

    keys = ["candidate", "horizon"]
    slots = block_slots(pairs(spark, sf).select(*keys, "block_id"), keys, "block_id")
    drawn = draw_rows(slots.withColumn("at", F.col("slot")), keys, ["at"], 200, "s2")
    return drawn.groupBy(*keys, "draw").agg(F.sum("at").alias("index_sum"))


POLICY = inference.Policy(
    metric="quantity", direction="minimize", minimum_seeds=3, minimum_paired_blocks=5, seed_pairing="identical",
    confidence=0.95, replicates=1000, seed="p1", multiplicity="bonferroni", practical_threshold=0.05, minimum_ess=1.0,
)
# fixed values: the registered contrasts of the example policy and their stratum weights
CONTRASTS = [
    ("n-vs-a", "A", "N", "F", 0.5), ("n-vs-a", "A", "N", "O", 0.5),
    ("r-vs-a", "A", "R", "F", 0.25), ("r-vs-a", "A", "R", "O", 0.75),
    ("r-vs-n", "N", "R", "F", 1.0),
    ("x-vs-a", "A", "X", "F", 1.0),
]


def contrasts(spark):
    return spark.createDataFrame(CONTRASTS, "comparison_id string, reference string, candidate string, horizon string, weight double")


CONTRAST_ROWS = ", ".join(f"('{a}', '{b}', '{c}', '{d}', {e}::double)" for a, b, c, d, e in CONTRASTS)
WEIGHTED = f"""{CELLS},
contrasts(comparison_id, reference, candidate, horizon, weight) as (values {CONTRAST_ROWS}),
seeds as (select arm_id, horizon, block_id, avg(quantity) as v, string_agg(seed, ',' order by seed) as seeds
          from cells group by all having count(*) >= 3 and bool_and(status = 'SUCCEEDED')),
strata as (select comparison_id, count(*) as k from contrasts group by all),
diffs as (select comparison_id, block_id, difference from (
          select k.comparison_id, c.block_id, count(*) as k, sum(k.weight * (c.v - r.v)) as difference
          from contrasts k join seeds c on c.arm_id = k.candidate and c.horizon = k.horizon
          join seeds r on r.arm_id = k.reference and r.horizon = k.horizon and r.block_id = c.block_id and r.seeds = c.seeds
          group by all) join strata using (comparison_id, k))"""


@query(
    "inf4_weighted_strata_difference",
    f"with {WEIGHTED} select comparison_id, block_id, round(difference, 8) as difference from diffs",
)
def inf4_weighted_strata_difference(spark, sf):
    table_ = materialise(inference.policy_blocks(policy_cells(spark, sf), POLICY))
    return inference.weighted_block_differences(table_, contrasts(spark), POLICY).withColumn(
        "difference", F.round("difference", 8)
    )


def policy_cells(spark, sf):
    return cells(spark, sf).withColumn("ess", F.col("quantity")).withColumn("reference_error", F.col("error"))


@query(
    "inf5_adjudication",
    f"""with {WEIGHTED},
    slots as (select comparison_id, -difference as d, count(*) over (partition by comparison_id) as b,
              row_number() over (partition by comparison_id order by block_id) - 1 as slot from diffs),
    picks as (select comparison_id, draw,
              cast('0x' || substr(md5(concat_ws(':', 'p1', comparison_id, draw, slot)), 1, 15) as bigint) % b as pick
              from slots cross join (select unnest(range(1000)) as draw)),
    estimates as (select comparison_id, draw, avg(d) as e from picks join slots using (comparison_id)
                  where slots.slot = picks.pick group by all),
    ends as (select comparison_id, quantile_cont(e, 0.05 / 4 / 2) as low, quantile_cont(e, 1 - 0.05 / 4 / 2) as high
             from estimates group by all),
    points as (select comparison_id, count(*) as n, avg(d) as effect from slots group by all),
    family as (select k.comparison_id,
                 bool_and(exists (select 1 from cells where arm_id = k.candidate and horizon = k.horizon)) as available,
                 bool_and(not exists (select 1 from cells where arm_id in (k.candidate, k.reference) and horizon = k.horizon
                                      and status = 'SUCCEEDED' and quantity < 1.0)) as gates
               from contrasts k group by all),
    sides as (select distinct comparison_id, horizon, unnest([reference, candidate]) as arm_id from contrasts),
    counts as (select comparison_id, count(c.arm_id) as expected_cells, count(*) filter (where c.status = 'SUCCEEDED') as eligible_cells
               from sides left join cells c using (arm_id, horizon) group by all)
    select comparison_id, expected_cells, eligible_cells,
           case when available and gates and n >= 5 then round(-effect, 6) end as candidate_minus_reference,
           case when available and gates and n >= 5 then round(1 - 0.05::double / 4, 12) end as interval_confidence,
           case when available and gates then coalesce(n, 0) else 0 end as independent_n,
           case when available and gates and n >= 5 then round(effect, 6) end as effect,
           case when available and gates and n >= 5 then round(low, 6) end as low,
           case when available and gates and n >= 5 then round(high, 6) end as high,
           case when not (available and gates) then 'INAPPLICABLE' when coalesce(n, 0) < 5 then 'INSUFFICIENT_DATA'
                when low > 0.05 then 'GAIN' when high <= 0.05 then 'NO_GAIN' else 'STATISTICALLY_UNCERTAIN' end as verdict
    from family left join points using (comparison_id) left join ends using (comparison_id) join counts using (comparison_id)""",
)
def inf5_adjudication(spark, sf):
    out = inference.adjudicate(policy_cells(spark, sf), contrasts(spark), POLICY)
    return out.select(
        "comparison_id", "independent_n", *[F.round(c, 6).alias(c) for c in ("effect", "low", "high", "candidate_minus_reference")],
        F.round("interval_confidence", 12).alias("interval_confidence"), "expected_cells", "eligible_cells", "verdict",
    )


@query(
    "inf6_quality_gates",
    f"""with {CELLS}, contrasts(comparison_id, reference, candidate, horizon, weight) as (values {CONTRAST_ROWS}),
    sides as (select comparison_id, horizon, unnest([reference, candidate]) as arm_id from contrasts)
    select comparison_id, bool_and(coalesce(quantity >= 3 and error <= 120000, true) or coalesce(status <> 'SUCCEEDED', true)) as gates_passed,
           bool_and(c.arm_id is not null) as available
    from sides s left join cells c using (arm_id, horizon) group by comparison_id""",
)
def inf6_quality_gates(spark, sf):
    policy = inference.Policy(minimum_ess=3.0, maximum_reference_error=120000.0)
    return inference.quality_gates(policy_cells(spark, sf), contrasts(spark), inference.gates_met(policy))


@query(
    "prj16_relative_delta",
    f"""with {BLOCKS} select c.arm_id, c.horizon, c.block_id,
        round(100.0 * (c.quantity - r.quantity) / abs(nullif(r.quantity, 0)), 6) as delta_pct
        from blocks c join blocks r using (horizon, block_id)
        where r.arm_id = 'A' and r.complete and c.complete and c.arm_id <> 'A'""",
)
def prj16_relative_delta(spark, sf):
    met = pairing.arms_together(blocks(spark, sf).where("complete"), ["horizon", "block_id"], "arm_id", "A", ["quantity"])
    return met.select(
        F.col("cand.arm").alias("arm_id"), "horizon", "block_id",
        F.round(relative_delta_pct("cand.quantity", "ref.quantity"), 6).alias("delta_pct"),
    )


@query(
    "snk5_claim_index",
    f"""with {BLOCKS}, arms as (
      select arm_id, horizon, 'quantity' as metric, avg(quantity) as value, count(*) filter (where complete) as independent_n,
             case when bool_and(complete) then 'complete' else 'incomplete' end as evidence_status from blocks group by all)
    select sha256(concat_ws('|', a.arm_id, a.horizon, a.metric)) as claim_id, a.metric, round(a.value, 8) as value, a.evidence_status,
           a.independent_n, c.attempt_id
    from arms a join blocks b on b.arm_id = a.arm_id and b.horizon = a.horizon and b.complete
    join cells c on c.arm_id = b.arm_id and c.horizon = b.horizon and c.block_id = b.block_id and c.status = 'SUCCEEDED'""",
)
def snk5_claim_index(spark, sf):
    """One row per claim and contributing attempt: the attempt list of a claim has no bound."""
    from evigrid.sources.sinks import claim_index

    all_cells = cells(spark, sf)
    return claim_index(all_cells, materialise(rollup.block_means(all_cells, ["quantity"])), ["quantity"]).select(
        "claim_id", "metric", F.round("value", 8).alias("value"), "evidence_status", "independent_n", "attempt_id"
    )


@query(
    "agg27_attempt_and_cell_counts",
    f"""with {LEDGER}, c as (select cell_id, count(*) as attempts, count(*) filter (where state = 'SUCCEEDED') as ok,
            count(*) filter (where state = 'FAILED') as bad, bool_and(state <> 'RUNNING') as done from ledger group by all)
    select cell_id % 5 as family, count(*) as expected_cells, count(*) filter (where ok > 0) as successful_cells,
           cast(sum(attempts) as bigint) as observed_attempts, cast(sum(ok) as bigint) as successful_attempts,
           cast(sum(bad) as bigint) as failed_attempts, bool_and(done) as complete_history
    from c group by all""",
)
def agg27_attempt_and_cell_counts(spark, sf):
    return summaries.attempt_and_cell_counts(ledger(spark, sf), "cell_id", F.col("cell_id") % 5, "state")