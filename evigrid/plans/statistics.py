"""Resampling, multiplicity, decisions, sampler estimators and study-level summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigrid.functions.quantiles import exact_quantiles
from evigrid.functions.scalars import exact_mean
from evigrid.operators import inference, pairing, ranking, rollup, summaries
from evigrid.plans.bindings import (
    CAPTURES, CELLS, ELIGIBILITY, LEDGER, TRIALS, captures, cells, draws, eligibility, ledger, table, trials,
)
from evigrid.plans.evidence import BLOCKS, PAIRS, blocks, pairs
from evigrid.plans.registry import query
from evigrid.session import materialise

SEGMENTS = f"""{BLOCKS},
seg as (select c.arm_id as candidate, c.horizon, c.block_id, c.quantity as ce, r.quantity as re, (c.error > 38000)::int as cc, (r.error > 38000)::int as rc,
        c.error as cp, r.error as rp from blocks c join blocks r using (horizon, block_id) where r.arm_id = 'A' and c.arm_id <> 'A' and c.complete and r.complete)"""


@query(
    "inf1_segment_bootstrap",
    f"""with {SEGMENTS}, slots as (select *, row_number() over (partition by candidate, horizon order by block_id) - 1 as slot,
          count(*) over (partition by candidate, horizon) as b from seg),
    picks as (select candidate, horizon, draw, cast('0x' || substr(md5(concat_ws(':', 's1', candidate, horizon, draw, slot)), 1, 15) as bigint) % b as pick
              from slots cross join (select unnest(range(1000)) as draw)),
    d as (select candidate, horizon, draw, avg(ce) - avg(re) as energy, avg(cc) - avg(rc) as coverage, median(cp) - median(rp) as cep50
          from picks join slots using (candidate, horizon) where slots.slot = picks.pick group by all)
    select candidate, horizon, {", ".join(f"round(quantile_cont({c}, {p}), 5) as {c}_{t}" for c in ("energy", "coverage", "cep50") for p, t in ((0.025, "low"), (0.975, "high")))}
    from d group by candidate, horizon""",
)
def inf1_segment_bootstrap(spark, sf):
    done = blocks(spark, sf).where("complete").withColumn("hit", (F.col("error") > 38000).cast("int"))
    met = pairing.arms_together(done, ["horizon", "block_id"], "arm_id", "A", ["quantity", "hit", "error"])
    sides = [F.col(f"{side}.{c}").alias(f"{side[0]}{n}") for side in ("cand", "ref") for c, n in (("quantity", "e"), ("hit", "c"), ("error", "p"))]
    out = inference.segment_bootstrap(
        met.select(F.col("cand.arm").alias("candidate"), "horizon", "block_id", *sides), ["candidate", "horizon"], "block_id",
        [("energy", "ce", "re"), ("coverage", "cc", "rc")], [("cep50", "cp", "rp")],
    )
    return out.select("candidate", "horizon", *[F.round(c, 5).alias(c) for c in out.columns if c not in ("candidate", "horizon")])


@query(
    "inf2_bootstrap_status",
    f"""with {CELLS}, k as (select arm_id, horizon, block_id, seed from cells where not (arm_id = 'R' and status = 'FAILED')),
    s as (select arm_id, count(*) as n from k group by all),
    m as (select c.arm_id, count(*) as matched from k c join k r using (horizon, block_id, seed) where r.arm_id = 'A' group by all),
    e as (select arm_id, bool_and(status = 'SUCCEEDED') as energy from cells group by all)
    select arm_id, case when arm_id = 'A' then 'reference' when matched <> n or n <> (select n from s where arm_id = 'A') then 'segment_alignment_failed'
           when energy then 'complete' else 'partial_closed_energy_not_resampled' end as bootstrap_status
    from s join m using (arm_id) join e using (arm_id)""",
)
def inf2_bootstrap_status(spark, sf):
    c = cells(spark, sf)
    kept = c.where(~((F.col("arm_id") == "R") & (F.col("status") == "FAILED"))).withColumn("target", F.lit(0))
    aligned = pairing.alignment(kept, "arm_id", "A", ["horizon", "block_id", "seed"], "target")
    energy = c.groupBy("arm_id").agg(F.bool_and(F.col("status") == rollup.SUCCEEDED).alias("energy"))
    state = summaries.bootstrap_status(F.col("arm_id") == "A", F.lit(True), F.col("aligned"), F.col("energy"))
    return aligned.join(energy, "arm_id").select("arm_id", state.alias("bootstrap_status"))


DRAWS = 2000


def student_sql(stream: str, name: str) -> str:
    return f"""{name}_slots as (select candidate, horizon, quantity as v, count(*) over w as b, row_number() over (partition by candidate, horizon order by block_id) - 1 as slot
           from pairs window w as (partition by candidate, horizon)),
{name}_obs as (select candidate, horizon, count(*) as n, avg(quantity) as delta, stddev_samp(quantity) / sqrt(count(*)) as se from pairs group by all),
{name}_picks as (select candidate, horizon, draw, cast('0x' || substr(md5(concat_ws(':', '{stream}', horizon, draw, slot)), 1, 15) as bigint) % b as pick
           from {name}_slots cross join (select unnest(range({DRAWS})) as draw)),
{name}_star as (select candidate, horizon, draw, avg(v) as m, stddev_samp(v) / sqrt(count(*)) as s
           from {name}_picks p join {name}_slots k using (candidate, horizon) where k.slot = p.pick group by all),
{name}_t as (select candidate, horizon, (m - delta) / s as t, delta / se as t0 from {name}_star join {name}_obs using (candidate, horizon)),
{name}_r as (select *, row_number() over (partition by candidate, horizon order by t) as r from {name}_t),
{name}_q as (select candidate, horizon, max(t) filter (where r = greatest(ceil({DRAWS} * 0.0125 - 1e-9), 1)) as ql,
           max(t) filter (where r = ceil({DRAWS} * (1 - 0.0125) - 1e-9)) as qu,
           (1 + count(*) filter (where abs(t) >= abs(t0))) / {DRAWS + 1}.0::double as p_raw from {name}_r group by all),
{name} as (select horizon, candidate, 2 as m, n, delta, se, delta - qu * se as low, delta - ql * se as high, p_raw from {name}_q join {name}_obs using (candidate, horizon))"""


STUDENT = f"{PAIRS},\n{student_sql('b1', 'student')}"


def student(spark, sf, stream="b1"):
    return inference.studentized(
        pairs(spark, sf), ["horizon"], ["candidate"], "block_id", "quantity", DRAWS, stream
    )


@query(
    "inf8_studentized_intervals",
    f"with {STUDENT} select horizon, candidate, m::bigint as m, n, round(delta, 8) as delta, round(se, 8) as se, round(low, 6) as low, round(high, 6) as high, round(p_raw, 8) as p_raw from student",
)
def inf8_studentized_intervals(spark, sf):
    return student(spark, sf).select(
        "horizon", "candidate", "m", "n", F.round("delta", 8).alias("delta"), F.round("se", 8).alias("se"),
        F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), F.round("p_raw", 8).alias("p_raw"),
    )


@query("inf9_add_one_p", f"with {STUDENT} select horizon, candidate, round(p_raw, 8) as p_raw from student")
def inf9_add_one_p(spark, sf):
    return student(spark, sf).select("horizon", "candidate", F.round("p_raw", 8).alias("p_raw"))


HOLM = f"""{STUDENT},
h as (select *, row_number() over (order by p_raw, horizon, candidate) as r, count(*) over () as k from student),
holm as (select *, max(least(1.0, (k - r + 1) * p_raw)) over (order by p_raw, horizon, candidate rows unbounded preceding) as p_holm from h)"""


def holm(spark, sf):
    whole = student(spark, sf).withColumn("family", F.lit("all"))
    return inference.holm(whole, ["family"], "p_raw", ["horizon", "candidate"]).drop("family")


@query("inf10_holm", f"with {HOLM} select horizon, candidate, round(p_raw, 8) as p_raw, round(p_holm, 8) as p_holm from holm")
def inf10_holm(spark, sf):
    return holm(spark, sf).select("horizon", "candidate", F.round("p_raw", 8).alias("p_raw"), F.round("p_holm", 8).alias("p_holm"))


@query(
    "inf11_tail_stability",
    f"""with {STUDENT}, {student_sql('b2', 'second')}
    select a.horizon, a.candidate, round(greatest(abs(b.low - a.low), abs(b.high - a.high)), 6) as shift,
           greatest(abs(b.low - a.low), abs(b.high - a.high)) <= 0.075 as stable from student a join second b using (horizon, candidate)""",
)
def inf11_tail_stability(spark, sf):
    out = inference.tail_stability(student(spark, sf), student(spark, sf, "b2"), ["horizon", "candidate"], 0.075)
    return out.select("horizon", "candidate", F.round("shift", 6).alias("shift"), "stable")


STATES = f"""{HOLM},
seedfx as (select c.arm_id as candidate, c.horizon, c.seed, avg(c.quantity - r.quantity) as e from cells c join cells r using (horizon, block_id, seed)
           where r.arm_id = 'A' and c.arm_id <> 'A' and c.status = 'SUCCEEDED' and r.status = 'SUCCEEDED' group by all),
seedn as (select candidate, horizon, count(*) filter (where e < -1e-9) as below, count(*) filter (where e > 1e-9) as above,
          count(*) filter (where abs(e) < 0.3 - 1e-9) as inside from seedfx group by all),
states as (select horizon, candidate, case when n >= 30 and high < -0.3 - 1e-9 and p_holm <= 0.05 and below >= 4 then 'beneficial'
           when n >= 30 and low > 0.3 + 1e-9 and p_holm <= 0.05 and above >= 4 then 'harmful'
           when n >= 30 and low > -0.3 + 1e-9 and high < 0.3 - 1e-9 and inside >= 4 then 'equivalent' else 'inconclusive' end as state
           from holm join seedn using (horizon, candidate))"""


def states(spark, sf):
    c = cells(spark, sf).where(F.col("status") == rollup.SUCCEEDED)
    met = pairing.arms_together(c, ["horizon", "block_id", "seed"], "arm_id", "A", ["quantity"])
    per_seed = met.groupBy(F.col("cand.arm").alias("candidate"), "horizon", "seed").agg(
        F.avg(F.col("cand.quantity") - F.col("ref.quantity")).alias("e")
    )
    counts = inference.seed_counts(per_seed, ["candidate", "horizon"], "e", 0.3, 1e-9)
    joined = holm(spark, sf).join(counts, ["candidate", "horizon"])
    state = inference.decision_state(0.3, F.lit(1e-9), F.col("n") >= 30)
    return joined.select("horizon", "candidate", state.alias("state"))


@query("inf12_decision_states", f"with {STATES} select * from states")
def inf12_decision_states(spark, sf):
    return states(spark, sf)


@query(
    "inf13_family_unavailable",
    f"""with {BLOCKS}, a as (select horizon, arm_id, count(*) filter (where not complete) as incomplete, avg(quantity) as q from blocks group by all)
    select horizon, arm_id, case when bool_or(incomplete > case when horizon = 'F' then 20 else 1000000 end) over (partition by horizon) then 'unavailable'
           when q > 25.4 then 'high' else 'low' end as state from a""",
)
def inf13_family_unavailable(spark, sf):
    """One arm beyond its failure allowance takes its whole family with it."""
    arms = blocks(spark, sf).groupBy("horizon", "arm_id").agg(
        F.count_if(~F.col("complete")).alias("incomplete"), F.avg("quantity").alias("q")
    )
    allowance = F.when(F.col("horizon") == "F", 20).otherwise(1000000)
    keep = F.when(F.col("q") > 25.4, "high").otherwise("low")
    return inference.family_unavailable(arms, ["horizon"], F.col("incomplete") > allowance, keep).select("horizon", "arm_id", "state")


FACTOR_ROWS = ", ".join(f"('{a}', '{b}', '{v}')" for (a, b), v in inference.FACTOR_DECISIONS.items())


@query(
    "inf14_factor_decision",
    f"""with lk(a, b, v) as (values {FACTOR_ROWS}),
    s as (select l_suppkey as factor, l_linestatus, avg(l_quantity) - 25.5 as e from lineitem group by all),
    st as (select factor, l_linestatus, case when e < -0.4 then 'beneficial' when e > 0.4 then 'harmful' when abs(e) < 0.1 then 'equivalent' else 'inconclusive' end as state,
           case when e < -0.8 then 'beneficial' when e > 0.8 then 'harmful' else 'inconclusive' end as raw from s)
    select o.factor, o.state as loo_state, i.state as lio_state,
           case when (o.raw = 'beneficial' and i.raw = 'harmful') or (o.raw = 'harmful' and i.raw = 'beneficial') then 'inconclusive' else lk.v end as decision
    from st o join st i on i.factor = o.factor and o.l_linestatus = 'F' and i.l_linestatus = 'O' join lk on lk.a = o.state and lk.b = i.state""",
)
def inf14_factor_decision(spark, sf):
    e = F.avg("l_quantity") - 25.5
    s = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("factor"), "l_linestatus").agg(e.alias("e"))
    state = (
        F.when(F.col("e") < -0.4, "beneficial").when(F.col("e") > 0.4, "harmful").when(F.abs("e") < 0.1, "equivalent")
        .otherwise("inconclusive")
    )
    raw = F.when(F.col("e") < -0.8, "beneficial").when(F.col("e") > 0.8, "harmful").otherwise("inconclusive")
    def of(code, value):
        return F.max(F.when(F.col("l_linestatus") == code, value))

    wide = s.groupBy("factor").agg(
        of("F", state).alias("loo_state"), of("O", state).alias("lio_state"), of("F", raw).alias("ro"), of("O", raw).alias("ri")
    )
    decision = inference.factor_decision(F.col("loo_state"), F.col("lio_state"), F.col("ro"), F.col("ri"))
    return wide.dropna().select("factor", "loo_state", "lio_state", decision.alias("decision"))


# the same series, fraction and steps as the columns; both constants and the shifted effect go through them
_SERIES = "list_reduce(list_prepend(1.0::double, list_transform(range(81, 1, -2), lambda k: k::double)), lambda acc, k: 1 + x * x / k * acc)"
_FRACTION = "list_reduce(list_prepend(x, list_transform(range(60, 0, -1), lambda k: k::double)), lambda acc, k: x + k / acc)"
_DENSITY = "(exp(-x * x / 2) / sqrt(2 * pi()))"
_TAIL = f"(case when x <= 2.5 then 0.5 - {_DENSITY} * x * {_SERIES} else {_DENSITY} / {_FRACTION} end)"


def _halley(name: str, source: str) -> str:
    return f"{name} as (select name, p, x + u / (1 - u * x / 2) as x from (select *, ({_TAIL} - (1 - p)) / {_DENSITY} as u from {source}))"


@query(
    "inf15_planning_power",
    f"""with {PAIRS}, levels as (select * from (values ('z', 1 - 0.05 / 4), ('target', 0.8)) v(name, p)),
    roots as (select name, p::double as p, sqrt(-2 * ln((1 - p)::double)) as t from levels),
    start as (select name, p, t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t) as x from roots),
    {_halley("once", "start")}, {_halley("twice", "once")}, q as (select max(x) filter (where name = 'z') as z, max(x) filter (where name = 'target') as target from twice),
    g as (select candidate, horizon, stddev_samp(quantity) as sd, count(*) as n from pairs group by all),
    e as (select *, 0.3 * sqrt(n) / (case when sd > 0 then sd end) - z as v, abs(0.3 * sqrt(n) / (case when sd > 0 then sd end) - z) as x from g, q)
    select candidate, horizon, round(sd, 10) as sd, n, round(case when v < 0 then {_TAIL} else 1 - {_TAIL} end, 12) as power,
           ceil(pow((z + target) * (case when sd > 0 then sd end) / 0.3, 2))::bigint as required_n from e""",
)
def inf15_planning_power(spark, sf):
    sd = pairs(spark, sf).groupBy("candidate", "horizon").agg(
        F.stddev_samp("quantity").alias("sd"), F.count(F.lit(1)).alias("n")
    )
    return inference.planning(sd, "sd", "n", 0.3, 2).withColumns({"power": F.round("power", 12), "sd": F.round("sd", 10)})


def moments(spark, sf, shift=None):
    taken = draws(spark, sf) if shift is None else draws(spark, sf).withColumn("log_weight", F.col("log_weight") + shift)
    # chunk statistics are saved; merging reads them twice
    saved = materialise(inference.chunk_moments(taken, ["stream", "chunk"]))
    return inference.merge_moments(saved, ["stream"])


DIRECT = """direct as (select l_returnflag as stream, count(*) as n, count(*) filter (where l_quantity > 45) as hits, avg(l_quantity) as mean,
  var_pop(l_quantity) * count(*) as m2, sum(exp(-l_discount)) as w, sum(exp(-2 * l_discount)) as w2,
  sum(exp(-l_discount)) filter (where l_quantity > 45) as we, sum(exp(-2 * l_discount)) filter (where l_quantity > 45) as we2
  from lineitem group by l_returnflag)"""


@query(
    "inf16_mean_interval",
    f"""with {DIRECT}, s as (select *, sqrt(m2 / (n - 1) / n) as se from direct)
    select stream, n, round(mean, 8) as mean, round(se, 8) as se, round(mean - 1.959963984540054 * se, 8) as low,
           round(mean + 1.959963984540054 * se, 8) as high from s""",
)
def inf16_mean_interval(spark, sf):
    return inference.mean_interval(moments(spark, sf)).select("stream", "n", *[F.round(c, 8).alias(c) for c in ("mean", "se", "low", "high")])


@query(
    "inf17_binomial_bound",
    """with d as (select l_orderkey, count(*) as n, count(*) filter (where l_quantity > 45) as hits from lineitem group by l_orderkey)
    select l_orderkey, n, hits, round(case when hits = 0 then 0 when hits = n then pow(0.05, 1.0 / n) end, 8) as low,
           round(case when hits = 0 then 1 - pow(0.05, 1.0 / n) when hits = n then 1 end, 8) as high from d where hits in (0, n)""",
)
def inf17_binomial_bound(spark, sf):
    d = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_quantity") > 45).alias("hits")
    )
    out = inference.binomial_bound(d).where(F.col("low").isNotNull())
    return out.withColumn("low", F.round("low", 8)).withColumn("high", F.round("high", 8))


@query(
    "inf18_importance_estimate",
    f"""with {DIRECT}, e as (select *, we / n as estimate, sqrt(greatest(0, (we2 / n - pow(we / n, 2)) * n / (n - 1)) / n) as se, w * w / w2 as ess from direct)
    select stream, round(estimate, 8) as estimate, round(se, 8) as se, round(ess, 4) as ess, round(estimate - 1.959963984540054 * se, 8) as low,
           round(estimate + 1.959963984540054 * se, 8) as high, case when ess < 2 then 'LOW_ESS' else 'SUCCEEDED' end as state from e""",
)
def inf18_importance_estimate(spark, sf):
    out = inference.importance_estimate(moments(spark, sf))
    return out.select("stream", *[F.round(c, 4 if c == "ess" else 8).alias(c) for c in ("estimate", "se", "ess", "low", "high")], "state")


@query(
    "inf19_mergeable_moments",
    f"""with {DIRECT}, s as (select *, case stream when 'A' then -800 when 'R' then 800 else 0 end as shift from direct)
    select stream, n, hits, round(mean, 8) as mean, round(m2, 2) as m2, round(ln(w) + shift, 8) as log_w, round(ln(w2) + 2 * shift, 8) as log_w2,
        round(ln(we) + shift, 8) as log_event, round(ln(we2) + 2 * shift, 8) as log_event2 from s""",
)
def inf19_mergeable_moments(spark, sf):
    """Log weights around -800 and 800, whose exponentials do not fit a double."""
    shift = F.when(F.col("stream") == "A", -800).when(F.col("stream") == "R", 800).otherwise(0)
    return moments(spark, sf, shift).select(
        "stream", "n", "hits", F.round("mean", 8).alias("mean"), F.round("m2", 2).alias("m2"),
        *[F.round(c, 8).alias(c) for c in ("log_w", "log_w2", "log_event", "log_event2")],
    )


LEVELS = """lv as (select l_returnflag as stream, l_linenumber as level, count(*) as n, avg(l_quantity / l_linenumber) as mean,
  var_samp(l_quantity / l_linenumber) as variance, avg(l_extendedprice) / 1000 as cost from lineitem group by all)"""


def levels(spark, sf):
    x = F.col("l_quantity") / F.col("l_linenumber")
    return table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("stream"), F.col("l_linenumber").alias("level")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.var_samp(x).alias("variance"), (F.avg("l_extendedprice") / 1000).alias("cost")
    )


@query(
    "inf20_multilevel_estimate",
    f"""with {LEVELS}, s as (select stream, count(*) as levels, sum(mean) as estimate, sqrt(sum(variance / n)) as se from lv group by stream)
    select stream, levels, round(estimate, 8) as estimate, round(se, 8) as se, round(estimate - 1.959963984540054 * se, 8) as low,
           round(estimate + 1.959963984540054 * se, 8) as high, case when se > 0 then 'resolved' else 'unresolved' end as state from s""",
)
def inf20_multilevel_estimate(spark, sf):
    out = inference.multilevel_estimate(levels(spark, sf), ["stream"])
    return out.select("stream", "levels", *[F.round(c, 8).alias(c) for c in ("estimate", "se", "low", "high")], "state")


@query(
    "inf21_level_allocation",
    f"""with {LEVELS}, r as (select stream, sum(sqrt(variance * cost)) as root from lv group by stream)
    select stream, level, case when row_number() over w > 2 then round(variance / lag(variance) over w, 8) end as variance_ratio, round(cost / lag(cost) over w, 8) as cost_ratio,
           greatest(2, ceil(root / 0.0001 * sqrt(variance / cost)))::bigint as samples from lv join r using (stream) window w as (partition by stream order by level)""",
)
def inf21_level_allocation(spark, sf):
    return inference.level_allocation(levels(spark, sf), ["stream"], "level", 0.01).select(
        "stream", "level", F.round("variance_ratio", 8).alias("variance_ratio"), F.round("cost_ratio", 8).alias("cost_ratio"), "samples"
    )


@query(
    "inf22_budget_checks",
    """with o as (select l_suppkey, max(l_quantity) as peak, avg(l_tax) as tax, count(*)::double as rows from lineitem group by all),
    l as (select l_suppkey, unnest(['peak', 'tax', 'rows']) as check, unnest([peak, tax, rows]) as observed, unnest([50.0, 0.0405, 610.0])::double as cap,
          peak <= 50 and tax <= 0.0405 and rows <= 610 as ok from o)
    select l_suppkey, case when ok then 'PASSED' else 'FAILED' end as state, "check", round(observed, 8) as observed, cap, observed <= cap as passed from l""",
)
def inf22_budget_checks(spark, sf):
    o = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.max("l_quantity").alias("peak"), exact_mean("l_tax").alias("tax"), F.avg("l_tax").alias("mean"), F.count(F.lit(1)).cast("double").alias("rows")
    )
    # a mean at its cap is judged exactly; shown is the sum of doubles, as in SQL
    out = inference.budget_checks(o, ["l_suppkey", "mean"], {"peak": ("peak", 50.0), "tax": ("tax", 0.0405), "rows": ("rows", 610.0)})
    shown = F.when(F.col("check") == "tax", F.col("mean")).otherwise(F.col("observed"))
    return out.withColumn("observed", F.round(shown, 8)).drop("mean")


@query(
    "inf23_replay_comparison",
    """with s as (select doc_id, n_chars as value from documents), r as (select doc_id, case when lang = 'fr' then length(text) + doc_id % 3 else length(text) end as value from documents)
       (select *, 'only_left' as side, 1::bigint as copies from (select * from s except all select * from r))
       union all (select *, 'only_right', 1 from (select * from r except all select * from s))""",
)
def inf23_replay_comparison(spark, sf):
    d = table(spark, sf, "documents")
    stored = d.select("doc_id", F.col("n_chars").alias("value"))
    shift = F.when(F.col("lang") == "fr", F.col("doc_id") % 3).otherwise(0)
    replayed = d.select("doc_id", (F.length("text") + shift).cast("bigint").alias("value"))
    return pairing.two_way_difference(stored, replayed)


@query(
    "inf24_reproduction_status",
    """select case when l.doc_id is null then 'missing' when sha256(text) = sha256(trim(text)) and toxic = 0 then 'exact' else 'mismatch' end as status,
              lang, count(*) as items from documents d left join labels l using (doc_id) group by all""",
)
def inf24_reproduction_status(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("original"), F.sha2(F.trim("text"), 256).alias("again"))
    joined = d.join(table(spark, sf, "labels"), "doc_id", "left")
    same = (F.col("original") == F.col("again")) & (F.col("toxic") == 0)
    status = F.when(F.col("toxic").isNull(), "missing").when(same, "exact").otherwise("mismatch")
    return joined.groupBy(status.alias("status"), "lang").agg(F.count(F.lit(1)).alias("items"))


@query(
    "win3_hash_ordered_selection",
    f"""with {ELIGIBILITY}, b as (select block_id, min(sample_id) as sample_id, count(*) as windows, sha256('order-v1' || block_id) as block_hash
         from eligibility where len(reasons) = 0 group by block_id),
    r as (select *, row_number() over (order by block_hash, block_id) as position from b)
    select block_id, sample_id, windows, block_hash, position::integer as position, position <= 4 as secondary from r where position <= 12""",
)
def win3_hash_ordered_selection(spark, sf):
    e = eligibility(spark, sf).where(F.size("reasons") == 0)
    return ranking.hash_ordered_selection(e, "block_id", "sample_id", "order-v1", 12, 4)


@query(
    "win4_leave_one_out",
    f"""with {PAIRS}, l as (select candidate, horizon, block_id, (sum(quantity) over w - quantity) / (count(*) over w - 1) as loo, avg(quantity) over w as full_mean
         from pairs window w as (partition by candidate, horizon))
    select candidate, horizon, count(*) as blocks, round(min(loo), 8) as low, round(max(loo), 8) as high, bool_and(sign(loo) = sign(full_mean)) as sign_kept from l group by all""",
)
def win4_leave_one_out(spark, sf):
    loo = inference.leave_one_out(pairs(spark, sf), ["candidate", "horizon"], "block_id", "quantity")
    return loo.groupBy("candidate", "horizon").agg(
        F.count(F.lit(1)).alias("blocks"), F.round(F.min("loo_mean"), 8).alias("low"), F.round(F.max("loo_mean"), 8).alias("high"),
        F.bool_and(F.signum("loo_mean") == F.signum("full_mean")).alias("sign_kept"),
    )


@query(
    "agg30_runtime_conditions",
    f"""with {TRIALS} select subject, kind, count(*) filter (where status = 'success') as successes, count(*) filter (where status <> 'success') as failures,
        case when count(*) filter (where status = 'success') >= 5 then 'computed' else 'unavailable' end as state,
        case when count(*) filter (where status = 'success') >= 5 then round(quantile_cont(end_to_end_ms, 0.5) filter (where status = 'success'), 6) end as p50,
        case when count(*) filter (where status = 'success') >= 5 then round(quantile_cont(end_to_end_ms, 0.95) filter (where status = 'success'), 6) end as p95
        from trials where kind <> 'warmup' group by subject, kind""",
)
def agg30_runtime_conditions(spark, sf):
    t = trials(spark, sf).where(F.col("kind") != "warmup")
    out = summaries.runtime_conditions(
        t, ["subject", "kind"], F.col("status") == "success", "end_to_end_ms", {"p50": 0.5, "p95": 0.95}, 5
    )
    return out.withColumn("p50", F.round("p50", 6)).withColumn("p95", F.round("p95", 6))


@query(
    "agg31_kernel_cost",
    f"""with {LEDGER} select cell_id % 15 as kernel, count(*) as planned, count(elapsed_ms) as recorded, count(*) - count(elapsed_ms) as missing,
        sum(elapsed_ms)::bigint as total_ms, round(sum(elapsed_ms) / count(elapsed_ms), 8) as mean_ms from ledger group by all""",
)
def agg31_kernel_cost(spark, sf):
    out = summaries.recorded_cost(ledger(spark, sf), [(F.col("cell_id") % 15).alias("kernel")], "elapsed_ms")
    return out.withColumn("mean_ms", F.round("mean_ms", 8))


@query(
    "agg32_capture_totals",
    f"""with {CAPTURES} select coalesce(matrix, 'all') as matrix, coalesce(disposition, 'all') as disposition,
        coalesce(sum(n) filter (where capture = 'earlier'), 0)::bigint as earlier, coalesce(sum(n) filter (where capture = 'later'), 0)::bigint as later,
        (coalesce(sum(n) filter (where capture = 'later'), 0) - coalesce(sum(n) filter (where capture = 'earlier'), 0))::bigint as net
        from captures group by rollup (matrix, disposition)""",
)
def agg32_capture_totals(spark, sf):
    return summaries.capture_totals(captures(spark, sf), ["matrix", "disposition"], "capture", "n", "earlier", "later")


@query(
    "jon13_capture_join",
    f"""with {CAPTURES} select matrix, disposition, a.n as n_left, b.n as n_right, coalesce(b.n, 0) - coalesce(a.n, 0) as net, a.n is distinct from b.n as changed
        from (select * from captures where capture = 'earlier') a full join (select * from captures where capture = 'later') b using (matrix, disposition)""",
)
def jon13_capture_join(spark, sf):
    return summaries.capture_join(captures(spark, sf), ["matrix", "disposition"], "capture", "n", "earlier", "later")


@query(
    "agg33_geography_stages",
    """with c as (select r_name as area, n_name as country, c_mktsegment as block, count(*) as released, count(*) filter (where c_acctbal > 0) as positive,
          count(*) filter (where c_acctbal > 3000) as supported from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey group by all)
    select case when grouping(area) = 1 then 'all' else area end as area, case when grouping(country) = 1 then 'all' else country end as country, sum(released)::bigint as released, sum(positive)::bigint as positive,
           sum(supported)::bigint as supported, count(distinct block) as blocks, count(distinct block) filter (where supported > 0) as supported_blocks
    from c group by grouping sets ((area, country), (area), ())""",
)
def agg33_geography_stages(spark, sf):
    """Customers shrink to (area, country, block) counts before the grouping sets expand them."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    bal = F.col("c_acctbal")
    small = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("block")).agg(
        F.count(F.lit(1)).alias("released"), F.count_if(bal > 0).alias("positive"), F.count_if(bal > 3000).alias("supported")
    )
    named = small.join(n, "n_nationkey").join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("r_name").alias("area"), F.col("n_name").alias("country"), "block", "released", "positive", "supported"
    )
    out = named.rollup("area", "country").agg(
        *[F.sum(c).alias(c) for c in ("released", "positive", "supported")], F.count_distinct("block").alias("blocks"),
        F.count_distinct(F.when(F.col("supported") > 0, F.col("block"))).alias("supported_blocks"),
        F.grouping("area").alias("all_areas"), F.grouping("country").alias("all_countries"),
    )

    def shown(name: str, is_total: str):
        # a total is known by its grouping: an unknown name stays null
        return F.when(F.col(is_total) == 1, "all").otherwise(F.col(name)).alias(name)

    return out.select(
        shown("area", "all_areas"), shown("country", "all_countries"),
        "released", "positive", "supported", "blocks", "supported_blocks",
    )


@query(
    "agg33_display_rule",
    """with c as (select r_name as area, n_name as country, count(*) as n from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey group by all),
    k as (select *, row_number() over (partition by area order by n desc, country) as position from c)
    select area, country, n, position::integer as position, country in ('NATION_3', 'NATION_7') as selected from k where position <= 2 or country in ('NATION_3', 'NATION_7')""",
)
def agg33_display_rule(spark, sf):
    """Per area the selected countries and the two largest; counts per country are a short table."""
    from pyspark.sql import Window as W

    counts = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"))
    named = counts.join(table(spark, sf, "nation"), "n_nationkey").join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    ).select(F.col("r_name").alias("area"), F.col("n_name").alias("country"), "n")
    position = F.row_number().over(W.partitionBy("area").orderBy(F.col("n").desc(), "country"))
    chosen = F.col("country").isin("NATION_3", "NATION_7")
    return named.withColumn("position", position).withColumn("selected", chosen).where((F.col("position") <= 2) | chosen)


@query(
    "agg34_environment_means",
    """with k(class) as (values ('AUTOMOBILE'), ('BUILDING'), ('FURNITURE'), ('HOUSEHOLD'), ('MACHINERY'), ('UNKNOWN')),
    m as (select c_mktsegment as class, count(*) as n, avg(c_acctbal) as v from customer group by all)
    select class, coalesce(n, 0) as windows, case when n >= 290 then round(v, 6) end as mean,
           case when n >= 290 then 'computed' else 'unavailable' end as state from k left join m using (class)""",
)
def agg34_environment_means(spark, sf):
    names = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "UNKNOWN")
    classes = spark.createDataFrame([(c,) for c in names], "class string")
    customers = table(spark, sf, "customer").withColumnRenamed("c_mktsegment", "class")
    return summaries.class_means(classes, customers, "class", "c_acctbal", 290).withColumn("mean", F.round("mean", 6))


@query(
    "agg35_availability_matrix",
    """with c as (select o_orderpriority as family, o_orderstatus as mode, count(*) as n, count(*) filter (where o_totalprice < 10000) as bad from orders group by all)
    select family, coalesce(sum(n) filter (where mode = 'F'), 0)::bigint as f, coalesce(sum(n) filter (where mode = 'O'), 0)::bigint as o,
           coalesce(sum(n) filter (where mode = 'P'), 0)::bigint as p, case when bool_or(bad > 25) then 'unavailable' else 'available' end as state from c group by family""",
)
def agg35_availability_matrix(spark, sf):
    orders = table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "family")
    modes = {"F": "f", "O": "o", "P": "p"}
    return summaries.availability_matrix(orders, "family", "o_orderstatus", modes, F.col("o_totalprice") < 10000, 25)


@query(
    "agg41_paired_variance_ratio",
    f"""with {CELLS}, w as (select horizon, block_id, seed, max(quantity) filter (where arm_id = 'A') as a, max(quantity) filter (where arm_id = 'N') as b,
          max(quantity) filter (where arm_id = 'R') as c from cells where status = 'SUCCEEDED' group by all)
    select horizon, block_id, count(*) as seeds, round(var_samp(a - c) / nullif(var_samp(b - c), 0), 8) as ratio
    from w where a is not null and b is not null and c is not null group by all""",
)
def agg41_paired_variance_ratio(spark, sf):
    good = cells(spark, sf).where(F.col("status") == rollup.SUCCEEDED)
    out = summaries.paired_variance_ratio(good, ["horizon", "block_id"], "seed", "arm_id", "quantity", "A", "N", "R")
    return out.withColumn("ratio", F.round("ratio", 8))


@query(
    "agg44_verification_tally",
    f"""with {LEDGER} select cell_id % 15 as study, count(*) as expected, count(*) filter (where state = 'SUCCEEDED' and wall_ns > 20000) as verified,
        count(*) filter (where state = 'SUCCEEDED') as passed, count(*) filter (where state = 'FAILED') as failed, count(*) filter (where state = 'RUNNING') as not_completed
        from ledger group by all""",
)
def agg44_verification_tally(spark, sf):
    s = F.col("state")
    states = {
        "verified": (s == "SUCCEEDED") & (F.col("wall_ns") > 20000), "passed": s == "SUCCEEDED", "failed": s == "FAILED",
        "not_completed": s == "RUNNING",
    }
    return summaries.tally(ledger(spark, sf), [(F.col("cell_id") % 15).alias("study")], states)