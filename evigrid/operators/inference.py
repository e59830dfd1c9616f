"""Intervals, multiplicity control, verdicts and estimators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evigrid.functions.fingerprint import element_digest, sequence_fingerprint
from evigrid.functions.scalars import is_finite, normal_cdf, normal_quantile
from evigrid.operators.resample import block_slots, bootstrap_both, bootstrap_means, order_statistics
from evigrid.operators.rollup import SUCCEEDED, whole_mean
from evigrid.session import materialise

# fixed values: two-sided 95 % normal quantile; float64 spacing at one
Z95 = 1.959963984540054
EPS = 2.0**-52


def paired_interval(
    pairs: DataFrame, keys: Sequence[str], unit: str, values: Sequence[str], draws: int = 1000, stream: str = "s1",
    label: Sequence[str] | None = None,
) -> DataFrame:
    """Percentile interval of paired block differences, one row per (keys, metric).

    The interval is made of the 25th and 975th of 1000 ordered estimates (scaled for another number of draws), and
    is null with fewer than two blocks.
    """
    slots = block_slots(pairs, keys, unit)
    estimates = bootstrap_means(slots, keys, values, draws, stream, label)
    metric_rows = F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).alias("estimate")) for v in values])
    spread = estimates.select(*keys, F.inline(metric_rows))
    ends = order_statistics(
        spread, [*keys, "metric"], "estimate", draws, max(1, round(0.025 * draws)), max(1, round(0.975 * draws))
    )
    points = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("independent_n"), *[F.avg(v).alias(v) for v in values])
    point_rows = F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).alias("delta")) for v in values])
    enough = F.col("independent_n") >= 2
    return points.select(*keys, "independent_n", F.inline(point_rows)).join(ends, [*keys, "metric"], "left").select(
        *keys, "metric", "independent_n", "delta", F.when(enough, F.col("low")).alias("low"),
        F.when(enough, F.col("high")).alias("high"),
    )


def segment_bootstrap(
    segments: DataFrame, keys: Sequence[str], unit: str, means: Sequence[tuple[str, str, str]],
    medians: Sequence[tuple[str, str, str]], draws: int = 1000, stream: str = "s1",
) -> DataFrame:
    """Paired bootstrap of mean and median differences with interpolated percentile ends.

    Entries are ``(name, candidate column, reference column)``. Medians are taken per side and then subtracted. All come
    out of one set of draws. A metric has no interval as soon as one unit of the key lacks a finite value of it.
    """
    columns = list(dict.fromkeys(c for _, a, b in (*means, *medians) for c in (a, b)))
    slots = block_slots(segments.select(*keys, unit, *columns), keys, unit)
    drawn = bootstrap_both(
        slots, keys, [c for _, a, b in means for c in (a, b)], [c for _, a, b in medians for c in (a, b)], draws, stream
    )
    ends = []
    for n, a, b in (*means, *medians):
        lacking = F.max(f"__lacks_{n}")
        for p, tag in ((0.025, "low"), (0.975, "high")):
            ends.append(F.when(lacking == 0, F.percentile(F.col(a) - F.col(b), F.lit(p))).alias(f"{n}_{tag}"))
    lacks = slots.groupBy(*[F.col(k).alias(f"__k_{k}") for k in keys]).agg(
        *[F.count_if(~(is_finite(a) & is_finite(b))).alias(f"__lacks_{n}") for n, a, b in (*means, *medians)]
    )
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]) if keys else F.lit(True)
    return drawn.join(lacks, same).groupBy(*keys).agg(*ends)


# fixed values: the registered words for how seeds of the two arms are paired
INDEPENDENT_PAIRING = ("independent", "independent-within-block")
IDENTICAL_PAIRING = ("identical", "identical-within-block")


@dataclass(frozen=True)
class Policy:
    """Frozen comparison policy. A field left at None was never registered; an unknown pairing word is refused."""

    metric: str | None = None
    direction: str | None = None
    minimum_seeds: int | None = None
    minimum_paired_blocks: int | None = None
    seed_pairing: str | None = None
    confidence: float | None = None
    replicates: int | None = None
    seed: str | None = None
    multiplicity: str | None = None
    practical_threshold: float | None = None
    minimum_ess: float | None = None
    maximum_reference_error: float | None = None

    def __post_init__(self) -> None:
        if self.seed_pairing is not None and self.seed_pairing not in INDEPENDENT_PAIRING + IDENTICAL_PAIRING:
            raise ValueError(f"seed pairing {self.seed_pairing!r} is not a registered word")

    def unregistered(self) -> list[str]:
        optional = {"minimum_ess", "maximum_reference_error"}
        return [k for k, v in self.__dict__.items() if v is None and k not in optional]


def gates_met(policy: Policy) -> Column:
    """A successful cell meets the registered diagnostics; an unknown diagnostic fails, other cells do not count."""
    ok = F.lit(True)
    if policy.minimum_ess is not None:
        ok = ok & F.coalesce((F.col("ess") >= policy.minimum_ess) & (F.col("ess") >= 0), F.lit(False))
    if policy.maximum_reference_error is not None:
        e = F.col("reference_error")
        ok = ok & F.coalesce((e <= policy.maximum_reference_error) & (e >= 0), F.lit(False))
    return ok | (F.col("status") != SUCCEEDED)


def quality_gates(rows: DataFrame, contrasts: DataFrame, ok: Column) -> DataFrame:
    """Per contrast: every row of its arms and strata is ok, and every arm and stratum has rows at all."""
    per_arm = rows.groupBy("arm_id", "horizon").agg(F.bool_and(ok).alias("__ok"))
    sides = contrasts.select("comparison_id", "horizon", F.explode(F.array("reference", "candidate")).alias("arm_id"))
    return sides.join(per_arm, ["arm_id", "horizon"], "left").groupBy("comparison_id").agg(
        F.bool_and(F.coalesce("__ok", F.lit(True))).alias("gates_passed"),
        F.bool_and(F.col("__ok").isNotNull()).alias("available"),
    )


def policy_blocks(cells: DataFrame, policy: Policy, eligible: Column | None = None) -> DataFrame:
    """All a policy needs of the cells in one aggregate: block mean, completeness, seed set and gate verdict.

    ``eligible`` admits a cell (default: it succeeded). A block in which a cell lacks the metric is incomplete. A cell is unique per (arm, stratum, block, seed), so the fingerprint of its rows is that of the seed set.
    """
    admitted = eligible if eligible is not None else F.col("status") == SUCCEEDED
    good = admitted & is_finite(policy.metric)
    return cells.groupBy("arm_id", "horizon", "block_id").agg(
        ((F.count_if(good) == F.count(F.lit(1))) & (F.count(F.lit(1)) >= policy.minimum_seeds)).alias("complete"),
        F.count(F.lit(1)).alias("n_cells"), F.count_if(admitted).alias("n_eligible"), whole_mean(policy.metric).alias("v"), sequence_fingerprint(element_digest(F.lit(0), "seed")).alias("seeds"),
        F.bool_and(gates_met(policy)).alias("gates"),
    )


def weighted_block_differences(blocks: DataFrame, contrasts: DataFrame, policy: Policy) -> DataFrame:
    """Weighted difference per contrast and block over blocks which are paired in every weighted stratum."""
    done = blocks.where("complete").select("arm_id", "horizon", "block_id", "v", "seeds")
    strata = contrasts.groupBy("comparison_id").agg(F.count(F.lit(1)).alias("strata"))
    cand = contrasts.join(done.withColumnRenamed("arm_id", "candidate"), ["candidate", "horizon"])
    ref = contrasts.select("comparison_id", "reference", "horizon").join(
        done.select(F.col("arm_id").alias("reference"), "horizon", "block_id", F.col("v").alias("rv"), F.col("seeds").alias("rs")),
        ["reference", "horizon"],
    )
    paired = cand.join(ref.drop("reference"), ["comparison_id", "horizon", "block_id"])
    if policy.seed_pairing not in INDEPENDENT_PAIRING:
        paired = paired.where(F.col("seeds") == F.col("rs"))
    summed = paired.groupBy("comparison_id", "block_id").agg(
        F.sum(F.col("weight") * (F.col("v") - F.col("rv"))).alias("difference"), F.count(F.lit(1)).alias("k")
    )
    return summed.join(strata, "comparison_id").where(F.col("k") == F.col("strata")).select(
        "comparison_id", "block_id", "difference"
    )


def contrast_counts(blocks: DataFrame, contrasts: DataFrame, costs: DataFrame | None = None) -> DataFrame:
    """Cells expected and eligible on both sides of each contrast and, from ``costs`` (``arm_id, horizon, charged_ms``), their
    cost, which is unknown as soon as one side's is.
    """
    sides = contrasts.select("comparison_id", "horizon", F.explode(F.array("reference", "candidate")).alias("arm_id")).distinct()
    per_arm = blocks.groupBy("arm_id", "horizon").agg(F.sum("n_cells").alias("n_cells"), F.sum("n_eligible").alias("n_eligible"))
    met = sides.join(per_arm, ["arm_id", "horizon"], "left")
    total = F.lit(None).cast("bigint")
    if costs is not None:
        met = met.join(costs.select("arm_id", "horizon", "charged_ms"), ["arm_id", "horizon"], "left")
        total = F.when(F.count("charged_ms") == F.count(F.lit(1)), F.sum("charged_ms"))
    return met.groupBy("comparison_id").agg(
        F.coalesce(F.sum("n_cells"), F.lit(0)).alias("expected_cells"), F.coalesce(F.sum("n_eligible"), F.lit(0)).alias("eligible_cells"),
        (total if costs is not None else F.max(total)).alias("charged_ms"),
    )


def adjudicate(
    cells: DataFrame, contrasts: DataFrame, policy: Policy, eligible: Column | None = None, costs: DataFrame | None = None
) -> DataFrame:
    """Verdict per registered contrast. ``contrasts`` has one row per (comparison_id, horizon) with its weight.

    The record also holds the difference in the metric's own direction, the confidence of the interval after the multiplicity
    rule, cells expected and eligible, and the cost of both sides (null without ``costs`` or where a part is unknown).

    Cells are read once; block rows and paired differences are stored, because several branches use them.
    """
    family = contrasts.select("comparison_id", "reference", "candidate").distinct()
    if policy.unregistered():
        unknown = F.lit(None).cast("double")
        counts = contrast_counts(policy_blocks(cells, policy, eligible), contrasts, costs) if policy.metric and policy.minimum_seeds else None
        named = family.select("comparison_id", F.lit(0).cast("bigint").alias("independent_n"), *[
            unknown.alias(n) for n in ("effect", "low", "high", "candidate_minus_reference", "interval_confidence")
        ])
        missing = F.lit(None).cast("bigint")
        whole = named.join(counts, "comparison_id", "left") if counts is not None else named.select(
            "*", *[missing.alias(n) for n in ("expected_cells", "eligible_cells", "charged_ms")]
        )
        return whole.withColumn("verdict", F.lit("NEEDS_PREREGISTRATION"))
    blocks = materialise(policy_blocks(cells, policy, eligible))
    gates = quality_gates(blocks, contrasts, F.col("gates"))
    sign = -1.0 if policy.direction == "minimize" else 1.0
    oriented = materialise(
        weighted_block_differences(blocks, contrasts, policy).select(
            "comparison_id", "block_id", (F.col("difference") * sign).alias("effect")
        )
    )
    estimates = bootstrap_means(
        block_slots(oriented, ["comparison_id"], "block_id"), ["comparison_id"], ["effect"], policy.replicates, policy.seed
    )
    # the family is the registered policy, a handful of rows
    members = family.withColumn("m", F.count(F.lit(1)).over(W.partitionBy(F.lit(0))))
    divisor = F.col("m") if policy.multiplicity == "bonferroni" else F.lit(1)
    tail = F.lit(1 - policy.confidence) / divisor / 2
    order = F.array_sort(F.collect_list("effect"))
    sorted_draws = estimates.groupBy("comparison_id").agg(order.alias("__e"))
    points = oriented.groupBy("comparison_id").agg(
        F.count(F.lit(1)).alias("independent_n"), F.avg("effect").alias("effect")
    )
    joined = (
        members.join(gates, "comparison_id", "left").join(points, "comparison_id", "left")
        .join(sorted_draws, "comparison_id", "left").join(contrast_counts(blocks, contrasts, costs), "comparison_id", "left")
        .withColumn("independent_n", F.coalesce("independent_n", F.lit(0)))
    )
    applicable = F.col("gates_passed") & F.col("available")
    ready = applicable & (F.col("independent_n") >= policy.minimum_paired_blocks)

    def percentile(p: Column) -> Column:
        position = F.lit(policy.replicates - 1) * p
        low, high = F.floor(position), F.ceil(position)
        w = position - low
        return F.get("__e", low.cast("int")) * (1 - w) + F.get("__e", high.cast("int")) * w

    out = joined.select(
        "comparison_id",
        F.when(applicable, F.col("independent_n")).otherwise(F.lit(0)).alias("independent_n"),
        F.when(ready, F.col("effect")).alias("effect"),
        F.when(ready, percentile(tail)).alias("low"),
        F.when(ready, percentile(1 - tail)).alias("high"),
        F.when(ready, F.col("effect") * sign).alias("candidate_minus_reference"),
        F.when(ready, 1 - F.lit(1 - policy.confidence) / divisor).alias("interval_confidence"),
        "expected_cells", "eligible_cells", "charged_ms",
        F.when(~applicable, "INAPPLICABLE").when(~ready, "INSUFFICIENT_DATA").alias("__state"),
    )
    threshold = policy.practical_threshold
    verdict = (
        F.when(F.col("__state").isNotNull(), F.col("__state"))
        .when(F.col("low") > threshold, "GAIN")
        .when(F.col("high") <= threshold, "NO_GAIN")
        .otherwise("STATISTICALLY_UNCERTAIN")
    )
    return out.withColumn("verdict", verdict).drop("__state")


def studentized(
    effects: DataFrame, family: Sequence[str], member: Sequence[str], unit: str, value: str, draws: int, stream: str,
    alpha: float = 0.05,
) -> DataFrame:
    """Simultaneous bootstrap-t intervals within a family, with add-one p-values.

    All members of a family share their draws: the index text names the family only. Tails are ``alpha/(2m)`` and
    quantiles are order statistics, so an unbounded pivot yields an unbounded (null) end and never a clipped one.
    """
    keys = [*family, *member]
    observed = effects.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("delta"),
        (F.stddev_samp(value) / F.sqrt(F.count(F.lit(1)))).alias("se"),
    )
    slots = block_slots(effects.select(*keys, unit, value), keys, unit)
    drawn = bootstrap_means(slots, keys, [value], draws, stream, label=list(family), deviations=True)
    joined = drawn.join(observed, keys)
    guard = F.lit(32 * EPS) * F.greatest(F.lit(1.0), F.abs("delta"))
    residual = F.col(value) - F.col("delta")
    star_se = F.col(f"{value}_sd") / F.sqrt("size")
    infinite = F.lit(float("inf"))

    def pivot(rest: Column, spread: Column, tolerance: Column) -> Column:
        return (
            F.when(spread > tolerance, rest / spread).when(F.abs(rest) <= tolerance, F.lit(0.0))
            .when(rest > 0, infinite).otherwise(-infinite)
        )

    null_statistic = pivot(F.col("delta"), F.col("se"), F.lit(32 * EPS))
    pivots = joined.withColumn("t", pivot(residual, star_se, guard)).withColumn("t0", null_statistic)
    sizes = observed.groupBy(*family).agg(F.count(F.lit(1)).alias("m"))
    collected = pivots.groupBy(*keys, "n", "delta", "se").agg(
        F.array_sort(F.collect_list("t")).alias("__t"),
        ((1 + F.count_if(F.abs("t") >= F.abs("t0"))) / F.lit(float(draws + 1))).alias("p_raw"),
    )
    sized = collected.join(sizes, list(family))
    tail = F.lit(alpha) / (2 * F.col("m"))

    def order_statistic(p: Column) -> Column:
        rank = F.greatest(F.ceil(F.lit(float(draws)) * p - F.lit(1e-9)), F.lit(1))
        return F.element_at("__t", rank.cast("int"))

    low = F.col("delta") - order_statistic(1 - tail) * F.col("se")
    high = F.col("delta") - order_statistic(tail) * F.col("se")

    def bounded(c: Column) -> Column:
        return F.when(F.abs(c) < infinite, c)

    return sized.select(*keys, "m", "n", "delta", "se", bounded(low).alias("low"), bounded(high).alias("high"), "p_raw")


def holm(df: DataFrame, family: Sequence[str], p: str, order: Sequence[str]) -> DataFrame:
    """Step-down adjusted p-values. A family is a registered list of contrasts, so its window is small."""
    w = W.partitionBy(*family).orderBy(p, *order)
    m = F.count(F.lit(1)).over(W.partitionBy(*family))
    scaled = F.least(F.lit(1.0), (m - F.row_number().over(w) + 1) * F.col(p))
    return df.withColumn("__s", scaled).withColumn(
        "p_holm", F.max("__s").over(w.rowsBetween(W.unboundedPreceding, 0))
    ).drop("__s")


def tail_stability(first: DataFrame, second: DataFrame, keys: Sequence[str], limit: float) -> DataFrame:
    """Largest shift of an interval end between two resampling streams."""
    b = second.select(*keys, F.col("low").alias("low2"), F.col("high").alias("high2"))
    shift = F.greatest(F.abs(F.col("low2") - F.col("low")), F.abs(F.col("high2") - F.col("high")))
    known = F.col("low").isNotNull() & F.col("high").isNotNull() & F.col("low2").isNotNull() & F.col("high2").isNotNull()
    return first.join(b, list(keys)).withColumn("shift", F.when(known, shift)).withColumn(
        "stable", F.coalesce(F.col("shift") <= limit, F.lit(False))
    )


def decision_state(delta: float, guard: Column, qualified: Column) -> Column:
    """Beneficial / harmful / equivalent / inconclusive from interval, adjusted p and counts of seed effects."""
    low, high, p = F.col("low"), F.col("high"), F.col("p_holm")
    beneficial = (high < -delta - guard) & (p <= 0.05) & (F.col("seeds_below") >= 4)
    harmful = (low > delta + guard) & (p <= 0.05) & (F.col("seeds_above") >= 4)
    equivalent = (low > -delta + guard) & (high < delta - guard) & (F.col("seeds_inside") >= 4)
    return (
        F.when(qualified & beneficial, "beneficial").when(qualified & harmful, "harmful")
        .when(qualified & equivalent, "equivalent").otherwise("inconclusive")
    )


def seed_counts(seed_effects: DataFrame, keys: Sequence[str], value: str, delta: float, guard: float) -> DataFrame:
    v = F.col(value)
    return seed_effects.groupBy(*keys).agg(
        F.count_if(v < -guard).alias("seeds_below"),
        F.count_if(v > guard).alias("seeds_above"),
        F.count_if(F.abs(v) < delta - guard).alias("seeds_inside"),
    )


def family_unavailable(df: DataFrame, family: Sequence[str], blocked: Column, keep: Column) -> DataFrame:
    """One missing or failed required score makes the whole family unavailable, before any other state."""
    # a family is a registered list of comparisons
    any_blocked = F.bool_or(blocked).over(W.partitionBy(*family))
    return df.withColumn("state", F.when(any_blocked, "unavailable").otherwise(keep))


# fixed values: factor decision by leave-one-out state (first) and leave-one-in state (second)
FACTOR_DECISIONS: Mapping[tuple[str, str], str] = {
    ("beneficial", "beneficial"): "retain",
    ("beneficial", "harmful"): "inconclusive",
    ("beneficial", "equivalent"): "retain",
    ("beneficial", "inconclusive"): "retain",
    ("harmful", "beneficial"): "inconclusive",
    ("harmful", "harmful"): "harmful",
    ("harmful", "equivalent"): "harmful",
    ("harmful", "inconclusive"): "harmful",
    ("equivalent", "beneficial"): "redundant",
    ("equivalent", "harmful"): "redundant",
    ("equivalent", "equivalent"): "redundant",
    ("equivalent", "inconclusive"): "redundant",
    ("inconclusive", "beneficial"): "inconclusive",
    ("inconclusive", "harmful"): "inconclusive",
    ("inconclusive", "equivalent"): "inconclusive",
    ("inconclusive", "inconclusive"): "inconclusive",
}


def factor_decision(out_state: Column, in_state: Column, raw_out: Column, raw_in: Column) -> Column:
    """Factor decision; missing evidence comes first, then opposite raw directions override any cell."""
    lookup = F.create_map(*[F.lit(x) for (a, b), v in FACTOR_DECISIONS.items() for x in (f"{a}/{b}", v)])
    opposite = ((raw_out == "beneficial") & (raw_in == "harmful")) | ((raw_out == "harmful") & (raw_in == "beneficial"))
    return (
        F.when(out_state.isNull() | in_state.isNull(), "unavailable").when(opposite, "inconclusive")
        .otherwise(F.element_at(lookup, F.concat_ws("/", out_state, in_state)))
    )


def planning(df: DataFrame, sd: str, n: str, margin: float, m: int, alpha: float = 0.05, target: float = 0.8) -> DataFrame:
    """Normal-approximation power at ``n`` blocks and the number of blocks which reaches the target power."""
    z = normal_quantile(F.lit(1 - alpha / (2 * m)))
    shift = F.lit(2 * margin - margin)
    spread = F.when(F.col(sd) > 0, F.col(sd))
    return df.withColumn("power", normal_cdf(shift * F.sqrt(n) / spread - z)).withColumn(
        "required_n", F.ceil(F.pow((z + normal_quantile(F.lit(target))) * spread / shift, F.lit(2.0)))
    )


# --- estimators from sampler output -----------------------------------------------------------------------------


BAND = 256


def chunk_moments(draws: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Saved sufficient statistics of one chunk of sampler output.

    Weights are summed in bands of their logarithm, each shifted by its own band, so neither very small nor very large ones
    vanish or overflow. A null weight makes the weight statistics null: the chunk is then not usable, not merely smaller.
    """
    lw, hit, band = F.col("log_weight").cast("double"), F.col("hit"), F.col("__band")
    unknown = lw.isNull() | F.isnan(lw)
    banded = draws.withColumn("__band", F.when(F.abs(lw) < 1e15, F.floor(lw / BAND).cast("bigint")).otherwise(0))
    shifted = F.when(lw == float("-inf"), F.lit(float("-inf"))).otherwise(lw - band * BAND)
    parts = banded.groupBy(*keys, "__band").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("hits"), F.count_if(unknown).alias("unknown"),
        F.avg("x").alias("mean"), (F.var_pop("x") * F.count("x")).alias("m2"), F.count("x").alias("known"), F.max(lw).alias("top"),
        F.sum(F.exp(shifted)).alias("w"), F.sum(F.exp(2 * shifted)).alias("w2"),
        F.sum(F.when(hit, F.exp(shifted))).alias("e"), F.sum(F.when(hit, F.exp(2 * shifted))).alias("e2"),
    )
    # a chunk has a handful of bands
    whole = parts.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.sum("unknown").alias("__unknown"), F.max("top").alias("max_log_w"),
        F.try_divide(F.sum(F.col("mean") * F.col("known")), F.sum("known")).alias("mean"),
        F.collect_list(F.struct(band.alias("band"), "mean", "m2", "known", "w", "w2", "e", "e2")).alias("__parts"),
    )

    def log_sum(field: str, power: int) -> Column:
        some = F.filter("__parts", lambda p: p[field] > 0)
        top = F.array_max(F.transform(some, lambda p: p["band"]))
        total = F.aggregate(
            some, F.lit(0.0), lambda a, p: a + p[field] * F.exp((p["band"] - top).cast("double") * (BAND * power))
        )
        return F.when((F.col("__unknown") == 0) & (F.size(some) > 0), top * (BAND * power) + F.log(total))

    m2 = F.aggregate(
        F.filter("__parts", lambda p: p["known"] > 0), F.lit(0.0),
        lambda a, p: a + p["m2"] + p["known"] * F.pow(p["mean"] - F.col("mean"), F.lit(2.0)),
    )
    return whole.select(
        *keys, "n", "hits", "mean", m2.alias("m2"), "max_log_w", log_sum("w", 1).alias("log_w"), log_sum("w2", 2).alias("log_w2"),
        log_sum("e", 1).alias("log_event"), log_sum("e2", 2).alias("log_event2"),
    )


def merge_moments(chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Merge saved chunk statistics: pooled mean and second moment, log-sum-exp for the weights.

    The peak of each logarithm is found first and shared, so the exponentials never overflow.
    """
    logs = ("log_w", "log_w2", "log_event", "log_event2")
    totals = chunks.groupBy(*keys).agg(
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"), *[F.max(c).alias(f"__max_{c}") for c in logs]
    )
    joined = chunks.withColumnRenamed("mean", "__chunk_mean").join(totals, list(keys))
    return joined.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.max("mean").alias("mean"),
        F.sum(F.col("m2") + F.col("n") * F.pow(F.col("__chunk_mean") - F.col("mean"), F.lit(2.0))).alias("m2"),
        F.max("max_log_w").alias("max_log_w"),
        *[
            # a chunk without weights would leave them out of the total while its draws still count
            F.when(
                F.count_if(F.col(c).isNull() & (F.col("hits") > 0 if "event" in c else F.col("n") > 0)) == 0,
                F.max(f"__max_{c}") + F.log(F.sum(F.exp(F.col(c) - F.col(f"__max_{c}")))),
            ).alias(c)
            for c in logs
        ],
    )


def mean_interval(moments: DataFrame) -> DataFrame:
    # one draw has no error
    se = F.sqrt(F.try_divide(F.try_divide(F.col("m2"), F.col("n") - 1), F.col("n")))
    return moments.withColumn("se", se).withColumn("low", F.col("mean") - Z95 * se).withColumn(
        "high", F.col("mean") + Z95 * se
    )


def binomial_bound(moments: DataFrame) -> DataFrame:
    """Exact one-sided 95 % bound when no draw or every draw hits; null otherwise."""
    radius = -F.expm1(F.log(F.lit(0.05)) / F.col("n"))
    none, every = F.col("hits") == 0, F.col("hits") == F.col("n")
    return moments.withColumn("low", F.when(none, F.lit(0.0)).when(every, 1 - radius)).withColumn(
        "high", F.when(none, radius).when(every, F.lit(1.0))
    )


def importance_estimate(moments: DataFrame) -> DataFrame:
    """Unnormalised importance-sampling estimate with effective sample size."""
    n = F.col("n").cast("double")
    estimate = F.when(F.col("hits") > 0, F.exp(F.col("log_event") - F.log(n))).otherwise(F.lit(0.0))
    second = F.when(F.col("hits") > 0, F.exp(F.col("log_event2") - F.log(n))).otherwise(F.lit(0.0))
    spread = F.try_divide((second - estimate * estimate) * n, n - 1)
    variance = F.when(spread.isNotNull(), F.greatest(F.lit(0.0), spread))
    ess = F.exp(2 * F.col("log_w") - F.col("log_w2"))
    se = F.when(F.col("hits") > 0, F.sqrt(variance / n))
    return moments.select(
        "*", estimate.alias("estimate"), se.alias("se"), ess.alias("ess"),
        (estimate - Z95 * se).alias("low"), (estimate + Z95 * se).alias("high"),
        F.when(ess.isNull(), "UNAVAILABLE").when(F.col("hits") == 0, "INSUFFICIENT_EVENTS").when(ess < 2, "LOW_ESS")
        .otherwise(SUCCEEDED).alias("state"),
    )


def multilevel_estimate(levels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum of level means; unresolved when the standard error is zero."""
    summed = levels.groupBy(*keys).agg(
        F.sum("mean").alias("estimate"), F.sqrt(F.sum(F.col("variance") / F.col("n"))).alias("se"),
        F.count(F.lit(1)).alias("levels"),
    )
    open_ = F.col("se") > 0
    return summed.select(
        *keys, "levels", "estimate", "se",
        F.when(open_, F.col("estimate") - Z95 * F.col("se")).alias("low"),
        F.when(open_, F.col("estimate") + Z95 * F.col("se")).alias("high"),
        F.when(open_, "resolved").otherwise("unresolved").alias("state"),
    )


def level_allocation(levels: DataFrame, keys: Sequence[str], level: str, budget_se: float) -> DataFrame:
    """Variance and cost ratios to the level below, and samples per level, two at least, for a target error. Levels are few.

    The first level is an estimate of its own, so variances of differences are compared from the third level on.
    """
    below = W.partitionBy(*keys).orderBy(level)
    ratios = levels.select(
        "*",
        F.sum(F.sqrt(F.col("variance") * F.col("cost"))).over(W.partitionBy(*keys)).alias("__root"),
        F.when(F.row_number().over(below) > 2, F.col("variance") / F.nullif(F.lag("variance").over(below), F.lit(0.0)))
        .alias("variance_ratio"),
        (F.col("cost") / F.nullif(F.lag("cost").over(below), F.lit(0.0))).alias("cost_ratio"),
    )
    norm = F.col("__root") / F.lit(budget_se * budget_se)
    return ratios.withColumn(
        "samples",
        F.when(F.col("cost") > 0, F.greatest(F.lit(2), F.ceil(norm * F.sqrt(F.try_divide("variance", "cost"))))),
    ).drop("__root")


def budget_checks(df: DataFrame, keys: Sequence[str], checks: Mapping[str, tuple[str, float]]) -> DataFrame:
    """Observed value against its cap per check, long form, with the overall state of the row."""
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("check"), F.col(c).cast("double").alias("observed"), F.lit(float(cap)).alias("cap"))
            for n, (c, cap) in checks.items()
        ]
    )
    passed = F.coalesce(F.col("observed") <= F.col("cap"), F.lit(False))
    overall = None
    for c, cap in checks.values():
        part = F.coalesce(F.col(c) <= cap, F.lit(False))
        overall = part if overall is None else overall & part
    return df.select(*keys, F.when(overall, "PASSED").otherwise("FAILED").alias("state"), F.inline(rows)).withColumn(
        "passed", passed
    )


def leave_one_out(df: DataFrame, keys: Sequence[str], unit: str, value: str) -> DataFrame:
    """Mean without each unit. Group sums are joined back, so no group is sorted or held."""
    totals = df.groupBy(*keys).agg(F.sum(value).alias("__s"), F.count(value).alias("__n"))
    return df.join(totals, list(keys)).select(
        *keys, unit, F.when(F.col("__n") > 1, (F.col("__s") - F.col(value)) / (F.col("__n") - 1)).alias("loo_mean"),
        (F.col("__s") / F.col("__n")).alias("full_mean"),
    )
