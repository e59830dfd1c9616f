"""Named summaries: statuses, envelopes, matrices, tallies, each over any table with the named columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evigrid.functions.fingerprint import element_digest, sequence_fingerprint
from evigrid.functions.quantiles import exact_quantiles
from evigrid.session import materialise

COMPUTED, UNAVAILABLE = "computed", "unavailable"


def gate_status(records: DataFrame, gates: DataFrame, key: str, passed: Column, not_run: Column) -> DataFrame:
    """``not_run`` where the record says so, ``passed`` where all its gates are, else ``failed``; records without gates go."""
    verdict = gates.groupBy(key).agg(F.bool_and(passed).alias("__ok"))
    state = F.when(not_run, "not_run").when(F.col("__ok"), "passed").otherwise("failed")
    return records.join(verdict, key).select(key, state.alias("status"))


def delta_summary(pairs: DataFrame, keys: Sequence[str], delta: str) -> DataFrame:
    """Blocks, their mean candidate-minus-reference difference, and in how many the candidate is lower."""
    return pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("blocks"), F.avg(delta).alias("mean_delta"), F.count_if(F.col(delta) < 0).alias("candidate_lower")
    )


def containment_means(blocks: DataFrame, keys: Sequence[str], covered: str, seeds: str, means: Sequence[str]) -> DataFrame:
    """Coverage inside each block first, then blocks with equal weight; other columns are means over blocks."""
    share = F.try_divide(F.col(covered), F.col(seeds))
    return blocks.groupBy(*keys).agg(F.avg(share).alias("coverage"), *[F.avg(m).alias(m) for m in means])


def coverage_envelope(means: DataFrame, keys: Sequence[str], level: str, tolerance: float = 1e-12) -> DataFrame:
    """Range of coverage over configurations, and how many lie below, at and above the nominal level."""
    gap = F.col("coverage") - F.col(level)
    return means.groupBy(*keys).agg(
        F.min("coverage").alias("lowest"), F.max("coverage").alias("highest"), F.count_if(gap < -tolerance).alias("below"),
        F.count_if(F.abs(gap) <= tolerance).alias("equal"), F.count_if(gap > tolerance).alias("above"),
    )


def horizon_overview(means: DataFrame, keys: Sequence[str], slot: str, slots: Sequence[int], nominal: float) -> DataFrame:
    """Coverage of every horizon side by side, the lowest of the last one, and whether all of that is below nominal."""
    last = F.when(F.col(slot) == slots[-1], F.col("coverage"))
    return means.groupBy(*keys).agg(
        *[F.max(F.when(F.col(slot) == i, F.col("coverage"))).alias(f"coverage_{i}") for i in slots],
        F.min(last).alias("last_low"), F.bool_and(last < nominal).alias("last_below_nominal"),
    )


def shared_source_cost(uses: DataFrame, source: str, agreement: str, cost: Column) -> DataFrame:
    """A shared source is charged once; users who disagree about ``agreement`` leave its cost unknown."""
    same = F.min(agreement).eqNullSafe(F.max(agreement)) & (F.count_if(F.col(agreement).isNull()).isin(0, F.count(F.lit(1))))
    return uses.groupBy(source).agg(
        F.count(F.lit(1)).alias("uses"), (~same).alias("conflict"), F.when(same, F.min(cost)).alias("charged_ms")
    )


def attempt_and_cell_counts(
    attempts: DataFrame, cell: str, family: Column, state: str, good: str = "SUCCEEDED", bad: str = "FAILED", open_: str = "RUNNING"
) -> DataFrame:
    """Cells and attempts per family, and whether every attempt of the family has come to an end."""
    s = F.col(state)
    per_cell = attempts.groupBy(family.alias("family"), cell).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(s == good).alias("ok"), F.count_if(s == bad).alias("bad"),
        F.bool_and(F.coalesce(s != open_, F.lit(False))).alias("done"),
    )
    return per_cell.groupBy("family").agg(
        F.count(F.lit(1)).alias("expected_cells"), F.count_if(F.col("ok") > 0).alias("successful_cells"),
        F.sum("n").alias("observed_attempts"), F.sum("ok").alias("successful_attempts"), F.sum("bad").alias("failed_attempts"),
        F.bool_and("done").alias("complete_history"),
    )


def best_by(df: DataFrame, keys: Sequence[str], item: str, score: str) -> DataFrame:
    """The item with the lowest score; ties go to the smaller item, unknown scores never win."""
    known = F.when(F.col(score).isNotNull(), F.struct(score, item))
    return df.groupBy(*keys).agg(F.min_by(item, known).alias("best"), F.min(score).alias("score"))


def recorded_cost(df: DataFrame, keys: Sequence[Column], cost: str) -> DataFrame:
    """Planned, recorded and missing items, the recorded total, and the mean over what was recorded."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("planned"), F.count(cost).alias("recorded"), F.count_if(F.col(cost).isNull()).alias("missing"),
        F.sum(cost).alias("total_ms"), F.avg(cost).alias("mean_ms"),
    )


def _of(capture: str, name: str, n: str) -> Column:
    return F.when(F.col(capture) == name, F.col(n))


def capture_totals(captures: DataFrame, rows: Sequence[str], capture: str, n: str, earlier: str, later: str) -> DataFrame:
    """Totals of two captures by row, group and in all; a total is named ``all`` by its grouping, never by a null."""
    out = captures.rollup(*rows).agg(
        *[F.grouping(r).alias(f"__all_{r}") for r in rows],
        *[F.coalesce(F.sum(_of(capture, name, n)), F.lit(0)).alias(as_) for name, as_ in ((earlier, "earlier"), (later, "later"))],
    )
    return out.select(
        *[F.when(F.col(f"__all_{r}") == 1, "all").otherwise(F.col(r)).alias(r) for r in rows], "earlier", "later",
        (F.col("later") - F.col("earlier")).alias("net"),
    )


def capture_join(captures: DataFrame, keys: Sequence[str], capture: str, n: str, earlier: str, later: str) -> DataFrame:
    """Both captures of each cell, from one aggregate; a cell absent from one side stays with a null there."""
    both = captures.groupBy(*keys).agg(F.max(_of(capture, earlier, n)).alias("n_left"), F.max(_of(capture, later, n)).alias("n_right"))
    net = F.coalesce("n_right", F.lit(0)) - F.coalesce("n_left", F.lit(0))
    return both.select(
        *keys, "n_left", "n_right", net.alias("net"), (~F.col("n_left").eqNullSafe(F.col("n_right"))).alias("changed")
    )


def class_means(classes: DataFrame, df: DataFrame, key: str, value: str, minimum: int) -> DataFrame:
    """Mean per registered class; a class with fewer rows than ``minimum``, or none, stays as unavailable."""
    m = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), F.avg(value).alias("__v"))
    enough = F.coalesce(F.col("__n") >= minimum, F.lit(False))
    return classes.join(m, key, "left").select(
        key, F.coalesce("__n", F.lit(0)).alias("windows"), F.when(enough, F.col("__v")).alias("mean"),
        F.when(enough, COMPUTED).otherwise(UNAVAILABLE).alias("state"),
    )


def availability_matrix(df: DataFrame, family: str, mode: str, modes: Mapping[str, str], bad: Column, limit: int) -> DataFrame:
    """Rows per family and mode (``modes``: mode -> column), and whether any mode has more than ``limit`` bad rows."""
    counts = df.groupBy(family, mode).agg(F.count(F.lit(1)).alias("__n"), F.count_if(bad).alias("__bad"))
    return counts.groupBy(family).agg(
        *[F.coalesce(F.sum(F.when(F.col(mode) == m, F.col("__n"))), F.lit(0)).alias(c) for m, c in modes.items()],
        F.when(F.bool_or(F.col("__bad") > limit), UNAVAILABLE).otherwise("available").alias("state"),
    )


def paired_variance_ratio(
    rows: DataFrame, keys: Sequence[str], seed: str, arm: str, value: str, common: str, independent: str, reference: str
) -> DataFrame:
    """Variance of ``common - reference`` over that of ``independent - reference`` across the seeds that have all three."""
    arms = (common, independent, reference)
    wide = rows.groupBy(*keys, seed).agg(*[F.max(F.when(F.col(arm) == a, F.col(value))).alias(f"__{i}") for i, a in enumerate(arms)])
    full = wide.where(F.col("__0").isNotNull() & F.col("__1").isNotNull() & F.col("__2").isNotNull())
    spread = [F.var_samp(F.col(f"__{i}") - F.col("__2")) for i in (0, 1)]
    return full.groupBy(*keys).agg(F.count(F.lit(1)).alias("seeds"), (spread[0] / F.nullif(spread[1], F.lit(0.0))).alias("ratio"))


def tally(df: DataFrame, keys: Sequence[Column], states: Mapping[str, Column]) -> DataFrame:
    """Expected rows and the number that meet each named condition."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("expected"), *[F.count_if(c).alias(n) for n, c in states.items()])


def runtime_conditions(
    trials: DataFrame, keys: Sequence[str], ok: Column, latency: str, probabilities: Mapping[str, float], minimum: int
) -> DataFrame:
    """Latency quantiles of the successes only, failures counted beside them, null below ``minimum`` successes."""
    counts = trials.groupBy(*keys).agg(F.count_if(ok).alias("successes"), F.count_if(~ok).alias("failures"))
    quantiles = exact_quantiles(trials.where(ok), keys, latency, probabilities)
    enough = F.col("successes") >= minimum
    return counts.join(quantiles, list(keys), "left").select(
        *keys, "successes", "failures", F.when(enough, COMPUTED).otherwise(UNAVAILABLE).alias("state"),
        *[F.when(enough, F.col(p)).alias(p) for p in probabilities],
    )


def exact_cover(cells: DataFrame, packages: DataFrame, cell: str) -> DataFrame:
    """Every executable cell has one package: covered, uncovered, duplicate, or a package of a cell that is not executable."""
    bound = packages.groupBy(cell).agg(F.count(F.lit(1)).alias("__n"))
    known = cells.select(cell, F.lit(True).alias("__executable"))
    state = (
        F.when(F.col("__executable").isNull(), "not_executable").when(F.col("__n").isNull(), "uncovered")
        .when(F.col("__n") > 1, "duplicate").otherwise("covered")
    )
    return known.join(bound, cell, "full_outer").select(cell, F.coalesce("__n", F.lit(0)).alias("packages"), state.alias("state"))


def replicate_alignment(rows: DataFrame, keys: Sequence[str], replicate: str, expected: Sequence[int], ok: Column) -> DataFrame:
    """Replicates side by side without an n-way join: which of the expected ones an execution key has, and whether it has each
    exactly once and succeeded.
    """
    wanted = F.col(replicate).isin(list(expected))
    return rows.groupBy(*keys).agg(
        F.count_if(wanted).alias("replicates"),
        (
            (F.count_if(wanted & ok) == len(expected)) & (F.count_if(wanted) == len(expected))
            & (F.size(F.collect_set(F.when(wanted, F.col(replicate)))) == len(expected))
        ).alias("aligned"),
    )


def _contract(columns: Sequence[str]) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def replicate_matrices(
    rows: DataFrame, keys: Sequence[str], replicate: str, expected: Sequence[int], contract: Sequence[str]
) -> DataFrame:
    """One row per replicate: its executions, and how its matrix compares with that of the first expected replicate.

    ``state`` is the first that holds of ``unregistered``, ``absent``, ``repeated_execution`` (a key twice), ``matrix_differs`` (another set
    of keys), ``contract_differs`` (the same keys, but another value of a ``contract`` column at some key) and ``aligned``. Key sets and
    contracts are compared as sums of digests, so no replicate is joined to another and no key set is gathered. Null keys and null contract
    values count as values. If the first replicate is absent, every other differs from it.
    """
    seen = rows.groupBy(replicate, *keys).agg(F.count(F.lit(1)).alias("__n"), F.min(_contract(contract)).alias("__c"))
    key = _contract(keys)
    prints = seen.groupBy(replicate).agg(
        F.sum("__n").alias("executions"), F.max("__n").alias("__most"),
        sequence_fingerprint(element_digest(F.lit(0), key)).alias("__keys"),
        sequence_fingerprint(element_digest(F.lit(0), F.concat_ws(":", key, "__c"))).alias("__contracts"),
    )
    kind = rows.schema[replicate].dataType
    registered = rows.sparkSession.createDataFrame([(r,) for r in expected], T.StructType([T.StructField("__r", kind)]))
    # one row per replicate, stored, because the first one is compared with all
    both = materialise(
        prints.join(registered, F.col(replicate).eqNullSafe(F.col("__r")), "full_outer").withColumn("__id", F.coalesce(replicate, "__r"))
    )
    first = both.where(F.col("__r") == F.lit(expected[0]))
    state = (
        F.when(F.col("__r").isNull(), "unregistered").when(F.col("__most").isNull(), "absent")
        .when(F.col("__most") > 1, "repeated_execution")
        .when(~F.col("__keys").eqNullSafe(first.select("__keys").scalar()), "matrix_differs")
        .when(~F.col("__contracts").eqNullSafe(first.select("__contracts").scalar()), "contract_differs").otherwise("aligned")
    )
    return both.select(F.col("__id").alias(replicate), F.coalesce("executions", F.lit(0)).alias("executions"), state.alias("state"))


def replicate_contracts(
    rows: DataFrame, keys: Sequence[str], replicate: str, expected: Sequence[int], contract: Sequence[str], status: str
) -> DataFrame:
    """One row per execution key: whether the expected replicates agree on its contract, and the status they share.

    ``state`` is the first that holds of ``repeated_execution``, ``missing_replicate``, ``contract_differs`` and ``aligned``; a key of
    unregistered replicates alone has none. ``replicate_status`` is the one status of all replicates or ``mixed``. Minima and maxima
    decide, so everything combines on the map side once the rows of a key and replicate are counted.
    """
    wanted = rows.where(F.col(replicate).isin(list(expected)))
    per = wanted.groupBy(*keys, replicate).agg(
        F.count(F.lit(1)).alias("__n"), F.min(_contract(contract)).alias("__low"), F.max(_contract(contract)).alias("__high"),
        F.min(_contract([status])).alias("__first"), F.max(_contract([status])).alias("__last"), F.max(status).alias("__status"),
    )
    met = per.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("replicates"), F.max("__n").alias("__most"), F.min("__low").alias("__low"), F.max("__high").alias("__high"),
        (F.min("__first") == F.max("__last")).alias("__one"), F.max("__status").alias("__status"),
    )
    state = (
        F.when(F.col("__most") > 1, "repeated_execution").when(F.col("replicates") < len(set(expected)), "missing_replicate")
        .when(F.col("__low") != F.col("__high"), "contract_differs").otherwise("aligned")
    )
    return met.select(
        *keys, "replicates", state.alias("state"), F.when(F.col("__one"), F.col("__status")).otherwise("mixed").alias("replicate_status")
    )


def bootstrap_status(reference: Column, loaded: Column, aligned: Column, energy: Column, applicable: Column | None = None) -> Column:
    """State of a resampled comparison, the first that holds: what cannot be compared comes before what was not."""
    return (
        F.when(reference, "reference").when(F.lit(False) if applicable is None else ~applicable, "not_applicable")
        .when(~F.coalesce(loaded, F.lit(False)), "predictions_not_loaded")
        .when(~F.coalesce(aligned, F.lit(False)), "segment_alignment_failed")
        .when(F.coalesce(energy, F.lit(False)), "complete").otherwise("partial_closed_energy_not_resampled")
    )
