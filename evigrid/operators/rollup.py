"""Roll-ups which never hide a failure: repeats -> independent blocks -> arms, ledgers, funnels, profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evigrid.functions.quantiles import exact_quantiles
from evigrid.functions.scalars import is_finite

SUCCEEDED = "SUCCEEDED"


def whole_mean(metric: str) -> Column:
    """Mean of a metric over a group, null unless every row has a finite value."""
    return F.when(F.count_if(is_finite(metric)) == F.count(F.lit(1)), F.avg(metric)).alias(metric)


def block_means(
    cells: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ("arm_id", "horizon", "block_id"),
    minimum_seeds: int = 1, eligible: Column | None = None,
) -> DataFrame:
    """Seeds averaged inside a block; one ineligible or missing seed makes the whole block incomplete.

    ``eligible`` admits a cell (default: it succeeded); pass ``project.comparison_eligible`` where outputs are qualified. A
    metric is null as soon as one of the block's cells has no finite value of it. Block sums combine on the map side, so a block with very many repeats stays one small partial row per task.
    """
    ok = eligible if eligible is not None else F.col("status") == SUCCEEDED
    return (
        cells.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n_cells"),
            F.count_if(ok).alias("n_eligible"),
            *[whole_mean(m) for m in metrics],
        )
        .withColumn("complete", (F.col("n_eligible") == F.col("n_cells")) & (F.col("n_cells") >= minimum_seeds))
        .select(
            *keys, "n_cells", "n_eligible", "complete",
            *[F.when(F.col("complete"), F.col(m)).alias(m) for m in metrics],
        )
    )


def arm_means(blocks: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ("arm_id", "horizon")) -> DataFrame:
    """Complete blocks averaged with equal weight; incomplete blocks stay in the counts.

    A metric which a complete block lacks is null for the arm: nothing is averaged over fewer blocks than counted.
    """
    return blocks.groupBy(*keys).agg(
        F.sum("n_cells").alias("expected_cells"),
        F.sum("n_eligible").alias("eligible_cells"),
        F.count(F.lit(1)).alias("expected_blocks"),
        F.count_if("complete").alias("independent_n"),
        *[F.when(F.count_if(F.col("complete") & F.col(m).isNull()) == 0, F.avg(m)).alias(m) for m in metrics],
    ).withColumn(
        "status", F.when(F.col("independent_n") == F.col("expected_blocks"), "complete").otherwise("incomplete")
    )


def block_dispositions(blocks: DataFrame) -> DataFrame:
    """The complete and incomplete block lists as rows: a list can be as long as the data."""
    return blocks.select(
        "arm_id", "horizon", "block_id", F.when(F.col("complete"), "complete").otherwise("incomplete").alias("state")
    )


def disposition_counts(df: DataFrame, keys: Sequence[str], status: str = "status") -> DataFrame:
    return df.groupBy(*keys, status).agg(F.count(F.lit(1)).alias("n"))


def with_denominator(counts: DataFrame, keys: Sequence[str], n: str = "n") -> DataFrame:
    """Rate of each disposition over all registered rows of its group."""
    # one row per disposition, so the window holds an enumeration
    total = F.sum(n).over(W.partitionBy(*keys))
    return counts.withColumn("denominator", total).withColumn("rate", F.col(n) / F.col("denominator"))


def collapse(df: DataFrame, keys: Sequence[str], column: str, name: str, total: str | None = None) -> DataFrame:
    """One value, or ``mixed:a=2;b=1``; optionally the row count. Works on value counts; ``column`` is an enumeration."""
    counts = df.groupBy(*keys, F.col(column).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    parts = F.array_sort(F.collect_list(F.struct("__v", "__n")))
    text = F.array_join(F.transform(parts, lambda p: F.concat(p["__v"], F.lit("="), p["__n"].cast("string"))), ";")
    return counts.groupBy(*keys).agg(
        F.when(F.count(F.lit(1)) == 1, F.max("__v")).otherwise(F.concat(F.lit("mixed:"), text)).alias(name),
        *([F.sum("__n").alias(total)] if total else []),
    )


def equal_weight_levels(df: DataFrame, levels: Sequence[Sequence[str]], metrics: Sequence[str]) -> DataFrame:
    """Stacked means: each entry of ``levels`` is the grouping of the next mean, innermost first."""
    out = df
    for keys in levels:
        out = out.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in metrics])
    return out


def gated_group_means(
    rows: DataFrame, expected: DataFrame, group: Sequence[str], item: Sequence[str], levels: Sequence[Sequence[str]],
    metrics: Sequence[str], status: str = "status", success: str = "success",
) -> DataFrame:
    """Group summary which is unavailable as soon as one expected row is missing or failed, or lacks the metric.

    ``expected`` has one row per expected (group, item). Unique pairs make the join one-to-one, and nothing is
    aggregated before the full grid is in view. An item may be null: a deterministic forecast has no seed.
    """
    keys = [*group, *item]
    right = rows.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in rows.columns if c not in expected.columns])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    grid = expected.join(right, same, "left")
    # counts travel up with the means, so the grid is read once
    out = grid.groupBy(*levels[0]).agg(
        F.count(F.lit(1)).alias("expected_rows"),
        F.count(status).alias("available_rows"),
        F.count_if(F.col(status).isNull()).alias("missing_rows"),
        F.count_if(F.col(status) == success).alias("success_rows"),
        *[whole_mean(m) for m in metrics],
    )
    counts = ("expected_rows", "available_rows", "missing_rows", "success_rows")
    for keys_up in levels[1:]:
        out = out.groupBy(*keys_up).agg(*[F.sum(c).alias(c) for c in counts], *[whole_mean(m) for m in metrics])
    complete = F.col("success_rows") == F.col("expected_rows")
    return out.select(
        *group, "expected_rows", "available_rows", "missing_rows", "success_rows",
        F.when(complete, "computed").otherwise("unavailable").alias("status"),
        *[F.when(complete, F.col(m)).alias(m) for m in metrics],
    )


def replicate_summary(df: DataFrame, keys: Sequence[str], value: str, replicates: int) -> DataFrame:
    """Mean, sample deviation, range and sign agreement, only where every replicate is present."""
    full = F.count(value) == replicates
    same_sign = F.min(F.signum(value)) == F.max(F.signum(value))
    return df.groupBy(*keys).agg(
        F.count(value).alias("available"),
        F.when(full, F.avg(value)).alias("mean"),
        F.when(full, F.stddev_samp(value)).alias("sample_std"),
        F.when(full, F.min(value)).alias("low"),
        F.when(full, F.max(value)).alias("high"),
        F.when(full, same_sign).alias("sign_consistent"),
    )


def seed_directions(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    v = F.col(value)
    counted = df.groupBy(*keys).agg(
        F.count_if(v < 0).alias("negative"),
        F.count_if(v > 0).alias("positive"),
        F.count_if(v == 0).alias("zero"),
        (F.max(v) - F.min(v)).alias("range"),
    )
    only_negative = (F.col("positive") == 0) & (F.col("zero") == 0)
    only_positive = (F.col("negative") == 0) & (F.col("zero") == 0)
    return counted.withColumn(
        "direction",
        F.when(only_negative, "all-negative").when(only_positive, "all-positive")
        .when((F.col("negative") == 0) & (F.col("positive") == 0), "all-zero").otherwise("mixed"),
    )


def gain_rule(df: DataFrame, keys: Sequence[str], delta: str) -> DataFrame:
    """Gain: mean delta below zero and a majority of the repeats better."""
    counted = df.groupBy(*keys).agg(
        F.count(delta).alias("n"), F.avg(delta).alias("mean_delta"), F.count_if(F.col(delta) < 0).alias("better")
    )
    return counted.withColumn(
        "gain", (F.col("mean_delta") < 0) & (F.col("better") >= F.floor(F.col("n") / 2) + 1)
    )


def charge(events: DataFrame) -> DataFrame:
    """Charge per event: settled events cost their elapsed time, or the reservation where it was not measured."""
    return events.withColumn(
        "charged_ms",
        F.when(F.col("settled"), F.coalesce("elapsed_ms", "reserved_ms")).otherwise(F.lit(0).cast("bigint")),
    )


def latest_events(events: DataFrame, order: str | None = None) -> DataFrame:
    """One event per attempt: the last by ``order``; without one a settlement stands above its reservation.

    Events that tie are told apart by their cost, the higher one counts, so the charge never depends on the order of arrival.
    """
    costs = [F.col(c) for c in ("elapsed_ms", "reserved_ms") if c in events.columns]
    rank = F.struct(*([F.col(order)] if order else []), F.col("settled"), *costs)
    rest = [c for c in events.columns if c != "attempt_id"]
    return events.groupBy("attempt_id").agg(F.max_by(F.struct(*rest), rank).alias("__e")).select("attempt_id", "__e.*")


def ledger_violations(history: DataFrame, events: DataFrame) -> DataFrame:
    """``attempt_id``, ``violation``: attempts settled more than once, and events of attempts the history does not know."""
    settled = events.groupBy("attempt_id").agg(F.count_if("settled").alias("settlements"))
    known = history.select("attempt_id", F.lit(True).alias("known")).distinct()
    state = F.when(F.col("known").isNull(), "foreign_attempt").when(F.col("settlements") > 1, "duplicate_settlement")
    return settled.join(known, "attempt_id", "left").select("attempt_id", state.alias("violation")).where(
        F.col("violation").isNotNull()
    )


def cell_costs(history: DataFrame, events: DataFrame, cell: str = "cell_id", order: str | None = None) -> DataFrame:
    """Cost of each cell over all its attempts; an attempt without an event leaves the charge unknown.

    An attempt counts once, by its latest event, however many events it has.
    """
    priced = charge(latest_events(events, order)).select("attempt_id", "settled", "elapsed_ms", "reserved_ms", "charged_ms")
    joined = history.select(cell, "attempt_id").join(priced, "attempt_id", "left")
    missing = F.col("settled").isNull()
    unknown = F.col("settled") & F.col("elapsed_ms").isNull()
    pending = ~F.col("settled")
    return joined.groupBy(cell).agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count_if(missing).alias("missing_attempts"),
        F.count_if(unknown).alias("unknown_attempts"),
        F.count_if(pending).alias("pending_attempts"),
        F.when(F.count_if(missing) == 0, F.coalesce(F.sum(F.when(F.col("settled"), F.col("charged_ms"))), F.lit(0)))
        .alias("charged_ms"),
        F.coalesce(F.sum(F.when(pending, F.col("reserved_ms"))), F.lit(0)).alias("reserved_ms"),
        F.when(F.count_if(missing | unknown | pending) == 0, F.coalesce(F.sum("elapsed_ms"), F.lit(0)))
        .alias("measured_ms"),
    )


def attempt_cost_states(ledger: DataFrame, is_event: Column) -> DataFrame:
    """``missing``, ``pending``, ``unknown`` or ``measured`` per attempt of a table that holds attempts and, where ``is_event``,
    their cost events. A settled event stands above a reservation of the same attempt.
    """
    event = F.when(is_event, F.struct("settled", "elapsed_ms"))
    last = ledger.groupBy("attempt_id").agg(F.max(event).alias("e"))
    state = (
        F.when(F.col("e.settled").isNull(), "missing").when(~F.col("e.settled"), "pending")
        .when(F.col("e.elapsed_ms").isNull(), "unknown").otherwise("measured")
    )
    return last.select("attempt_id", state.alias("cost_state"))


def weighting_guard(cells: DataFrame, keys: Sequence[str], block: str, metric: str, tolerance: float = 1e-12) -> DataFrame:
    """Mean of block means beside the pooled mean, and whether block sizes make them differ: one must not stand for the other."""
    blocks = cells.groupBy(*keys, block).agg(F.sum(metric).alias("__s"), F.count(metric).alias("__n"))
    out = blocks.groupBy(*keys).agg(
        F.avg(F.try_divide("__s", "__n")).alias("block_mean"), F.try_divide(F.sum("__s"), F.sum("__n")).alias("pooled_mean"),
        F.count_if(F.col("__n") > 0).alias("blocks"), F.sum("__n").alias("rows"),
    )
    return out.withColumn("differs", F.abs(F.col("block_mean") - F.col("pooled_mean")) > tolerance)


def poisoned_total(value: str, name: str) -> Column:
    """A sum which is unknown as soon as one part is unknown."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.sum(value)).alias(name)


def resource_rollup(observations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Durations add up; peaks only have a maximum; totals are null unless every attempt was recorded."""
    recorded = F.col("resource_status") == "RECORDED"
    measured = recorded & F.col("peak_bytes").isNotNull()
    counted = observations.groupBy(*keys).agg(
        F.count_if(recorded).alias("observed_attempts"),
        F.count_if(~recorded).alias("unavailable_attempts"),
        F.count_if(recorded & F.col("peak_bytes").isNull()).alias("memory_unknown_attempts"),
        F.sum(F.when(recorded, F.col("wall_ns"))).alias("observed_wall_ns"),
        F.sum(F.when(recorded, F.col("cpu_ns"))).alias("observed_cpu_ns"),
        F.max(F.when(measured, F.col("peak_bytes"))).alias("maximum_peak_bytes"),
    )
    duration = (F.col("observed_attempts") > 0) & (F.col("unavailable_attempts") == 0)
    memory = F.col("maximum_peak_bytes").isNotNull() & (F.col("unavailable_attempts") == 0) & (
        F.col("memory_unknown_attempts") == 0
    )
    return counted.select(
        "*",
        duration.alias("duration_complete"),
        memory.alias("memory_complete"),
        F.when(duration, F.col("observed_wall_ns")).alias("wall_ns"),
        F.when(duration, F.col("observed_cpu_ns")).alias("cpu_ns"),
    )


RESOURCE_SUMS = ("legacy_cells", "unattempted_cells", "observed_attempts", "unavailable_attempts", "memory_unknown_attempts")


def resource_states(cells: DataFrame, attempts: DataFrame, cell: str = "cell_id", has_record: str = "has_record") -> DataFrame:
    """One mergeable state per cell, with the cell's own columns: which kind of unknown it holds, and what was observed.

    A cell is *legacy* where no resource record exists at all (its attempts then do not count), *unattempted* where its record
    names no attempt. Of its attempts some are recorded, the others unavailable; a recorded one may lack its memory.
    """
    recorded = F.col("resource_status").eqNullSafe("RECORDED")
    counted = attempts.groupBy(F.col(cell).alias("__cell")).agg(
        F.count_if(recorded).alias("observed_attempts"), F.count_if(~recorded).alias("unavailable_attempts"),
        F.count_if(recorded & F.col("peak_bytes").isNull()).alias("memory_unknown_attempts"),
        F.sum(F.when(recorded, F.col("wall_ns"))).alias("observed_wall_ns"), F.sum(F.when(recorded, F.col("cpu_ns"))).alias("observed_cpu_ns"),
        F.max(F.when(recorded, F.col("peak_bytes"))).alias("maximum_peak_bytes"),
    )
    has = F.coalesce(has_record, F.lit(False))
    none = F.lit(0).cast("bigint")
    counts = [F.when(has, F.coalesce(n, none)).otherwise(none).alias(n) for n in RESOURCE_SUMS[2:]]
    values = [F.when(has, F.col(n)).alias(n) for n in ("observed_wall_ns", "observed_cpu_ns", "maximum_peak_bytes")]
    return cells.join(counted, F.col(cell) == F.col("__cell"), "left").select(
        *cells.columns, F.when(has, none).otherwise(1).alias("legacy_cells"),
        F.when(has & F.col("__cell").isNull(), 1).otherwise(0).cast("bigint").alias("unattempted_cells"), *counts, *values,
    )


def merge_resources(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """States of larger groups from those of smaller ones: counts and durations add up, peaks only have a maximum."""
    return states.groupBy(*keys).agg(
        *[F.sum(n).alias(n) for n in (*RESOURCE_SUMS, "observed_wall_ns", "observed_cpu_ns")],
        F.max("maximum_peak_bytes").alias("maximum_peak_bytes"),
    )


def resource_summary(states: DataFrame) -> DataFrame:
    """Completeness and totals of states at any level. A legacy cell or an unavailable attempt leaves the totals unknown."""
    known = (F.col("legacy_cells") == 0) & (F.col("unavailable_attempts") == 0)
    duration = known & (F.col("observed_attempts") > 0)
    memory = known & F.col("maximum_peak_bytes").isNotNull() & (F.col("memory_unknown_attempts") == 0)
    return states.select(
        "*", duration.alias("duration_complete"), memory.alias("memory_complete"), F.when(duration, F.col("observed_wall_ns")).alias("wall_ns"),
        F.when(duration, F.col("observed_cpu_ns")).alias("cpu_ns"),
    )


def resource_unknowns(attempts: DataFrame, attempt: str = "attempt_id") -> DataFrame:
    """The attempts that leave something unknown, as rows: ``unavailable`` (both), ``memory`` (recorded without a peak)."""
    recorded = F.col("resource_status").eqNullSafe("RECORDED")
    reason = F.when(~recorded, "unavailable").when(F.col("peak_bytes").isNull(), "memory")
    return attempts.select(attempt, reason.alias("unknown")).where(F.col("unknown").isNotNull())


def five_numbers(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Minimum, inclusive quartiles, maximum; exact for groups of any size."""
    return exact_quantiles(
        df, keys, value, {"minimum": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "maximum": 1.0}
    )


def histogram(df: DataFrame, keys: Sequence[str], name: str = "size") -> DataFrame:
    """How many groups have each size."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    return sizes.groupBy(name).agg(F.count(F.lit(1)).alias("groups"))


def stage_counts(df: DataFrame, stages: Mapping[str, Column], block: str, keys: Sequence[str] = ()) -> DataFrame:
    """Windows and distinct blocks at each nested stage, long form.

    Rows are first reduced to one per block, so the distinct count is a plain sum.
    """
    names = list(stages)
    per_block = df.groupBy(*keys, block).agg(*[F.count_if(stages[n]).alias(f"__{n}") for n in names])
    rows = F.array(*[F.struct(F.lit(n).alias("stage"), F.col(f"__{n}").alias("__w")) for n in names])
    return (
        per_block.select(*keys, F.inline(rows))
        .groupBy(*keys, "stage")
        .agg(F.sum("__w").alias("windows"), F.count_if(F.col("__w") > 0).alias("blocks"))
    )
