"""Exact quantiles of groups of any size, under the two rules in use."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigrid.functions.ordered import PIECE, running_sums, with_piece


def _ranks(p: float, rule: str) -> tuple[Column, Column, Column]:
    """Lower rank, upper rank (1-based) and upper weight for probability ``p`` among ``__n_total`` values."""
    n = F.col("__n_total").cast("double")
    if rule == "linear":
        position = (n - 1) * F.lit(float(p))
        low = F.floor(position)
        return low + 1, F.ceil(position) + 1, position - low
    # a product such as 0.9*10 may land a hair above the integer it stands for
    rank = F.greatest(F.ceil(n * F.lit(float(p)) - F.lit(1e-9)), F.lit(1))
    return rank, rank, F.lit(0.0)


def _in_memory(df: DataFrame, keys: Sequence[str], value: str, probabilities: Mapping[str, float], rule: str) -> DataFrame:
    if rule == "linear":
        return df.groupBy(*keys).agg(*[F.percentile(value, F.lit(float(p))).alias(n) for n, p in probabilities.items()])
    return df.groupBy(*keys).agg(
        *[
            F.expr(f"percentile_disc({max(p - 1e-12, 0.0)!r}) within group (order by {value})").alias(n)
            for n, p in probabilities.items()
        ]
    )


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Mapping[str, float],
    rule: str = "linear",
    bounded: bool = False,
) -> DataFrame:
    """One row per group with a column per requested quantile.

    ``rule`` is ``linear`` (interpolated) or ``rank`` (the ceil(p*n)-th order statistic, equal to the inverted
    distribution function). Equal values are counted before any shuffle, values are ordered inside narrow value
    bins, and only the carry between bins is computed per group, so no task holds a whole group.

    ``bounded`` is for groups whose size has a proven limit (draws of a resample, particles of a forecast): Spark's
    own aggregate then does it in one shuffle.
    """
    if bounded:
        return _in_memory(df, keys, value, probabilities, rule)
    # nulls count nothing, but keep a group of nulls in the result
    counted = df.groupBy(*keys, F.col(value).alias("__x")).agg(F.count(value).alias("__m"))
    ranked = running_sums(
        with_piece(counted, "__x"), keys, [F.col("__x").asc()], F.col(PIECE), {"__n": F.col("__m")}, totals=True
    )
    picks = []
    for name, p in probabilities.items():
        low, high, _ = _ranks(p, rule)
        for tag, rank in (("lo", low), ("hi", high)):
            hit = (F.col("__m") > 0) & (F.col("__n") >= rank) & (F.col("__n") - F.col("__m") < rank)
            picks.append(F.max(F.when(hit, F.col("__x"))).alias(f"__{tag}_{name}"))
    picked = ranked.groupBy(*keys).agg(F.max("__n_total").alias("__n_total"), *picks)
    out = []
    for name, p in probabilities.items():
        _, _, w = _ranks(p, rule)
        low, high = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        # equal neighbours are returned as they are: infinities must not turn into NaN
        out.append(F.when(low == high, low).otherwise(low * (1 - w) + high * w).alias(name))
    return picked.select(*keys, *out)
