"""Evidence conditioning on sampled paths: hits, exclusion, presence, soft evidence and the maps they give."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def path_hits(points: DataFrame, path: str, region: Column, window: Column, time: str, x: str, y: str, order: str) -> DataFrame:
    """One row per path: whether and when it is first inside the region in the window, and where it ends."""
    inside = region & window
    return points.groupBy(path).agg(
        F.bool_or(inside).alias("hit"), F.min(F.when(inside, F.col(time))).alias("first_hit"),
        F.max_by(F.struct(F.col(x).alias("end_x"), F.col(y).alias("end_y"), region.alias("end_inside")), order).alias("__e"),
    ).select(path, "hit", "first_hit", "__e.*")


def with_total(df: DataFrame, weight: Column, name: str = "total") -> DataFrame:
    """Add a grand total to every row, as a scalar subquery."""
    return df.withColumn(name, df.agg(F.sum(weight)).scalar())


def soft_weight(rho: float, prior: Column) -> Column:
    """Posterior presence weight for likelihood ratio ``rho``."""
    return rho * prior / (rho * prior + 1 - prior)


def class_weights(paths: DataFrame, rho: float) -> DataFrame:
    """Weight per path: its class keeps its inner shape while presence gets its posterior share."""
    counted = paths.agg(F.struct(F.count_if("hit").alias("__h"), F.count(F.lit(1)).alias("__n")).alias("c")).scalar()
    joined = paths.withColumn("__c", counted).select("*", "__c.__h", "__c.__n").drop("__c")
    prior = F.col("__h") / F.col("__n")
    w = soft_weight(rho, prior)
    weight = F.when(F.col("hit"), w / F.col("__h")).otherwise((1 - w) / (F.col("__n") - F.col("__h")))
    return joined.withColumn("prior", prior).withColumn("posterior", w).withColumn("weight", weight).drop("__h", "__n")


def cell_mass(paths: DataFrame, size: float, weight: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Mass per end cell, normalised over the kept paths."""
    cell = [F.floor(F.col(c) / size).alias(n) for c, n in (("end_x", "cx"), ("end_y", "cy"))]
    summed = paths.select(*keys, *cell, weight.alias("__w")).groupBy(*keys, "cx", "cy").agg(F.sum("__w").alias("__m"))
    if keys:
        totals = summed.groupBy(*keys).agg(F.sum("__m").alias("__t"))
        shared = summed.join(totals, list(keys))
    else:
        shared = with_total(summed, F.col("__m"), "__t")
    return shared.select(*keys, "cx", "cy", (F.col("__m") / F.col("__t")).alias("mass"))


def total_variation(p: DataFrame, q: DataFrame) -> DataFrame:
    """Half the summed absolute difference of two cell maps; one union and one aggregate, no join."""
    both = p.select("cx", "cy", "mass").unionByName(q.select("cx", "cy", (-F.col("mass")).alias("mass")))
    return both.groupBy("cx", "cy").agg(F.sum("mass").alias("d")).agg((0.5 * F.sum(F.abs("d"))).alias("distance"))


def pattern_weights(items: DataFrame, k: int) -> DataFrame:
    """Normalised weight of every presence pattern of ``k`` evidence items and its ratio to all-present.

    ``items`` has columns ``item`` (0-based), ``prior``, ``l1``, ``l0``. There are 2^k patterns of k registered items.
    """
    bits = items.withColumn("pattern", F.explode(F.sequence(F.lit(0), F.lit(2**k - 1))))
    bit = F.expr("shiftright(pattern, item) & 1")
    present, absent = F.col("l1") * F.col("prior"), F.col("l0") * (1 - F.col("prior"))
    factor = F.when(bit == 1, present).otherwise(absent)
    logs = bits.groupBy("pattern").agg(
        F.sum(F.ln(factor)).alias("__l"), F.sum(F.when(bit == 1, F.lit(0.0)).otherwise(F.ln(absent) - F.ln(present))).alias("__r")
    )
    return with_total(logs.withColumn("__w", F.exp("__l")), F.col("__w"), "__t").select(
        "pattern", (F.col("__w") / F.col("__t")).alias("weight"), F.exp("__r").alias("ratio")
    )
