"""Selections, splits and rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evigrid.functions.ordered import PIECE, previous, row_numbers, running_sums, with_piece
from evigrid.functions.scalars import unit_interval_hash


def first_success(
    history: DataFrame, cell: Sequence[str], order: str, attempt: str, success: Column, selected: Column | None = None
) -> DataFrame:
    """First and last successful attempt of each cell; only the first may be selected. An aggregate, not a sort.

    ``selected`` marks the attempts that were used; ``only_first_used`` then tells whether they are just the first success.
    Without it the last success is taken as the one used.
    """
    good = F.when(success, F.col(order))
    used = [] if selected is None else [F.min(F.when(selected, F.col(attempt))).alias("used"), F.count_if(selected).alias("uses")]
    picked = history.groupBy(*cell).agg(
        F.min_by(attempt, good).alias("first_success"), F.max_by(attempt, good).alias("last_success"),
        F.count_if(success).alias("successes"), *used,
    ).where(F.col("successes") > 0)
    if selected is not None:
        first = (F.col("uses") == 1) & (F.col("used") == F.col("first_success"))
        return picked.withColumn("only_first_used", F.coalesce(first, F.lit(False)))
    return picked.withColumn("only_first_used", F.col("first_success") == F.col("last_success"))


def hash_ordered_selection(
    df: DataFrame, block: str, sample: str, salt: str, primary: int, secondary: int
) -> DataFrame:
    """Outcome-blind choice: blocks in hash order, the smallest sample of each, the first ``primary`` of them.

    The limit is the feature; it is taken as a distributed top-k before the short result is numbered.
    """
    blocks = df.groupBy(block).agg(F.min(sample).alias(sample), F.count(F.lit(1)).alias("windows"))
    keyed = blocks.withColumn("block_hash", F.sha2(F.concat(F.lit(salt), F.col(block).cast("string")), 256))
    top = keyed.orderBy("block_hash", block).limit(primary)
    position = F.row_number().over(W.orderBy("block_hash", block))
    return top.withColumn("position", position).withColumn("secondary", F.col("position") <= secondary)


def hash_split(df: DataFrame, block: str, salt: str, cuts: Sequence[tuple[str, float]], last: str) -> DataFrame:
    """Split by a hash of the block, so every row of a block lands in the same part wherever it is computed."""
    u = unit_interval_hash(salt, block)
    part = None
    for name, upper in cuts:
        part = F.when(u < upper, name) if part is None else part.when(u < upper, name)
    return df.withColumn("u", u).withColumn("split", part.otherwise(last))


def rank_fraction_split(df: DataFrame, keys: Sequence[str], unit: str, salt: str, fraction: float) -> DataFrame:
    """First ``round(fraction*n)`` units of each group in hash order are for training; halves round to even."""
    hashed = df.withColumn("__h", F.sha2(F.concat(F.lit(salt), F.col(unit).cast("string")), 256))
    # a hash is uniform, so its first digits cut even one huge group into equal pieces
    numbered = row_numbers(
        hashed, keys, [F.col("__h"), F.col(unit)], F.substring("__h", 1, 4), "rank", total="size"
    )
    keep = F.bround(F.lit(fraction) * F.col("size"), 0)
    return numbered.withColumn("role", F.when(F.col("rank") <= keep, "train").otherwise("validation")).drop("__h")


def rank_bands(df: DataFrame, keys: Sequence[str], value: str, tie: str, bands: int) -> DataFrame:
    """Band ``min(bands-1, floor(bands*rank/size))`` with the zero-based rank of ``value``."""
    cut = with_piece(df, value, tie)
    numbered = row_numbers(cut, keys, [F.col(value), F.col(tie)], F.col(PIECE), "rank", total="size").drop(PIECE)
    zero = F.col("rank") - 1
    band = F.least(F.lit(bands - 1).cast("bigint"), F.floor(F.lit(bands) * zero / F.col("size")))
    return numbered.withColumn("band", band).withColumn("rank", zero)


def retry_chains(attempts: DataFrame, cell: Sequence[str], order: Sequence[Column], chunk: Column, failed: str) -> DataFrame:
    """Chains of attempts in which each follows a failed one; at most two retries per root are allowed."""
    seen = previous(attempts, cell, order, chunk, {"__failed_before": failed})
    root = (~F.coalesce("__failed_before", F.lit(False))).cast("bigint")
    numbered = running_sums(seen, cell, order, chunk, {"chain": root})
    return numbered.groupBy(*cell, "chain").agg(F.count(F.lit(1)).alias("attempts")).withColumn(
        "allowed", F.col("attempts") <= 3
    )


def mass_order(cells: DataFrame, keys: Sequence[str], mass: str, ties: Sequence[str], share: float) -> DataFrame:
    """Cells by falling mass with rank, running mass and whether the cell is needed to reach ``share`` of the total."""
    order = [F.col(mass).desc(), *[F.col(t) for t in ties]]
    falling = cells.withColumn("__fall", -F.col(mass).cast("double"))
    cut = with_piece(falling, "__fall", ties[0] if ties else None)
    # as in the order, an unknown mass comes last
    chunk = F.struct(F.col(mass).isNull().alias("unknown"), F.col(PIECE).alias("piece"))
    ranked = running_sums(
        cut, keys, order, chunk, {"rank": F.lit(1).cast("bigint"), "cumulative": F.col(mass)}, totals=True
    ).drop("__fall", PIECE)
    needed = F.col("cumulative") - F.col(mass) < share * F.col("cumulative_total")
    return ranked.withColumn("needed", needed).drop("rank_total")
