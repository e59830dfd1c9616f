"""Scores of sampled forecasts.

The long sample table has one row per ``(*keys, sample_idx)`` with position ``x, y`` and target ``tx, ty``. Every score
is a composition of aggregates; nothing depends on how many particles a forecast has. ``bounded`` may be set where
the number of particles per forecast has a proven limit, and saves shuffles.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evigrid.functions.ordered import PIECE, previous, row_numbers, with_piece
from evigrid.functions.quantiles import exact_quantiles
from evigrid.session import materialise

KEYS = ("method", "forecast_id", "slot")
TILE = 512


def distance(ax: str, ay: str, bx: str, by: str) -> Column:
    return F.hypot(F.col(ax) - F.col(bx), F.col(ay) - F.col(by))


def energy_cyclic(samples: DataFrame, keys: Sequence[str] = KEYS, bounded: bool = False) -> DataFrame:
    """Energy score whose spread term pairs each sample with the one before it; the first is paired with the last."""
    if bounded:
        w = W.partitionBy(*keys).orderBy("sample_idx")
        linked = samples.select("*", F.lag("x").over(w).alias("__px"), F.lag("y").over(w).alias("__py"))
    else:
        chunk = F.floor(F.col("sample_idx") / 65536)
        linked = previous(samples, keys, [F.col("sample_idx")], chunk, {"__px": "x", "__py": "y"})
    ends = {f"__{tag}{c}": pick(c, "sample_idx") for tag, pick in (("a", F.min_by), ("z", F.max_by)) for c in ("x", "y")}
    summed = linked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("particles"),
        F.avg(distance("x", "y", "tx", "ty")).alias("__accuracy"),
        F.coalesce(F.sum(distance("x", "y", "__px", "__py")), F.lit(0.0)).alias("__steps"),
        *[v.alias(k) for k, v in ends.items()],
    )
    wrap = distance("__ax", "__ay", "__zx", "__zy")
    score = F.col("__accuracy") - 0.5 * (F.col("__steps") + wrap) / F.col("particles")
    return summed.select(*keys, "particles", score.alias("energy"))


def pair_distance_sums(samples: DataFrame, keys: Sequence[str], vector: Column, width: int) -> DataFrame:
    """Sum of Euclidean distances over all unordered pairs of samples per group.

    The square of all pairs of a group of N samples is cut into a grid of blocks with sides of ``sqrt(512 N)`` samples, dealt by a hash.
    Every pair of blocks is one row with its own key, so the quadratic work of one huge forecast spreads over N/1024 rows, while each
    sample moves only ``sqrt(N/512)`` times, and a row holds no more than two sides of samples. Inside a row distances are
    array operations on 512 by 512 tiles; no pair of samples ever becomes a row.
    """
    n = F.count(F.lit(1))
    sized = samples.groupBy(*keys).agg(F.ceil(F.sqrt(n / F.lit(TILE))).cast("int").alias("__blocks"))
    dealt = samples.select(*keys, vector.alias("__v"), F.xxhash64("sample_idx").alias("__h")).join(sized, list(keys))
    dealt = dealt.withColumn("__block", F.pmod("__h", F.col("__blocks").cast("bigint")).cast("int"))
    # stored, because every block is read as the left and as the right side
    blocks = materialise(dealt.groupBy(*keys, "__blocks", "__block").agg(F.flatten(F.collect_list("__v")).alias("__p")))
    left = blocks.select(
        *keys, F.col("__block").alias("__a"),
        F.explode(F.sequence(F.col("__block"), F.col("__blocks") - 1)).alias("__b"), F.col("__p").alias("__pa"),
    )
    right = blocks.select(
        *keys, F.explode(F.sequence(F.lit(0), F.col("__block"))).alias("__a"), F.col("__block").alias("__b"),
        F.col("__p").alias("__pb"),
    )

    def between(a: pa.Array, b: pa.Array) -> pa.Array:
        import numpy as np

        def points(side: pa.ListScalar) -> np.ndarray:
            return side.values.to_numpy(zero_copy_only=False).astype("float64").reshape(-1, width)

        out = []
        for one, two in zip(a, b, strict=True):
            p, q = points(one), points(two)
            total = 0.0
            for i in range(0, len(p), TILE):
                for j in range(0, len(q), TILE):
                    squares = 0.0
                    for axis in range(width):
                        gap = p[i : i + TILE, axis][:, None] - q[j : j + TILE, axis][None, :]
                        squares = squares + gap * gap
                    total += float(np.sqrt(squares).sum())
            out.append(total)
        return pa.array(out, type=pa.float64())

    total = F.arrow_udf(between, T.DoubleType())(F.col("__pa"), F.col("__pb"))
    # a block against itself holds every pair twice
    share = F.when(F.col("__a") == F.col("__b"), 0.5).otherwise(1.0)
    # a stated number of partitions: the planner would merge them by their few bytes, and their work is the square of those
    cell = [*keys, "__a", "__b"]
    parts = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = left.repartition(parts, *cell).join(right.repartition(parts, *cell).hint("merge"), cell).select(*keys, (total * share).alias("__d"))
    return pairs.groupBy(*keys).agg(F.sum("__d").alias("pair_sum"))


def energy_unbiased(samples: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Energy score with the unbiased pair term over ordered distinct pairs; null below two samples."""
    spread = pair_distance_sums(samples, keys, F.array("x", "y"), 2)
    accuracy = samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("particles"), F.avg(distance("x", "y", "tx", "ty")).alias("__accuracy")
    )
    n = F.col("particles")
    score = F.when(n >= 2, F.col("__accuracy") - F.col("pair_sum") / (n * (n - 1)))
    return accuracy.join(spread, list(keys)).select(*keys, "particles", score.alias("energy"))


def path_energy(samples: DataFrame, weights: Sequence[float], keys: Sequence[str] = ("method", "forecast_id")) -> DataFrame:
    """Energy score of whole paths: time slots become coordinates scaled by the root of their weight."""
    def coordinates(x: str, y: str) -> list[Column]:
        return [
            F.max(F.when(F.col("slot") == i, F.col(c))) * F.sqrt(F.lit(w)) for i, w in enumerate(weights) for c in (x, y)
        ]

    paths = samples.groupBy(*keys, "sample_idx").agg(
        F.array(*coordinates("x", "y")).alias("p"), F.array(*coordinates("tx", "ty")).alias("t")
    )
    squares = F.aggregate(F.zip_with("p", "t", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    accuracy = paths.groupBy(*keys).agg(F.count(F.lit(1)).alias("particles"), F.avg(F.sqrt(squares)).alias("__accuracy"))
    spread = pair_distance_sums(paths, keys, F.col("p"), 2 * len(weights))
    n = F.col("particles")
    return accuracy.join(spread, list(keys)).select(
        *keys, "particles", F.when(n >= 2, F.col("__accuracy") - F.col("pair_sum") / (n * (n - 1))).alias("path_energy")
    )


def coordinate_crps(samples: DataFrame, keys: Sequence[str] = KEYS, bounded: bool = False) -> DataFrame:
    """CRPS per coordinate from ranks: the pair term is ``sum((2r-N-1)x) / (N(N-1))``, so no pairs are formed."""
    axes = F.array(
        F.struct(F.lit("east").alias("axis"), F.col("x").alias("v"), F.col("tx").alias("t")),
        F.struct(F.lit("north").alias("axis"), F.col("y").alias("v"), F.col("ty").alias("t")),
    )
    long = samples.select(*keys, F.inline(axes))
    if bounded:
        w = W.partitionBy(*keys, "axis")
        ranked = long.select("*", F.row_number().over(w.orderBy("v")).alias("r"), F.count(F.lit(1)).over(w).alias("n"))
    else:
        ranked = row_numbers(with_piece(long, "v"), [*keys, "axis"], [F.col("v")], F.col(PIECE), "r", total="n")
    n = F.max("n")
    return ranked.groupBy(*keys, "axis").agg(
        n.alias("particles"),
        F.when(
            n >= 2, F.avg(F.abs(F.col("v") - F.col("t"))) - F.sum((2 * F.col("r") - F.col("n") - 1) * F.col("v")) / (n * (n - 1))
        ).alias("crps"),
    )


def centres(samples: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Ensemble mean per forecast and slot with its distance to the target."""
    mean = samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("particles"), F.avg("x").alias("cx"), F.avg("y").alias("cy"),
        F.max("tx").alias("tx"), F.max("ty").alias("ty"),
    )
    return mean.withColumn("target_radius", distance("cx", "cy", "tx", "ty"))


def displacement_errors(samples: DataFrame, keys: Sequence[str] = ("method", "forecast_id")) -> DataFrame:
    """Average and final displacement of the ensemble mean over the registered slots."""
    return centres(samples, [*keys, "slot"]).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("slots"), F.avg("target_radius").alias("ade"), F.max_by("target_radius", "slot").alias("fde")
    )


def radii(samples: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Distance of every sample to its ensemble mean."""
    mean = centres(samples, keys).select(*keys, "cx", "cy")
    return samples.join(mean, list(keys)).select(*keys, distance("x", "y", "cx", "cy").alias("radius"))


def centre_coverage(samples: DataFrame, level: float = 0.9, keys: Sequence[str] = KEYS, bounded: bool = False) -> DataFrame:
    """Target inside the interpolated ``level`` quantile of the radii."""
    q = exact_quantiles(radii(samples, keys), keys, "radius", {"radius_q": level}, bounded=bounded)
    return centres(samples, keys).join(q, list(keys)).select(
        *keys, "target_radius", "radius_q", (F.col("target_radius") <= F.col("radius_q")).alias("covered")
    )


def radial_disks(
    samples: DataFrame, levels: Mapping[str, float], keys: Sequence[str] = KEYS, bounded: bool = False
) -> DataFrame:
    """Disk per level with the ceil(q*N)-th smallest radius: area and coverage, long form."""
    q = exact_quantiles(radii(samples, keys), keys, "radius", levels, rule="rank", bounded=bounded)
    rows = F.array(*[F.struct(F.lit(v).alias("level"), F.col(n).alias("radius")) for n, v in levels.items()])
    long = q.select(*keys, F.inline(rows))
    return centres(samples, keys).select(*keys, "target_radius").join(long, list(keys)).select(
        *keys, "level", "radius", (F.pi() * F.col("radius") * F.col("radius")).alias("area"),
        (F.col("target_radius") <= F.col("radius")).alias("covered"),
    )


def endpoint_quantiles(
    samples: DataFrame, probabilities: Mapping[str, float], last_slot: int, keys: Sequence[str] = ("method", "forecast_id"),
    bounded: bool = False,
) -> DataFrame:
    """Quantiles of particle endpoint error inside each forecast."""
    errors = samples.where(F.col("slot") == last_slot).select(*keys, distance("x", "y", "tx", "ty").alias("e"))
    return exact_quantiles(errors, keys, "e", probabilities, bounded=bounded)


def position_entropy(samples: DataFrame, half_width: float = 10000.0, cell: float = 250.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Plug-in entropy in nats on a fixed grid with one overflow bin."""
    inside = (F.abs("x") < half_width) & (F.abs("y") < half_width)
    bins = [F.when(inside, F.floor((F.col(c) + half_width) / cell)).otherwise(F.lit(-1)).alias(f"__{c}") for c in ("x", "y")]
    counts = samples.select(*keys, *bins).groupBy(*keys, "__x", "__y").agg(F.count(F.lit(1)).alias("__n"))
    n = F.sum("__n")
    # -sum(p ln p) with p = n/N is ln N - sum(n ln n)/N: one pass over the bins
    return counts.groupBy(*keys).agg(
        n.alias("particles"), F.count(F.lit(1)).alias("bins"), (F.ln(n) - F.sum(F.col("__n") * F.ln("__n")) / n).alias("entropy")
    )


def axis_intervals(samples: DataFrame, low: float = 0.05, high: float = 0.95, keys: Sequence[str] = KEYS, bounded: bool = False) -> DataFrame:
    """Central interval per axis, whether it holds the target, and the area of the rectangle."""
    out = None
    for axis in ("x", "y"):
        q = exact_quantiles(samples, keys, axis, {f"{axis}_low": low, f"{axis}_high": high}, bounded=bounded)
        out = q if out is None else out.join(q, list(keys))
    mean = centres(samples, keys).select(*keys, "tx", "ty")
    out = out.join(mean, list(keys))
    return out.select(
        *keys, F.col("tx").between(F.col("x_low"), F.col("x_high")).alias("x_inside"),
        F.col("ty").between(F.col("y_low"), F.col("y_high")).alias("y_inside"),
        ((F.col("x_high") - F.col("x_low")) * (F.col("y_high") - F.col("y_low"))).alias("area"),
    )


def rescaled(samples: DataFrame, scale: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """Samples pulled towards (or pushed from) their ensemble mean."""
    mean = centres(samples, keys).select(*keys, "cx", "cy")
    return samples.join(mean, list(keys)).select(
        *keys, "sample_idx", (F.col("cx") + scale * (F.col("x") - F.col("cx"))).alias("x"),
        (F.col("cy") + scale * (F.col("y") - F.col("cy"))).alias("y"), "tx", "ty",
    )


def weighted_score(per_slot: DataFrame, score: str, weights: Sequence[float], keys: Sequence[str]) -> DataFrame:
    """Time-weighted score; null unless every registered slot is present."""
    table = F.array(*[F.lit(float(w)) for w in weights])
    return per_slot.groupBy(*keys).agg(
        F.when(F.count(score) == len(weights), F.sum(F.get(table, F.col("slot").cast("int")) * F.col(score))).alias("weighted_score")
    )
