"""Trajectory preparation: segments, windows, frames, features, fits. Points are ordered by ``(segment_id, idx)``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evigrid.functions.fingerprint import element_digest, sequence_fingerprint
from evigrid.functions.ordered import AT, CHUNK, place, previous, within
from evigrid.functions.scalars import ColumnLike, col

EARTH_RADIUS_M = 6371000.0


def reasons(rules: Mapping[str, Column]) -> Column:
    """Names of the rules a row breaks, in registered order."""
    return F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]))


def segment_points(
    points: DataFrame, key: str, order: Sequence[Column], chunk: Column, time: str, gap: int,
    sums: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Split each track where time runs back or a gap is exceeded; add ``seg``, ``idx`` (0-based) and size ``n``.

    One long track is worked on by many tasks: breaks and running sums are found inside time chunks, and a row per
    (track, chunk) carries the counts, and the break between two chunks, to the next. ``order`` begins with ``time``.
    """
    sums = dict(sums or {})
    names = ["__breaks", "__at", *sums]
    inside = W.partitionBy(AT).orderBy(*order)
    before = F.lag(time).over(inside)
    t = F.col(time)
    gone = F.coalesce((t - before > gap) | (t < before), F.lit(False)).cast("bigint")
    staged = points.select("*", place([key], chunk)).select(
        "*", gone.alias("__v___breaks"), F.lit(1).cast("bigint").alias("__v___at"), *[e.alias(f"__v_{n}") for n, e in sums.items()]
    )
    level = staged.groupBy(AT).agg(
        F.min(time).alias("__first"), F.max(time).alias("__last"), *[F.sum(f"__v_{n}").alias(f"__s_{n}") for n in names]
    )
    ordered = W.partitionBy(*within([key])).orderBy(F.col(AT)[CHUNK])
    last = F.lag("__last").over(ordered)
    # the first chunk of a track opens its first segment
    opens = F.coalesce(F.col("__first") - last > gap, F.row_number().over(ordered) == 1).cast("bigint")
    earlier = ordered.rowsBetween(W.unboundedPreceding, -1)
    carry = level.withColumn("__opens", opens).select(
        AT,
        (F.coalesce(F.sum("__s___breaks").over(earlier), F.lit(0)) + F.sum("__opens").over(ordered)).alias("__c___breaks"),
        *[F.coalesce(F.sum(f"__s_{n}").over(earlier), F.lit(0)).alias(f"__c_{n}") for n in names[1:]],
    )
    running = inside.rowsBetween(W.unboundedPreceding, 0)
    walked = staged.join(carry, AT).select(
        *points.columns, *[(F.col(f"__c_{n}") + F.coalesce(F.sum(f"__v_{n}").over(running), F.lit(0))).alias(n) for n in names]
    ).withColumnRenamed("__breaks", "seg")
    # as a struct, a null track keeps its segments too
    placed = walked.select("*", place([key], F.col("seg")))
    bounds = placed.groupBy(AT).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("n"))
    return placed.join(bounds, AT).select(
        *points.columns, "seg", *sums, (F.col("__at") - F.col("__first")).alias("idx"), "n"
    )


def clock_flags(points: DataFrame, key: str, order: Sequence[Column], chunk: Column, time: str, gap: int) -> DataFrame:
    """Duplicate, backward and long-gap flags per point; false at the first point."""
    linked = previous(points, [key], order, chunk, {"previous_time": time})
    step = F.col(time) - F.col("previous_time")
    return linked.select(
        "*", F.coalesce(step == 0, F.lit(False)).alias("duplicate"), F.coalesce(step < 0, F.lit(False)).alias("backward"),
        F.coalesce(step > gap, F.lit(False)).alias("long_gap"),
    )


def origin_index(n: ColumnLike = "n") -> Column:
    """Last history index of the midpoint window."""
    return F.greatest(F.lit(1).cast("bigint"), F.floor(col(n) / 2)) - 1


def midpoint_window(points: DataFrame) -> DataFrame:
    """History up to the origin, targets after it; segments below four points have no window."""
    return points.where(F.col("n") >= 4).withColumn(
        "role", F.when(F.col("idx") <= origin_index(), "history").otherwise("target")
    )


def origin_states(points: DataFrame) -> DataFrame:
    """One row per window with the last three history points and the first target, by conditional aggregates.

    Positions are known from ``idx`` and ``n``, so no sorted window is needed.
    """
    at = F.col("idx") - origin_index()
    fields = {"x": "x", "y": "y", "t": "t_us"}
    picks = [
        F.max(F.when(at == offset, F.col(source))).alias(f"{name}{tag}")
        for offset, tag in ((-2, "_2"), (-1, "_1"), (0, "0"), (1, "1"))
        for name, source in fields.items()
    ]
    return points.where(F.col("n") >= 4).groupBy("segment_id").agg(F.max("n").alias("n"), *picks)


def secant_velocity(origins: DataFrame) -> DataFrame:
    """Velocity from the first to the last of the last three history points, in units per second."""
    seconds = (F.col("t0") - F.col("t_2")) / 1e6
    usable = F.col("t_2").isNotNull() & (F.col("t_2") < F.col("t_1")) & (F.col("t_1") < F.col("t0"))
    return origins.withColumn("vx", F.when(usable, (F.col("x0") - F.col("x_2")) / seconds)).withColumn(
        "vy", F.when(usable, (F.col("y0") - F.col("y_2")) / seconds)
    )


def constant_velocity(states: DataFrame, horizons: Sequence[float]) -> DataFrame:
    """Straight-line prediction at each registered horizon."""
    slots = F.array(*[F.struct(F.lit(i).alias("slot"), F.lit(float(u)).alias("u")) for i, u in enumerate(horizons)])
    return states.where(F.col("vx").isNotNull()).select("segment_id", "x0", "y0", "vx", "vy", F.inline(slots)).select(
        "segment_id", "slot", (F.col("x0") + F.col("u") * F.col("vx")).alias("px"), (F.col("y0") + F.col("u") * F.col("vy")).alias("py")
    )


def first_transition(origins: DataFrame) -> DataFrame:
    """Displacement and elapsed seconds from the origin to the first target."""
    return origins.select(
        "segment_id", (F.col("x1") - F.col("x0")).alias("dx"), (F.col("y1") - F.col("y0")).alias("dy"),
        ((F.col("t1") - F.col("t0")) / 1e6).alias("dt"),
    )


def window_spans(points: DataFrame) -> DataFrame:
    """Visible, follow-up and whole span of each window in seconds, long form."""
    last = F.max(F.when(F.col("idx") == F.col("n") - 1, F.col("t_us")))
    first = F.max(F.when(F.col("idx") == 0, F.col("t_us")))
    origin = F.max(F.when(F.col("idx") == origin_index(), F.col("t_us")))
    spans = F.array(
        *[
            F.struct(F.lit(name).alias("part"), ((b - a) / 1e6).alias("seconds"))
            for name, a, b in (("visible", F.col("a"), F.col("o")), ("followup", F.col("o"), F.col("z")), ("whole", F.col("a"), F.col("z")))
        ]
    )
    ends = points.where(F.col("n") >= 4).groupBy("segment_id").agg(first.alias("a"), origin.alias("o"), last.alias("z"))
    return ends.select("segment_id", F.inline(spans))


def local_projection(points: DataFrame, keys: Sequence[str], lon: str, lat: str) -> DataFrame:
    """Equirectangular metres around the centroid of each group; the centroid is joined back, not windowed."""
    centre = points.groupBy(*keys).agg(F.avg(lon).alias("__lon0"), F.avg(lat).alias("__lat0"))
    east = F.lit(EARTH_RADIUS_M) * F.radians(F.col(lon) - F.col("__lon0")) * F.cos(F.radians("__lat0"))
    north = F.lit(EARTH_RADIUS_M) * F.radians(F.col(lat) - F.col("__lat0"))
    return points.join(centre, list(keys)).withColumn("east", east).withColumn("north", north).drop("__lon0", "__lat0")


def origin_frame(points: DataFrame) -> DataFrame:
    """Positions relative to the origin point of their window."""
    origin = points.where((F.col("n") >= 4) & (F.col("idx") == origin_index())).select(
        "segment_id", F.col("x").alias("__x0"), F.col("y").alias("__y0"), F.col("t_us").alias("__t0")
    )
    return points.join(origin, "segment_id").select(
        "segment_id", "idx", (F.col("x") - F.col("__x0")).alias("rx"), (F.col("y") - F.col("__y0")).alias("ry"),
        ((F.col("t_us") - F.col("__t0")) / 1e6).alias("rt"),
    )


def recording_block(coordinates: ColumnLike, speeds: ColumnLike) -> Column:
    """Block identity of a recording: hash over both literal texts, each closed by a NUL."""
    nul = F.decode(F.unhex(F.lit("00")), "UTF-8")
    return F.sha2(F.concat(col(coordinates), nul, col(speeds), nul), 256)


def normal_number(value: ColumnLike) -> Column:
    """Text of a number in which both zeros and all NaNs are the same."""
    c = col(value)
    return F.when(F.isnan(c), "NaN").when(c == 0, "0.0").otherwise(c.cast("string"))


def track_fingerprints(
    points: DataFrame, keys: Sequence[str], index: str, columns: Sequence[str], clock: str | None = None
) -> DataFrame:
    """Fingerprint of each whole track: coordinates in order, and the clock where it is asked for.

    Equal tracks have equal fingerprints; positions combine on the map side, so no track is gathered.
    """
    parts = [normal_number(c) for c in columns] + ([F.col(clock).cast("string")] if clock else [])
    return points.groupBy(*keys).agg(
        sequence_fingerprint(element_digest(index, F.concat_ws(",", *parts))).alias("fingerprint")
    )


def resampled_transitions(points: DataFrame, tau: int, chunk_buckets: int = 64) -> DataFrame:
    """First point of each ``tau``-wide time bucket per segment, and the steps between consecutive ones."""
    bucketed = points.withColumn("bucket", F.floor(F.col("t_us") / F.lit(tau)))
    firsts = bucketed.groupBy("segment_id", "bucket").agg(F.min_by(F.struct("x", "y", "t_us"), "idx").alias("p")).select(
        "segment_id", "bucket", "p.*"
    )
    linked = previous(
        firsts, ["segment_id"], [F.col("bucket")], F.floor(F.col("bucket") / chunk_buckets),
        {"px": "x", "py": "y", "pt": "t_us"},
    )
    return linked.where(F.col("pt").isNotNull()).select(
        "segment_id", "bucket", (F.col("x") - F.col("px")).alias("dx"), (F.col("y") - F.col("py")).alias("dy"),
        ((F.col("t_us") - F.col("pt")) / 1e6).alias("dt"),
    )


def unit(value: ColumnLike, length: ColumnLike) -> Column:
    return col(value) / F.nullif(col(length), F.lit(0.0))


def clipped_standardisation(df: DataFrame, keys: Sequence[str], columns: Sequence[str], train: Column, clip: float) -> DataFrame:
    """Centre and scale by training rows only, then clip."""
    stats = df.where(train).agg(
        F.struct(
            *[F.avg(c).alias(f"__m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"__s_{c}") for c in columns]
        ).alias("s")
    ).scalar()
    return df.withColumn("__s", stats).select("*", "__s.*").select(
        *keys,
        *[
            F.greatest(F.lit(-clip), F.least(F.lit(clip), (F.col(c) - F.col(f"__m_{c}")) / F.nullif(F.col(f"__s_{c}"), F.lit(0.0)))).alias(c)
            for c in columns
        ],
    )


# fixed values: land-cover codes by group; any other valid code is "other"
COVER_GROUPS = {"built": [50], "vegetated": [10, 20, 30, 40, 95, 100], "water": [80, 90]}


def cover_indicators(code: ColumnLike) -> dict[str, Column]:
    """Four indicator columns; a missing code is null in all of them and never "other"."""
    c = col(code)
    known = [x for codes in COVER_GROUPS.values() for x in codes]
    out = {name: F.when(c.isNotNull(), c.isin(codes).cast("int")) for name, codes in COVER_GROUPS.items()}
    out["other"] = F.when(c.isNotNull(), (~c.isin(known)).cast("int"))
    return out


def with_masks(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Each numeric column filled with zero next to its validity mask."""
    return df.select(
        *keys, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns],
        *[F.col(c).isNotNull().alias(f"{c}_valid") for c in columns],
    )


def ridge_fit(df: DataFrame, keys: Sequence[str], features: Sequence[str], targets: Sequence[str], penalty: float) -> DataFrame:
    """Ridge coefficients ``(X'X + n*penalty*I) theta = X'Y`` per configuration, long form.

    The data are reduced to their product sums by one aggregate; what is solved is a k-by-k system per row.
    """
    k, m = len(features), len(targets)
    gram = [F.sum(F.col(a) * F.col(b)) for a in features for b in features]
    cross = [F.sum(F.col(a) * F.col(b)) for a in features for b in targets]
    sums = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array(*gram).alias("g"), F.array(*cross).alias("c"))

    def solve(n: pd.Series, g: pd.Series, c: pd.Series) -> pd.Series:
        import numpy as np

        out = []
        for count, left, right in zip(n, g, c, strict=True):
            a = np.asarray(left, dtype="float64").reshape(k, k) + count * penalty * np.eye(k)
            out.append(np.linalg.solve(a, np.asarray(right, dtype="float64").reshape(k, m)).ravel().tolist())
        return pd.Series(out)

    theta = F.pandas_udf(solve, T.ArrayType(T.DoubleType()))("n", "g", "c")
    names = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(t).alias("target")) for f in features for t in targets])
    solved = sums.select(*keys, "n", theta.alias("theta"))
    return solved.select(*keys, "n", F.posexplode(names).alias("__i", "__name"), "theta").select(
        *keys, "n", "__name.feature", "__name.target", F.get("theta", F.col("__i")).alias("theta")
    )


def diffusion_moment(df: DataFrame, keys: Sequence[str], ex: Column, ey: Column, dt: Column) -> DataFrame:
    """Second moment of displacement residuals per unit time; residuals are not centred and the divisor is n."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(ex * ex / dt).alias("qxx"), F.avg(ex * ey / dt).alias("qxy"), F.avg(ey * ey / dt).alias("qyy")
    )


def interval_bins(value: Column, edges: Sequence[float]) -> Column:
    """Label of the half-open bin ``(a,b]``; null outside."""
    out = None
    for a, b in zip(edges, edges[1:], strict=False):
        test, label = (value > a) & (value <= b), f"({a:g},{b:g}]"
        out = F.when(test, label) if out is None else out.when(test, label)
    return out
