"""Block resampling with indices computed from a hash, so any executor can rebuild any draw."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evigrid.functions.ordered import PIECE, row_numbers, with_piece
from evigrid.functions.scalars import ColumnLike, col, hash_index
from evigrid.session import materialise

BATCH = 50
#: stored bytes of a unit table up to which it is sent to every task; beyond, both sides are sorted by index
BROADCAST_BYTES = 8 * 1024 * 1024
#: units of a group up to which they meet in a task as vectors; larger groups are drawn row by row, with the same values
VECTOR_UNITS = 200_000


def block_slots(units: DataFrame, keys: Sequence[str], unit: str, chunk: Column | None = None) -> DataFrame:
    """Number the units of each group 0..B-1 in order of their id and add the group size."""
    if chunk is not None:
        numbered = row_numbers(units, keys, [F.col(unit)], chunk, "slot", total="size")
    else:
        numbered = row_numbers(with_piece(units, unit), keys, [F.col(unit)], F.col(PIECE), "slot", total="size").drop(PIECE)
    # one row per unit: stored, because draws read it as positions and as values
    return materialise(numbered.withColumn("slot", F.col("slot") - 1))


def draw_rows(
    slots: DataFrame, keys: Sequence[str], values: Sequence[str], draws: int, stream: str,
    label: Sequence[ColumnLike] | None = None,
) -> DataFrame:
    """One row per (group, draw, slot) with the values of the unit drawn there.

    Draws are handed out in batches before they are expanded, so the expansion is spread over all tasks even when
    the unit table is small. The unit table is joined by index. Spark does not see that the other side has grown by
    the number of draws and might broadcast that one, so the strategy is stated: the unit table is broadcast when its
    size, added up over the stored units, is small; otherwise both sides are sorted by index. The rows are the same.
    """
    session = slots.sparkSession
    unit = F.to_json(F.struct(*[F.col(c) for c in dict.fromkeys([*keys, "slot", *values])]))
    small = (slots.agg(F.sum(F.octet_length(unit))).first()[0] or 0) <= BROADCAST_BYTES
    width = int(session.conf.get("spark.sql.shuffle.partitions"))
    batches = slots.select(
        *keys, "size", "slot", F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // BATCH))).alias("__batch")
    ).repartition(width, *keys, "slot", "__batch")
    first = F.col("__batch") * BATCH
    last = F.least(first + BATCH - 1, F.lit(draws - 1))
    expanded = batches.select(*keys, "size", "slot", F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))).alias("draw"))
    named = [F.lit(stream), *(label if label is not None else keys), F.col("draw"), F.col("slot")]
    # keys as one struct: equal structs may hold nulls
    place = F.struct(F.lit(0).alias("n"), *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]).alias("__at")
    picked = expanded.select(*keys, "draw", place, hash_index(named, "size").alias("__pick"))
    table = slots.select(place, F.col("slot").alias("__pick"), *values)
    table = F.broadcast(table) if small else table.hint("merge")
    return picked.join(table, ["__at", "__pick"]).drop("__at", "__pick")


def bootstrap_means(
    slots: DataFrame, keys: Sequence[str], values: Sequence[str], draws: int, stream: str,
    label: Sequence[ColumnLike] | None = None, deviations: bool = False,
) -> DataFrame:
    """Mean (and sample deviation) of each value in each draw."""
    if _held(slots):
        statistics = [(v, v, "mean") for v in values] + ([(f"{v}_sd", v, "deviation") for v in values] if deviations else [])
        out = drawn_vectors(slots, keys, statistics, draws, stream, label)
        return out if deviations else out.drop("size")
    rows = draw_rows(slots, keys, values, draws, stream, label)
    out = [F.avg(v).alias(v) for v in values]
    if deviations:
        out += [F.stddev_samp(v).alias(f"{v}_sd") for v in values] + [F.count(F.lit(1)).alias("size")]
    return rows.groupBy(*keys, "draw").agg(*out)


def bootstrap_both(
    slots: DataFrame, keys: Sequence[str], means: Sequence[str], medians: Sequence[str], draws: int, stream: str,
    label: Sequence[ColumnLike] | None = None,
) -> DataFrame:
    """Means and medians of one set of draws."""
    if _held(slots):
        statistics = [(v, v, "mean") for v in means] + [(v, v, "median") for v in medians]
        return drawn_vectors(slots, keys, statistics, draws, stream, label).drop("size")
    rows = draw_rows(slots, keys, list(dict.fromkeys([*means, *medians])), draws, stream, label)
    return rows.groupBy(*keys, "draw").agg(
        *[F.avg(v).alias(v) for v in means], *[F.percentile(v, F.lit(0.5)).alias(v) for v in medians]
    )


def _held(slots: DataFrame) -> bool:
    """Whether the units of every group fit a task as vectors; the table is stored, so this reads one column of it."""
    return (slots.agg(F.max("size")).first()[0] or 0) <= VECTOR_UNITS


def drawn_vectors(
    slots: DataFrame, keys: Sequence[str], statistics: Sequence[tuple[str, str, str]], draws: int, stream: str,
    label: Sequence[ColumnLike] | None = None,
) -> DataFrame:
    """Statistics ``(name, value column, mean | deviation | median)`` of each draw, and the ``size`` of the group.

    The units of a group meet once per batch of draws and stay in the task as vectors; a draw is an index vector, and only its
    statistics leave the task. What is shuffled does not depend on the number of draws, and the indices are those of ``draw_rows``.
    Nulls are left out, as Spark's aggregates do.
    """
    values = list(dict.fromkeys(v for _, v, _ in statistics))
    # the index text up to the draw; null labels are skipped as in the text of one index
    prefix = F.concat_ws(":", F.lit(stream), *[col(p).cast("string") for p in (label if label is not None else keys)])
    # under names of their own: a key may bear the name of a column here
    named = slots.select(
        *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], prefix.alias("prefix"), "size", "slot",
        *[F.col(v).cast("double").alias(f"v{i}") for i, v in enumerate(values)],
        F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // BATCH))).alias("batch"),
    )
    shape = [(f"k{i}", slots.schema[k].dataType) for i, k in enumerate(keys)]
    schema = T.StructType([T.StructField(n, t) for n, t in shape] + [T.StructField("draw", T.LongType()), T.StructField("size", T.LongType())])
    for i in range(len(statistics)):
        schema = schema.add(f"s{i}", T.DoubleType())
    plan = [(f"v{values.index(v)}", kind) for _, v, kind in statistics]
    batch_size = BATCH

    def statistic(picked, known, kind: str) -> float | None:
        import numpy as np

        picked = picked if known is None else picked[known]
        n = len(picked)
        if n == 0 or (kind == "deviation" and n < 2):
            return None
        if kind == "mean":
            return float(picked.mean())
        if kind == "deviation":
            return float(picked.std(ddof=1))
        ordered = np.partition(picked, [(n - 1) // 2, n // 2])
        low, high = float(ordered[(n - 1) // 2]), float(ordered[n // 2])
        return low if low == high else 0.5 * low + 0.5 * high

    def evaluate(group: pa.Table) -> pa.Table:
        from hashlib import md5

        import numpy as np

        group = group.take(pa.array(np.argsort(group.column("slot").to_numpy())))
        size = group.num_rows
        vectors = {name: group.column(name).to_numpy() for name, _ in plan}
        known = {name: None if not group.column(name).null_count else group.column(name).is_valid().to_numpy() for name, _ in plan}
        head = group.column("prefix")[0].as_py().encode()
        slots_text = [b"%d" % s for s in range(size)]
        first = group.column("batch")[0].as_py() * batch_size
        numbers = range(first, min(first + batch_size, draws))
        out: list[list[float | None]] = [[] for _ in plan]
        for draw in numbers:
            start = b"%s:%d:" % (head, draw)
            digests = b"".join([md5(start + s).digest() for s in slots_text])
            # fifteen hexadecimal digits
            pick = ((np.frombuffer(digests, dtype=">u8")[::2] >> np.uint64(4)) % np.uint64(size)).astype(np.int64)
            for i, (name, kind) in enumerate(plan):
                out[i].append(statistic(vectors[name][pick], None if known[name] is None else known[name][pick], kind))
        times = pa.array([0] * len(numbers), pa.int64())
        keyed = group.select([f"k{i}" for i in range(len(shape))]).take(times) if shape else None
        columns = [*(keyed.columns if shape else []), pa.array(list(numbers), pa.int64()), pa.array([size] * len(numbers), pa.int64())]
        return pa.table([*columns, *[pa.array(o, pa.float64()) for o in out]], names=schema.names)

    # few bytes, but much work: the number of tasks is stated, or the planner would join them
    width = int(slots.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = [*[n for n, _ in shape], "batch"]
    drawn = named.repartition(width, *cells).groupBy(*cells).applyInArrow(evaluate, schema)
    return drawn.select(
        *[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "draw", *[F.col(f"s{i}").alias(n) for i, (n, _, _) in enumerate(statistics)],
        "size",
    )


def order_statistics(
    estimates: DataFrame, keys: Sequence[str], value: str, draws: int, low: int, high: int
) -> DataFrame:
    """The ``low``-th and ``high``-th smallest of the draws; the number of draws is a fixed parameter."""
    # percentile_disc(p) is the ceil(p*n)-th value; half a step below k/n avoids landing on the next one
    pick = [
        F.expr(f"percentile_disc({(k - 0.5) / draws!r}) within group (order by {value})").alias(name)
        for name, k in (("low", low), ("high", high))
    ]
    return estimates.groupBy(*keys).agg(*pick)
