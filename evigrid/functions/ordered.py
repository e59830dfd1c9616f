"""Ordered computations over groups of any size.

A window ``partition by key`` sorts each key inside one task. When one key can hold a third of a table that task
never ends. Every helper here takes a ``chunk`` column, monotone in the requested order, and works in two levels:
rows are ordered inside ``(key, chunk)`` in parallel, and the carry between chunks is computed on one row per
``(key, chunk)``. The join which brings the carry back and the window share one exchange: both use one struct of keys and chunk,
in which nulls are values like any other, so no row with a null key or chunk is lost. A null chunk comes first. Results equal
those of the plain window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evigrid.session import materialise

CHUNK = "__chunk"
#: keys and chunk as one struct: equal structs may hold nulls
AT = "__where"
PIECE = "__piece"
PIECE_ROWS = 5_000_000
#: ranges that ``with_piece`` cuts at least
PIECES = 256


def piece_width(df: DataFrame, keys: Sequence[str], position: Column, widths: Sequence[int]) -> int:
    """Widest of ``widths`` (falling) at which no piece of any key holds more than five million rows.

    One scan with map-side counting at the widest setting decides in the usual case; a track which is much denser
    than the rest makes the pieces narrower.
    """
    for width in widths[:-1]:
        counts = df.groupBy(*keys, F.floor(position / F.lit(width)).alias(CHUNK)).agg(F.count(F.lit(1)).alias("n"))
        if (counts.agg(F.max("n")).first()[0] or 0) <= PIECE_ROWS:
            return width
    return widths[-1]


def place(keys: Sequence[str], chunk: Column) -> Column:
    """Keys and chunk of a row as the struct ``__where``."""
    return F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], chunk.alias(CHUNK)).alias(AT)


def within(keys: Sequence[str]) -> list[Column]:
    """The keys inside ``__where``, for windows over the carry."""
    return [F.col(AT)[f"k{i}"] for i in range(len(keys))]


def with_piece(df: DataFrame, value: str, tie: str | None = None, pieces: int = PIECES) -> DataFrame:
    """``df``, stored, with ``__piece``, monotone in ``value`` and then ``tie``, cut where the data are: neither an offset nor the range of
    values matters, and a frequent value is cut again by ``tie``. Null comes first.

    The pieces are the partitions of one range exchange: Spark samples the order columns, each row moves once, and the partition's
    number is the piece. The result is stored, so whoever orders within the pieces and whoever adds up their totals read the same rows and
    neither reads ``df`` again. At least ``pieces`` ranges are cut, as many as the session shuffles to if that is more.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(c).asc_nulls_first() for c in (value, tie) if c is not None]
    ranged = df.repartitionByRange(max(pieces, tasks), *order).withColumn(PIECE, F.spark_partition_id())
    # fewer files than pieces; a partition keeps its number
    return materialise(ranged.coalesce(tasks))


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    chunk: Column,
    sums: Mapping[str, Column],
    totals: bool = False,
) -> DataFrame:
    """Add inclusive running sums ``name -> expression`` in ``order`` within ``keys``.

    With ``totals`` the group totals are added as ``<name>_total``.
    """
    columns = [c for c in df.columns if c not in sums]
    staged = df.select("*", place(keys, chunk), *[e.alias(f"__v_{n}") for n, e in sums.items()])
    level = staged.groupBy(AT).agg(*[F.sum(f"__v_{n}").alias(f"__s_{n}") for n in sums])
    group = W.partitionBy(*within(keys))
    before = group.orderBy(F.col(AT)[CHUNK]).rowsBetween(W.unboundedPreceding, -1)
    carry = level.select(
        AT,
        *[F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__c_{n}") for n in sums],
        *([F.sum(f"__s_{n}").over(group).alias(f"{n}_total") for n in sums] if totals else []),
    )
    inside = W.partitionBy(AT).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return staged.join(carry, AT).select(
        *columns,
        *[(F.col(f"__c_{n}") + F.coalesce(F.sum(f"__v_{n}").over(inside), F.lit(0))).alias(n) for n in sums],
        *([f"{n}_total" for n in sums] if totals else []),
    )


def row_numbers(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], chunk: Column, name: str, total: str | None = None
) -> DataFrame:
    """``row_number()`` (1-based) in ``order`` within ``keys``; optionally the group size as ``total``."""
    out = running_sums(df, keys, order, chunk, {name: F.lit(1).cast("bigint")}, totals=total is not None)
    return out.withColumnRenamed(f"{name}_total", total) if total else out


def previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], chunk: Column, columns: Mapping[str, str]
) -> DataFrame:
    """``lag(column, 1)`` in ``order`` within ``keys`` for each ``new name -> column``."""
    kept = [c for c in df.columns if c not in columns]
    staged = df.select("*", place(keys, chunk))
    # a struct is never null, so the last row of a chunk is found whatever it holds
    last = staged.groupBy(AT).agg(
        F.max_by(F.struct(*[F.col(c).alias(f"__l_{n}") for n, c in columns.items()]), F.struct(*order)).alias("__last")
    )
    carry = last.select(AT, F.lag("__last").over(W.partitionBy(*within(keys)).orderBy(F.col(AT)[CHUNK])).alias("__carry"))
    inside = W.partitionBy(AT).orderBy(*order)
    first = F.row_number().over(inside) == 1
    return staged.join(carry, AT).select(
        *kept,
        *[
            F.when(first, F.col("__carry")[f"__l_{name}"]).otherwise(F.lag(column).over(inside)).alias(name)
            for name, column in columns.items()
        ],
    )
