"""Small column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def col(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def micros(value: ColumnLike) -> Column:
    """Microseconds since the epoch, for timestamps with and without a time zone."""
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", epoch, col(value).cast("timestamp_ntz"))


def is_finite(value: ColumnLike) -> Column:
    """True for a present, finite number."""
    c = col(value).cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def close_to(left: ColumnLike, right: ColumnLike, rtol: float = 1e-10, atol: float = 1e-10) -> Column:
    """Symmetric tolerance test: |a-b| <= max(rtol*max(|a|,|b|), atol)."""
    a, b = col(left), col(right)
    return F.abs(a - b) <= F.greatest(F.lit(rtol) * F.greatest(F.abs(a), F.abs(b)), F.lit(atol))


def exact_part(value: ColumnLike) -> Column:
    """The value as a decimal, whose sums do not depend on the order of addition; null beyond a billion and for NaN (``plain_part``)."""
    v = col(value)
    return F.when(F.abs(v) < 1e9, v).cast("decimal(28,18)")


def plain_part(value: ColumnLike) -> Column:
    """What ``exact_part`` leaves out, as a double: null, or the value where it is no decimal."""
    v = col(value)
    return F.when(~(F.abs(v) < 1e9), v)


def exact_mean(value: ColumnLike) -> Column:
    """Mean of an aggregate, the same in whatever order the rows are added; plain where a value is no decimal."""
    total = (F.sum(exact_part(value)) / F.count(col(value))).cast("double")
    return F.when(F.count(plain_part(value)) > 0, F.avg(col(value))).otherwise(total)


def relative_delta_pct(value: ColumnLike, reference: ColumnLike) -> Column:
    """100*(v-r)/|r|; null when the reference is zero or absent."""
    v, r = col(value), col(reference)
    return F.lit(100.0) * (v - r) / F.nullif(F.abs(r), F.lit(0.0))


def canonical_map(value: ColumnLike) -> Column:
    """A string map as JSON text with sorted keys: the stratum's comparable form."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(col(value)))))


def stratum_id(value: ColumnLike) -> Column:
    return F.sha2(canonical_map(value), 256)


def seal(*columns: ColumnLike) -> Column:
    """Content hash of a row over integer and text columns, joined by ``|`` with nulls written out."""
    parts = [F.coalesce(col(c).cast("string"), F.lit("null")) for c in columns]
    return F.sha2(F.concat_ws("|", *parts), 256)


def unit_interval_hash(salt: str, value: ColumnLike) -> Column:
    """Hash of ``salt || value`` as a number in [0,1): 15 hexadecimal digits, the most an int64 holds."""
    digits = F.substring(F.sha2(F.concat(F.lit(salt), col(value).cast("string")), 256), 1, 15)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(float(16**15))


def hash_index(parts: Sequence[ColumnLike], size: ColumnLike) -> Column:
    """Deterministic index in ``0..size-1`` named by the text of ``parts``: no generator state to share or replay."""
    # 15 digits, the most an int64 holds: groups of any size are drawn evenly
    digits = F.substring(F.md5(F.concat_ws(":", *[col(p).cast("string") for p in parts])), 1, 15)
    # never null, so a join on the index needs no null check, which would compute the hash a second time
    return F.coalesce(F.conv(digits, 16, 10).cast("bigint") % col(size), F.lit(0).cast("bigint"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it appears."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _density(x: Column) -> Column:
    return F.exp(-x * x / 2) / F.lit(math.sqrt(2 * math.pi))


def _upper_tail(x: Column) -> Column:
    """Probability of more than ``x`` (zero or more): a power series near zero, a continued fraction farther out."""
    odd = F.array(*[F.lit(float(k)) for k in range(81, 1, -2)])
    series = F.aggregate(odd, F.lit(1.0), lambda acc, k: 1 + x * x / k * acc)
    count = F.array(*[F.lit(float(k)) for k in range(60, 0, -1)])
    fraction = F.aggregate(count, x, lambda acc, k: x + k / acc)
    return F.when(x <= 2.5, F.lit(0.5) - _density(x) * x * series).otherwise(_density(x) / fraction)


def normal_cdf(value: ColumnLike) -> Column:
    """Normal distribution function, to 1e-14: column arithmetic that SQL can repeat. NaN gives null."""
    x = col(value).cast("double")
    tail = _let(F.abs(x), _upper_tail)
    return F.when(F.isnan(x), F.lit(None).cast("double")).when(x < 0, tail).otherwise(1 - tail)


def normal_quantile(value: ColumnLike) -> Column:
    """Inverse of the normal distribution function; null outside (0,1). A rational start, then two steps of third order."""
    p = col(value).cast("double")
    rare = F.least(p, 1 - p)

    # fixed values: coefficients of the rational approximation 26.2.23 in the Handbook of Mathematical Functions
    def start(t: Column) -> Column:
        return t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t)

    def step(x: Column) -> Column:
        return _let((_upper_tail(x) - rare) / _density(x), lambda u: x + u / (1 - u * x / 2))

    # the approximation falls below zero where p is near a half
    first = F.greatest(_let(F.sqrt(-2 * F.log(rare)), start), F.lit(0.0))
    size = _let(_let(first, step), step)
    return F.when((p > 0) & (p < 1), F.when(p < 0.5, -size).otherwise(size))
