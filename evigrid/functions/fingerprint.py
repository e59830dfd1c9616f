"""Order-aware fingerprints which merge like sums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evigrid.functions.scalars import ColumnLike, col


def element_digest(index: ColumnLike, content: ColumnLike) -> Column:
    """Digest of one element at its position."""
    return F.md5(F.concat_ws(":", col(index).cast("string"), col(content).cast("string")))


def sequence_fingerprint(digest: ColumnLike) -> Column:
    """Aggregate of element digests: length and two 48-bit digest sums.

    Positions are part of each digest, so the result depends on order, and it combines on the map side; the
    sequence itself is never gathered.
    """
    halves = [
        F.sum(F.conv(F.substring(col(digest), start, 12), 16, 10).cast("decimal(20,0)")).cast("string") for start in (1, 13)
    ]
    return F.concat_ws("-", F.count(F.lit(1)).cast("string"), *halves)
