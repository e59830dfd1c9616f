"""Data-quality operators. Each returns the violating rows, or every judged row with its verdict; none raises."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigrid.functions.ordered import previous
from evigrid.functions.scalars import ColumnLike, close_to, col, is_finite, seal
from evigrid.operators.pairing import full_compare


def row_violations(df: DataFrame, keys: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """One row per (row, broken rule). A rule is the condition of a violation; unknown is no violation."""
    tags = F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]))
    return df.select(*keys, F.explode(tags).alias("rule"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def single_valued(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Whether every row of a group carries the same values. Smallest equals largest: no distinct shuffle."""
    return df.groupBy(*keys).agg(
        *[
            ((F.min(c) == F.max(c)) & (F.count(c) == F.count(F.lit(1))) | (F.count(c) == 0)).alias(f"{c}_single")
            for c in columns
        ]
    )


def dependency_violations(df: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Keys which determine more than one value of ``value``."""
    pairs = df.groupBy(*key, value).agg(F.count(F.lit(1)).alias("__n"))
    return pairs.groupBy(*key).agg(
        F.count(value).alias("distinct_values"), F.sum("__n").alias("rows")
    ).where(F.col("distinct_values") > 1)


def contract_mismatches(counts: DataFrame, contract: DataFrame, keys: Sequence[str], n: str = "n") -> DataFrame:
    """Registered and observed counts which differ; an absent side counts as null."""
    return full_compare(contract, counts, keys, [n]).where(F.col("state") != "equal").select(
        *keys, F.col(f"{n}_left").alias("registered"), F.col(f"{n}_right").alias("observed"), "state"
    )


def all_or_none(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Groups in which ``column`` is present on some rows and absent on others."""
    counted = df.groupBy(*keys).agg(
        F.count(column).alias("present"), F.count_if(F.col(column).isNull()).alias("absent")
    )
    return counted.where((F.col("present") > 0) & (F.col("absent") > 0))


def gate_passes(operator: ColumnLike, value: ColumnLike, threshold: ColumnLike) -> Column:
    return F.when(col(operator) == "ge", col(value) >= col(threshold)).when(
        col(operator) == "le", col(value) <= col(threshold)
    )


def gate_mismatches(gates: DataFrame) -> DataFrame:
    """Stored pass flags which disagree with value, threshold and operator."""
    right = gate_passes("operator", "value", "threshold")
    return gates.withColumn("recomputed", right).where(~F.col("passed").eqNullSafe(right))


def stage_mismatches(df: DataFrame, names: ColumnLike, expected: Sequence[str]) -> DataFrame:
    """Rows whose stage names are not exactly the registered sequence."""
    return df.where(~col(names).eqNullSafe(F.array(*[F.lit(e) for e in expected])))


def number_violations(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Absent, not finite or negative numbers, long form."""
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    long = df.select(*keys, F.inline(rows))
    rule = F.when(F.col("value").isNull(), "absent").when(~is_finite("value"), "not_finite").when(
        F.col("value") < 0, "negative"
    )
    return long.withColumn("rule", rule).where(F.col("rule").isNotNull()).drop("value")


def not_increasing(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], chunk: Column, value: str
) -> DataFrame:
    """Rows whose value does not exceed that of the row before."""
    seen = previous(df, keys, order, chunk, {"previous_value": value})
    return seen.where(F.col(value) <= F.col("previous_value"))


def interval_violations(df: DataFrame, keys: Sequence[str], low: str, high: str) -> DataFrame:
    lo, hi = F.col(low), F.col(high)
    one = lo.isNull() != hi.isNull()
    rule = (
        F.when(one, "one_end_only").when(lo.isNotNull() & ~(is_finite(lo) & is_finite(hi)), "not_finite")
        .when(lo > hi, "reversed")
    )
    return df.select(*keys, rule.alias("rule")).where(F.col("rule").isNotNull())


def stored_value_mismatches(
    stored: DataFrame, recomputed: DataFrame, keys: Sequence[str], value: str, rtol: float, atol: float
) -> DataFrame:
    """Stored summaries which a recomputation does not reproduce; absent on either side counts."""
    joined = full_compare(stored, recomputed, keys, [value])
    a, b = F.col(f"{value}_left"), F.col(f"{value}_right")
    agree = F.coalesce(close_to(a, b, rtol, atol), a.isNull() & b.isNull())
    return joined.where(~agree).select(*keys, a.alias("stored"), b.alias("recomputed"))


def seal_mismatches(df: DataFrame, stored: str, columns: Sequence[str]) -> DataFrame:
    return df.where(~F.col(stored).eqNullSafe(seal(*columns)))


def bundle_hashes(files: DataFrame, keys: Sequence[str], path: str, digest: str) -> DataFrame:
    """SHA-256 of the ordered file list of each bundle, written as compact JSON: one definition at every size.

    A bundle is the list of a code base's source files, which one task holds. Sets without such a bound have
    ``fingerprint.sequence_fingerprint``, whose sums combine before the shuffle.
    """
    entry = F.concat(F.lit('{"path":"'), F.col(path), F.lit('","sha256":"'), F.col(digest), F.lit('"}'))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(path).alias("p"), entry.alias("e")))), lambda s: s["e"])
    text = F.concat(F.lit("["), F.array_join(ordered, ","), F.lit("]"))
    return files.groupBy(*keys).agg(F.sha2(text, 256).alias("bundle_sha256"))


# fixed values: patterns of text which must not be released, and file types which must not be
SENSITIVE = {
    "workstation path": r"(?i)(?:\b[A-Z]:[\\/]|[\\/]Users[\\/][^\\/]+|[\\/]home[\\/][^\\/]+)",
    "private key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "common access token": r"(?:gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{20,})",
}
FORBIDDEN_SUFFIXES = [".parquet", ".npy", ".npz", ".pt", ".pth", ".ckpt", ".zip", ".7z"]


def sensitive_lines(df: DataFrame, keys: Sequence[str], text: str, patterns: Mapping[str, str] = SENSITIVE) -> DataFrame:
    """Every (row, line, rule) hit over whole texts; a hit which spans lines counts for the line it begins in.

    A rule looks at the whole text once: where it hits, the line breaks before each hit are counted.
    """

    def breaks(part: Column) -> Column:
        return F.length(part) - F.length(F.replace(part, F.lit("\n"), F.lit("")))

    def lines(pattern: str) -> Column:
        both = F.arrays_zip(
            F.split(text, pattern, -1).alias("piece"), F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)).alias("hit")
        )
        start = F.struct(F.lit(1).cast("bigint").alias("line"), F.expr("cast(array() as array<bigint>)").alias("found"))
        walked = F.aggregate(
            F.filter(both, lambda b: b["hit"].isNotNull()), start,
            lambda a, b: F.struct(
                (a["line"] + breaks(b["piece"]) + breaks(b["hit"])).cast("bigint").alias("line"),
                F.concat(a["found"], F.array((a["line"] + breaks(b["piece"])).cast("bigint"))).alias("found"),
            ),
        )
        return F.when(F.col(text).rlike(pattern), F.array_distinct(walked["found"]))

    rules = F.array(*[F.struct(F.lit(n).alias("rule"), lines(p).alias("found")) for n, p in patterns.items()])
    return df.select(*keys, F.inline(rules)).select(*keys, F.explode("found").alias("line"), "rule")


def forbidden_suffixes(df: DataFrame, keys: Sequence[str], path: str, suffixes: Sequence[str]) -> DataFrame:
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return df.select(*keys, suffix.alias("suffix")).where(F.col("suffix").isin(list(suffixes)))


JSON_STRING = r'"(?:[^"\\]|\\.)*"(?:\s*:)?'


def forbidden_fields(df: DataFrame, keys: Sequence[str], document: str, fields: Sequence[str]) -> DataFrame:
    """Forbidden keys at any depth of JSON text: strings are read from left to right, those before a colon are keys."""
    strings = F.regexp_extract_all(F.col(document), F.lit(JSON_STRING), F.lit(0))
    names = F.transform(F.filter(strings, lambda m: m.endswith(":")), lambda m: F.regexp_extract(m, r'^"(.*)"\s*:$', 1))
    return df.select(*keys, F.explode(F.array_intersect(names, F.array(*[F.lit(f) for f in fields]))).alias("field"))


def text_profile(df: DataFrame, keys: Sequence[str], text: str, limits: Mapping[str, int]) -> DataFrame:
    """Bytes, lines and longest line of each text, and whether all stay within their limits."""
    lines = F.split(text, "\n")
    measured = df.select(
        *keys, F.octet_length(text).cast("bigint").alias("bytes"), F.size(lines).cast("bigint").alias("lines"),
        F.array_max(F.transform(lines, lambda x: F.length(x))).cast("bigint").alias("longest_line"),
    )
    ok = F.lit(True)
    for name, limit in limits.items():
        ok = ok & (F.col(name) <= limit)
    return measured.withColumn("within", ok)


def permitted(
    grants: DataFrame, purposes: str, required: Sequence[str], blocks: str, block: Column, expires: str, now: Column,
    visibility: Column,
) -> DataFrame:
    """Grants which cover every required purpose, name the block, are visible and have not expired."""
    need = F.array(*[F.lit(r) for r in required])
    return grants.where(
        (F.size(F.array_except(need, F.col(purposes))) == 0) & F.array_contains(F.col(blocks), block)
        & (now < F.col(expires)) & visibility
    )


def chain_order(events: DataFrame, keys: Sequence[str], kind: str, sequence: str, chain: Sequence[str]) -> DataFrame:
    """First position of each kind per attempt and whether they come in the registered order."""
    first = events.groupBy(*keys).agg(
        *[F.min(F.when(F.col(kind) == k, F.col(sequence))).alias(f"first_{k}") for k in chain]
    )
    ok = F.lit(True)
    for a, b in zip(chain, chain[1:], strict=False):
        ok = ok & F.coalesce(F.col(f"first_{a}") < F.col(f"first_{b}"), F.lit(False))
    return first.withColumn("ordered", ok)


def check_coverage(
    required: DataFrame, evidence: DataFrame, keys: Sequence[str], passed: Column, bound: Column
) -> DataFrame:
    """A required check is covered by exactly one evidence row, which passed with matching bindings."""
    counted = evidence.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.bool_and(passed & bound).alias("__good")
    )
    joined = required.join(counted, list(keys), "left")
    return joined.select(
        *keys, F.coalesce("rows", F.lit(0)).alias("rows"),
        ((F.coalesce("rows", F.lit(0)) == 1) & F.coalesce("__good", F.lit(False))).alias("covered"),
    )
