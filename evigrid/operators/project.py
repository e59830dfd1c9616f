"""Flattening of nested documents, scope filters, names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigrid.functions.scalars import ColumnLike, col
from evigrid.operators.rollup import SUCCEEDED


def process_rows(records: DataFrame) -> DataFrame:
    """Run records as flat rows: first gate only, ids joined by ``;``, absent metrics null."""
    gate = F.get("mechanism_gates", F.lit(0))
    metric = [F.try_element_at("metrics", F.lit(m)).alias(m) for m in ("energy_score_d2", "hdr90_coverage", "cep50_error")]
    return records.select(
        "arm_id", "subconfig_id", "group", F.coalesce("slot", F.lit("")).alias("slot"), F.array_join("lineage.idea_ids", ";").alias("idea_ids"),
        F.col("lineage.role").alias("lineage_role"), F.col("lineage.confidence").alias("lineage_confidence"),
        "implementation_status", "run_status", "verdict", F.col("dataset.dataset_id").alias("dataset_id"),
        F.col("runtime.requested_prediction_samples").alias("requested_prediction_samples"),
        F.col("runtime.effective_prediction_samples").alias("effective_prediction_samples"), "replicate_seed", "result_id", *metric,
        gate["statistic"].alias("mechanism_statistic"), gate["value"].alias("mechanism_value"),
        gate["threshold"].alias("mechanism_threshold"), gate["passed"].alias("mechanism_passed"),
    )


def comparison_rows(families: DataFrame, keys: Sequence[str], nested: str) -> DataFrame:
    """``family -> comparison -> {verdict, inference, descriptive}`` as rows; inferred values win over descriptive ones."""
    by_family = families.select(*keys, F.explode(nested).alias("family_id", "__c"))
    rows = by_family.select(*keys, "family_id", F.explode("__c").alias("comparison_id", "r"))
    return rows.select(
        *keys, "family_id", "comparison_id", F.col("r.verdict").alias("verdict"),
        F.coalesce("r.inference.delta", "r.descriptive.delta").alias("delta"),
        F.get("r.inference.interval", F.lit(0)).alias("lower"), F.get("r.inference.interval", F.lit(1)).alias("upper"),
    )


def gated_metrics(df: DataFrame, keys: Sequence[str], means: str, metrics: Sequence[str]) -> DataFrame:
    """Metric columns which are null unless the group was computed."""
    return df.select(*keys, "status", *[F.when(F.col("status") == "computed", F.col(f"{means}.{m}")).alias(m) for m in metrics])


def slot_rows(df: DataFrame, keys: Sequence[str], values: str, nominal: Sequence[float]) -> DataFrame:
    """One row per registered slot even where the array is null or short."""
    slots = F.array(*[F.struct(F.lit(i).alias("slot"), F.lit(float(t)).alias("nominal")) for i, t in enumerate(nominal)])
    return df.select(*keys, values, F.inline(slots)).select(*keys, "slot", "nominal", F.get(values, F.col("slot")).alias("value"))


def region_rows(df: DataFrame, keys: Sequence[str], by_time: str, slots: int, levels: Sequence[float]) -> DataFrame:
    """One row per slot and registered level; a level which was not reported is null.

    ``by_time`` is an array over slots of maps from level to value; the grid is built per row, so nothing is joined.
    """
    grid = F.array(
        *[F.struct(F.lit(i).alias("slot"), F.lit(float(v)).alias("level")) for i in range(slots) for v in levels]
    )
    return df.select(*keys, by_time, F.inline(grid)).select(
        *keys, "slot", "level", F.try_element_at(F.get(by_time, F.col("slot")), F.col("level")).alias("value")
    )


def owners(df: DataFrame, nested: str, name: str = "name", value: str = "owner") -> DataFrame:
    """Map entries of all documents as one table; names which occur with different values are in conflict."""
    entries = df.select(F.explode(nested).alias(name, value))
    return entries.groupBy(name).agg(
        F.min(value).alias(value), F.count(F.lit(1)).alias("documents"), (F.min(value) != F.max(value)).alias("conflict")
    )


RESERVED_AXES = ("arm_id", "block_id", "seed")


def normal_dimensions(df: DataFrame, keys: Sequence[str], dimensions: str, axes: Sequence[str]) -> DataFrame:
    """Fixed axis columns merged into the dimension map; conflicting and reserved names are reported, not merged."""
    d = F.col(dimensions)
    clash = F.lit(False)
    for a in axes:
        known = F.try_element_at(d, F.lit(a))
        clash = clash | F.coalesce(known != F.col(a), F.lit(False))
    reserved = F.arrays_overlap(F.map_keys(d), F.array(*[F.lit(r) for r in RESERVED_AXES]))
    present = F.map_filter(F.create_map(*[x for a in axes for x in (F.lit(a), F.col(a).cast("string"))]), lambda k, v: v.isNotNull())
    fresh = F.map_filter(present, lambda k, v: ~F.array_contains(F.map_keys(d), k))
    state = F.when(reserved, "reserved_key").when(clash, "conflict").otherwise("ok")
    return df.select(*keys, state.alias("state"), F.when(state == "ok", F.map_concat(d, fresh)).alias("dimensions"))


def output_status(applies: Column, qualification: ColumnLike) -> Column:
    """Qualification of a path output: null where it does not apply, UNRESOLVED where it is not a known word."""
    q = col(qualification)
    return F.when(applies, F.when(q.isin("PASSED", "FAILED"), q).otherwise("UNRESOLVED"))


def comparison_eligible(status: ColumnLike, output: Column) -> Column:
    return (col(status) == SUCCEEDED) & (output.isNull() | (output == "PASSED"))


def anonymous(df: DataFrame, private: Sequence[str], nested: Mapping[str, Sequence[str]]) -> DataFrame:
    """Drop private columns, and private fields inside arrays of structs."""
    def without(names: Sequence[str]):
        return lambda s: s.dropFields(*names)

    return df.drop(*private).withColumns({c: F.transform(c, without(names)) for c, names in nested.items()})


# fixed values: reader-facing names of terrain configurations and method variants
TERRAIN_NAMES = {
    "base": "B (history)", "all-terrain": "A (all groups)",
    "loo-road": "A - road", "loo-river": "A - river", "loo-worldcover": "A - cover", "loo-surface": "A - surface",
    "lio-road": "B + road", "lio-river": "B + river", "lio-worldcover": "B + cover", "lio-surface": "B + surface",
}
VARIANT_NAMES = {
    "pointwise": "Heading/redraw", "pointwise_mixture": "Heading/redraw", "single_gaussian": "Single Gaussian", "gmm_kernel": "RDM",
    "explicit_decomp": "Speed/radial", "qmle": "QMLE label", "mixed": "Mixed calibration", "pure_es": "ES calibration",
    "d2_mc": "2D MC score", "d2_closed": "2D closed score", "scratch": "Scratch", "reptile": "Reptile", "drift_only": "Drift-only",
    "two_step": "Two-step", "em": "Euler-M.", "euler": "Euler alias", "mc": "MC", "crn": "CRN",
}


def method_name(arm: ColumnLike, variant: ColumnLike, names: Mapping[str, str] | None = None) -> Column:
    """Display name of an arm: full arms by number, observation intervals by seconds, others by the table; unmapped is null."""
    v = col(variant)
    table = F.create_map(*[F.lit(x) for pair in (names or VARIANT_NAMES).items() for x in pair])
    return (
        F.when(v == "full", F.concat(F.lit("HSM-"), col(arm)))
        .when(v.rlike(r"^dt\d+$"), F.concat(F.lit("Obs "), F.regexp_extract(v, r"^dt(\d+)$", 1), F.lit(" s")))
        .otherwise(F.try_element_at(table, v))
    )
