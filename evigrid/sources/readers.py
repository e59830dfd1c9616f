"""Readers with fixed schemas. Documents are read in parallel by file; rows come from exploding them."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_RECORD = (
    "schema_version string, run_id string, result_id string, arm_id int, subconfig_id string, `group` string, slot string, "
    "lineage struct<idea_ids:array<string>,role:string,confidence:string,sources:array<string>>, "
    "implementation_status string, run_status string, verdict string, "
    "dataset struct<dataset_id:string,fingerprint:string,selected_segment_ids_sha256:map<string,string>>, "
    "config map<string,string>, runtime struct<requested_prediction_samples:int,effective_prediction_samples:int>, "
    "seed bigint, replicate_seed bigint, stages array<struct<name:string,status:string>>, "
    "artifacts map<string,struct<path:string,size_bytes:bigint,sha256:string>>, metrics map<string,double>, "
    "mechanism_gates array<struct<statistic:string,value:double,threshold:double,operator:string,passed:boolean,sample_size:int>>"
)
PREDICTIONS = "predictions array<struct<segment_id:string,target:array<double>,samples:array<array<double>>>>"
CELL = (
    "cell_hash string, arm_id string, block_id string, seed int, status string, attempt_id string, run_id string, "
    "artifact_id string, metrics map<string,double>, metric_units map<string,string>, "
    "comparison_dimensions map<string,string>, history array<struct<attempt_id:string,state:string>>"
)
EXPECTED_CELL = "cell_hash string, arm_id string, block_id string, seed int"

def _struct(ddl: str) -> str:
    """``a int, b string`` -> ``a:int,b:string`` at the top level of a schema text."""
    out, depth, field = [], 0, ""
    for character in ddl + ",":
        depth += {"<": 1, ">": -1}.get(character, 0)
        if character == "," and depth == 0:
            name, kind = field.strip().split(" ", 1)
            out.append(f"{name}:{kind}")
            field = ""
        else:
            field += character
    return f"struct<{','.join(out)}>"


BUNDLE = (
    "study_id string, spec_hash string, protocol_hash string, data_hash string, code_hash string, bundle_hash string, "
    f"expected_cells array<{_struct(EXPECTED_CELL)}>, cells array<{_struct(CELL)}>"
)


def read_records(spark: SparkSession, path: str, multi_line: bool = True, schema: str = RUN_RECORD) -> DataFrame:
    """One record per file, a list of records, or ``{"records": [...]}``: all give one row per record."""
    wrapped = f"{schema}, records array<{_struct(schema)}>"
    raw = spark.read.schema(wrapped).option("multiLine", multi_line).option("recursiveFileLookup", True).json(path)
    own = F.array(F.struct(*[F.col(f"`{c}`") for c in raw.columns if c != "records"]))
    # files are parsed once, whichever form they have
    return raw.select(F.inline(F.coalesce("records", own)))


def explode_predictions(df: DataFrame, keys: Sequence[str], predictions: str = "predictions") -> DataFrame:
    """Prediction documents as sample rows which keep the sample order."""
    segments = df.select(*keys, F.explode(predictions).alias("p"))
    return segments.select(
        *keys, F.col("p.segment_id").alias("segment_id"), F.col("p.target")[0].alias("tx"), F.col("p.target")[1].alias("ty"),
        F.posexplode("p.samples").alias("sample_idx", "__s"),
    ).select(*keys, "segment_id", "tx", "ty", "sample_idx", F.col("__s")[0].alias("x"), F.col("__s")[1].alias("y"))


def read_bundle(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Header, expected cells and cells of evidence bundles, one per file or (``multi_line`` false) one per line."""
    raw = spark.read.schema(BUNDLE).option("multiLine", multi_line).json(path)
    header = raw.drop("expected_cells", "cells")
    return header, raw.select("study_id", F.inline("expected_cells")), raw.select("study_id", F.inline("cells"))


def read_pinned(spark: SparkSession, path: str, size_limit: int, sha256: str | None = None) -> DataFrame:
    """Every file with its size, its state (``ok``, ``changed`` or ``oversized``), its hash and its parsed document.

    ``document`` is null where the text repeats a key or holds NaN. Oversized files are listed, but never loaded: the
    filter on length is pushed into the scan, and their row reads no content.
    """
    files = spark.read.format("binaryFile").load(path)
    digest = F.sha2("content", 256)
    pinned = digest == (F.lit(sha256) if sha256 else digest)
    within = files.where(F.col("length") <= size_limit).select(
        "path", "length", digest.alias("sha256"), pinned.alias("pinned"), F.when(pinned, "ok").otherwise("changed").alias("state"),
        F.try_parse_json(F.decode("content", "UTF-8")).alias("document"),
    )
    over = files.where(F.col("length") > size_limit).select(
        "path", "length", F.lit(None).cast("string").alias("sha256"), F.lit(False).alias("pinned"), F.lit("oversized").alias("state"),
        F.lit(None).cast("variant").alias("document"),
    )
    return within.unionByName(over)


def read_sharded(
    spark: SparkSession, root: str, index: DataFrame, schema: str, size_limit: int = 128 * 1024 * 1024
) -> tuple[DataFrame, DataFrame]:
    """Rows of the shards an index names, and the index entries which are refused.

    ``index`` has ``path, sha256``. Refused are paths which leave the root or are not plain (a drive, a backslash, an empty
    part), repeat, are absent, oversized or changed.
    """
    relative = F.regexp_replace("path", "^\\./", "")
    copies = index.groupBy(relative.alias("path")).agg(F.max("sha256").alias("sha256"), F.count(F.lit(1)).alias("copies"))
    checked = copies.withColumn("escapes", F.col("path").startswith("/") | F.col("path").rlike(r"(^|/)\.\.(/|$)|[:\\]|//|^$"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    # listings may spell the scheme of the root differently
    base = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "", root).strip("/") + "/"
    name = F.substring_index("path", base, -1).alias("path")
    listed = files.select(name, (F.col("length") > size_limit).alias("oversized"))
    found = files.where(F.col("length") <= size_limit).select(
        name, F.sha2("content", 256).alias("found"), F.decode("content", "UTF-8").alias("text")
    )
    joined = checked.join(listed, "path", "left").join(found, "path", "left")
    state = (
        F.when(F.col("escapes"), "escapes_root").when(F.col("copies") > 1, "duplicate").when(F.col("oversized").isNull(), "absent")
        .when(F.col("oversized"), "oversized").when(F.col("found") != F.col("sha256"), "changed").otherwise("ok")
    )
    tagged = joined.withColumn("state", state)
    rows = tagged.where(F.col("state") == "ok").select("path", F.explode(F.from_json("text", f"array<{_struct(schema)}>")).alias("r"))
    return rows.select("path", "r.*"), tagged.where(F.col("state") != "ok").select("path", "state")


def read_work_items(spark: SparkSession, path: str) -> DataFrame:
    """Cached work items: ``work_id``, ``digest`` of every item document below ``path``."""
    return spark.read.schema("work_id bigint, digest string").option("recursiveFileLookup", True).json(path)


def unique_versions(items: DataFrame, bindings: DataFrame, work_id: str, digest: str) -> DataFrame:
    """Cached work items which match a binding exactly once; others are tagged."""
    matched = bindings.join(items.select(work_id, digest, F.lit(True).alias("__hit")), [work_id, digest], "left")
    counted = matched.groupBy(work_id, digest).agg(F.count("__hit").alias("versions"))
    return counted.withColumn(
        "state", F.when(F.col("versions") == 1, "unique").when(F.col("versions") == 0, "absent").otherwise("ambiguous")
    )


def read_compressed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Gzip JSON lines through the built-in codec."""
    return spark.read.schema(schema).option("pathGlobFilter", "*.json.gz").json(path)


def transport_contract(spark: SparkSession, path: str, rows: int, decoded_limit: int) -> DataFrame:
    """One row: rows and decoded bytes of a compressed transport, and whether both keep their contract. The text is not parsed."""
    lines = spark.read.option("pathGlobFilter", "*.json.gz").text(path)
    found = lines.agg(
        F.count(F.lit(1)).alias("found"), F.coalesce(F.sum(F.octet_length("value") + 1), F.lit(0)).alias("decoded_bytes")
    )
    return found.select("*", ((F.col("found") == rows) & (F.col("decoded_bytes") <= decoded_limit)).alias("kept"))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with header and fixed types; empty text is null."""
    return spark.read.schema(schema).option("header", True).option("nullValue", "").option("mode", "FAILFAST").csv(path)


def row_contract(df: DataFrame, expected: int) -> DataFrame:
    """One row: the promised and the found number of rows."""
    return df.agg(F.count(F.lit(1)).alias("found")).select(
        F.lit(expected).cast("bigint").alias("expected"), "found", (F.col("found") == expected).alias("kept")
    )


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Batch manifests: ``batch_id`` and the list of replicates each names."""
    return spark.read.schema("batch_id string, replicates array<struct<seed:bigint>>").json(path)


def read_policy(spark: SparkSession, path: str) -> DataFrame:
    """A scope policy document."""
    return spark.read.schema("approved_excluded_arms array<string>").option("multiLine", True).json(path)


def replicate_inputs(manifest: DataFrame, summaries: DataFrame) -> DataFrame:
    """Replicates a batch manifest names, joined to their summaries by seed; absent summaries stay visible."""
    listed = manifest.select("batch_id", F.inline("replicates"))
    return listed.join(summaries, "seed", "left").withColumn("present", F.col("status").isNotNull())


def read_family(spark: SparkSession, folder: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """Documents of one family by kind, each row with the file it came from."""
    return {
        kind: spark.read.schema(ddl).json(f"{folder.rstrip('/')}/{kind}").withColumn(
            "source", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1)
        )
        for kind, ddl in schemas.items()
    }


def read_test_report(spark: SparkSession, path: str) -> DataFrame:
    """Test cases of an XML report with their state."""
    schema = (
        "_classname string, _name string, failure struct<_VALUE:string,_message:string>, error struct<_VALUE:string,_message:string>, "
        "skipped struct<_VALUE:string,_message:string>"
    )
    cases = spark.read.format("xml").option("rowTag", "testcase").schema(schema).load(path)
    state = (
        F.when(F.col("failure").isNotNull(), "failure").when(F.col("error").isNotNull(), "error")
        .when(F.col("skipped").isNotNull(), "skipped").otherwise("passed")
    )
    return cases.select(F.concat_ws("::", "_classname", "_name").alias("name"), state.alias("state"))


def expected_grid(policy: DataFrame, grid: DataFrame, key: str = "arm_id") -> DataFrame:
    """The registered grid without the arms a scope policy excludes."""
    excluded = policy.select(F.explode("approved_excluded_arms").alias(key)).distinct()
    return grid.join(excluded, key, "left_anti")


def artifact_states(artifacts: DataFrame, files: DataFrame) -> DataFrame:
    """Registered artifacts against the files found: missing, wrong size, wrong hash, outside the root."""
    joined = artifacts.join(files.select("name", F.col("bytes").alias("found_bytes"), F.col("sha256").alias("found_sha256")), "name", "left")
    state = (
        F.when(F.col("name").startswith("/") | F.col("name").rlike(r"(^|/)\.\.(/|$)"), "outside")
        .when(F.col("found_sha256").isNull(), "missing").when(F.col("found_bytes") != F.col("bytes"), "size")
        .when(F.col("found_sha256") != F.col("sha256"), "hash").otherwise("ok")
    )
    return joined.select("name", state.alias("state"))
