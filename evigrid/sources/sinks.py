"""Writers: ordered CSV, nested CSV, write-once packages, manifests, claim index, summaries."""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException, StreamingQueryException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evigrid.functions.fingerprint import element_digest, sequence_fingerprint
from evigrid.operators.rollup import SUCCEEDED, arm_means


def write_ordered_csv(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Globally ordered CSV: a range exchange, then sorted part files whose names follow the order."""
    df.orderBy(*keys).write.option("header", True).mode("errorifexists").csv(path)


def flat_for_csv(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, nulls left empty."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(
        *[
            F.when(F.col(f.name).isNotNull(), F.to_json(f.name, {"ignoreNullFields": "false"})).alias(f.name)
            if isinstance(f.dataType, nested) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def write_nested_csv(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    flat_for_csv(df).orderBy(*keys).write.option("header", True).option("emptyValue", "").option("nullValue", "").option(
        "quoteAll", True
    ).option("escape", '"').mode("errorifexists").csv(path)


#: what publication writes: where the rows lie, what they are, and how many
RECORD = "folder string, fingerprint string, columns string, rows bigint, writer string"


def package_record(spark: SparkSession, path: str) -> Row | None:
    """The published record of the package at ``path``; None before publication, whatever is staged there."""
    try:
        return spark.read.schema(RECORD).parquet(f"{path.rstrip('/')}/record").first()
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _content(df: DataFrame) -> tuple[str, str, int]:
    """Fingerprint of the rows as a multiset, names and types in the order of names, and the number of rows."""
    fields = sorted(df.schema.fields, key=lambda f: f.name)
    columns = ",".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    row = F.to_json(F.struct(*[F.col(f"`{f.name}`") for f in fields]), {"ignoreNullFields": "false"})
    found = df.select(element_digest(F.lit(0), row).alias("digest")).agg(
        F.sha2(F.coalesce(sequence_fingerprint("digest"), F.lit("0")), 256).alias("fingerprint"), F.count(F.lit(1)).alias("rows")
    ).first()
    return found.fingerprint, columns, found.rows


def stage_package(df: DataFrame, path: str) -> Row:
    """Write the rows under a name of their own, and a claim that carries their fingerprint. Nobody sees them before ``publish_package``."""
    spark, writer = df.sparkSession, uuid.uuid4().hex
    root = path.rstrip("/")
    folder = f"rows/{writer}"
    df.write.mode("errorifexists").parquet(f"{root}/{folder}")
    # the fingerprint is that of the stored rows: an input that is not repeatable cannot differ from it
    fingerprint, columns, rows = _content(spark.read.schema(df.schema).parquet(f"{root}/{folder}"))
    claim = spark.createDataFrame([(folder, fingerprint, columns, rows, writer)], RECORD)
    claim.coalesce(1).write.parquet(f"{root}/claims/{writer}")
    return claim.first()


def publish_package(spark: SparkSession, path: str, claim: Row) -> bool:
    """Publish a staged package. One writer wins; the others are accepted if their content equals the winner's, else refused.

    The record goes through the streaming file sink, whose manifest of batch 0 is created in one atomic step and never replaced.
    A writer that comes second finds the manifest, or loses the race for it, and compares its content with the record. A
    writer lost before that step leaves staged rows that no reader sees. Returns whether this writer's rows are the package.
    """
    root = path.rstrip("/")
    lost = None
    stream = spark.readStream.schema(RECORD).parquet(f"{root}/claims/{claim.writer}").writeStream.format("parquet")
    try:
        stream.option("checkpointLocation", f"{root}/commits/{claim.writer}").trigger(availableNow=True).start(
            f"{root}/record"
        ).awaitTermination()
    except StreamingQueryException as race:
        lost = race
    record = package_record(spark, path)
    if record is None:
        raise lost or RuntimeError(f"package {path} was not published")
    if record.writer == claim.writer:
        return True
    _same_content(path, record, claim.fingerprint, claim.columns)
    return False


def _same_content(path: str, record: Row, fingerprint: str, columns: str) -> None:
    if (record.fingerprint, record.columns) != (fingerprint, columns):
        raise ValueError(f"package {path} holds different rows; choose a new output version")


def write_package(df: DataFrame, path: str) -> bool:
    """Write once. The same rows again, in any order, are accepted without writing; different rows are refused.

    Two writers at once are told apart by ``publish_package``. Names and types of columns are content, their order is not. Map
    columns count by the order of their entries. Returns whether this call's rows are the package.
    """
    record = package_record(df.sparkSession, path)
    if record is None:
        return publish_package(df.sparkSession, path, stage_package(df, path))
    fingerprint, columns, _ = _content(df)
    _same_content(path, record, fingerprint, columns)
    return False


def read_package(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a published package."""
    record = package_record(spark, path)
    if record is None:
        raise ValueError(f"no package is published at {path}")
    return spark.read.parquet(f"{path.rstrip('/')}/{record.folder}")


def file_manifest(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Name relative to ``root``, size and content hash of every written file, read back in parallel."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    )
    # listings may spell the scheme of the root differently
    base = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "", root).strip("/") + "/"
    return files.select(
        F.substring_index("path", base, -1).alias("name"), F.col("length").alias("bytes"),
        F.sha2("content", 256).alias("sha256"),
    )


def rows_per_file(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """A file manifest of line-based files with the number of rows of each; a file without rows has zero."""
    base = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "", root).strip("/") + "/"
    lines = spark.read.option("recursiveFileLookup", True).text(root)
    counted = lines.groupBy(F.substring_index(F.col("_metadata.file_path"), base, -1).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return files.join(counted, "name", "left").select(*files.columns, F.coalesce("n", F.lit(0)).alias("rows"))


def table_manifest(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count per output table."""
    out = None
    for name, df in tables.items():
        part = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = part if out is None else out.unionByName(part)
    return out


def claim_index(cells: DataFrame, blocks: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Claims ``(arm, stratum, metric)`` with one row per contributing attempt."""
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])
    arms = arm_means(blocks, metrics).select(
        "arm_id", "horizon", F.col("status").alias("evidence_status"), "independent_n", F.inline(rows)
    )
    claims = arms.withColumn("claim_id", F.sha2(F.concat_ws("|", "arm_id", "horizon", "metric"), 256))
    good_blocks = blocks.where("complete").select("arm_id", "horizon", "block_id")
    attempts = cells.where(F.col("status") == SUCCEEDED).join(good_blocks, ["arm_id", "horizon", "block_id"], "left_semi")
    return attempts.select("arm_id", "horizon", "attempt_id").join(claims, ["arm_id", "horizon"])


def summary_document(counts: DataFrame, key: str, n: str, **identities: Column | str) -> DataFrame:
    """One row: a map of counts over an enumeration, and the identities it belongs to."""
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key).cast("string"), F.col(n)))))
    fixed = [(F.lit(v) if isinstance(v, str) else v).alias(k) for k, v in identities.items()]
    return counts.agg(entries.alias("counts"), F.sum(n).alias("total")).select(*fixed, "counts", "total")
