"""Session defaults, the shared scratch folder, and materialised intermediates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A session for tests and local runs; on a cluster the submitter's settings win."""
    builder = (
        SparkSession.builder.master(master)
        .appName("evigrid")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        # call-site capture costs a JVM round trip per column expression
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a temporary one only in local mode, as in tests.

    On a cluster every executor would write a temporary folder to its own disk, so a missing setting is an error there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share (master {master})")
    key = spark.sparkContext.applicationId
    if key not in _LOCAL:
        _LOCAL[key] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _LOCAL[key]


def job_folder(spark: SparkSession) -> str:
    """The folder of this application's intermediates: one per job, so whoever owns the shared folder sees whose they are."""
    return f"{shared_folder(spark).rstrip('/')}/evigrid-{spark.conf.get('spark.app.id')}"


def release(spark: SparkSession) -> None:
    """Delete the intermediates of this application, for the end of a job.

    Results that were not written or collected yet read them, so nothing of this application may be used after this call but
    what it stored itself. Other applications' intermediates stay. The folder is overwritten with an empty table,
    which every file system that Spark writes to can do.
    """
    spark.range(0).coalesce(1).write.mode("overwrite").parquet(job_folder(spark))


def materialise(df: DataFrame) -> DataFrame:
    """Write an intermediate which several branches read into the shared folder and read it back.

    Without this every branch would scan and shuffle the base table again, because column pruning makes the branches
    differ and their exchanges are then not reused. A lost executor costs nothing: the files are on shared storage.
    """
    path = f"{job_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
