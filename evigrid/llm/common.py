"""Readers and Arrow helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import shutil
import tempfile
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; the path is left to Spark, so any store which Spark reads will do."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null: empty), under fixed names, so no other column can clash."""
    return docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))


def whole_text(text_col: str = "text") -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


#: rows that a worker handles at a time
SLICE = 512

_SHIPPED: set[str] = set()


def release() -> None:
    """Give freed memory back to the system: workers stay for the next stage, which needs it elsewhere."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_function(function: Callable[[list[bytes]], Sequence], kind: str, slice_rows: int = 64) -> Callable[[Column], Column]:
    """A column function over texts as UTF-8 bytes (null: empty), a few at a time, so a batch is never there as Python texts."""

    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        out: list = []
        wide = pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()
        for at in range(0, len(texts), slice_rows):
            out.extend(function([t or b"" for t in texts.slice(at, slice_rows).cast(wide).to_pylist()]))
        result = pa.array(out, type={"boolean": pa.bool_(), "double": pa.float64(), "bigint": pa.int64()}[kind])
        release()
        return result

    return run


def ship(spark: SparkSession) -> None:
    """Send this package to the executors through Spark, once per application: workers import it wherever they run."""
    application = spark.sparkContext.applicationId
    if application not in _SHIPPED:
        package = Path(__file__).resolve().parents[1]
        folder = tempfile.mkdtemp(prefix="spark-package-")
        shutil.copytree(
            package, Path(folder, "all", package.name), ignore=lambda _, names: [n for n in names if n == "__pycache__"]
        )
        spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", f"{folder}/all"))
        _SHIPPED.add(application)


def arrow_schema(spark: SparkSession, ddl: str) -> tuple[StructType, pa.Schema]:
    """A DDL string as Spark's schema and as Arrow's."""
    schema = spark.createDataFrame([], ddl).schema
    return schema, to_arrow_schema(schema)


def map_batches(
    df: DataFrame, function: Callable[[pa.RecordBatch], dict[str, Sequence]], schema: str
) -> DataFrame:
    """``mapInArrow`` with one dictionary of columns per slice of a batch; ``schema`` is a DDL string.

    A batch of Spark may hold ten thousand documents; slices keep what a worker makes of them small.
    """
    ship(df.sparkSession)
    spark_schema, arrow = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                columns = function(batch.slice(start, SLICE))
                yield pa.RecordBatch.from_arrays([_array(columns[f.name], f.type) for f in arrow], schema=arrow)
                del columns
            release()

    return df.mapInArrow(run, spark_schema)


def _array(values: Sequence, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def binary_column(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as its UTF-8 bytes."""
    column = batch.column(name)
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()
