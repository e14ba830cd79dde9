"""Helpers shared by the corpus operators: scratch tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: blank and \x09 to \x0D.
SPACE = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\f\r"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none (tests, notebooks) a local folder is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    own = getattr(spark.sparkContext, "_spindrift_shared", None)
    if own is None:
        own = "file://" + tempfile.mkdtemp(prefix="spindrift-")
        spark.sparkContext._spindrift_shared = own
        spark.sparkContext.setCheckpointDir(own)
    return own


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/spindrift-{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """While a job of this package runs, Arrow batches hold fewer rows: both the executor and its Python workers
    hold whole batches of texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def trim() -> None:
    """Give a worker's free memory back: several workers share an executor's limit."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with columns that are computed once, at this place. Filters on them stay above: one that Spark
    moved below would repeat the whole expression, and inside a lambda once for each element."""
    made = F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items()))))
    return df.select(*(F.col(c) for c in df.columns if c not in columns), made)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder of this package."""
    if "/spindrift-" in path:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def remove(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table made by :func:`written` that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def octets(text: Column) -> Column:
    """UTF-8 bytes of a string, 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
