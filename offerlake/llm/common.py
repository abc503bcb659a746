"""Helpers that several operators share: scratch tables and byte-level words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Files that a task may hold open at once; with one bucket a task, rows need not be sorted by it.
_OPEN = "spark.sql.maxConcurrentOutputFileWriters"


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Only on a single machine (a local master) a folder of our own is made where the setting is absent.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-scratch-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


@contextmanager
def _set(spark: SparkSession, **values: str) -> Iterator[None]:
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back, which cuts its lineage.

    Nothing reads the shuffle files of the write afterwards, so Spark may delete them when it ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _set(spark, **{_CLEAN: "true"}):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """As stored(), in buckets by the keys: joins on all of them move the other side only."""
    spark, table = df.sparkSession, f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    writer = df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).option("path", f"{scratch_dir(spark)}/{table}")
    with _set(spark, **{_CLEAN: "true", _OPEN: "8"}):
        writer.saveAsTable(table)
    return spark.table(table)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table that stored() or bucketed() wrote and nobody reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        table = folder.rsplit("/", 1)[-1]
        if "-" not in table:
            spark.sql(f"DROP TABLE IF EXISTS {table}")


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    values = batch.column(column)
    if pa.types.is_binary(values.type):
        return values.to_pylist()
    return values.cast(pa.large_binary() if pa.types.is_large_string(values.type) else pa.binary()).to_pylist()
