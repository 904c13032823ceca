"""Written tables that cut lineage, in the shared folder that the session names in spark.checkpoint.dir."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no checkpoint folder and runs on one machine (tests).
LOCAL_SCRATCH = "file:///tmp/checkpoints/loomstone"


def file_system(spark: SparkSession, path: str) -> tuple:
    """The Hadoop file system of a path, and the path."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new, unique folder path that the driver and all executors share; it goes when the driver's JVM ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = LOCAL_SCRATCH
    root = f"{base.rstrip('/')}/loomstone-{spark.sparkContext.applicationId}"
    files, path = file_system(spark, root)
    files.deleteOnExit(path)
    return f"{root}/{label}-{uuid.uuid4().hex}"


#: Paths of the tables that ``cut`` wrote, in order.
_WRITTEN: list[str] = []


def sweep(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished jobs, which it does once their plans are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later stages and loops survive lost executors."""
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    df.write.options(**options).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch_path = path
    _WRITTEN.append(path)
    return table


def written() -> int:
    """How many tables ``cut`` wrote so far: a mark for ``discard_since``."""
    return len(_WRITTEN)


def discard_since(spark: SparkSession, mark: int, *kept: DataFrame) -> None:
    """Delete all tables that ``cut`` wrote since a mark, except ``kept``, which must not read any of the others."""
    paths = {t._scratch_path for t in kept}
    for path in [p for p in _WRITTEN[mark:] if p not in paths]:
        files, where = file_system(spark, path)
        files.delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``cut`` that no plan will read again."""
    for table in tables:
        files, path = file_system(table.sparkSession, table._scratch_path)
        files.delete(path, True)
