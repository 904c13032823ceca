"""Tables that stay: Parquet dealt by a hash of their key into buckets, of which a change rewrites only those that it meets.

A bucket is a partition folder, so a change reads and overwrites the folders of its keys alone (Spark's dynamic partition
overwrite). The change is computed from what was read and written aside first; then its version number is claimed by creating a file
that must not be there yet. A second writer that read the same version finds it claimed: it reads again, or is told
(``ChangedMeanwhile``), and nothing of the first one's is lost. The folder must be on a file system that creates files exclusively.

Null keys are keys of their own bucket; a table without rows has no folders; a bucket that a change empties goes.
"""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from loomstone.sources.scratch import cut, discard, file_system

BUCKETS = 64
BUCKET = "_bucket"


class ChangedMeanwhile(RuntimeError):
    """Another writer changed the table after it was read."""


class StoredTable:
    """A table at ``path``; ``keys``: the columns by which its rows are merged."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = BUCKETS, files: int = 1):
        self.spark, self.path, self.keys, self.buckets, self.files = spark, path.rstrip("/"), keys, buckets, files
        self.schema = spark.read.parquet(f"{self.path}/columns").schema

    @classmethod
    def create(cls, rows: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS, files: int = 1) -> StoredTable:
        """A new table with ``rows``; ``files``: how many tasks write a bucket (for buckets of many rows)."""
        rows.limit(0).write.parquet(f"{path.rstrip('/')}/columns")
        out = cls(rows.sparkSession, path, keys, buckets, files)
        out._claim(0)
        out._write(rows, "overwrite")
        return out

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _claim(self, version: int) -> bool:
        files, path = file_system(self.spark, f"{self.path}/versions/{version:012d}")
        return files.createNewFile(path)

    def version(self) -> int:
        """The number of the last change."""
        files, path = file_system(self.spark, f"{self.path}/versions")
        return max(int(status.getPath().getName()) for status in files.listStatus(path))

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The table's rows, or those of some buckets."""
        files, path = file_system(self.spark, f"{self.path}/data")
        if not files.exists(path):
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(StructType([*self.schema, StructField(BUCKET, IntegerType())])).parquet(f"{self.path}/data")
        return (rows if buckets is None else rows.where(F.col(BUCKET).isin(buckets))).drop(BUCKET)

    def _write(self, rows: DataFrame, mode: str) -> None:
        dealt = rows.withColumn(BUCKET, self._bucket()).withColumn("_file", F.pmod(F.xxhash64(*rows.columns), F.lit(self.files)))
        dealt = dealt.repartition(BUCKET, "_file").drop("_file")
        dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(f"{self.path}/data")

    def _met(self, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in rows.select(self._bucket()).distinct().collect())  # as many as there are buckets at most

    def update(self, fresh: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], retries: int = 3) -> list[int]:
        """Replace the buckets that ``fresh`` meets by ``merge`` of their rows and ``fresh``; the buckets rewritten."""
        return self._change(fresh, merge, "overwrite", retries)

    def append(self, fresh: DataFrame, rows: Callable[[DataFrame, DataFrame], DataFrame], retries: int = 3) -> list[int]:
        """Append ``rows`` of the buckets that ``fresh`` meets and ``fresh``; the buckets that were read."""
        return self._change(fresh, rows, "append", retries)

    def _change(self, fresh: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], mode: str, retries: int) -> list[int]:
        fresh = cut(fresh, "stored-fresh")
        met = self._met(fresh)
        for _ in range(retries + 1):
            seen = self.version()
            try:
                after = cut(merge(self.read(met), fresh).select(*self.schema.names), "stored-after")
            except (PySparkException, Py4JError):
                if self.version() == seen:
                    raise
                continue  # another writer took files away that were to be read
            if self._claim(seen + 1):
                kept = self._met(after)
                if kept:
                    self._write(after, mode)
                if mode == "overwrite":
                    for gone in set(met) - set(kept):
                        files, path = file_system(self.spark, f"{self.path}/data/{BUCKET}={gone}")
                        files.delete(path, True)
                discard(fresh, after)
                return met
            discard(after)
        raise ChangedMeanwhile(f"{self.path} was changed after version {seen}")
