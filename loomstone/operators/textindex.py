"""Trigram index for searches of any text inside texts, whatever the case: only matching parts are read.

Rows of any keys and a text are units. Written below one folder, by Spark, so that later sessions can open them:

* ``units``: the rows with a number each, in the partition folder ``shelf`` of the task that wrote them; no shuffle.
* ``postings``: (gram, unit) for every run of three UTF-8 bytes of a unit's lower-cased text, line ends left out, in the partition
  folder of gram mod ``buckets``, in order of gram inside files. A gram that all units have is many rows, not one list.
* ``grams``: how many units have each gram (16.7 million rows at most).

A search reads the counts of its text's grams, takes the RAREST of them, intersects their postings (their buckets' folders and the row groups of their grams
alone), reads the shelves that have candidates and looks into the candidates' texts. Results are those of a scan. A
text of fewer than three bytes has no gram: all units are looked into.

Null texts are no units; an empty text is one that only an empty search finds; equal rows are units of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.functions.text import let
from loomstone.sources.scratch import scratch_dir

BUCKETS = 64
#: Grams of a search that are intersected at most; the candidates' texts are looked into in any case.
RAREST = 4
NEWLINE = 10


def text_grams(text: bytes) -> list[int]:
    """The distinct runs of three bytes of a lower-cased text, as numbers, without those that hold a line end."""
    return sorted({int.from_bytes(text[i : i + 3], "big") for i in range(len(text) - 2) if NEWLINE not in text[i : i + 3]})


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, unit) of batches (unit, text): every gram of a text once."""
    for batch in batches:
        column = batch.column("text")
        if not batch.num_rows:
            continue
        wide = pa.types.is_large_string(column.type)
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + batch.num_rows + 1].astype(np.int64)
        data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]].astype(np.int64)
        if len(data) < 3:
            continue
        ends = offsets[1:] - offsets[0]
        row = np.searchsorted(ends, np.arange(len(data) - 2), side="right")
        line_end = data == NEWLINE
        good = (np.arange(2, len(data)) < ends[row]) & ~(line_end[:-2] | line_end[1:-1] | line_end[2:])
        keys = np.unique((row[good] << 24) | (data[:-2][good] << 16) | (data[1:-1][good] << 8) | data[2:][good])
        units = batch.column("unit").to_numpy()[keys >> 24]
        yield pa.record_batch([pa.array((keys & 0xFFFFFF).astype(np.int32)), pa.array(units)], names=["gram", "unit"])


class TextIndex:
    """A written index; open one by its folder, or ``build`` it."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets
        columns = spark.read.parquet(f"{path}/columns").schema  # an empty table has no files to tell them
        self.units = spark.read.schema(columns).parquet(f"{path}/units")
        self.postings = spark.read.schema("gram int, unit long, bucket int").parquet(f"{path}/postings")
        self.grams = spark.read.schema("gram int, units long").parquet(f"{path}/grams")

    @classmethod
    def build(cls, rows: DataFrame, text: Column, path: str | None = None, buckets: int = BUCKETS) -> TextIndex:
        """Index ``rows`` by ``text``; they may not have columns unit, shelf or searched."""
        spark = rows.sparkSession
        path = path or scratch_dir(spark, "index")
        # The upper bits of a row's number tell the task that wrote it.
        units = rows.select("*", text.alias("searched")).where("searched IS NOT NULL").withColumn("unit", F.monotonically_increasing_id())
        units = units.withColumn("shelf", (F.shiftright("unit", 33) % buckets).cast("int"))
        units.write.partitionBy("shelf").parquet(f"{path}/units")
        units.where(F.lit(False)).write.parquet(f"{path}/columns")
        searched = spark.read.schema(units.schema).parquet(f"{path}/units").select("unit", F.lower("searched").alias("text"))
        postings = searched.mapInArrow(_postings, "gram int, unit long").withColumn("bucket", F.col("gram") % buckets)
        postings = postings.repartitionByRange("bucket", "gram", "unit").sortWithinPartitions("bucket", "gram", "unit")
        postings.write.partitionBy("bucket").parquet(f"{path}/postings")
        written = spark.read.schema("gram int, unit long, bucket int").parquet(f"{path}/postings")
        written.groupBy("gram").agg(F.count("*").alias("units")).repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{path}/grams")
        return cls(spark, path, buckets)

    def lowered(self, text: str) -> str:
        """``text`` in the lower case of Spark's own rules, as the index has it."""
        return self.spark.range(1).select(F.lower(F.lit(text))).first()[0]

    def candidates(self, text: str) -> DataFrame | None:
        """Numbers of the units that have the text's rarest grams; None where it has no gram."""
        grams = text_grams(self.lowered(text).encode())
        if not grams:
            return None
        # As many rows as the text has grams.
        counts = {r.gram: r.units for r in self.grams.where(F.col("gram").isin(grams)).collect()}
        if len(counts) < len(grams):
            return self.postings.where(F.lit(False)).select("unit")
        rarest = sorted(grams, key=lambda g: (counts[g], g))[:RAREST]
        met = self.postings.where(F.col("bucket").isin(sorted({g % self.buckets for g in rarest})) & F.col("gram").isin(rarest))
        if len(rarest) == 1:
            return met.select("unit")
        return met.groupBy("unit").agg(F.count("*").alias("n")).where(F.col("n") == len(rarest)).select("unit")

    def search(self, text: str) -> DataFrame:
        """The rows whose text contains ``text``, whatever the case."""
        units, found = self.units, self.candidates(text)
        if found is not None:
            shelves = [r[0] for r in found.select((F.shiftright("unit", 33) % self.buckets).cast("int")).distinct().collect()]  # ``buckets`` at most
            units = units.where(F.col("shelf").isin(shelves)).join(found, "unit", "left_semi")
        return units.where(F.lower("searched").contains(self.lowered(text))).drop("unit", "shelf", "searched")


def line_blocks(docs: DataFrame, lines: int = 64) -> DataFrame:
    """``docs`` (doc_id, text) in blocks of whole lines: doc_id, first_line (from 1), block."""

    def blocks(every):
        starts = F.sequence(F.lit(1), F.greatest(F.size(every), F.lit(1)), F.lit(lines))
        return F.transform(starts, lambda at: F.struct(at.cast("long").alias("first_line"), F.array_join(F.slice(every, at, lines), "\n").alias("block")))

    return docs.where("text IS NOT NULL").select("doc_id", F.inline(let(F.split("text", "\n", -1), blocks)))


class LineIndex:
    """Lines of documents, found by what they contain."""

    def __init__(self, index: TextIndex):
        self.index = index

    @classmethod
    def build(cls, docs: DataFrame, path: str | None = None, lines: int = 64, buckets: int = BUCKETS) -> LineIndex:
        """Index docs (doc_id, text) by blocks of ``lines`` lines."""
        return cls(TextIndex.build(line_blocks(docs, lines), F.col("block"), path, buckets))

    def matching_lines(self, text: str) -> DataFrame:
        """(doc_id, line) of lines that contain ``text``, as ``segments.matching_lines`` has them."""
        lines = self.index.search(text).select("doc_id", "first_line", F.posexplode(F.split("block", "\n", -1)).alias("n", "content"))
        return lines.where(F.lower("content").contains(self.index.lowered(text))).select("doc_id", (F.col("first_line") + F.col("n")).alias("line"))
