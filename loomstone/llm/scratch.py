"""What the operators share: written tables, joins of frequent keys, free column names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.sources import scratch
from loomstone.sources.scratch import discard, discard_since, file_system, scratch_dir, sweep, written

__all__ = ["cut", "discard", "discard_since", "fresh", "join_hot", "numbered", "renamed", "scratch_dir", "small_batches", "sweep", "written"]


#: Tables of more than MANY_FILES files with less than SMALL_FILE bytes each are written again in files of WHOLE_FILE bytes.
MANY_FILES, SMALL_FILE, WHOLE_FILE = 8, 64 << 10, 1 << 20


def cut(df: DataFrame, label: str) -> DataFrame:
    """``df`` written and read back; where its partitions gave many small files, in few.

    A small table of many partitions would take more disk and tasks for its files than for its rows, in each later step.
    """
    table = scratch.cut(df, label)
    files, path = file_system(df.sparkSession, table._scratch_path)
    summary = files.getContentSummary(path)
    n, size = summary.getFileCount(), summary.getLength()
    if n <= MANY_FILES or size >= n * SMALL_FILE:
        return table
    whole = scratch.cut(table.coalesce(max(1, size // WHOLE_FILE)), label)
    discard(table)
    return whole


#: Keys with more than one in so many of all rows are joined by broadcast: there are fewer than so many.
HOT_KEYS = 500


def join_hot(rows: DataFrame, keyed: DataFrame, key: str, times: str) -> DataFrame:
    """``rows`` joined to ``keyed``, a written table with one row for each key (column ``times``: how many rows have it).

    Keys with more than one in HOT_KEYS of all rows, of which there are fewer than HOT_KEYS, are broadcast, so that no
    task gets all rows of a frequent key; the others are shuffled.
    """
    most = keyed.agg(F.sum(times), F.max(times)).first()
    total = most[0] or 0
    if (most[1] or 0) * HOT_KEYS <= total:
        return rows.join(keyed.drop(times), key)
    hot = keyed.where(F.col(times) * HOT_KEYS > total).drop(times)
    rare = keyed.where(F.col(times) * HOT_KEYS <= total).drop(times)
    frequent = rows.join(F.broadcast(hot), key)
    return frequent.unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rare, key))


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, with underscores in front until no column of ``frames`` is called so (case-blind)."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def numbered(docs: DataFrame, *plain: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with all columns but ``plain`` called column0, column1, ..., and the names by column.

    Operators may then add columns of any other name; ``renamed`` gives the columns back.
    """
    names = {c: c if c in plain else f"column{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), names


def renamed(rows: DataFrame, names: dict[str, str], columns: list[str]) -> DataFrame:
    """The ``columns`` of the table that was ``numbered``, by their names."""
    return rows.select(*(F.col(names[c]).alias(c) for c in columns))


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """Keep Arrow batches small: rows hold whole texts, and JVM and Python both hold whole batches.

    Descriptions of plans are kept short, too: the driver remembers those of the last thousand jobs.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    spark.conf.set("spark.sql.maxPlanStringLength", "4000")
