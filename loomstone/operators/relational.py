"""Joins that Spark has no operator for, and file formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.sources.scratch import cut, scratch_dir


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], time: str, values: list[str]) -> DataFrame:
    """``left`` with the ``values`` of the key's last row of ``right`` at or before ``time``; null for none.

    One shuffle: both sides in one sequence, and the last value seen so far. Of right rows at one time the greatest values count.
    """
    payload = F.struct(*values)
    names = left.columns
    a = left.select(*keys, time, F.lit(1).alias("_side"), F.struct(*names).alias("_row"), F.lit(None).cast(right.select(payload.alias("x")).schema["x"].dataType).alias("_value"))
    b = right.select(*keys, time, F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), payload.alias("_value"))
    w = Window.partitionBy(*keys).orderBy(time, "_side", F.col("_value").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    seen = a.union(b).withColumn("_last", F.last("_value", ignorenulls=True).over(w)).where("_side = 1")
    return seen.select("_row.*", *(F.col(f"_last.{v}").alias(v) for v in values))


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], t: str, u: str, low: float, high: float) -> DataFrame:
    """Pairs of equal keys with u in [t + low, t + high]: an equi-join on time buckets as wide as the interval."""
    width = max(high - low, 1e-9)
    bucket = lambda c: F.floor(c / width)
    a = left.withColumn("_b", F.explode(F.sequence(bucket(F.col(t) + low), bucket(F.col(t) + high))))
    b = right.withColumn("_b", bucket(F.col(u)))
    return a.join(b, [*keys, "_b"]).where((F.col(u) >= F.col(t) + low) & (F.col(u) <= F.col(t) + high)).drop("_b")


def salted_join(large: DataFrame, small: DataFrame, keys: list[str], salts: int) -> DataFrame:
    """Inner join with each key of the large side dealt over ``salts`` tasks; the small side is repeated for each."""
    dealt = large.withColumn("_salt", F.pmod(F.xxhash64(*large.columns), F.lit(salts)))
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return dealt.join(repeated, [*keys, "_salt"]).drop("_salt")


def round_trip(rows: DataFrame, file_format: str) -> DataFrame:
    """Rows written to the shared folder in a format, and read back with their schema."""
    spark = rows.sparkSession
    path = scratch_dir(spark, file_format)
    rows.write.format(file_format).save(path)
    return spark.read.format(file_format).schema(rows.schema).load(path)


def running(rows: DataFrame, order: list, sums: dict[str, str] | None = None, place: str = "place") -> DataFrame:
    """``rows`` with their ``place`` (from 1) in a global order, and for each of ``sums`` (name -> column) the total of all rows before.

    The rows are dealt by ranges of the order; places and sums inside a range start from the totals of the ranges
    before it, of which there is one row for each range. No task holds more than a range. ``order`` should tell rows apart.
    """
    sums = sums or {}
    taken = {c.lower() for c in rows.columns}
    part = "part"
    while part in taken:
        part = f"_{part}"
    # Written, so that the ranges hold.
    ranged = cut(rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranges")
    names = [place, *sums]
    totals = ranged.groupBy(part).agg(F.count("*").alias(f"{place}{part}"), *(F.sum(c).alias(f"{n}{part}") for n, c in sums.items()))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(part, *(F.coalesce(F.sum(f"{n}{part}").over(earlier), F.lit(0)).alias(f"{n}{part}") for n in names))
    inside = Window.partitionBy(part).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, -1)
    found = ranged.withColumns({place: F.row_number().over(inside), **{n: F.coalesce(F.sum(c).over(upto), F.lit(0)) for n, c in sums.items()}})
    return found.join(F.broadcast(bases), part).select(*rows.columns, *((F.col(n) + F.col(f"{n}{part}")).alias(n) for n in names))
