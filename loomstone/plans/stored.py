"""Queries that write stored tables, change parts of them and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.operators import accounting as acc
from loomstone.operators import catalog as c
from loomstone.registry import query
from loomstone.sources.scratch import scratch_dir
from loomstone.sources.sqlite import read_sqlite, write_sqlite
from loomstone.sources.stored import StoredTable
from loomstone.sources.tables import spread, table


def _new(rows: DataFrame, label: str, *keys: str) -> StoredTable:
    return StoredTable.create(rows, scratch_dir(rows.sparkSession, label), list(keys), 16)


@query("stored_files", """
WITH a AS (SELECT c_custkey AS k, c_name AS name, c_nationkey AS first_seen FROM customer WHERE c_custkey % 3 <> 0),
o AS (SELECT o_custkey AS k, max(o_orderpriority) AS name FROM orders GROUP BY 1)
SELECT coalesce(a.k, o.k) AS k, CASE WHEN o.k % 2 = 0 THEN o.name || '!' ELSE coalesce(o.name, a.name) END AS name, coalesce(a.first_seen, 99) AS first_seen
FROM a FULL JOIN o USING (k)""")
def stored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of files, twice changed by key; what is stored keeps when it was first seen."""
    stored = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("first_seen"))
    fresh = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderpriority").alias("name"), F.lit(99).alias("first_seen"))
    out = _new(stored, "files", "k")
    merge = lambda old, new: c.upsert(old, new, "k", ("first_seen",))
    out.update(fresh, merge)
    out.update(fresh.where("k % 2 = 0").withColumn("name", F.concat("name", F.lit("!"))).withColumn("first_seen", F.lit(7)), merge)
    return out.read()


@query("stored_endpoints", """
WITH u AS (SELECT l_returnflag AS kind, 'h' || (l_suppkey % 9) AS locator, repeat('x', CAST(l_linenumber AS INT)) AS extra, l_linestatus = 'F' AS parsed FROM lineitem)
SELECT kind, locator, extra, parsed FROM u QUALIFY row_number() OVER (PARTITION BY kind, locator ORDER BY parsed DESC, length(extra) DESC) = 1""")
def stored_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared endpoints, stored from one half of their mentions and changed by the other."""
    kind, locator = F.col("l_returnflag").alias("kind"), F.concat(F.lit("h"), F.col("l_suppkey") % 9).alias("locator")
    rows = table(spark, sf_dir, "lineitem").select(kind, locator, F.expr("repeat('x', cast(l_linenumber as int))").alias("extra"), (F.col("l_linestatus") == "F").alias("parsed"), (F.col("l_orderkey") % 2).alias("half"))
    one, two = (rows.where(F.col("half") == h).drop("half") for h in (0, 1))
    out = _new(c.upsert_endpoints(one, one.limit(0)), "endpoints", "kind", "locator")
    out.update(two, c.upsert_endpoints)
    return out.read()


@query("stored_versions", """
WITH t AS (SELECT conv_id AS file_id, turn, md5(text) AS hash FROM conversations WHERE turn < 3),
v AS (SELECT *, lag(hash) OVER (PARTITION BY file_id ORDER BY turn) AS before FROM t)
SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY turn) AS version_number, hash FROM v WHERE hash IS DISTINCT FROM before""")
def stored_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of conversations, appended turn by turn where the text is another; the last turn comes twice."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file_id"), "turn", F.md5("text").alias("hash"))
    out = _new(turns.where("turn = 0").select("file_id", F.lit(1).cast("long").alias("version_number"), "hash"), "versions", "file_id")
    for turn in (1, 2, 2):
        out.append(turns.where(F.col("turn") == turn).drop("turn"), c.append_versions)
    return out.read()


@query("stored_costs", """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type AS tool, count(*) AS calls, CAST(sum(greatest(event_id % 50 - 20, 0)) AS BIGINT) AS saved, CAST(sum(event_id % 50) AS BIGINT) AS raw, CAST(20 * count(*) AS BIGINT) AS act FROM events GROUP BY 1, 2""")
def stored_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs by day and tool, a third of the calls at a time."""
    rows = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("tool"), (F.col("event_id") % 50).alias("raw"), F.lit(20).alias("act"))
    third = lambda k: acc.daily_costs(rows.where(F.col("event_id") % 3 == k))
    out = _new(third(0), "costs", "day", "tool")
    for k in (1, 2):
        out.update(third(k), acc.add_costs)
    return out.read()


@query("stored_pairs", """
SELECT event_type, user_id, count(*) AS occurrences, min(epoch_us(ts)) AS first_seen, max(epoch_us(ts)) AS last_seen FROM events GROUP BY 1, 2""")
def stored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failing pairs, those of the later half of events added to the stored ones."""
    rows = table(spark, sf_dir, "events").select("event_type", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), (F.col("event_id") % 2).alias("half"))
    pairs = lambda h: acc.failing_pairs(rows.where(F.col("half") == h), "event_type", "user_id")
    out = _new(pairs(0), "pairs", "event_type", "user_id")
    out.update(pairs(1), lambda old, new: acc.add_pairs(old, new, "event_type", "user_id"))
    return out.read()


@query("sqlite_orders", """
SELECT o_orderkey, o_custkey, o_orderpriority, CAST(o_totalprice AS DOUBLE) AS price, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS status FROM orders""")
def sqlite_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as SQLite files by tasks, read again by ranges of row ids, with the columns that the files declare."""
    folder = scratch_dir(spark, "sqlite")
    rows = spread(table(spark, sf_dir, "orders")).select(F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long"), "o_orderpriority", F.col("o_totalprice").cast("double").alias("price"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")).alias("status"))
    files = spark.createDataFrame(write_sqlite(rows, folder, "orders").collect())  # a row for each file
    return read_sqlite(files, "orders").drop("path")
