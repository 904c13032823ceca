"""The driver tables in the roles that the operators work on (projects, files, imports, endpoints, logs).

The same roles are spelled out as DuckDB common table expressions, so that oracles start from the same
rows but compute their answers on their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.sources.tables import table

# part -> file of one import graph. Edge 1 of file p: to p + 1, from every 64th file (and the last) to (7 p + 3) mod n + 1; external
# where p % 11 = 0, unresolved where p % 13 = 0. Edge 2, of every third file: to p div 2. Edge 3, of every ninth: to one of four hubs.
GRAPH_SQL = """
n AS (SELECT max(p_partkey) AS n FROM part),
files AS (SELECT p_partkey AS file_id, p_size % 5 AS project_id, 'a.' || p_partkey AS address, p_name AS name, p_size % 7 <> 0 AS is_readable_text FROM part),
imports AS (
  SELECT p_partkey * 3 AS import_id, p_partkey AS file_id, 'mod_' || p_partkey AS import_path,
         CASE WHEN p_partkey % 11 = 0 OR p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 64 = 0 OR p_partkey = n.n THEN (p_partkey * 7 + 3) % n.n + 1 ELSE p_partkey + 1 END AS resolved_file_id,
         p_partkey % 11 = 0 AS is_external, 3 AS line
  FROM part, n
  UNION ALL
  SELECT p_partkey * 3 + 1, p_partkey, './half', p_partkey // 2, false, 1 FROM part WHERE p_partkey % 3 = 1 AND p_partkey > 1
  UNION ALL
  SELECT p_partkey * 3 + 2, p_partkey, './hub', p_partkey // 9 % 4 + 1, false, 2 FROM part WHERE p_partkey % 9 = 0
),
refs AS (SELECT s_suppkey AS ref_id, CASE WHEN s_nationkey % 2 = 0 THEN 'server' ELSE 'service' END AS kind, s_name AS name, 'h' || (s_suppkey // 2) AS locator FROM supplier),
file_refs AS (SELECT DISTINCT l_partkey AS file_id, l_suppkey AS ref_id, l_linenumber AS line FROM lineitem),
databases AS (SELECT n_nationkey AS database_id, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE '99.' || n_nationkey END AS address, n_name AS name FROM nation),
connections AS (SELECT p_partkey AS file_id, CAST(p_size % 25 AS BIGINT) AS database_id, p_size AS line FROM part),
queries AS (
  SELECT l_partkey AS file_id, CAST(l_linenumber * 4 % 25 AS BIGINT) AS database_id,
         CASE l_linenumber % 4 WHEN 0 THEN '-- note' || chr(10) || 'select 1' WHEN 1 THEN '/* x */ INSERT INTO t' WHEN 2 THEN 'FROM_VAR' ELSE '  with a as (select 1) select 2' END AS sql,
         l_returnflag = 'R' AS is_dynamic
  FROM lineitem
)
"""


def graph(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """files, imports, refs, file_refs, databases, connections and queries of the synthetic import graph."""
    read = lambda name: table(spark, sf_dir, name)
    part = read("part")
    n = part.agg(F.max("p_partkey")).first()[0] or 1
    p = F.col("p_partkey")
    target = F.when((p % 64 == 0) | (p == n), (p * 7 + 3) % n + 1).otherwise(p + 1)
    first = part.select(
        (p * 3).alias("import_id"), p.alias("file_id"), F.concat(F.lit("mod_"), p).alias("import_path"),
        F.when((p % 11 != 0) & (p % 13 != 0), target).alias("resolved_file_id"), (p % 11 == 0).alias("is_external"), F.lit(3).alias("line"),
    )
    other = lambda k, name, to, line: (p * 3 + k, p, F.lit(name), F.floor(to).cast("long"), F.lit(False), F.lit(line))
    half = part.where((p % 3 == 1) & (p > 1)).select(*other(1, "./half", p / 2, 1))
    hub = part.where(p % 9 == 0).select(*other(2, "./hub", F.floor(p / 9) % 4 + 1, 2))
    line, number = read("lineitem"), F.col("l_linenumber")
    sql = F.when(number % 4 == 0, "-- note\nselect 1").when(number % 4 == 1, "/* x */ INSERT INTO t").when(number % 4 == 2, "FROM_VAR").otherwise("  with a as (select 1) select 2")
    return {
        "files": part.select(p.alias("file_id"), (F.col("p_size") % 5).alias("project_id"), F.concat(F.lit("a."), p).alias("address"), F.col("p_name").alias("name"), (F.col("p_size") % 7 != 0).alias("is_readable_text")),
        "imports": first.union(half).union(hub),
        "refs": read("supplier").select(F.col("s_suppkey").alias("ref_id"), F.when(F.col("s_nationkey") % 2 == 0, "server").otherwise("service").alias("kind"), F.col("s_name").alias("name"), F.concat(F.lit("h"), F.floor(F.col("s_suppkey") / 2)).alias("locator")),
        "file_refs": line.select(F.col("l_partkey").alias("file_id"), F.col("l_suppkey").alias("ref_id"), number.alias("line")).distinct(),
        "databases": read("nation").select(F.col("n_nationkey").cast("long").alias("database_id"), F.when(F.col("n_nationkey") % 3 != 0, F.concat(F.lit("99."), "n_nationkey")).alias("address"), F.col("n_name").alias("name")),
        "connections": part.select(p.alias("file_id"), (F.col("p_size") % 25).cast("long").alias("database_id"), F.col("p_size").alias("line")),
        "queries": line.select(F.col("l_partkey").alias("file_id"), (number * 4 % 25).cast("long").alias("database_id"), sql.alias("sql"), (F.col("l_returnflag") == "R").alias("is_dynamic")),
    }
