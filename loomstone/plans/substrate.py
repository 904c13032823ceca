"""Relational building blocks that Spark brings along: joins, grouping sets, set operations, windows, sketches, formats."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstone.functions.text import glob_match, grouped_number, padded
from loomstone.operators.relational import as_of_join, interval_join, round_trip, salted_join
from loomstone.registry import query
from loomstone.sources.tables import table, views


def _sql(name: str, tables: tuple[str, ...], spark_sql: str, duck_sql: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, *tables)
        return spark.sql(spark_sql)

    query(name, duck_sql or spark_sql)(run)


_sql("grouping_cube", ("orders",), "SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus) AS INT) + 2 * CAST(grouping(o_orderpriority) AS INT) AS level, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
_sql("grouping_rollup", ("lineitem",), "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(round(sum(l_quantity), 2) AS DOUBLE) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
_sql("grouping_sets", ("customer",), "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())")
_sql("intersect_all", ("orders", "customer"), "SELECT o_custkey % 50 AS k FROM orders INTERSECT ALL SELECT c_custkey % 70 FROM customer")
_sql("except_all", ("orders", "customer"), "SELECT o_custkey % 50 AS k FROM orders EXCEPT ALL SELECT c_custkey % 70 FROM customer")
_sql("except_distinct", ("customer", "orders"), "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
_sql("full_outer_join", ("customer", "supplier"), "SELECT c_custkey, s_suppkey FROM (SELECT * FROM customer WHERE c_custkey % 2 = 0) c FULL OUTER JOIN supplier s ON c.c_custkey = s.s_suppkey")
_sql("right_join", ("nation", "supplier"), "SELECT s_suppkey, n_name FROM (SELECT * FROM nation WHERE n_nationkey < 9) n RIGHT JOIN supplier s ON s_nationkey = n_nationkey")
_sql("correlated_count", ("customer", "orders"), "SELECT c_custkey, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n_orders FROM customer c")
_sql("window_frames", ("orders",), "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS running, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS next_key, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS priority_rank, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS quarter FROM orders")
_sql("json_values", ("events",), "SELECT event_type, CAST(sum(CAST(get_json_object(props, '$.k') AS INT)) AS BIGINT) AS total FROM events GROUP BY 1", "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS INT)) AS BIGINT) AS total FROM events GROUP BY 1")
_sql("tumbling_counts", ("events",), "SELECT CAST(floor(unix_seconds(CAST(ts AS TIMESTAMP)) / 3600) AS BIGINT) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2", "SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
_sql("decimal_sums", ("lineitem",), "SELECT l_returnflag, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2)))) AS DOUBLE) AS revenue FROM lineitem GROUP BY 1")
_sql("like_escape", ("part",), r"SELECT p_partkey FROM part WHERE p_name LIKE '%e%' ESCAPE '!' AND p_type NOT LIKE 'a!_%' ESCAPE '!'")


_sql("cross_join", ("nation", "region"), "SELECT n_nationkey, r_regionkey FROM nation CROSS JOIN region")
_sql("interval_shift", ("orders",), "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + INTERVAL 3 MONTH AS VARCHAR(10)) AS later FROM orders", "SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) + INTERVAL 3 MONTH, '%Y-%m-%d') AS later FROM orders")
_sql(
    "map_values", ("orders",), "SELECT o_custkey, m['F'] AS f, m['O'] AS o, cardinality(m) AS kinds FROM (SELECT o_custkey, map_from_entries(collect_list(struct(o_orderstatus, n))) AS m FROM (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1)",
    "SELECT o_custkey, max(n) FILTER (o_orderstatus = 'F') AS f, max(n) FILTER (o_orderstatus = 'O') AS o, count(*) AS kinds FROM (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1",
)


@query("glob_names", "SELECT p_partkey FROM part WHERE p_name GLOB '?*[a-m]'")
def glob_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(glob_match(F.col("p_name"), "?*[a-m]")).select("p_partkey")


@query("join_hints", "SELECT n_name, count(*) AS n_lines FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def join_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The join strategy by choice: a small table by broadcast, a middle one by hashing."""
    line, supplier, nation = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation"))
    hashed = line.select("l_suppkey").join(supplier.hint("shuffle_hash"), F.col("l_suppkey") == F.col("s_suppkey"))
    return hashed.join(nation.hint("broadcast"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n_lines"))


@query("grouped_udf", "SELECT c_nationkey, round(quantile_cont(c_acctbal, 0.9) - quantile_cont(c_acctbal, 0.1), 6) AS spread FROM customer GROUP BY 1")
def grouped_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grouped aggregate of one's own (pandas, Arrow batches): the spread of the middle four fifths."""

    @F.pandas_udf("double")
    def spread(values: pd.Series) -> float:
        return float(values.quantile(0.9) - values.quantile(0.1))

    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.round(spread("c_acctbal"), 6).alias("spread"))


@query("approximate_distinct", "SELECT event_type, true AS close FROM events GROUP BY 1")
def approximate_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketched distinct users by type within a tenth of the exact number."""
    near = F.abs(F.approx_count_distinct("user_id", 0.02) - F.count_distinct("user_id")) <= 0.1 * F.count_distinct("user_id")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(near.alias("close"))


@query("approximate_percentile", "SELECT l_returnflag, true AS close FROM lineitem GROUP BY 1")
def approximate_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = F.abs(F.percentile_approx("l_quantity", 0.5, 1000) - F.median("l_quantity")) <= 1
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(near.alias("close"))


@query("as_of_join", """
SELECT a.event_id, b.event_id AS last_view FROM (SELECT * FROM events WHERE event_type = 'purchase') a
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') b ON a.user_id = b.user_id AND a.ts >= b.ts""")
def as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    left = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    right = e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("last_view"))
    return as_of_join(left, right, ["user_id"], "ts", ["last_view"]).select("event_id", "last_view")


@query("interval_join", """
SELECT a.event_id AS purchase, b.event_id AS view FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'purchase' AND b.event_type = 'view'
AND epoch(b.ts) BETWEEN epoch(a.ts) - 3600 AND epoch(a.ts)""")
def interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("t")
    e = table(spark, sf_dir, "events").select("user_id", t, "event_id", "event_type")
    left = e.where("event_type = 'purchase'").select("user_id", "t", F.col("event_id").alias("purchase"))
    right = e.where("event_type = 'view'").select("user_id", F.col("t").alias("u"), F.col("event_id").alias("view"))
    return interval_join(left, right, ["user_id"], "t", "u", -3600, 0).select("purchase", "view")


@query("salted_join", "SELECT o_orderpriority, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1")
def salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join whose keys are dealt over salts on the large side and repeated on the small one."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", "o_orderpriority")
    small = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return salted_join(orders, small, ["k"], 8).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("file_formats", "SELECT f AS format, n_nationkey, n_name FROM nation, (VALUES ('csv'), ('json'), ('orc'), ('parquet')) t(f)")
def file_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows written to, and read from, each built-in file format."""
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    out = None
    for name in ("csv", "json", "orc", "parquet"):
        part = round_trip(rows, name).select(F.lit(name).alias("format"), "n_nationkey", "n_name")
        out = part if out is None else out.union(part)
    return out


@query("skewed_top_orders", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def top_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("nth", F.row_number().over(w)).where("nth <= 3").select("o_custkey", "o_orderkey")


@query("formatted_numbers", """
SELECT o_orderkey, format('{:,}', CAST(o_totalprice * 1000 AS BIGINT)) AS grouped, lpad(CAST(o_orderkey AS VARCHAR), 12, '.') AS padded FROM orders""")
def formatted_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers with separators, and padded texts."""
    rows = table(spark, sf_dir, "orders")
    return rows.select("o_orderkey", grouped_number((F.col("o_totalprice") * 1000).cast("decimal(38,0)").cast("long")).alias("grouped"), padded(F.col("o_orderkey").cast("string"), 12, ".").alias("padded"))
