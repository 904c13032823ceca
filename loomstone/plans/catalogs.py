"""Queries over the hierarchy region > nation > customer > orders > lineitem as project > folder > file > module > method."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstone.functions.text import natural_key
from loomstone.operators import catalog as c
from loomstone.operators.relational import running
from loomstone.registry import query
from loomstone.sources.tables import table

FILES_SQL = """
files AS (
  SELECT c_custkey AS file_id, n_nationkey AS dir_id, CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE n_regionkey END AS project_id, c_name AS name,
    'r' || n_regionkey || '/n' || n_nationkey || '/' || c_name AS rel_path,
    '/srv/r' || n_regionkey || '/n' || n_nationkey || '/' || c_name AS abs_path,
    'b.' || n_nationkey || '.' || c_custkey AS address,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'supported' WHEN 'MACHINERY' THEN 'coming_soon' WHEN 'FURNITURE' THEN 'opaque_text' ELSE 'opaque_binary' END AS category,
    lower(c_mktsegment) AS language
  FROM customer JOIN nation ON c_nationkey = n_nationkey
)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n, name = F.col("n_regionkey"), F.col("n_nationkey"), F.col("c_name")
    category = F.when(F.col("c_mktsegment") == "BUILDING", "supported").when(F.col("c_mktsegment") == "MACHINERY", "coming_soon").when(F.col("c_mktsegment") == "FURNITURE", "opaque_text").otherwise("opaque_binary")
    rel = F.concat(F.lit("r"), r, F.lit("/n"), n, F.lit("/"), name)
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == n)
    return rows.select(
        F.col("c_custkey").alias("file_id"), n.alias("dir_id"), F.when(F.col("c_custkey") % 17 != 0, r).alias("project_id"), name.alias("name"), rel.alias("rel_path"),
        F.concat(F.lit("/srv/"), rel).alias("abs_path"), F.concat(F.lit("b."), n, F.lit("."), "c_custkey").alias("address"), category.alias("category"), F.lower("c_mktsegment").alias("language"),
    )


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("module_id"), F.col("o_custkey").alias("file_id"))


@query("project_counts", f"""WITH {FILES_SQL},
m AS (SELECT o_custkey AS file_id, count(*) AS m FROM orders GROUP BY 1)
SELECT r_regionkey AS project_id, r_name AS name, (SELECT count(*) FROM files f WHERE f.project_id = r_regionkey) AS n_files,
  CAST((SELECT coalesce(sum(m), 0) FROM files f JOIN m USING (file_id) WHERE f.project_id = r_regionkey) AS BIGINT) AS n_modules FROM region
UNION ALL SELECT NULL, 'unknown', count(*), CAST(coalesce(sum(m), 0) AS BIGINT) FROM files LEFT JOIN m USING (file_id) WHERE project_id IS NULL""")
def project_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    projects = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("project_id"), F.col("r_name").alias("name"))
    return c.project_counts(projects, files(spark, sf_dir), modules(spark, sf_dir))


@query("table_stats", "SELECT 'projects' AS what, count(*) AS n FROM region UNION ALL SELECT 'directories', count(*) FROM nation UNION ALL SELECT 'files', count(*) FROM customer UNION ALL SELECT 'modules', count(*) FROM orders UNION ALL SELECT 'methods', count(*) FROM lineitem")
def table_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = {"projects": "region", "directories": "nation", "files": "customer", "modules": "orders", "methods": "lineitem"}
    return c.table_counts({k: table(spark, sf_dir, v) for k, v in roles.items()})


@query("files_by_category", f"WITH {FILES_SQL} SELECT category, count(*) AS n FROM files GROUP BY 1")
def files_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"))


@query("scan_estimate", f"""WITH {FILES_SQL}
SELECT language, category, count(*) AS n_files, count(*) * CASE category WHEN 'supported' THEN 30 WHEN 'opaque_binary' THEN 2 ELSE 5 END AS est_ms,
  CASE WHEN count(*) >= 5000 THEN 'huge' WHEN count(*) >= 1000 THEN 'busy' ELSE 'none' END AS warning
FROM files GROUP BY language, category""")
def scan_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.scan_estimate(files(spark, sf_dir)).withColumn("warning", c.scan_warning(F.col("n_files")))


@query("scan_summary", "SELECT count(*) AS files, count(*) FILTER (o_orderstatus = 'O') AS parsed, count(*) FILTER (o_orderstatus = 'F') AS skipped, count(*) FILTER (o_orderstatus NOT IN ('O', 'F')) AS failed, count(*) FILTER (o_orderkey % 9 = 0) AS absent FROM orders")
def scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "parsed").when(F.col("o_orderstatus") == "F", "skipped").otherwise("failed")
    return c.scan_summary(table(spark, sf_dir, "orders").select(status.alias("parse_status"), (F.col("o_orderkey") % 9 != 0).alias("present")))


@query("folder_overview", f"WITH {FILES_SQL} SELECT split_part(rel_path, '/', 1) AS folder, count(*) AS n_files FROM files GROUP BY 1")
def folder_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.folder_overview(files(spark, sf_dir))


@query("exact_file_project", f"""WITH {FILES_SQL}, p AS (SELECT abs_path AS path FROM files UNION ALL SELECT '/none/' || r_name FROM region)
SELECT path, project_id FROM p LEFT JOIN files ON abs_path = path""")
def exact_file_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    paths = f.select(F.col("abs_path").alias("path")).union(table(spark, sf_dir, "region").select(F.concat(F.lit("/none/"), "r_name")))
    return c.exact_project(paths, f)


_ROOTS = "roots AS (SELECT CAST(n_nationkey AS BIGINT) AS project_id, '/srv/r' || n_regionkey || '/n' || n_nationkey AS root FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT 100 + r_regionkey, '/srv/r' || r_regionkey FROM region WHERE r_regionkey <> 2)"


def roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r, k = F.col("n_nationkey"), F.col("n_regionkey"), F.col("r_regionkey")
    low = table(spark, sf_dir, "nation").where("n_nationkey % 3 = 0").select(n.cast("long").alias("project_id"), F.concat(F.lit("/srv/r"), r, F.lit("/n"), n).alias("root"))
    return low.union(table(spark, sf_dir, "region").where("r_regionkey <> 2").select((k + 100).cast("long"), F.concat(F.lit("/srv/r"), k)))


@query("longest_project_root", f"""WITH {FILES_SQL}, {_ROOTS}
SELECT abs_path AS path, (SELECT arg_max(project_id, length(root)) FROM roots WHERE starts_with(abs_path, root || '/')) AS project_id FROM files""")
def longest_project_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.longest_root(files(spark, sf_dir).select(F.col("abs_path").alias("path")), roots(spark, sf_dir))


@query("overlapping_roots", f"WITH {_ROOTS} SELECT a.project_id AS outer_project, b.project_id AS inner_project FROM roots a JOIN roots b ON starts_with(b.root, a.root || '/')")
def overlapping_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.overlapping_roots(roots(spark, sf_dir))


@query("suffix_match", f"""WITH {FILES_SQL}, f AS (SELECT file_id, abs_path || CASE WHEN file_id % 2 = 0 THEN '' ELSE '/x' END AS abs_path FROM files),
s AS (SELECT DISTINCT name AS suffix FROM files UNION SELECT 'x' UNION SELECT 'nothing'),
h AS (SELECT suffix, file_id, length(abs_path) AS n FROM s JOIN f ON abs_path = suffix OR ends_with(abs_path, '/' || suffix)),
t AS (SELECT suffix, max(n) AS n FROM h GROUP BY 1)
SELECT suffix, CASE count(file_id) WHEN 0 THEN 'none' WHEN 1 THEN 'found' ELSE 'ambiguous' END AS status, CASE count(file_id) WHEN 1 THEN min(file_id) END AS file_id
FROM s LEFT JOIN (SELECT h.* FROM h JOIN t USING (suffix, n)) USING (suffix) GROUP BY 1""")
def suffix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    longer = f.select("file_id", F.concat("abs_path", F.when(F.col("file_id") % 2 == 0, "").otherwise("/x")).alias("abs_path"))
    wanted = f.select(F.col("name").alias("suffix")).union(spark.sql("SELECT explode(array('x', 'nothing')) AS suffix")).distinct()
    return c.suffix_match(wanted, longer)


@query("resolve_coordinate", f"""WITH {FILES_SQL}, q AS (SELECT address || CASE file_id % 3 WHEN 0 THEN '' WHEN 1 THEN '.12' ELSE '.3.4' END AS coordinate FROM files UNION ALL SELECT 'b.' || n_nationkey FROM nation)
SELECT coordinate, (SELECT arg_max(file_id, length(address)) FROM files WHERE address = coordinate OR starts_with(coordinate, address || '.')) AS file_id,
  (SELECT nullif(substr(coordinate, max(length(address)) + 2), '') FROM files WHERE address = coordinate OR starts_with(coordinate, address || '.')) AS segment,
  CASE WHEN EXISTS (SELECT 1 FROM files WHERE address = coordinate OR starts_with(coordinate, address || '.')) THEN 'file' ELSE 'folder' END AS kind
FROM q""")
def resolve_coordinate(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    tail = F.when(F.col("file_id") % 3 == 0, "").when(F.col("file_id") % 3 == 1, ".12").otherwise(".3.4")
    q = f.select(F.concat("address", tail).alias("coordinate")).union(table(spark, sf_dir, "nation").select(F.concat(F.lit("b."), "n_nationkey")))
    return c.resolve_coordinate(q, f)


@query("address_lookup", """
WITH q AS (SELECT 'k' || o_orderkey AS address FROM orders)
SELECT address, CASE WHEN k <= 5 THEN 'database' WHEN k < 25 THEN 'directory' WHEN k <= (SELECT max(c_custkey) FROM customer) AND k >= 1 THEN 'file' ELSE 'module' END AS kind, k AS id
FROM (SELECT address, CAST(substr(address, 2) AS BIGINT) AS k FROM q)""")
def address_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = lambda name, key: table(spark, sf_dir, name).select(F.concat(F.lit("k"), key).alias("address"), F.col(key).alias("id"))
    tables = {"database": named("supplier", "s_suppkey").where("id <= 5"), "directory": named("nation", "n_nationkey"), "file": named("customer", "c_custkey"), "module": named("orders", "o_orderkey")}
    return c.address_lookup(named("orders", "o_orderkey").select("address"), tables)


@query("path_search", f"""WITH {FILES_SQL}, p AS (SELECT rel_path AS path FROM files UNION ALL SELECT DISTINCT 'r' || n_regionkey FROM nation UNION ALL SELECT 'r' || n_regionkey || '/n' || n_nationkey FROM nation)
SELECT path FROM p WHERE EXISTS (SELECT 1 FROM p q WHERE q.path LIKE '%0012%' AND (q.path = p.path OR starts_with(q.path, p.path || '/')))""")
def path_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    folder = F.concat(F.lit("r"), "n_regionkey")
    paths = files(spark, sf_dir).select(F.col("rel_path").alias("path")).union(n.select(folder).distinct()).union(n.select(F.concat(folder, F.lit("/n"), "n_nationkey")))
    return c.with_ancestors(paths, F.col("path").contains("0012"))


def _letters_sql(n: str) -> str:
    return f"CASE WHEN {n} < 26 THEN chr(97 + CAST({n} AS INT)) WHEN {n} < 702 THEN chr(97 + CAST(({n} - 26) // 26 AS INT)) || chr(97 + CAST(({n} - 26) % 26 AS INT)) ELSE chr(97 + CAST(({n} - 702) // 676 AS INT)) || chr(97 + CAST(({n} - 702) // 26 % 26 AS INT)) || chr(97 + CAST(({n} - 702) % 26 AS INT)) END"


@query("assign_addresses", f"""WITH {FILES_SQL},
u AS (
  SELECT 'directory' AS kind, CAST(n_nationkey AS BIGINT) AS id, 1000 + n_regionkey AS parent_id, 0 AS a, 0 AS b, n_name AS key FROM nation
  UNION ALL SELECT 'file', file_id, dir_id % 3 + 1000, 1, CASE WHEN category = 'supported' THEN 0 ELSE 1 END, name FROM files
), r AS (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY a, b, key, id) - 1 AS n FROM u)
SELECT kind, id, parent_id, {_letters_sql('n')} AS letter FROM r""")
def assign_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("dir_id"), (F.col("n_regionkey") + 1000).alias("parent_id"), F.col("n_name").alias("path"), F.lit(1).alias("depth"))
    own = files(spark, sf_dir).select("file_id", (F.col("dir_id") % 3 + 1000).alias("dir_id"), "name", (F.col("category") == "supported").alias("supported"))
    return c.assign_addresses(dirs, own)


@query("next_free_address", f"SELECT c_nationkey AS dir_id, max(c_custkey) + 1 AS next, {_letters_sql('(max(c_custkey) + 1)')} AS next_letters FROM customer GROUP BY 1")
def next_free_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.next_free(table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "dir_id"), "c_custkey", "dir_id")


@query("unique_names", "SELECT o_orderkey, CASE WHEN n = 1 THEN o_orderpriority ELSE o_orderpriority || '-' || n END AS unique_name FROM (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS n FROM orders)")
def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.unique_names(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderdate", "o_orderkey").select("o_orderkey", "unique_name")


@query("natural_address_order", """
SELECT s_suppkey, row_number() OVER (ORDER BY s_nationkey, s_suppkey) AS place FROM supplier""")
def natural_address_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses a.<nation>.<supplier> in natural order: numbers by value, not by text."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("a."), "s_nationkey", F.lit("."), "s_suppkey").alias("address"))
    keyed = rows.select("s_suppkey", natural_key(F.col("address")).alias("key"))
    return running(keyed, ["key"]).select("s_suppkey", "place")


@query("tree_order", f"""WITH {FILES_SQL}
SELECT file_id, row_number() OVER (ORDER BY 'r' || split_part(split_part(rel_path, '/', 1), 'r', 2), split_part(rel_path, '/', 2), name) AS place FROM files""")
def tree_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in tree order: folders (with all below) before the files of their parent."""
    parts = F.split("rel_path", "/")
    key = F.transform(parts, lambda p, i: F.struct((i == F.size(parts) - 1).alias("file"), p.alias("name")))
    return running(files(spark, sf_dir).select("file_id", key.alias("key")), ["key"]).select("file_id", "place")


@query("recent_first", "SELECT s_suppkey, row_number() OVER (ORDER BY last_scan DESC NULLS LAST, s_suppkey) AS place FROM (SELECT s_suppkey, CASE WHEN s_nationkey % 4 = 0 THEN NULL ELSE s_nationkey END AS last_scan FROM supplier)")
def recent_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan = F.when(F.col("s_nationkey") % 4 != 0, F.col("s_nationkey"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", scan.alias("last_scan"))
    return running(rows, [F.col("last_scan").desc_nulls_last(), F.col("s_suppkey")]).select("s_suppkey", "place")


@query("queue_positions", "SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS position FROM documents")
def queue_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smallest file first in each project's queue."""
    return table(spark, sf_dir, "documents").select("doc_id", F.row_number().over(Window.partitionBy("source").orderBy("n_chars", "doc_id")).cast("long").alias("position"))


@query("bones_imports", """
WITH i AS (SELECT o_custkey AS file_id, o_orderpriority AS import_path, o_orderkey AS import_id, o_orderkey % 9 AS line, o_orderkey % 50 AS resolved_file_id, o_orderstatus = 'F' AS is_external FROM orders)
SELECT file_id, import_path, line, resolved_file_id, is_external FROM i QUALIFY row_number() OVER (PARTITION BY file_id, import_path ORDER BY line, import_id) = 1""")
def bones_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return c.bones_imports(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file_id"), F.col("o_orderpriority").alias("import_path"), key.alias("import_id"), (key % 9).alias("line"), (key % 50).alias("resolved_file_id"), (F.col("o_orderstatus") == "F").alias("is_external")))


@query("broken_import_count", "SELECT p_size % 5 AS project_id, count(*) FILTER (p_partkey % 13 = 0 AND p_partkey % 11 <> 0) AS broken FROM part GROUP BY 1")
def broken_import_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomstone.operators.graph import missing_imports
    from loomstone.plans.fixtures import graph

    t = graph(spark, sf_dir)
    broken = missing_imports(t["imports"]).groupBy("file_id").agg(F.count("*").alias("n"))
    return t["files"].join(broken, "file_id", "left").groupBy("project_id").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("broken"))


@query("upsert_files", """
SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN a.name ELSE b.name END AS name, CASE WHEN b.k IS NULL THEN a.first_seen ELSE coalesce(a.first_seen, b.first_seen) END AS first_seen
FROM (SELECT c_custkey AS k, c_name AS name, c_nationkey AS first_seen FROM customer WHERE c_custkey % 3 <> 0) a
FULL JOIN (SELECT o_custkey AS k, max(o_orderpriority) AS name, 99 AS first_seen FROM orders GROUP BY 1) b USING (k)""")
def upsert_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("first_seen"))
    fresh = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderpriority").alias("name"), F.lit(99).alias("first_seen"))
    return c.upsert(stored, fresh, "k", ("first_seen",))


@query("upsert_endpoints", """
WITH u AS (SELECT l_returnflag AS kind, 'h' || (l_suppkey % 9) AS locator, repeat('x', CAST(l_linenumber AS INT)) AS extra, l_linestatus = 'F' AS parsed FROM lineitem)
SELECT kind, locator, extra, parsed FROM u QUALIFY row_number() OVER (PARTITION BY kind, locator ORDER BY parsed DESC, length(extra) DESC) = 1""")
def upsert_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    rows = line.select(F.col("l_returnflag").alias("kind"), F.concat(F.lit("h"), F.col("l_suppkey") % 9).alias("locator"), F.expr("repeat('x', cast(l_linenumber as int))").alias("extra"), (F.col("l_linestatus") == "F").alias("parsed"), (F.col("l_orderkey") % 2).alias("half"))
    return c.upsert_endpoints(rows.where("half = 0").drop("half"), rows.where("half = 1").drop("half"))


@query("append_versions", """
WITH v AS (SELECT conv_id AS file_id, turn + 1 AS version_number, md5(text) AS hash FROM conversations),
l AS (SELECT file_id, max(version_number) AS n, arg_max(hash, version_number) AS h FROM v GROUP BY 1),
f AS (SELECT conv_id AS file_id, CASE WHEN conv_id % 2 = 0 THEN h ELSE 'new' END AS hash FROM (SELECT DISTINCT conv_id FROM conversations) JOIN l ON conv_id = file_id UNION ALL SELECT -1, 'first')
SELECT f.file_id, coalesce(n, 0) + 1 AS version_number, f.hash FROM f LEFT JOIN l USING (file_id) WHERE f.hash IS DISTINCT FROM h""")
def append_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file_id"), (F.col("turn") + 1).alias("version_number"), F.md5("text").alias("hash"))
    latest = v.groupBy("file_id").agg(F.max_by("hash", "version_number").alias("hash"))
    fresh = latest.select("file_id", F.when(F.col("file_id") % 2 == 0, F.col("hash")).otherwise("new").alias("hash")).union(spark.sql("SELECT -1L, 'first'"))
    return c.append_versions(v, fresh)


@query("write_guard", f"""WITH {FILES_SQL}, q AS (SELECT '/srv/r' || c_nationkey % 5 || '/n' || c_nationkey || '/' || c_name AS path, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey % 6 END AS project_id FROM customer)
SELECT path, project_id, CASE WHEN project_id IS NULL THEN 'project missing' WHEN project_id > 4 THEN 'project unknown' WHEN path IN (SELECT abs_path FROM files) THEN 'file exists' END AS refused FROM q""")
def write_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_nationkey")
    q = table(spark, sf_dir, "customer").select(F.concat(F.lit("/srv/r"), n % 5, F.lit("/n"), n, F.lit("/"), "c_name").alias("path"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_custkey") % 6).alias("project_id"))
    projects = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("project_id"))
    return c.creatable(q, files(spark, sf_dir), projects)


@query("unused_databases", "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_discount > 0.08)")
def unused_databases(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "lineitem").where("l_quantity > 49 AND l_discount > 0.08").select(F.col("l_suppkey").alias("s_suppkey"))
    return c.unreferenced(table(spark, sf_dir, "supplier"), "s_suppkey", used).select("s_suppkey", "s_name")


@query("neighbour_projects", """
WITH i AS (SELECT DISTINCT l_partkey % 5 AS a, l_suppkey % 7 AS b FROM lineitem)
SELECT a AS project_id, b AS neighbour FROM i UNION SELECT b, a FROM i""")
def neighbour_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 5).alias("project_id"), (F.col("l_suppkey") % 7).alias("neighbour"))
    return i.union(i.select("neighbour", "project_id")).distinct()
