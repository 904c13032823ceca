"""Queries over the import graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.operators import graph as g
from loomstone.plans.fixtures import GRAPH_SQL, graph
from loomstone.registry import query
from loomstone.sources.tables import table

_WITH = f"WITH {GRAPH_SQL}"


@query("outgoing_imports", f"""{_WITH}
SELECT i.file_id, i.import_path, i.line, i.is_external, i.resolved_file_id, f.address AS to_address, f.name AS to_name
FROM imports i LEFT JOIN files f ON i.resolved_file_id = f.file_id""")
def outgoing_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = graph(spark, sf_dir)
    return g.outgoing_imports(t["imports"], t["files"])


@query("incoming_imports", f"""{_WITH}
SELECT f.file_id AS to_file_id, s.file_id AS from_file_id, s.address AS from_address, s.name AS from_name, i.line
FROM imports i JOIN files f ON i.resolved_file_id = f.file_id JOIN files s ON s.file_id = i.file_id""")
def incoming_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = graph(spark, sf_dir)
    return g.incoming_imports(t["imports"], t["files"])


@query("file_databases", f"""{_WITH},
d AS (
  SELECT file_id, database_id, count(*) AS q,
    count(*) FILTER (sql LIKE '%select%') AS r, count(*) FILTER (sql LIKE '%INSERT%') AS w,
    count(*) FILTER (sql = 'FROM_VAR' AND is_dynamic) AS dyn
  FROM queries GROUP BY ALL
)
SELECT c.file_id, c.database_id, b.address, b.name, c.line, coalesce(r, 0) AS n_read, coalesce(w, 0) AS n_write,
  coalesce(dyn, 0) AS n_dynamic, coalesce(q, 0) AS n_queries,
  CASE WHEN r > 0 AND w > 0 THEN 'both' WHEN r > 0 THEN 'in' WHEN w > 0 THEN 'out' WHEN dyn > 0 THEN 'dynamic' ELSE 'unknown' END AS direction
FROM connections c JOIN databases b ON c.database_id = b.database_id
LEFT JOIN d ON d.file_id = c.file_id AND d.database_id = c.database_id""")
def file_databases(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = graph(spark, sf_dir)
    return g.file_databases(t["connections"], t["databases"], t["queries"])


@query("file_endpoints", f"""{_WITH}
SELECT fr.file_id, kind, name, locator, line FROM file_refs fr JOIN refs USING (ref_id)""")
def file_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = graph(spark, sf_dir)
    return g.file_endpoints(t["file_refs"], t["refs"])


@query("entry_points", f"""{_WITH}
SELECT file_id, project_id, address, name, is_readable_text FROM files f
WHERE is_readable_text AND NOT EXISTS (SELECT 1 FROM imports i WHERE i.resolved_file_id = f.file_id)""")
def entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = graph(spark, sf_dir)
    return g.entry_files(t["files"], t["imports"])


@query("missing_imports", f"""{_WITH}
SELECT import_id, file_id, import_path, resolved_file_id, is_external, line FROM imports WHERE NOT is_external AND resolved_file_id IS NULL""")
def missing_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.missing_imports(graph(spark, sf_dir)["imports"])


_TOPOLOGY = f"""{_WITH},
e AS (
  SELECT a.address AS from_id, b.address AS to_id, 'imports' AS kind, line
  FROM imports i JOIN files a ON a.file_id = i.file_id JOIN files b ON b.file_id = i.resolved_file_id WHERE NOT is_external
  UNION ALL SELECT f.address, r.kind || ':' || locator, 'external_ref', line FROM file_refs x JOIN files f USING (file_id) JOIN refs r USING (ref_id)
  UNION ALL SELECT f.address, coalesce(d.address, 'db:' || d.name), 'db_connection', line FROM connections c JOIN files f USING (file_id) JOIN databases d ON d.database_id = c.database_id
),
nodes AS (
  SELECT address AS id, 'file' AS kind, name FROM files f WHERE is_readable_text AND file_id NOT IN (SELECT resolved_file_id FROM imports WHERE resolved_file_id IS NOT NULL)
  UNION ALL SELECT coalesce(address, 'db:' || name), 'database', name FROM databases
  UNION ALL SELECT kind || ':' || locator, 'external', min(name) FROM refs GROUP BY 1
)"""


@query("topology_edges", f"{_TOPOLOGY} SELECT from_id, to_id, kind, min(line) AS line FROM e GROUP BY 1, 2, 3")
def topology_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = graph(spark, sf_dir)
    return g.topology_edges(t["files"], t["imports"], t["connections"], t["databases"], t["file_refs"], t["refs"])


@query("topology_nodes", f"{_TOPOLOGY} SELECT id, kind, name FROM nodes")
def topology_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = graph(spark, sf_dir)
    return g.topology_nodes(t["files"], t["imports"], t["databases"], t["refs"])


@query("topology_summary", f"""{_TOPOLOGY}
SELECT (SELECT count(*) FROM files) AS total_files, (SELECT count(*) FROM nodes WHERE kind = 'file') AS entry_points,
  (SELECT count(*) FROM nodes WHERE kind = 'database') AS databases, (SELECT count(*) FROM nodes WHERE kind = 'external') AS external_nodes,
  (SELECT count(*) FROM (SELECT DISTINCT from_id, to_id, kind FROM e)) AS edges""")
def topology_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = graph(spark, sf_dir)
    of = lambda k: F.count_if(F.col("kind") == k)
    nodes = topology_nodes(spark, sf_dir).agg(of("file").alias("entry_points"), of("database").alias("databases"), of("external").alias("external_nodes"))
    edges = topology_edges(spark, sf_dir).agg(F.count("*").alias("edges"))
    # Single rows on both sides.
    return t["files"].agg(F.count("*").alias("total_files")).join(nodes).join(edges)


_BFS = f"""WITH RECURSIVE {GRAPH_SQL},
edge AS (SELECT DISTINCT file_id AS src, resolved_file_id AS dst FROM imports WHERE NOT is_external AND resolved_file_id IN (SELECT file_id FROM files)),
"""


def _starts(t: dict[str, DataFrame]) -> DataFrame:
    """The stated starts: every fiftieth file."""
    return t["files"].where("file_id % 50 = 0").select(F.col("file_id").alias("start_id"))


@query("trace_hops", f"""{_BFS}
walk AS (SELECT file_id AS start_id, file_id AS node, 0 AS depth FROM files
  UNION SELECT start_id, dst, depth + 1 FROM walk JOIN edge ON src = node WHERE depth < 25)
, best AS (SELECT start_id, node, min(depth) AS depth FROM walk GROUP BY 1, 2)
, e AS (SELECT start_id, depth + 1 AS hop, i.* FROM best JOIN imports i ON i.file_id = node WHERE depth < 25)
, leaf AS (SELECT start_id, depth + 1 AS hop, count(*) AS n FROM best WHERE depth < 25 AND node NOT IN (SELECT file_id FROM imports) GROUP BY 1, 2)
, f AS (SELECT start_id, depth AS hop, count(*) AS n FROM best WHERE depth > 0 GROUP BY 1, 2)
SELECT start_id, hop, 'external' AS terminus, count(*) AS n FROM e WHERE is_external GROUP BY 1, 2
UNION ALL SELECT start_id, hop, 'unresolved', count(*) FROM e WHERE NOT is_external AND resolved_file_id IS NULL GROUP BY 1, 2
UNION ALL SELECT start_id, hop, 'leaf', n FROM leaf
UNION ALL SELECT start_id, hop, 'follow', n FROM f
UNION ALL SELECT e.start_id, e.hop, 'cycle', count(*) - coalesce(any_value(f.n), 0) FROM e LEFT JOIN f USING (start_id, hop)
  WHERE NOT is_external AND resolved_file_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) > coalesce(any_value(f.n), 0)""")
def trace_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges by hop and terminus of the traces from every file through the whole graph."""
    t = graph(spark, sf_dir)
    return g.trace_counts(t["imports"], t["files"].select(F.col("file_id").alias("start_id")))


@query("discover_files", f"""{_BFS}
walk AS (SELECT file_id AS start_id, file_id AS node, 0 AS depth FROM files
  UNION SELECT start_id, dst, depth + 1 FROM walk JOIN edge ON src = node WHERE depth < 5)
SELECT start_id, node, min(depth) AS depth FROM walk GROUP BY 1, 2""")
def discover_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = graph(spark, sf_dir)
    return g.discover(t["imports"], t["files"].select(F.col("file_id").alias("start_id")))


@query("crawl_neighbours", f"""{_BFS}
both_ways AS (SELECT src, dst FROM edge UNION SELECT dst, src FROM edge),
walk AS (SELECT file_id AS start_id, file_id AS node, 0 AS depth FROM files WHERE file_id % 50 = 0
  UNION SELECT start_id, dst, depth + 1 FROM walk JOIN both_ways ON src = node WHERE depth < 6)
SELECT start_id, node, min(depth) AS depth FROM walk GROUP BY 1, 2""")
def crawl_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = graph(spark, sf_dir)
    return g.crawl(t["imports"], _starts(t))


@query("file_placement", """
WITH f AS (SELECT c_custkey AS file_id, '/r' || (c_nationkey % 7) || '/n' || c_nationkey || '/' || c_custkey AS path, CASE WHEN c_custkey % 10 = 0 THEN c_custkey % 3 END AS project_id FROM customer),
roots AS (SELECT CAST(n_nationkey AS BIGINT) AS project_id, '/r' || (n_nationkey % 7) || '/n' || n_nationkey AS root FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 100 + r_regionkey, '/r' || r_regionkey FROM region WHERE r_regionkey < 2),
links AS (SELECT DISTINCT o_custkey AS file_id, CASE o_orderstatus WHEN 'F' THEN 1 ELSE 2 END AS project_id FROM orders),
m AS (SELECT file_id, arg_max(roots.project_id, length(root)) AS p FROM f JOIN roots ON starts_with(path, root || '/') GROUP BY 1),
l AS (SELECT file_id, min(project_id) AS p FROM links GROUP BY 1 HAVING count(DISTINCT project_id) = 1)
, d AS (SELECT file_id, path, CASE WHEN project_id IS NOT NULL THEN 'existing' WHEN m.p IS NOT NULL THEN 'root_match' WHEN l.p IS NOT NULL THEN 'linked' ELSE 'unknown' END AS placement,
  coalesce(project_id, m.p, l.p) AS project_id
FROM f LEFT JOIN m USING (file_id) LEFT JOIN l USING (file_id))
SELECT file_id, placement, project_id, CASE WHEN placement = 'unknown' THEN 'unknown_' || row_number() OVER (PARTITION BY placement ORDER BY path, file_id) END AS unknown_name FROM d""")
def file_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = F.col("c_custkey"), F.col("c_nationkey")
    files = table(spark, sf_dir, "customer").select(c.alias("file_id"), F.concat(F.lit("/r"), n % 7, F.lit("/n"), n, F.lit("/"), c).alias("path"), F.when(c % 10 == 0, c % 3).alias("project_id"))
    k, r = F.col("n_nationkey"), F.col("r_regionkey")
    roots = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(k.cast("long").alias("project_id"), F.concat(F.lit("/r"), k % 7, F.lit("/n"), k).alias("root"))
    roots = roots.union(table(spark, sf_dir, "region").where("r_regionkey < 2").select((r + 100).cast("long"), F.concat(F.lit("/r"), r)))
    links = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file_id"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(2).cast("long").alias("project_id")).distinct()
    return g.name_unknown(g.place_files(files, roots, links), files)


@query("absorbed_files", f"""{_BFS}
both_ways AS (SELECT src, dst FROM edge UNION SELECT dst, src FROM edge),
owned AS (SELECT file_id, CASE WHEN file_id % 4 = 0 THEN project_id END AS project_id FROM files),
walk AS (SELECT project_id, file_id AS node, 0 AS depth FROM owned WHERE project_id IS NOT NULL
  UNION SELECT project_id, dst, depth + 1 FROM walk JOIN both_ways ON src = node WHERE depth < 6)
SELECT walk.node AS file_id, min(walk.project_id) AS project_id FROM walk JOIN owned b ON b.file_id = walk.node AND b.project_id IS NULL GROUP BY 1""")
def absorbed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files without a project that a crawl from a project's files takes in."""
    t = graph(spark, sf_dir)
    owned = t["files"].select("file_id", F.when(F.col("file_id") % 4 == 0, F.col("project_id")).alias("project_id"))
    return g.absorb_unknown(t["imports"], owned)


@query("project_merge", """
SELECT c_nationkey % 5 AS project_id, count(*) AS n_files FROM (SELECT CASE WHEN c_nationkey % 5 = 3 THEN 1 ELSE c_nationkey END AS c_nationkey FROM customer) GROUP BY 1""")
def project_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file_id"), (F.col("c_nationkey") % 5).alias("project_id"))
    projects = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("project_id"))
    moved, kept = g.merge_project(files, projects, 3, 1)
    return moved.join(kept, "project_id", "left_semi").groupBy("project_id").agg(F.count("*").alias("n_files"))


@query("validation_walk", """
WITH t AS (SELECT o_custkey AS file_id, o_orderkey AS ord, o_orderstatus = 'F' AND o_orderkey % 3 = 0 AS verified, o_orderkey % 7 = 0 AS failed FROM orders),
f AS (SELECT file_id, min(ord) AS stop_at FROM t WHERE NOT verified AND failed GROUP BY 1)
SELECT t.file_id, ord, verified, failed FROM t LEFT JOIN f USING (file_id) WHERE NOT verified AND (stop_at IS NULL OR ord <= stop_at)""")
def validation_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file_id"), key.alias("ord"), ((F.col("o_orderstatus") == "F") & (key % 3 == 0)).alias("verified"), (key % 7 == 0).alias("failed"))
    return g.validation_walk(rows)


@query("common_ancestor", """
SELECT c_custkey // 3 AS grp, CASE WHEN count(DISTINCT c_nationkey) > 1 THEN '/r' WHEN count(DISTINCT c_mktsegment) > 1 THEN '/r/n' || min(c_nationkey)
  ELSE '/r/n' || min(c_nationkey) || '/' || min(c_mktsegment) END AS ancestor FROM customer GROUP BY 1""")
def common_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Common folders of every three files."""
    key = F.col("c_custkey")
    paths = table(spark, sf_dir, "customer").select(F.floor(key / 3).cast("long").alias("grp"), F.concat(F.lit("/r/n"), "c_nationkey", F.lit("/"), "c_mktsegment", F.lit("/"), key).alias("path"))
    return g.common_ancestor(paths, "grp")
