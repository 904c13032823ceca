"""Queries over texts: tokens, lines, segments, endpoints, search; synthetic sources are built from key columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.functions import net, text
from loomstone.functions.text import basename, dirname
from loomstone.operators import extract, facts, segments, textindex
from loomstone.registry import query
from loomstone.sources.scratch import cut, scratch_dir
from loomstone.sources.tables import table
from loomstone.sources.tree import list_tree, with_content


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", F.lit("plaintext").alias("language"), "source")


@query("token_estimates", """
SELECT doc_id, CAST(ceil(octet_length(encode(text)) / 3.7) AS BIGINT) AS file_tokens, CAST(ceil(length(text) / 4.0) AS BIGINT) AS response_tokens,
  CAST(floor(length(text) / 4.0 + 0.5) AS BIGINT) AS page_tokens, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) END AS n_lines FROM documents""")
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.file_tokens(t).alias("file_tokens"), text.response_tokens(t).alias("response_tokens"), text.page_tokens(t).alias("page_tokens"), text.line_count(t).alias("n_lines"))


@query("plain_segments", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
f AS (SELECT *, trim(regexp_replace(line, '\\s+', ' ', 'g')) = '' AS blank, trim(line, ' ') AS t FROM l),
h AS (SELECT *, NOT blank AND ((length(t) BETWEEN 4 AND 79 AND t = upper(t) AND regexp_matches(t, '[A-Z]')) OR regexp_matches(t, '^[\\d.]+\\s+.') OR regexp_matches(t, '^#{1,6}\\s+.')) AND NOT regexp_matches(t, '^[=-]{3,}\\s*$') AS heading FROM f),
s AS (SELECT *, sum(CASE WHEN prev IS NULL OR prev <> blank OR (NOT blank AND heading) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS ord
  FROM (SELECT *, lag(blank) OVER (PARTITION BY doc_id ORDER BY n) AS prev FROM h))
SELECT doc_id, CAST(ord AS BIGINT) AS ord, CAST(min(n) AS BIGINT) AS start_line, CAST(max(n) AS BIGINT) AS end_line, bool_or(blank) AS blank, CAST(sum(length(line)) + count(*) - 1 AS BIGINT) AS n_chars FROM s GROUP BY 1, 2""")
def plain_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments.plain_segments(_docs(spark, sf_dir))
    return s.select("doc_id", "ord", "start_line", "end_line", (F.col("kind") == "whitespace").alias("blank"), F.length("content").cast("long").alias("n_chars"))


@query("segments_cover", "SELECT doc_id, true AS covered FROM documents")
def segments_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return segments.covers(segments.plain_segments(docs), docs)


_ENDPOINT_TEXT = "'import mod_' || k || chr(10) || 'x = http://h' || k || '.io:' || (8000 + k % 100) || chr(10) || '127.0.0.1:' || (9000 + k % 7) || ' and svc-' || (k % 5) || '.service' || chr(10) || 'systemctl restart db' || (k % 3) || chr(10) || 'load \"/m/w' || k || '.gguf\" with ffmpeg'"


def _endpoint_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr("c_custkey AS k").selectExpr("k AS doc_id", f"{_ENDPOINT_TEXT} AS text")


@query("detect_endpoints", """
WITH c AS (SELECT c_custkey AS k FROM customer)
SELECT k AS doc_id, 'server' AS kind, 'h' || k || '.io:' || (8000 + k % 100) AS name, 'h' || k || '.io:' || (8000 + k % 100) AS locator, 2 AS line FROM c
UNION ALL SELECT k, 'server', '127.0.0.1:' || (9000 + k % 7), '127.0.0.1:' || (9000 + k % 7), 3 FROM c
UNION ALL SELECT k, 'service', 'svc-' || (k % 5) || '.service', 'svc-' || (k % 5) || '.service', 3 FROM c
UNION ALL SELECT k, 'service', 'db' || (k % 3) || '.service', 'db' || (k % 3) || '.service', 4 FROM c
UNION ALL SELECT k, 'model', 'w' || k || '.gguf', '/m/w' || k || '.gguf', 5 FROM c
UNION ALL SELECT k, 'binary', 'ffmpeg', 'ffmpeg', 5 FROM c""")
def detect_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.detect_endpoints(_endpoint_docs(spark, sf_dir))


@query("merged_endpoints", """
WITH e AS (SELECT p_partkey % 50 AS doc_id, 'server' AS kind, 'h' || (p_partkey % 9) AS locator, p_partkey % 7 % 3 AS source, p_size AS line FROM part)
SELECT doc_id, kind, locator, source, min(line) AS line FROM e GROUP BY doc_id, kind, locator, source QUALIFY source = min(source) OVER (PARTITION BY doc_id, kind, locator)""")
def merged_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoints of a parser, of listeners, and of detection."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select((k % 50).alias("doc_id"), F.lit("server").alias("kind"), F.concat(F.lit("h"), k % 9).alias("locator"), F.col("p_size").alias("line"), (k % 7 % 3).alias("from"))
    return facts.merge_endpoints(*(rows.where(F.col("from") == i) for i in range(3)))


@query("private_addresses", """
WITH a AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}')) AS ip FROM documents),
o AS (SELECT DISTINCT doc_id, ip, CAST(split_part(ip, '.', 1) AS INT) AS a, CAST(split_part(ip, '.', 2) AS INT) AS b, CAST(split_part(ip, '.', 3) AS INT) AS c FROM a)
SELECT doc_id, ip, a IN (0, 10, 127) OR a >= 224 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168)
  OR (a = 192 AND b = 0 AND c IN (0, 2)) OR (a = 198 AND b IN (18, 19)) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113) AS private FROM o""")
def private_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every address of every text, and whether it is of a special block."""
    every = F.regexp_extract_all("text", F.lit(r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(every)).alias("ip")).select("*", net.is_private_ip(F.col("ip")).alias("private"))


@query("content_search", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
h AS (SELECT doc_id, CAST(n AS BIGINT) AS line, count(*) OVER (PARTITION BY doc_id) AS total, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS nth FROM l WHERE contains(lower(line), 'the '))
SELECT doc_id, line, total, nth, 'b' || ((line - 1) // 4) AS seg FROM h WHERE nth <= 25""")
def content_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a word, each with the innermost of nested segments (whole text, blocks of eight and of four lines)."""
    docs = _docs(spark, sf_dir)
    hits = segments.limited(segments.matching_lines(docs, "The "), ["doc_id"], ["line"])
    n = docs.select("doc_id", F.size(F.split("text", "\n", -1)).alias("lines"))
    def blocks(size: int, depth: int, name: str) -> DataFrame:
        rows = n.select("doc_id", F.explode(F.sequence(F.lit(0), F.floor((F.col("lines") - 1) / size))).alias("b"), "lines")
        return rows.select("doc_id", F.concat(F.lit(name), "b").alias("seg"), F.lit(depth).alias("depth"), (F.col("b") * size + 1).alias("start_line"), F.least((F.col("b") + 1) * size, F.col("lines").cast("long")).alias("end_line"))

    nested = blocks(1 << 30, 0, "all").union(blocks(8, 1, "a")).union(blocks(4, 2, "b"))
    inner = segments.deepest_segments(hits.select("doc_id", "line"), nested)
    return hits.join(inner, ["doc_id", "line"]).select("doc_id", "line", "total", F.col("nth").cast("long").alias("nth"), "seg")


@query("name_search", "SELECT p_partkey, p_name, p_type FROM part WHERE contains(lower(p_name), 'e') OR contains(lower(p_type), 'e')")
def name_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_type").alias("kind"))
    return segments.search_names(rows, "E").select("p_partkey", F.col("name").alias("p_name"), F.col("kind").alias("p_type"))


#: Searches: a frequent one, a rare one, one across words, one in other letters, one that no text has, and one of too few bytes for a gram.
_TERMS = ("THE ", "password", "of the", "É", "qzqzq", "x=")


@query("indexed_content_search", f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
h AS (SELECT term, doc_id, CAST(n AS BIGINT) AS line, count(*) OVER w AS total, row_number() OVER (w ORDER BY n) AS nth
  FROM l JOIN (SELECT unnest({list(_TERMS)}) AS term) ON contains(lower(line), lower(term)) WINDOW w AS (PARTITION BY term, doc_id))
SELECT term, doc_id, line, total, nth FROM h WHERE nth <= 25""")
def indexed_content_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that hold each of several texts, by one written index."""
    index = textindex.LineIndex.build(_docs(spark, sf_dir).select("doc_id", "text"))
    found = None
    for term in _TERMS:
        hits = segments.limited(index.matching_lines(term), ["doc_id"], ["line"]).select(F.lit(term).alias("term"), "doc_id", "line", "total", F.col("nth").cast("long").alias("nth"))
        found = hits if found is None else found.union(hits)
    return found


_NAMES = ("E", "STEEL", "an", "#1")


@query("indexed_name_search", f"""
SELECT term, p_partkey FROM part JOIN (SELECT unnest({list(_NAMES)}) AS term) ON contains(lower(p_name), lower(term)) OR contains(lower(p_type), lower(term))""")
def indexed_name_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments whose name or kind holds each of several texts, by one written index."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_type").alias("kind"))
    index = textindex.TextIndex.build(rows, F.concat_ws("\n", "name", "kind"))
    found = None
    for term in _NAMES:
        hits = segments.search_names(index.search(term), term).select(F.lit(term).alias("term"), "p_partkey")
        found = hits if found is None else found.union(hits)
    return found


@query("source_spans", """
SELECT doc_id, 2 AS line_start, 4 AS line_end, array_to_string(list_slice(string_split(text, chr(10)), 2, 4), chr(10)) AS source FROM documents""")
def source_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return segments.source_span(docs, docs.select("doc_id", F.lit(2).alias("line_start"), F.lit(4).alias("line_end")))


@query("large_file_windows", """
WITH RECURSIVE l AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents),
w AS (SELECT doc_id, 0 AS w, 1 AS a, least(9, n) AS b, n FROM l UNION ALL SELECT doc_id, w + 1, b + 1, least(b + 9, n), n FROM w WHERE b < n)
SELECT doc_id, CAST(w AS BIGINT) AS "window", CAST(a AS BIGINT) AS start_line, CAST(b AS BIGINT) AS end_line FROM w""")
def large_file_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of at most nine lines (no line of these texts is blank or closing)."""
    return segments.windows_of_lines(_docs(spark, sf_dir), 5, 9)


@query("uncovered_lines", """
WITH n AS (SELECT l_orderkey AS doc_id, 100 AS lines FROM lineitem GROUP BY 1),
s AS (SELECT l_orderkey AS doc_id, l_partkey % 90 + 1 AS a, l_partkey % 90 + 1 + l_suppkey % 9 AS b FROM lineitem),
g AS (SELECT doc_id, x FROM n, range(1, 101) r(x) EXCEPT SELECT doc_id, unnest(range(a, b + 1)) FROM s)
SELECT doc_id, CAST(min(x) AS BIGINT) AS start_line, CAST(max(x) AS BIGINT) AS end_line, 'lines ' || min(x) || '-' || max(x) AS name FROM (SELECT doc_id, x, x - row_number() OVER (PARTITION BY doc_id ORDER BY x) AS run FROM g) GROUP BY doc_id, run""")
def uncovered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    a = F.col("l_partkey") % 90 + 1
    spans = line.select(F.col("l_orderkey").alias("doc_id"), a.alias("start_line"), (a + F.col("l_suppkey") % 9).alias("end_line"))
    return segments.fill_lines(spans, spans.select("doc_id").distinct().withColumn("lines", F.lit(100).cast("long")))


@query("stable_segment_ids", """
SELECT o_orderkey, substr(sha1('p' || (o_custkey % 50) || chr(0) || '' || chr(0) || o_orderstatus || chr(0) || o_orderpriority || chr(0) || 'x' || chr(0) || n), 1, 12) AS seg_id
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey % 50, o_orderstatus, o_orderpriority ORDER BY o_orderkey) AS n FROM orders)""")
def stable_segment_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("p"), F.col("o_custkey") % 50).alias("path"), F.lit(None).cast("string").alias("parent_id"), F.col("o_orderstatus").alias("kind"), F.col("o_orderpriority").alias("name"), F.lit("x").alias("first_line"), F.col("o_orderkey").alias("ord"))
    return segments.stable_ids(rows).select("o_orderkey", "seg_id")


@query("banner_groups", "SELECT o_orderkey AS ord, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS \"group\" FROM orders")
def banner_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("ord"), (F.col("o_orderstatus") == "F").alias("banner"))
    return segments.section_groups(rows).select("ord", "group")


@query("compact_skeleton", """
WITH s AS (SELECT o_custkey AS doc_id, o_orderkey AS ord, CASE o_orderstatus WHEN 'F' THEN 'import' ELSE 'function' END AS kind FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - row_number() OVER (PARTITION BY doc_id, kind ORDER BY ord) AS run FROM s)
SELECT doc_id, min(ord) AS ord, kind, count(*) AS n FROM r WHERE kind = 'import' GROUP BY doc_id, kind, run UNION ALL SELECT doc_id, ord, kind, 1 FROM r WHERE kind <> 'import'""")
def compact_skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("ord"), F.when(F.col("o_orderstatus") == "F", "import").otherwise("function").alias("kind"), F.lit("").alias("name"))
    return segments.compact_skeleton(rows).select("doc_id", "ord", "kind", "n")


@query("attributed_queries", """
WITH d AS (SELECT s_suppkey AS database_id, s_suppkey % 40 AS file_id, CASE WHEN s_nationkey % 3 = 0 THEN 'lmdb' ELSE 'sqlite' END AS type, CASE WHEN s_nationkey % 2 = 0 THEN 'db' END AS handle FROM supplier),
q AS (SELECT o_orderkey AS query_id, o_orderkey % 40 AS file_id, CASE WHEN o_orderkey % 3 = 0 THEN 'db' END AS receiver FROM orders),
h AS (SELECT file_id, handle, min(database_id) AS id FROM d WHERE type = 'sqlite' AND handle IS NOT NULL GROUP BY 1, 2),
o AS (SELECT file_id, min(database_id) AS id FROM d WHERE type = 'sqlite' GROUP BY 1 HAVING count(DISTINCT database_id) = 1)
SELECT query_id, q.file_id, coalesce(h.id, o.id) AS database_id FROM q LEFT JOIN h ON h.file_id = q.file_id AND h.handle = receiver LEFT JOIN o ON o.file_id = q.file_id""")
def attributed_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n, o = F.col("s_suppkey"), F.col("s_nationkey"), F.col("o_orderkey")
    databases = table(spark, sf_dir, "supplier").select(k.alias("database_id"), (k % 40).alias("file_id"), F.when(n % 3 == 0, "lmdb").otherwise("sqlite").alias("type"), F.when(n % 2 == 0, "db").alias("handle"))
    queries = table(spark, sf_dir, "orders").select(o.alias("query_id"), (o % 40).alias("file_id"), F.when(o % 3 == 0, "db").alias("receiver"))
    return facts.attribute_queries(queries, databases)


@query("resolved_imports", """
WITH i AS (SELECT p_partkey AS import_id, p_partkey % 6 AS m, p_partkey AS k FROM part), n AS (SELECT max(p_partkey) AS n FROM part)
SELECT import_id, CASE m WHEN 0 THEN './f' || (k // 2) WHEN 1 THEN '../d1/f' || (k + 100000) WHEN 2 THEN 'react' WHEN 3 THEN './f' || k || '.js' WHEN 4 THEN 'd0.f' || (k // 4) ELSE 'os' END AS import_path,
  CASE WHEN m = 0 AND (k // 2) % 3 = k % 3 AND (k // 2) % 6 <= 3 THEN k // 2 WHEN m = 3 AND k % 6 <= 3 THEN k WHEN m = 4 AND (k // 4) % 3 = 0 AND (k // 4) % 6 > 3 THEN k // 4 END AS resolved_file_id,
  m IN (2, 5) AS is_external FROM i, n""")
def resolved_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files /p/d<k mod 3>/f<k>.js (or .py where k mod 6 is over 3), each with one import."""
    return facts.resolve_imports(*_importing_files(spark, sf_dir))


def _importing_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("p_partkey")
    m, half, quarter = k % 6, F.floor(k / 2), F.floor(k / 4)
    python = m > 3
    path = F.concat(F.lit("/p/d"), k % 3, F.lit("/f"), k, F.when(python, ".py").otherwise(".js"))
    rows = table(spark, sf_dir, "part")
    files = rows.select(k.alias("file_id"), path.alias("path"), F.lit("/p").alias("root"))
    text_ = (
        F.when(m == 0, F.concat(F.lit("./f"), half)).when(m == 1, F.concat(F.lit("../d1/f"), k + 100000)).when(m == 2, "react")
        .when(m == 3, F.concat(F.lit("./f"), k, F.lit(".js"))).when(m == 4, F.concat(F.lit("d0.f"), quarter)).otherwise("os")
    )
    imports = rows.select(k.alias("import_id"), path.alias("file_path"), F.lit("/p").alias("root"), F.when(python, "python").otherwise("javascript").alias("language"), text_.alias("import_path"))
    return imports, files


@query("relinked_imports", """
WITH i AS (SELECT p_partkey AS import_id, p_partkey % 6 AS m, p_partkey AS k FROM part WHERE p_partkey % 11 <> 0)
SELECT import_id, CASE m WHEN 0 THEN './f' || (k // 2) WHEN 1 THEN '../d1/f' || (k + 100000) WHEN 2 THEN 'react' WHEN 3 THEN './f' || k || '.js' WHEN 4 THEN 'd0.f' || (k // 4) ELSE 'os' END AS import_path,
  CASE WHEN m = 0 AND (k // 2) % 3 = k % 3 AND (k // 2) % 6 <= 3 AND (k // 2) % 4 <> 1 THEN k // 2 WHEN m = 3 AND k % 4 <> 1 THEN k WHEN m = 4 AND (k // 4) % 3 = 0 AND (k // 4) % 6 > 3 AND (k // 4) % 4 <> 1 THEN k // 4 END AS resolved_file_id,
  m IN (2, 5) AS is_external FROM i""")
def relinked_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The import graph after files came and went, and imports: only what these may concern is resolved again."""
    imports, files = _importing_files(spark, sf_dir)
    before, after = files.where("file_id % 5 <> 0"), files.where("file_id % 4 <> 1")
    known = cut(facts.resolve_imports(imports.where("import_id % 7 <> 0"), before), "resolved")
    asked = imports.where("import_id % 11 <> 0")
    return facts.relink_imports(asked, known, cut(facts.import_candidates(asked), "candidates"), before, after)


@query("listed_tree", """
SELECT 'a=' || (p_size % 7) || '/b=' || (p_partkey % 5) AS folder, count(*) AS n_lines, CAST(sum(strlen(p_name) + 1) AS BIGINT) AS size FROM part GROUP BY 1""")
def listed_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts written as text in folders of folders; the tree is listed in tasks, and only files of text are read."""
    root = scratch_dir(spark, "names")
    table(spark, sf_dir, "part").select(F.col("p_name").alias("value"), (F.col("p_size") % 7).alias("a"), (F.col("p_partkey") % 5).alias("b")).write.partitionBy("a", "b").text(root)
    files = list_tree(spark, root).where(basename(F.col("path")).rlike(r"^part-.*\.txt$"))
    lines = F.size(F.split("content", "\n", -1)) - 1
    return with_content(files, root).groupBy(dirname(F.col("path")).alias("folder")).agg(F.sum(lines).alias("n_lines"), F.sum("size").alias("size"))


@query("load_edges", """
SELECT DISTINCT a.p_partkey AS from_file_id, b.p_partkey AS to_file_id, 'load' AS edge_kind FROM part a JOIN part b ON a.p_partkey // 20 = b.p_partkey // 20 AND b.p_partkey % 2 = 0 AND a.p_partkey <> b.p_partkey""")
def load_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, folder = F.col("p_partkey"), F.concat(F.lit("/p/"), F.floor(F.col("p_partkey") / 20))
    rows = table(spark, sf_dir, "part")
    files = rows.select(k.alias("file_id"), F.concat(folder, F.lit("/f"), k, F.when(k % 2 == 0, ".js").otherwise(".css")).alias("path"))
    return facts.load_edges(rows.select(k.alias("file_id"), folder.alias("folder"), F.lit(".js").alias("suffix")), files)


@query("listener_clients", """
WITH a AS (SELECT s_suppkey AS f, s_nationkey AS p FROM supplier), b AS (SELECT c_custkey AS f, c_nationkey AS p FROM customer)
SELECT DISTINCT ':' || a.p AS locator, a.f AS listener_file, b.f AS client_file FROM a JOIN b USING (p) WHERE a.f <> b.f""")
def listener_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda c: F.concat(F.lit(":"), c).alias("locator")
    listeners = table(spark, sf_dir, "supplier").select(F.lit("port").alias("kind"), at("s_nationkey"), F.col("s_suppkey").alias("file_id"))
    clients = table(spark, sf_dir, "customer").select(F.lit("port").alias("kind"), at("c_nationkey"), F.col("c_custkey").alias("file_id"))
    return facts.shared_endpoints(listeners, clients)


@query("python_facts", """
WITH c AS (SELECT c_custkey AS k FROM customer)
SELECT k AS file_id, 'import' AS fact, 'mod_' || k AS name, 'import' AS kind, 1 AS line_start FROM c
UNION ALL SELECT k, 'module', 'C' || k, 'class', 2 FROM c UNION ALL SELECT k, 'method', 'm' || (k % 10), 'method', 3 FROM c
UNION ALL SELECT k, 'query', 'execute', 'sql', 4 FROM c UNION ALL SELECT k, 'module', 'f' || k, 'async_function', 5 FROM c""")
def python_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of small Python files built from customer keys."""
    source = "'import mod_' || c_custkey || chr(10) || 'class C' || c_custkey || ':' || chr(10) || '    def m' || (c_custkey % 10) || '(self):' || chr(10) || '        self.db.execute(\"SELECT ' || c_custkey || '\")' || chr(10) || 'async def f' || c_custkey || '(): pass'"
    files = table(spark, sf_dir, "customer").selectExpr("c_custkey AS file_id", "'python' AS language", f"{source} AS content")
    return extract.extract_facts(files).select("file_id", "fact", "name", "kind", "line_start")


#: Small sources by language ({k}: the file's key, {p}: a port), and the facts that they hold: fact, name, kind, first and last line.
_SOURCES = {
    "javascript": (
        "import x from './m{k}.js';\nexport class C{k} {\n  run{k}() {\n  }\n}\nfunction f{k}() {}\nconst db = new Database('d{k}.db');\ndb.exec('DELETE FROM t{k}');\napp.listen({p});\n",
        [("module", "C{k}", "class", 2, 5), ("method", "run{k}", "method", 3, 4), ("module", "f{k}", "function", 6, 6), ("import", "./m{k}.js", "import", 1, 1), ("listener", "{p}", "port", 9, 9), ("database", "d{k}.db", "sqlite", 7, 7), ("query", "exec", "sql", 8, 8)],
    ),
    "typescript": (
        'import y from "./n{k}";\ninterface I{k} {\n}\nconst g{k} = (a) => {\n};\n',
        [("module", "I{k}", "interface", 2, 3), ("module", "g{k}", "arrow_function", 4, 5), ("import", "./n{k}", "import", 1, 1)],
    ),
    "go": (
        'package main\nimport "fmt{k}"\ntype T{k} struct {\n}\nfunc (t *T{k}) Run() {\n}\nfunc F{k}() {\n}\n',
        [("module", "T{k}", "struct", 3, 4), ("module", "(*T{k}).Run", "method", 5, 6), ("module", "F{k}", "function", 7, 8), ("import", "fmt{k}", "import", 2, 2)],
    ),
    "java": (
        'import java.util.L{k};\npublic class A{k} {\n  public void run{k}() {\n  }\n}\n',
        [("module", "A{k}", "class", 2, 5), ("module", "A{k}.run{k}", "method", 3, 4), ("import", "java.util.L{k}", "import", 1, 1)],
    ),
    "rust": (
        'use std::m{k};\npub struct S{k} {\n}\nimpl S{k} {\n    pub fn go{k}(&self) {\n    }\n}\nfn main{k}() {\n}\n',
        [("module", "S{k}", "struct", 2, 3), ("module", "impl S{k}", "impl", 4, 7), ("module", "S{k}::go{k}", "method", 5, 6), ("module", "main{k}", "function", 8, 9), ("import", "std::m{k}", "import", 1, 1)],
    ),
    "c": (
        '#include <h{k}.h>\nstruct s{k} {\n  int a;\n};\nint f{k}(int a) {\n  return a;\n}\n',
        [("module", "s{k}", "struct", 2, 4), ("module", "f{k}", "function", 5, 7), ("import", "h{k}.h", "import", 1, 1)],
    ),
    "cpp": (
        '#include <h{k}>\nnamespace n{k} {\nclass A{k} {\npublic:\n  int m{k}();\n};\n}\n',
        [("module", "n{k}", "namespace", 2, 7), ("module", "n{k}::A{k}", "class", 3, 6), ("module", "n{k}::A{k}::m{k}", "method", 5, 5), ("import", "h{k}", "import", 1, 1)],
    ),
    "csharp": (
        'using System.X{k};\npublic class A{k} {\n  public int M{k}(int a) {\n    return a;\n  }\n}\n',
        [("module", "A{k}", "class", 2, 6), ("module", "A{k}.M{k}", "method", 3, 5), ("import", "System.X{k}", "import", 1, 1)],
    ),
    "kotlin": (
        'import a.b{k}\nclass A{k} {\n  fun m{k}() {\n  }\n}\nfun top{k}() {\n}\n',
        [("module", "A{k}", "class", 2, 5), ("module", "A{k}.m{k}", "method", 3, 4), ("module", "top{k}", "function", 6, 7), ("import", "a.b{k}", "import", 1, 1)],
    ),
    "swift": (
        'import F{k}\nclass A{k} {\n  func m{k}() {\n  }\n}\n',
        [("module", "A{k}", "class", 2, 5), ("module", "A{k}.m{k}", "method", 3, 4), ("import", "F{k}", "import", 1, 1)],
    ),
    "php": (
        '<?php\nuse A\\B{k};\nclass C{k} {\n  public function m{k}() {\n  }\n}\n',
        [("module", "C{k}", "class", 3, 6), ("module", "C{k}::m{k}", "method", 4, 5), ('import', 'A\\B{k}', 'import', 2, 2)],
    ),
    "nginx": (
        'upstream u{k} {\n  server 10.0.0.1:{p};\n}\nserver {\n  listen {p};\n  location /a{k} {\n    proxy_pass http://u{k};\n  }\n}\n',
        [("module", "u{k}", "upstream", 1, 3), ("endpoint", "10.0.0.1:{p}", "server", 2, 2), ("module", "server", "server", 4, 9), ("endpoint", "0.0.0.0:{p}", "port", 5, 5), ("endpoint", "u{k}", "server", 7, 7)],
    ),
}


@query("code_facts", f"""
WITH e AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{fact}', '{name}', '{kind}', {a}, {b})" for i, (_, found) in enumerate(_SOURCES.values()) for fact, name, kind, a, b in found)}) t(i, fact, name, kind, a, b))
SELECT c_custkey AS file_id, fact, replace(replace(name, '{{k}}', CAST(c_custkey AS VARCHAR)), '{{p}}', CAST(3000 + c_custkey % 1000 AS VARCHAR)) AS name, kind, a AS line_start, b AS line_end FROM customer JOIN e ON c_custkey % {len(_SOURCES)} = i""")
def code_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of small sources in every language that scanners read."""
    k = F.col("c_custkey")
    nth = (k % len(_SOURCES) + 1).cast("int")
    texts = F.element_at(F.array(*(F.lit(t) for t, _ in _SOURCES.values())), nth)
    content = F.replace(F.replace(texts, F.lit("{k}"), k.cast("string")), F.lit("{p}"), (3000 + k % 1000).cast("string"))
    files = table(spark, sf_dir, "customer").select(k.alias("file_id"), F.element_at(F.array(*map(F.lit, _SOURCES)), nth).alias("language"), content.alias("content"))
    return extract.extract_facts(files).select("file_id", "fact", "name", "kind", "line_start", "line_end")


@query("sql_objects", """
SELECT n_nationkey AS doc_id, 0 AS ord, 'table' AS kind, 't' || n_nationkey AS name FROM nation UNION ALL SELECT n_nationkey, 1, 'view', 'v_' || n_regionkey FROM nation""")
def sql_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS doc_id", "'CREATE TABLE IF NOT EXISTS t' || n_nationkey || ' (a INT); create or replace view \"v_' || n_regionkey || '\" as select 1' AS text")
    return facts.sql_objects(docs)


@query("statement_verbs", """
SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 'SELECT' WHEN 1 THEN 'INSERT' WHEN 2 THEN 'FROM' ELSE 'WITH' END AS verb,
  CASE l_linenumber % 4 WHEN 0 THEN 'read' WHEN 1 THEN 'write' WHEN 3 THEN 'read' ELSE CASE WHEN l_returnflag = 'R' THEN 'dynamic' END END AS class, l_linenumber % 4 IN (3) AS sniffed FROM lineitem""")
def statement_verbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("l_linenumber")
    sql = F.when(number % 4 == 0, "-- note\nselect 1").when(number % 4 == 1, "/* x */ INSERT INTO t").when(number % 4 == 2, "FROM_VAR").otherwise("  with a as (select 1) select 2")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.leading_verb(sql).alias("verb"), text.verb_class(sql, F.col("l_returnflag") == "R").alias("class"), text.looks_like_sql(sql).alias("sniffed"))


#: Commands, and what the guard makes of them.
_COMMANDS = (
    ("ls -la f", None), ("cat f", "read"), ("/bin/cat f", "read"), ("  tail -n 3 f | wc", "read"), ("sed -i s/a/b/ f", "edit"), ("awk 1 f", "edit"), ("echo x > f", "edit"), ("echo x >> f", None),
    ("python3 -c \"open(1)\"", "edit"), ("python3 run.py", None), ("node -e \"fs.readFile(1)\"", "edit"), ("bash run.sh", "edit"), ("bash -c \"head f\"", "read"), ("sh -c \"perl -e 1\"", "edit"), ("grep cat f", None), ("git log; cat f", None),
)


@query("command_guard", f"""
WITH c AS (SELECT * FROM (VALUES {", ".join(f"({i}, " + (f"'{outcome}'" if outcome else "NULL") + ")" for i, (_, outcome) in enumerate(_COMMANDS))}) t(i, refused))
SELECT o_orderkey, refused FROM orders JOIN c ON o_orderkey % {len(_COMMANDS)} = i""")
def command_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the guard makes of commands that orders stand for."""
    listed = F.array(*(F.lit(c) for c, _ in _COMMANDS))
    command = F.element_at(listed, (F.col("o_orderkey") % len(_COMMANDS) + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", facts.command_guard(command).alias("refused"))


@query("viewport_rule", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 300 + c_custkey % 1000 END AS width FROM customer")
def viewport_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    asked = F.when(k % 3 == 0, "99999x20").otherwise(F.concat(300 + k % 1000, F.lit("x900")))
    return table(spark, sf_dir, "customer").select("c_custkey", net.viewport(asked)["width"].alias("width"))


#: Headers, and the language that they show.
_HEADERS = (
    ("class A { public: };", "cpp"), ("int f(void); // class X {", "c"), ("bool ok = nullptr; constexpr int n = 1;", "c"), ("#ifdef __cplusplus\nnamespace n {\n#endif\nint f(void);", "c"), ("#ifndef __cplusplus\nint f(void);\n#else\nclass A { };\n#endif", "c"),
    ("#if 1\nnamespace n {\n#endif", "cpp"), ("#include <vector>", "cpp"), ("#include <stdint.h>", "c"), ("char *s = \"// template <\"; int virtual_x;", "c"), ("/* \" */ using T = int;", "cpp"), ("struct A { int x; };", "c"), ("struct A : B {", "cpp"),
)


@query("classified_files", f"""
WITH h AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{language}')" for i, (_, language) in enumerate(_HEADERS))}) t(i, shown))
SELECT c_custkey AS k, CASE c_custkey % 6 WHEN 0 THEN 'python' WHEN 1 THEN 'nginx' WHEN 4 THEN 'protobuf' WHEN 5 THEN NULL ELSE shown END AS language,
  CASE c_custkey % 6 WHEN 4 THEN 'coming_soon' WHEN 5 THEN 'unrecognized' ELSE 'supported' END AS category FROM customer JOIN h ON c_custkey % {len(_HEADERS)} = i WHERE c_custkey % 7 > 1""")
def classified_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files outside ignored folders, by suffix, folder and header text."""
    k = F.col("c_custkey")
    inside = F.element_at(F.array(*map(F.lit, ("a/node_modules/", "env9/lib/", "b.egg-info/", "vendor/x/", ".venv3/"))), (k % 5 + 1).cast("int"))
    folder = F.when(k % 7 == 0, inside).when(k % 6 == 1, "etc/conf.d/").otherwise("src/")
    suffix = F.when(k % 6 == 0, ".pyw").when(k % 6 == 1, "").when((k % 6).isin(2, 3), ".h").when(k % 6 == 4, ".proto").otherwise(".scala")
    name = F.when(k % 7 == 1, "yarn.lock").otherwise(F.concat(F.lit("f"), k, suffix))
    content = F.element_at(F.array(*(F.lit(c) for c, _ in _HEADERS)), (k % len(_HEADERS) + 1).cast("int"))
    rows = table(spark, sf_dir, "customer").select(k.alias("k"), F.concat(folder, name).alias("path"), content.alias("content"))
    marker = spark.sql("SELECT -1L AS k, 'env9/pyvenv.cfg' AS path, '' AS content")
    return facts.classify_files(facts.scanned_paths(rows.union(marker))).select("k", "language", "category")


@query("language_registry", """
SELECT * FROM (VALUES ('c', 'supported', '.c .h .m'), ('cpp', 'supported', '.cpp .cu .cuh .hip .hpp .metal .mm'), ('csharp', 'supported', '.cs'), ('go', 'supported', '.go'), ('java', 'supported', '.java'),
  ('javascript', 'supported', '.cjs .js .jsx .mjs'), ('kotlin', 'supported', '.kt .kts'), ('nginx', 'supported', '.conf .nginx'), ('php', 'supported', '.php'), ('python', 'supported', '.py .pyw'), ('ruby', 'supported', '.rb'),
  ('rust', 'supported', '.rs'), ('shell', 'supported', '.sh'), ('sql', 'supported', '.sql'), ('swift', 'supported', '.swift'), ('typescript', 'supported', '.ts .tsx'), ('lua', 'coming_soon', '.lua'), ('protobuf', 'coming_soon', '.proto'),
  ('css', 'opaque_text', '.css'), ('html', 'opaque_text', '.html'), ('image', 'opaque_text', '.svg'), ('json', 'opaque_text', '.json'), ('markdown', 'opaque_text', '.md'), ('restructuredtext', 'opaque_text', '.rst'), ('text', 'opaque_text', '.txt'),
  ('toml', 'opaque_text', '.toml'), ('xml', 'opaque_text', '.xml'), ('yaml', 'opaque_text', '.yaml .yml'), ('document', 'opaque_binary', '.pdf'), ('image', 'opaque_binary', '.gif .jpeg .jpg .png .webp'), ('java_archive', 'opaque_binary', '.jar'),
  ('java_bytecode', 'opaque_binary', '.class'), ('object_file', 'opaque_binary', '.o'), ('python_bytecode', 'opaque_binary', '.pyc'), ('python_extension', 'opaque_binary', '.pyd'), ('shared_library', 'opaque_binary', '.dll .dylib .so'),
  ('sqlite_db', 'opaque_binary', '.db .sqlite .sqlite3'), ('static_library', 'opaque_binary', '.a'), ('webassembly', 'opaque_binary', '.wasm')) t(language, category, suffixes)""")
def language_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.language_registry(spark)


#: Segments of the small files below, by their offsets: (ord, depth, parent's ord, address, kind, name, head, from, to, first line, last line).
_UNIT = """
WITH f AS (SELECT s_suppkey AS k, '/etc/systemd/' || s_suppkey || '.service' AS path, '# unit ' || s_suppkey AS note, 'Name=' || s_name AS one, 'Exec=/bin/x ' || s_nationkey AS two FROM supplier),
o AS (SELECT *, length(note) + 1 + 7 AS n0, length(note) + 1 + 7 + length(one) AS n1 FROM f),
p AS (SELECT *, n1 + 2 AS s0, n1 + 2 + 10 AS e0, n1 + 2 + 10 + length(two) AS e1 FROM o),
r AS (
  SELECT k, path, 0 AS ord, 0 AS depth, NULL AS up, '1' AS address, 'section' AS kind, '[Unit]' AS name, note AS head, 0 AS a, n1 AS b, 1 AS first, 3 AS last FROM p
  UNION ALL SELECT k, path, 1, 1, 0, NULL, 'gap', '(gap)', note, 0, n0, 1, 2 FROM p
  UNION ALL SELECT k, path, 2, 1, 0, '1.1', 'entry', 'Name', one, n0, n1, 3, 3 FROM p
  UNION ALL SELECT k, path, 3, 0, NULL, NULL, 'whitespace', '(blank)', '', n1, s0, 3, 4 FROM p
  UNION ALL SELECT k, path, 4, 0, NULL, '2', 'section', '[Service]', '[Service]', s0, e1, 5, 6 FROM p
  UNION ALL SELECT k, path, 5, 1, 4, NULL, 'gap', '(gap)', '[Service]', s0, e0, 5, 5 FROM p
  UNION ALL SELECT k, path, 6, 1, 4, '2.1', 'entry', 'Exec', two, e0, e1, 6, 6 FROM p
  UNION ALL SELECT k, path, 7, 0, NULL, NULL, 'whitespace', '(blank)', '', e1, e1 + 1, 6, 6 FROM p
),
t AS (SELECT *, sha1(path || chr(0) || chr(0) || kind || chr(0) || name || chr(0) || head || chr(0) || CASE ord WHEN 7 THEN '2' ELSE '1' END)[:12] AS own FROM r WHERE up IS NULL),
u AS (SELECT t.k, t.ord, t.own, NULL AS parent FROM t UNION ALL SELECT r.k, r.ord, sha1(r.path || chr(0) || t.own || chr(0) || r.kind || chr(0) || r.name || chr(0) || r.head || chr(0) || '1')[:12], t.own FROM r JOIN t ON r.k = t.k AND r.up = t.ord)
SELECT k AS doc_id, own AS seg_id, parent AS parent_id, ord, depth, address, kind, name, a AS start_char, b AS end_char, first AS start_line, last AS end_line FROM r JOIN u USING (k, ord)"""


@query("config_segments", _UNIT)
def config_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of small configuration files built from supplier keys."""
    ini = "'# unit ' || s_suppkey || chr(10) || '[Unit]' || chr(10) || 'Name=' || s_name || chr(10) || chr(10) || '[Service]' || chr(10) || 'Exec=/bin/x ' || s_nationkey || chr(10)"
    files = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS doc_id", "'/etc/systemd/' || s_suppkey || '.service' AS path", "CAST(NULL AS STRING) AS language", f"{ini} AS content")
    return segments.file_segments(files)
