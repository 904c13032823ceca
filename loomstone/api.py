"""The engine's entry points: scan a tree into tables, then ask about projects, files, pages and segments.

``scan`` gives a ``Catalog`` of DataFrames; its methods answer with DataFrames, too. What needs a browser,
a server, a compiler or a language model is not here.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstone.functions import net, text
from loomstone.operators import catalog, changes, extract, facts, graph, html, meaning, retrieval, segments
from loomstone.operators.relational import running
from loomstone.operators.textindex import LineIndex
from loomstone.sources.scratch import cut

EXTRACTOR_VERSION = "1"
MAX_RESPONSE_TOKENS = 4000
MAX_NODES, MAX_EDGES = 50, 100


@dataclass
class Catalog:
    """Tables of one scanned tree (see FIXTURES.md for their columns)."""

    spark: SparkSession
    files: DataFrame  # file_id, path, root, language, category, content, hash, address, name, line_count, est_tokens
    facts: DataFrame  # of operators.extract
    imports: DataFrame  # import_id, file_id, import_path, resolved_file_id, is_external, line
    databases: DataFrame  # database_id, file_id, name, type, address, handle, line
    queries: DataFrame  # query_id, file_id, database_id, sql, is_dynamic, line
    endpoints: DataFrame  # doc_id (file), kind, locator, line
    lines: LineIndex | None = None  # of ``index``
    candidates: DataFrame | None = None  # import_id, root, priority, path: what imports may mean, for ``refresh``

    # Structure.
    def languages(self) -> DataFrame:
        return facts.language_registry(self.spark)

    def file_list(self, language: str | None = None, most: int = 100) -> DataFrame:
        """Files by path, of one language or all: a list of at most ``most``."""
        rows = self.files if language is None else self.files.where(F.col("language") == language)
        return rows.select("path", "language", "category", "address", "line_count").orderBy("path").limit(most)

    def stats(self) -> DataFrame:
        return catalog.table_counts({"files": self.files, "facts": self.facts, "imports": self.imports, "databases": self.databases, "queries": self.queries, "endpoints": self.endpoints})

    def estimate(self) -> DataFrame:
        return catalog.scan_estimate(self.files)

    def structure(self, search: str | None = None) -> DataFrame:
        """Paths in tree order, with all folders that lead to a match of ``search``."""
        paths = self.files.select(F.explode(catalog.ancestors(F.col("path"))).alias("path")).distinct()
        if search:
            paths = catalog.with_ancestors(paths, F.lower("path").contains(search.lower()))
        parts = F.split("path", "/")
        known = self.files.select("path", F.lit(True).alias("is_file"), "address", "line_count")
        rows = paths.join(known, "path", "left")
        key = F.transform(parts, lambda p, i: F.struct((F.coalesce("is_file", F.lit(False)) & (i == F.size(parts) - 1)).alias("last"), p.alias("p")))
        return rows.select("path", F.col("is_file").isNotNull().alias("is_file"), "address", "line_count", key.alias("tree_key")).orderBy("tree_key")

    def overview(self) -> DataFrame:
        return catalog.folder_overview(self.files.withColumnRenamed("path", "rel_path"))

    # One file.
    def bones(self, suffix: str) -> DataFrame:
        """Imports and declarations of the file whose path ends with ``suffix``; LookupError where several do equally."""
        wanted = self.spark.createDataFrame([(suffix,)], "suffix string")
        hit = catalog.suffix_match(wanted, self.files.withColumnRenamed("path", "abs_path")).first()
        if hit.status == "ambiguous":
            raise LookupError(f"several files end with {suffix!r}")
        rows = self.facts.where((F.col("file_id") == F.lit(hit.file_id)) & F.col("fact").isin("import", "module", "method"))
        return rows.select("file_id", "fact", "name", "kind", "parent", "line_start", "line_end")

    def full_skeleton(self) -> DataFrame:
        """Every file's declarations below its address and path, in order of path and line."""
        declared = self.facts.where("fact IN ('module', 'method')").select("file_id", "kind", F.col("name").alias("declared"), "line_start", "line_end")
        rows = self.files.select("file_id", "path", "address", "language", "line_count").join(declared, "file_id", "left")
        return rows.select("path", "address", "language", "line_count", "kind", "declared", "line_start", "line_end").orderBy("path", "line_start")

    def connections(self, file_id: int) -> dict[str, DataFrame]:
        """Outgoing and incoming imports, databases with direction, endpoints of a file."""
        named = self.files.select("file_id", "address", "name")
        queries = self.queries.where("database_id IS NOT NULL")
        links = self.databases.select("file_id", "database_id", "line").distinct()
        return {
            "outgoing": graph.outgoing_imports(self.imports, named).where(F.col("file_id") == file_id),
            "incoming": graph.incoming_imports(self.imports, named).where(F.col("to_file_id") == file_id),
            "databases": graph.file_databases(links, self.databases.select("database_id", "address", "name").distinct(), queries).where(F.col("file_id") == file_id),
            "endpoints": self.endpoints.where(F.col("doc_id") == file_id),
        }

    def navigate(self, *coordinates: str) -> DataFrame:
        """The files or segments that dotted coordinates name, with their source where it fits a response.

        A coordinate that only leads to a folder is refused: IsADirectoryError names the files below it.
        """
        asked = self.spark.createDataFrame([(c,) for c in coordinates], "coordinate string")
        for c in coordinates:
            below = self.files.where(F.col("address").startswith(f"{c}."))
            if not self.files.where(F.col("address") == c).limit(1).count() and (inside := below.orderBy("path").limit(5).collect()):
                raise IsADirectoryError(f"{c} is a folder; files below it: " + ", ".join(f"{r.address} {r.path}" for r in inside))
        found = catalog.resolve_coordinate(asked, self.files).where("kind = 'file'")
        parts = self.segments().select(F.col("doc_id").alias("file_id"), F.col("address").alias("segment"), "start_char", "end_char", F.col("kind").alias("segment_kind"), F.col("name").alias("segment_name"))
        joined = found.join(parts, ["file_id", "segment"], "left").join(self.files.select("file_id", "path", "content"), "file_id")
        piece = F.when(F.col("start_char").isNotNull(), F.expr("substring(content, start_char + 1, end_char - start_char)")).when(F.col("segment").isNull(), F.col("content"))
        tokens = text.response_tokens(piece)
        return joined.select("path", "segment", "segment_kind", "segment_name", F.when(tokens <= MAX_RESPONSE_TOKENS, piece).alias("source"), tokens.alias("tokens"))

    def segments(self) -> DataFrame:
        rows = self.files.select(F.col("file_id").alias("doc_id"), "path", "language", "content")
        return segments.file_segments(rows)

    def index(self, path: str | None = None) -> LineIndex:
        """Index the files' lines: later searches read only what can match. ``path``: a folder to keep the index in."""
        self.lines = LineIndex.build(self.files.select(F.col("file_id").alias("doc_id"), F.col("content").alias("text")), path)
        return self.lines

    def search(self, what: str, most: int = 25) -> DataFrame:
        """Lines that contain ``what`` with the innermost segment that holds each; by the index if there is one."""
        docs = self.files.select(F.col("file_id").alias("doc_id"), F.col("content").alias("text"))
        lines = segments.matching_lines(docs, what) if self.lines is None else self.lines.matching_lines(what)
        hits = segments.limited(lines, ["doc_id"], ["line"], most)
        spans = self.segments().where("kind NOT IN ('whitespace', 'gap')").select("doc_id", F.col("address").alias("seg"), "depth", "start_line", "end_line")
        return hits.join(segments.deepest_segments(hits.select("doc_id", "line"), spans), ["doc_id", "line"], "left")

    # The graph.
    def missing(self) -> DataFrame:
        return graph.missing_imports(self.imports)

    def _starts(self, file_id: int) -> DataFrame:
        return self.spark.createDataFrame([(file_id,)], "start_id long")

    def ping(self, file_id: int, max_hops: int = 25) -> DataFrame:
        return graph.trace(self.files, self.imports, self._starts(file_id), max_hops)

    def routes(self, file_id: int, max_hops: int = 25) -> DataFrame:
        """Where the routes from a file end, fewest hops first."""
        return graph.routes(self.ping(file_id, max_hops))

    def discover(self, file_id: int, max_depth: int = 5) -> DataFrame:
        return graph.discover(self.imports, self._starts(file_id), max_depth)

    def register(self, file_id: int, max_depth: int = 5) -> tuple[DataFrame, DataFrame]:
        """Files that a file leads to, and their common folder: what a new project would hold, and its root."""
        found = self.discover(file_id, max_depth).select(F.col("node").alias("file_id")).join(self.files.select("file_id", "path"), "file_id")
        return found, graph.common_ancestor(found.select(F.lit(1).alias("grp"), "path"), "grp").select("ancestor")

    def crawl(self, file_id: int, max_depth: int = 6) -> DataFrame:
        return graph.crawl(self.imports, self._starts(file_id), max_depth)

    def topology(self, trim: bool = True) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges; trimmed to what a response holds if they are more."""
        named = self.files.select("file_id", "address", "name", F.col("content").isNotNull().alias("is_readable_text"))
        databases = self.databases.select("database_id", "address", "name").distinct()
        refs = self.endpoints.select(F.xxhash64("kind", "locator").alias("ref_id"), "kind", F.col("locator").alias("name"), "locator").distinct()
        file_refs = self.endpoints.select(F.col("doc_id").alias("file_id"), F.xxhash64("kind", "locator").alias("ref_id"), F.col("line").cast("int").alias("line"))
        nodes = graph.topology_nodes(named, self.imports, databases, refs)
        edges = graph.topology_edges(named, self.imports, self.databases.select("file_id", "database_id", "line"), databases, file_refs, refs)
        return (nodes.orderBy("kind", "id").limit(MAX_NODES), edges.orderBy("from_id", "to_id", "kind").limit(MAX_EDGES)) if trim else (nodes, edges)

    def data_flow(self, file_id: int | None = None) -> DataFrame:
        """Entry files from which an import, a database or an endpoint leads out; of one file, the edges and ends of its trace."""
        if file_id is not None:
            return self.ping(file_id)
        named = self.files.select("file_id", "address", "name", F.lit(True).alias("is_readable_text"))
        entry = graph.entry_files(named, self.imports)
        out = self.imports.select("file_id").union(self.databases.select("file_id")).union(self.endpoints.select(F.col("doc_id"))).distinct()
        return entry.join(out, "file_id", "left_semi").select("file_id", "address", "name")

    # Change.
    def refresh(self, tree: DataFrame) -> Catalog:
        """The catalog of a later tree, equal to a scan of it: only changed files are parsed, only imports that they may concern resolved."""
        stored = self.files.join(self.facts.where("fact = 'module'").groupBy("file_id").agg(F.count("*").alias("n_modules")), "file_id", "left").select("file_id", "hash", F.lit(EXTRACTOR_VERSION).alias("extractor_version"), F.coalesce("n_modules", F.lit(0)).alias("n_modules"))
        files = _file_rows(tree)
        gate = changes.parse_gate(files.select("file_id", "hash"), stored, EXTRACTOR_VERSION)
        fresh = extract.extract_facts(files.join(gate.where("NOT skip"), "file_id", "left_semi").select("file_id", "language", "content"))
        kept = self.facts.join(gate.where("skip"), "file_id", "left_semi")
        return _assemble(self.spark, files, kept.unionByName(fresh), self)

    def what_if(self, candidate: DataFrame) -> Catalog:
        """The catalog with unsaved contents: candidate(path, content) over the stored files; nothing is stored."""
        new = candidate.select("path", F.col("content").alias("unsaved"))
        tree = self.files.select("path", "content").join(new, "path", "full_outer").select("path", F.coalesce("unsaved", "content").alias("content"))
        return self.refresh(tree)


def _file_rows(tree: DataFrame) -> DataFrame:
    """Scanned, classified and addressed files of tree(path, content)."""
    rows = facts.classify_files(facts.scanned_paths(tree.select("path", "content"))).where("category <> 'unrecognized'")
    rows = rows.withColumn("file_id", F.xxhash64("path")).withColumn("root", F.lit("."))
    # Addresses: letters for every folder on the way, then for the file, in one sequence for each folder.
    own = F.col("content")
    folders = rows.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda n: F.array_join(F.slice(F.split("path", "/"), F.lit(1), n), "/"))).alias("entry")).distinct()
    entries = folders.join(rows.select(F.col("path").alias("entry"), (F.col("category") == "supported").alias("supported")), "entry", "left")
    parent = text.dirname(F.col("entry"))
    part = F.when(F.col("supported").isNull(), 0).when(F.col("supported"), 1).otherwise(2)
    letter = text.letters(F.row_number().over(Window.partitionBy("parent").orderBy("part", "entry")) - 1)
    lettered = entries.select("entry", parent.alias("parent"), part.alias("part")).withColumn("letter", letter).select("entry", "letter")
    steps = rows.select("file_id", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda n: F.array_join(F.slice(F.split("path", "/"), F.lit(1), n), "/"))).alias("n", "entry"))
    addresses = steps.join(lettered, "entry").groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "letter"))), lambda x: x["letter"]), ".").alias("address"))
    return rows.join(addresses, "file_id").select(
        "file_id", "path", "root", "language", "category", "content", F.sha2(own.cast("binary"), 256).alias("hash"), "address",
        text.basename(F.col("path")).alias("name"), text.line_count(own).alias("line_count"), text.file_tokens(own).alias("est_tokens"),
    )


def _assemble(spark: SparkSession, files: DataFrame, found: DataFrame, before: Catalog | None = None) -> Catalog:
    files, found = cut(files, "files"), cut(found, "facts")
    where = files.select("file_id", F.concat(F.lit("./"), "path").alias("file_path"), "root", "language")
    raw = found.where("fact = 'import'").select("file_id", F.col("name").alias("import_path"), F.col("line_start").alias("line")).withColumn("import_id", F.xxhash64("file_id", "import_path", "line")).dropDuplicates(["import_id"])
    asked = raw.join(where, "file_id")
    resolved, candidates = _resolve(asked, files, before)
    loads = found.where("fact = 'load'").join(files.select("file_id", text.dirname(F.col("path")).alias("here")), "file_id")
    folder = F.regexp_replace(F.regexp_replace("name", r"^.*?[\"'`]\.?/?", ""), r"[\"'`].*$", "")
    loads = loads.select("file_id", F.when(F.col("name").rlike(r"[\"'`]"), F.trim(F.concat_ws("/", F.when(F.col("here") != "", F.col("here")), F.when(folder != "", folder)))).otherwise(F.col("here")).alias("folder"), F.col("kind").alias("suffix"))
    load = facts.load_edges(loads, files.select("file_id", "path")).select(F.xxhash64("from_file_id", "to_file_id").alias("import_id"), F.col("from_file_id").alias("file_id"), F.lit("(load)").alias("import_path"), F.col("to_file_id").alias("resolved_file_id"), F.lit(False).alias("is_external"), F.lit(0).alias("line"))
    imports = cut(raw.join(resolved.select("import_id", "resolved_file_id", "is_external"), "import_id").select("import_id", "file_id", "import_path", "resolved_file_id", "is_external", "line").union(load), "imports")
    db = found.where("fact = 'database'").select(F.xxhash64("kind", "name").alias("database_id"), "file_id", "name", F.col("kind").alias("type"), F.col("receiver").alias("handle"), F.col("line_start").alias("line"))
    numbers = running(db.groupBy("database_id").agg(F.min("name").alias("n")), ["n", "database_id"]).select("database_id", F.concat(F.lit("99."), "place").alias("address"))
    databases = cut(db.join(numbers, "database_id"), "databases")
    asked = found.where("fact = 'query'").withColumn("query_id", F.xxhash64("file_id", "line_start", "detail", "name"))
    linked = facts.attribute_queries(asked.select("query_id", "file_id", "receiver"), databases)
    queries = asked.join(linked.select("query_id", "database_id").distinct(), "query_id").select("query_id", "file_id", "database_id", F.col("detail").alias("sql"), F.col("dynamic").alias("is_dynamic"), F.col("line_start").alias("line"))
    parsed = found.where("fact = 'endpoint'").select(F.col("file_id").alias("doc_id"), "kind", F.col("name").alias("locator"), F.col("line_start").cast("long").alias("line"))
    listeners = found.where("fact = 'listener'").select(F.col("file_id").alias("doc_id"), F.lit("port").alias("kind"), F.col("name").alias("locator"), F.col("line_start").cast("long").alias("line"))
    detected = facts.detect_endpoints(files.select(F.col("file_id").alias("doc_id"), F.col("content").alias("text"))).select("doc_id", "kind", "locator", "line")
    endpoints = cut(facts.merge_endpoints(parsed, listeners, detected), "endpoints")
    return Catalog(spark, files, found, imports, databases, queries, endpoints, candidates=candidates)


def _resolve(asked: DataFrame, files: DataFrame, before: Catalog | None = None) -> tuple[DataFrame, DataFrame]:
    """Imports of relative trees, resolved, with their stored candidates; paths are rooted at ``/`` for resolution.

    After an earlier catalog only new imports' candidates are found, and only imports that changed files may concern are resolved.
    """
    rooted = lambda rows: rows.select("file_id", F.concat(F.lit("/r/"), "path").alias("path"), F.lit("/r").alias("root"))
    imports = asked.select("import_id", F.concat(F.lit("/r/"), F.expr("substr(file_path, 3)")).alias("file_path"), F.lit("/r").alias("root"), "language", "import_path")
    if before is None or before.candidates is None:
        candidates = cut(facts.import_candidates(imports), "candidates")
        return facts.resolve_imports(imports, rooted(files), candidates), candidates
    # Languages of headers may change with their content, and with them the candidates: such imports count as new.
    same = before.files.select("file_id", "language").join(files.select("file_id", "language"), ["file_id", "language"]).select("file_id")
    known = before.imports.where("import_path <> '(load)'").join(same, "file_id", "left_semi").select("import_id", "import_path", "resolved_file_id", "is_external")
    old = before.candidates.join(imports.join(known, "import_id", "left_semi").select("import_id"), "import_id", "left_semi")
    new = facts.import_candidates(imports.join(known, "import_id", "left_anti"))
    candidates = cut(old.unionAll(new), "candidates")
    return facts.relink_imports(imports, known, candidates, rooted(before.files), rooted(files)), candidates


def scan(spark: SparkSession, tree: DataFrame) -> Catalog:
    """Parse tree(path, content), paths relative to its root, into a catalog: one extraction, then joins."""
    files = _file_rows(tree)
    return _assemble(spark, files, extract.extract_facts(files.select("file_id", "language", "content")))


def scan_folder(spark: SparkSession, path: str) -> Catalog:
    """``scan`` of a folder that tasks can open."""
    return scan(spark, facts.scan_tree(spark, path))


class Workspace:
    """Projects over one file table: lookups, lists, membership and what may be written.

    projects(project_id, name, root), files(file_id, abs_path, project_id or null). Tables go in and come out; nothing is stored.
    """

    def __init__(self, projects: DataFrame, files: DataFrame) -> None:
        self.spark, self.projects, self.files = projects.sparkSession, projects, files

    def project_for(self, paths: DataFrame) -> DataFrame:
        """paths(path) with the project of the file itself, else the one of the longest root above it."""
        exact = catalog.exact_project(paths.select("path").distinct(), self.files).withColumnRenamed("project_id", "own")
        above = catalog.longest_root(paths.select("path").distinct(), self.projects.select("project_id", "root"))
        found = exact.join(above, "path").select("path", F.coalesce("own", "project_id").alias("project_id"))
        return paths.select("path").join(found, "path", "left")

    def project_list(self, modules: DataFrame | None = None) -> DataFrame:
        """Every project with its files and declarations, and files without a project as ``unknown``."""
        none = self.files.where("false").select("file_id")
        return catalog.project_counts(self.projects, self.files, none if modules is None else modules)

    def target(self, what: str) -> DataFrame:
        """What a name or path means: a project by name or root, a file, a folder of known files, or nothing known (an unscanned path).

        Rows (kind, project_id, path); of several meanings the first in this order.
        """
        path = F.lit(what.rstrip("/") or "/")
        named = self.projects.where((F.col("name") == what) | (F.col("root") == path)).select(F.lit(0).alias("rank"), F.lit("project").alias("kind"), "project_id", F.col("root").alias("path"))
        file = self.files.where(F.col("abs_path") == path).select(F.lit(1), F.lit("file"), "project_id", "abs_path")
        inside = self.files.where(F.col("abs_path").startswith(F.concat(path, F.lit("/")))).select(F.lit(2), F.lit("folder"), "project_id", path).distinct()
        unknown = self.spark.range(1).select(F.lit(3), F.lit("unscanned"), F.lit(None).cast("long"), path)
        every = named.union(file).union(inside).union(unknown)
        return every.withColumn("first", F.min("rank").over(Window.partitionBy(F.lit(1)))).where("rank = first").select("kind", "project_id", "path")

    def membership(self, links: DataFrame) -> DataFrame:
        """How each file belongs to a project (existing, root_match, linked, unknown): links(file_id, project_id) of its neighbours."""
        return graph.place_files(self.files.withColumnRenamed("abs_path", "path"), self.projects.select("project_id", "root"), links)

    def associate(self, paths: DataFrame, project_id: int) -> DataFrame:
        """The file table with paths(path) in a project: known files move to it, others are added under new ids."""
        known = self.files.join(paths.select(F.col("path").alias("abs_path"), F.lit(True).alias("asked")).distinct(), "abs_path", "left")
        moved = known.select("file_id", "abs_path", F.when(F.col("asked"), F.lit(project_id)).otherwise(F.col("project_id")).cast("long").alias("project_id"))
        new = paths.select(F.col("path").alias("abs_path")).distinct().join(self.files.select("abs_path"), "abs_path", "left_anti")
        return moved.union(new.select(F.xxhash64("abs_path"), "abs_path", F.lit(project_id).cast("long")))

    def write_refusals(self, requests: DataFrame) -> DataFrame:
        """requests(path, project_id) of new files, with the reason against them, if any."""
        return catalog.creatable(requests, self.files, self.projects)

    @staticmethod
    def update_endpoints(stored: DataFrame, fresh: DataFrame) -> DataFrame:
        """The endpoint inventory after a scan: one row for each (kind, locator), the richer one."""
        return catalog.upsert_endpoints(stored, fresh)


class Editor:
    """Edits of segmented files as a log: files(path, segments array<struct<id, text>>), edits(path, edit_id, payload JSON).

    A call with a token and an action is an edit; the token holds as long as its file's hash does.
    """

    def __init__(self, files: DataFrame, edits: DataFrame) -> None:
        self.files, self.edits = files, edits

    def _content(self) -> DataFrame:
        text_ = F.array_join(F.transform("segments", lambda x: x["text"]), "\n")
        return self.files.select("path", text_.alias("content"), F.sha2(text_.cast("binary"), 256).alias("hash"))

    def tokens(self, locations: DataFrame) -> DataFrame:
        """The first call of an edit: locations(path, location) with the token that its second call must bring."""
        return locations.join(self._content(), "path").select("path", "location", changes.edit_token(F.col("location"), F.col("hash")).alias("token"))

    def stale(self, tokens: DataFrame) -> DataFrame:
        """tokens(token, path, location) whose file has another content by now."""
        return changes.stale_tokens(tokens, self.apply().select("path", F.sha2(F.col("content").cast("binary"), 256).alias("hash")))

    def apply(self) -> DataFrame:
        """Contents after the log, edits applied and refused, and whether undoing them all gives the start back."""
        return changes.replay_edits(self.files, self.edits)

    def undo(self, last: int = 1) -> Editor:
        """The editor without the last edits of each file."""
        nth = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("edit_id")))
        return Editor(self.files, self.edits.withColumn("nth", nth).where(F.col("nth") > last).drop("nth"))

    def diff(self) -> DataFrame:
        """Files that the log changes: path, lines before and after."""
        lines = lambda c: F.size(F.split(c, "\n", -1))
        both = self._content().withColumnRenamed("content", "before").join(self.apply().select("path", F.col("content").alias("after")), "path")
        return both.where("before <> after").select("path", lines("before").alias("lines_before"), lines("after").alias("lines_after"))

    def status(self) -> DataFrame:
        """committed or edited, and how many edits wait, of every file."""
        waiting = self.edits.groupBy("path").agg(F.count("*").alias("n_edits"))
        rows = self.files.select("path").join(waiting, "path", "left").fillna(0, ["n_edits"])
        return rows.select("path", F.when(F.col("n_edits") > 0, "edited").otherwise("committed").alias("status"), "n_edits")

    def commit(self) -> Editor:
        """The editor over the edited contents, one segment each, with an empty log."""
        whole = F.array(F.struct(F.lit("all").alias("id"), F.col("content").alias("text")))
        return Editor(self.apply().select("path", whole.alias("segments")), self.edits.where("false"))

    def discard(self) -> Editor:
        return Editor(self.files, self.edits.where("false"))

    @staticmethod
    def project_undo(changes_: DataFrame, most: int = 10) -> DataFrame:
        """Of a project's newest changes, those that can be taken back: up to the first whose file differs by now."""
        return changes.undo_until_conflict(changes_, most)


def router_status(served: DataFrame, at: int) -> DataFrame:
    """Requests and tokens that each backend holds at a time: served(served, tokens, seconds) of ``accounting.route_requests``."""
    parts = F.split("served", "@")
    rows = served.where("served <> '413'").select(parts[0].alias("backend"), parts[1].cast("long").alias("begun"), "tokens", "seconds")
    live = (F.col("begun") <= at) & (F.col("begun") + F.col("seconds") > at)
    return rows.groupBy("backend").agg(F.count_if(live).alias("active"), F.coalesce(F.sum(F.when(live, F.col("tokens"))), F.lit(0)).alias("tokens"))


class Pages:
    """Saved pages: elements, search, sections, skeletons and outlines; ``titles`` may name untitled elements.

    ``embed`` maps rows with a column text to the same rows with a column vector (a model's work, not done here).
    """

    def __init__(self, pages: DataFrame, titles: Callable[[DataFrame], DataFrame] | None = None, embed: Callable[[DataFrame], DataFrame] | None = None) -> None:
        found = html.page_elements(pages.where(F.coalesce(net.url_allowed(F.col("url")), F.lit(False))))
        self.elements = cut(retrieval.with_structure(titles(found) if titles else found), "elements")

        self.embed = embed

    def search(self, query: str) -> DataFrame:
        """Matches by the ladder of words; with an embedding also by meaning, on the rung between word and any word."""
        asked = self.elements.sparkSession.createDataFrame([(1, query)], "query_id int, query string")
        return retrieval.search_ladder(self.elements, asked, self._meaning(asked) if self.embed else None)

    def _meaning(self, asked: DataFrame) -> DataFrame:
        """Elements of each page whose vectors stand out for the query; long texts count by their best piece."""
        found = cut(self.embed(retrieval.embed_pieces(self.elements).select("page_id", "element_id", F.col("piece").alias("text"))), "vectors")
        wanted = self.embed(asked.select("query_id", F.col("query").alias("text"))).select("query_id", "vector")
        return meaning.meaning_matches(found.select("page_id", "element_id", "vector"), wanted)

    def read(self, element_id: str) -> DataFrame:
        return self.elements.where(F.col("element_id") == element_id).select("page_id", text.fold_blank_lines(F.col("text")).alias("text"))

    def skeleton(self, full: bool = False) -> DataFrame:
        """Skeletons; pages over the token limit give their outline, unless ``full``."""
        made = retrieval.skeletons(retrieval.skeleton_lines(self.elements))
        if full:
            return made.select("page_id", "skeleton", "tokens")
        brief = retrieval.outline(self.elements).groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n").alias("outline"))
        shown = F.when(F.col("tokens") > retrieval.TOKEN_LIMIT, F.col("outline")).otherwise(F.col("skeleton"))
        return made.join(brief, "page_id", "left").select("page_id", shown.alias("skeleton"), text.page_tokens(shown).alias("tokens"))
