"""The graph of files, imports, databases and endpoints: connections, topology, traces, merges.

Tables (see the schemas in FIXTURES.md): files(file_id, project_id, address, name, ...), imports(import_id,
file_id, import_path, resolved_file_id, is_external, line), db_connections(file_id, database_id, line),
file_refs(file_id, ref_id, line), refs(ref_id, kind, name, locator), queries(file_id, database_id, sql, is_dynamic).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions.text import verb_class
from loomstone.operators.relational import running
from loomstone.sources.scratch import cut, discard, sweep


def outgoing_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Every import with the address and name of the file that it resolves to, if any."""
    target = files.select(F.col("file_id").alias("resolved_file_id"), F.col("address").alias("to_address"), F.col("name").alias("to_name"))
    return imports.join(target, "resolved_file_id", "left").select("file_id", "import_path", "line", "is_external", "resolved_file_id", "to_address", "to_name")


def incoming_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Importers of every file."""
    source = files.select("file_id", F.col("address").alias("from_address"), F.col("name").alias("from_name"))
    return imports.where("resolved_file_id IS NOT NULL").join(source, "file_id").select(F.col("resolved_file_id").alias("to_file_id"), F.col("file_id").alias("from_file_id"), "from_address", "from_name", "line")


def query_direction(queries: DataFrame, *keys: str) -> DataFrame:
    """Counts of reading, writing and dynamic queries by ``keys``, and the data direction that they show."""
    kind = verb_class(F.col("sql"), F.col("is_dynamic"))
    count = lambda k: F.count_if(kind == k).alias(f"n_{k}")
    counted = queries.groupBy(*keys).agg(count("read"), count("write"), count("dynamic"), F.count("*").alias("n_queries"))
    direction = F.when((F.col("n_read") > 0) & (F.col("n_write") > 0), "both").when(F.col("n_read") > 0, "in").when(F.col("n_write") > 0, "out").when(F.col("n_dynamic") > 0, "dynamic").otherwise("unknown")
    return counted.withColumn("direction", direction)


def file_databases(connections: DataFrame, databases: DataFrame, queries: DataFrame) -> DataFrame:
    """Databases of every file with the direction of its queries; ``unknown`` without queries."""
    known = query_direction(queries, "file_id", "database_id")
    joined = connections.join(databases, "database_id").join(known, ["file_id", "database_id"], "left")
    zero = {c: 0 for c in ("n_read", "n_write", "n_dynamic", "n_queries")}
    return joined.fillna(zero).fillna({"direction": "unknown"})


def file_endpoints(file_refs: DataFrame, refs: DataFrame) -> DataFrame:
    return file_refs.join(refs, "ref_id").select("file_id", "kind", "name", "locator", "line")


def entry_files(files: DataFrame, imports: DataFrame) -> DataFrame:
    """Readable files that no import resolves to (an import of itself counts as one)."""
    hit = imports.where("resolved_file_id IS NOT NULL").select(F.col("resolved_file_id").alias("file_id"))
    return files.where("is_readable_text").join(hit, "file_id", "left_anti")


def missing_imports(imports: DataFrame) -> DataFrame:
    """Imports of the project itself that no file answers."""
    return imports.where(~F.col("is_external") & F.col("resolved_file_id").isNull())


def first_edges(edges: DataFrame, *order: str) -> DataFrame:
    """One edge for each (from_id, to_id, kind): the first in ``order``."""
    rest = [c for c in edges.columns if c not in ("from_id", "to_id", "kind")]
    if not rest:
        return edges.distinct()
    return edges.groupBy("from_id", "to_id", "kind").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("first")).select("from_id", "to_id", "kind", "first.*")


def topology_edges(files: DataFrame, imports: DataFrame, connections: DataFrame, databases: DataFrame, file_refs: DataFrame, refs: DataFrame) -> DataFrame:
    """Distinct typed edges (from_id, to_id, kind, line): imports, endpoints and databases."""
    own = files.select("file_id", F.col("address").alias("from_id"))
    target = files.select(F.col("file_id").alias("resolved_file_id"), F.col("address").alias("to_id"))
    inner = imports.where("NOT is_external").join(own, "file_id").join(target, "resolved_file_id").select("from_id", "to_id", F.lit("imports").alias("kind"), "line")
    ext = file_endpoints(file_refs, refs).join(own, "file_id").select("from_id", F.concat_ws(":", "kind", "locator").alias("to_id"), F.lit("external_ref").alias("kind"), "line")
    db = connections.join(databases, "database_id").join(own, "file_id").select("from_id", F.coalesce("address", F.concat(F.lit("db:"), "name")).alias("to_id"), F.lit("db_connection").alias("kind"), "line")
    return first_edges(inner.union(ext).union(db), "line")


def topology_nodes(files: DataFrame, imports: DataFrame, databases: DataFrame, refs: DataFrame) -> DataFrame:
    """Entry files, databases, and one node for each endpoint kind and locator."""
    entry = entry_files(files, imports).select(F.col("address").alias("id"), F.lit("file").alias("kind"), "name")
    db = databases.select(F.coalesce("address", F.concat(F.lit("db:"), "name")).alias("id"), F.lit("database").alias("kind"), "name")
    ext = refs.groupBy(F.concat_ws(":", "kind", "locator").alias("id")).agg(F.min("name").alias("name")).select("id", F.lit("external").alias("kind"), "name")
    return entry.union(db).union(ext)


def trace(files: DataFrame, imports: DataFrame, starts: DataFrame, max_hops: int = 25) -> DataFrame:
    """Breadth-first trace from each start: one row for every edge that it meets, and for every leaf.

    Rows: start_id, hop, from_id, to_id, import_path, line, terminus (follow, cycle, external, unresolved, leaf), edge_path. A
    file is followed once for each start, by the first of its edges in queue order; any other edge to a known file is a
    ``cycle``. The queue order inside a hop is the order of paths (arrays of line and edge number), so no hop needs a
    global sort: the first edge to a file is the one of the least path. Files at ``max_hops`` are reached but not read.

    How far each file lies from each start is found for all starts together (``reach``); only edges one hop farther then
    compete for the least path, and all edges are judged at once at the end.
    """
    edges = imports.select(F.col("file_id").alias("from_id"), "import_id", "import_path", "line", "is_external", "resolved_file_id")
    inner = edges.where("NOT is_external AND resolved_file_id IS NOT NULL")
    far = cut(reach(inner.select(F.col("from_id").alias("src"), F.col("resolved_file_id").alias("dst")).distinct(), starts, max_hops), "trace-far")
    step = lambda path: F.concat(path, F.array(F.col("line").cast("long"), F.col("import_id").cast("long")))
    level = cut(far.where("depth = 0").select("start_id", "node", "depth", F.array().cast("array<long>").alias("path")), "trace")
    written, paths = [level], level
    for depth in range(1, (far.agg(F.max("depth")).first()[0] or 0) + 1):
        wanted = far.where(F.col("depth") == depth).select("start_id", F.col("node").alias("resolved_file_id"), "depth")
        tried = level.select("start_id", F.col("node").alias("from_id"), "path").join(inner, "from_id").select("start_id", "resolved_file_id", step(F.col("path")).alias("path"))
        level = tried.join(wanted, ["start_id", "resolved_file_id"]).groupBy("start_id", F.col("resolved_file_id").alias("node"), "depth").agg(F.min("path").alias("path"))
        level = cut(level, "trace")
        written.append(level)
        paths = paths.union(level)
    read = paths.where(F.col("depth") < max_hops).select("start_id", (F.col("depth") + 1).alias("hop"), F.col("node").alias("from_id"), "path")
    first = paths.select("start_id", F.col("node").alias("resolved_file_id"), F.col("path").alias("first"))
    met = read.join(edges, "from_id", "left").withColumn("next", F.when(F.col("import_id").isNotNull(), step(F.col("path")))).join(first, ["start_id", "resolved_file_id"], "left")
    terminus = (
        F.when(F.col("import_id").isNull(), "leaf").when(F.col("is_external"), "external").when(F.col("resolved_file_id").isNull(), "unresolved")
        .when(F.col("next") == F.col("first"), "follow").otherwise("cycle")
    )
    found = met.select("start_id", "hop", "from_id", F.col("resolved_file_id").alias("to_id"), "import_path", "line", terminus.alias("terminus"), F.filter("next", lambda x, i: i % 2 == 1).alias("edge_path"))
    out = cut(found, "trace-edges")
    discard(far, *written)
    return out


def routes(found: DataFrame) -> DataFrame:
    """The ends of a trace's routes, fewest hops first: start_id, hops, terminus, to_id, import_path, edge_path."""
    ends = found.where("terminus <> 'follow'").withColumnRenamed("hop", "hops")
    return ends.select("start_id", "hops", "terminus", "to_id", "import_path", "edge_path").orderBy("start_id", "hops", "edge_path")


#: Starts whose steps are taken together: the bits of a number.
TOGETHER = 64
#: Sets of starts that a crawl takes at a time (all of them need disk as the square of the files), and names of starts that are broadcast.
SETS, FEW_STARTS = 8, 1 << 18
#: Files with more links than this are hubs, up to TOGETHER of them; pairs of kinds of files that are broadcast; starts in a row.
HUB_LINKS, FEW_KINDS, IN_ROW = 32, 1 << 18, 1024


def _levels(edges: DataFrame, starts: DataFrame, max_depth: int, sets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes within ``max_depth`` links (edges: src, dst) of sets of starts: (node, group, levels), and the starts' numbers (start_id, n).

    starts: start_id, and node where a start is not its own node or has several. Starts are numbered and dealt into sets of
    TOGETHER, one bit each. A row is a node and a set, with the bits that reached it at each depth, so starts that
    meet take their further steps as one row; the bits of a node's edges are joined (``bit_or``) before they are
    shuffled, which also holds for the edges into a hub. Each hop rewrites the one table of rows.

    With ``sets``, so many sets go all their steps before the next ones start, so only their rows are rewritten and shuffled at a
    time. What stays of the others is sorted by its bits: files that are as far from the same starts take hardly any room. Where
    these sets left rows for few of the nodes, up to eight times as many go next, as long as about as many rows are expected
    as ``sets`` that reach all nodes have.
    """
    starts = starts.where("start_id IS NOT NULL")
    edges = cut(edges.select("src", "dst"), "reach-edges")
    seeds = starts.select("start_id", F.col("node") if "node" in starts.columns else F.col("start_id").alias("node"))
    numbered = cut(running(seeds.select("start_id").distinct(), ["start_id"]).select("start_id", (F.col("place") - 1).alias("n")), "reach-starts")
    bit = F.expr(f"shiftleft(1L, CAST(n % {TOGETHER} AS INT))")
    group = F.floor(F.col("n") / TOGETHER).alias("group")
    if sets:
        spark, done, low, wide, n = edges.sparkSession, [], 0, sets, numbered.count()
        most = sets * edges.select("src").distinct().count() if n > sets * TOGETHER else 0
        while low < n:
            own = numbered.where(F.col("n").between(low, low + wide * TOGETHER - 1))
            first = seeds.join(own, "start_id").groupBy("node", group).agg(F.bit_or(bit).alias("known"))
            done.append(_walk(edges, first, max_depth, compact=True))
            sweep(spark)
            low += wide * TOGETHER
            if low < n:
                wide = max(sets, min(8 * wide, wide * most // max(done[-1].count(), 1)))
        if done:
            return spark.read.schema(done[0].schema).parquet(*(t._scratch_path for t in done)), numbered
    first = seeds.join(numbered, "start_id").groupBy("node", group).agg(F.bit_or(bit).alias("known"))
    return _walk(edges, first, max_depth).select("node", "group", "levels"), numbered


def _walk(edges: DataFrame, first: DataFrame, max_depth: int, compact: bool = False) -> DataFrame:
    """The steps of ``_levels`` from rows (node, group, known); ``compact``: at last only node, group and levels, sorted."""
    none = F.lit(0).cast("long")
    at = lambda depth, bits: F.array(F.struct(F.lit(depth).alias("depth"), bits.alias("bits")))
    final = lambda rows: cut(rows.select("node", "group", "levels").sortWithinPartitions("group", "levels", "node"), "reached", compression="zstd")
    state = cut(first.select("node", "group", "known", F.col("known").alias("fresh"), at(0, F.col("known")).alias("levels")), "reach")
    for depth in range(1, max_depth + 1):
        ahead = state.where("fresh <> 0").select(F.col("node").alias("src"), "group", "fresh").join(edges, "src").select(F.col("dst").alias("node"), "group", none.alias("known"), F.lit(None).alias("levels"), F.col("fresh").alias("bits"))
        # One shuffle: what is known of a node and what comes to it are summed together.
        both = state.select("node", "group", "known", "levels", none.alias("bits")).union(ahead)
        joined = both.groupBy("node", "group").agg(F.bit_or("known").alias("known"), F.coalesce(F.max("levels"), F.filter(at(0, none), lambda x: F.lit(False))).alias("levels"), F.bit_or("bits").alias("bits"))
        joined = joined.withColumn("fresh", F.col("bits").bitwiseAND(F.bitwise_not("known")))
        grown = F.when(F.col("fresh") != 0, F.concat("levels", at(depth, F.col("fresh")))).otherwise(F.col("levels"))
        rows = joined.select("node", "group", F.col("known").bitwiseOR(F.col("fresh")).alias("known"), "fresh", grown.alias("levels"))
        last = compact and depth == max_depth
        after = final(rows) if last else cut(rows, "reach")
        discard(state)
        state = after
        if last:
            return state
        if state.where("fresh <> 0").isEmpty():
            break
    if compact:
        whole = state
        state = final(whole)
        discard(whole)
    return state


def reach(edges: DataFrame, starts: DataFrame, max_depth: int, sets: int | None = None) -> DataFrame:
    """start_id, node, depth of every node within ``max_depth`` links (edges: src, dst); its least depth.

    starts: start_id, and node where a start is not its own node or has several; ``sets``: of starts at a time; see ``_levels``.
    """
    state, numbered = _levels(edges, starts, max_depth, sets)
    names = numbered.groupBy(F.floor(F.col("n") / TOGETHER).alias("group")).agg(F.array_sort(F.collect_list(F.struct("n", "start_id"))).alias("names"))  # TOGETHER at most
    if sets and numbered.count() <= FEW_STARTS:
        names = F.broadcast(names)  # else all rows are shuffled to the names of their set
    rows = state.join(names, "group").select("node", "names", F.inline("levels"))
    members = F.filter("names", lambda x, i: F.expr("bits").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) != 0)
    return rows.select("node", "depth", F.explode(members).alias("member")).select(F.col("member.start_id").alias("start_id"), "node", "depth")


#: What ``trace_counts`` sums over the nodes at a depth.
_SUMMED = ("external", "unresolved", "leaf", "resolved", "nodes")


def _sums_of_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(n, depth, sums) of the starts whose bits are set, for rows (group, depth, bits, values to be summed) by group and depth."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
        group, depth = at("group"), at("depth")
        new = np.concatenate([[0], np.flatnonzero((np.diff(group) != 0) | (np.diff(depth) != 0)) + 1])
        bits = np.unpackbits(np.ascontiguousarray(at("bits")).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int64)
        sums = [np.add.reduceat(bits * at(c)[:, None], new, axis=0).ravel() for c in _SUMMED]
        n, hop = (group[new][:, None] * TOGETHER + np.arange(TOGETHER)).ravel(), np.repeat(depth[new], TOGETHER)
        met = sums[-1] > 0
        yield pa.record_batch([pa.array(x[met]) for x in (n, hop, *sums)], names=["n", "depth", *_SUMMED])


def trace_counts(imports: DataFrame, starts: DataFrame, max_hops: int = 25) -> DataFrame:
    """start_id, hop, terminus, n: how many edges (and leaves) of each kind ``trace`` meets at each hop, without its paths.

    Which of the edges to a file is the one followed depends on paths, how many are does not: one for each file reached. So the depths
    of ``_levels`` tell all counts: each set of starts is summed bit by bit, and no row is made for a start and a file.
    """
    resolved = F.col("resolved_file_id").isNotNull()
    inner = imports.where(~F.col("is_external") & resolved).select(F.col("file_id").alias("src"), F.col("resolved_file_id").alias("dst")).distinct()
    state, numbered = _levels(inner, starts, max_hops)
    kinds = F.when(F.col("is_external"), "external").when(resolved, "resolved").otherwise("unresolved")
    count = lambda k: F.count_if(kinds == k).alias(k)
    known = imports.groupBy(F.col("file_id").alias("node")).agg(count("external"), count("unresolved"), count("resolved"))
    # Files at the last hop are reached but not read.
    read = (F.col("depth") < max_hops).cast("long")
    of = lambda c: (F.coalesce(F.col(c), F.lit(0)) * read).alias(c)
    leaf = (F.col("resolved").isNull().cast("long") * read).alias("leaf")
    rows = state.join(known, "node", "left").select("group", F.inline("levels"), "external", "unresolved", "resolved")
    rows = rows.select("group", "depth", "bits", of("external"), of("unresolved"), leaf, of("resolved"), F.lit(1).cast("long").alias("nodes"))
    dealt = rows.repartition("group").sortWithinPartitions("group", "depth")
    summed = dealt.mapInArrow(_sums_of_bits, f"n long, depth int, {', '.join(f'{c} long' for c in _SUMMED)}")
    kind = lambda hop, name, n: F.struct(hop.alias("hop"), F.lit(name).alias("terminus"), n.alias("n"))
    own, after = F.col("depth"), F.col("depth") + 1
    # A resolved edge is followed or a cycle.
    met = [kind(after, k, F.col(k)) for k in ("external", "unresolved", "leaf")] + [kind(own, "follow", F.when(own > 0, F.col("nodes"))), kind(after, "cycle", F.col("resolved")), kind(own, "cycle", F.when(own > 0, -F.col("nodes")))]
    counts = summed.select("n", F.inline(F.filter(F.array(*met), lambda x: x["n"] != 0)).alias("hop", "terminus", "edges")).groupBy("n", "hop", "terminus").agg(F.sum("edges").alias("edges"))
    return counts.where("edges > 0").join(numbered, "n").select("start_id", "hop", "terminus", F.col("edges").alias("n"))


def discover(imports: DataFrame, starts: DataFrame, max_depth: int = 5) -> DataFrame:
    """Files that a file's resolved imports lead to."""
    edges = imports.where("NOT is_external AND resolved_file_id IS NOT NULL").select(F.col("file_id").alias("src"), F.col("resolved_file_id").alias("dst")).distinct()
    return reach(edges, starts, max_depth)


def crawl(imports: DataFrame, starts: DataFrame, max_depth: int = 6) -> DataFrame:
    """Files linked to a file in either direction; starts: start_id, and node for the files of a start that is no file.

    More starts than SETS sets go by ``_crawl_by_hubs`` where it applies; all others, and all starts else, by ``reach``.
    """
    one = imports.where("resolved_file_id IS NOT NULL").select(F.col("file_id").alias("src"), F.col("resolved_file_id").alias("dst"))
    links = one.union(one.select("dst", "src")).distinct()
    found = None
    if starts.where("start_id IS NOT NULL").select("start_id").distinct().count() > SETS * TOGETHER:
        links = cut(links, "crawl-links")
        found = _crawl_by_hubs(links, starts, max_depth)
    return reach(links, starts, max_depth, SETS) if found is None else found


def _crawl_by_hubs(links: DataFrame, starts: DataFrame, max_depth: int) -> DataFrame | None:
    """``reach`` over links that lead both ways, by way of the files with most links; None where there are none, or they tell too little.

    A shortest path meets a hub, and then is as long as from the start to some hub and on from there, or meets none, and then
    lies in the graph without them. Files as far from each hub are of one kind, and so are starts: two kinds are one
    distance apart by hubs, told once. Only starts that are nearer without hubs are told one by one. Where the kinds are many,
    hubs save nothing.
    """
    degree = links.where("src IS NOT NULL").groupBy(F.col("src").alias("start_id")).count()
    hubs = cut(degree.where(F.col("count") > HUB_LINKS).orderBy(F.desc("count"), "start_id").limit(TOGETHER).select("start_id"), "hubs")
    if hubs.isEmpty():
        return None
    starts = starts.where("start_id IS NOT NULL")
    seeds = starts.select("start_id", F.col("node") if "node" in starts.columns else F.col("start_id").alias("node"))
    far = cut(reach(links, hubs, max_depth, 1).withColumnRenamed("start_id", "hub"), "hub-far")
    hubs_of = lambda rows, key: rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("hub", "depth"))).alias("hubs"))
    nodes = cut(hubs_of(far, "node"), "hub-nodes")
    own = cut(hubs_of(seeds.join(far, "node").groupBy("start_id", "hub").agg(F.min("depth").alias("depth")), "start_id"), "hub-starts")
    discard(far)
    node_kinds, start_kinds = (t.select("hubs").distinct() for t in (nodes, own))
    if node_kinds.count() * start_kinds.count() > FEW_KINDS:
        discard(nodes, own)
        return None
    kinds = cut(running(node_kinds.union(start_kinds).distinct(), ["hubs"]).select("hubs", F.col("place").alias("kind")), "hub-kinds")
    each = lambda rows, kind, depth: rows.join(kinds, "hubs").select(F.col("kind").alias(kind), F.inline("hubs").alias("hub", depth))
    apart = each(node_kinds, "kind", "there").join(each(start_kinds, "start_kind", "here"), "hub").groupBy("kind", "start_kind").agg(F.min(F.col("here") + F.col("there")).alias("by_hub"))
    apart = cut(apart.where(F.col("by_hub") <= max_depth), "hub-apart")
    kind_of = cut(nodes.join(kinds, "hubs").select("node", "kind"), "hub-kind-of")
    placed = cut(running(own.join(kinds, "hubs").select("start_id", F.col("kind").alias("start_kind")), ["start_kind", "start_id"]), "hub-placed")
    discard(nodes, own)

    hub = lambda end: F.broadcast(hubs.select(F.col("start_id").alias(end)))
    near = cut(reach(links.join(hub("src"), "src", "left_anti").join(hub("dst"), "dst", "left_anti"), starts, max_depth, SETS), "near")
    judged = near.join(placed, "start_id", "left").join(kind_of.withColumnRenamed("node", "own"), F.col("node").eqNullSafe(F.col("own")), "left").join(F.broadcast(apart), ["kind", "start_kind"], "left")
    nearer = cut(judged.where("by_hub IS NULL OR depth < by_hub").select("start_id", "node", "depth", "start_kind", "place", "by_hub"), "nearer")
    discard(near)

    spark, n = links.sparkSession, placed.count()
    # Tasks of some 30 million pairs at most.
    parts = max(spark.sparkContext.defaultParallelism, kind_of.count() * min(n, FEW_STARTS) >> 25)
    found = nearer.select("start_id", "node", "depth")
    for low in range(0, n, FEW_STARTS):
        within = F.col("place").between(low + 1, low + FEW_STARTS)
        names = placed.where(within).groupBy("start_kind", F.floor(F.col("place") / IN_ROW)).agg(F.collect_list("start_id").alias("ids"))
        other = nearer.where(within & F.col("by_hub").isNotNull()).groupBy("node", "start_kind").agg(F.collect_list("start_id").alias("ids"))
        other = other.groupBy(F.col("node").alias("own")).agg(F.map_from_entries(F.collect_list(F.struct("start_kind", "ids"))).alias("other"))
        rows = kind_of.join(other, F.col("node").eqNullSafe(F.col("own")), "left").repartition(parts, "node")
        rows = rows.join(F.broadcast(apart), "kind").join(F.broadcast(names.select("start_kind", "ids")), "start_kind")
        told = F.try_element_at("other", F.col("start_kind"))
        left = F.when(F.col("other").isNull() | told.isNull(), F.col("ids")).otherwise(F.array_except("ids", told))
        found = found.union(rows.select(F.explode(left).alias("start_id"), "node", F.col("by_hub").alias("depth")))
    return found


def place_files(files: DataFrame, roots: DataFrame, links: DataFrame) -> DataFrame:
    """How each file belongs to a project: existing, root_match (longest root), linked (one neighbour project), unknown.

    files: file_id, path, project_id or null; roots: project_id, root; links: file_id, other project_id.
    """
    matched = (
        files.select("file_id", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/")) - 1), lambda n: F.array_join(F.slice(F.split("path", "/"), 1, n), "/"))).alias("root"))
        .join(roots.select("root", F.col("project_id").alias("root_project")), "root")
        .groupBy("file_id")
        .agg(F.max_by("root_project", F.length("root")).alias("root_project"))
    )
    near = links.groupBy("file_id").agg(F.min("project_id").alias("near"), F.count_distinct("project_id").alias("n"))
    near = near.where("n = 1").select("file_id", F.col("near").alias("linked_project"))
    joined = files.join(matched, "file_id", "left").join(near, "file_id", "left")
    how = F.when(F.col("project_id").isNotNull(), "existing").when(F.col("root_project").isNotNull(), "root_match").when(F.col("linked_project").isNotNull(), "linked").otherwise("unknown")
    return joined.select("file_id", how.alias("placement"), F.coalesce("project_id", "root_project", "linked_project").alias("project_id"))


def name_unknown(placed: DataFrame, files: DataFrame, first: int = 1) -> DataFrame:
    """``placed`` with ``unknown_name``: unknown_N of each file without a project, numbered by path from ``first``."""
    lost = running(placed.where("placement = 'unknown'").select("file_id").join(files.select("file_id", "path"), "file_id"), ["path", "file_id"])
    names = lost.select("file_id", F.concat(F.lit("unknown_"), F.col("place") + (first - 1)).alias("unknown_name"))
    return placed.join(names, "file_id", "left")


def absorb_unknown(imports: DataFrame, placed: DataFrame, max_depth: int = 6) -> DataFrame:
    """Files of no project that a crawl from a project's files reaches, with the least such project: placed(file_id, project_id).

    The crawl starts from projects, each at all of its files at once.
    """
    owners = placed.where("project_id IS NOT NULL").select(F.col("project_id").alias("start_id"), F.col("file_id").alias("node"))
    lost = placed.where("project_id IS NULL").select(F.col("file_id").alias("node"))
    return crawl(imports, owners, max_depth).join(lost, "node").groupBy(F.col("node").alias("file_id")).agg(F.min("start_id").alias("project_id"))


def merge_project(files: DataFrame, projects: DataFrame, absorbed: int, into: int) -> tuple[DataFrame, DataFrame]:
    """Files re-pointed from one project to another, and the projects that still have files."""
    moved = files.withColumn("project_id", F.when(F.col("project_id") == absorbed, into).otherwise(F.col("project_id")))
    return moved, projects.join(moved.select("project_id").distinct(), "project_id", "left_semi")


def validation_walk(targets: DataFrame) -> DataFrame:
    """Targets of each file in order, up to and including the first failure; verified ones are skipped.

    targets: file_id, ord, verified, failed.
    """
    before = Window.partitionBy("file_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    live = targets.where("NOT verified")
    return live.withColumn("stopped", F.coalesce(F.max(F.col("failed").cast("int")).over(before), F.lit(0))).where("stopped = 0").drop("stopped")


def common_ancestor(paths: DataFrame, *keys: str) -> DataFrame:
    """Longest common leading directories of each group's paths (columns ``keys``, path)."""
    parts = paths.select(*keys, F.posexplode(F.split("path", "/")).alias("pos", "part"))
    total = paths.groupBy(*keys).agg(F.count("*").alias("total"), F.min(F.size(F.split("path", "/"))).alias("least"))
    same = parts.groupBy(*keys, "pos").agg(F.min("part").alias("part"), F.count_distinct("part").alias("kinds"), F.count("*").alias("n"))
    joined = same.join(total, list(keys)).withColumn("broken", (F.col("kinds") > 1) | (F.col("n") < F.col("total")) | (F.col("pos") >= F.col("least") - 1))
    stop = Window.partitionBy(*keys).orderBy("pos")
    kept = joined.withColumn("any_broken", F.max("broken").over(stop)).where("NOT any_broken")
    found = kept.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"]), "/").alias("ancestor"))
    return total.select(*keys).join(found, list(keys), "left").fillna({"ancestor": ""})
