"""The catalog of projects, folders and files: lookups, addresses, counts, estimates, merges into tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions.text import letters

#: Milliseconds that one file takes to scan, by category.
SCAN_MS = {"supported": 30, "coming_soon": 5, "opaque_text": 5, "opaque_binary": 2}
BUSY_FILES, HUGE_FILES = 1000, 5000


# Lookups.
def exact_project(paths: DataFrame, files: DataFrame) -> DataFrame:
    """paths(path) with the project of the file of just that path."""
    return paths.join(files.select(F.col("abs_path").alias("path"), "project_id"), "path", "left")


def ancestors(path):
    """All leading folders of a path, shortest first, the path itself last."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def longest_root(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """paths(path) with the project whose root (project_id, root) is the longest leading folder of it.

    Paths are exploded into their leading folders, so this is an equi-join, not one by prefix comparison.
    """
    held = paths.select("path", F.explode(ancestors(F.col("path"))).alias("root")).join(roots, "root")
    best = held.groupBy("path").agg(F.max_by("project_id", F.length("root")).alias("project_id"))
    return paths.join(best, "path", "left")


def overlapping_roots(roots: DataFrame) -> DataFrame:
    """Pairs (outer, inner) of roots of which one lies inside the other."""
    inside = roots.select(F.col("project_id").alias("inner_project"), F.col("root").alias("inner_root"), F.explode(ancestors(F.col("root"))).alias("root"))
    return inside.where("root <> inner_root").join(roots.withColumnRenamed("project_id", "outer_project"), "root").select("outer_project", "inner_project")


def suffix_match(suffixes: DataFrame, files: DataFrame) -> DataFrame:
    """suffixes(suffix) with the file that ends with it (whole path parts): longest path wins, a tie is ambiguous."""
    parts = F.split("abs_path", "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "/"))
    hits = files.select("file_id", F.length("abs_path").alias("n"), F.explode(tails).alias("suffix")).join(suffixes, "suffix")
    top = hits.withColumn("rank", F.rank().over(Window.partitionBy("suffix").orderBy(F.desc("n")))).where("rank = 1")
    found = top.groupBy("suffix").agg(F.count("*").alias("n"), F.min("file_id").alias("file_id"))
    status = F.when(F.col("n").isNull(), "none").when(F.col("n") > 1, "ambiguous").otherwise("found")
    return suffixes.join(found, "suffix", "left").select("suffix", status.alias("status"), F.when(F.col("n") == 1, F.col("file_id")).alias("file_id"))


def resolve_coordinate(coordinates: DataFrame, files: DataFrame) -> DataFrame:
    """coordinates(coordinate): the longest dotted prefix that is a file's address; the rest names a segment."""
    parts = F.split("coordinate", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    hit = coordinates.select("coordinate", F.explode(prefixes).alias("address")).join(files.select("address", "file_id"), "address")
    best = hit.groupBy("coordinate").agg(F.max_by(F.struct("file_id", "address"), F.length("address")).alias("best"))
    rest = F.substring(F.col("coordinate"), F.length("best.address") + 2, F.length("coordinate"))
    joined = coordinates.join(best, "coordinate", "left")
    return joined.select("coordinate", F.col("best.file_id").alias("file_id"), F.when(rest != "", rest).alias("segment"), F.when(F.col("best").isNull(), "folder").otherwise("file").alias("kind"))


#: Kinds of rows that an address may name, in the order of lookup.
ADDRESS_ORDER = ("database", "db_table", "directory", "file", "module", "method")


def address_lookup(addresses: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """addresses(address) with the first kind of row that has it; tables: kind -> (address, id)."""
    every = None
    for rank, kind in enumerate(ADDRESS_ORDER):
        if kind in tables:
            rows = tables[kind].select("address", F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), F.col("id").cast("long").alias("id")).alias("hit"))
            every = rows if every is None else every.union(rows)
    first = every.groupBy("address").agg(F.min("hit").alias("hit"))
    return addresses.join(first, "address", "left").select("address", "hit.kind", "hit.id")


def with_ancestors(paths: DataFrame, matched) -> DataFrame:
    """Paths for which ``matched`` holds, and all folders that lead to them."""
    hit = paths.where(matched).select(F.explode(ancestors(F.col("path"))).alias("path")).distinct()
    return paths.join(hit, "path", "left_semi")


# Addresses.
def assign_addresses(directories: DataFrame, files: DataFrame) -> DataFrame:
    """Letters for folders, then for files, in one sequence for each folder.

    directories(dir_id, parent_id, path, depth), files(file_id, dir_id, name, supported). Folders of a parent
    take letters by path, its files go on behind them, supported ones first, then by name. Rows (kind, id, parent_id, letter).
    """
    dirs = directories.where("parent_id IS NOT NULL").select(F.lit("directory").alias("kind"), F.col("dir_id").alias("id"), "parent_id", F.lit(0).alias("part"), F.lit(0).alias("late"), F.col("path").alias("key"))
    own = files.select(F.lit("file").alias("kind"), F.col("file_id").alias("id"), F.col("dir_id").alias("parent_id"), F.lit(1).alias("part"), F.when(F.col("supported"), 0).otherwise(1).alias("late"), F.col("name").alias("key"))
    place = F.row_number().over(Window.partitionBy("parent_id").orderBy("part", "late", "key", "id"))
    return dirs.union(own).select("kind", "id", "parent_id", letters(place - 1).alias("letter"))


def next_free(rows: DataFrame, index: str, *keys: str) -> DataFrame:
    """The next unused number of each group, and its letters."""
    return rows.groupBy(*keys).agg((F.max(index) + 1).alias("next")).withColumn("next_letters", letters(F.col("next")))


def unique_names(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """``unique_name``: repeated names get -2, -3, ... in ``order``."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(*order))
    return rows.withColumn("unique_name", F.when(n == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("-"), n)))


# Counts.
def project_counts(projects: DataFrame, files: DataFrame, modules: DataFrame) -> DataFrame:
    """Files and modules of every project, zero for none; files without a project count as ``unknown``."""
    per_file = modules.groupBy("file_id").agg(F.count("*").alias("m"))
    counts = files.join(per_file, "file_id", "left").groupBy("project_id").agg(F.count("*").alias("n_files"), F.coalesce(F.sum("m"), F.lit(0)).alias("n_modules"))
    known = projects.join(counts, "project_id", "left").select("project_id", "name", F.coalesce("n_files", F.lit(0)).alias("n_files"), F.coalesce("n_modules", F.lit(0)).alias("n_modules"))
    return known.union(counts.where("project_id IS NULL").select("project_id", F.lit("unknown"), "n_files", "n_modules"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table: (what, n)."""
    parts = [df.agg(F.lit(name).alias("what"), F.count("*").alias("n")) for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def scan_estimate(files: DataFrame) -> DataFrame:
    """For each language and category: files and estimated milliseconds."""
    ms = F.coalesce(*(F.when(F.col("category") == c, v) for c, v in SCAN_MS.items()), F.lit(0))
    return files.groupBy("language", "category").agg(F.count("*").alias("n_files"), F.sum(ms).cast("long").alias("est_ms"))


def scan_summary(files: DataFrame) -> DataFrame:
    """Counters of one scan: files by parse status (parsed, skipped, failed), and those that are absent."""
    n = lambda s: F.count_if(F.col("parse_status") == s).alias(s)
    return files.agg(F.count("*").alias("files"), n("parsed"), n("skipped"), n("failed"), F.count_if(~F.col("present")).alias("absent"))


def scan_warning(n):
    """none, busy (1,000 files or more) or huge (5,000 or more)."""
    return F.when(n >= HUGE_FILES, "huge").when(n >= BUSY_FILES, "busy").otherwise("none")


def folder_overview(files: DataFrame) -> DataFrame:
    """Files by first path component, most first."""
    top = F.when(F.col("rel_path").contains("/"), F.split_part("rel_path", F.lit("/"), F.lit(1))).otherwise(F.lit("."))
    return files.groupBy(top.alias("folder")).agg(F.count("*").alias("n_files")).orderBy(F.desc("n_files"), "folder")


def bones_imports(imports: DataFrame) -> DataFrame:
    """One row for each import path of a file, with the columns of its first line."""
    return imports.groupBy("file_id", "import_path").agg(F.min("line").alias("line"), F.min_by("resolved_file_id", F.struct("line", "import_id")).alias("resolved_file_id"), F.min_by("is_external", F.struct("line", "import_id")).alias("is_external"))


# Sinks: merges that give the table's next content.
def upsert(stored: DataFrame, fresh: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Full-outer merge on ``key``: fresh columns win, except ``keep`` columns of rows that were stored."""
    s, f = stored.alias("s"), fresh.alias("f")
    both = s.join(f, F.col(f"s.{key}") == F.col(f"f.{key}"), "full_outer")
    pick = lambda c: F.when(F.col(f"f.{key}").isNull(), F.col(f"s.{c}")).otherwise(F.coalesce(F.col(f"s.{c}"), F.col(f"f.{c}")) if c in keep else F.col(f"f.{c}"))
    return both.select(F.coalesce(F.col(f"s.{key}"), F.col(f"f.{key}")).alias(key), *(pick(c).alias(c) for c in stored.columns if c != key))


def upsert_endpoints(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """One row for each (kind, locator); richer ``extra`` wins: parsed before detected, then the longer, then the text."""
    rank = F.struct(F.col("parsed"), F.length(F.coalesce("extra", F.lit(""))), F.coalesce("extra", F.lit("")))
    return stored.unionByName(fresh).groupBy("kind", "locator").agg(F.max_by("extra", rank).alias("extra"), F.max("parsed").alias("parsed"))


def append_versions(versions: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows to append: fresh contents whose hash is not that of the file's latest version, numbered on.

    versions(file_id, version_number, hash), fresh(file_id, hash).
    """
    latest = versions.groupBy("file_id").agg(F.max("version_number").alias("last"), F.max_by("hash", "version_number").alias("last_hash"))
    joined = fresh.join(latest, "file_id", "left").where(~F.col("hash").eqNullSafe(F.col("last_hash")))
    return joined.select("file_id", (F.coalesce("last", F.lit(0)) + 1).cast("long").alias("version_number"), "hash")


def creatable(requests: DataFrame, files: DataFrame, projects: DataFrame) -> DataFrame:
    """Write requests (path, project_id) with the reason against them, if any: create only, project mandatory."""
    taken = files.select(F.col("abs_path").alias("path"), F.lit(True).alias("taken")).distinct()
    known = projects.select("project_id", F.lit(True).alias("known"))
    joined = requests.join(taken, "path", "left").join(known, "project_id", "left")
    why = F.when(F.col("project_id").isNull(), "project missing").when(F.col("known").isNull(), "project unknown").when(F.col("taken"), "file exists")
    return joined.select("path", "project_id", why.alias("refused"))


def unreferenced(rows: DataFrame, key: str, references: DataFrame) -> DataFrame:
    """Rows whose key no reference has (NOT IN over keys that are not null)."""
    return rows.join(references.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti")
