"""Facts that pure expressions find in text: endpoints, SQL objects, attribution, import resolution, load edges."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions.text import basename, dirname
from loomstone.sources.scratch import cut
from loomstone.sources.tree import list_tree, with_content

#: Suffixes of model files, and binaries that are told by name.
MODEL_SUFFIXES = ("gguf", "safetensors", "onnx", "ggml", "pt", "pth")
BINARIES = ("llama-server", "llama-cli", "llama.cpp", "ollama", "ffmpeg", "sqlite3", "pg_dump", "redis-server", "mongod", "python3", "node")
SQL_TYPES = ("sqlite", "duckdb", "postgres", "mysql")

# Fixed patterns (order, kind, pattern, group), in the order of detection; of equal endpoints the first counts.
_DETECTORS = (
    (0, "server", r"https?://([a-zA-Z0-9._-]+:\d{2,5})\b", 1),
    (1, "server", r"\b((?:\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}|localhost):\d{2,5})\b", 1),
    (2, "model", rf"(?:^|[\"'`\s(])((?:/|\.\.?/)[^\"'`\s)]+?\.(?:{'|'.join(MODEL_SUFFIXES)}))\b", 1),
    (3, "service", r"\b([a-zA-Z0-9_.@-]+\.service)\b", 1),
    (4, "service", r"systemctl\s+(?:start|stop|restart|enable|disable|status|is-active)\s+([a-zA-Z0-9_.@-]+)", 1),
    (5, "binary", "\\b(" + "|".join(b.replace(".", "\\.") for b in BINARIES) + ")\\b", 1),
)


def detect_endpoints(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, name, locator, line) of servers, models, services and known binaries in docs(doc_id, text).

    Lines are searched one by one; a document counts each kind and locator once, at its first line.
    """
    hint = r"https?://|localhost:|\d:\d|\.service\b|systemctl|\.(?:" + "|".join(MODEL_SUFFIXES) + r")\b|" + "|".join(b.replace(".", "\\.") for b in BINARIES)
    lines = docs.where(F.col("text").rlike(hint)).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "line")).where(F.col("line").rlike(hint))

    def hits_of(rank: int, kind: str, pattern: str, group: int) -> Column:
        return F.transform(F.regexp_extract_all("line", F.lit(pattern), F.lit(group)), lambda x: F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x.alias("locator")))

    found = [hits_of(*d) for d in _DETECTORS]
    hits = lines.select("doc_id", "n", F.explode(F.concat(*found)).alias("hit")).select("doc_id", (F.col("n") + 1).alias("line"), "hit.*")
    unit = (F.col("rank") == 4) & ~F.col("locator").endswith(".service")
    hits = hits.withColumn("locator", F.when(unit, F.concat("locator", F.lit(".service"))).otherwise(F.col("locator")))
    first = hits.groupBy("doc_id", "kind", "locator").agg(F.min(F.struct("rank", "line"))["line"].cast("long").alias("line"))
    return first.select("doc_id", "kind", F.when(F.col("kind") == "model", basename(F.col("locator"))).otherwise(F.col("locator")).alias("name"), "locator", "line")


def merge_endpoints(parsed: DataFrame, listeners: DataFrame, detected: DataFrame) -> DataFrame:
    """Endpoints of three sources; of equal (doc_id, kind, locator) the parser's counts, then the listener's."""
    every = None
    for rank, rows in enumerate((parsed, listeners, detected)):
        part = rows.select("doc_id", "kind", "locator", "line", F.lit(rank).alias("source"))
        every = part if every is None else every.union(part)
    return every.groupBy("doc_id", "kind", "locator").agg(F.min(F.struct("source", "line")).alias("m")).select("doc_id", "kind", "locator", "m.line", "m.source")


def sql_objects(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, name) of CREATE statements in docs(doc_id, text)."""
    pattern = r"(?i)\bcreate\s+(?:or\s+replace\s+)?(?:(?:temp|temporary|unique|materialized)\s+)*(table|view|procedure|function|index|trigger)\s+(?:if\s+not\s+exists\s+)?[\"`\[]?([\w.]+)"
    pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)).alias("kind"), F.regexp_extract_all("text", F.lit(pattern), F.lit(2)).alias("name"))
    return docs.select("doc_id", F.posexplode(pairs).alias("ord", "o")).select("doc_id", "ord", F.lower("o.kind").alias("kind"), "o.name")


def attribute_queries(queries: DataFrame, databases: DataFrame) -> DataFrame:
    """``database_id`` of each query: the database with its handle, else the file's only SQL database, else null.

    queries(query_id, file_id, receiver), databases(database_id, file_id, type, handle).
    """
    sql = databases.where(F.col("type").isin(*SQL_TYPES))
    by_handle = sql.where("handle IS NOT NULL").groupBy("file_id", F.col("handle").alias("receiver")).agg(F.min("database_id").alias("own"))
    single = sql.groupBy("file_id").agg(F.count_distinct("database_id").alias("n"), F.min("database_id").alias("only"))
    joined = queries.join(by_handle, ["file_id", "receiver"], "left").join(single, "file_id", "left")
    return joined.select("query_id", "file_id", F.coalesce("own", F.when(F.col("n") == 1, F.col("only"))).alias("database_id"))


#: What may follow a path without suffix, in order.
SUFFIXES = {
    "javascript": ("", ".js", ".mjs", ".cjs", ".jsx", "/index.js", "/index.mjs"), "typescript": ("", ".ts", ".tsx", ".d.ts", ".js", ".mjs", ".cjs", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.mjs"),
    "go": ("", ".go", "/doc.go"), "rust": ("", ".rs", "/mod.rs"), "c": ("", ".h", ".c"), "cpp": ("", ".hpp", ".h", ".cpp", ".cc"), "ruby": ("", ".rb"), "shell": ("", ".sh"),
}


def normal_path(path: Column) -> Column:
    """``.`` and ``..`` parts resolved."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != ".") & (p != ""))
    folded = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when((p == "..") & (F.size(a) > 0), F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p))))
    return F.concat(F.when(path.startswith("/"), F.lit("/")).otherwise(F.lit("")), F.array_join(folded, "/"))


def import_candidates(imports: DataFrame) -> DataFrame:
    """Paths that an import may mean, with their priority: imports(import_id, file_path, root, language, import_path)."""
    here, text = dirname(F.col("file_path")), F.col("import_path")
    relative = text.rlike(r"^\.{0,2}/|^\.{1,2}$")
    base = F.when(text.startswith("/"), text).otherwise(F.concat(here, F.lit("/"), text))
    plain = F.lit(None).cast("array<string>")
    for language, tails in SUFFIXES.items():
        options = F.transform(F.array(*map(F.lit, tails)), lambda s: F.concat(normal_path(base), s))
        plain = F.when((F.col("language") == language) & relative, options).otherwise(plain)
    # Python: leading dots go up; others are sought beside the file, in its parents, at the root and below src.
    dots = F.length(F.regexp_extract(text, r"^(\.*)", 1))
    dotted = F.replace(F.regexp_replace(text, r"^\.+", ""), F.lit("."), F.lit("/"))
    up = F.array_join(F.slice(F.split(here, "/"), F.lit(1), F.greatest(F.size(F.split(here, "/")) - dots + 1, F.lit(1))), "/")
    parents = F.reverse(F.transform(F.sequence(F.lit(1), F.size(F.split(here, "/"))), lambda n: F.array_join(F.slice(F.split(here, "/"), F.lit(1), n), "/")))
    inside = F.filter(parents, lambda p: (p == F.col("root")) | p.startswith(F.concat("root", F.lit("/"))))
    folders = F.when(dots > 0, F.array(up)).otherwise(F.concat(inside, F.array(F.col("root"), F.concat("root", F.lit("/src")))))
    python = F.flatten(F.transform(folders, lambda f: F.array(*(F.concat_ws("/", f, F.concat(dotted, F.lit(tail))) for tail in (".py", "/__init__.py")))))
    options = F.when(F.col("language") == "python", python).otherwise(plain)
    return imports.select("import_id", "root", F.posexplode(options).alias("priority", "path"))


def resolve_imports(imports: DataFrame, files: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """``resolved_file_id`` of each import by its first candidate that is a file, and whether it is external.

    files(file_id, path, root). Only relative imports, and Python imports whose first part is a file or folder
    of the root, can be internal. ``candidates``: those of the imports, where they are known already.
    """
    candidates = import_candidates(imports) if candidates is None else candidates
    hits = candidates.join(files.select("path", "root", F.col("file_id").alias("hit")), ["path", "root"])
    best = hits.groupBy("import_id").agg(F.min_by("hit", "priority").alias("resolved_file_id"))
    tops = _tops(files).withColumn("own", F.lit(True))
    joined = imports.withColumn("top", F.when(F.col("language") == "python", _top_of_import())).join(best, "import_id", "left").join(tops, ["root", "top"], "left")
    local = F.col("resolved_file_id").isNotNull() | F.col("import_path").rlike(r"^[./]") | ((F.col("language") == "python") & F.coalesce("own", F.lit(False)))
    return joined.select("import_id", "import_path", "resolved_file_id", (~local).alias("is_external"))


def _tops(files: DataFrame) -> DataFrame:
    """(root, top): first parts below each root, files without ``.py``."""
    return files.select("root", F.regexp_replace(F.split_part(F.expr("substr(path, length(root) + 2)"), F.lit("/"), F.lit(1)), r"\.py$", "").alias("top")).distinct()


def _top_of_import() -> Column:
    return F.split_part(F.regexp_replace("import_path", r"^src\.", ""), F.lit("."), F.lit(1))


def _differing(before: DataFrame, after: DataFrame, *keys: str) -> DataFrame:
    """Keys that only one of two tables has."""
    both = before.select(*keys, F.lit(True).alias("_old")).unionAll(after.select(*keys, F.lit(False).alias("_old")))
    return both.groupBy(*keys).agg(F.min("_old").alias("a"), F.max("_old").alias("b")).where("a = b").select(*keys)


def relink_imports(imports: DataFrame, resolved: DataFrame, candidates: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """``resolve_imports`` of ``imports`` over the files ``after``, of which only what may have changed is resolved.

    resolved(import_id, import_path, resolved_file_id, is_external): outcomes over the files ``before``, of some of the imports; those
    of imports that are no more go. ``candidates``: of ``import_candidates`` for all of ``imports``, stored. An import is resolved again
    that has no outcome, that has a candidate among new or lost files, or whose first part came to a root or went from it.
    A file is new that has another file_id.
    """
    moved, tops = _differing(before, after, "path", "root", "file_id"), _differing(_tops(before), _tops(after), "root", "top")
    met = candidates.join(moved.select("path", "root").distinct(), ["path", "root"], "left_semi").select("import_id")
    python = imports.where("language = 'python'").select("import_id", "root", _top_of_import().alias("top"))
    met = met.unionAll(python.join(tops, ["root", "top"], "left_semi").select("import_id")).unionAll(imports.select("import_id").join(resolved, "import_id", "left_anti"))
    met = met.distinct()
    again = imports.join(met, "import_id", "left_semi")
    fresh = resolve_imports(again, after, candidates.join(met, "import_id", "left_semi"))
    kept = resolved.join(met, "import_id", "left_anti").join(imports.select("import_id"), "import_id", "left_semi")
    return kept.select("import_id", "import_path", "resolved_file_id", "is_external").unionAll(fresh)


def load_edges(loads: DataFrame, files: DataFrame) -> DataFrame:
    """Edges from a file that loads a folder's plugins to every file there with the suffix, itself excepted."""
    targets = files.select(F.col("file_id").alias("to_file_id"), dirname(F.col("path")).alias("folder"), F.regexp_extract("path", r"(\.[^./]+)$", 1).alias("suffix"))
    return loads.join(targets, ["folder", "suffix"]).where("file_id <> to_file_id").select(F.col("file_id").alias("from_file_id"), "to_file_id", F.lit("load").alias("edge_kind")).distinct()


#: Pairs of a locator that one key of the join makes, some.
PAIRS_A_KEY = 1 << 20


def shared_endpoints(listeners: DataFrame, upstreams: DataFrame) -> DataFrame:
    """Files that listen where others connect to: (locator, listener_file, client_file), each once.

    Each side is made distinct before the join, so the pairs are not shuffled; a pair that shares several kinds of a locator is made by the
    least of them. The clients of a locator with many pairs are dealt into parts, and its listeners are repeated for each.
    """

    def side(rows: DataFrame, name: str) -> DataFrame:
        files = rows.where("kind IS NOT NULL").groupBy("locator", F.col("file_id").alias(f"{name}_file")).agg(F.array_sort(F.collect_set("kind")).alias(f"{name}_kinds"))
        return files.select("locator", f"{name}_file", f"{name}_kinds", F.explode(f"{name}_kinds").alias("kind"))

    a, b = cut(side(listeners, "listener"), "listeners"), cut(side(upstreams, "client"), "clients")
    count = lambda rows, n: rows.groupBy("kind", "locator").agg(F.count("*").alias(n))
    sizes = count(a, "n_listeners").join(count(b, "n_clients"), ["kind", "locator"])
    parts = F.ceil(F.least(F.col("n_clients"), F.col("n_listeners") * F.col("n_clients") / PAIRS_A_KEY))
    sizes = cut(sizes.select("kind", "locator", parts.alias("parts")), "endpoint-parts")
    dealt = b.join(sizes, ["kind", "locator"]).withColumn("part", F.pmod(F.xxhash64("client_file"), "parts")).drop("parts")
    repeated = a.join(sizes, ["kind", "locator"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    least = F.array_min(F.array_intersect("listener_kinds", "client_kinds"))
    first = (F.size("listener_kinds") == 1) | (F.size("client_kinds") == 1) | (F.col("kind") == least)
    return repeated.join(dealt, ["kind", "locator", "part"]).where((F.col("listener_file") != F.col("client_file")) & first).select("locator", "listener_file", "client_file")


#: Names of folders that are not scanned, with patterns, files that mark one, and files that are not scanned.
IGNORED_FOLDERS = (
    ".git", "node_modules", "__pycache__", ".pytest_cache", "dist", "build", "out", "target", ".next", ".nuxt", ".cache", "venv", ".venv", "env", ".env", "virtualenv", ".idea", ".vscode", ".vs",
    "coverage", ".nyc_output", ".tox", "vendor", "bower_components", ".gradle", ".mvn", "site-packages", ".eggs", "*.egg-info",
)
IGNORED_PATTERNS = (r"^\.venv.*$", r"^venv[-_].*$", r"^\.env-.*$", r"^env[-_].*$", r".*\.egg-info$")
MARKERS = ("pyvenv.cfg",)
IGNORED_FILES = (".DS_Store", "Thumbs.db", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "composer.lock", "Cargo.lock", "Gemfile.lock", "poetry.lock", "Pipfile.lock")
#: Folders of a virtual environment's own files where the scanned folder is one, and what they must hold (none: nothing).
VENV_FOLDERS = {("bin", "Scripts"): r"^(activate|activate\.bat|Activate\.ps1)$", ("lib", "lib64", "Lib"): r"^python\d|^site-packages$", ("include", "Include", "share", "local"): ""}

#: Languages by category, with their suffixes.
REGISTRY = {
    "supported": {
        "javascript": ".js .mjs .cjs .jsx", "python": ".py .pyw", "typescript": ".ts .tsx", "go": ".go", "rust": ".rs", "java": ".java", "kotlin": ".kt .kts", "swift": ".swift", "ruby": ".rb", "php": ".php",
        "c": ".c .h .m", "cpp": ".cpp .hpp .cu .cuh .hip .metal .mm", "csharp": ".cs", "shell": ".sh", "sql": ".sql", "nginx": ".conf .nginx",
    },
    "coming_soon": {"lua": ".lua", "protobuf": ".proto"},
    "opaque_text": {"image": ".svg", "markdown": ".md", "restructuredtext": ".rst", "text": ".txt", "json": ".json", "yaml": ".yaml .yml", "toml": ".toml", "xml": ".xml", "html": ".html", "css": ".css"},
    "opaque_binary": {
        "shared_library": ".so .dll .dylib", "webassembly": ".wasm", "object_file": ".o", "static_library": ".a", "java_archive": ".jar", "java_bytecode": ".class", "python_bytecode": ".pyc",
        "python_extension": ".pyd", "image": ".png .jpg .jpeg .gif .webp", "document": ".pdf", "sqlite_db": ".sqlite .sqlite3 .db",
    },
}

#: Standard headers of C++, and constructs that only C++ has. Only so many characters of a header are read.
HEADER_CHARACTERS = 256 * 1024
CPP_HEADERS = (
    "algorithm any array atomic bitset cassert cctype cerrno cfloat chrono cinttypes climits cmath codecvt complex concepts condition_variable csignal cstdarg cstddef cstdint cstdio cstdlib cstring "
    "ctime deque exception filesystem forward_list fstream functional future initializer_list iomanip ios iosfwd iostream istream iterator limits list locale map memory mutex new numeric optional "
    "ostream queue random ranges ratio regex set shared_mutex span sstream stack stdexcept streambuf string string_view system_error thread tuple type_traits typeindex typeinfo unordered_map "
    "unordered_set utility valarray variant vector"
)
CPP_CONSTRUCTS = (
    r"\bnamespace\s+[A-Za-z_][\w:]*\s*\{", r"\bnamespace\s*\{", r"\btemplate\s*<", r"\bclass\s+[A-Za-z_]\w*\s*(final\s*)?(:[^:;{]*)?\{", r"\bstruct\s+[A-Za-z_]\w*\s*(final\s*)?:[^:;{]*\{",
    r"\bclass\s+[A-Za-z_]\w*\s*;", r"^\s*(public|private|protected)\s*:", r"\bstd::", r"\busing\s+namespace\b", r"\busing\s+[A-Za-z_]\w*\s*=", r"\bnoexcept\b", r"\bvirtual\s+[\w~]",
    r"\boperator\s*(\(\)|\[\]|[-+*/%^&|~!=<>]+|new\b|delete\b)\s*\(", r"\b(static|reinterpret|dynamic)_cast\s*<",
)


def _without_cplusplus(text: Column) -> Column:
    """Lines of a header outside the branches that only C++ compilers read, without the conditionals.

    State of the fold: for each open conditional 0 (not about __cplusplus), 1 (its branch for C) or 2 (its branch for C++), and the text.
    """
    top = lambda s: F.try_element_at(s["open"], F.lit(-1))
    below = lambda s: F.slice(s["open"], F.lit(1), F.greatest(F.size(s["open"]) - 1, F.lit(0)))

    def read(s: Column, line: Column) -> Column:
        negated = line.rlike(r"^\s*#\s*ifndef\b") | line.rlike(r"!\s*(defined\s*\(?\s*)?__cplusplus\b")
        opened = F.when(~line.rlike(r"\b__cplusplus\b"), 0).when(negated, 1).otherwise(2)
        state = lambda stack, out: F.struct(stack.alias("open"), out.alias("text"))
        turned = F.when(top(s) > 0, F.concat(below(s), F.array(3 - top(s)))).otherwise(s["open"])
        kept = F.when(F.array_contains(s["open"], 2), s["text"]).otherwise(F.concat(s["text"], line, F.lit("\n")))
        return (
            F.when(line.rlike(r"^\s*#\s*if"), state(F.concat(s["open"], F.array(opened)), s["text"])).when(line.rlike(r"^\s*#\s*(else|elif)\b"), state(turned, s["text"]))
            .when(line.rlike(r"^\s*#\s*endif\b"), state(below(s), s["text"])).otherwise(state(s["open"], kept))
        )

    start = F.struct(F.array().cast("array<int>").alias("open"), F.lit("").alias("text"))
    return F.aggregate(F.split(text, "\n", -1), start, read, lambda s: s["text"])


def cpp_header(content: Column) -> Column:
    """Whether a header shows C++: a construct or standard header of C++ outside comments, literals and __cplusplus branches."""
    # Literals are kept while comments go, in one pass from left to right; then they are emptied.
    bare = F.regexp_replace(F.substring(content, 1, HEADER_CHARACTERS), r"(\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')|/\*[\s\S]*?(?:\*/|\z)|//[^\n]*", "$1 ")
    bare = _without_cplusplus(F.regexp_replace(bare, r"([\"'])(?:\\.|(?!\1)[^\\\n])*\1", "$1$1"))
    return bare.rlike("(?m)" + "|".join([rf"^\s*#\s*include\s*<({'|'.join(CPP_HEADERS.split())})>", *CPP_CONSTRUCTS]))


def _by_suffix(category: str) -> Column:
    """A map of suffixes to languages."""
    return F.create_map(*[F.lit(x) for language, suffixes in REGISTRY[category].items() for s in suffixes.split() for x in (s, language)])


def classify_files(files: DataFrame) -> DataFrame:
    """language and category of files(path, content): supported, coming_soon, opaque or unrecognized; nginx by folder first."""
    from loomstone.functions.text import extension

    suffix = extension(F.col("path"))
    nginx = (basename(F.col("path")) == "nginx.conf") | F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).isin("sites-enabled", "sites-available", "conf.d")
    header = (suffix == ".h") & F.coalesce(cpp_header(F.col("content")), F.lit(False))
    found = {category: F.try_element_at(_by_suffix(category), suffix) for category in REGISTRY}
    language = F.when(nginx, "nginx").when(header, "cpp").otherwise(F.coalesce(*found.values()))
    category = F.when(nginx, "supported").otherwise(F.coalesce(*(F.when(known.isNotNull(), name) for name, known in found.items()), F.lit("unrecognized")))
    return files.select("*", language.alias("language"), category.alias("category"))


def scanned_paths(files: DataFrame) -> DataFrame:
    """files(path) that a scan reads: not ignored by name, not below a folder ignored by name, pattern or marker file.

    Where the scanned folder itself is a virtual environment, the environment's own folders go, told by what they hold.
    """
    parts = F.split("path", "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    bad = F.exists(folders, lambda f: f.isin(*IGNORED_FOLDERS) | f.rlike("|".join(IGNORED_PATTERNS)))
    marks = files.where(basename(F.col("path")).isin(*MARKERS)).select(F.when(F.col("path").contains("/"), dirname(F.col("path"))).otherwise("").alias("folder")).distinct()
    kept = files.where(~bad & ~basename(F.col("path")).isin(*IGNORED_FILES))
    # Folders above each file, and the top folder where the whole tree is an environment: at most one row.
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    above = kept.select("path", F.explode(prefixes).alias("folder"))
    below_mark = above.join(marks.where("folder <> ''"), "folder", "left_semi").select("path").distinct()
    first, second = parts[0], F.try_element_at(parts, F.lit(2))
    own = reduce(or_, (first.isin(*names) & (second.rlike(holds) if holds else second.isNotNull()) for names, holds in VENV_FOLDERS.items()))
    environment = files.where(own).select(first.alias("top")).distinct().join(F.broadcast(marks.where("folder = ''").limit(1)), how="cross").select("top")
    tops = kept.withColumn("top", F.when(F.col("path").contains("/"), first))
    return tops.join(environment, "top", "left_anti").select(*files.columns).join(below_mark, "path", "left_anti").select(*files.columns)


def language_registry(spark) -> DataFrame:
    """Languages with category and suffixes."""
    rows = [(language, category, " ".join(sorted(suffixes.split()))) for category, languages in REGISTRY.items() for language, suffixes in languages.items()]
    return spark.createDataFrame(rows, "language string, category string, suffixes string")


def entered(folder: Column) -> Column:
    """Whether a scan lists a folder, by its own name: what ``scanned_paths`` would leave out whole need not be listed."""
    return ~(basename(folder).isin(*IGNORED_FOLDERS) | basename(folder).rlike("|".join(IGNORED_PATTERNS)))


def read_tree(spark, path: str, text_only: bool = True) -> DataFrame:
    """(path, size, modified, content) of all files below a folder, empty and hidden ones included; paths relative to it."""
    return with_content(list_tree(spark, path), path, text_only)


def scan_tree(spark, path: str) -> DataFrame:
    """(path, size, modified, content) of the files below a folder that a scan reads: no others are opened, no ignored folder is listed."""
    listed = list_tree(spark, path, entered)
    known = classify_files(scanned_paths(listed).withColumn("content", F.lit(None).cast("string"))).where("category <> 'unrecognized'")
    return with_content(known.select(*listed.columns), path)


#: Commands that read files, commands that edit files, and other ways of either, by pattern.
READING = "cat head tail tac less more bat batcat strings"
EDITING = "sed awk perl tee truncate patch"
EDITING_PATTERNS = (
    r"\b(echo|printf)\b.*[^>]>[^>]", r"\bpython3?\s+-c\s+.*open\s*\(", r"\bpython3?\s+.*<<", r"\bpython3?\s+-c\s+.*(read|write|\.readlines|\.writelines)",
    r"\bnode\s+-e\s+.*(readFile|writeFile|appendFile|createWriteStream|createReadStream)", r"\b(bash|sh|source)\s+\S+\.(sh|bash|py|js|pl|rb)\b",
)
#: Subcommands of the token-saving wrapper that read files.
READING_SUBCOMMANDS = "read smart"


def command_guard(command: Column, wrapped: bool = False) -> Column:
    """``read`` or ``edit`` if a command reads or edits files past the tools for that; null if it may run.

    The command's first word counts without its folder, and so does the first word behind ``bash -c``. ``wrapped``: arguments of
    the wrapper, of which some subcommands read.
    """
    text = F.trim(command)
    starts = lambda words, before="^": text.rlike(rf"{before}(?:[^\s|;&]*/)?(?:{'|'.join(words.split())})(?:[\s|;&]|$)")
    inner = r"\b(?:bash|sh)\s+-c\s+['\"]?"
    rules = [(starts(READING), "read"), (starts(EDITING), "edit"), (text.rlike("|".join(EDITING_PATTERNS)), "edit"), (starts(READING, inner), "read"), (starts(EDITING, inner), "edit")]
    if wrapped:
        rules.insert(0, (F.split(text, r"\s+")[0].isin(*READING_SUBCOMMANDS.split()), "read"))
    return F.coalesce(*(F.when(rule, outcome) for rule, outcome in rules))
