"""Addressed segments of texts: plain text by windows, configuration files and Python by scanners, search over them."""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.operators.extract import analyze
from loomstone.operators.flavours import FLAVORS, Seg, Text, config_flavor
from loomstone.sources.tables import spread

# Plain text, with built-in functions only.
_MD, _NUMBERED = r"^#{1,6}\s+(.+)", r"^[\d.]+\s+(.+)"


def detected_title(line: Column) -> Column:
    """Heading text of a line: after #, a capitals line of 4 to 79 characters, or after a number; else null."""
    t = F.trim(line)
    caps = (F.length(t) >= 4) & (F.length(t) < 80) & (t == F.upper(t)) & t.rlike("[A-Z]")
    return F.when(t.rlike(_MD), F.trim(F.regexp_extract(t, _MD, 1))).when(caps, t).when(t.rlike(_NUMBERED), F.trim(F.regexp_extract(t, _NUMBERED, 1)))


def segment_kind(first: Column, language: Column) -> Column:
    """Kind of a plain-text segment by its first line."""
    t = F.trim(first)
    caps = (t == F.upper(t)) & (F.length(t) >= 4) & t.rlike("[A-Z]")
    return (
        F.when(t.rlike(r"^#{1,6}\s"), "heading").when(caps, "heading").when(t.rlike(r"^[\d.]+\s"), "section").when(t.rlike(r"^([-*+]\s|\d+\.\s)"), "list")
        .when(t.rlike(r"^[{\[]"), "block").when(t.contains(":") & (F.instr(t, ":") <= 30) & (language == "yaml"), "mapping")
        .when(t.contains("=") & language.isin("env", "ini"), "assignment").when(t.startswith("```"), "code_block").when(t.rlike("^(---|===)"), "separator").otherwise("paragraph")
    )


def plain_segments(docs: DataFrame) -> DataFrame:
    """Gapless segments of docs(doc_id, text, language): content chunks, and the blank lines between them.

    A chunk ends at a blank line or before a heading. Rows: doc_id, ord, kind, name, start_line, end_line,
    content; joined by newlines in order they give the text back.
    """
    lines = docs.select("doc_id", F.coalesce("language", F.lit("plaintext")).alias("language"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("n", "line"))
    doc = Window.partitionBy("doc_id").orderBy("n")
    blank = F.trim(F.regexp_replace("line", r"\s+", " ")) == ""
    rows = lines.withColumn("blank", blank).withColumn("heading", ~blank & detected_title(F.col("line")).isNotNull() & ~F.trim("line").rlike(r"^[=-]{3,}\s*$"))
    before = F.lag("blank").over(doc)
    new = before.isNull() | (F.col("blank") != before) | (~F.col("blank") & F.col("heading"))
    numbered = rows.withColumn("ord", F.sum(F.when(new, 1).otherwise(0)).over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = numbered.groupBy("doc_id", "ord").agg(
        F.first("language").alias("language"), F.first("blank").alias("blank"), F.min("n").alias("a"), F.max("n").alias("b"),
        F.min_by("line", "n").alias("first"), F.array_sort(F.collect_list(F.struct("n", "line"))).alias("lines"),
    )
    title = F.coalesce(detected_title(F.col("first")), F.substring(F.trim("first"), 1, 60))
    kind = segment_kind(F.col("first"), F.col("language"))
    short = F.when(F.length(title) > 60, F.concat(F.substring(title, 1, 57), F.lit("..."))).otherwise(title)
    name = F.when(F.col("blank"), "(blank)").when(kind == "heading", title).otherwise(short)
    content = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    return grouped.select("doc_id", F.col("ord").cast("long").alias("ord"), F.when(F.col("blank"), "whitespace").otherwise(kind).alias("kind"), name.alias("name"), (F.col("a") + 1).cast("long").alias("start_line"), (F.col("b") + 1).cast("long").alias("end_line"), content.alias("content"))


def covers(segments: DataFrame, docs: DataFrame) -> DataFrame:
    """Whether each document's segments, joined in order, are its text."""
    joined = segments.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "content"))), lambda x: x["content"]), "\n").alias("joined"))
    return docs.join(joined, "doc_id", "left").select("doc_id", F.coalesce(F.col("joined") == F.coalesce("text", F.lit("")), F.lit(False)).alias("covered"))


def windows_of_lines(docs: DataFrame, size: int = 2000, most: int = 3000) -> DataFrame:
    """Windows of large files: cut at the first blank or closing line after ``size`` lines, at ``most`` at the latest.

    Rows: doc_id, window, start_line, end_line. The cut depends on the window's start, so the lines of a
    document are folded in order in one pass over its cut candidates.
    """
    lines = F.split("text", "\n", -1)
    cuttable = F.transform(lines, lambda l: l.rlike(r"^\s*$|^[})\]]"))
    empty = F.lit(0).cast("int")
    state = F.struct(empty.alias("start"), F.array().cast("array<int>").alias("ends"))
    folded = F.aggregate(
        F.transform(cuttable, lambda c, i: F.struct(c.alias("cut"), (i + 1).cast("int").alias("n"))), state,
        lambda s, x: F.when(((x["n"] - s["start"] >= size) & x["cut"]) | (x["n"] - s["start"] >= most), F.struct(x["n"].alias("start"), F.concat(s["ends"], F.array(x["n"])).alias("ends"))).otherwise(s),
    )
    total = F.size(lines)
    ends = F.array_distinct(F.concat(folded["ends"], F.array(total)))
    rows = docs.select("doc_id", F.posexplode(ends).alias("window", "end_line"))
    start = F.coalesce(F.lag("end_line").over(Window.partitionBy("doc_id").orderBy("window")), F.lit(0)) + 1
    return rows.withColumn("start_line", start).select("doc_id", F.col("window").cast("long").alias("window"), F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"))


def fill_lines(spans: DataFrame, totals: DataFrame) -> DataFrame:
    """Line ranges that no span (doc_id, start_line, end_line) covers, up to totals(doc_id, lines)."""
    w = Window.partitionBy("doc_id").orderBy("start_line", "end_line")
    reached = F.max("end_line").over(w.rowsBetween(Window.unboundedPreceding, -1))
    gaps = spans.select("doc_id", (F.coalesce(reached, F.lit(0)) + 1).alias("a"), (F.col("start_line") - 1).alias("b"))
    tail = totals.join(spans.groupBy("doc_id").agg(F.max("end_line").alias("last")), "doc_id", "left").select("doc_id", (F.coalesce("last", F.lit(0)) + 1).alias("a"), F.col("lines").alias("b"))
    return gaps.union(tail).where("a <= b").select("doc_id", F.col("a").cast("long").alias("start_line"), F.col("b").cast("long").alias("end_line"), F.concat(F.lit("lines "), "a", F.lit("-"), "b").alias("name"))


def stable_ids(segments: DataFrame) -> DataFrame:
    """``seg_id``: sha1 of path, parent, kind, name, first line and number among equal siblings.

    segments(path, parent_id, kind, name, first_line, ord). One level at a time: parents have ids already.
    """
    same = Window.partitionBy("path", "parent_id", "kind", "name", "first_line").orderBy("ord")
    n = F.row_number().over(same)
    return segments.withColumn("seg_id", F.substring(F.sha1(F.concat_ws("\0", "path", F.coalesce("parent_id", F.lit("")), "kind", "name", "first_line", n.cast("string")).cast("binary")), 1, 12))


def section_groups(segments: DataFrame) -> DataFrame:
    """``group``: number of the banner segment (column banner) that each segment stands below; 0 before the first."""
    return segments.withColumn("group", F.sum(F.col("banner").cast("long")).over(Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)))


def compact_skeleton(segments: DataFrame) -> DataFrame:
    """Without whitespace, and runs of neighbouring imports as one line with their number."""
    shown = segments.where("kind NOT IN ('whitespace', 'gap')")
    doc = Window.partitionBy("doc_id").orderBy("ord")
    run = F.row_number().over(doc) - F.row_number().over(Window.partitionBy("doc_id", F.col("kind") == "import").orderBy("ord"))
    marked = shown.withColumn("run", F.when(F.col("kind") == "import", run)).withColumn("own", F.when(F.col("kind") != "import", F.col("ord")))
    return marked.groupBy("doc_id", "run", "own").agg(F.min("ord").alias("ord"), F.min_by("kind", "ord").alias("kind"), F.min_by("name", "ord").alias("name"), F.count("*").alias("n")).drop("run", "own")


# Search.
def search_names(segments: DataFrame, text: str) -> DataFrame:
    """Segments whose name or kind contains ``text``, whatever the case."""
    return segments.where(F.lower("name").contains(text.lower()) | F.lower("kind").contains(text.lower()))


def deepest_segments(hits: DataFrame, segments: DataFrame, bucket: int = 64) -> DataFrame:
    """For each hit (doc_id, line): the innermost segment (doc_id, seg, depth, start_line, end_line) that holds it.

    Segments are listed under every bucket of lines that they touch, so the range join is an equi-join.
    """
    span = lambda c: F.floor(c / bucket)
    listed = segments.select("*", F.explode(F.sequence(span(F.col("start_line")), span(F.col("end_line")))).alias("bucket"))
    joined = hits.withColumn("bucket", span(F.col("line"))).join(listed, ["doc_id", "bucket"]).where("line >= start_line AND line <= end_line")
    best = F.max_by(F.col("seg"), F.struct(F.col("depth"), F.col("start_line"), -F.col("end_line"), F.col("seg")))
    return joined.groupBy("doc_id", "line").agg(best.alias("seg"))


def matching_lines(docs: DataFrame, text: str) -> DataFrame:
    """(doc_id, line) of lines that contain ``text``, whatever the case."""
    lines = docs.where(F.lower("text").contains(text.lower())).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "content"))
    return lines.where(F.lower("content").contains(text.lower())).select("doc_id", (F.col("n") + 1).cast("long").alias("line"))


def limited(rows: DataFrame, keys: list[str], order: list[str], most: int = 25) -> DataFrame:
    """The first ``most`` rows of each group, with the group's total."""
    w = Window.partitionBy(*keys)
    return rows.withColumn("total", F.count("*").over(w)).withColumn("nth", F.row_number().over(w.orderBy(*order))).where(F.col("nth") <= most)


def source_span(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Text of line ranges (doc_id, line_start, line_end)."""
    lines = F.slice(F.split("text", "\n", -1), F.col("line_start"), F.greatest(F.col("line_end") - F.col("line_start") + 1, F.lit(0)))
    return docs.join(spans, "doc_id").select("doc_id", "line_start", "line_end", F.array_join(lines, "\n").alias("source"))


def _python_segments(t: Text) -> list[Seg]:
    """Top-level statements with the comments above them, and the members of classes."""
    tree = ast.parse(t.text)

    def of(body: list, least: int) -> list[Seg]:
        out = []
        for node in body:
            first = min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))]) - 1
            a = t.lead(first, least)
            kind, name = "statement", t.lines[first].strip()[:60]
            if isinstance(node, ast.ClassDef):
                kind, name = "class", node.name
            elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
                kind, name = "function", node.name
            elif isinstance(node, ast.Import | ast.ImportFrom):
                kind = "import"
            kids = of(node.body, first + 1) if isinstance(node, ast.ClassDef) else []
            if out and t.start[a] < out[-1].end:  # several statements in one line
                out[-1].end = t.end(node.end_lineno - 1)
            else:
                out.append(Seg(kind, name, t.start[a], t.end(node.end_lineno - 1), kids))
            least = node.end_lineno
        return out

    return of(tree.body, 0)


#: Languages whose declarations are found by scanners.
CODE_LANGUAGES = frozenset("javascript typescript go java rust c cpp csharp kotlin swift php objc".split())
#: What starts a comment or attribute line above a declaration, in the languages of braces.
_ABOVE = ("//", "/*", "*", "#", "@", "--")


def _declared_segments(t: Text, language: str) -> list[Seg]:
    """Declarations of a language of braces, nested by their lines, each with the comment lines above it."""
    found = [f for f in analyze(t.text, language).facts if f.fact in ("module", "method") and 0 < f.line_start <= f.line_end]
    out: list[Seg] = []
    open_: list[tuple[Seg, int]] = []  # segments around the next one, and their last lines
    last = 0
    for f in sorted(found, key=lambda f: (f.line_start, -f.line_end)):
        while open_ and open_[-1][1] < f.line_start - 1 + (open_[-1][1] < f.line_end - 1):
            open_.pop()
        first, end = f.line_start - 1, min(f.line_end, len(t.lines)) - 1
        siblings = open_[-1][0].children if open_ else out
        if siblings and t.start[first] < siblings[-1].end:
            continue  # in a line that another declaration ends in
        while first > last and t.bare[first - 1].startswith(_ABOVE) and (not siblings or t.start[first - 1] >= siblings[-1].end):
            first -= 1
        seg = Seg(f.kind, f.name, t.start[first], t.end(end))
        siblings.append(seg)
        if end > f.line_start - 1:
            open_.append((seg, end))
        last = f.line_start
    return out


def scan_segments(text: str, path: str = "", language: str | None = None) -> list[Seg]:
    """Segment tree of one text: Python, a configuration flavour, declarations, or paragraphs; gaps are filled."""
    t = Text(text)
    flavor = config_flavor(path, text, language)
    if language == "python":
        try:
            found = _python_segments(t)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            found = FLAVORS["lines"](t)
    elif flavor:
        found = FLAVORS[flavor](t)
    else:
        found = (_declared_segments(t, language) if language in CODE_LANGUAGES else []) or FLAVORS["lines"](t)
    return fill(found, text, 0, len(text))


def fill(found: list[Seg], text: str, a: int, b: int) -> list[Seg]:
    """Segments in order, with a segment for every stretch between them, so that they join to the text."""
    out, at = [], a
    gap = lambda x, y: Seg("whitespace" if not text[x:y].strip() else "gap", "(blank)" if not text[x:y].strip() else "(gap)", x, y)
    for s in sorted(found, key=lambda s: s.start):
        if s.start < at:
            continue
        if s.start > at:
            out.append(gap(at, s.start))
        if s.children:
            s.children = fill(s.children, text, s.start, s.end)
        out.append(s)
        at = s.end
    if at < b:
        out.append(gap(at, b))
    return out


def comment_class(comment: str) -> str:
    """``deactivated`` for [off] marks and comments that parse as code, else ``prose``."""
    body = "\n".join(re.sub(r"^\s*#\s?", "", x) for x in comment.split("\n")).strip()
    if body.startswith("[off]"):
        return "deactivated"
    try:
        tree = ast.parse(body)
    except (SyntaxError, ValueError):
        return "prose"
    plain = all(isinstance(n, ast.Expr) and isinstance(n.value, ast.Name | ast.Constant | ast.Tuple | ast.Attribute) for n in tree.body)
    return "prose" if plain else "deactivated"


SEGMENTS = "doc_id long, seg_id string, parent_id string, ord int, depth int, address string, kind string, name string, start_char int, end_char int, start_line int, end_line int"


def segment_rows(doc_id, path: str, text: str, language: str | None) -> list[tuple]:
    """Flattened segments with stable ids and dotted addresses (numbered without whitespace)."""
    rows: list[tuple] = []
    line = lambda at: text.count("\n", 0, at) + 1

    def walk(found: list[Seg], parent: str | None, address: str, depth: int) -> None:
        seen: dict[tuple, int] = {}
        shown = 0
        for s in found:
            head = text[s.start : s.end].lstrip("\n").split("\n", 1)[0]
            key = (s.kind, s.name, head)
            seen[key] = seen.get(key, 0) + 1
            seg_id = hashlib.sha1("\0".join([path, parent or "", s.kind, s.name, head, str(seen[key])]).encode()).hexdigest()[:12]
            hidden = s.kind in ("whitespace", "gap")
            shown += not hidden
            own = "" if hidden else f"{address}.{shown}" if address else str(shown)
            rows.append((doc_id, seg_id, parent, len(rows), depth, own or None, s.kind, s.name, s.start, s.end, line(s.start), line(max(s.start, s.end - 1))))
            walk(s.children, seg_id, own, depth + 1)

    walk(scan_segments(text, path, language), None, "", 0)
    return rows


def file_segments(files: DataFrame) -> DataFrame:
    """Segment rows of files(doc_id, path, language, content)."""
    names = [c.split()[0] for c in SEGMENTS.split(", ")]
    types = [pa.int64(), *[pa.string()] * 2, pa.int32(), pa.int32(), *[pa.string()] * 3, *[pa.int32()] * 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, path, language, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "path", "language", "content")), strict=True):
                if text:
                    rows += segment_rows(doc, path or "", text, language)
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(columns, types, strict=True)], names=names)

    return spread(files.select(F.col("doc_id").cast("long").alias("doc_id"), "path", "language", "content")).mapInArrow(run, SEGMENTS)


#: Language hints of code snippets, what starts a shell line, and unmistakable signs of languages.
HINTS = {
    "python": "py python python3 py3 ipython default", "javascript": "js javascript jsx mjs cjs node", "typescript": "ts typescript tsx", "c": "c h", "cpp": "cpp c++ cc cxx hpp",
    "csharp": "cs csharp c#", "go": "go golang", "rust": "rs rust", "java": "java", "kotlin": "kt kotlin", "php": "php", "ruby": "rb ruby", "swift": "swift",
    "shell": "sh bash shell zsh console shellsession", "css": "css scss", "html": "html xml vue svelte", "json": "json", "yaml": "yaml yml", "toml": "toml", "markdown": "md markdown",
    "plaintext": "text txt plaintext plain none pycon python-repl pytb doscon",
}
SHELL_LINE = (
    r"^\s*(?:\$\s|(?:sudo|npm|npx|yarn|pnpm|pip3?|python3?\s+-m|git|cd|ls|mkdir|rm|cp|mv|cat|echo|export|source|curl|wget|apt(?:-get)?|brew|docker|kubectl|make|cmake|cargo"
    r"|go\s+(?:get|run|build|install|mod)|node|deno|bun|chmod|chown|tar|unzip|ssh|scp|systemctl|journalctl)\b)"
)
SIGNS = (
    ("csharp", r"\busing\s+System\b|\bConsole\.\w+\(|\bnamespace\s+[\w.]+\s*[{;]"), ("java", r"\bSystem\.out\.|\bimport\s+java\.|\bpublic\s+static\s+void\s+main\s*\(\s*String"),
    ("cpp", r"#include\s*<(iostream|vector|string|memory|map)>|\bstd::|\bcout\s*<<"), ("c", r"#include\s*[<\"]|\bint\s+main\s*\(|\bprintf\s*\(|\bmalloc\s*\("),
    ("kotlin", r"\bfun\s+\w+\s*\(|\bval\s+\w+\s*[:=]"), ("swift", r"\bimport\s+(UIKit|SwiftUI|Foundation)\b|\bfunc\s+\w+\s*\([^)]*\)\s*->"),
)
#: Without a grammar to count errors, constructs stand for a language that parses; in the order in which languages are tried.
CONSTRUCTS = (
    ("python", r"^\s*(async )?def \w+\(.*\).*:|^\s*(import \w[\w.]*( as \w+)?|from [\w.]+ import .+)$|^\s*class \w+.*:$"), ("typescript", r"^\s*(export )?(interface|type) \w+|\b(const|let) \w+:\s*\w+"),
    ("javascript", r"\b(const|let|var) \w+\s*=|=>\s*[{(]|\bfunction\s*\w*\("), ("rust", r"\bfn \w+\(.*\)|\blet mut "), ("go", r"^package \w+|\bfunc (\(\w+ \*?\w+\) )?\w+\("),
    ("php", r"<\?(php|=)"), ("ruby", r"^\s*def \w+[^:]*$|^\s*require '"), ("shell", r"^#!|\$\{?\w|\b(then|fi|done|esac)\b|\s\|\s|&&|^\s*[A-Za-z_]\w*=\S"), ("html", r"(?i)^\s*<(!doctype|[a-z][\w-]*[\s>/])"),
)
#: Longer snippets are plain text unless a hint names their language.
MAX_DETECT_BYTES = 200 * 1024


def snippet_language(text: Column, hint: Column) -> Column:
    """Language of a code snippet: by hint, then half of its lines being shell, then signs, then constructs; else plain text."""
    table = F.create_map(*[F.lit(x) for language, hints in HINTS.items() for h in hints.split() for x in (h, language)])
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    ratio = F.size(F.filter(lines, lambda x: x.rlike(SHELL_LINE))) / F.greatest(F.size(lines), F.lit(1))
    told = F.coalesce(*(F.when(text.rlike(f"(?m){sign}"), language) for language, sign in (*SIGNS, *CONSTRUCTS)), F.lit("plaintext"))
    found = F.when(text.isNull() | (F.trim(text) == "") | (F.length(text) > MAX_DETECT_BYTES), "plaintext").when(ratio >= 0.5, "shell").otherwise(told)
    return F.coalesce(F.try_element_at(table, F.regexp_replace(F.lower(hint), "^(language-|lang-)", "")), found)


SNIPPET_PARTS = "page_id long, element_id string, language string, address string, kind string, name string, start_line int, end_line int"


def snippet_parts(elements: DataFrame) -> DataFrame:
    """Addressed parts (e12.3.1) of code snippets: elements(page_id, element_id, text, hint)."""
    rows = elements.select(F.col("page_id").cast("long").alias("page_id"), "element_id", "text", snippet_language(F.col("text"), F.col("hint")).alias("language"))
    types = [pa.int64(), *[pa.string()] * 5, pa.int32(), pa.int32()]
    names = [c.split()[0] for c in SNIPPET_PARTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page, element, text, language in zip(*(batch.column(c).to_pylist() for c in ("page_id", "element_id", "text", "language")), strict=True):
                parts = segment_rows(page, f"snippet.{language}", text or "", language) if text else []
                out += [(page, element, language, f"{element}.{r[5]}", r[6], r[7], r[10], r[11]) for r in parts if r[5]]
            columns = list(zip(*out, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(columns, types, strict=True)], names=names)

    return rows.mapInArrow(run, SNIPPET_PARTS)
