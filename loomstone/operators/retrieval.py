"""Search over page elements: structure by windows, the word ladder, meaning by vectors, skeletons and outlines."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions.text import page_tokens, word_root
from loomstone.operators.relational import running
from loomstone.sources.scratch import cut

#: Fixed values of meaning search: least z-score, spread below the best, most results, rerank candidates.
MEANING_Z, MEANING_SPREAD, MEANING_MAX, RERANK = 2.5, 0.1, 10, 20
TOKEN_LIMIT = 3000
LADDER = ("exact phrase", "all words", "word", "meaning", "any word", "word root")
OUTLINE_KINDS = ("main", "navigation", "nav", "sidebar", "aside", "region", "header", "footer", "section", "article", "form")


# Structure.
STRUCTURE = "has_children boolean, end_ord int, parent_ord int, heading string, items_below int, links_below int"


def _structure_of(depth: list[int], kind: list[str], label: list[str | None], link: list[bool]) -> list[list]:
    """The columns of STRUCTURE for the elements of one page in order: one pass with the elements that are open."""
    n = len(depth)
    end, parent, heading = [n - 1] * n, [None] * n, [None] * n
    items, links, open_, last = [0], [0], [], None
    for i in range(n):
        while open_ and depth[open_[-1]] >= depth[i]:
            end[open_.pop()] = i - 1
        parent[i], heading[i] = open_[-1] if open_ else None, last
        open_.append(i)
        last = label[i] if kind[i] == "heading" and label[i] is not None else last
        items.append(items[-1] + (kind[i] == "item"))
        links.append(links[-1] + link[i])
    below = lambda sums: [sums[e + 1] - sums[i + 1] for i, e in enumerate(end)]
    return [[e > i for i, e in enumerate(end)], end, parent, heading, below(items), below(links)]


def with_structure(elements: DataFrame) -> DataFrame:
    """Adds to elements (ord from 0 on each page): has_children, end_ord (last element of the subtree), parent_ord, heading (the
    last one before), and how many items and links lie below. One shuffle by page; a page is held at a time."""
    names = elements.columns
    added = [c.split() for c in STRUCTURE.split(", ")]
    types = {"boolean": pa.bool_(), "int": pa.int32(), "string": pa.string()}
    sample = elements.select("*", *(F.lit(None).cast(t).alias(c) for c, t in added))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def finish() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            col = lambda c: table.column(c).to_pylist()
            page, depth, kind, label = (col(c) for c in ("page_id", "depth", "kind", "label"))
            link = [k == "link" or (c and d is not None) for k, c, d in zip(kind, col("clickable"), col("dest"), strict=True)]
            columns: list[list] = [[] for _ in added]
            edges = [0, *(i for i in range(1, len(page)) if page[i] != page[i - 1]), len(page)]
            for a, b in zip(edges, edges[1:], strict=False):
                for column, found in zip(columns, _structure_of(depth[a:b], kind[a:b], label[a:b], link[a:b]), strict=True):
                    column += found
            arrays = [pa.array(c, type=types[t]) for c, (_, t) in zip(columns, added, strict=True)]
            yield from pa.Table.from_arrays([*table.columns, *arrays], names=[*names, *(c for c, _ in added)]).to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            page = batch.column("page_id").to_pylist()
            # Rows of the last page wait for those that may follow.
            last = next((i + 1 for i in range(len(page) - 2, -1, -1) if page[i] != page[-1]), 0)
            if last or (held and held[-1].column("page_id")[-1].as_py() != page[0]):
                held.append(batch.slice(0, last))
                yield from finish()
                held = []
            held.append(batch.slice(last))
        if held:
            yield from finish()

    return elements.repartition("page_id").sortWithinPartitions("page_id", "ord").mapInArrow(run, sample.schema)


#: Rows of a stated query set that go to every executor.
STATED_ROWS = 10_000


def against(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """All ``rows`` with every row of a stated query set, STATED_ROWS of them broadcast at a time, each in a pass of its own."""
    n = queries.count()
    if n <= STATED_ROWS:
        return rows.join(F.broadcast(queries))
    placed = cut(running(queries.withColumn("_own", F.monotonically_increasing_id()), ["_own"], place="_place").drop("_own"), "stated")
    passes = [placed.where((F.col("_place") > at) & (F.col("_place") <= at + STATED_ROWS)).drop("_place") for at in range(0, n, STATED_ROWS)]
    return functools.reduce(DataFrame.union, [rows.join(F.broadcast(p)) for p in passes])


# Words.
def search_ladder(elements: DataFrame, queries: DataFrame, meaning: DataFrame | None = None) -> DataFrame:
    """Matches of queries(query_id, query) on every page by the first rung that finds something there.

    elements need structure; meaning: (query_id, page_id, element_id) of vector search. Containers whose
    match lies in a child are dropped. Rows: query_id, page_id, ord, element_id, rung.
    """
    q = F.trim(F.regexp_replace(F.lower("query"), r"\s+", " "))
    words = F.filter(F.split(q, " "), lambda w: F.length(w) > 2)
    roots = F.filter(F.transform(words, word_root), lambda r: F.length(r) >= 4)
    asked = queries.select("query_id", q.alias("q"), words.alias("words"), roots.alias("roots"))
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    full = F.lower(F.concat_ws(" ", blank("label"), blank("summary"), blank("text")))
    own = F.when(F.col("has_children"), F.lower(F.concat_ws(" ", blank("label"), blank("summary")))).otherwise(full)
    rows = elements.select("page_id", "ord", "element_id", "depth", "end_ord", full.alias("full"), own.alias("own"))
    # The stated queries against all elements: the queries are the small side.
    pairs = against(rows, asked)
    several, phrase = F.size("words") >= 2, F.col("q").contains(" ")
    hits = [
        phrase & F.col("full").contains(F.col("q")),
        several & F.forall("words", lambda w: F.col("own").contains(w)),
        (F.col("q") != "") & ~phrase & F.col("full").contains(F.col("q")),
        F.lit(False),
        several & F.exists("words", lambda w: F.col("full").contains(w)),
        F.exists("roots", lambda r: F.col("full").contains(r)),
    ]
    if meaning is not None:
        pairs = pairs.join(meaning.select("query_id", "page_id", "element_id", F.lit(True).alias("meant")), ["query_id", "page_id", "element_id"], "left")
        hits[3] = F.coalesce("meant", F.lit(False))
    found = pairs.select("query_id", "page_id", "ord", "element_id", "end_ord", F.explode(F.array_compact(F.array(*(F.when(h, F.lit(i)) for i, h in enumerate(hits))))).alias("rung"))
    first = F.min("rung").over(Window.partitionBy("query_id", "page_id"))
    kept = found.withColumn("first", first).where("rung = first").drop("first")
    following = F.min("ord").over(Window.partitionBy("query_id", "page_id").orderBy("ord").rowsBetween(1, 1))
    specific = kept.withColumn("inner", following).where("inner IS NULL OR inner > end_ord").drop("inner", "end_ord")
    return specific.withColumn("rung", F.element_at(F.array(*map(F.lit, LADDER)), F.col("rung") + 1))


def match_ancestors(matches: DataFrame, elements: DataFrame) -> DataFrame:
    """(query_id, page_id, ord) of every element that holds a match (elements with structure)."""
    spans = elements.where("has_children").select("page_id", "ord", "end_ord")
    inside = matches.select("query_id", "page_id", F.col("ord").alias("hit")).join(spans, "page_id").where("hit > ord AND hit <= end_ord")
    return inside.select("query_id", "page_id", "ord").distinct()


# Vectors.
def pack_vector(vector, dims: int):
    """Truncate, scale to length one, times 127, round half up, clamp to a signed byte."""
    cut = F.transform(F.slice(vector, 1, dims), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(cut, F.lit(0.0), lambda a, x: a + x * x))
    norm = F.when(norm == 0, 1.0).otherwise(norm)
    return F.transform(cut, lambda x: F.greatest(F.lit(-128), F.least(F.lit(127), F.floor(x / norm * 127 + 0.5))).cast("tinyint"))


def cosine(a, b):
    """Cosine in double precision; a zero vector counts as length one."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    safe = lambda n: F.when(n == 0, 1.0).otherwise(n)
    return dot / (safe(norm(a)) * safe(norm(b)))


def meaning_matches(vectors: DataFrame, queries: DataFrame, z: float = MEANING_Z, spread: float = MEANING_SPREAD, most: int = MEANING_MAX, skip_equal: bool = False) -> DataFrame:
    """For each query and page: elements whose best cosine stands out from the page's (population z-score).

    vectors(page_id, element_id, vector), queries(query_id, vector): the queries are the small side.
    ``skip_equal``: an element is not compared with the query of its own id.
    """
    asked = queries.select("query_id", F.col("vector").alias("wanted"))
    pairs = against(vectors, asked)
    scored = (pairs.where("query_id <> element_id") if skip_equal else pairs).select("query_id", "page_id", "element_id", cosine(F.col("wanted"), F.col("vector")).alias("s"))
    best = scored.groupBy("query_id", "page_id", "element_id").agg(F.max("s").alias("score"))
    page = Window.partitionBy("query_id", "page_id")
    sd = F.stddev_pop("score").over(page)
    rated = best.withColumn("z", (F.col("score") - F.avg("score").over(page)) / F.when(sd == 0, 1.0).otherwise(sd)).withColumn("top", F.max("score").over(page))
    kept = rated.where((F.col("z") >= z) & (F.col("score") >= F.col("top") - spread)).drop("top")
    return kept.withColumn("rank", F.row_number().over(page.orderBy(F.desc("score"), "element_id"))).where(F.col("rank") <= most)


def page_similarity(scores: DataFrame) -> DataFrame:
    """Mean and population deviation of scores by query and page; a deviation of zero counts as one."""
    sd = F.stddev_pop("score")
    return scores.groupBy("query_id", "page_id").agg(F.avg("score").alias("mean"), F.when(sd == 0, 1.0).otherwise(sd).alias("sd"))


def embed_jobs(elements: DataFrame) -> DataFrame:
    """One job for each distinct (heading, text), with the elements that share it counted."""
    return elements.groupBy(F.coalesce("heading", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("body")).agg(F.count("*").alias("n_elements"))


#: Tokens of a text that one vector stands for.
PIECE_TOKENS = 1800


def embed_pieces(elements: DataFrame, tokens: int = PIECE_TOKENS) -> DataFrame:
    """Texts to embed: (page_id, element_id, piece_no, title, piece), long ones in pieces of at most ``tokens`` (four characters each)."""
    size, body = tokens * 4, F.coalesce("text", F.lit(""))
    starts = F.sequence(F.lit(0), F.floor(F.greatest(F.length(body) - 1, F.lit(0)) / size).cast("int"))
    rows = elements.select("page_id", "element_id", F.coalesce("heading", F.lit("")).alias("title"), body.alias("body"), F.explode(starts).alias("piece_no"))
    return rows.select("page_id", "element_id", "piece_no", "title", F.expr(f"substring(body, piece_no * {size} + 1, {size})").alias("piece"))


def vector_text(vector):
    """Base64 of a packed vector's signed bytes."""
    return F.base64(F.unhex(F.array_join(F.transform(vector, lambda x: F.lpad(F.hex(F.pmod(x.cast("int"), F.lit(256))), 2, "0")), "")))


def text_vector(text):
    """The packed vector of its base64 text."""
    h = F.hex(F.unbase64(text))
    byte = lambda i: F.conv(F.substr(h, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
    signed = lambda v: F.when(v > 127, v - 256).otherwise(v).cast("tinyint")
    return F.when(F.length(h) == 0, F.array().cast("array<tinyint>")).otherwise(F.transform(F.sequence(F.lit(0), (F.length(h) / 2 - 1).cast("int")), lambda i: signed(byte(i))))


# Greedy budgets.
def greedy_fit(rows: DataFrame, keys: list[str], order: str, size: str, budget: int) -> DataFrame:
    """Rows in order that still fit the group's budget; one that does not fit is passed over, later ones may fit."""
    names, schema = rows.columns, rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, left = None, 0
        for batch in batches:
            keep = []
            for *own, n in zip(*(batch.column(c).to_pylist() for c in [*keys, size]), strict=True):
                if own != key:
                    key, left = own, budget
                keep.append(n <= left)
                left -= n if n <= left else 0
            yield batch.filter(pa.array(keep, type=pa.bool_()))

    return rows.repartition(*keys).sortWithinPartitions(*keys, order).select(*names).mapInArrow(run, schema)


def prefix_fit(rows: DataFrame, keys: list[str], order: str, size: str, budget: int) -> DataFrame:
    """Rows in order up to the first that exceeds the group's budget."""
    so_far = F.sum(size).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_used", so_far).where(F.col("_used") <= budget).drop("_used")


def greedy_batches(rows: DataFrame, keys: list[str], order: str, size: str, limit: int) -> DataFrame:
    """``batch`` number of each row: a batch closes before the row that would exceed its limit."""
    names = rows.columns
    schema = rows.withColumn("batch", F.lit(0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, used, number = None, 0, 0
        for part in batches:
            numbers = []
            for *own, n in zip(*(part.column(c).to_pylist() for c in [*keys, size]), strict=True):
                if own != key:
                    key, used, number = own, 0, 0
                elif used and used + n > limit:
                    used, number = 0, number + 1
                used += n
                numbers.append(number)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(numbers, type=pa.int32())], names=[*names, "batch"])

    return rows.repartition(*keys).sortWithinPartitions(*keys, order).select(*names).mapInArrow(run, schema)


# Skeletons.
def _line(indent, mark, shown):
    click = F.when(F.col("clickable"), F.lit("● ")).otherwise(F.lit("○ "))
    return F.concat(indent, click, F.lit("["), F.col("element_id"), F.lit("] "), shown, mark)


def skeleton_lines(elements: DataFrame) -> DataFrame:
    """Lines of the page skeleton (elements with structure): page_id, ord, line, collapsed (elements it stands for).

    Navigation, footers and opened buttons with three or more elements below become one line, code blocks
    always do; leaves without label, target or text are left out.
    """
    page = Window.partitionBy("page_id").orderBy("ord")
    below = F.col("end_ord") - F.col("ord")
    drop = F.col("kind").isin("button", "summary") & F.col("clickable") & F.col("has_children")
    type_ = F.when(F.col("kind") == "navigation", "nav").when(F.col("kind") == "footer", "footer").when(drop, "dropdown")
    rows = elements.withColumn("fold", F.when(type_.isNotNull() & (below >= 3), type_).when(F.col("kind") == "code", "code"))
    covered = F.max(F.when(F.col("fold").isNotNull(), F.col("end_ord"))).over(page.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("hidden", F.coalesce(covered >= F.col("ord"), F.lit(False)))
    shown = rows.where("NOT hidden").withColumnsRenamed({"items_below": "items", "links_below": "links"})
    first = lambda a, b: F.when(F.col(a) > 0, F.col(a)).otherwise(F.col(b))
    count = F.when(F.col("fold") == "dropdown", first("items", "links")).when(F.col("fold") == "code", F.size(F.split("text", "\n")).cast("long")).otherwise(first("links", "items"))
    unit = F.when(F.col("fold") == "code", "lines").when(F.col("fold") == "dropdown", "items").otherwise("links")
    indent = F.repeat(F.lit("  "), F.col("depth"))
    label = F.when(F.col("label") != "", F.concat(F.lit(' "'), F.col("label"), F.lit('"'))).otherwise("")
    target = F.when(F.col("dest").isNotNull(), F.concat(F.lit(" → "), F.col("dest"))).otherwise("")
    useful = F.col("summary").isNotNull() & (F.length("summary") > 5)
    under = F.when(~F.col("has_children") & useful & (F.col("summary") != F.col("label")), F.concat(F.lit("\n"), indent, F.lit("  └ "), F.col("summary"))).otherwise("")
    named = F.when(F.col("label") != "", F.col("label")).otherwise(F.col("kind"))
    folded = _line(indent, F.lit(""), F.concat(F.col("fold"), F.lit(' "'), named, F.lit('" ('), count, F.lit(" "), unit, F.lit(")")))
    line = F.when(F.col("fold").isNotNull(), folded).otherwise(F.concat(_line(indent, F.lit(""), F.concat(F.col("kind"), label, target)), under))
    empty = ~F.col("has_children") & F.col("dest").isNull() & ((F.col("label") == "") | (F.col("label") == "[image]")) & ~useful & F.col("fold").isNull()
    return shown.where(~empty).select("page_id", "ord", line.alias("line"), F.when(F.col("fold").isNotNull(), F.col("end_ord") - F.col("ord")).otherwise(0).cast("int").alias("collapsed"))


def skeletons(lines: DataFrame) -> DataFrame:
    """One text for each page from its lines, with its estimated tokens."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy("page_id").agg(joined.alias("skeleton"), F.count("*").alias("n_lines"), F.sum("collapsed").cast("long").alias("collapsed")).withColumn("tokens", page_tokens(F.col("skeleton")))


def outline(elements: DataFrame, budget_chars: int = TOKEN_LIMIT * 4) -> DataFrame:
    """Headings and landmarks of depth two or less; where fewer than five fit, labelled links, too."""
    mark = (F.col("kind") == "heading") | (F.col("kind").isin(*OUTLINE_KINDS) & (F.col("depth") <= 2))
    label = F.when(F.col("label") != "", F.concat(F.lit(' "'), F.col("label"), F.lit('"'))).otherwise("")
    line = F.concat(F.repeat(F.lit("  "), F.least("depth", F.lit(6))), F.lit("["), F.col("element_id"), F.lit("] "), F.col("kind"), label)
    rows = elements.where(mark).select("page_id", "ord", line.alias("line"), (F.length(line) + 1).alias("size"))
    marks = greedy_fit(rows, ["page_id"], "ord", "size", budget_chars)
    few = elements.select("page_id").distinct().join(marks.groupBy("page_id").agg(F.count("*").alias("n"), F.sum("size").alias("used")), "page_id", "left").fillna(0).where("n < 5")
    to = F.concat(F.lit("  ["), F.col("element_id"), F.lit("] "), F.col("kind"), label, F.when(F.col("dest").isNotNull(), F.concat(F.lit(" → "), F.col("dest"))).otherwise(""))
    links = elements.where("clickable AND label <> ''").join(few, "page_id").select("page_id", (F.col("ord") + (1 << 20)).alias("ord"), to.alias("line"), (F.length(to) + 1).alias("size"))
    return marks.union(greedy_fit(links, ["page_id"], "ord", "size", budget_chars)).drop("size")


def savings(raw, reduced):
    """Struct of per cent saved (half up) and ratio; null ratio without raw tokens."""
    percent = F.when(raw > 0, F.floor((1 - reduced / raw) * 100 + 0.5)).otherwise(0).cast("long")
    return F.struct(percent.alias("percent"), F.when(raw > 0, F.round(raw / reduced, 1)).alias("ratio"))


