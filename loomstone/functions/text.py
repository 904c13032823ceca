"""Column functions over text: token estimates, lines, letters, paths, word roots, SQL verbs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Statement verbs that read or write, and those that a SQL string may begin with.
READ_VERBS = ("SELECT", "WITH", "PRAGMA", "EXPLAIN", "ANALYZE")
WRITE_VERBS = ("INSERT", "UPDATE", "DELETE", "REPLACE", "CREATE", "ALTER", "DROP", "TRUNCATE", "MERGE", "UPSERT")
LEADING_COMMENTS = r"^(?:\s|--[^\n]*\n|/\*(?s:.*?)\*/)*"
#: Fixed pattern: endings dropped to get a word's root.
ROOT_ENDINGS = r"(ations?|ments?|ings?|ed|es|s|ly)$"
BYTES_PER_TOKEN = 3.7


def file_tokens(content: Column) -> Column:
    """Estimated tokens of a file: bytes / 3.7, rounded up."""
    return F.ceil(F.octet_length(content) / BYTES_PER_TOKEN).cast("long")


def response_tokens(text: Column) -> Column:
    """Estimated tokens of a response: characters / 4, rounded up."""
    return F.ceil(F.length(text) / 4).cast("long")


def page_tokens(text: Column) -> Column:
    """Estimated tokens of a page: characters / 4, half up."""
    return F.floor(F.length(text) / 4 + 0.5).cast("long")


def line_count(text: Column) -> Column:
    """0 for empty text, otherwise newlines + 1."""
    return F.when(F.length(text) == 0, 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")


def line_of(text: Column, position: Column) -> Column:
    """1-based line of a 1-based character position."""
    before = F.substring(text, F.lit(1), position - 1)
    return (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("long")


def ellipsis(text: Column, limit: int = 60, mark: str = "...") -> Column:
    """Text cut to ``limit`` characters, the mark included."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - len(mark)), F.lit(mark))).otherwise(text)


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def fold_blank_lines(text: Column) -> Column:
    """Runs of blank lines become one, and none stands at an end."""
    return F.regexp_replace(F.regexp_replace(text, r"\n(?:[ \t]*\n)+", "\n\n"), r"^\s+|\s+$", "")


def letters(index: Column) -> Column:
    """0 -> a, 25 -> z, 26 -> aa: bijective base 26, for every index of a long (14 letters at most)."""
    n = index.cast("long") + 1
    # Digits from the last one: each takes (n - 1) mod 26 and leaves (n - 1) div 26.
    start = F.struct(n.alias("n"), F.lit("").alias("out"))

    def step(state: Column, _: Column) -> Column:
        left = state["n"] - 1
        more = F.struct(F.floor(left / 26).cast("long").alias("n"), F.concat(F.char((left % 26 + 97).cast("int")), state["out"]).alias("out"))
        return F.when(state["n"] > 0, more).otherwise(state)

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step, lambda s: s["out"]))


def letter_index(text: Column) -> Column:
    """The inverse of ``letters``."""
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda a, c: a * 26 + F.ascii(c) - 96) - 1


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(F.lit(""))


def extension(path: Column) -> Column:
    """Lower-case suffix with its dot; empty for none and for dot files."""
    return F.lower(F.regexp_extract(basename(path), r"[^.](\.[^.]*)$", 1))


def word_root(word: Column) -> Column:
    return F.regexp_replace(word, ROOT_ENDINGS, "")


def leading_verb(sql: Column) -> Column:
    """First word behind comments, in capitals; null if there is none."""
    verb = F.upper(F.regexp_extract(F.regexp_replace(sql, LEADING_COMMENTS, ""), r"^\s*([A-Za-z]+)", 1))
    return F.when(verb != "", verb)


def verb_class(sql: Column, is_dynamic: Column) -> Column:
    """read, write or dynamic; null for a static statement with another verb."""
    verb = leading_verb(sql)
    return F.when(verb.isin(*READ_VERBS), "read").when(verb.isin(*WRITE_VERBS), "write").when(is_dynamic, "dynamic")


def looks_like_sql(text: Column) -> Column:
    """A string of six characters or more that begins with a statement verb."""
    verbs = "|".join(sorted({*READ_VERBS, *WRITE_VERBS} - {"ANALYZE", "UPSERT"}))
    return (F.length(F.trim(text)) >= 6) & text.rlike(rf"(?i)^\s*({verbs})\b")


def natural_key(address: Column) -> Column:
    """Sort key of a dotted address: parts by kind (letters first), length and text."""
    return F.transform(F.split(address, r"\."), lambda p: F.struct(p.rlike("^[0-9]").alias("digit"), F.length(p).alias("n"), p.alias("part")))


def prefixes(parts: Column) -> Column:
    """All prefixes of an array, shortest first."""
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.slice(parts, F.lit(1), n))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def grouped_number(number: Column) -> Column:
    """A whole number with commas between groups of three digits."""
    return F.format_number(number, 0)


def padded(text: Column, width: int, fill: str = " ") -> Column:
    """``text`` with ``fill`` in front up to ``width``; longer texts stay whole."""
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, fill))


def glob_match(path: Column, pattern: str) -> Column:
    """Whether a path matches a GLOB pattern: * and ? stand for any characters, [...] for one of a set ([^...] for one outside it)."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c in "*?":
            out += ".*" if c == "*" else "."
        elif end > 0:
            inside = pattern[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[")
            out, i = f"{out}[{inside}]", end
        else:
            out += "\\" + c if not c.isalnum() else c
        i += 1
    return path.rlike(f"(?s)^{out}$")


def relative_path(path: Column, folder: Column) -> Column:
    """``path`` seen from ``folder`` (both absolute and without dots): up to the common folder, then down."""
    a, b = F.split(path, "/"), F.split(folder, "/")
    pairs = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    shared = F.aggregate(pairs, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, same: F.struct((s["n"] + (s["on"] & same).cast("int")).alias("n"), (s["on"] & same).alias("on")), lambda s: s["n"])
    down = F.slice(a, shared + 1, F.greatest(F.size(a) - shared, F.lit(0)))
    return F.array_join(F.concat(F.array_repeat(F.lit(".."), F.size(b) - shared), down), "/")


def let(value, body):
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]
