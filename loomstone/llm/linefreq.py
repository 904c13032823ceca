"""Quality rules: lines that many documents of a host share go, and documents that lose too much are rejected. DataFrame functions only.

1. Every line with a word is normalised (lower case, runs of white space as one space, runs of digits as 0) and told by
   the MD5 of host and line, 128 bits.
2. Documents of a host with one text count once, so that exact copies do not make their own lines frequent. A line is
   common where more than ``min_docs`` distinct documents of the host have it, and more than ``percent`` of the host's.
3. Common lines are removed. A document is depleted, and rejected, if that leaves under ``min_words`` words or under
   ``least`` of them.
4. Rules on the document alone come first (``base_failed``): under ``min_words`` words, or over 30 % of them in runs of
   8 words that the text holds twice or more.

Runs of 8 words are told by 64-bit hashes inside their text. Texts whose hashes are all distinct, the most, need no more;
else the hashes are sorted with their places and equal neighbours marked: n log n for a text of any length.

Counts are summed before they are shuffled. Common lines meet the documents by broadcast up to BROADCAST_LINES of them; beyond
that by shuffle, the most frequent by broadcast (``join_hot``).

Defined results: a null text has no words and fails; a null host is a host of its own; repeated rows are documents of
their own and get the same result; an empty table gives no rows. Only text and host are read; ``carry`` columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.scratch import cut, join_hot

WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"
WINDOW, MIN_WORDS, REPEAT_PERCENT = 8, 20, 30
#: A line is common above both limits; a document is depleted with less than LEAST_PERCENT of its words.
MIN_DOCS, PERCENT, LEAST_PERCENT = 20, 1, 50
#: Common lines (16 bytes each) that are broadcast at most.
BROADCAST_LINES = 1 << 20


def _let(value, body):
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words, window: int = WINDOW):
    """Words of an array that lie in runs of ``window`` words which the array holds twice or more."""

    def covered(places):
        reach = F.transform(places, lambda p, i: F.least(F.lit(window), F.coalesce(F.get(places, i + 1) - p, F.lit(window))))
        return F.aggregate(reach, F.lit(0), lambda a, x: a + x)

    def marked(ordered):
        same = lambda x, i: x["h"] == F.get(ordered, i)["h"]
        twice = F.transform(ordered, lambda x, i: F.when(F.coalesce(same(x, i - 1), F.lit(False)) | F.coalesce(same(x, i + 1), F.lit(False)), x["p"]))
        return _let(F.array_sort(F.filter(twice, lambda p: p.isNotNull())), covered)

    def of_runs(runs):
        pairs = F.transform(runs, lambda h, i: F.struct(h.alias("h"), i.alias("p")))
        return F.when(F.size(F.array_distinct(runs)) == F.size(runs), F.lit(0)).otherwise(_let(F.sort_array(pairs), marked))

    def of_hashes(hashes):
        return F.transform(F.sequence(F.lit(1), F.size(hashes) - (window - 1)), lambda i: F.xxhash64(F.slice(hashes, i, window)))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < window + 1, F.lit(0)).otherwise(_let(_let(hashed, of_hashes), of_runs)).cast("long")


def line_keys(host, lines):
    """Of each line: its key within its host (binary) and its number of words; null for a line without a word."""
    place = F.coalesce(F.concat(F.length(host), F.lit(":"), host), F.lit("-"))

    def one(line):
        plain = F.regexp_replace(F.trim(F.regexp_replace(F.lower(line), SPACES, " ")), "[0-9]+", "0")
        key = lambda p: F.unhex(F.md5(F.concat(place, F.lit("\n"), p)))
        words = lambda p: F.length(p) - F.length(F.replace(p, F.lit(" "), F.lit(""))) + 1
        return F.when(line.rlike(WORD), _let(plain, lambda p: F.struct(key(p).alias("key"), words(p).alias("words"))))

    return F.transform(lines, one)


def common_lines(described: DataFrame, min_docs: int = MIN_DOCS, percent: int = PERCENT) -> DataFrame:
    """Rows (key, times): the lines above both limits and how many distinct documents of their host have them.

    described: host_key, digest of the text, lines (key, words).
    """
    texts = described.select("host_key", "digest", F.array_compact(F.array_distinct(F.col("lines.key"))).alias("keys")).dropDuplicates(["host_key", "digest"])
    texts = cut(texts.select("host_key", "keys"), "lines-texts")
    hosts = texts.groupBy("host_key").agg(F.count("*").alias("texts"))
    counted = texts.select("host_key", F.explode("keys").alias("key")).groupBy("host_key", "key").agg(F.count("*").alias("times")).where(F.col("times") > min_docs)
    counted = cut(counted, "lines-counted")
    # ``times`` of a host: its lines among those counted.
    sized = cut(hosts.join(counted.groupBy("host_key").agg(F.count("*").alias("lines")), "host_key"), "lines-hosts")
    return join_hot(counted, sized, "host_key", "lines").where(100 * F.col("times") > percent * F.col("texts")).select("key", "times")


def line_quality(
    docs: DataFrame,
    carry: list[str] | None = None,
    host: str = "source",
    with_text: bool = True,
    min_docs: int = MIN_DOCS,
    percent: int = PERCENT,
    least: int = LEAST_PERCENT,
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """``carry`` columns (doc_id), the figures of every document, n_common_words, base_failed, kept; ``with_text``: clean_text, without common lines."""
    text = F.coalesce("text", F.lit(""))
    read = docs.select(
        F.struct(*(carry or ["doc_id"])).alias("carried"),
        F.col(host).alias("host"),
        text.alias("text"),
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"),
        F.split(text, "\n").alias("every_line"),
        F.monotonically_increasing_id().alias("row"),
    )
    read = read.withColumn("worded", F.filter("every_line", lambda x: x.rlike(WORD)))
    n = F.size("words").cast("long")
    described = read.select(
        "row",
        "carried",
        F.unhex(F.md5(F.coalesce(F.concat(F.lit("="), "host"), F.lit("")))).alias("host_key"),
        F.unhex(F.md5("text")).alias("digest"),
        n.alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("worded") - F.size(F.array_distinct("worded"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
        line_keys(F.col("host"), F.col("every_line")).alias("lines"),
        *([F.col("text")] if with_text else []),
    )
    # Written: the row numbers hold from here on.
    described = cut(described, "lines")
    common = cut(common_lines(described, min_docs, percent), "lines-common")
    met = described.select("row", F.posexplode("lines").alias("place", "line")).where("line IS NOT NULL").select("row", "place", F.col("line.key").alias("key"), F.col("line.words").alias("words"))
    if common.count() <= BROADCAST_LINES:
        found = met.join(F.broadcast(common.select("key")), "key")
    else:
        rows = cut(met.groupBy("key").agg(F.count("*").alias("rows")).join(common.select("key"), "key"), "lines-rows")
        found = join_hot(met, rows, "key", "rows")
    lost = found.groupBy("row").agg(F.sum("words").alias("lost"), *([F.collect_set("place").alias("places")] if with_text else []))
    judged = described.join(lost, "row", "left").withColumn("lost", F.coalesce("lost", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    left = F.col("n_words") - F.col("lost")
    depleted = (F.col("lost") > 0) & ((left < min_words) | (100 * left < least * F.col("n_words")))
    columns = ["carried.*", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.col("lost").alias("n_common_words"), failed.alias("base_failed"), (~failed & ~depleted).alias("kept")]
    return judged.select(*columns, *([_without(F.col("text"), F.col("places")).alias("clean_text")] if with_text else []))


def _without(text, places):
    """``text`` without the lines at ``places`` (a set of numbers from 0; null for none)."""

    def kept(lines):
        rest = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), places)
        return F.array_join(F.transform(rest, lambda i: F.get(lines, i)), "\n")

    return F.when(places.isNull(), text).otherwise(_let(F.split(text, "\n"), kept))
