"""Mixing sources to target weights with a low-discrepancy slot schedule. DataFrame functions only.

1. Sizes are words; a source's target is its share by weight of ``budget`` times all words, at most
   ``repeats`` times its own words, the excess shared again by weight (closed form: sources in order of
   cap by weight; the first whose level lies below its cap sets the level of all that are not capped).
2. Slot j of the mix takes the source in whose interval of cumulative targets the point
   (j * golden ratio) mod 1 falls, in whole numbers of 2^31 points; slots are ranked within their source (counts
   of chunks of slots first, then places inside a chunk). A source whose target the schedule leaves open
   gets its few missing slots behind the last.
3. A source's documents, in hashed order, are one long sequence of words, repeated as often as needed and cut into
   blocks of ``block`` words; block r joins the source's slot of rank r. A document takes the words that its
   blocks' slots cover; the last slot stops at the target.

Orders over all sources, chunks and documents are taken by ranges (``running``), so no task holds all sources, or
all rows of a source, and no part grows with the data.

Nothing is random: the order comes from hashes of doc_id and text, so reruns agree. Defined results: a null text
has size 0 and takes nothing; the null source is a source, last in order; repeated rows and null doc_ids
are documents of their own; an empty table gives no rows. Only doc_id, source and text are read; ``carry``
columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.llm.scratch import cut, discard_since, join_hot, sweep, written
from loomstone.operators.relational import running

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
REPEATS = 2
BLOCK_WORDS = 256
WORD = r"[^\x20\x09-\x0D]+"
#: Points of the schedule, the golden ratio among them (odd, so that 2^31 slots meet every point once), slots of a chunk.
POINTS, GOLDEN, CHUNK = 1 << 31, 1327217885, 1 << 11


def word_count(text):
    """Words of a text column; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS) -> DataFrame:
    """sizes: one row for each source (source, source_size). Adds s (number in order of code points, null last), start (words of the sources before) and target."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("s") % len(weights) + 1).cast("int"))
    rows = running(sizes, [F.isnull("source"), F.col("source")], {"start": "source_size"}).withColumn("s", F.col("place") - 1).drop("place")
    rows = rows.withColumn("weight", weight).withColumn("cap", F.lit(repeats) * F.col("source_size"))
    rows = running(rows, [F.col("cap") / F.col("weight"), F.col("s")], {"capped": "cap", "before": "weight"})
    whole = rows.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    level = (F.lit(budget) * F.lit(whole["words"] or 0) - F.col("capped")) / (F.lit(whole["weight"] or 0) - F.col("before"))
    # One row: the level of all sources that are not capped.
    first = rows.withColumn("level", level).where(F.col("level") <= F.col("cap") / F.col("weight")).agg(F.min_by("level", "place")).first()[0]
    shared = F.col("cap").cast("double") if first is None else F.least(F.col("cap").cast("double"), F.lit(first) * F.col("weight"))
    return rows.select("s", "source", "source_size", "start", shared.alias("target"))


def schedule(sources: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """sources: (s, target, words). Rows (s, rank): the slots of the mix, ranked within their source."""
    spark = sources.sparkSession
    spaces = running(sources.where("words > 0").select("s", "words"), ["s"], {"before": "words"})
    sums = spaces.agg(F.sum("words").alias("words"), F.count("*").alias("n")).first()
    total = sums["words"] or 0
    point = lambda words: F.floor(words / F.lit(float(max(total, 1))) * POINTS)
    spaces = spaces.withColumn("lower", point(F.col("before"))).withColumn("upper", point(F.col("before") + F.col("words")))
    x = F.col("id").bitwiseAND(F.lit(POINTS - 1)) * F.lit(GOLDEN) % POINTS
    slots = spark.range(0, -(-total // block), 1).select(F.col("id").alias("slot"), x.alias("x"))
    # The interval of a point: the sources are listed under every cell of points that they touch, several cells for each source.
    cell = max(1, POINTS >> max(10, (4 * sums["n"]).bit_length()))
    listed = spaces.where("lower < upper").select("s", "lower", "upper", F.explode(F.sequence(F.floor(F.col("lower") / cell), F.floor((F.col("upper") - 1) / cell))).alias("cell"))
    taken = slots.withColumn("cell", F.floor(F.col("x") / cell)).join(listed, "cell").where("x >= lower AND x < upper").select("s", "slot", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    # Slots before a chunk, of its source: of all sources' chunks in order, less those of the sources before.
    counts = running(taken.groupBy("s", "chunk").agg(F.count("*").alias("n")), ["s", "chunk"], {"before": "n"})
    scheduled = cut(counts.groupBy("s").agg(F.sum("n").alias("scheduled"), F.min("before").alias("start"), F.count("*").alias("chunks")), "mixing-scheduled")
    base = join_hot(counts, scheduled.select("s", "start", "chunks"), "s", "chunks").select("s", "chunk", (F.col("before") - F.col("start")).alias("base"))
    place = F.row_number().over(Window.partitionBy("s", "chunk").orderBy("slot")) - 1
    ranked = taken.withColumn("place", place).join(base, ["s", "chunk"]).select("s", (F.col("base") + F.col("place")).alias("rank"))
    needed = F.ceil(F.col("words") / block).cast("long")
    missing = (
        spaces.join(scheduled, "s", "left")
        .withColumn("n", F.coalesce("scheduled", F.lit(0).cast("long")))
        .where(needed > F.col("n"))
        .select("s", F.explode(F.sequence(F.col("n"), needed - 1)).alias("rank"))
    )
    return ranked.union(missing)


def mix(docs: DataFrame, carry: list[str] | None = None, weights: tuple = WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS, block: int = BLOCK_WORDS) -> DataFrame:
    """``carry`` columns (doc_id), size, source_size, target and taken of every document."""
    carry, mark = carry or ["doc_id"], written()
    key = F.when(F.col("source").isNotNull(), F.concat(F.lit("="), "source")).otherwise("").alias("key")
    sized = docs.select(F.struct(*carry).alias("carried"), "source", key, word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("h"), F.monotonically_increasing_id().alias("row"))
    sized = cut(sized, "mixing")  # row stays: it tells equal documents apart, whose order does not matter
    sources = cut(sized.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("n")), "mixing-sources")
    # The target in whole words.
    known = cut(targets(sources.select("source", "source_size"), weights, budget, repeats).withColumn("words", F.round("target").cast("long")).withColumn("key", key), "mixing-targets")
    named = cut(known.select("key", "s", "source_size", "start", "target", "words").join(sources.select("key", "n"), "key"), "mixing-known")
    placed = join_hot(sized.select("key", "carried", "size", "h", "row"), named, "key", "n").drop("key")
    # Place of a document in its source's sequence: words before it of all documents by source, less those of the sources before.
    at = running(placed, ["s", "h", "size", "row"], {"before": "size"})
    at = at.withColumn("begin", F.col("before") - F.col("start"))
    # Blocks that a document meets in each repeat of the sequence, as far as the target goes.
    met = at.where("size > 0 AND begin < words").select("row", "s", "size", "source_size", "words", "begin", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("words") - F.col("begin") - 1) / F.col("source_size")))).alias("round"))
    met = met.withColumn("a", F.col("begin") + F.col("round") * F.col("source_size")).withColumn("b", F.least(F.col("a") + F.col("size"), F.col("words")))
    met = met.select("row", "s", "a", "b", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor((F.col("b") - 1) / block))).alias("rank"))
    covered = F.least(F.col("b"), (F.col("rank") + 1) * block) - F.greatest(F.col("a"), F.col("rank") * block)
    words = met.withColumn("covered", covered).join(schedule(known, block), ["s", "rank"]).groupBy("row").agg(F.sum("covered").alias("taken"))
    out = cut(at.select("row", "carried", "size", "source_size", "target").join(words, "row", "left"), "mixing-taken")
    discard_since(docs.sparkSession, mark, out)
    sweep(docs.sparkSession)
    return out.select("carried.*", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
