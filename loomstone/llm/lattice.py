"""Filter interaction audit: how filters overlap, over every order in which they may be applied, as paths of a lattice.

1. Every document gets a mask of the filters that it fails. A class is all documents of one part with one mask.
2. An edge of the lattice is (filters already applied, next filter): 80 of them for five filters. Each class
   contributes to every edge: its documents pass, are removed here, or fail but were removed earlier.
3. An order of the filters is a path of edges; the 600 steps of the 120 orders are joined to the summed edges. Each
   edge lies on |applied|! * (others)! orders, which gives a filter's removals over all orders.

Filters here (``corpus_masks``), for a text's words (maximal runs without white space): A under 200 words; B under half
of them distinct; C over 3 % capitals; D a sign of ``#$%&*|``; E a text that a smaller doc_id of any part has.

A text is told by its SHA-256. Of a repeated text only the least doc_id is kept in a table, with its copies counted;
its rows meet that table by broadcast where the text is frequent, by shuffle otherwise. Copies leave the class without E
for the one with E (counts of -1 and +1), so rows that repeat nothing are not joined at all. Only counts of classes
go on from there: 32 rows for each part at most.

Defined results: a null text is the empty text; a null lang is the part ''; rows without doc_id are documents, but
neither have nor are a smaller doc_id and bear no label; equal doc_ids with one text do not repeat each other; of several label
rows of a doc_id any that says 1 counts; an empty table gives no rows. Only doc_id, text and lang are read.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.scratch import cut, join_hot

WORD = r"[^\x20\x09-\x0D]+"
LETTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT, SIGNS = 200, 50, 3, "[#$%&*|]"


def corpus_masks(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, part, mask, count): the filters that documents fail, as bits; sums of ``count`` are numbers of documents."""
    text = F.coalesce("text", F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    read = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"), words.alias("words"))
    n = F.size("words")
    capitals = F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))
    fails = [n < MIN_WORDS, 100 * F.size(F.array_distinct("words")) < DISTINCT_PERCENT * n, 100 * capitals > CAPITALS_PERCENT * F.length("text"), F.col("text").rlike(SIGNS)]
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    facts = cut(read.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest")), "lattice")
    copied = facts.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("times")).where("least < most").drop("most")
    repeats = cut(join_hot(facts, cut(copied, "lattice-copied"), "digest", "times").where("doc_id > least").select("doc_id", "part", "mask"), "lattice-repeats")
    once = F.lit(1).cast("long")
    moved = [repeats.select("doc_id", "part", "mask", -once), repeats.select("doc_id", "part", F.col("mask") + (1 << len(fails)), once)]
    return facts.select("doc_id", "part", "mask", once.alias("count")).union(moved[0]).union(moved[1])


def classes(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (part, mask, n, good, toxic) of documents by mask; labels: doc_id, quality and toxic."""
    said = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    known = labels.where("quality = 1 OR toxic = 1").groupBy("doc_id").agg(said("quality").alias("good"), said("toxic").alias("toxic"))
    zero = F.lit(0).cast("long")
    counts = masks.groupBy("part", "mask").agg(F.sum("count").alias("n")).select("part", "mask", "n", zero.alias("good"), zero.alias("toxic"))
    lost = masks.join(known, "doc_id").groupBy("part", "mask").agg(F.sum(F.col("count") * F.col("good")).alias("good"), F.sum(F.col("count") * F.col("toxic")).alias("toxic"))
    both = counts.union(lost.select("part", "mask", zero, "good", "toxic"))
    return both.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))


def lattice_edges(by_mask: DataFrame, n_filters: int = len(LETTERS)) -> DataFrame:
    """Rows (part, applied, bit, paths, kept, removed, redundant, unique_fails, good_lost, toxic_lost): every edge of every part."""
    all_edges = [(s, 1 << f, factorial(s.bit_count()) * factorial(n_filters - 1 - s.bit_count())) for f in range(n_filters) for s in range(1 << n_filters) if not s >> f & 1]
    edge = F.explode(F.array(*(F.struct(F.lit(s).alias("applied"), F.lit(b).alias("bit"), F.lit(p).alias("paths")) for s, b, p in all_edges))).alias("edge")
    met = by_mask.select("*", edge).select("*", "edge.*")
    reached = F.col("mask").bitwiseAND(F.col("applied")) == 0
    fails = F.col("mask").bitwiseAND(F.col("bit")) != 0
    total = lambda condition, c="n": F.sum(F.when(condition, F.col(c)).otherwise(0))
    return met.groupBy("part", "applied", "bit", "paths").agg(
        total(reached & ~fails).alias("kept"),
        total(reached & fails).alias("removed"),
        total(~reached & fails).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(reached & fails, "good").alias("good_lost"),
        total(reached & fails, "toxic").alias("toxic_lost"),
    )


def audit(masks: DataFrame, labels: DataFrame, letters: str = LETTERS) -> DataFrame:
    """Every step of every order of the filters, for every part: counts at the step, and the filter's removals over all orders.

    masks: doc_id, part, mask, count. The table of steps has len(letters)! * len(letters) rows, whatever the data.
    """
    edges = cut(lattice_edges(classes(masks, labels), len(letters)), "lattice-edges")
    over_all = edges.groupBy("part", "bit").agg(F.sum(F.col("removed") * F.col("paths")).alias("shapley"))
    steps = [
        ("".join(letters[f] for f in order), i + 1, sum(1 << f for f in order[:i]), 1 << order[i])
        for order in permutations(range(len(letters)))
        for i in range(len(letters))
    ]
    paths = masks.sparkSession.createDataFrame(steps, "filter_order string, step int, applied int, bit int")
    found = edges.join(F.broadcast(paths), ["applied", "bit"]).join(over_all, ["part", "bit"])
    return found.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
