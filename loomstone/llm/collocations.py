"""Phrase collocations by level-wise passes: longer phrases are counted only where both shorter ones in them are frequent.

1. Texts are lower-cased (A-Z), cut at sentence marks and line ends into pieces, and those into words. Everything is per
   language. Pass 1 counts words; pass k emits a phrase of k words only if the phrases of its first and of its last k-1
   words are frequent, which no frequent phrase escapes.
2. The frequent phrases of a level go to the tasks as one bitmap of their hashes, of 32 bits for each phrase and
   MOST_BITS at most (32 MB), however many there are. A bit that another phrase has set only lets a phrase be counted
   in vain; what is frequent is decided by the counts, which are keyed by the phrases themselves.
3. A cut of a phrase in two has its counts in the tables of the lower levels. Its score is floor(scale * a * n / (l * r)) in
   whole numbers of 38 digits; the lowest cut counts.
4. A phrase inside a longer one that occurs as often is dropped. Of the longer ones those of one word more suffice: if any
   longer one occurs often enough, so does the one between.

Tasks sum equal phrases of a pass (told by hash, length and first eight bytes) before they give rows, Spark sums again
before its shuffle, so a frequent phrase is a few rows of each task. Phrases are ranked by ranges of their order, so no task ranks all of a language.

Defined results: a null text has no words; a null language is ``und`` (so is the language of that name); repeated rows count
repeatedly; a language without frequent phrases gives no rows, as does an empty table. Only text and lang are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.scratch import cut, small_batches
from loomstone.llm.textcore import class_table, combine, first_bytes, passes, run_hashes, scan, word_hashes
from loomstone.operators.relational import running

LONGEST, FREQUENT, SCALE, TOP, CONTAINED_PERCENT = 5, 100, 1000, 2000, 100
BREAKS = ".,;:!?\n\x0b\x0c\r"
_BREAK = ~class_table(BREAKS)
_WORDS = class_table(" \t" + BREAKS)
#: Bits of the bitmap for each phrase, fewest and most bits.
BITS_EACH, LEAST_BITS, MOST_BITS = 32, 1 << 16, 1 << 28
#: Bytes of text that a task counts at once, and rows of a batch that it gives.
PASS, ROWS = 8 << 20, 1 << 16
#: Languages whose totals are broadcast at most.
BROADCAST_LANGUAGES = 100_000
COUNTS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])


def _languages(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages of a batch, the number of each row's, and a hash for each language."""
    coded = column.fill_null("und").dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    names = coded.dictionary.to_pylist()
    hashes = word_hashes(scan(pa.array([f"={x}" for x in names], pa.string()), np.ones(256, dtype=bool)))
    return names, coded.indices.to_numpy(), hashes


def _is_set(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bitmap (bytes, a power of two of them) has the hashes' bits."""
    bit = hashes & np.uint64(len(bitmap) * 8 - 1)
    return (bitmap[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _phrases(batch: pa.RecordBatch, k: int, bitmap: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Phrases of k words of a batch (lang, text) with their counts; pass 1 also the words of each language under a null phrase."""
    words = scan(batch.column("text"), _WORDS, lower=True)
    names, lang_of, lang_hash = _languages(batch.column("lang"))
    lang = lang_of[words.doc_of()]
    if k == 1:
        n = np.bincount(lang, minlength=len(names))
        yield pa.record_batch([pa.array(names, pa.string()), pa.nulls(len(names), pa.string()), pa.array(n)], schema=COUNTS)
    if len(words) < k:
        return
    hashes = word_hashes(words)
    # Phrases lie in one text and one piece: as many breaks before the first word as before the last.
    breaks = np.cumsum(_BREAK[words.buf[: len(words.inside)]], dtype=np.int32)[words.starts]
    doc = words.doc_of()
    last = len(words) - k + 1
    good = (breaks[:last] == breaks[k - 1 :]) & (doc[:last] == doc[k - 1 :])
    if k > 1:
        shorter = _is_set(bitmap, combine(run_hashes(hashes, k - 1), lang_hash[lang[: last + 1]]))
        good &= shorter[:-1] & shorter[1:]
    at = np.flatnonzero(good)
    if not len(at):
        return
    joined, starts, ends = words.joined()
    joined = np.append(joined, np.zeros(8, dtype=np.uint8))
    h = combine(run_hashes(hashes, k)[at], lang_hash[lang[at]])
    order = np.argsort(h, kind="stable")
    at, h = at[order], h[order]
    size = ends[at + k - 1] - starts[at]
    head = first_bytes(joined, starts[at], size)
    new = np.ones(len(at), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (size[1:] != size[:-1]) | (head[1:] != head[:-1]) | (lang[at[1:]] != lang[at[:-1]])
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(at)))
    at, size = at[first], size[first]
    named = pa.array(names, pa.string()).take(pa.array(lang[at]))
    for lo in range(0, len(at), ROWS):
        begin, length = starts[at[lo : lo + ROWS]], size[lo : lo + ROWS]
        offsets = np.zeros(len(length) + 1, dtype=np.int32)
        np.cumsum(length, out=offsets[1:])
        data = joined[np.repeat(begin - offsets[:-1], length) + np.arange(offsets[-1])]
        phrase = pa.StringArray.from_buffers(len(length), pa.py_buffer(offsets), pa.py_buffer(data))
        yield pa.record_batch([named.slice(lo, ROWS), phrase, pa.array(counts[lo : lo + ROWS], pa.int64())], schema=COUNTS)


def _bits(batches: Iterator[pa.RecordBatch], k: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Words (place, set bits) of the bitmap that the phrases of a level table set."""
    for batch in batches:
        words = scan(batch.column("phrase"), _WORDS)
        _, lang_of, lang_hash = _languages(batch.column("lang"))
        h = combine(run_hashes(word_hashes(words), k)[words.first[:-1]], lang_hash[lang_of]) & np.uint64(bits - 1)
        place = (h >> np.uint64(6)).astype(np.int64)
        mask = (np.uint64(1) << (h & np.uint64(63))).view(np.int64)
        yield pa.record_batch([pa.array(place), pa.array(mask)], names=["place", "bits"])


def level_bitmap(level: DataFrame, k: int) -> np.ndarray:
    """The bytes of the bitmap of a level's phrases of k words: BITS_EACH bits for each, MOST_BITS at most."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * level.count()).bit_length()))
    rows = level.select("lang", "phrase").mapInArrow(lambda it: _bits(it, k, bits), "place long, bits long")
    rows = rows.groupBy("place").agg(F.bit_or("bits").alias("bits"))
    found = rows.toArrow()  # at most MOST_BITS / 64 rows
    out = np.zeros(bits // 64, dtype=np.int64)
    out[found["place"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint8)


def count_level(docs: DataFrame, k: int, below: DataFrame | None, frequent: int = FREQUENT) -> DataFrame:
    """Rows (lang, phrase, n): the phrases of k words with n >= frequent; ``below``: the level of k-1 words. Level 1 has null phrases with all words of a language."""
    context = docs.sparkSession.sparkContext
    shared = None if below is None else context.broadcast(level_bitmap(below.where("phrase IS NOT NULL"), k - 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in passes(batch, "text", PASS):
                yield from _phrases(part, k, None if shared is None else shared.value)

    rows = docs.select("lang", "text").mapInArrow(count, "lang string, phrase string, n long")
    found = rows.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= frequent) | F.col("phrase").isNull())
    out = cut(found, f"phrases{k}")
    if shared is not None:
        shared.destroy()
    return out


def levels(docs: DataFrame, longest: int = LONGEST, frequent: int = FREQUENT) -> list[DataFrame]:
    """Tables (lang, phrase, n) of the frequent phrases of 1, 2, ... words, as far as there are any."""
    small_batches(docs.sparkSession, str(PASS))
    docs = docs.select("lang", "text")
    out = [count_level(docs, 1, None, frequent)]
    while len(out) < longest and not out[-1].where("phrase IS NOT NULL").isEmpty():
        out.append(count_level(docs, len(out) + 1, out[-1], frequent))
    return out


def _few(by_language: DataFrame) -> bool:
    """Whether a table with one row for each language may be broadcast."""
    return by_language.count() <= BROADCAST_LANGUAGES


def scored(tables: list[DataFrame], scale: int = SCALE) -> DataFrame:
    """Rows (lang, phrase, k, a, l, r, n, score): every phrase of two words or more at its lowest cut."""
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    parts = [t.where("phrase IS NOT NULL").withColumn("k", F.lit(i + 1)) for i, t in enumerate(tables)]
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    totals = tables[0].where("phrase IS NULL").select("lang", F.col("n").alias("total"))
    words = F.split("phrase", " ")
    piece = lambda a, n: F.array_join(F.slice("words", a, n), " ")
    cuts = every.where("k > 1").select("lang", "phrase", "k", F.col("n").alias("a"), words.alias("words"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "k", "a", "cut", piece(F.lit(1), F.col("cut")).alias("left"), piece(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    found = cuts.join(every.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    found = found.join(every.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    found = found.join(F.broadcast(totals) if _few(totals) else totals, "lang")
    found = found.withColumn("above", (wide("a") * scale * wide("total")).cast("decimal(38,0)")).withColumn("under", (wide("l") * wide("r")).cast("decimal(38,0)"))
    found = found.withColumn("score", F.expr("above div under"))
    best = F.min(F.struct("score", "cut", "l", "r")).alias("best")
    return found.groupBy("lang", "phrase", "k", "a", "total").agg(best).select("lang", "phrase", "k", "a", "best.l", "best.r", F.col("total").alias("n"), "best.score")


def collocations(docs: DataFrame, longest: int = LONGEST, frequent: int = FREQUENT, scale: int = SCALE, contained: int = CONTAINED_PERCENT, top: int = TOP) -> DataFrame:
    """The best ``top`` phrases of every language: lang, rank, phrase, a, l, r, n, score.

    Dropped: phrases inside a longer one that has ``contained`` percent of their occurrences or more.
    """
    tables = levels(docs, longest, frequent)
    found = cut(scored(tables, scale), "phrases-scored")
    words = F.split("phrase", " ")
    longer = found.where("k > 2").select("lang", "a", words.alias("words"), F.col("k").alias("k"))
    inner = F.explode(F.array(F.array_join(F.slice("words", F.lit(1), F.col("k") - 1), " "), F.array_join(F.slice("words", F.lit(2), F.col("k") - 1), " ")))
    within = longer.select("lang", "a", inner.alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("outer"))
    kept = found.join(within, ["lang", "phrase"], "left").where((F.col("outer").isNull()) | (100 * F.col("outer") < contained * F.col("a")))
    placed = cut(running(kept.drop("k", "outer"), ["lang", F.desc("score"), F.desc("a"), F.asc("phrase")]), "phrases-placed")
    starts = placed.groupBy("lang").agg(F.min("place").alias("start"))
    ranked = placed.join(F.broadcast(starts) if _few(starts) else starts, "lang").withColumn("rank", F.col("place") - F.col("start") + 1).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
