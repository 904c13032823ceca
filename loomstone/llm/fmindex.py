"""Benchmark decontamination with FM-indexes: one index per training shard, searched backwards.

A shard is a run of documents of one task. Its words become symbols (rank in the benchmark's vocabulary,
zero for any other word and between documents), runs of zero shrink to one, and the shard gets a suffix
order, its BWT in a wavelet matrix, and sampled suffix positions. Every benchmark window is searched
backwards through wavelet ranks, all windows at once; occurrences are located by walking to a sampled
suffix, and the words that they cover are merged into removal spans.

The phrases are dealt by hash into parts of about ``PHRASES_PER_PART`` that travel to the executors one by one; with several
parts, the spans of a row are merged after a shuffle of spans alone, by the row's place in a written table.

Defined results: a null or wordless document has no hits; a wordless benchmark item has no window; items
with equal windows all count; null item_ids are ignored; repeated rows each give a row.
Only text and item_id, text are read besides the columns to carry.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.scratch import cut, fresh, small_batches
from loomstone.llm.textcore import ALNUM_WORDS, passes, release, scan, word_hashes

WINDOW = 13
#: Symbols of one FM-index: bounds the memory of a task (one longer document is a shard of its own). A large benchmark is
#: searched in larger shards, which are fewer: SYMBOLS_A_PATTERN for each of its windows, SHARD_SYMBOLS at most.
SHARD_SYMBOLS, LEAST_SYMBOLS, SYMBOLS_A_PATTERN = 1 << 20, 1 << 18, 4
#: Bytes of the documents of a shard: words that the benchmark does not have are hardly symbols, but are held, too.
SHARD_BYTES, PASS = 4 << 20, 1 << 20
SAMPLE = 16
#: Windows of items in one broadcast part: at most 13 * 4 bytes each, some 30 MB.
PHRASES_PER_PART = 1 << 19


class BitRank:
    """Bits with rank: ones before a position, by block counts and population counts."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, dtype=np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words), dtype=np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        block = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.words[block] & mask)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)


class WaveletMatrix:
    """Symbols of a sequence, one bit level at a time, highest bit first; zeros go before ones."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.bits, self.levels, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            ones = (symbols >> level & 1).astype(bool)
            self.levels.append(BitRank(ones))
            self.zeros.append(int(len(ones) - ones.sum()))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before ``at`` (arrays, element by element)."""
        start = np.zeros_like(at)
        for i, level in enumerate(range(self.bits - 1, -1, -1)):
            one = (symbol >> level & 1).astype(bool)
            a, b = self.levels[i].rank(start), self.levels[i].rank(at)
            start = np.where(one, self.zeros[i] + a, start - a)
            at = np.where(one, self.zeros[i] + b, at - b)
        return at - start

    def symbol_and_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and its occurrences before it."""
        symbol, start = np.zeros_like(at), np.zeros_like(at)
        for i in range(self.bits):
            one = self.levels[i].get(at).astype(bool)
            a, b = self.levels[i].rank(start), self.levels[i].rank(at)
            start = np.where(one, self.zeros[i] + a, start - a)
            at = np.where(one, self.zeros[i] + b, at - b)
            symbol = symbol << 1 | one
        return symbol, at - start


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; every zero counts as a symbol of its own, in order of position."""
    n, size = len(symbols), 1
    zero = symbols == 0
    n_zero = int(zero.sum())
    rank = symbols.astype(np.int64) + max(n_zero - 1, 0)
    rank[zero] = np.arange(n_zero)
    while True:
        key = rank * (n + int(rank.max()) + 2)
        key[: n - size] += rank[size:] + 1
        order = np.argsort(key)
        key = key[order]
        place = np.zeros(n, dtype=np.int64)
        np.cumsum(key[1:] != key[:-1], out=place[1:])
        if place[-1] == n - 1:
            return order
        rank = np.empty(n, dtype=np.int64)
        rank[order] = place
        size *= 2


class FMIndex:
    """FM-index of symbols that begin and end with zero; finds patterns without zeros.

    Suffix positions are kept for every ``SAMPLE``-th position and behind every zero, so a walk to the
    left never has to pass a zero (zeros are ordered by position, not by what follows).
    """

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        order = suffix_order(symbols)
        self.n = len(symbols)
        bwt = symbols[order - 1]
        kept = (order % SAMPLE == 0) | (bwt == 0)
        self.sampled, self.positions = BitRank(kept), order[kept].astype(np.int32)
        self.wavelet = WaveletMatrix(bwt, bits)
        self.less = np.zeros((1 << bits) + 1, dtype=np.int64)
        np.cumsum(np.bincount(symbols, minlength=1 << bits), out=self.less[1:])

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of patterns, one in each row, all of one length."""
        lo, hi = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), self.n, dtype=np.int64)
        live = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            s = patterns[live, k].astype(np.int64)
            lo[live] = self.less[s] + self.wavelet.rank(s, lo[live])
            hi[live] = self.less[s] + self.wavelet.rank(s, hi[live])
            live = live[lo[live] < hi[live]]
        return lo, np.maximum(hi, lo)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of the suffix in each row."""
        out, steps = np.empty(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
        live, at = np.arange(len(rows)), rows.astype(np.int64)
        while len(live):
            hit = self.sampled.get(at).astype(bool)
            out[live[hit]] = self.positions[self.sampled.rank(at[hit])] + steps[live[hit]]
            live, at = live[~hit], at[~hit]
            symbol, before = self.wavelet.symbol_and_rank(at)
            at = self.less[symbol] + before
            steps[live] += 1
        return out


@dataclass
class Phrases:
    """One part of the benchmark: its vocabulary and its distinct windows with the items that have them."""

    vocabulary: np.ndarray  # sorted word hashes
    bits: int
    by_length: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]  # length, patterns, item slots from, to
    items: np.ndarray  # item_ids by slot


def windows_of(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct rows (pattern, item_id): the word hashes of each window of each item; a shorter item is one window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in passes(batch, "text"):
                words = scan(part.column("text"), ALNUM_WORDS, lower=True)
                data, counts = word_hashes(words).tobytes(), words.counts
                n = np.where(counts > 0, np.maximum(counts - window + 1, 1), 0)
                item = np.repeat(np.arange(len(counts)), n)
                begin = words.first[item] + np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)
                end = np.minimum(begin + window, words.first[item + 1])
                patterns = [data[8 * a : 8 * b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(patterns, type=pa.binary()), part.column("item_id").take(pa.array(item))], names=["pattern", "item_id"])

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null")
    return items.mapInArrow(run, "pattern binary, item_id long").distinct()


def phrases_of(windows: pa.Table) -> Phrases:
    """One part of the benchmark's windows (pattern, item_id) for the search."""
    found: dict[bytes, list[int]] = {}
    for pattern, item in zip(windows.column("pattern").to_pylist(), windows.column("item_id").to_pylist(), strict=True):
        found.setdefault(pattern, []).append(item)
    ordered = sorted(found, key=lambda p: (len(p), p))
    vocabulary = np.unique(np.frombuffer(b"".join(ordered), dtype=np.uint64))
    by_length, slots = [], []
    for size in sorted({len(p) for p in ordered}):
        own = [p for p in ordered if len(p) == size]
        n = np.array([len(found[p]) for p in own])
        ends = len(slots) + np.cumsum(n)
        slots += [i for p in own for i in sorted(found[p])]
        patterns = (np.searchsorted(vocabulary, np.frombuffer(b"".join(own), dtype=np.uint64)) + 1).astype(np.int32)
        by_length.append((size // 8, patterns.reshape(len(own), -1), ends - n, ends))
    if not len(vocabulary):
        vocabulary = np.zeros(1, dtype=np.uint64)
    return Phrases(vocabulary, max(1, len(vocabulary).bit_length()), by_length, np.array(slots, dtype=np.int64))


class Shard:
    """Documents gathered for one FM-index."""

    def __init__(self, phrases: Phrases) -> None:
        self.phrases, self.symbols, self.size, self.word_at, self.counts, self.columns = phrases, [], 0, [], [], []
        self.n_words = self.n_bytes = 0
        self.most = min(SHARD_SYMBOLS, max(LEAST_SYMBOLS, SYMBOLS_A_PATTERN * sum(len(p) for _, p, _, _ in phrases.by_length)))

    def full(self, part: pa.RecordBatch) -> bool:
        """Whether ``part`` belongs in the next shard."""
        return bool(self.columns) and (self.size + part.nbytes // 8 > self.most or self.n_bytes + part.nbytes > SHARD_BYTES)

    def add(self, part: pa.RecordBatch) -> None:
        words = scan(part.column("text"), ALNUM_WORDS, lower=True)
        hashes, vocabulary = word_hashes(words), self.phrases.vocabulary
        place = np.searchsorted(vocabulary, hashes)
        known = vocabulary[np.minimum(place, len(vocabulary) - 1)] == hashes
        # A zero in front of each text; further zeros only where the symbol before is not zero.
        symbols = np.zeros(len(hashes) + len(words.counts), dtype=np.int64)
        slot = np.arange(len(hashes)) + words.doc_of() + 1
        symbols[slot] = np.where(known, place + 1, 0)
        number = np.full(len(symbols), -1, dtype=np.int64)
        number[slot] = np.arange(len(hashes)) + self.n_words
        keep = np.ones(len(symbols), dtype=bool)
        keep[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0)
        self.symbols.append(symbols[keep])
        self.word_at.append(number[keep])
        self.size += int(keep.sum())
        self.n_words += len(hashes)
        self.n_bytes += part.nbytes
        self.counts.append(words.counts)
        self.columns.append(part)

    def spans(self) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list[list[list[int]]], list[list[int]]]]:
        """For each gathered batch: the batch, words of each text, merged [from, to) spans, sorted items."""
        symbols = np.concatenate([*self.symbols, [0]]).astype(np.int32)
        word_at = np.concatenate([*self.word_at, [-1]])
        counts = np.concatenate(self.counts)
        first = np.zeros(len(counts) + 1, dtype=np.int64)
        np.cumsum(counts, out=first[1:])
        begin, length, slot_from, slot_to = self._occurrences(symbols, word_at)
        # Words covered by any occurrence, by differences.
        cover = np.zeros(first[-1] + 1, dtype=np.int64)
        np.add.at(cover, begin, 1)
        np.add.at(cover, begin + length, -1)
        hit = np.cumsum(cover[:-1]) > 0
        doc = np.searchsorted(first, begin, side="right") - 1
        n_slots = slot_to - slot_from
        pair_doc = np.repeat(doc, n_slots)
        slots = np.repeat(slot_from, n_slots) + np.arange(n_slots.sum()) - np.repeat(np.cumsum(n_slots) - n_slots, n_slots)
        pairs = np.unique(np.stack([pair_doc, self.phrases.items[slots]], axis=1), axis=0) if len(slots) else np.zeros((0, 2), dtype=np.int64)
        owner_from = np.searchsorted(pairs[:, 0], np.arange(len(counts) + 1))
        edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
        runs_doc = {}
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            while a < b:  # a run may cross texts
                d = int(np.searchsorted(first, a, side="right")) - 1
                to = min(b, int(first[d + 1]))
                runs_doc.setdefault(d, []).append([a - int(first[d]), to - int(first[d])])
                a = to
        at = 0
        for part in self.columns:
            n = part.num_rows
            runs = [runs_doc.get(d, []) for d in range(at, at + n)]
            items = [pairs[owner_from[d] : owner_from[d + 1], 1].tolist() for d in range(at, at + n)]
            yield part, counts[at : at + n], runs, items
            at += n

    def _occurrences(self, symbols: np.ndarray, word_at: np.ndarray) -> tuple[np.ndarray, ...]:
        index, found = FMIndex(symbols, self.phrases.bits), []
        for length, patterns, slot_from, slot_to in self.phrases.by_length:
            lo, hi = index.search(patterns)
            n = hi - lo
            if n.sum():
                rows = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                begin = word_at[index.locate(rows)]
                found.append((begin, np.full(len(begin), length, dtype=np.int64), np.repeat(slot_from, n), np.repeat(slot_to, n)))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else tuple(np.zeros(0, dtype=np.int64) for _ in range(4))


SPANS = "n_words long, spans array<array<int>>, item_ids array<long>"


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, carry: list[str], window: int = WINDOW) -> DataFrame:
    """``carry`` columns of every document, n_words, merged word spans [from, to) and sorted item_ids found.

    ``docs`` needs a column text. The benchmark's windows are found in tasks and dealt into parts of a bounded
    size, so neither the driver nor a broadcast holds more than one part of them.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    windows = cut(windows_of(benchmark, window), "windows")
    n_parts = max(1, -(-windows.count() // PHRASES_PER_PART))
    part_of = F.pmod(F.xxhash64("pattern", "item_id"), F.lit(n_parts))
    kept = list(dict.fromkeys([*carry, "text"]))
    source = docs.select(*kept)

    def search(phrases, source: DataFrame, carry: list[str]) -> DataFrame:
        schema = ", ".join([*(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in carry), SPANS])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def finish(shard: Shard) -> Iterator[pa.RecordBatch]:
                for part, counts, runs, own in shard.spans():
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(c) for c in carry), pa.array(counts.astype(np.int64)), pa.array(runs, type=pa.list_(pa.list_(pa.int32()))), pa.array(own, type=pa.list_(pa.int64()))],
                        names=[*carry, "n_words", "spans", "item_ids"],
                    )

            shard = Shard(phrases.value)
            for batch in batches:
                for part in passes(batch, "text", PASS):
                    if shard.full(part):
                        yield from finish(shard)
                        shard = Shard(phrases.value)
                        release()
                    shard.add(part)
            if shard.columns:
                yield from finish(shard)

        return source.mapInArrow(run, schema)

    def part(number: int):
        return spark.sparkContext.broadcast(phrases_of(windows.where(part_of == number).toArrow()))

    if n_parts == 1:
        return search(part(0), source, carry)
    # Several parts: each row's spans are gathered by its file and row in a written table.
    place = [fresh("file_key", source), fresh("row_key", source)]
    placed = cut(source, "placed").select("*", F.xxhash64("_metadata.file_path").alias(place[0]), F.col("_metadata.row_index").alias(place[1]))
    every = [search(part(i), placed.select(*place, "text"), place) for i in range(n_parts)]
    merged = F.expr("aggregate(array_sort(flatten(collect_list(spans))), cast(array() as array<array<int>>), (a, x) -> if(size(a) > 0 and element_at(a, -1)[1] >= x[0], concat(slice(a, 1, size(a) - 1), array(array(element_at(a, -1)[0], greatest(element_at(a, -1)[1], x[1])))), concat(a, array(x))))")
    found = reduce(DataFrame.union, every).groupBy(*place).agg(F.first("n_words").alias("n_words"), merged.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
    gathered = found.select(*place, *(F.col(c).alias(fresh(c, source)) for c in ("n_words", "spans", "item_ids")))
    rows = placed.select(*dict.fromkeys(carry), *place).join(gathered, place)
    return rows.select(*carry, *(F.col(fresh(c, source)).alias(c) for c in ("n_words", "spans", "item_ids")))


def n_hit(spans="spans"):
    """Words in merged spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])


def is_contaminated(hit, n_words):
    """The rule: at least a twentieth of the words are hit."""
    return (hit > 0) & (20 * hit >= n_words)
