"""Substring dedup: suffix automata of reference shards, streamed for matching statistics.

A repeated passage of ``window`` words or more is removed wherever it also starts earlier. Streaming every
document through the automata of the whole corpus would cost the square of it and broadcast all of it, so
shards are dealt by content: each window of words is filed under its anchor, the least hash among its runs
of ``anchor`` words. Equal windows have equal anchors at equal offsets, so a maximal run of windows with
one anchor (a strand, ``window`` words and a few more) needs to be compared with strands of the same anchor only.

1. Every document is cut into strands. A task sends one row for each distinct strand; an equal, later
   strand of the same task is covered by it at once, one of another task where the two meet. Strands whose anchor
   occurs once are dropped. The strands of an anchor are dealt into shards of a bounded number of words.
2. The remaining distinct strands fetch their words from their documents.
3. Each shard builds a generalised suffix automaton in order of position, so each state knows the earliest
   place where its words end. Strands are streamed through it; where the match is ``window`` words or
   longer and the earliest place is not the strand's own, the window is removed. An anchor's strands also visit the
   shards before their own, a few shards' strands in a task: there the later of two equal windows is removed, whichever side it is on.
4. Spans are merged for each document.

Order of positions: doc_id (null first), then the text's hash, then the place in the text. Rows equal in
doc_id and text are one position: they get equal results and do not remove each other. A null or wordless
text has no windows. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.scratch import cut, small_batches
from loomstone.llm.textcore import SPACE_WORDS, Words, combine, passes, run_hashes, scan, sliding_min, word_hashes

WINDOW = 20
ANCHOR = 8
#: Words of one automaton of several anchors: bounds the memory of a task.
SHARD_WORDS = 60_000
#: Words of a shard of one anchor, and of how many shards the strands visit a shard in one task.
ANCHOR_WORDS, RUN_SHARDS = 8_000, 4
#: Anchors of several shards that are broadcast with their number of shards; more are joined by a shuffle.
LARGE_ANCHORS = 100_000
#: Strands that a task gathers before it sends its distinct ones.
TASK_STRANDS = 1 << 20

POSITION = "doc long, k long, start int, size int"
STRANDS = f"route long, strand long, copy boolean, {POSITION}"
SHARDED = f"anchor long, shard int, copy boolean, {POSITION}"
WORDS = f"anchor long, shard int, words binary, {POSITION}"
SPANS = POSITION


def leftmost_least(runs: np.ndarray, width: int, piece: int = 1 << 22) -> np.ndarray:
    """The place of the least of every ``width`` consecutive values by their upper 40 bits; of equal ones the leftmost.

    The lower 24 bits hold the place while minima are taken, in pieces that overlap by width - 1 values.
    """
    out = np.empty(len(runs) - width + 1, dtype=np.int64)
    for at in range(0, len(out), piece):
        part = runs[at : at + piece + width - 1]
        key = (part >> np.uint64(24) << np.uint64(24)) | np.arange(len(part), dtype=np.uint64)
        least = sliding_min(key, width) & np.uint64((1 << 24) - 1)
        out[at : at + len(least)] = least.astype(np.int64) + at
    return out


def strands_of(words: Words, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(text, first word in text, words, anchor hash, strand hash) of each strand of a batch."""
    hashes = word_hashes(words)
    empty = tuple(np.zeros(0, dtype=np.int64) for _ in range(5))
    if len(hashes) < window:
        return empty
    runs = run_hashes(hashes, anchor)
    place = leftmost_least(runs, window - anchor + 1)
    doc = words.doc_of()
    whole = doc[: len(place)] == doc[window - 1 :][: len(place)]
    at = np.flatnonzero(whole)
    if not len(at):
        return empty
    new = np.ones(len(at), dtype=bool)
    new[1:] = (place[at[1:]] != place[at[:-1]]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(new)
    first = at[begin]
    last = at[np.append(begin[1:], len(at)) - 1]
    # A strand is told by its words: prefix sums of mixed window hashes, with its length.
    inner = run_hashes(hashes, window)
    mixed = np.zeros(len(at) + 1, dtype=np.uint64)
    step = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
    np.cumsum(combine(inner[at], step.astype(np.uint64)), out=mixed[1:])
    total = mixed[np.append(begin[1:], len(at))] - mixed[begin]
    size = last - first + window
    return doc[first], first - words.first[doc[first]], size, runs[place[first]].view(np.int64), combine(total, size.astype(np.uint64)).view(np.int64)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of [from, to) spans."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _rows(**columns) -> pa.RecordBatch:
    kinds = {"start": np.int32, "size": np.int32, "shard": np.int32, "copy": bool}
    arrays = [x if isinstance(x, pa.Array) else pa.array(np.asarray(x, dtype=kinds.get(c, np.int64))) for c, x in columns.items()]
    return pa.RecordBatch.from_arrays(arrays, names=list(columns))


def _cut_documents(batches: Iterator[pa.RecordBatch], window: int, anchor: int) -> Iterator[pa.RecordBatch]:
    """Distinct strands of a task (route: the anchor), and its covered spans (copy)."""
    held: list[np.ndarray] = []
    count = 0

    def flush() -> Iterator[pa.RecordBatch]:
        a, s, doc, k, start, size = np.concatenate(held, axis=1)
        order = np.lexsort((start, k, doc, s, a))
        a, s, doc, k, start, size = (x[order] for x in (a, s, doc, k, start, size))
        new = np.ones(len(a), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (s[1:] != s[:-1])
        lead = np.flatnonzero(new)[np.cumsum(new) - 1]
        covered = (doc != doc[lead]) | (k != k[lead]) | (start != start[lead])
        yield _rows(route=a[new], strand=s[new], copy=np.zeros(new.sum(), dtype=bool), doc=doc[new], k=k[new], start=start[new], size=size[new])
        d, kk, b, e = doc[covered], k[covered], start[covered], start[covered] + size[covered]
        order = np.lexsort((b, kk, d))
        d, kk, b, e = d[order], kk[order], b[order], e[order]
        if len(d):  # overlapping spans of a document become one
            same = np.zeros(len(d), dtype=bool)
            # Strands of one document start in order and are about equally long: ends rise with starts.
            same[1:] = (d[1:] == d[:-1]) & (kk[1:] == kk[:-1]) & (b[1:] <= e[:-1])
            head = np.flatnonzero(~same)
            tail = np.maximum.reduceat(e, head)
            d, kk, b = d[head], kk[head], b[head]
            yield _rows(route=kk, strand=kk, copy=np.ones(len(d), dtype=bool), doc=d, k=kk, start=b, size=tail - b)

    for batch in batches:
        for part in passes(batch, "text"):
            words = scan(part.column("text"), SPACE_WORDS)
            text, start, size, a, s = strands_of(words, window, anchor)
            doc = part.column("doc").to_numpy(zero_copy_only=False)[text]
            k = part.column("k").to_numpy(zero_copy_only=False)[text]
            held.append(np.stack([a, s, doc, k, start, size]).astype(np.int64))
            count += len(a)
            if count >= TASK_STRANDS:
                yield from flush()
                held, count = [], 0
    if count:
        yield from flush()


def _repeated_anchors(batches: Iterator[pa.RecordBatch], shard_words: int) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (copy, route, strand, doc, k, start): covered spans as they are; later copies of a strand as covered
    spans; the first of equal strands where its anchor has another row, with the number of its shard.

    Holds one batch and the last row before it, however many rows an anchor has.
    """
    names = ("route", "strand", "doc", "k", "start", "size")
    held: list[np.ndarray] | None = None  # the only row so far of the last anchor
    open_anchor = None  # the last anchor, if rows of it are sent; with its last strand's hash, position, shard, and words so far
    for batch in batches:
        span = batch.column("copy").to_numpy(zero_copy_only=False)
        if span.any():
            d, k, b, n = (batch.column(c).to_numpy()[span] for c in ("doc", "k", "start", "size"))
            yield _rows(anchor=k, shard=np.zeros(len(d)), copy=np.ones(len(d), dtype=bool), doc=d, k=k, start=b, size=n)
        columns = [batch.column(c).to_numpy()[~span].astype(np.int64) for c in names]
        if not len(columns[0]):
            continue
        if held is not None:
            columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
        a, s, doc, k, start, size = columns
        n = len(a)
        goes_on = open_anchor is not None and a[0] == open_anchor[0]
        new_anchor = np.append(not goes_on, a[1:] != a[:-1])
        first = np.append(not (goes_on and s[0] == open_anchor[1]), new_anchor[1:] | (s[1:] != s[:-1]))
        # Words of the distinct strands of the anchor before each strand, and its shard.
        group = np.cumsum(new_anchor)
        words = np.where(first, size, 0)
        before = np.cumsum(words) - words
        base = np.zeros(int(group[-1]) + 1, dtype=np.int64)
        base[group[new_anchor]] = before[new_anchor]
        if goes_on:
            base[0] = -open_anchor[4]
        inside = before - base[group]
        lead = np.maximum.accumulate(np.where(first, np.arange(n), -1))
        shard = inside[lead] // shard_words
        ld, lk, ls = doc[lead], k[lead], start[lead]
        if goes_on:  # rows that go on with the last strand
            early = lead < 0
            (ld[early], lk[early], ls[early]), shard[early] = open_anchor[2], open_anchor[3]
        several = np.bincount(group, minlength=len(base)) > 1
        if goes_on:
            several[0] = True
        send = several[group]
        take = send & first
        if take.any():
            yield _rows(anchor=a[take], shard=shard[take], copy=np.zeros(take.sum(), dtype=bool), doc=doc[take], k=k[take], start=start[take], size=size[take])
        # A copy in the same place (rows equal in doc_id and text) is its leader.
        take = send & ~first & ((doc != ld) | (k != lk) | (start != ls))
        if take.any():
            yield _rows(anchor=a[take], shard=shard[take], copy=np.ones(take.sum(), dtype=bool), doc=doc[take], k=k[take], start=start[take], size=size[take])
        if send[-1]:
            held, open_anchor = None, (a[-1], s[-1], (ld[-1], lk[-1], ls[-1]), shard[-1], inside[-1] + words[-1])
        else:
            held, open_anchor = [c[-1:] for c in columns], None


def _fetch_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word hashes of the strands that each document was asked for."""
    for batch in batches:
        for part in passes(batch, "text"):
            words = scan(part.column("text"), SPACE_WORDS)
            hashes = word_hashes(words)
            asked = part.column("asked")
            text = np.repeat(np.arange(part.num_rows), pa.compute.list_value_length(asked).to_numpy(zero_copy_only=False))
            flat = asked.flatten()
            anchor, shard, start, size = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("anchor", "shard", "start", "size"))
            begin = words.first[text] + start
            content = pa.array([hashes[b : b + n].tobytes() for b, n in zip(begin.tolist(), size.tolist(), strict=True)], type=pa.binary())
            doc, k = (part.column(c).to_numpy(zero_copy_only=False)[text] for c in ("doc", "k"))
            yield _rows(anchor=anchor, shard=shard, words=content, doc=doc, k=k, start=start, size=size)


class SuffixAutomaton:
    """Generalised suffix automaton; each state keeps the place where its words first ended.

    Strings must be added in order of position. A place is (string number << 32) + end.
    """

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]

    def add(self, words: list, number: int) -> None:
        last = 0
        for end, word in enumerate(words, 1):
            last = self._extend(last, word, (number << 32) + end)

    def _extend(self, last: int, word, place: int) -> int:
        nexts, link, length, first = self.next, self.link, self.length, self.first
        q = nexts[last].get(word)
        if q is not None and length[q] == length[last] + 1:
            return q
        if q is None:
            new = len(nexts)
            nexts.append({})
            link.append(0)
            length.append(length[last] + 1)
            first.append(place)
            p = last
            while p != -1 and word not in nexts[p]:
                nexts[p][word] = new
                p = link[p]
            if p == -1:
                return new
            q = nexts[p][word]
            if length[q] == length[p] + 1:
                link[new] = q
                return new
            link[new] = self._clone(p, q, word)
            return new
        return self._clone(last, q, word)

    def _clone(self, p: int, q: int, word) -> int:
        nexts, link = self.next, self.link
        clone = len(nexts)
        nexts.append(dict(nexts[q]))
        link.append(link[q])
        self.length.append(self.length[p] + 1)
        self.first.append(self.first[q])
        link[q] = clone
        while p != -1 and nexts[p].get(word) == q:
            nexts[p][word] = clone
            p = link[p]
        return clone

    def statistics(self, words: list, window: int) -> Iterator[tuple[int, int]]:
        """(end, state of the last ``window`` words) for every end where so long a match ends."""
        nexts, link, length = self.next, self.link, self.length
        state, matched = 0, 0
        for end, word in enumerate(words, 1):
            while state and word not in nexts[state]:
                state = link[state]
                matched = length[state]
            if word in nexts[state]:
                state, matched = nexts[state][word], matched + 1
            if matched >= window:
                while length[link[state]] >= window:
                    state = link[state]
                    matched = length[state]
                yield end, state


class Shard:
    """The automaton of some strands (position, words); later shards' strands visit it. A position is (doc, k, start)."""

    def __init__(self, strings: list[tuple[tuple, list]], window: int) -> None:
        self.strings, self.window, self.automaton = sorted(strings, key=lambda s: s[0]), window, SuffixAutomaton()
        for number, (_, words) in enumerate(self.strings):
            self.automaton.add(words, number)
        self.visitors: dict[int, tuple] = {}  # the earliest visitor's place by state

    def _place(self, state: int) -> tuple:
        place = self.automaton.first[state]
        (doc, k, start), _ = self.strings[place >> 32]
        return doc, k, start + (place & 0xFFFFFFFF) - self.window

    def visit(self, position: tuple, words: list) -> list[int]:
        """Starts of windows of a visitor that the shard has earlier; the others are remembered."""
        (doc, k, start), out = position, []
        for end, state in self.automaton.statistics(words, self.window):
            own = (doc, k, start + end - self.window)
            if self._place(state) < own:
                out.append(end - self.window)
            elif own < self.visitors.get(state, (own[0] + 1,)):
                self.visitors[state] = own
        return out

    def own(self) -> list[tuple[tuple, list[int]]]:
        """For each of the shard's strands: starts of windows that it or a visitor has earlier."""
        out = []
        for (doc, k, start), words in self.strings:
            covered = []
            for end, state in self.automaton.statistics(words, self.window):
                here = (doc, k, start + end - self.window)
                if self._place(state) < here or self.visitors.get(state, here) < here:
                    covered.append(end - self.window)
            out.append(((doc, k, start), covered))
        return out


def _match_shards(batches: Iterator[pa.RecordBatch], window: int, shard_words: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (anchor, target, run, visitor): strands with words. Gives covered spans.

    Shards without visitors are matched together, up to ``shard_words`` words; visitors are streamed.
    """
    key, small, size, own, shard = None, [], 0, [], None
    out: list[tuple[int, int, int, int]] = []

    def found(position: tuple, starts: list[int]) -> None:
        doc, k, start = position
        out.extend((doc, k, start + a, b - a) for a, b in merged([(o, o + window) for o in starts]))

    def settle(matcher: Shard) -> None:
        for position, starts in matcher.own():
            found(position, starts)

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("anchor", "target", "run", "visitor", "words", "doc", "k", "start")]
        for anchor, target, run, visitor, words, *position in zip(*columns, strict=True):
            if (anchor, target, run) != key:
                if shard is not None:
                    settle(shard)
                    shard = None
                small += own
                size += sum(len(w) for _, w in own)
                if size >= shard_words:
                    settle(Shard(small, window))
                    small, size = [], 0
                key, own = (anchor, target, run), []
            string = (tuple(position), np.frombuffer(words, dtype=np.uint64).tolist())
            if not visitor:
                own.append(string)
                continue
            if shard is None:
                shard, own = Shard(own, window), []
            found(string[0], shard.visit(*string))
        if out:
            doc, k, start, n = zip(*out, strict=True)
            yield _rows(doc=doc, k=k, start=start, size=n)
            out.clear()
    if shard is not None:
        settle(shard)
    settle(Shard(small + own, window))
    if out:
        doc, k, start, n = zip(*out, strict=True)
        yield _rows(doc=doc, k=k, start=start, size=n)


def covered_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, shard_words: int = SHARD_WORDS, anchor_words: int = ANCHOR_WORDS) -> DataFrame:
    """``docs`` keyed by (doc, k), with its text and spans: list of (start, size), the words to remove."""
    small_batches(docs.sparkSession)
    keyed = docs.select("doc_id", F.col("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64("doc_id", "text").alias("k"))
    shipped = keyed.select("text", "doc", "k").mapInArrow(lambda b: _cut_documents(b, window, anchor), STRANDS)
    dealt = shipped.repartition("route").sortWithinPartitions("copy", "route", "strand", "doc", "k", "start")
    repeated = cut(dealt.mapInArrow(lambda b: _repeated_anchors(b, anchor_words), SHARDED), "substring")
    asked = repeated.where("not copy").groupBy("doc", "k").agg(F.collect_list(F.struct("anchor", "shard", "start", "size")).alias("asked"))
    fetched = keyed.select("doc", "k", "text").join(asked, ["doc", "k"]).select("text", "doc", "k", "asked").mapInArrow(_fetch_words, WORDS)
    # A strand visits the anchor's shards before its own, in runs of RUN_SHARDS shards; its own shard has it in every run.
    large = cut(repeated.where("not copy AND shard > 0").groupBy("anchor").agg(F.max("shard").alias("top")), "large-anchors")
    few = large.limit(LARGE_ANCHORS + 1).count() <= LARGE_ANCHORS
    known = fetched.join(F.broadcast(large) if few else large, "anchor", "left").withColumn("top", F.coalesce("top", "shard"))
    run = lambda shard: F.floor(shard / RUN_SHARDS).cast("int")
    here = F.transform(F.sequence(run(F.col("shard")), run(F.col("top"))), lambda r: F.struct(F.col("shard").alias("target"), r.alias("run"), F.lit(False).alias("visitor")))
    before = F.transform(F.filter(F.sequence(F.lit(0), F.col("shard")), lambda t: t < F.col("shard")), lambda t: F.struct(t.alias("target"), run(F.col("shard")).alias("run"), F.lit(True).alias("visitor")))
    going = known.withColumn("at", F.explode(F.concat(here, before))).select("anchor", "at.*", "words", "doc", "k", "start")
    matched = going.repartition("anchor", "target", "run").sortWithinPartitions("anchor", "target", "run", "visitor").mapInArrow(lambda b: _match_shards(b, window, shard_words), SPANS)
    covered = matched.union(repeated.where("copy").select("doc", "k", "start", "size"))
    spans = covered.groupBy("doc", "k").agg(F.collect_list(F.struct("start", "size")).alias("spans"))
    return keyed.join(spans, ["doc", "k"], "left").select("doc_id", "doc", "k", "text", "spans")


def _kept(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in passes(batch, "text"):
            words = scan(part.column("text"), SPACE_WORDS)
            keep = np.ones(len(words), dtype=np.int8)
            spans = part.column("spans")
            text = np.repeat(np.arange(part.num_rows), pa.compute.fill_null(pa.compute.list_value_length(spans), 0).to_numpy(zero_copy_only=False))
            flat = spans.flatten()
            edge = np.zeros(len(words) + 1, dtype=np.int64)
            begin = words.first[text] + flat.field("start").to_numpy(zero_copy_only=False)
            np.add.at(edge, begin, 1)
            np.add.at(edge, begin + flat.field("size").to_numpy(zero_copy_only=False), -1)
            keep = np.cumsum(edge[:-1]) == 0
            buf, starts, ends = words.joined()
            lens = ends - starts + 1
            stay = np.repeat(keep, lens)
            data = buf[stay].tobytes()
            kept_bytes, kept_words = np.concatenate([[0], np.cumsum(np.where(keep, lens, 0))]), np.concatenate([[0], np.cumsum(keep)])
            at = kept_bytes[words.first].tolist()
            texts = [data[a : max(a, b - 1)] for a, b in zip(at, at[1:], strict=False)]
            counts = words.counts
            removed = counts - np.diff(kept_words[words.first])
            arrays = [part.column("doc_id"), pa.array(counts.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array([hashlib.sha256(t).hexdigest() for t in texts])]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                arrays.append(pa.array(texts, type=pa.binary()).cast(pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(arrays, names=names)


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, with_text: bool = True, shard_words: int = SHARD_WORDS, anchor_words: int = ANCHOR_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and (``with_text``) kept_text of every row of ``docs``."""
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    marked = covered_spans(docs, window, anchor, shard_words, anchor_words).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "spans")
    return marked.mapInArrow(lambda b: _kept(b, with_text), schema)
