"""Secret scans: base patterns, and automata inferred from labelled credentials.

The base kinds (assign, access, hex) are plain patterns. Their whole values in a bounded sample of documents are
the labelled credentials: for each kind, a prefix tree of their character classes is merged state by state
where the outgoing and ending frequencies are statistically compatible (Hoeffding bounds), which leaves a
small probabilistic automaton of the kind's format. Every other run of credential characters of every whole text, from the
shortest length that a base kind takes, is a candidate; where the whole run is none, its parts between ``=``, then
``/``, ``.`` and other marks are. A candidate becomes a span of kind ``grammar`` when its likelihood under some
automaton exceeds that under a background model of ordinary runs by ``min_bits``. What a run has beside a base span is a candidate, too.

Defined results: a null or empty text has no spans; without labelled credentials no spans are added;
repeated rows each give a row. Offsets are code points, end exclusive.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.scratch import cut, discard, small_batches
from loomstone.llm.textcore import Words, passes, scan, string_bytes, word_hashes

#: Bounds of the sample that the automata are inferred from: documents (those of least hash of doc_id and text), values of a
#: kind, characters of a value (longer ones are left out, none is cut), and ordinary runs of the background model.
SAMPLE_DOCUMENTS = 20_000
VALUES_PER_KIND = 300
VALUE_LENGTH = 512
BACKGROUND_RUNS = 3_000
MIN_BITS = 12.0
ALPHA = 0.05
CAPITALS_BITS = 3.0
GRAMMAR = "grammar"
#: Runs' classes whose credentials a task remembers, and their greatest length, so 26 MB of classes at most; results depend on neither.
REMEMBERED = 100_000
REMEMBERED_LENGTH = 256

# Fixed patterns: the base kinds, in this order.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_HINT = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 8, 16, 32
MIN_RUN = min(MIN_ASSIGN, MIN_ACCESS, MIN_HEX)
#: Marks at which a run that is no credential as a whole is cut, one group after the other.
SEPARATORS = ("=", "/", ".", "+_-")

#: Bytes of credential characters.
RUN_CHARS = np.zeros(256, dtype=bool)
RUN_CHARS[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"]] = True
_CLASS = str.maketrans({**{c: "d" for c in "0123456789"}, **{c: "h" for c in "abcdef"}, **{chr(c): "l" for c in range(ord("g"), ord("z") + 1)}, **{chr(c): "U" for c in range(65, 91)}})


_CLASS_BYTES = np.arange(256, dtype=np.uint8)
for _char, _class in _CLASS.items():
    _CLASS_BYTES[_char] = ord(_class)


def classes(value: str) -> str:
    """Digits, hex letters, other small letters and capitals by class; other characters stay."""
    return value.translate(_CLASS)


def letters(symbols: str) -> str:
    """All classes of letters as one."""
    return symbols.replace("h", "l").replace("U", "l")


@dataclass
class Automaton:
    """States with log2 probabilities: arcs[state][symbol] = (next state, bits), ends[state] = bits."""

    arcs: list[dict[str, tuple[int, float]]] = field(default_factory=list)
    ends: list[float] = field(default_factory=list)

    def log2(self, symbols: str) -> float:
        state, bits = 0, 0.0
        for s in symbols:
            step = self.arcs[state].get(s)
            if step is None:
                return -math.inf
            state = step[0]
            bits += step[1]
        return bits + self.ends[state]


def infer(values: list[str], alpha: float = ALPHA) -> Automaton:
    """Merge statistically compatible states of the prefix tree of ``values`` (strings of symbols)."""
    child: list[dict[str, int]] = [{}]
    seen, ends = [0], [0]  # values that reach a node, and that end there
    for value in values:
        node = 0
        seen[0] += 1
        for s in value:
            if s not in child[node]:
                child[node][s] = len(child)
                child.append({})
                seen.append(0)
                ends.append(0)
            node = child[node][s]
            seen[node] += 1
        ends[node] += 1
    arc: list[dict[str, int]] = [{s: seen[c] for s, c in out.items()} for out in child]

    def differ(x: int, n: int, y: int, m: int) -> bool:
        return abs(x / n - y / m) > math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def compatible(a: int, b: int) -> bool:
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            if not seen[a] or not seen[b]:
                continue
            if differ(ends[a], seen[a], ends[b], seen[b]):
                return False
            for s in child[a].keys() | child[b].keys():
                if differ(arc[a].get(s, 0), seen[a], arc[b].get(s, 0), seen[b]):
                    return False
                if s in child[a] and s in child[b]:
                    stack.append((child[a][s], child[b][s]))
        return True

    def fold(a: int, b: int) -> None:
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            seen[a] += seen[b]
            ends[a] += ends[b]
            for s, c in sorted(child[b].items()):
                arc[a][s] = arc[a].get(s, 0) + arc[b][s]
                if s in child[a]:
                    stack.append((child[a][s], c))
                else:
                    child[a][s] = c

    red = [0]
    while True:
        settled = set(red)
        blue = [(r, s, c) for r in red for s, c in sorted(child[r].items()) if c not in settled]
        if not blue:
            break
        parent, symbol, b = blue[0]
        for r in red:
            if compatible(r, b):
                child[parent][symbol] = r
                fold(r, b)
                break
        else:
            red.append(b)
    number = {node: i for i, node in enumerate(red)}
    log = lambda x, n: math.log2(x / n) if x else -math.inf
    return Automaton(
        [{s: (number[c], log(arc[node][s], seen[node])) for s, c in child[node].items()} for node in red],
        [log(ends[node], seen[node]) for node in red],
    )


def background(values: list[str]) -> dict[str, dict[str, float]]:
    """Smoothed log2 bigram model of symbols, with "^" as start and "$" as end."""
    counts: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
    symbols = sorted({*"dhlU+/_.=-", "$"})
    for value in values:
        for a, b in zip("^" + value, value + "$", strict=True):
            counts[a][b] += 1
    out = {}
    for a in ["^", *symbols[:]]:
        total = sum(counts[a].values()) + 0.5 * len(symbols)
        out[a] = {b: math.log2((counts[a][b] + 0.5) / total) for b in symbols}
    return out


@dataclass
class Model:
    automata: dict[str, Automaton]
    ordinary: dict[str, dict[str, float]]
    caseless: dict[str, dict[str, float]]
    min_bits: float

    def is_secret(self, symbols: str) -> bool:
        """Whether the format likelihood of a run's classes under some automaton is far above the background's."""
        best = max((a.log2(symbols) for a in self.automata.values()), default=-math.inf)
        if best == -math.inf:
            return False
        # Words in capitals are ordinary, too: at a price, a run counts by its letters whatever their case.
        return best - max(self.bits(self.ordinary, symbols), self.bits(self.caseless, letters(symbols)) - CAPITALS_BITS) >= self.min_bits

    def credentials(self, symbols: str) -> list[tuple[int, int]]:
        """The [from, to) of the credentials in the classes of a run."""
        found, stack = [], [(0, len(symbols), 0)]
        while stack:
            a, b, level = stack.pop()
            if b - a < MIN_RUN:
                continue
            if self.is_secret(symbols[a:b]):
                found.append((a, b))
                continue
            for below, marks in enumerate(SEPARATORS[level:], level + 1):
                at = [i for i in range(a, b) if symbols[i] in marks]
                if at:
                    stack += [(x, y, below) for x, y in zip([a, *(i + 1 for i in at)], [*at, b], strict=True)]
                    break
        return sorted(found)

    @staticmethod
    def bits(table: dict[str, dict[str, float]], symbols: str) -> float:
        return sum(table[a][b] for a, b in zip("^" + symbols, symbols + "$", strict=True))


def base_in_run(run: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of access and hex matches in one run of credential characters."""
    found = [(m.start(), 1, m.end()) for m in ACCESS.finditer(run) if m.end() - m.start() >= MIN_ACCESS] if "AKIA" in run else []
    if len(run) >= MIN_HEX:
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(run) if m.end() - m.start() >= MIN_HEX]
    return found


@dataclass
class Scan:
    """Of each text: base spans (start, kind number, end) and values (kind number, value); all other runs of ``MIN_RUN`` bytes or more."""

    base: list[list[tuple[int, int, int]]]
    values: list[list[tuple[int, str]]]
    data: bytes
    text_of: np.ndarray
    start: np.ndarray  # code points
    begin: np.ndarray  # bytes in data
    end: np.ndarray

    def runs(self) -> list[str]:
        return [self.data[a:b].decode() for a, b in zip(self.begin.tolist(), self.end.tolist(), strict=True)]

    def added(self, model: Model, known: dict[bytes, list[tuple[int, int]]]) -> dict[int, list[tuple[int, int]]]:
        """Credentials by text; ``known`` remembers them by a run's classes, on which alone they depend."""
        out: dict[int, list[tuple[int, int]]] = {}
        if not len(self.begin) or not model.automata:
            return out
        buf = np.zeros(len(self.data) + 8, dtype=np.uint8)
        buf[: len(self.data)] = _CLASS_BYTES[np.frombuffer(self.data, dtype=np.uint8)]
        hashes = word_hashes(Words(buf, np.zeros(0, dtype=bool), self.begin, self.end, np.zeros(1, dtype=np.int64)))
        _, first, same = np.unique(hashes, return_index=True, return_inverse=True)
        symbols, spans = buf.tobytes(), []
        for a, b in zip(self.begin[first].tolist(), self.end[first].tolist(), strict=True):
            own = symbols[a:b]
            spans_own = known.get(own)
            if spans_own is None:
                spans_own = model.credentials(own.decode())
                if len(own) <= REMEMBERED_LENGTH:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[own] = spans_own
            spans.append(spans_own)
        some = np.array([bool(x) for x in spans])
        for i in np.flatnonzero(some[same]).tolist():
            s = int(self.start[i])
            out.setdefault(int(self.text_of[i]), []).extend((s + a, s + b) for a, b in spans[same[i]])
        return out


def spans_of(texts: pa.Array) -> Scan:
    """Base spans and values, and all other runs, of texts."""
    n = len(texts)
    base: list = [[] for _ in range(n)]
    values: list = [[] for _ in range(n)]
    hinted = np.flatnonzero(pc.fill_null(pc.match_substring_regex(texts, ASSIGN_HINT), False).to_numpy(zero_copy_only=False))
    for d in hinted.tolist():
        for m in ASSIGN.finditer(texts[d].as_py()):
            if len(m[2]) >= MIN_ASSIGN:
                base[d].append((m.start(), 0, m.end()))
                values[d].append((0, m[2]))
    runs = scan(texts, RUN_CHARS)
    raw, offsets = string_bytes(texts)
    data = raw.tobytes()
    long = np.flatnonzero(runs.ends - runs.starts >= MIN_RUN)
    begin, end = runs.starts[long], runs.ends[long]
    text_of = np.searchsorted(runs.first, long, side="right") - 1
    points = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=points[1:])
    start = points[begin] - points[offsets[text_of]]
    for i in np.flatnonzero(end - begin >= min(MIN_ACCESS, MIN_HEX)).tolist():
        run, d, s = data[begin[i] : end[i]].decode(), int(text_of[i]), int(start[i])
        for at, kind, to in base_in_run(run):
            base[d].append((s + at, kind, s + to))
            values[d].append((kind, run[at:to]))
    for spans in base:
        spans.sort()
    # Runs that meet base spans: what is left of them.
    meets, rest = np.zeros(len(long), dtype=bool), []
    for i in np.flatnonzero(np.array([bool(x) for x in base], dtype=bool)[text_of]).tolist() if n else []:
        s, to = int(start[i]), int(start[i] + end[i] - begin[i])
        cuts = [(a, b) for a, _, b in base[text_of[i]] if a < to and s < b]
        if cuts:
            meets[i], at = True, s
            for a, b in [*sorted(cuts), (to, to)]:
                if a - at >= MIN_RUN:
                    rest.append((text_of[i], at, begin[i] + at - s, begin[i] + a - s))
                at = max(at, b)
    left = np.array(rest, dtype=np.int64).reshape(-1, 4)
    return Scan(base, values, data, *(np.append(x[~meets], left[:, c]) for c, x in enumerate((text_of, start, begin, end))))


def fit(docs: DataFrame, sample_documents: int = SAMPLE_DOCUMENTS, min_bits: float = MIN_BITS) -> Model:
    """Infer the automata from the sample; at most VALUES_PER_KIND values of a kind come to the driver."""
    small_batches(docs.sparkSession)
    hashed = docs.select("text", F.xxhash64("doc_id", "text").alias("h")).where("text is not null")
    # Rows up to the hash of the last sampled one; rows equal in doc_id and text give the same values.
    last = hashed.select("h").distinct().orderBy("h").limit(sample_documents).agg(F.max("h")).first()[0]
    chosen = hashed.where(F.col("h") <= F.lit(last)).select("text")

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in passes(batch, "text"):
                found = spans_of(part.column("text"))
                pairs = {(k, v) for own in found.values for k, v in own} | {(-1, r) for r in found.runs()}
                pairs = [p for p in pairs if len(p[1]) <= VALUE_LENGTH]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in pairs], type=pa.int32()), pa.array([v for _, v in pairs], type=pa.string())], names=["kind", "value"])

    found = cut(chosen.mapInArrow(values, "kind int, value string").distinct(), "secret-values")
    per_kind: dict[int, list[str]] = {}
    for kind in range(-1, len(KINDS)):
        few = found.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(VALUES_PER_KIND if kind >= 0 else BACKGROUND_RUNS)
        per_kind[kind] = [classes(r.value) for r in few.collect()]
    discard(found)
    automata = {KINDS[k]: infer(v) for k, v in per_kind.items() if k >= 0 and v}
    return Model(automata, background(per_kind[-1]), background([letters(v) for v in per_kind[-1]]), min_bits)


SPANS = "n_assign long, n_access long, n_hex long, base array<struct<kind:string,begin:int,finish:int>>, spans array<struct<kind:string,begin:int,finish:int>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("finish", pa.int32())]))


def find_secrets(docs: DataFrame, model: Model, carry: list[str]) -> DataFrame:
    """``carry`` columns of every document, counts by base kind, base spans, and all spans with the added ones."""
    small_batches(docs.sparkSession)
    send = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand states at most
    source = docs.select(*dict.fromkeys([*carry, "text"]))
    schema = ", ".join([*(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in carry), SPANS])
    names = [*KINDS, GRAMMAR]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, list[tuple[int, int]]] = {}
        for batch in batches:
            for part in passes(batch, "text"):
                found = spans_of(part.column("text"))
                base, added = found.base, found.added(send.value, known)
                every = [sorted(own + [(a, len(KINDS), b) for a, b in added[d]]) if d in added else own for d, own in enumerate(base)]
                as_rows = lambda spans: pa.array([[(names[k], a, b) for a, k, b in own] for own in spans], type=_SPAN_TYPE)
                counts = [pa.array([sum(k == kind for _, k, _ in own) for own in base], type=pa.int64()) for kind in range(len(KINDS))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), *counts, as_rows(base), as_rows(every)], names=[*carry, *(f"n_{k}" for k in KINDS), "base", "spans"])

    return source.mapInArrow(run, schema)


def span_text(spans):
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["finish"].cast("string"))), ",")
