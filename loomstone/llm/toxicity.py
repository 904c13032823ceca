"""Toxicity by a weighted finite-state pattern grammar over clauses.

Transducers read a clause token by token, each rewriting the symbols that the one before gives out:

* insult, threat: words become INSULT symbols, weighted by a lexicon of words and word beginnings, or THREAT symbols;
* phrases: several words in a row ("according to", "by no means") become one symbol;
* negation: an INSULT or THREAT within three words behind a negation (also "isn't", "n'est") becomes its negated form;
* quotation, reported speech: inside quotation marks or behind a speech verb they become their reported form;
* target: behind a person who is addressed they become their targeted form.

Their composition is one machine over a finite alphabet, whose table is filled in as its states are met. Clauses end at
full stops, exclamation and question marks, semicolons and line ends; what is quoted goes on over them up
to the closing mark or the line's end. Only clauses with an insult or threat are read (found by vectorised look-ups
over all words of the whole text), and a text is scored by the weights of its matched clauses, not by isolated
words: a logistic model over the summed weights of the forms.

The insult lexicon and the form weights are learned from labelled rows: at most ``per_class`` labelled
rows of each class, those with the least hash of doc_id and text, of which near copies count once. Threat, phrase, negation,
speech and target words are fixed small lists, which only change the form of a match. The lexicon keeps the
``max_lexicon`` entries that tell the classes apart best, a documented bound of the model.

Defined results: null, empty and wordless texts get the score of a text without matches; without labels
of both classes the lexicon is empty and every score is 0; of repeated labels of a document the larger
counts; null doc_ids carry no label; repeated rows each give a row, and equal rows count once in the sample.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.llm.langid import held_out, least_hashed
from loomstone.llm.scratch import cut, small_batches
from loomstone.llm.textcore import ALNUM_WORDS, Words, combine, passes, run_hashes, scan, string_bytes, word_hashes

#: Bound of the sample: labelled documents of each class.
PER_CLASS = 4000
#: Bounds of the lexicon: entries, and the G statistic that an entry needs.
MAX_LEXICON = 20_000
MIN_G = 30.0
PREFIXES = (4, 5, 6)
NEGATION_REACH = 3
#: MinHash values by which near copies in the sample are told.
SIGNATURES = 3

# Form-changing words and phrases (lower case) in the languages at hand.
NEGATIONS = frozenset("not never no cannot nicht kein keine nie ne pas jamais nunca jamás".split())
SPEECH = frozenset("said says quoted reported wrote called sagte schrieb laut dit écrit selon dijo escribió según".split())
TARGETS = frozenset("you your yours du dich dir euch tu toi vous tú usted ustedes".split())
THREATS = frozenset("kill hurt destroy beat attack töten verletzen tuer frapper matar golpear".split())
PHRASES = {
    ("according", "to"): "speech", ("in", "the", "words", "of"): "speech", ("d", "après"): "speech", ("by", "no", "means"): "negation", ("far", "from"): "negation",
    ("anything", "but"): "negation", ("all", "of", "them"): "target", ("those", "people"): "target",
}

FORMS = ("plain", "negated", "reported", "targeted", "threat")
#: Quotation marks, and which marks close what each of them opens.
QUOTES = {'"': '"', "„": "“”", "“": "”", "”": "”", "«": "»", "»": "«"}
_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[\"“”„«»]")
_MARKS = re.compile("|".join(map(re.escape, [*QUOTES, "\n"])).encode())
_CLAUSE_END = np.zeros(256, dtype=bool)
_CLAUSE_END[[ord(c) for c in ".!?;\n"]] = True
_ASCII_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@dataclass
class Lexicon:
    """Weights by word hash, and by the first n bytes of a word."""

    words: dict[int, float] = field(default_factory=dict)
    prefixes: dict[int, dict[int, float]] = field(default_factory=dict)

    def weight(self, word: bytes, hashed: int) -> float:
        best = self.words.get(hashed, 0.0)
        for n, table in self.prefixes.items():
            if len(word) >= n:
                best = max(best, table.get(int.from_bytes(word[:n], "little"), 0.0))
        return best


@dataclass
class Model:
    lexicon: Lexicon
    coefficients: list[float]  # bias, then one for each form
    learned: bool


# Transducers: (state, symbol) -> (state, symbol). A symbol is (kind, form); the kind of a word that phrases
# have is (kind of its own, word).
def symbol_of(token: str, weight: float) -> tuple:
    """The symbol of a token: what the insult and threat transducers, which have one state each, make of it."""
    if token in QUOTES:
        return token, ""
    word = token.lower().replace("’", "'")
    kind = "insult" if weight else "word"
    if word in NEGATIONS or word.endswith("n't") or word.startswith("n'"):
        kind = "negation"
    else:
        for name, words in (("speech", SPEECH), ("target", TARGETS), ("threat", THREATS)):
            if word in words:
                kind = name
    form = {"insult": "plain", "threat": "threat"}.get(kind, "")
    return ((kind, word) if any(word in p for p in PHRASES) else kind), form


def phrase_step(state: tuple, s: tuple) -> tuple[tuple, tuple]:
    """State: the words of a phrase that came so far."""
    if not isinstance(s[0], tuple):
        return (), s
    (kind, word), form = s
    for so_far in ((*state, word), (word,)):
        if so_far in PHRASES:
            return (), (PHRASES[so_far], "")
        if any(p[: len(so_far)] == so_far for p in PHRASES):
            return so_far, (kind, form)
    return (), (kind, form)


def negation_step(state: int, s: tuple) -> tuple[int, tuple]:
    """State: words for which a negation still holds."""
    if s[0] == "negation":
        return NEGATION_REACH, s
    if s[0] in QUOTES:
        return state, s
    if state and s[1]:
        s = (s[0], "negated")
    return max(0, state - 1), s


def quoted_step(state: str, s: tuple) -> tuple[str, tuple]:
    """State: the mark that opened a quotation, if one is open."""
    if s[0] in QUOTES:
        return ("" if s[0] in QUOTES[state] else state) if state else s[0], s
    return state, ((s[0], "reported") if state and s[1] in ("plain", "threat") else s)


def reported_step(state: int, s: tuple) -> tuple[int, tuple]:
    """State: 1 behind a speech verb."""
    if s[0] == "speech":
        return 1, s
    return state, ((s[0], "reported") if state and s[1] in ("plain", "threat") else s)


def target_step(state: int, s: tuple) -> tuple[int, tuple]:
    """State: 1 behind an addressed person."""
    if s[0] == "target":
        return 1, s
    return state, ((s[0], "targeted") if state and s[1] == "plain" else s)


class Machine:
    """The composition of transducers: each reads what the one before gives out. Its table holds the pairs met so far."""

    def __init__(self, *steps) -> None:
        self.steps, self.table = steps, {}

    def step(self, states: tuple, symbol: tuple) -> tuple[tuple, str]:
        """The next states, and the form that comes out."""
        known = self.table.get((states, symbol))
        if known is None:
            after, s = [], symbol
            for state, one in zip(states, self.steps, strict=True):
                state, s = one(state, s)
                after.append(state)
            known = self.table[states, symbol] = (tuple(after), s[1])
        return known


GRAMMAR = Machine(phrase_step, negation_step, quoted_step, reported_step, target_step)


def clause_weights(clause: str, lexicon_weight, quote: str = "") -> dict[str, float]:
    """Summed weights of the forms that the composed grammar finds in one clause; ``quote``: the mark open at its start."""
    states, found, step = ((), 0, quote, 0, 0), {}, GRAMMAR.step
    for token in _TOKEN.findall(clause):
        weight = lexicon_weight(token)
        states, form = step(states, symbol_of(token, weight))
        if form:
            found[form] = found.get(form, 0.0) + (weight or 1.0)
    return found


def open_quotes(text: bytes, at: list[int]) -> list[str]:
    """The quotation mark that is open at each of the ascending places of a text; line ends close all."""
    out, state, marks = [], "", _MARKS.finditer(text)
    mark = next(marks, None)
    for place in at:
        while mark is not None and mark.start() < place:
            state = "" if mark[0] == b"\n" else quoted_step(state, (mark[0].decode(), ""))[0]
            mark = next(marks, None)
        out.append(state)
    return out


def _lookup(table: dict[int, float]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.array(sorted(table), dtype=np.uint64)
    return keys, np.array([table[int(k)] for k in keys])


def _first_bytes(words: Words, n: int) -> np.ndarray:
    eight = np.ndarray(shape=(len(words.buf) - 7,), dtype="<u8", buffer=words.buf.data, strides=(1,))
    return eight[words.starts] & np.uint64((1 << 8 * n) - 1)


def matched_words(words: Words, lexicon: Lexicon) -> np.ndarray:
    """Numbers of the words that the insult or threat lexicon has."""
    hit = np.zeros(len(words), dtype=bool)
    lens = words.ends - words.starts

    def among(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
        place = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
        return keys[place] == values

    hashed = word_hashes(words)
    # A scan lower-cases ASCII only: other letters of the threat words may be capitals.
    threats = {v.translate(_ASCII_LOWER) for w in THREATS for v in (w, w.upper(), w.capitalize())}
    keys = np.array(sorted({*lexicon.words, *_hash_words(threats)}), dtype=np.uint64)
    hit |= among(hashed, keys)
    for n, table in lexicon.prefixes.items():
        if table:
            hit |= (lens >= n) & among(_first_bytes(words, n), _lookup(table)[0])
    return np.flatnonzero(hit)


def _hash_words(words) -> list[int]:
    words = sorted(words)
    return word_hashes(scan(pa.array(words), ALNUM_WORDS, lower=True)).tolist() if words else []


def text_features(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """Summed clause weights of each text: one row of len(FORMS) values."""
    words = scan(texts, ALNUM_WORDS, lower=True)
    out = np.zeros((len(texts), len(FORMS)))
    hits = matched_words(words, lexicon)
    if not len(hits):
        return out
    text_of = np.searchsorted(words.first, hits, side="right") - 1
    data = words.buf[: len(words.inside)]
    ends = np.flatnonzero(_CLAUSE_END[data])
    lower = np.searchsorted(ends, words.starts[hits], side="right")
    # Clauses end at punctuation and at the borders of a text.
    offsets = string_bytes(texts)[1]
    begin = np.maximum(np.where(lower > 0, ends[np.maximum(lower - 1, 0)] + 1 if len(ends) else 0, 0), offsets[text_of])
    finish = np.minimum(np.where(lower < len(ends), ends[np.minimum(lower, len(ends) - 1)] if len(ends) else len(data), len(data)), offsets[text_of + 1])
    raw, cache = string_bytes(texts)[0].tobytes(), {}

    def weight(token: str) -> float:
        """The largest weight of a token's parts (of words with apostrophes), which are lower-cased as the scan does it."""
        if token not in cache:
            lower = token.translate(_ASCII_LOWER)
            parts = scan(pa.array([lower]), ALNUM_WORDS)
            spans = zip(parts.starts.tolist(), parts.ends.tolist(), word_hashes(parts).tolist(), strict=True)
            encoded = lower.encode()
            cache[token] = max((lexicon.weight(encoded[a:b], h) for a, b, h in spans), default=0.0)
        return cache[token]

    clauses = np.unique(np.stack([text_of, begin, finish], axis=1), axis=0)
    edges = np.flatnonzero(np.append(True, np.append(clauses[1:, 0] != clauses[:-1, 0], True)))
    for first, last in zip(edges.tolist(), edges[1:].tolist(), strict=False):
        own = clauses[first:last].tolist()
        origin = int(offsets[own[0][0]])
        quotes = open_quotes(raw[origin : int(offsets[own[0][0] + 1])], [a - origin for _, a, _ in own])
        for (text, a, b), quote in zip(own, quotes, strict=True):
            for form, value in clause_weights(raw[a:b].decode(errors="replace"), weight, quote).items():
                out[text, FORMS.index(form)] += value
    return out


def _scores(features: np.ndarray, model: Model) -> np.ndarray:
    if not model.learned:
        return np.zeros(len(features))
    z = model.coefficients[0] + np.log1p(features) @ np.array(model.coefficients[1:])
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score(docs: DataFrame, model: Model, carry: list[str]) -> DataFrame:
    """``carry`` columns of every document, the summed weights of each form, and the score."""
    small_batches(docs.sparkSession)
    send = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_LEXICON entries
    source = docs.select(*dict.fromkeys([*carry, "text"]))
    schema = ", ".join([*(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in carry), *(f"{f}_weight double" for f in FORMS), "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in passes(batch, "text"):
                features = text_features(part.column("text"), send.value.lexicon)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in carry), *(pa.array(features[:, i]) for i in range(len(FORMS))), pa.array(_scores(features, send.value))],
                    names=[*carry, *(f"{f}_weight" for f in FORMS), "score"],
                )

    return source.mapInArrow(run, schema)


def _sample(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """Text and label (y) of the rows that may be learned from, per class those of least hash."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("y")).where(~held_out(F.col("doc_id"), 5, 0))
    # At most 2 * per_class ids are broadcast; rows that share an id are ranked again.
    chosen = cut(least_hashed(known, "y", per_class, "doc_id"), "toxicity-labels")
    drawn = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(F.broadcast(chosen), "doc_id")
    few = least_hashed(drawn, "y", per_class, "doc_id", "text")
    signed = cut(few.select("doc_id", "text", "y").mapInArrow(_sign, f"doc_id long, text string, y int, {', '.join(f'm{i} long' for i in range(SIGNATURES))}"), "toxicity")
    # Of near copies one counts: else every word of a much copied toxic text would look toxic.
    for i in range(SIGNATURES):
        one = Window.partitionBy(f"m{i}").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
        signed = signed.withColumn("rank", F.row_number().over(one)).where("rank = 1").drop("rank")
    return signed.select("text", "y")


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """MinHash values of each text over runs of five words (shorter texts: over their words)."""
    for batch in batches:
        for part in passes(batch, "text"):
            words = scan(part.column("text"), ALNUM_WORDS, lower=True)
            hashed, counts = word_hashes(words), words.counts
            runs = run_hashes(np.append(hashed, np.zeros(4, dtype=np.uint64)), 5)
            has = np.flatnonzero(counts)
            mins = []
            for i in range(SIGNATURES):
                low = np.zeros(len(counts), dtype=np.uint64)
                if len(has):
                    # The last four runs reach into the next text; they are left out where there are others.
                    value = combine(runs, np.full(len(runs), i, dtype=np.uint64))
                    inside = np.arange(len(runs)) < np.repeat(np.where(counts > 4, words.first[1:] - 4, words.first[1:]), counts)
                    value[~inside] = np.iinfo(np.uint64).max
                    low[has] = np.minimum.reduceat(value, words.first[has])
                mins.append(pa.array(low.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), part.column("y"), *mins], names=["doc_id", "text", "y", *(f"m{i}" for i in range(SIGNATURES))])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class that have a word (n = 0) or a word beginning of n bytes."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for part in passes(batch, "text"):
            words = scan(part.column("text"), ALNUM_WORDS, lower=True)
            raw, y = words.buf.tobytes(), part.column("y").to_pylist()
            for d in range(part.num_rows):
                at = slice(words.first[d], words.first[d + 1])
                own = {raw[a:b] for a, b in zip(words.starts[at].tolist(), words.ends[at].tolist(), strict=True)}
                keys = {(0, w) for w in own}
                for n in PREFIXES:
                    keys |= {(n, w[:n]) for w in own if len(w) > n}
                counts[y[d]].update(keys)
    keys = list(counts[0].keys() | counts[1].keys())
    for at in range(0, len(keys), 50_000):
        few = keys[at : at + 50_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in few], type=pa.int32()), pa.array([k[1] for k in few], type=pa.binary()), *(pa.array([counts[c][k] for k in few], type=pa.int64()) for c in (0, 1))],
            names=["n", "form", "clean", "toxic"],
        )


def _lexicon(sample: DataFrame) -> Lexicon:
    sizes = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        return Lexicon()
    counted = sample.mapInArrow(_count_words, "n int, form binary, clean long, toxic long").groupBy("n", "form").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    # G statistic of the two counts against the classes' sizes; only what leans to toxic.
    total = F.col("clean") + F.col("toxic")
    part = lambda c, n: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) * (n0 + n1) / (total * n))).otherwise(0.0)
    odds = F.log((F.col("toxic") + 0.5) / (n1 + 1)) - F.log((F.col("clean") + 0.5) / (n0 + 1))
    rows = counted.withColumn("g", 2 * (part("clean", n0) + part("toxic", n1))).withColumn("odds", odds)
    top = rows.where((F.col("g") >= MIN_G) & (F.col("odds") >= 2.5)).orderBy(F.desc("g"), "n", "form").limit(MAX_LEXICON).collect()
    found = Lexicon(prefixes={n: {} for n in PREFIXES})
    for r in sorted(top, key=lambda r: (r.n == 0, r.n, r.form)):  # a beginning stands for all words that it has
        word, weight = bytes(r.form), float(min(r.odds, 8.0))
        if any(found.prefixes[n].get(int.from_bytes(word[:n], "little"), 0) >= weight - 1 for n in PREFIXES if len(word) >= n):
            continue
        if r.n:
            found.prefixes[r.n][int.from_bytes(word, "little")] = weight
        else:
            found.words.update(dict.fromkeys(word_hashes(scan(pa.array([word.decode(errors="replace")]), ALNUM_WORDS)).tolist(), weight))
    return found


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> list[float]:
    """Coefficients of a ridge logistic regression by Newton steps; form weights do not go below zero."""
    a = np.hstack([np.ones((len(x), 1)), np.log1p(x)])
    ridge = np.diag([1e-3, *[0.05] * x.shape[1]])
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge
        w = w - np.clip(np.linalg.solve(h, a.T @ (p - y) + ridge @ w), -2, 2)
        w[1:] = np.maximum(w[1:], 0)
    return w.tolist()


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Learn lexicon and form weights from the sample outside the held-out part (crc32 mod 5 = 0)."""
    small_batches(docs.sparkSession)
    sample = cut(_sample(docs, labels, per_class), "toxicity")
    lexicon = _lexicon(sample)
    if not lexicon.words and not any(lexicon.prefixes.values()):
        return Model(lexicon, [0.0] * (1 + len(FORMS)), False)
    # 2 * per_class rows of a few numbers come to the driver.
    seen = np.array(score(sample, Model(lexicon, [0.0] * (1 + len(FORMS)), True), ["y"]).toPandas(), dtype=float)
    return Model(lexicon, _logistic(seen[:, 1 : 1 + len(FORMS)], seen[:, 0]), True)
