"""Collocations against counts of every run of words."""

import random
import re
from collections import Counter

import pytest

from loomstone.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, longest, frequent, scale=1000, contained=100, top=2000):
    counts, totals = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            counts.update((lang, tuple(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    f = {p: n for p, n in counts.items() if n >= frequent}
    outer = Counter()
    for (lang, p), n in f.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                outer[lang, p[i : i + k]] = max(outer[lang, p[i : i + k]], n)
    rows = []
    for (lang, p), a in f.items():
        if len(p) < 2 or ((lang, p) in outer and 100 * outer[lang, p] >= contained * a):
            continue
        score, k = min((scale * a * totals[lang] // (f[lang, p[:c]] * f[lang, p[c:]]), c) for c in range(1, len(p)))
        rows.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], totals[lang]))
    rank, out = Counter(), []
    for lang, score, a, phrase, left, right, n in sorted(rows):
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], phrase.decode(), -a, left, right, n, -score))
    return out


def odd():
    rng = random.Random(3)
    vocabulary = ["the", "of", "New", "york", "é", "Ünder", "state's", "a-b", "extraordinarily", "extraordinary", "x"]
    docs = []
    for _ in range(200):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 5, 60]))]
        words.insert(rng.randrange(len(words) + 1), "New York  state's\tbest of")
        docs.append(("".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "; "]) for w in words), rng.choice(["en", "en", "de", None, "und", ""])))
    return docs + [(None, None), ("", "en"), (" ,, !", "fr"), ("one two", "fr"), ("go on " * 3000, "en")] + [("same line here", "de")] * 40


@pytest.mark.parametrize(("longest", "frequent", "contained", "top"), [(5, 3, 100, 2000), (3, 10, 60, 7), (5, 100, 100, 2000)])
def test_against_brute_force(spark, longest, frequent, contained, top):
    docs = odd()
    table = spark.createDataFrame([(*d, 1) for d in docs], "text string, lang string, phrase int").repartition(4)
    got = collocations.collocations(table, longest, frequent, contained=contained, top=top)
    want = brute(docs, longest, frequent, contained=contained, top=top)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and want


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "LEAST_BITS", 64)
    monkeypatch.setattr(collocations, "MOST_BITS", 64)
    docs = odd()
    got = collocations.collocations(spark.createDataFrame(docs, "text string, lang string"), frequent=3)
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute(docs, 5, 3))


def test_levels_below_the_threshold_stop(spark):
    tables = collocations.levels(spark.createDataFrame([("a b a b a b. c d", "en")], "text string, lang string"), frequent=3)
    assert [sorted((r.phrase, r.n) for r in t.collect() if r.phrase) for t in tables] == [[("a", 3), ("b", 3)], [("a b", 3)], []]


def test_products_past_64_bits(spark):
    big = 3_000_000_000_000
    one = spark.createDataFrame([("en", None, 10 * big), ("en", "a", big), ("en", "b", big)], "lang string, phrase string, n long")
    two = spark.createDataFrame([("en", "a b", big - 7)], "lang string, phrase string, n long")
    assert collocations.scored([one, two]).first()["score"] == 1000 * (big - 7) * 10 * big // (big * big)
