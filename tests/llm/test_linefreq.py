"""Figures of words and lines, and the verdict by common lines, against plain versions."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loomstone.llm import linefreq

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeated(words, window=8):
    seen = defaultdict(list)
    for i in range(len(words) - window + 1):
        seen[tuple(words[i : i + window])].append(i)
    return len({j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + window)})


def brute(docs, min_docs, percent, least, min_words=20):
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_common_words, base_failed, kept, clean_text)"""
    plain = lambda line: re.sub("[0-9]+", "0", " ".join(WORD.findall(line.lower())))
    lines, hosts = Counter(), defaultdict(set)
    for _, text, host in docs:
        hosts[host].add(text or "")
    for host, texts in hosts.items():
        for text in texts:
            lines.update((host, x) for x in {plain(line) for line in text.split("\n")} if x)
    common = {x for x, n in lines.items() if n > min_docs and 100 * n > percent * len(hosts[x[0]])}
    out = []
    for i, text, host in docs:
        t = text or ""
        w, split = WORD.findall(t), t.split("\n")
        goes = [(host, plain(line)) in common for line in split]
        lost = sum(len(WORD.findall(line)) for line, g in zip(split, goes, strict=True) if g)
        worded = [line for line in split if WORD.search(line)]
        repeat = repeated(w)
        failed = len(w) < min_words or 100 * repeat > 30 * len(w)
        left = len(w) - lost
        kept = not failed and not (lost and (left < min_words or 100 * left < least * len(w)))
        clean = "\n".join(line for line, g in zip(split, goes, strict=True) if not g)
        out.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(worded) - len(set(worded)), repeat, lost, failed, kept, clean))
    return sorted(out, key=str)


def odd(seed=5):
    rng = random.Random(seed)
    footers = ["All rights  reserved 2019", "all rights reserved 2020", "Click here to subscribe to our letter\tnow", "é Ü mixed"]
    docs = []
    for i in range(150):
        lines = [" ".join(rng.choice(["red", "Blue", "grün", "x<y", "$5", "a|b"]) + str(rng.randrange(40)) for _ in range(rng.choice([0, 1, 9, 25]))) for _ in range(rng.randrange(1, 6))]
        lines.insert(rng.randrange(len(lines) + 1), rng.choice(footers))
        if i % 6 == 0:
            lines += lines[:2]
        docs.append((i, rng.choice(["\n", "\n\n", "\r\n"]).join(lines), rng.choice(["a", "a", "a", "b", None, ""])))
    docs += [docs[0]] * 30 + [(200 + i, docs[7][1], "a") for i in range(20)]
    docs += [(None, None, None), (None, "", "a"), (300, "\n\n", "b"), (301, "one two three four five six seven eight", "a"), (302, "word " * 9, "a"), (303, "tick tock " * 4000 + "end", "a"), (304, " ".join(map(str, range(5000))) + "\n" + " ".join(map(str, range(5000))), "b")]
    return docs


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(linefreq, "BROADCAST_LINES", limit)
    docs = odd()
    table = spark.createDataFrame([(*d, 1, "z") for d in docs], "doc_id long, text string, source string, row long, lines string").repartition(4)
    found = linefreq.line_quality(table, min_docs=8, percent=5, least=60)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_common_words", "base_failed", "kept", "clean_text"]
    got = sorted((tuple(r) for r in found.select(*names).collect()), key=str)
    want = brute(docs, 8, 5, 60)
    assert got == want
    assert any(r[6] and r[8] for r in want) and any(r[6] and not r[7] and not r[8] for r in want)


def test_carried_columns_of_any_name(spark):
    table = spark.createDataFrame([(1, "w " * 30, "h", "k")], "doc_id long, text string, source string, digest string")
    assert linefreq.line_quality(table, ["doc_id", "source", "digest"]).first()["digest"] == "k"


def test_repeats_of_a_long_text_take_no_square(spark):
    words = [str(i) for i in range(60_000)] * 2
    row = spark.createDataFrame([(" ".join(words),)], "text string").select(F.split("text", " ").alias("w"))
    assert row.select(linefreq.repeat_words(F.col("w")).alias("n")).first()["n"] == len(words)


def test_no_python_in_the_plan(spark):
    table = spark.createDataFrame([(1, "w", "h")], "doc_id long, text string, source string")
    plan = linefreq.line_quality(table)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
