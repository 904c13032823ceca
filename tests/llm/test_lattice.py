"""The audit of filters against a plain walk of every order."""

import re
from collections import Counter
from itertools import permutations

from loomstone.llm import lattice

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, labels):
    """Rows of the audit by following every document through every order."""
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    said = {1: set(), 2: set()}
    for row in labels:
        for c in said:
            if row[c] == 1 and row[0] is not None:
                said[c].add(row[0])
    failing, out = [], []
    for i, text, lang in docs:
        t = text or ""
        w = WORDS.findall(t)
        tests = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > least[t]]
        failing.append((lang or "", {c for c, f in zip("ABCDE", tests, strict=True) if f}, i in said[1], i in said[2]))
    for part in {f[0] for f in failing}:
        removals, rows = Counter(), []
        for order in permutations("ABCDE"):
            rest = [f for f in failing if f[0] == part]
            for step, c in enumerate(order, 1):
                gone = [f for f in rest if c in f[1]]
                rest = [f for f in rest if c not in f[1]]
                all_failing = [f for f in failing if f[0] == part and c in f[1]]
                removals[c] += len(gone)
                rows.append((part, "".join(order), step, len(rest), len(gone), len(all_failing) - len(gone), sum(f[1] == {c} for f in all_failing), sum(f[2] for f in gone), sum(f[3] for f in gone)))
        out += [(*r, removals[r[1][r[2] - 1]]) for r in rows]
    return sorted(out)


def odd():
    long = " ".join(f"word{i}" for i in range(210))
    texts = [long, long + " x", long.upper(), "a " * 300, long + " # %", "", None, "Short one", long.replace("word1", "WORD1"), "a|b " * 250]
    docs = [(i, texts[i % len(texts)], ("en", "de", None, "", "e'\\")[i % 5]) for i in range(60)]
    docs += [(None, long, "en"), (None, None, None), (3, texts[3], "en"), (3, texts[3], "de"), (100, long, "xx")]
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(50)] + [(4, 1, 0), (4, None, 1), (None, 1, 1), (999, 1, 1)]
    return docs, labels


def test_every_order(spark):
    docs, labels = odd()
    table = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, lang string, mask int, part string").repartition(5)
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted(tuple(r) for r in lattice.audit(lattice.corpus_masks(table), said).collect())
    assert got == brute(docs, labels) and len(got) == 600 * 5


def test_hot_text_is_joined_by_broadcast(spark):
    docs = [(i, "the same" if i % 3 else f"text {i}", "en") for i in range(600)]
    got = lattice.audit(lattice.corpus_masks(spark.createDataFrame(docs, "doc_id long, text string, lang string")), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert sorted(tuple(r) for r in got.collect()) == brute(docs, [])


def test_fewer_filters(spark):
    masks = spark.createDataFrame([(1, "p", 1, 1), (2, "p", 3, 1), (3, "p", 0, 1)], "doc_id long, part string, mask int, count long")
    got = lattice.audit(masks, spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int"), letters="XY")
    rows = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got.collect()}
    assert rows == {("XY", 1): (1, 2, 0, 1, 1, 0, 3), ("XY", 2): (1, 0, 1, 0, 0, 0, 1), ("YX", 1): (2, 1, 0, 0, 1, 0, 1), ("YX", 2): (1, 1, 1, 1, 0, 0, 3)}
