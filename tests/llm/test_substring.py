import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstone.llm import substring


def brute(docs, window=20):
    """docs: (doc_id, text) -> doc_id, words, removed, sha, by the definition."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    order = lambda i, p: (docs[i][0] is not None, docs[i][0] or 0, p)
    first = {}
    for i, w in enumerate(words):
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            first[key] = min(first.get(key, order(i, p)), order(i, p))
    out = []
    for i, w in enumerate(words):
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < order(i, p):
                gone.update(range(p, p + window))
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((docs[i][0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def corpus(seed, n=120, vocabulary=400):
    rng = random.Random(seed)
    fresh = lambda k: [f"w{rng.randrange(vocabulary)}é" for _ in range(k)]
    passages = [fresh(rng.choice([19, 20, 21, 35, 90])) for _ in range(12)]
    docs = []
    for d in range(n):
        w = fresh(rng.choice([0, 3, 30, 120]))
        for _ in range(rng.choice([0, 1, 3])):
            p = list(rng.choice(passages))
            if rng.random() < 0.4:
                p[rng.randrange(len(p))] = "edited"
            a = rng.randrange(len(p) // 2)
            w += p[a:] + fresh(rng.choice([0, 2]))
        docs.append((d * 3, rng.choice([" ", "\n", " \t "]).join(w)))
    docs += [(1000 + i, docs[5][1]) for i in range(30)]
    docs += [(2000, "be " * 700 + "the " * 50), (2001, "the " * 30), (2002, None), (2003, ""), (None, docs[7][1])]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed,vocabulary", [(1, 400), (2, 3)])
def test_removed_words_match_brute_force(spark, seed, vocabulary):
    docs = corpus(seed, vocabulary=vocabulary)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("k", F.lit("clash")).withColumn("spans", F.lit(1)).repartition(5)
    for shard_words, anchor_words in ((substring.SHARD_WORDS, substring.ANCHOR_WORDS), (100, 30)):
        got = sorted(map(tuple, substring.remove_repeats(df, shard_words=shard_words, anchor_words=anchor_words).collect()), key=str)
        assert got == sorted(brute(docs), key=str)


def test_strands_of_an_anchor_come_in_any_batches():
    rng = np.random.default_rng(4)
    n = 400
    rows = np.stack([rng.choice([3, 3, 3, 8, 9, *range(20, 60)], n), rng.integers(0, 6, n), rng.integers(0, 9, n), rng.integers(0, 2, n), rng.integers(0, 4, n), np.full(n, 20)])
    rows = rows[:, np.lexsort(rows[::-1])]
    names = ("route", "strand", "doc", "k", "start", "size")
    outs = []
    for step in (n, 37, 1):
        batches = [substring._rows(**dict(zip(names, rows[:, i : i + step], strict=True)), copy=np.zeros(rows[:, i : i + step].shape[1], dtype=bool)) for i in range(0, n, step)]
        outs.append([r for b in substring._repeated_anchors(iter(batches), 40) for r in b.to_pylist()])
    key = lambda r: tuple(r.values())
    assert all(sorted(o, key=key) == sorted(outs[0], key=key) for o in outs)
    firsts = {(a, s): min(map(tuple, rows[2:5, (rows[0] == a) & (rows[1] == s)].T.tolist())) for a, s in rows[:2].T.tolist()}
    alone = {a for a in rows[0].tolist() if (rows[0] == a).sum() == 1}
    assert sorted((r["anchor"], r["doc"], r["k"], r["start"]) for r in outs[0] if not r["copy"]) == sorted((a, *p) for (a, _), p in firsts.items() if a not in alone)


def test_small_shards_give_the_same(spark):
    rng = random.Random(8)
    strings, at = [], 0
    words = lambda k: [rng.randrange(3) for _ in range(k)]
    for _ in range(40):
        w = words(rng.choice([5, 9, 12]))
        strings.append(((0, 0, at), w))
        at += 100
    seen, want = {}, []
    for (_, _, s), w in strings:
        own = []
        for o in range(len(w) - 3):
            key = tuple(w[o : o + 4])
            if seen.setdefault(key, s + o) < s + o:
                own.append(o)
        want.append(own)
    rng.shuffle(strings)  # shards need not be in order of position
    for limit in (40, 7, 1):
        found = {position: set() for position, _ in strings}
        parts = [strings[i : i + limit] for i in range(0, len(strings), limit)]
        for number, part in enumerate(parts):
            shard = substring.Shard(part, 4)
            for position, w in (s for later in parts[number + 1 :] for s in later):
                found[position].update(shard.visit(position, w))
            for position, own in shard.own():
                found[position].update(own)
        assert [sorted(found[position]) for position in sorted(found)] == want


def test_places_in_pieces():
    rng = np.random.default_rng(2)
    runs = rng.integers(0, 50, 3000).astype(np.uint64) << np.uint64(30)
    want = [i + int(np.argmin(runs[i : i + 13])) for i in range(3000 - 12)]
    for piece in (1 << 22, 500, 13):
        assert substring.leftmost_least(runs, 13, piece).tolist() == want


def test_equal_rows_do_not_remove_each_other_and_empty_tables(spark):
    text = " ".join(f"t{i}" for i in range(40))
    df = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in substring.remove_repeats(df).collect()) == [(1, 0), (1, 0), (2, 40)]
    assert substring.remove_repeats(df.limit(0)).collect() == []
