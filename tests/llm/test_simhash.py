import random
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from loomstone.llm import simhash


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(prints, radius=4):
    """prints: list of (doc_id, fp) -> list of (doc_id, fp, smallest doc_id reachable)."""
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j][1]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, f, least.get(find(i))) for i, (d, f) in enumerate(prints)]


def as_rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_fingerprints_match_the_definition():
    texts = ["Hello World  foo bar baz\n qux", None, "", " \t", "one", "a b c d", "É b\tC " + "x" * 90 + " y z", "a b c a b c a b c a b c " * 500]
    assert simhash.fingerprints_of(pa.array(texts)).tolist() == [brute_fingerprint(t) for t in texts]


def test_bk_tree_finds_exactly_the_values_in_range():
    rng = random.Random(5)
    values = [rng.getrandbits(16) for _ in range(300)]
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for v in values[:60]:
        assert sorted(set(tree.within(v, 3))) == sorted({x for x in values if (x ^ v).bit_count() <= 3})


def test_classes_match_brute_force_with_nulls_copies_and_chains(spark):
    base = [f"w{i} " * 3 + " ".join(f"t{i}x{j}" for j in range(60)) for i in range(25)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, t.replace("x5", "y5", 1)) for i, t in enumerate(base)]
    rows += [(200 + i, base[3]) for i in range(40)] + [(7, base[7]), (None, base[8]), (None, "only null ids here once"), (300, None), (301, ""), (302, "  ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("shard", F.lit(1))
    for limit in (2048, 3):  # a small limit splits the shards
        got = simhash.near_duplicates(docs, tree_limit=limit).select("doc_id", "fp", "component_id")
        want = brute_classes([(d, brute_fingerprint(t)) for d, t in rows])
        assert as_rows(got) == sorted(((d, f - (f >> 63 << 64), c) for d, f, c in want), key=str)


def test_chains_of_links_reach_across_shards(spark):
    import random

    rng, prints = random.Random(9), []
    for start in range(20):
        fp = rng.getrandbits(64)
        for step in range(12):  # each within four bits of the one before
            prints.append((len(prints), fp))
            for b in rng.sample(range(64), rng.choice([1, 4, 4])):
                fp ^= 1 << b
    signed = [(f - (f >> 63 << 64),) for _, f in prints]
    edges = simhash.links(spark.createDataFrame(signed, "fp long").distinct())
    from loomstone.llm.components import components

    roots = {r.node: r.root for r in components(edges).collect()}
    want = {}
    for d, f, c in brute_classes(prints):
        want.setdefault(c, set()).add(f - (f >> 63 << 64))
    got = {}
    for (f,) in signed:
        got.setdefault(roots.get(f, f), set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).collect() == []


def test_similar_documents_by_five_word_shingles(spark):
    import random

    rng = random.Random(12)
    fresh = lambda n: [rng.choice(["the", "of", "on", "in"]) if rng.random() < 0.4 else f"w{rng.randrange(4000)}" for _ in range(n)]
    rows, want = [], {}
    for g in range(40):
        base = fresh(rng.choice([120, 400]))
        first = len(rows)
        rows.append((first, " ".join(base)))
        for _ in range(rng.choice([0, 1, 3])):  # near copies: one word in a hundred edited
            w = list(base)
            for _ in range(len(w) // 100):
                w[rng.randrange(len(w))] = "edited"
            rows.append((len(rows), " ".join(w)))
        want.update(dict.fromkeys(range(first, len(rows)), first))
        w = [x if rng.random() < 0.9 else "other" for x in base]  # a tenth of all words: not similar
        want[len(rows)] = len(rows)
        rows.append((len(rows), " ".join(w)))
    rows += [(5000, None), (5001, ""), (5002, rows[0][1].upper()), (None, rows[0][1]), (5003, "two words"), (5004, "words two"), (5004, "words two")]
    want |= {5000: 5000, 5001: 5000, 5002: 0, None: 0, 5003: 5003, 5004: 5004}
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sketch", F.lit("clash"))
    for limit in (2048, 2):
        got = {r.doc_id: r.component_id for r in simhash.similar_documents(docs, tree_limit=limit).collect()}
        assert got == want
    assert simhash.similar_documents(docs.limit(0)).collect() == []


def brute_similar(rows, similarity=0.8, shingle=5):
    """rows: (doc_id, text) -> list of classes as sets of row numbers, by exact Jaccard of shingle sets."""
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        return {tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set()

    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if (not a and not sets[j]) or (a and sets[j] and 5 * len(a & sets[j]) >= 4 * len(a | sets[j])):
                parent[find(i)] = find(j)
    classes = {}
    for i in range(len(rows)):
        classes.setdefault(find(i), set()).add(i)
    return sorted(map(sorted, classes.values()))


def classes_of(df):
    classes = {}
    for r in df.collect():
        classes.setdefault(r.class_id, set()).add(r.doc_id)
    return sorted(map(sorted, classes.values()))


def test_similar_documents_finds_all_links_at_the_threshold_and_no_others(spark, monkeypatch):
    import random

    rng, rows = random.Random(31), []
    for g in range(40):  # similarities from 0.6 to 1, by scattered edits, and by cut or appended words
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([30, 104, 204]))] + ["a", "footer", "line", "in", "all", "texts", "here"]
        rows.append((len(rows), " ".join(base)))
        for _ in range(6):
            w = list(base)
            for _ in range(int(len(w) * rng.uniform(0, 0.05))):
                w[rng.randrange(len(w))] = f"x{rng.randrange(9999)}"
            rows.append((len(rows), " ".join(w)))
            rows.append((len(rows), " ".join(base + [f"y{rng.randrange(9999)}" for _ in range(int(len(base) * rng.uniform(0, 0.35)))])))
    rows.append((len(rows), " ".join(f"w{i}" for i in range(104))))  # 100 shingles, and exactly 80 of them
    rows.append((len(rows), " ".join(f"w{i}" for i in range(84))))
    want = brute_similar(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert classes_of(simhash.similar_documents(docs)) == want
    # Also where fingerprints propose next to nothing and lists are compared in pieces.
    monkeypatch.setattr(simhash, "LIST_BLOCK", 2)
    assert classes_of(simhash.similar_documents(docs, radius=0)) == want


def test_shingle_sets_do_not_tell_how_often_a_line_repeats():
    words = " ".join(f"w{i}" for i in range(100))
    line = "\n" + " ".join(f"l{i}" for i in range(10))
    prints, hashes, offsets = simhash.shingle_sets_of(pa.array([words + line * 3, None, words + line * 30]), 5)
    a, none, b = (hashes[x:y].tolist() for x, y in zip(offsets, offsets[1:], strict=False))
    assert a == b and len(a) == 96 + 10 + 4 and none == [] and prints[0] == prints[2]


def test_parities_bound_the_difference_from_below():
    rng = np.random.default_rng(4)
    for n, m, common in [(0, 5, 0), (30, 40, 20), (900, 850, 700), (5000, 4300, 4000), (3, 4000, 3)]:
        pool = rng.integers(0, 1 << 63, n + m).astype(np.uint64)
        a, b = pool[:n], np.append(pool[:common], pool[n : n + m - common])
        bound = simhash._difference(simhash._parities(a), simhash._parities(b))
        apart = n + m - 2 * common
        assert bound <= apart and (bound - apart) % 2 == 0
        if n > 100:
            assert bound > 0.6 * apart
        size = simhash.SKETCH_BITS // 8
        x, y = (simhash._folded(simhash._parities(v), size) for v in (a, b))
        assert len(x) == size and int(np.bitwise_count(x ^ y).sum()) <= apart


def test_lists_come_in_any_batches():
    rng = np.random.default_rng(5)
    shingle = np.sort(rng.integers(0, 90, 300))
    node = rng.integers(0, 6, 300)
    order = np.lexsort((node, shingle))
    columns = [shingle[order], node[order]]
    whole = None
    for step in (300, 41, 2, 1):
        batches = [simhash._table(a=columns[0][i : i + step], b=columns[1][i : i + step]) for i in range(0, 300, step)]
        pairs = []
        for (a, b), kept, _ in simhash._overlapping(iter(batches), 3):
            pairs += [(int(a[j]), int(b[i]), int(b[j])) for j in range(kept, len(a)) for i in range(max(0, j - 3), j) if a[i] == a[j]]
        whole = whole or sorted(pairs)
        assert sorted(pairs) == whole


def test_planted_near_copies_at_the_threshold_are_found(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows, planted, similar = [], [], lambda a, b: len(a & b) / len(a | b)
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    while len(planted) < 60:
        base = [word() for _ in range(rng.choice([60, 150, 400]))]
        copy = list(base)
        while similar(grams(base), grams(copy)) > 0.85:
            copy[rng.randrange(len(copy))] = word()
        if similar(grams(base), grams(copy)) >= 0.8:
            planted.append((2 * len(planted), 2 * len(planted) + 1))
            rows += [(planted[-1][0], " ".join(base)), (planted[-1][1], " ".join(copy))]
    rng.shuffle(rows)
    got = {r.doc_id: r.class_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum(got[a] == got[b] for a, b in planted)
    assert found == len(planted) and len(set(got.values())) == len(planted)
