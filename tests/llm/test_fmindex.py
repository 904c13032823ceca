import random
import re

import numpy as np
from pyspark.sql import functions as F

from loomstone.llm import fmindex


def brute_words(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute(text, items, window=13):
    words, hit, found = brute_words(text), set(), set()
    for item, t in items:
        own = brute_words(t)
        size = min(window, len(own))
        for w in {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else ():
            for i in range(len(words) - size + 1):
                if tuple(words[i : i + size]) == w:
                    hit.update(range(i, i + size))
                    found.add(item)
    return len(words), len(hit), sorted(found)


def test_index_searches_and_locates_every_occurrence():
    rng = np.random.default_rng(3)
    symbols = rng.integers(0, 4, 3000).astype(np.int32)
    symbols[500:800] = 2
    symbols[[0, -1]] = 0
    index = fmindex.FMIndex(symbols, 2)
    text = bytes(symbols.tolist())
    for size in (1, 2, 5, 9):
        patterns = np.array([symbols[i : i + size] for i in rng.integers(1, 2900, 60)] + [[1] * size, [2] * size])
        patterns = patterns[(patterns != 0).all(axis=1)]
        lo, hi = index.search(patterns)
        for p, a, b in zip(patterns, lo, hi, strict=True):
            want = [i for i in range(len(text)) if text.startswith(bytes(p.tolist()), i)]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def corpus():
    rng = random.Random(4)
    word = lambda: rng.choice(["the", "of", "An", "Über", "x1", "ça", "zed", "q"])
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 12, 13, 14, 30])))) for i in range(30)]
    items += [(90, None), (91, ""), (92, "?!"), (93, items[3][1]), (94, "Solo")]
    docs = []
    for d in range(80):
        text = " ".join(word() for _ in range(rng.choice([0, 1, 5, 40, 300])))
        for _ in range(d % 4):
            text += "\n" + rng.choice(items[:30])[1].upper() + "!! " + "tail, " * rng.choice([0, 3])
        docs.append((d, text))
    docs += [(200, None), (201, ""), (202, "a solo b"), (203, items[5][1]), (203, items[5][1]), (None, items[6][1]), (205, "the " * 5000 + items[8][1])]
    return docs, items


def test_spans_match_brute_force(spark, monkeypatch):
    docs, items = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1)).repartition(3)
    b = spark.createDataFrame([*items, (None, "the of")], "item_id long, text string").withColumn("doc_id", F.lit(2))
    want = sorted(((i, *brute(t, items)) for i, t in docs), key=str)
    for parts in (1 << 20, 100):
        monkeypatch.setattr(fmindex, "PHRASES_PER_PART", parts)
        got = fmindex.contaminated_spans(d, b, ["doc_id"]).select("doc_id", "n_words", fmindex.n_hit().alias("h"), "item_ids").collect()
        assert sorted((tuple(r) for r in got), key=str) == want


def test_small_shards_and_empty_tables(spark, monkeypatch):
    docs, items = corpus()
    windows = fmindex.windows_of(spark.createDataFrame(items, "item_id long, text string")).toArrow()
    shard = fmindex.Shard(fmindex.phrases_of(windows))
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": [d for d, _ in docs], "text": pa.array([t for _, t in docs])})
    for i in range(0, len(docs), 7):
        shard.add(batch.slice(i, 7))
    got = [(int(n), sum(b - a for a, b in runs), own) for _, counts, spans, ids in shard.spans() for n, runs, own in zip(counts, spans, ids, strict=True)]
    assert got == [brute(t, items) for _, t in docs]
    empty = spark.createDataFrame([], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert fmindex.contaminated_spans(empty, none, ["doc_id"]).count() == 0
    full = spark.createDataFrame(docs, "doc_id long, text string")
    assert fmindex.contaminated_spans(full, none, ["doc_id"]).where(F.size("spans") > 0).count() == 0


def test_several_parts_keep_every_row_and_its_own_spans(spark, monkeypatch):
    docs, items = corpus()
    docs += [(7, items[2][1] + " x1 q"), (7, "no words of it"), (None, "nor here " * 9), (None, items[9][1]), (203, items[5][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("spans", F.lit("clash")).repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(fmindex, "PHRASES_PER_PART", 100)
    got = fmindex.contaminated_spans(d, b, ["doc_id"]).select("doc_id", "n_words", fmindex.n_hit().alias("h"), "item_ids").collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(((i, *brute(t, items)) for i, t in docs), key=str)


def test_shards_are_bounded_by_the_texts_that_they_hold(spark, monkeypatch):
    """Words that the benchmark does not have shrink to nothing in a shard, but their texts are held with it."""
    import pyarrow as pa

    made = []

    class Noted(fmindex.Shard):
        def __init__(self, phrases):
            super().__init__(phrases)
            made.append(self)

    docs = [(i, "other words than those " * 2000) for i in range(200)]
    phrases = fmindex.phrases_of(pa.table({"pattern": pa.array([b"8 bytes!"]), "item_id": pa.array([1], pa.int64())}))
    batch = pa.RecordBatch.from_pydict({"doc_id": [d for d, _ in docs], "text": pa.array([t for _, t in docs])})
    shard, shards = Noted(phrases), 1
    for i in range(len(docs)):
        part = batch.slice(i, 1)
        if shard.full(part):
            shard, shards = Noted(phrases), shards + 1
        shard.add(part)
    assert shards > 1 and sum(len(s.columns) for s in made) == len(docs)
    assert all(sum(p.nbytes for p in s.columns) <= fmindex.SHARD_BYTES or len(s.columns) == 1 for s in made)
    # One text a shard gives the same spans.
    items = corpus()[1]
    few = spark.createDataFrame(corpus()[0], "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(fmindex, "SHARD_BYTES", 1)
    monkeypatch.setattr(fmindex, "PASS", 1)
    got = fmindex.contaminated_spans(few, spark.createDataFrame(items, "item_id long, text string"), ["doc_id"]).select("doc_id", "n_words", fmindex.n_hit().alias("h"), "item_ids").collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(((i, *brute(t, items)) for i, t in corpus()[0]), key=str)
