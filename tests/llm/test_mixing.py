import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loomstone.llm import mixing


def brute_targets(sizes):
    """sizes: source -> words. The rule as it is told, round after round."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in fixed]
        if not rest:
            return fixed
        level = (total - sum(fixed.values())) / sum(weight[s] for s in rest)
        over = [s for s in rest if level * weight[s] > 2 * sizes[s]]
        if not over:
            return fixed | {s: level * weight[s] for s in rest}
        fixed |= {s: 2.0 * sizes[s] for s in over}


def corpus(n=700):
    rng = random.Random(6)
    rows = []
    for i in range(n):
        source = rng.choice(["src0"] * 8 + ["src1", "src2", "é", "Z", None, "src10"])
        rows.append((i, "\n".join("w" for _ in range(rng.choice([0, 1, 7, 90, 400]))), source))
    rows += [(5, "a b c", "src0"), (5, "a b c", "src0"), (None, "x y", "src1"), (None, "x y", "src1"), (901, None, "src1"), (902, " ", "only empty"), (903, "w " * 20000, "src2")]
    return rows


@pytest.mark.parametrize("block", [256, 10])
def test_targets_and_taken_words(spark, block):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("target", F.lit("clash")).withColumn("s", F.lit(3)).repartition(4)
    got = mixing.mix(docs, ["doc_id", "source"], block=block).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size(t)
    want = brute_targets(dict(sizes))
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((i, s, size(t)) for i, t, s in rows)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, r.target)
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.5
    again = mixing.mix(docs.repartition(2), ["doc_id", "source"], block=block).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_schedule_interleaves_evenly(spark):
    known = spark.createDataFrame([(0, 50_000.0, 50_000), (1, 30_000.0, 30_000), (2, 20_000.0, 20_000)], "s long, target double, words long")
    rows = mixing.schedule(known, 10).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.s].append(r["rank"])
    for s, n in ((0, 5000), (1, 3000), (2, 2000)):
        assert sorted(by[s]) == list(range(len(by[s]))) and 0 <= len(by[s]) - n <= 5


def test_empty_and_wordless_tables(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert mixing.mix(docs.limit(0)).collect() == []
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in mixing.mix(docs).collect()) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
