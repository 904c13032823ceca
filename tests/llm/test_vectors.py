import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstone.llm import vectors


def brute(rows, c=0.9):
    ok = [v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    n, parent, links = len(rows), list(range(len(rows))), [0] * len(rows)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], dtype=float), np.array(rows[j][1], dtype=float)
                if a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= c:
                    links[i] += 1
                    links[j] += 1
                    parent[find(i)] = find(j)
    least = {}
    for i, (v, _) in enumerate(rows):
        if v is not None:
            least[find(i)] = min(v, least.get(find(i), v))
    return sorted(((v, links[i], least.get(find(i)), v is not None and v == least.get(find(i))) for i, (v, _) in enumerate(rows)), key=str)


def corpus():
    rng = np.random.default_rng(2)
    rows = []
    for g in range(30):
        center = rng.normal(size=6)
        for _ in range(rng.integers(1, 25)):
            rows.append((len(rows), (center + rng.normal(size=6) * rng.choice([0.05, 0.35])).tolist()))
    rows += [(1000 + i, rows[4][1]) for i in range(20)] + [(2000, [x * 1e20 for x in rows[4][1]]), (None, rows[9][1]), (2, rows[2][1])]
    rows += [(3000, None), (3001, [0.0] * 6), (3002, [1.0, None, 0, 0, 0, 0]), (3003, [float("nan")] * 6), (3004, [float("inf"), 0, 0, 0, 0, 0]), (3005, []), (3006, [1.0, 0.0]), (3007, [2.0, 0.1])]
    random.Random(1).shuffle(rows)
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


@pytest.mark.parametrize("block,kind", [(8192, "float"), (16, "double")])
def test_links_and_classes_match_brute_force(spark, block, kind):
    rows = corpus()
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumn("key", F.lit("clash"))
    got = sorted(map(tuple, vectors.near_vectors(df, block=block).collect()), key=str)
    assert got == brute(rows)


def test_every_close_pair_meets_once():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 5))
    u = vectors.unit(np.concatenate([base + rng.normal(size=base.shape) * s for s in (0, 0.1, 0.3)]))
    own, others = vectors.visits(u, u[::15], math.sqrt(0.2))
    for i in range(len(u)):
        for j in range(i):
            if u[i] @ u[j] >= 0.9:
                assert (own[i] == own[j]) + others[i, own[j]] + others[j, own[i]] == 1


def test_pairs_at_the_threshold_are_decided_in_double(spark):
    # cos of the second with the first lies just above, of the third just below 0.9.
    rows = [(i, [math.cos(a), math.sin(a)]) for i, a in enumerate([0.0, math.acos(0.9) - 1e-9, -math.acos(0.9) - 1e-9])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {r.vec_id: r.n_links for r in vectors.near_vectors(df).collect()} == {0: 1, 1: 1, 2: 0}
    assert vectors.near_vectors(df.limit(0)).collect() == []
