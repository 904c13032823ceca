"""Search by meaning in blocks against plain scores of all pairs."""

import numpy as np
import pytest

from loomstone.operators import meaning, retrieval


def brute(vectors, queries, z, spread, most, best):
    """(matches, candidates, statistics) by plain loops."""
    unit = lambda v: np.array(v, dtype=float) / (np.linalg.norm(v) or 1)
    matches, candidates, statistics = [], [], []
    for q, wanted in queries:
        pages = {}
        for page, element, v in vectors:
            if page is None or element is None or v is None or None in v or len(v) != 6:
                continue
            scores = pages.setdefault(page, {})
            s = float(unit(wanted) @ unit(v))
            scores[element] = max(s, scores.get(element, -2))
        for page, scores in pages.items():
            values = np.array(list(scores.values()))
            mean, sd = values.mean(), values.std()
            sd = 1.0 if sd < 1e-7 else sd
            statistics.append((q, page, round(mean, 6), round(sd, 6)))
            order = sorted(scores, key=lambda e: (-round(scores[e], 10), e))
            candidates += [(q, page, e, round(scores[e], 6), i + 1) for i, e in enumerate(order[:best])]
            kept = [e for e in order if (scores[e] - mean) / sd >= z and scores[e] >= values.max() - spread][:most]
            matches += [(q, page, e, round(scores[e], 6), i + 1) for i, e in enumerate(kept)]
    return sorted(matches), sorted(candidates), sorted(statistics)


@pytest.mark.parametrize("stated", [10_000, 8])
def test_blocks_against_all_pairs(spark, monkeypatch, stated):
    monkeypatch.setattr(meaning, "STATED_ROWS", stated)
    rng = np.random.default_rng(1)
    vectors = [(1, f"e{i:03}", rng.normal(size=6) + (3 if i < 3 else 0)) for i in range(90)]  # several blocks, one vector each
    vectors += [(2, f"e{i // 3:03}", rng.normal(size=6)) for i in range(120)]  # several blocks, three vectors each
    vectors += [(3, f"e{i:03}", rng.normal(size=6)) for i in range(5)] + [(4, "one", rng.normal(size=6)), (4, "one", rng.normal(size=6))]
    vectors += [(5, f"e{i:03}", np.ones(6)) for i in range(40)] + [(6, "zero", np.zeros(6)), (6, "two", np.ones(6))]
    rows = [(p, e, v.tolist()) for p, e, v in vectors] + [(None, "x", [1.0] * 6), (1, None, [1.0] * 6), (1, "n", None), (1, "m", [1.0, None] * 3), (1, "short", [1.0])]
    queries = [(i, rng.normal(size=6).tolist()) for i in range(20)] + [(30, [0.0] * 6)]
    table = spark.createDataFrame(rows, "page_id long, element_id string, vector array<double>").repartition(3)
    asked = spark.createDataFrame(queries, "query_id long, vector array<double>")
    want = brute(rows, queries, 1.2, 0.8, 4, 7)
    rounded = lambda df, *c: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select(*c).collect())
    # A zero query scores all elements 0: none stands out, and the order of the candidates is that of the elements.
    assert rounded(meaning.meaning_matches(table, asked, 1.2, 0.8, 4, block=8), "query_id", "page_id", "element_id", "score", "rank") == want[0]
    got = rounded(meaning.rerank_candidates(table, asked, 7, block=8), "query_id", "page_id", "element_id", "score", "rank")
    equal = {5}  # equal vectors: which of equal scores come first is a matter of rounding
    assert [r for r in got if r[1] not in equal] == [r for r in want[1] if r[1] not in equal] and len(got) == len(want[1])
    assert rounded(meaning.similarity(table, asked, block=8), "query_id", "page_id", "mean", "sd") == want[2]


def test_no_cartesian_product(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "STATED_ROWS", 2)
    rows, queries = spark.range(7), spark.createDataFrame([(i, [float(i)]) for i in range(5)], "query_id long, vector array<double>")
    found = retrieval.against(rows, queries)
    assert found.count() == 35 and found.distinct().count() == 35
    assert "CartesianProduct" not in found._jdf.queryExecution().executedPlan().toString()


def test_nothing_to_search(spark):
    none = spark.createDataFrame([], "page_id long, element_id string, vector array<float>")
    asked = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, vector array<float>")
    assert meaning.meaning_matches(none, asked).count() == 0 and meaning.similarity(none, asked).count() == 0
    some = spark.createDataFrame([(1, "a", [1.0, 2.0])], none.schema)
    assert meaning.rerank_candidates(some, asked.limit(0)).count() == 0 and meaning.rerank_candidates(some, asked).count() == 1


@pytest.mark.parametrize("block", [8, 1024])
def test_elements_of_the_queries_own_ids_take_no_part_in_blocks(spark, block):
    rng = np.random.default_rng(3)
    vectors = [(1, i, rng.normal(size=6).tolist()) for i in range(60)] + [(2, i // 3, rng.normal(size=6).tolist()) for i in range(90)]
    vectors += [(3, i, rng.normal(size=6).tolist()) for i in range(6)] + [(4, 5, [1.0] * 6)]
    queries = [(i, rng.normal(size=6).tolist()) for i in (0, 5, 17, 29, 59, 200)]
    table = spark.createDataFrame(vectors, "page_id long, element_id long, vector array<double>").repartition(3)
    asked = spark.createDataFrame(queries, "query_id long, vector array<double>")
    want = sorted(m for q in queries for m in brute([v for v in vectors if v[1] != q[0]], [q], 1.2, 0.8, 4, 7)[0])
    got = meaning.meaning_matches(table, asked, 1.2, 0.8, 4, block=block, skip_equal=True)
    assert sorted((r.query_id, r.page_id, r.element_id, round(r.score, 6), r["rank"]) for r in got.collect()) == want


def test_blocks_give_no_more_candidates_than_are_asked_for(spark, monkeypatch):
    made, paired = [], meaning._paired
    monkeypatch.setattr(meaning, "_paired", lambda *a, **k: made.append(paired(*a, **k)) or made[-1])
    vectors = [(1, i, [1.0, 0.0]) for i in range(200)] + [(2, i, [float(i), 1.0]) for i in range(200)]
    table = spark.createDataFrame(vectors, "page_id long, element_id long, vector array<double>")
    asked = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(40)], "query_id long, vector array<double>")
    found = meaning.rerank_candidates(table, asked, 7, block=4)
    assert found.where("page_id = 1").selectExpr("max(element_id)", "count(*)").first()[:] == (6, 40 * 7)
    # Two pages of one block each.
    assert made[0].count() == found.count() == 40 * 2 * 7
