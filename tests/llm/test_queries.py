"""Every column that the registered queries return, against brute force, over small tables with nulls, repeats and clashing columns."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstone.llm import langid, mixing, queries, secrets, toxicity
from tests.llm.test_fmindex import brute as brute_hits
from tests.llm.test_mixing import brute_targets
from tests.llm.test_secrets import brute_added, brute_base
from tests.llm.test_simhash import brute_classes, brute_fingerprint
from tests.llm.test_substring import brute as brute_repeats
from tests.llm.test_tokens import plain as plain_ids
from tests.llm.test_toxicity import plain_features
from tests.llm.test_vectors import brute as brute_links

CLASHES = ("fp", "n_words", "spans", "score", "size", "taken", "h", "row", "key", "rejected", "kept", "n", "text2", "s", "words")


def documents():
    rng = random.Random(12)
    word = {"en": ["the", "ing", "tion", "wh", "er"], "de": ["ung", "schaft", "keit", "ü", "ver"]}
    passage = " ".join(f"pass{i}" for i in range(30))
    rows = []
    for i in range(160):
        lang = rng.choice(["en", "en", "de"])
        w = ["".join(rng.choice(word[lang]) for _ in range(rng.choice([1, 2, 3]))) for _ in range(rng.choice([1, 12, 60]))]
        if i % 9 == 0:
            w.insert(len(w) // 2, passage)
        if i % 7 == 0:
            w += ["you", "vile", "scumbag" + rng.choice(["", "s"])]
        if i % 5 == 0:
            w.append("password=" + "".join(rng.choice("0123456789abcdef") for _ in range(16)))
        rows.append((i, " ".join(w), lang, rng.choice(["a", "a", "a", "é", None])))
    rows += [rows[9], rows[9], (300, rows[18][1], "en", "a"), (None, rows[18][1], "en", "b"), (None, None, None, None), (301, None, "de", "é"), (302, "", "en", "a"), (303, "12 !?", None, "a"), (304, ("the ing " * 3000) + passage, "en", "a")]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder of odd tables, and their rows."""
    where, docs = tmp_path_factory.mktemp("odd"), documents()
    bad = lambda df: df.withColumns({c: F.lit(c) for c in CLASHES if c not in df.columns})
    vectors = [(i, [float(np.float32(x)) for x in np.random.default_rng(i // 4).normal(size=4) + 0.01 * (i % 4)]) for i in range(60)] + [(60, None), (61, [0.0] * 4), (61, [1.0, None, 0.0, 0.0]), (None, [1.0, 2.0, 3.0, 4.0]), (3, [1.0, 2.0, 3.0, 4.0])]
    items = [(i, " ".join(f"pass{j}" for j in range(i, i + 14))) for i in range(3)] + [(7, "vile"), (8, None), (9, "?!"), (None, "the ing"), (7, "ung keit")]
    labels = [(i, i % 2, int(i % 7 == 0)) for i in range(0, 160) if i % 3] + [(None, 1, 1), (14, 0, 1), (5, 1, None)]
    schema = {"documents": "doc_id long, text string, lang string, source string", "embeddings": "vec_id long, embedding array<float>", "benchmark": "item_id long, text string", "labels": "doc_id long, quality int, toxic int"}
    rows = {"documents": docs, "embeddings": vectors, "benchmark": items, "labels": labels}
    for name, data in rows.items():
        df = spark.createDataFrame(data, schema[name])
        (bad(df) if name != "labels" else df).repartition(3).write.parquet(f"file://{where}/{name}.parquet")
    return str(where), rows


def run(spark, tables, name, columns):
    found = queries.QUERIES[name](spark, "file://" + tables[0])
    assert set(columns) <= set(found.columns)
    return sorted((tuple(r) for r in found.select(*columns).collect()), key=str)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op1(spark, tables):
    docs = tables[1]["documents"]
    got = run(spark, tables, "op1_token_ids", ["doc_id", "start", "n_tokens", "ids_crc32"])
    crc = lambda t: zlib.crc32(np.array(plain_ids(t), dtype="<u4").tobytes())
    assert sorted(((i, n, c) for i, _, n, c in got), key=str) == sorted(((i, len(plain_ids(t)), crc(t)) for i, t, _, _ in docs), key=str)
    at, before = 0, -math.inf
    for i, start, n, _ in sorted(got, key=lambda r: r[1]):
        assert start == at and (i is None) <= (before == -math.inf) and (i is None or i >= before)
        at, before = at + n, before if i is None else i


def test_op2(spark, tables):
    docs = [(i, t) for i, t, _, _ in tables[1]["documents"]]
    got = run(spark, tables, "op2_substring_dedup", ["doc_id", "n_words", "n_removed", "kept_sha256"])
    assert got == sorted((r[:4] for r in brute_repeats(docs)), key=str)
    assert sum(r[2] for r in got) > 0


def test_op3(spark, tables):
    prints = [(i, brute_fingerprint(t)) for i, t, _, _ in tables[1]["documents"]]
    want = sorted(((d, f"{f:016x}", c) for d, f, c in brute_classes(prints)), key=str)
    assert run(spark, tables, "op3_simhash_near_dedup", ["doc_id", "fingerprint", "component_id"]) == want


def test_op4(spark, tables):
    got = run(spark, tables, "op4_vector_near_dedup", ["vec_id", "n_links", "component_id", "kept"])
    assert got == brute_links(tables[1]["embeddings"]) and any(r[1] for r in got)


def test_op5(spark, tables):
    where, rows = tables
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0
    got = run(spark, tables, "op5_toxicity", ["doc_id", "held_out", "score", "predicted"])
    assert [r[0] for r in got] == [r[0] for r in sorted(((i,) for i, *_ in rows["documents"]), key=str)] or len(got) == len(rows["documents"])
    assert all(h == held(i) and 0 <= s <= 1 and p == int(s >= 0.5) for i, h, s, p in got)
    # The scores by the model, clause by clause.
    docs, labels = (spark.read.parquet(f"file://{where}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    assert model.learned

    def weight(token):
        parts = token.translate(toxicity._ASCII_LOWER).replace("’", "'").split("'")
        return max((model.lexicon.weight(p.encode(), toxicity._hash_words([p])[0]) for p in parts if p), default=0.0)

    want = []
    for i, t, _, _ in rows["documents"]:
        z = model.coefficients[0] + sum(c * math.log1p(x) for c, x in zip(model.coefficients[1:], plain_features(t, weight), strict=True))
        want.append((i, round(1 / (1 + math.exp(-max(-30, min(30, z)))), 9)))
    assert sorted(((i, round(s, 9)) for i, _, s, _ in got), key=str) == sorted(want, key=str)


def test_op6(spark, tables):
    docs, sizes, taken = tables[1]["documents"], defaultdict(int), defaultdict(int)
    size = lambda t: len((t or "").split())
    for _, t, _, s in docs:
        sizes[s] += size(t)
    want = brute_targets(dict(sizes))
    got = run(spark, tables, "op6_source_mixing", ["doc_id", "size", "source_size", "target", "taken"])
    assert sorted(((i, n, m) for i, n, m, _, _ in got), key=str) == sorted(((i, size(t), sizes[s]) for i, t, _, s in docs), key=str)
    by_size = {sizes[s]: s for s in sizes}
    assert len(by_size) == len(sizes)
    for _, n, m, target, k in got:
        assert abs(target - want[by_size[m]]) < 1e-6 * max(1, target) and 0 <= k <= 2 * n
        taken[by_size[m]] += k
    assert all(abs(taken[s] - t) <= 0.5 for s, t in want.items())


def test_op7(spark, tables):
    docs = tables[1]["documents"]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2
    got = run(spark, tables, "op7_language_id", ["doc_id", "held_out", "lang_pred", "score"])
    model = langid.fit(spark.read.parquet(f"file://{tables[0]}/documents.parquet"))
    assert set(model.languages) == {"en", "de"} and len(got) == len(docs)
    right = total = 0
    for i, h, lang, score in got:
        assert h == held(i) and lang in ("en", "de", "und") and 0 <= score <= 1 and (lang == "und") <= (score == 0)
        told = {x[2] for x in docs if x[0] == i}
        if h and i is not None and i < 300 and told:
            total, right = total + 1, right + (lang in told)
    assert right >= 0.9 * total > 0
    assert sorted(r[0] for r in got if r[2] == "und" and r[0] is not None) == [301, 302, 303]


def test_op8(spark, tables):
    docs = tables[1]["documents"]
    model = secrets.fit(spark.read.parquet(f"file://{tables[0]}/documents.parquet"))
    want = []
    for i, t, _, _ in docs:
        base = brute_base(t)
        told = lambda spans: ",".join(f"{(*secrets.KINDS, secrets.GRAMMAR)[k]}:{a}:{b}" for a, k, b in spans)
        every = sorted(base + [(a, 3, b) for a, b in brute_added(t, model)])
        want.append((i, *(sum(k == kind for _, k, _ in base) for kind in range(3)), sha(told(base)), told(every)))
    assert run(spark, tables, "op8_secret_scan", ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]) == sorted(want, key=str)


def test_op10(spark, tables):
    docs, items = tables[1]["documents"], [(i, t) for i, t in tables[1]["benchmark"] if i is not None]
    want = []
    for i, t, _, _ in docs:
        n, hit, found = brute_hits(t, items)
        want.append((i, n, hit, len(found), sha(",".join(sorted(map(str, found)))), hit > 0 and 20 * hit >= n))
    got = run(spark, tables, "op10_fmindex_decontamination", ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])
    assert got == sorted(want, key=str) and any(r[5] for r in got)


@pytest.mark.parametrize("name", ["op2_substring_dedup", "op4_vector_near_dedup", "op10_fmindex_decontamination", "op11_filter_audit", "op12_line_quality", "op13_collocations"])
def test_sql_of_the_queries(spark, tables, name):
    where, _ = tables
    db = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark", "labels"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{where}/{table}.parquet/*.parquet')")
    if name == "op4_vector_near_dedup":  # equal ids have no single answer to join back by
        db.execute("CREATE TABLE unique_rows AS SELECT DISTINCT ON (vec_id) * FROM embeddings WHERE vec_id IS NOT NULL ORDER BY vec_id, CAST(embedding AS VARCHAR)")
        db.execute("CREATE OR REPLACE VIEW embeddings AS SELECT * FROM unique_rows")
        folder = f"{where}/unique"
        spark.createDataFrame(db.execute("SELECT vec_id, embedding FROM embeddings").fetchall(), "vec_id long, embedding array<float>").write.mode("overwrite").parquet(f"file://{folder}/embeddings.parquet")
        where = folder
    want = db.execute(queries.ORACLES[name])
    names = sorted(c[0] for c in want.description)
    want = db.execute(f"SELECT {', '.join(names)} FROM ({queries.ORACLES[name]})").fetchall()
    found = queries.QUERIES[name](spark, "file://" + where)
    assert sorted(found.columns) == names
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in found.select(*names).collect())


def test_empty_tables(spark, tables, tmp_path):
    schema = {"documents": "doc_id long, text string, lang string, source string, n_chars long", "embeddings": "vec_id long, embedding array<float>", "benchmark": "item_id long, text string", "labels": "doc_id long, quality int, toxic int", "conversations": "conv_id long, turn long, role string, text string"}
    for name, columns in schema.items():
        spark.createDataFrame([], columns).write.parquet(f"file://{tmp_path}/{name}.parquet")
    for name, query in queries.QUERIES.items():
        assert query(spark, f"file://{tmp_path}").count() == (1 if name == "op9_chat_format" else 0)
    assert mixing.mix(spark.createDataFrame([], schema["documents"])).count() == 0
