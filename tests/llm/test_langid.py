import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomstone.llm import langid

SYLLABLES = {"aa": ["tion", "the", "ing", "er", "and", "wh"], "bb": ["schaft", "ung", "ü", "ei", "ver", "keit"], "cc": ["ción", "que", "ñ", "ado", "mente", "os"]}


def make(n, seed=1):
    rng = random.Random(seed)
    word = lambda s: "".join(rng.choice(s) for _ in range(rng.choice([1, 2, 3])))
    return [(i, " ".join(word(SYLLABLES[lang]) for _ in range(rng.choice([8, 40, 300]))), lang) for i in range(n) for lang in [rng.choice(list(SYLLABLES))]]


@pytest.mark.parametrize("part_languages", [512, 1])
def test_held_out_accuracy_and_defined_cases(spark, monkeypatch, part_languages):
    rows = make(600)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = langid.fit(docs, per_language=60)
    monkeypatch.setattr(langid, "PART_LANGUAGES", part_languages)
    got = {r.doc_id: r for r in langid.detect(docs, model, ["doc_id"]).withColumn("held", langid.held_out(F.col("doc_id"), 4, 2)).collect()}
    held = [r for r in rows if got[r[0]].held]
    assert len(held) > 80 and sum(got[i].lang_pred == lang for i, _, lang in held) >= 0.97 * len(held)
    assert not any(r.rejected for r in got.values())
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 345 !?"), (4, rows[0][1] * 200), (4, rows[0][1] * 200), (None, rows[1][1]), (5, "日本語テキスト" * 9)], "doc_id long, text string")
    out = {(r.doc_id, r.lang_pred, r.rejected) for r in langid.detect(odd, model, ["doc_id"]).collect()}
    assert out == {(1, "und", True), (2, "und", True), (3, "und", True), (4, rows[0][2], False), (None, rows[1][2], False), (5, next(x[1] for x in out if x[0] == 5), True)}


def test_no_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert [tuple(r) for r in langid.detect(docs, model, ["doc_id"]).collect()] == [(1, "und", 0.0, True)]
    assert langid.detect(docs.limit(0), model, ["doc_id"]).collect() == []


def test_fit_is_the_same_for_any_partitioning(spark):
    docs = spark.createDataFrame(make(200), "doc_id long, text string, lang string")
    a, b = langid.fit(docs.repartition(7), per_language=30), langid.fit(docs.coalesce(1), per_language=30)
    assert a.languages == b.languages and (a.centroids == b.centroids).all()


def plain_grams(text):
    """The n-gram buckets of a text, gram by gram."""
    data = (text or "").lower().encode()
    folded = [32 if b < 128 and not chr(b).isalpha() else b for b in data]
    out, mask = Counter(), (1 << 32) - 1
    for i in range(len(folded) - 2):
        h = folded[i] * 0x9E3779B1 & mask
        for j, prime in ((1, 0x85EBCA77), (2, 0xC2B2AE3D)):
            h ^= (folded[i + j] + j) * prime & mask
            h ^= h >> 15
        out[(h * 0x27D4EB2F & mask) >> 20] += 1
    return out


def test_vectors_and_nearest_centroid_match_a_plain_version(spark):
    rows = make(150)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, per_language=30)
    # The sample, its document frequencies, and the radius, by the definition.
    counts = langid.gram_counts(pa.array([t for _, t, _ in rows]))
    assert all({int(b): int(c[b]) for b in np.flatnonzero(c)} == dict(plain_grams(t)) for c, (_, t, _) in zip(counts, rows, strict=True))
    own = defaultdict(list)
    hashed = docs.where(~langid.held_out(F.col("doc_id"), 4, 2)).select("text", "lang", F.xxhash64("doc_id", "text").alias("h")).collect()
    for r in sorted(hashed, key=lambda r: (r.h % (1 << 20), r.h)):
        own[r.lang].append(r.text)
    sample = [t for texts in own.values() for t in texts[:30]]
    seen = Counter(b for t in sample for b in plain_grams(t))
    for b in range(langid.BUCKETS):
        assert abs(model.idf[b] - (math.log((1 + len(sample)) / (1 + seen[b])) + 1)) < 1e-5
    assert Counter(model.languages) == dict.fromkeys(own, langid.CENTROIDS)
    got = {r.doc_id: r for r in langid.detect(docs, model, ["doc_id"]).collect()}
    for i, t, _ in rows:
        v = {b: math.sqrt(n) * float(model.idf[b]) for b, n in plain_grams(t).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        cosine = [sum(x * float(c[b]) for b, x in v.items()) / norm for c in model.centroids]
        assert abs(max(cosine) - got[i].score) < 1e-4
        assert got[i].lang_pred == model.languages[int(np.argmax(cosine))] or sorted(cosine)[-1] - sorted(cosine)[-2] < 1e-4


def test_foreign_and_random_text_is_rejected(spark):
    docs = spark.createDataFrame(make(400), "doc_id long, text string, lang string")
    model = langid.fit(docs, per_language=60)
    rng = random.Random(3)
    noise = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(3, 9))) for _ in range(n))
    odd = [(i, noise(letters, n)) for i, (letters, n) in enumerate([("xqzjkvp", 12), ("xqzjkvp", 400), ("жщыэюя", 12), ("жщыэюя", 200), ("0123456789x", 80)])]
    odd = spark.createDataFrame(odd, "doc_id long, text string")
    assert all(r.rejected for r in langid.detect(odd, model, ["doc_id"]).collect())


def test_repeated_rows_count_once_in_the_sample(spark):
    rows = make(100)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    copies = spark.createDataFrame([rows[1]] * 500, docs.schema)
    a, b = langid.fit(docs, per_language=40), langid.fit(docs.union(copies), per_language=40)
    assert a.languages == b.languages and (a.centroids == b.centroids).all()
