import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomstone.llm import langid, toxicity

BAD = ["blurgh", "snarkle", "vorb"]


def make(n, seed=3):
    rng = random.Random(seed)
    good = [f"{a}{b}" for a in ["al", "be", "co", "du"] for b in ["ra", "min", "tel", "so", "vin"]]
    rows, labels = [], []
    for i in range(n):
        words, toxic = [rng.choice(good) for _ in range(rng.choice([20, 80]))], rng.random() < 0.3
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(BAD) if rng.random() < 0.6 else "grumpf" + rng.choice(good))
        rows.append((i, " ".join(words) + rng.choice([".", "!\n", ""])))
        labels.append((i, int(toxic)))
    return rows, labels


def forms(text, quote=""):
    return toxicity.clause_weights(text, lambda w: {"idiot": 2.0, "l'idiot": 2.0}.get(w, 0.0), quote)


def test_grammar_forms():
    assert forms("what an idiot this is") == {"plain": 2.0}
    assert forms("he is not an idiot") == {"negated": 2.0}
    assert forms("not one word of it was from that idiot") == {"plain": 2.0}
    assert forms("she said that idiot") == {"reported": 2.0}
    assert forms('the word "idiot" and idiot') == {"reported": 2.0, "plain": 2.0}
    assert forms("you idiot") == {"targeted": 2.0}
    assert forms("I will kill it") == {"threat": 1.0}
    assert forms("") == {}
    assert forms("she said: that idiot") == {"reported": 2.0}
    assert forms("he isn't an idiot") == forms("he isn’t an idiot") == forms("il n'est idiot") == {"negated": 2.0}
    assert forms("according to them an idiot") == forms("laut ihm idiot") == {"reported": 2.0}
    assert forms("according idiot to") == {"plain": 2.0} and forms("by no means an idiot") == forms("by by no means idiot") == {"negated": 2.0}
    assert forms("l'idiot") == {"plain": 2.0}
    assert forms("„an idiot“ idiot") == forms("“idiot” idiot") == forms("«idiot» idiot") == {"reported": 2.0, "plain": 2.0}
    assert forms("„an “ idiot ” idiot") == {"plain": 2.0, "reported": 2.0}  # the second mark closes, the third opens
    assert forms("more idiot” idiot", "„") == {"reported": 2.0, "plain": 2.0}


def plain_features(text, weight):
    """Clause by clause, mark by mark."""
    out, clause, quote, start = dict.fromkeys(toxicity.FORMS, 0.0), "", "", ""
    for c in [*(text or ""), None]:
        if c is None or c in ".!?;\n":
            for form, value in toxicity.clause_weights(clause, weight, start).items():
                out[form] += value
            clause = ""
            quote = "" if c == "\n" else quote
            start = quote
            continue
        clause += c
        if c in toxicity.QUOTES:
            quote = ("" if c in toxicity.QUOTES[quote] else quote) if quote else c
    return [out[f] for f in toxicity.FORMS]


def test_features_match_a_plain_version():
    rng = random.Random(9)
    lexicon = toxicity.Lexicon({}, {4: {int.from_bytes(b"vorb", "little"): 1.5}})
    lexicon.words.update(dict(zip(toxicity._hash_words(["snark", "éidi", "Éidi"]), [2.0, 2.0, 2.0], strict=True)))

    def weight(token):
        parts = token.translate(toxicity._ASCII_LOWER).replace("’", "'").split("'")
        return max((1.5 if p.startswith("vorb") else 2.0 if p in ("snark", "éidi", "Éidi") else 0.0 for p in parts), default=0.0)

    bits = ["snark", "Vorbel", "vor", "ÉIDI", "éidi", "you", "not", "isn't", "said", "kill", "TÖTEN", "according", "to", "by", "no", "means", "word", '"', "„", "“", "”", "«", "»", ".", "!", ":", ";", "\n", "l'vorb", "日本"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 6, 60]))) for _ in range(400)] + [None, "", "snark" * 3, '"' * 9 + "snark", "snark. " * 4000]
    got = toxicity.text_features(pa.array(texts, type=pa.string()), lexicon)
    for text, row in zip(texts, got.tolist(), strict=True):
        assert row == pytest.approx(plain_features(text, weight)), text


def test_repeated_rows_count_once_in_the_sample(spark):
    rows, labels = make(60)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    own = next(i for i, y in labels if i % 5 and y)
    copies = spark.createDataFrame([rows[own]] * 300 + [(own, f"other text {i}") for i in range(50)], docs.schema)
    few = toxicity._sample(docs.union(copies), marks, 20).groupBy("y").count().collect()
    assert all(r["count"] <= 20 for r in few) and len(few) == 2


def test_held_out_documents_are_told_apart(spark):
    rows, labels = make(900)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("y", F.lit("clash"))
    marks = spark.createDataFrame([*labels, (None, 1), (5, None), (labels[6][0], labels[6][1])], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    got = {r.doc_id: r for r in toxicity.score(docs, model, ["doc_id"]).withColumn("held", langid.held_out(F.col("doc_id"), 5, 0)).collect()}
    held = [(i, y) for i, y in labels if got[i].held]
    assert len(held) > 100 and sum((got[i].score >= 0.5) == bool(y) for i, y in held) >= 0.98 * len(held)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "?!"), (4, "vorb " * 20000), (5, "x vorb. " * 3)], "doc_id long, text string")
    out = {r.doc_id: r.score for r in toxicity.score(odd, model, ["doc_id"]).collect()}
    assert out[1] == out[2] == out[3] < 0.5 < out[5] and out[4] > 0.5


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a text")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.score for r in toxicity.score(docs, model, ["doc_id"]).collect()] == [0.0]
    assert toxicity.score(docs.limit(0), model, ["doc_id"]).collect() == []
