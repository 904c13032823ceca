import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from loomstone.llm import fmindex, tokens
from tests.llm.test_fmindex import brute as brute_hits
from tests.llm.test_mixing import brute_targets

DIR = "/root/testdata/sf0.001"


def staged(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIR).cache()
        out.append(docs)
    return out


def test_stages_against_brute_force(spark):
    start, spoken, unique, clean, mixed, coded = staged(spark)
    for df in (spoken, unique, clean, mixed):
        assert df.dtypes == start.dtypes
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert len(ids(spoken)) >= 0.99 * len(ids(start))
    # Near-duplicates: nothing that is kept is a copy; nothing goes without a similar document that stays.
    texts = {r.doc_id: r.text for r in spoken.collect()}

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets, kept = {i: shingles(t) for i, t in texts.items()}, ids(unique)
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert not any(like(a, b) >= 0.8 for a in kept for b in kept if a < b)
    reached = set(kept)
    while more := {a for a in sets.keys() - reached if any(like(a, b) >= 0.8 for b in reached)}:
        reached |= more
    assert reached == sets.keys()  # what goes is linked, link by link, to what stays
    # Decontamination: the rule of the contract.
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    want = set()
    for i in kept:
        n, hit, _ = brute_hits(texts[i], items)
        if not (hit > 0 and 20 * hit >= n):
            want.add(i)
    assert ids(clean) == want and len(want) > 50
    # Mixing: words of each source near its target, no document over twice its size.
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    own, sizes, taken, by_doc = {r.doc_id: r for r in clean.collect()}, Counter(), Counter(), Counter()
    for r in own.values():
        sizes[r.source] += size(r.text)
    for r in mixed.collect():
        taken[r.source] += size(r.text)
        by_doc[r.doc_id] += size(r.text)
        assert own[r.doc_id].text.split()[: size(r.text)] == r.text.split()
    assert all(abs(taken[s] - t) <= 0.5 for s, t in brute_targets(dict(sizes)).items())
    assert all(n <= 2 * size(own[i].text) for i, n in by_doc.items())
    # Token ids: as many as the tokenizer gives, one after another.
    import public_tokenizers

    tokenizer = tokens.load_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    want = defaultdict(list)
    for r in mixed.collect():
        want[r.doc_id].append(len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1)
    got, at = defaultdict(list), 0
    for r in sorted(coded.collect(), key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
        got[r.doc_id].append(r.n_tokens)
    assert {i: sorted(n) for i, n in got.items()} == {i: sorted(n) for i, n in want.items()}
    assert fmindex.WINDOW == 13


def test_null_rows_and_empty_tables_pass_every_stage(spark):
    real = spark.read.parquet(f"{DIR}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", None, 0), (None, "of the and", None, "s", 9), (2, "of the and", "en", "s", 9), (2, "of the", "en", "s", 9)], real.schema)
    for docs in (odd, real.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, DIR).count() <= max(5, docs.count() * 2)


def test_near_dedup_keeps_one_row_of_each_class_where_texts_share_a_doc_id(spark):
    one, two = (" ".join(f"{w}{i}" for i in range(40)) for w in "ab")
    schema = spark.read.parquet(f"{DIR}/documents.parquet").schema
    rows = [{"doc_id": i, "text": t, "lang": "en", "source": "s", "n_chars": len(t)} for i, t in ((2, one), (2, two), (7, two), (2, one), (9, one + " more"))]
    docs = spark.createDataFrame([tuple(r[f.name] for f in schema) for r in rows], schema)
    kept = corpus_pipeline.near_dedup(spark, docs, DIR).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(2, one), (2, two)]


def test_near_dedup_removes_copies_without_a_doc_id(spark):
    one, two = (" ".join(f"{w}{i}" for i in range(40)) for w in "ab")
    schema = spark.read.parquet(f"{DIR}/documents.parquet").schema
    rows = [{"doc_id": i, "text": t, "lang": "en", "source": "s", "n_chars": len(t or "")} for i, t in ((None, one), (5, one + " more"), (None, one), (None, two), (None, two), (None, None), (8, ""))]
    docs = spark.createDataFrame([tuple(r[f.name] for f in schema) for r in rows], schema)
    kept = corpus_pipeline.near_dedup(spark, docs, DIR).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == [(5, one + " more"), (8, ""), (None, two)]


def test_columns_of_any_name_pass_every_stage(spark):
    names = ["rejected", "n_words", "size", "time", "score", "spans", "taken", "item_ids", "lang_pred", "class_id", "component_id", "file_key", "row", "h", "place", "column0", "key", "carried"]
    real = spark.read.parquet(f"{DIR}/documents.parquet").limit(60)
    docs = real.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DIR)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            rows = out.collect()
            assert rows and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names)
        else:
            assert out.count() == docs.count()
