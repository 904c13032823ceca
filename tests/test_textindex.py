"""Searches by index against searches that read everything."""

import random

from pyspark.sql import functions as F

from loomstone.operators import segments, textindex


def texts():
    rng = random.Random(4)
    word = ["alpha", "Beta", "gämma", "x=1", "ΔELTA", "straße", "a", "", "#!", "日本語"]
    rows = [(i, rng.choice(["\n", "\r\n", " "]).join(" ".join(rng.choice(word) for _ in range(rng.randrange(8))) for _ in range(rng.randrange(30)))) for i in range(60)]
    return [*rows, (60, None), (61, ""), (62, "alpha\nbeta"), (62, "alpha\nbeta"), (None, "Beta alpha"), (63, "tail alpha " * 5000 + "needle"), (64, "\n" * 700 + "Needle")]


def found(df):
    return sorted(map(str, df.collect()))


def test_lines_as_a_scan_finds_them(spark):
    docs = spark.createDataFrame(texts(), "doc_id long, text string").repartition(5)
    index = textindex.LineIndex.build(docs, lines=4, buckets=8)
    again = textindex.LineIndex(textindex.TextIndex(spark, index.index.path, 8))
    for term in ["ALPHA", "a b", "beta gämma", "GÄMMA", "δelta", "STRASSE", "straße", "語", "日本", "zzz", "#", "", "needle", "alpha\nbeta", "1 alpha x"]:
        want = found(segments.matching_lines(docs, term))
        assert found(index.matching_lines(term)) == want and found(again.matching_lines(term)) == want, term


def test_only_the_buckets_of_the_search_are_read(spark):
    docs = spark.createDataFrame(texts(), "doc_id long, text string").repartition(5)
    index = textindex.TextIndex.build(docs, F.col("text"), buckets=16)
    plan = index.candidates("NEEDLE")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:200] and "gram" in plan.split("PushedFilters")[1][:200]
    hits = index.search("NEEDLE")
    assert sorted(r.doc_id for r in hits.collect()) == [63, 64]
    assert "shelf" in hits._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:200]


def test_names(spark):
    rows = spark.createDataFrame([(1, "Load File", "function"), (2, None, "Import"), (3, "x", None), (4, "fun", "ction")], "n long, name string, kind string")
    index = textindex.TextIndex.build(rows, F.concat_ws("\n", "name", "kind"))
    for term in ["FUNCTION", "fun", "port", "load", "n\nc", "e"]:
        want = found(segments.search_names(rows, term))
        assert found(segments.search_names(index.search(term), term)) == want


def test_no_rows(spark):
    index = textindex.LineIndex.build(spark.createDataFrame([], "doc_id long, text string"))
    assert index.matching_lines("any").count() == 0 and index.matching_lines("").count() == 0
