import random

import pytest
from pyspark.sql import functions as F

from loomstone.llm import components as components_module
from loomstone.llm import scratch
from loomstone.llm.components import components
from loomstone.operators.relational import running


def brute(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("hot", [500, 3])
def test_components_of_stars_chains_and_noise(spark, monkeypatch, hot):
    monkeypatch.setattr(components_module, "HOT_KEYS", hot)
    rng = random.Random(3)
    edges = [(1000, i) for i in range(200)] + [(2000 + i, 2001 + i) for i in range(60)] + [(rng.randrange(3000, 3300), rng.randrange(3000, 3300)) for _ in range(150)]
    edges += [(7, 7), (-5, 2030), (199, 1000), (-(1 << 63), 3000)]
    rng.shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long").repartition(5)).collect()}
    assert got == brute(edges)
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_plans_of_components_rounds_stay_small(spark, monkeypatch):
    """The driver's memory grows with the tables that one plan reads, each as often as it is read."""
    leaves, cut = [], components_module.cut
    monkeypatch.setattr(components_module, "HOT_KEYS", 3)
    monkeypatch.setattr(components_module, "cut", lambda df, label: leaves.append(df._jdf.queryExecution().analyzed().collectLeaves().size()) or cut(df, label))
    edges = [(0, i) for i in range(1, 40)] + [(50 + i, 51 + i) for i in range(12)] + [(39, 50)]
    assert {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()} == brute(edges)
    assert len(leaves) > 2 and max(leaves) <= 8


@pytest.mark.parametrize("hot", [500, 4])
def test_frequent_keys_are_joined_like_any_other(spark, monkeypatch, hot):
    monkeypatch.setattr(scratch, "HOT_KEYS", hot)
    rows = spark.createDataFrame([(i, 1 if i % 2 else i % 7) for i in range(200)], "i long, k long")
    keyed = scratch.cut(rows.groupBy("k").agg(F.count("*").alias("n"), F.max("i").alias("top")).where("k <> 3"), "keys")
    got = sorted(map(tuple, scratch.join_hot(rows, keyed, "k", "n").select("k", "i", "top").collect()))
    assert got == sorted(map(tuple, rows.join(keyed, "k").select("k", "i", "top").collect()))


def test_scratch_folders_are_told_and_deleted(spark):
    table = scratch.cut(spark.range(5), "x")
    assert table.count() == 5 and scratch.scratch_dir(spark, "y").startswith(spark.conf.get("spark.checkpoint.dir"))
    scratch.discard(table)
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table._scratch_path)
    assert not files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(files)


def test_running_totals_over_ranges(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, 1, 2, 3, 500]), rng.randrange(100)) for i in range(300)]
    df = spark.createDataFrame(rows, "i long, k long, n long").withColumn("part", F.lit("clash"))
    got = running(df.repartition(6), [F.col("k").asc_nulls_last(), F.col("i")], {"before": "n"}).collect()
    ordered = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0]))
    want, total = {}, 0
    for place, (i, _, n) in enumerate(ordered, 1):
        want[i] = (place, total)
        total += n
    assert {r.i: (r.place, r.before) for r in got} == want and all(r.part == "clash" for r in got)
    assert running(df.limit(0), ["i"], {"before": "n"}).collect() == []
