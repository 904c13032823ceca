"""Stored tables: only met buckets are rewritten, a second writer notices the first."""

import pytest
from pyspark.sql import functions as F

from loomstone.operators import catalog
from loomstone.sources.scratch import scratch_dir
from loomstone.sources.stored import ChangedMeanwhile, StoredTable


def merge(old, new):
    return catalog.upsert(old, new, "k")


def rows(spark, data):
    return spark.createDataFrame(data, "k long, v string")


def content(stored):
    return sorted((r.k, r.v) for r in stored.read().collect())


def test_only_met_buckets_are_rewritten(spark):
    stored = StoredTable.create(rows(spark, [(i, "a") for i in range(100)]), scratch_dir(spark, "t"), ["k"], 16)
    before = set(stored.read().inputFiles())
    met = stored.update(rows(spark, [(3, "b"), (200, "c")]), merge)
    after = set(StoredTable(spark, stored.path, ["k"], 16).read().inputFiles())
    changed = {f.split("_bucket=")[1].split("/")[0] for f in before ^ after}
    assert changed == set(map(str, met)) and 1 <= len(met) <= 2 and stored.version() == 1
    assert content(stored) == sorted([(i, "b" if i == 3 else "a") for i in range(100)] + [(200, "c")])


def test_second_writer_reads_again_or_is_told(spark):
    stored = StoredTable.create(rows(spark, [(1, "a"), (2, "a")]), scratch_dir(spark, "t"), ["k"], 4)
    other, raced = StoredTable(spark, stored.path, ["k"], 4), []

    def slow(old, new):
        if not raced:
            raced.append(other.update(rows(spark, [(1, "first")]), merge))
        return merge(old, new)

    stored.update(rows(spark, [(1, "second"), (2, "second")]), lambda old, new: slow(old, new))
    assert content(stored) == [(1, "second"), (2, "second")] and stored.version() == 2
    raced.clear()
    with pytest.raises(ChangedMeanwhile):
        stored.update(rows(spark, [(2, "late")]), slow, retries=0)
    assert content(stored) == [(1, "first"), (2, "second")]


def test_empty_tables_and_emptied_buckets(spark):
    stored = StoredTable.create(rows(spark, []), scratch_dir(spark, "t"), ["k"], 4)
    assert content(stored) == []
    stored.update(rows(spark, [(1, "a"), (None, "n")]), lambda old, new: old.union(new))
    assert sorted(map(str, stored.read().collect())) == ["Row(k=1, v='a')", "Row(k=None, v='n')"]
    stored.update(rows(spark, [(1, "x")]), lambda old, new: old.where(~F.col("k").eqNullSafe(1)))
    assert [r.v for r in stored.read().collect()] == ["n"]
    stored.append(rows(spark, [(1, "y"), (1, "z")]), lambda old, new: new)
    assert sorted(r.v for r in stored.read().collect()) == ["n", "y", "z"]
