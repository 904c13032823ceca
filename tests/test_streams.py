"""Stateful streams over several micro-batches, with rows out of order within the watermark, against folds over all rows."""

import random

import pytest
from pyspark.sql import functions as F

from loomstone.operators import accounting
from loomstone.streaming import stateful, streams

IDLE, LATE = 900, 3600


@pytest.fixture(scope="module")
def calls(spark, tmp_path_factory):
    """Rows (key, call_id, t, busy) in a folder of files by arrival, which is up to half an hour behind time."""
    rng, rows = random.Random(6), []
    for key in range(12):
        t = 1_700_000_000
        for _ in range(40):
            t += rng.choice([0, 20, 400, 1200, 5000])
            rows.append((key, len(rows), t, rng.choice([0, 0, 0, 700, 4000])))
    arrived = sorted(rows, key=lambda r: r[2] + rng.randrange(1800))
    folder = str(tmp_path_factory.mktemp("calls") / "rows")
    for i in range(0, len(arrived), 60):
        spark.createDataFrame(arrived[i : i + 60], "key long, call_id long, t long, busy long").coalesce(1).withColumn("ts", F.timestamp_seconds("t")).write.mode("append").parquet(folder)
    return folder, rows


def stream(spark, folder):
    return streams.read_events(spark, folder).withWatermark("ts", f"{LATE} seconds")


def test_sessions_with_busy_time(spark, calls):
    folder, rows = calls
    mark = max(r[2] for r in rows) - LATE
    want = []
    for key in {r[0] for r in rows}:
        own = []
        for _, _, t, busy in sorted(r for r in rows if r[0] == key):
            if own and t - own[-1][1] < IDLE:
                own[-1] = [own[-1][0], max(own[-1][1], t + busy), own[-1][2] + 1]
            else:
                own.append([t, t + busy, 1])
        want += [(key, a * 1000, (b + IDLE) * 1000, n) for a, b, n in own if b + IDLE <= mark]
    activity = stream(spark, folder).select("key", "ts", (F.col("t") * 1000).alias("t"), (F.col("busy") * 1000).alias("busy"))
    got = stateful.all_available(stateful.sessions(activity, IDLE), "test-sessions")
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and any(r[3] > 3 for r in want)


def test_admissions_in_order_of_time(spark, calls):
    folder, rows = calls
    mark = max(r[2] for r in rows) - LATE
    batch = spark.createDataFrame([r[:3] for r in rows], "key long, call_id long, t long")
    want = sorted((r.key, r.call_id, r.t, r.outcome) for r in accounting.rate_limit(batch.select("key", "t", "call_id"), 3, 3000).collect() if r.t <= mark)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    got = stateful.all_available(stateful.admissions(stream(spark, folder).select("key", "call_id", "t", "ts"), 3, 3000), "test-admissions")
    assert sorted(tuple(r) for r in got.collect()) == want and {r[3] for r in want} == {"admitted", "refused"}
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
