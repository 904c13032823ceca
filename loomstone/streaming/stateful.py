"""Streams with state of their own that ends: sessions with busy time, admissions in order of time.

State is kept by key in the state store until a timer of event time says that nothing can change it any more: a session when it
ended, admissions when they are too old to count. Rows may come in any order within the watermark; later ones are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from loomstone.operators.accounting import IDLE_SECONDS, RATE_LIMIT, RATE_SECONDS
from loomstone.sources.scratch import scratch_dir


class _Sessions(StatefulProcessor):
    """Open sessions of a key as intervals of milliseconds; intervals that come nearer than ``idle`` are one session."""

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "starts array<long>, ends array<long>, counts array<long>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        known = list(zip(*self.open.get(), strict=True)) if self.open.exists() else []
        for frame in rows:
            known += [(int(t), int(t) + int(b), 1) for t, b in zip(frame["t"], frame["busy"], strict=True)]
        merged: list[list[int]] = []
        for start, end, n in sorted(known):
            if merged and start - merged[-1][1] < self.idle:
                merged[-1] = [merged[-1][0], max(merged[-1][1], end), merged[-1][2] + n]
            else:
                merged.append([start, end, n])
        self.open.update(tuple(map(list, zip(*merged, strict=True))))
        for _, end, _ in merged:
            self.handle.registerTimer(end + self.idle)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        known = list(zip(*self.open.get(), strict=True)) if self.open.exists() else []
        # A timer of an interval that grew finds its session still open.
        over = [s for s in known if s[1] + self.idle <= now]
        rest = [s for s in known if s[1] + self.idle > now]
        if rest:
            self.open.update(tuple(map(list, zip(*rest, strict=True))))
        else:
            self.open.clear()
        if over:
            yield pd.DataFrame({"key": key[0], "started": [s[0] for s in over], "ended": [s[1] + self.idle for s in over], "n_events": [s[2] for s in over]})

    def close(self) -> None:
        pass


def sessions(activity: DataFrame, idle: int = IDLE_SECONDS) -> DataFrame:
    """key, started, ended (milliseconds), n_events of sessions that ended: ``idle`` seconds after the last activity.

    activity: a stream (key long, ts with a watermark, t and busy in milliseconds). A row is work from t to t + busy, so a
    session lasts as long as any of its work and the idle time begins when that is finished.
    """
    return activity.groupBy("key").transformWithStateInPandas(_Sessions(idle * 1000), "key long, started long, ended long, n_events long", "Append", "EventTime")


class _Admissions(StatefulProcessor):
    """Calls that wait for the watermark, and the admitted ones that still count."""

    def __init__(self, most: int, seconds: int):
        self.most, self.seconds = most, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.calls = handle.getValueState("calls", "times array<long>, ids array<long>, recent array<long>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        times, ids, recent = map(list, self.calls.get()) if self.calls.exists() else ([], [], [])
        for frame in rows:
            times += map(int, frame["t"])
            ids += map(int, frame["call_id"])
        self.calls.update((times, ids, recent))
        self.handle.registerTimer(min(times) * 1000)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        if not self.calls.exists():
            return
        now = timerValues.getCurrentWatermarkInMs() // 1000
        times, ids, recent = map(list, self.calls.get())
        waiting, done = [], []
        for t, i in sorted(zip(times, ids, strict=True)):
            if t > now:
                waiting.append((t, i))
                continue
            recent = [x for x in recent if x > t - self.seconds]
            if len(recent) < self.most:
                recent.append(t)
                done.append((i, t, "admitted"))
            else:
                done.append((i, t, "refused"))
        recent = [x for x in recent if x > now - self.seconds]
        if waiting or recent:
            self.calls.update(([t for t, _ in waiting], [i for _, i in waiting], recent))
            self.handle.registerTimer(min([t for t, _ in waiting[:1]] + [t + self.seconds for t in recent[-1:]]) * 1000)
        else:
            self.calls.clear()
        if done:
            yield pd.DataFrame({"key": key[0], "call_id": [d[0] for d in done], "t": [d[1] for d in done], "outcome": [d[2] for d in done]})

    def close(self) -> None:
        pass


def admissions(calls: DataFrame, most: int = RATE_LIMIT, seconds: int = RATE_SECONDS) -> DataFrame:
    """admitted or refused for each call once the watermark passed it, in order of time and id: at most ``most`` admitted in any ``seconds``.

    calls: a stream (key long, call_id long, t in seconds, ts with a watermark).
    """
    return calls.groupBy("key").transformWithStateInPandas(_Admissions(most, seconds), "key long, call_id long, t long, outcome string", "Append", "EventTime")


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings changed while a stream starts, which copies them."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def all_available(stream: DataFrame, label: str) -> DataFrame:
    """All available input of a stream through it into Parquet files of the shared folder, and these read back.

    The state is dealt over as many partitions as the session has cores.
    """
    spark = stream.sparkSession
    path = scratch_dir(spark, label)
    settings = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.shuffle.partitions": str(spark.sparkContext.defaultParallelism),
    }
    with _settings(spark, settings):
        query = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
