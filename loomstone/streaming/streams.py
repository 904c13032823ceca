"""Structured Streaming forms: sessions, daily costs, sliding admission, deduplication, windows and joins.

Event times must be zoned timestamps: ``zoned`` casts the tables' zone-less ones under the session's UTC.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomstone.operators.accounting import IDLE_SECONDS, RATE_LIMIT, RATE_SECONDS


def zoned(df: DataFrame, column: str = "ts") -> DataFrame:
    return df.withColumn(column, F.col(column).cast("timestamp"))


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A file stream of an events folder, with the schema of what is there."""
    schema = spark.read.parquet(path).schema
    return zoned(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path))


def idle_sessions(events: DataFrame, late: str = "10 minutes", idle: int = IDLE_SECONDS) -> DataFrame:
    """Sessions that ended by ``idle`` seconds without events; a session comes out when the watermark passed it."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", f"{idle} seconds").alias("w")).agg(F.count("*").alias("n_events"))


def running_costs(events: DataFrame) -> DataFrame:
    """Calls and values by day and type so far (update mode)."""
    return events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("calls"), F.sum("value").alias("total"))


def distinct_events(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events whose id was not seen within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def tumbling(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Events by type in tumbling (or sliding) windows."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"))


def joined_streams(left: DataFrame, right: DataFrame, within: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Pairs of a user's events of two streams, the right one within ``within`` after the left one."""
    a = left.withWatermark("ts", late).select("user_id", F.col("ts").alias("left_ts"), F.col("event_id").alias("left_id"))
    b = right.withWatermark("ts", late).select(F.col("user_id").alias("right_user"), F.col("ts").alias("right_ts"), F.col("event_id").alias("right_id"))
    return a.join(b, F.expr(f"user_id = right_user AND right_ts >= left_ts AND right_ts <= left_ts + interval {within}")).drop("right_user")


def admissions(calls: DataFrame, most: int = RATE_LIMIT, seconds: int = RATE_SECONDS) -> DataFrame:
    """admitted or refused for each call (key, t, call_id): the recent admissions of a key are its state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["t", "call_id"])
        outcomes = []
        for t in rows["t"].tolist():
            recent = [x for x in recent if x > t - seconds]
            ok = len(recent) < most
            if ok:
                recent.append(t)
            outcomes.append("admitted" if ok else "refused")
        state.update((recent,))
        yield pd.DataFrame({"key": key[0], "call_id": rows["call_id"], "t": rows["t"], "outcome": outcomes})

    return calls.groupBy("key").applyInPandasWithState(step, "key long, call_id long, t long, outcome string", "recent array<long>", "append", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """All available input through a stream into a table in memory (for tests and small results)."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
