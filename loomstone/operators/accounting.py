"""Accounting and service logs: costs, failing pairs, sessions, waits, locks; replays of admission, queues and caches.

Replays fold the events of one key in order; keys are dealt out, and the events of a key stream
through its task without being collected.
"""

from __future__ import annotations

from collections import OrderedDict, deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Seconds and numbers of the services' rules.
IDLE_SECONDS, RATE_LIMIT, RATE_SECONDS, LOCK_SECONDS = 600, 3, 300, 600
CACHE_ENTRIES, CACHE_SECONDS = 10, 300


def daily_costs(calls: DataFrame) -> DataFrame:
    """calls(day, tool, raw, act) by day and tool: number, tokens saved (never negative), raw and actual tokens."""
    saved = F.greatest(F.col("raw") - F.col("act"), F.lit(0))
    return calls.groupBy("day", "tool").agg(F.count("*").alias("calls"), F.sum(saved).cast("long").alias("saved"), F.sum("raw").cast("long").alias("raw"), F.sum("act").cast("long").alias("act"))


def add_costs(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored daily costs with fresh ones added."""
    return stored.unionByName(fresh).groupBy("day", "tool").agg(*(F.sum(c).cast("long").alias(c) for c in ("calls", "saved", "raw", "act")))


def failing_pairs(failures: DataFrame, *keys: str) -> DataFrame:
    """One row for each failing pair: occurrences, first and last time."""
    return failures.groupBy(*keys).agg(F.count("*").alias("occurrences"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def add_pairs(stored: DataFrame, fresh: DataFrame, *keys: str) -> DataFrame:
    """Stored failing pairs with fresh ones added: occurrences summed, the first and the last time."""
    both = stored.unionByName(fresh)
    return both.groupBy(*keys).agg(F.sum("occurrences").cast("long").alias("occurrences"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def pair_statistics(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("adapter", "status").agg(F.count("*").alias("n_pairs"), F.sum("occurrences").cast("long").alias("occurrences"))


def sessions(events: DataFrame, idle: int = IDLE_SECONDS) -> DataFrame:
    """Sessions of users that end after ``idle`` seconds without an event: events(user_id, ts)."""
    w = F.session_window("ts", f"{idle} seconds")
    return events.groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n_events")).select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n_events")


def wait_estimates(releases: DataFrame, hour: int = 3600, least: int = 3) -> DataFrame:
    """Mean gap in seconds between the releases of the last hour, where there are three or more: releases(key, t)."""
    w = Window.partitionBy("key").orderBy("t").rangeBetween(-hour, 0)
    n, span = F.count("*").over(w), F.max("t").over(w) - F.min("t").over(w)
    return releases.select("key", "t", F.when(n >= least, span / (n - 1)).alias("gap"))


def estimated_wait(gap, position):
    """Whole seconds until the job at a queue position is served, at the mean gap between releases; null without one."""
    return F.ceil(gap * position).cast("long")


def scan_progress(done, total):
    """Whole per cent of a scan's files that are done; 100 where there are none."""
    return F.when(total > 0, F.floor(100 * done / total)).otherwise(100).cast("int")


def scan_locks(starts: DataFrame, stale: int = LOCK_SECONDS) -> DataFrame:
    """STARTED or BLOCKED of scan starts(user_id, t, ended): blocked while an earlier start of the user is live.

    A start that was blocked holds no lock, so this is a fold, not a window.
    """

    def fold(rows: Iterator[dict]) -> Iterator[str]:
        until = float("-inf")
        for r in rows:
            if r["t"] < until:
                yield "BLOCKED"
            else:
                until = min(r["ended"] if r["ended"] is not None else float("inf"), r["t"] + stale)
                yield "STARTED"

    return replay(starts, ["user_id"], "t", fold, "outcome")


def replay(events: DataFrame, keys: list[str], order: str, fold: Callable[[Iterator[dict]], Iterator[str]], output: str) -> DataFrame:
    """``output`` of each event by a fold over the events of its key in order (ties by all columns)."""
    names = events.columns
    schema = events.withColumn(output, F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, inbox, outbox = None, None, None
        for batch in batches:
            results = []
            for row in batch.to_pylist():
                own = tuple(row[k] for k in keys)
                if own != key:
                    key, inbox = own, deque()
                    outbox = fold(iter(inbox.popleft, None))
                inbox.append(row)
                results.append(next(outbox))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(results, type=pa.string())], names=[*names, output])

    rest = [c for c in names if c not in keys and c != order]
    return events.repartition(*keys).sortWithinPartitions(*keys, order, *rest).mapInArrow(run, schema)


def rate_limit(calls: DataFrame, most: int = RATE_LIMIT, seconds: int = RATE_SECONDS) -> DataFrame:
    """admitted or refused: at most ``most`` admitted calls of a key in any ``seconds``; refused ones do not count."""

    def fold(rows: Iterator[dict]) -> Iterator[str]:
        recent: deque = deque()
        for r in rows:
            while recent and recent[0] <= r["t"] - seconds:
                recent.popleft()
            if len(recent) < most:
                recent.append(r["t"])
                yield "admitted"
            else:
                yield "refused"

    return replay(calls, ["key"], "t", fold, "outcome")


def slot_queue(requests: DataFrame, slots: int) -> DataFrame:
    """Start time of each request (pool, t, seconds) in a pool of slots: first come first served, no overtaking."""
    import heapq

    def fold(rows: Iterator[dict]) -> Iterator[str]:
        free = [float("-inf")] * slots
        last = float("-inf")
        for r in rows:
            start = max(r["t"], free[0], last)
            heapq.heapreplace(free, start + r["seconds"])
            last = start
            yield str(int(start))

    out = replay(requests, ["pool"], "t", fold, "started")
    return out.withColumn("started", F.col("started").cast("long")).withColumn("waited", F.col("started") - F.col("t"))


def route_requests(requests: DataFrame, backends: list[tuple[str, int, int]]) -> DataFrame:
    """Backend of each request (router, t, tokens, seconds): least loaded by weight among those with room.

    backends: (name, weight, token budget). A request that fits none at all is ``413``; one that has to wait
    goes to the backend that has room first, and requests are served in order.
    """
    import heapq

    def fold(rows: Iterator[dict]) -> Iterator[str]:
        live: dict[str, list[tuple[int, int]]] = {name: [] for name, _, _ in backends}
        clock = 0
        for r in rows:
            if all(r["tokens"] > budget for _, _, budget in backends):
                yield "413"
                continue
            clock = max(clock, r["t"])
            while True:
                for jobs in live.values():
                    while jobs and jobs[0][0] <= clock:
                        heapq.heappop(jobs)
                used = {name: sum(n for _, n in live[name]) for name in live}
                fit = [(used[name] / weight, i, name) for i, (name, weight, budget) in enumerate(backends) if used[name] + r["tokens"] <= budget]
                if fit:
                    break
                clock = min(jobs[0][0] for jobs in live.values() if jobs)
            name = min(fit)[2]
            heapq.heappush(live[name], (clock + r["seconds"], r["tokens"]))
            yield f"{name}@{clock}"

    return replay(requests, ["router"], "t", fold, "served")


def page_cache(loads: DataFrame, entries: int = CACHE_ENTRIES, seconds: int = CACHE_SECONDS) -> DataFrame:
    """hit, expired or miss of page loads (slot, t, url): least recently used entries go first."""

    def fold(rows: Iterator[dict]) -> Iterator[str]:
        cache: OrderedDict[str, int] = OrderedDict()
        for r in rows:
            stored = cache.pop(r["url"], None)
            fresh = stored is not None and r["t"] - stored < seconds
            cache[r["url"]] = stored if fresh else r["t"]
            if len(cache) > entries:
                cache.popitem(last=False)
            yield "hit" if fresh else "expired" if stored is not None else "miss"

    return replay(loads, ["slot"], "t", fold, "outcome")
