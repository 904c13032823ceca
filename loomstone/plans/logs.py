"""Queries over versions, edits, sessions, costs and SQL checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstone.operators import accounting as acc
from loomstone.operators import changes as ch
from loomstone.operators import validate
from loomstone.registry import query
from loomstone.sources.tables import table
from loomstone.streaming import stateful, streams

_SECONDS = "CAST(floor(epoch(ts)) AS BIGINT)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("t", F.unix_seconds(F.col("ts").cast("timestamp")))


@query("parse_gate", """
SELECT doc_id AS file_id, md5(text) AS hash, doc_id % 3 <> 0 AND doc_id % 5 <> 0 AND doc_id % 7 <> 0 AS skip FROM documents""")
def parse_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    stored = d.select(k.alias("file_id"), F.when(k % 3 == 0, "old").otherwise(F.md5("text")).alias("hash"), F.when(k % 5 == 0, "13").otherwise("14").alias("extractor_version"), F.when(k % 7 == 0, 0).otherwise(2).alias("n_modules"))
    return ch.parse_gate(d.select(k.alias("file_id"), F.md5("text").alias("hash")), stored, "14")


@query("reconciled_paths", """
SELECT coalesce(a.p, b.p) AS path, b.p IS NOT NULL AS present, CASE WHEN a.p IS NULL THEN 'new' WHEN b.p IS NULL THEN 'absent' ELSE 'kept' END AS state
FROM (SELECT c_name AS p FROM customer WHERE c_custkey % 3 <> 0) a FULL JOIN (SELECT c_name AS p FROM customer WHERE c_custkey % 4 <> 0) b ON a.p = b.p""")
def reconciled_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return ch.reconcile(c.where("c_custkey % 3 <> 0").select(F.col("c_name").alias("path")), c.where("c_custkey % 4 <> 0").select(F.col("c_name").alias("path")))


@query("drifted_files", "SELECT o_orderkey AS file_id FROM orders WHERE o_orderkey % 5 = 0")
def drifted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file_id"), F.col("o_orderdate").alias("mtime"))
    return ch.drifted(o, o.withColumn("mtime", F.when(F.col("file_id") % 5 == 0, F.col("mtime") + F.expr("interval 1 second")).otherwise(F.col("mtime"))))


@query("integrity_sweep", "SELECT doc_id AS file_id, CASE WHEN doc_id % 6 = 0 THEN 'missing' WHEN doc_id % 4 = 0 THEN 'size' WHEN doc_id % 5 = 0 THEN 'hash' END AS reason FROM documents")
def integrity_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    stored = table(spark, sf_dir, "documents").select(k.alias("file_id"), F.col("n_chars").alias("size"), F.md5("text").alias("hash"))
    f = F.col("file_id")
    disk = stored.where(f % 6 != 0).select("file_id", F.when(f % 4 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), F.when(f % 5 == 0, "x").otherwise(F.col("hash")).alias("hash"))
    return ch.integrity(stored, disk)


@query("latest_versions", "SELECT conv_id AS file_id, max(turn) AS version_number, md5(arg_max(text, turn)) AS hash, max(turn) + 1 AS next_version FROM conversations GROUP BY 1")
def latest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.latest_versions(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file_id"), F.col("turn").alias("version_number"), F.md5("text").alias("hash")))


@query("newest_changes", "SELECT event_id AS change_id, user_id AS project_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS nth FROM events QUALIFY nth <= 10")
def newest_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("change_id"), F.col("user_id").alias("project_id"))
    return ch.newest_changes(e).select("change_id", "project_id", F.col("nth").cast("long").alias("nth"))


@query("undo_until_conflict", """
WITH n AS (SELECT event_id, user_id, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS nth FROM events QUALIFY nth <= 10)
SELECT event_id AS change_id, user_id AS project_id, nth FROM n a WHERE NOT EXISTS (SELECT 1 FROM n b WHERE b.user_id = a.user_id AND b.nth <= a.nth AND b.bad)""")
def undo_until_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.when(F.col("event_type") == "error", "other").otherwise("same")
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("change_id"), F.col("user_id").alias("project_id"), F.lit("same").alias("hash_after"), now.alias("hash_now"))
    return ch.undo_until_conflict(e).select("change_id", "project_id", F.col("nth").cast("long").alias("nth"))


@query("undo_blockers", "SELECT event_id AS op_id, CAST(count(*) FILTER (event_type IN ('click', 'signup')) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS BIGINT) AS blocked_by FROM events")
def undo_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = table(spark, sf_dir, "events").select(F.col("event_id").alias("op_id"), F.col("user_id").alias("path"), F.col("event_type").isin("click", "signup").alias("structural"))
    return ch.blockers(ops).select("op_id", "blocked_by")


@query("verification_states", "SELECT user_id AS file_id, CASE arg_max(event_type, event_id) WHEN 'purchase' THEN 'verified' WHEN 'error' THEN 'not_verifiable' ELSE 'unverified' END AS status FROM events GROUP BY 1")
def verification_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "verify").when(F.col("event_type") == "error", "check").otherwise("edit")
    return ch.verification_states(table(spark, sf_dir, "events").select(F.col("user_id").alias("file_id"), F.col("event_id").alias("at"), "event_id", kind.alias("event")))


@query("segment_diff", """
WITH RECURSIVE o AS (SELECT o_custkey AS doc_id, o_orderkey AS seg_id, o_orderkey AS ord, CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE 'a' END AS text FROM orders),
old AS (SELECT * FROM o WHERE seg_id % 11 <> 0),
new AS (SELECT doc_id, seg_id, CASE WHEN seg_id % 3 = 0 THEN seg_id * 7919 % 50000 ELSE seg_id END AS ord, CASE WHEN seg_id % 5 = 0 THEN 'b' ELSE text END AS text FROM o WHERE seg_id % 7 <> 0),
s AS (SELECT doc_id, seg_id, old.ord AS a, new.ord AS b, row_number() OVER (PARTITION BY doc_id ORDER BY new.ord, old.ord) AS i FROM old JOIN new USING (doc_id, seg_id)),
chain AS (SELECT doc_id, i, a, 1 AS n FROM s UNION SELECT s.doc_id, s.i, s.a, n + 1 FROM chain c JOIN s ON s.doc_id = c.doc_id AND s.i > c.i AND s.a > c.a),
longest AS (SELECT doc_id, i, a, max(n) AS n FROM chain GROUP BY 1, 2, 3),
pre AS (SELECT x.doc_id, x.i, max(y.i) AS j FROM longest x JOIN longest y ON y.doc_id = x.doc_id AND y.n = x.n - 1 AND y.i < x.i AND y.a < x.a GROUP BY 1, 2),
kept AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, i DESC) AS r FROM longest) WHERE r = 1
  UNION SELECT kept.doc_id, j FROM kept JOIN pre ON pre.doc_id = kept.doc_id AND pre.i = kept.i),
d AS (SELECT doc_id, seg_id, old.ord AS from_ord, new.ord AS to_ord, old.text AS x, new.text AS y FROM old FULL JOIN new USING (doc_id, seg_id))
SELECT doc_id, seg_id, 'MOVED' AS change, a AS from_ord, b AS to_ord FROM s ANTI JOIN kept ON kept.doc_id = s.doc_id AND kept.i = s.i
UNION ALL SELECT doc_id, seg_id, CASE WHEN from_ord IS NULL THEN 'NEW' WHEN to_ord IS NULL THEN 'DELETED' WHEN x = '' THEN 'INSERTED' ELSE 'CHANGED' END, from_ord, to_ord
FROM d WHERE from_ord IS NULL OR (to_ord IS NULL AND x <> '') OR (from_ord IS NOT NULL AND to_ord IS NOT NULL AND x <> y)""")
def segment_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as segments of their customers: some gone, some new, some changed, every third dealt to another place."""
    k = F.col("seg_id")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("seg_id"))
    rows = rows.select("doc_id", "seg_id", k.alias("ord"), F.when(k % 9 == 0, "").otherwise("a").alias("text"))
    dealt = rows.withColumn("ord", F.when(k % 3 == 0, k * 7919 % 50000).otherwise(k)).withColumn("text", F.when(k % 5 == 0, "b").otherwise(F.col("text")))
    return ch.segment_diff(rows.where("seg_id % 11 <> 0"), dealt.where("seg_id % 7 <> 0"))


@query("deleted_segments", "SELECT o_custkey AS doc_id, o_orderkey AS seg_id FROM orders WHERE o_orderkey % 7 = 0")
def deleted_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("seg_id"))
    return ch.deleted_segments(rows, rows.where("seg_id % 7 <> 0"))


@query("replayed_edits", """
SELECT CAST(conv_id AS VARCHAR) AS path, string_agg(CASE WHEN turn = 0 THEN 'new' ELSE 't' || turn END, chr(10) ORDER BY turn) AS content, 1 AS n_applied, 1 AS n_refused, true AS restored FROM conversations GROUP BY conv_id""")
def replayed_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's turns as segments; the first is replaced, and an edit of an unknown one refused."""
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("path"), "turn")
    segs = t.groupBy("path").agg(F.transform(F.array_sort(F.collect_list("turn")), lambda x: F.struct(F.concat(F.lit("s"), x).alias("id"), F.concat(F.lit("t"), x).alias("text"))).alias("segments"))
    edits = t.select("path").distinct().select("path", F.posexplode(F.array(F.lit('{"op": "replace", "seg": "s0", "text": "new"}'), F.lit('{"op": "delete", "seg": "none"}'))).alias("edit_id", "payload"))
    return ch.replay_edits(segs, edits)


@query("stale_tokens", "SELECT c_custkey AS k, c_custkey % 4 = 0 AS stale FROM customer")
def stale_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    files = c.select(F.col("c_name").alias("path"), F.md5("c_mktsegment").alias("hash"))
    at_edit = F.when(k % 4 == 0, F.lit("old")).otherwise(F.md5("c_mktsegment"))
    tokens = c.select(ch.edit_token(F.concat(F.lit("a."), k), at_edit).alias("token"), F.col("c_name").alias("path"), F.concat(F.lit("a."), k).alias("location"), k.alias("k"))
    return ch.stale_tokens(tokens.drop("k"), files).join(tokens.select("token", "k"), "token").select("k", "stale")


@query("read_before_write", """
WITH e AS (SELECT event_id, user_id AS path, event_type = 'purchase' AS edit, event_type = 'view' AS read, CAST(round(value * 10) AS BIGINT) % 3 AS address FROM events)
SELECT event_id, coalesce((SELECT max(r.event_id) FROM e r WHERE r.path = e.path AND r.address = e.address AND r.read AND r.event_id < e.event_id) > coalesce((SELECT max(w.event_id) FROM e w WHERE w.path = e.path AND w.edit AND w.event_id < e.event_id), -1), false) AS allowed
FROM e WHERE edit""")
def read_before_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "edit").when(F.col("event_type") == "view", "read").otherwise("other")
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("path"), (F.round(F.col("value") * 10).cast("long") % 3).alias("address"), kind.alias("kind"))
    return ch.read_before_write(rows)


@query("repeated_failures", """
WITH e AS (SELECT user_id AS session, event_id AS call_id, event_type AS call, event_type IN ('error', 'click') AS failed FROM events),
n AS (SELECT *, lag(call) OVER w = call AND lag(failed) OVER w AND failed AS same, row_number() OVER w AS r FROM e WINDOW w AS (PARTITION BY session ORDER BY call_id)),
g AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY session ORDER BY call_id) AS run FROM n)
SELECT session, call_id, call FROM (SELECT *, row_number() OVER (PARTITION BY session, run ORDER BY call_id) AS nth FROM g) WHERE failed AND nth = 3""")
def repeated_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("call_id"), F.col("event_type").alias("call"), F.col("event_type").isin("error", "click").alias("failed"))
    return ch.repeated_failures(rows)


@query("verified_level", "SELECT l_orderkey AS file_id, coalesce(min(l_linenumber) FILTER (l_tax > 0.06) - 1, max(l_linenumber)) AS level FROM lineitem GROUP BY 1")
def verified_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.verified_level(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("level"), (F.col("l_tax") <= 0.06).alias("passed")))


@query("split_problems", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'not_checked' ELSE 'problem' END AS outcome FROM orders")
def split_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "Not checked: no database inferred").otherwise("unknown column x").alias("problem"))
    return ch.split_problems(rows).select("o_orderkey", "outcome")


@query("unknown_imports", "SELECT p_partkey FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 50 >= 25")
def unknown_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    imports = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("m"), k % 50, F.lit(".sub")).alias("import_path"), (k % 3 == 0).alias("is_external"))
    packages = table(spark, sf_dir, "nation").select(F.concat(F.lit("m"), "n_nationkey").alias("name"))
    return ch.unknown_imports(imports, packages, spark.sql("SELECT 'os' AS name")).select("p_partkey")


@query("daily_costs", """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type AS tool, count(*) AS calls, CAST(sum(greatest(0, CAST(round(value) AS BIGINT) - user_id)) AS BIGINT) AS saved, CAST(sum(CAST(round(value) AS BIGINT)) AS BIGINT) AS raw, CAST(sum(user_id) AS BIGINT) AS act FROM events GROUP BY 1, 2""")
def daily_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return acc.daily_costs(e.select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("tool"), F.round("value").cast("long").alias("raw"), F.col("user_id").alias("act")))


@query("added_costs", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type AS tool, count(*) AS calls FROM events GROUP BY 1, 2")
def added_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs of two halves added up are those of the whole."""
    rows = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("tool"), F.lit(2).alias("raw"), F.lit(1).alias("act"))
    return acc.add_costs(acc.daily_costs(rows.where("event_id % 2 = 0")), acc.daily_costs(rows.where("event_id % 2 = 1"))).select("day", "tool", "calls")


@query("failing_pairs", """
SELECT event_type AS adapter, user_id % 4 AS status, count(*) AS n_pairs, CAST(sum(n) AS BIGINT) AS occurrences FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1, 2""")
def failing_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = acc.failing_pairs(table(spark, sf_dir, "events"), "event_type", "user_id")
    return acc.pair_statistics(pairs.select(F.col("event_type").alias("adapter"), (F.col("user_id") % 4).alias("status"), "occurrences"))


@query("top_pairs", "SELECT event_type, user_id, count(*) AS occurrences FROM events GROUP BY 1, 2 ORDER BY 3 DESC, max(ts) DESC, 1, 2 LIMIT 20")
def top_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-20 report."""
    pairs = acc.failing_pairs(table(spark, sf_dir, "events"), "event_type", "user_id")
    return pairs.orderBy(F.desc("occurrences"), F.desc("last_seen"), "event_type", "user_id").limit(20).select("event_type", "user_id", "occurrences")


@query("idle_sessions", f"""
WITH e AS (SELECT user_id, {_SECONDS} AS t, epoch(ts) AS x FROM events),
g AS (SELECT *, CASE WHEN lag(x) OVER w IS NULL OR x - lag(x) OVER w >= 600 THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY x)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY x ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, CAST(floor(min(x)) AS BIGINT) AS started, CAST(floor(max(x)) + 600 AS BIGINT) AS ended, count(*) AS n_events FROM s GROUP BY user_id, k""")
def idle_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return acc.sessions(rows).select("user_id", F.unix_seconds("started").alias("started"), F.unix_seconds("ended").alias("ended"), "n_events")


@query("wait_estimates", f"""
WITH g AS (SELECT event_id, CASE WHEN count(*) OVER w >= 3 THEN (max({_SECONDS}) OVER w - min({_SECONDS}) OVER w) / (count(*) OVER w - 1) END AS gap
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY {_SECONDS} RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW))
SELECT event_id, gap, CAST(ceil(gap * (event_id % 5 + 1)) AS BIGINT) AS wait FROM g""")
def wait_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select(F.col("event_type").alias("key"), "t", "event_id")
    gaps = acc.wait_estimates(e.select("key", "t")).distinct()
    return e.join(gaps, ["key", "t"]).select("event_id", "gap", acc.estimated_wait(F.col("gap"), F.col("event_id") % 5 + 1).alias("wait"))


#: Folds as recursive SQL: the i-th event of every key follows the state behind the one before.
def _fold_sql(columns: str, key: str, first: str, following: str) -> str:
    """columns: of an event, by name; first and following: the further columns (outcome and state) of a key's first event and of
    the later ones, from the event e and the row w before it."""
    names = [c.rsplit(" AS ", 1)[1] for c in columns.split("; ")]
    own = ", ".join(f"e.{n}" for n in names)
    rest = ", ".join(["t", *(n for n in names if n not in (key, "t"))])
    return f"""WITH RECURSIVE s AS (SELECT {columns.replace("; ", ", ")} FROM (SELECT *, {_SECONDS} AS t FROM events)),
e AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {rest}) AS i FROM s),
w AS (SELECT {own}, i, {first} FROM e WHERE i = 1 UNION ALL SELECT {own}, e.i, {following} FROM w JOIN e ON e.{key} = w.{key} AND e.i = w.i + 1)"""


_LOCKS = _fold_sql(
    "user_id AS user_id; t AS t; t + 5000 * (event_id % 3) AS ended; event_id AS event_id", "user_id",
    f"'STARTED' AS outcome, least(e.ended, e.t + {acc.LOCK_SECONDS}) AS until",
    f"CASE WHEN e.t < until THEN 'BLOCKED' ELSE 'STARTED' END, CASE WHEN e.t < until THEN until ELSE least(e.ended, e.t + {acc.LOCK_SECONDS}) END",
)
_RECENT = "list_filter(recent, lambda x: x > e.t - 50000)"
_RATES = _fold_sql(
    "user_id AS key; t AS t; event_id AS event_id", "key", "'admitted' AS outcome, [e.t] AS recent",
    f"CASE WHEN len({_RECENT}) < 3 THEN 'admitted' ELSE 'refused' END, CASE WHEN len({_RECENT}) < 3 THEN list_append({_RECENT}, e.t) ELSE {_RECENT} END",
)
_BEGIN = "greatest(e.t, free[1], w.started)"
_SLOTS = _fold_sql(
    "event_type AS pool; t AS t; event_id % 900 + 600 AS seconds; event_id AS event_id", "pool", "e.t AS started, [-1, e.t + e.seconds] AS free",
    f"{_BEGIN}, list_sort([{_BEGIN} + e.seconds, free[2]])",
)
_STORED = "list_filter(cache, lambda x: x.url = e.url)[1].at"
_KEPT = f"CASE WHEN e.t - {_STORED} < 20000 THEN {_STORED} ELSE e.t END"
_CACHED = f"list_append(list_filter(cache, lambda x: x.url <> e.url), {{'url': e.url, 'at': {_KEPT}}})"
_CACHE = _fold_sql(
    "user_id % 5 AS slot; t AS t; 'u' || (user_id % 30) AS url; event_id AS event_id", "slot", "'miss' AS outcome, [{'url': e.url, 'at': e.t}] AS cache",
    f"CASE WHEN {_STORED} IS NULL THEN 'miss' WHEN e.t - {_STORED} < 20000 THEN 'hit' ELSE 'expired' END, list_slice({_CACHED}, greatest(1, len({_CACHED}) - 2), len({_CACHED}))",
)


@query("scan_locks", f"{_LOCKS} SELECT user_id, t, ended, event_id, outcome FROM w")
def scan_locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return acc.scan_locks(e.select("user_id", "t", (F.col("t") + 5000 * (F.col("event_id") % 3)).alias("ended"), "event_id"))


@query("scan_progress", f"""
SELECT user_id, event_id, CAST(floor(100 * row_number() OVER (PARTITION BY user_id ORDER BY {_SECONDS}, event_id) / count(*) OVER (PARTITION BY user_id)) AS INT) AS percent FROM events""")
def scan_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress of each user's events, seen as the files of a scan."""
    w = Window.partitionBy("user_id")
    done, total = F.row_number().over(w.orderBy("t", "event_id")), F.count("*").over(w)
    return _events(spark, sf_dir).select("user_id", "event_id", acc.scan_progress(done, total).alias("percent"))


@query("rate_limited", f"{_RATES} SELECT key, t, event_id, outcome FROM w")
def rate_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acc.rate_limit(_events(spark, sf_dir).select(F.col("user_id").alias("key"), "t", "event_id"), 3, 50_000)


@query("slot_queue", f"{_SLOTS} SELECT pool, t, seconds, event_id, started, started - t AS waited FROM w")
def slot_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acc.slot_queue(_events(spark, sf_dir).select(F.col("event_type").alias("pool"), "t", (F.col("event_id") % 900 + 600).alias("seconds"), "event_id"), 2)


_USED = "coalesce(list_sum(list_transform(list_filter(live, lambda j: j.b = {b} AND j.until > {at}), lambda j: j.n)), 0)"
_BIG, _SMALL = _USED.format(b="'big'", at="x"), _USED.format(b="'small'", at="x")


@query("routed_requests", f"""
WITH RECURSIVE s AS (SELECT user_id % 4 AS router, t, event_id % 1200 AS tokens, event_id % 3000 + 100 AS seconds, event_id FROM (SELECT *, {_SECONDS} AS t FROM events)),
e AS (SELECT *, row_number() OVER (PARTITION BY router ORDER BY t, tokens, seconds, event_id) AS i FROM s),
w AS (
  SELECT router, t, tokens, seconds, event_id, i, CASE WHEN tokens > 1000 THEN '413' ELSE 'big@' || t END AS served, CASE WHEN tokens > 1000 THEN 0 ELSE t END AS clock,
    CASE WHEN tokens > 1000 THEN [] ELSE [{{'b': 'big', 'until': t + seconds, 'n': tokens}}] END AS live FROM e WHERE i = 1
  UNION ALL SELECT router, t, tokens, seconds, event_id, i, CASE WHEN tokens > 1000 THEN '413' ELSE b || '@' || c END, CASE WHEN tokens > 1000 THEN clock ELSE c END,
    CASE WHEN tokens > 1000 THEN live ELSE list_append(list_filter(live, lambda j: j.until > c), {{'b': b, 'until': c + seconds, 'n': tokens}}) END
  FROM (
    SELECT *, CASE WHEN big + tokens <= 1000 AND (small + tokens > 500 OR big / 2 <= small) THEN 'big' ELSE 'small' END AS b
    FROM (SELECT *, {_USED.format(b="'big'", at="c")} AS big, {_USED.format(b="'small'", at="c")} AS small FROM (
      SELECT e.router, e.t, e.tokens, e.seconds, e.event_id, e.i, w.clock, w.live,
        list_filter(list_sort(list_concat([greatest(w.clock, e.t)], list_filter(list_transform(w.live, lambda j: j.until), lambda u: u > greatest(w.clock, e.t)))), lambda x: {_BIG.replace("live", "w.live")} + e.tokens <= 1000 OR {_SMALL.replace("live", "w.live")} + e.tokens <= 500)[1] AS c
      FROM w JOIN e ON e.router = w.router AND e.i = w.i + 1))))
SELECT router, t, tokens, seconds, event_id, served FROM w""")
def routed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select((F.col("user_id") % 4).alias("router"), "t", (F.col("event_id") % 1200).alias("tokens"), (F.col("event_id") % 3000 + 100).alias("seconds"), "event_id")
    return acc.route_requests(rows, [("big", 2, 1000), ("small", 1, 500)])


@query("page_cache_replay", f"{_CACHE} SELECT slot, t, url, event_id, outcome FROM w")
def page_cache_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select((F.col("user_id") % 5).alias("slot"), "t", F.concat(F.lit("u"), F.col("user_id") % 30).alias("url"), "event_id")
    return acc.page_cache(rows, 3, 20_000)


@query("split_statements", "SELECT o_orderkey AS id, 0 AS ord, 'SELECT '';'' AS a' AS statement FROM orders UNION ALL SELECT o_orderkey, 1, 'DELETE FROM t' || o_orderkey || ' /* ; */' FROM orders")
def split_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = F.concat(F.lit("SELECT ';' AS a;\n-- ; note\n;DELETE FROM t"), "o_orderkey", F.lit(" /* ; */;"))
    return validate.statements(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), sql.alias("sql")))


@query("sql_checks", """
SELECT * FROM (VALUES (1, 'sqlite', true, '', 'customer'), (2, 'sqlite', false, 'unknown_column', 'customer'), (3, 'sqlite', false, 'unknown_table', ''), (4, 'sqlite', false, 'syntax', ''),
 (5, 'postgres', true, '', 'orders,customer'), (6, 'redis', true, 'not_checked', ''), (7, 'sqlite', true, '', 'orders'), (8, 'sqlite', false, 'unknown_table', ''), (9, 'mysql', true, '', 'customer'), (10, 'sqlite', true, 'not_checked', '')) AS t(id, type, ok, problem, tables)""")
def sql_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements in the code of several databases against the driver tables' schema; nothing is executed."""
    schema = {n: [(f.name, f.dataType.simpleString()) for f in table(spark, sf_dir, n).schema] for n in ("customer", "orders")}
    adapters = {kind: validate.AnalyserAdapter(spark, kind, schema) for kind in ("sqlite", "postgres", "mysql")}
    queries = [
        (1, None, "SELECT c_name FROM customer WHERE c_custkey = ?"), (2, "sqlite", "SELECT c_nope FROM customer"), (3, "sqlite", "SELECT 1 FROM nowhere"), (4, "sqlite", "SELECT c_name FORM customer WHERE WHERE"),
        (5, "postgres", "SELECT o.o_orderkey, count(*) FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_name = $1 GROUP BY 1"), (6, "redis", "GET x"), (7, "sqlite", "DELETE FROM orders WHERE o_orderkey = :k"), (8, "sqlite", "INSERT INTO gone VALUES (1)"),
        (9, "mysql", "SELECT c_name FROM customer WHERE c_name = %s LIMIT 5"), (10, "sqlite", "DROP TABLE customer"),
    ]
    try:
        rows = [(i, t, f.ok, f.kind, ",".join(f.tables) if f.kind != "syntax" else "") for i, t, f in validate.dispatch(queries, adapters)]
    finally:
        for a in adapters.values():
            a.close()
    return spark.createDataFrame(rows, "id int, type string, ok boolean, problem string, tables string")


@query("syntax_levels", "SELECT c_custkey AS file_id, CASE c_custkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 2 ELSE 2 END AS level FROM customer")
def syntax_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    content = F.when(k % 4 == 0, "def f(): pass").when(k % 4 == 1, "def f(: pass").when(k % 4 == 2, F.concat(F.lit('{"a": '), k, F.lit("}"))).otherwise("[a]\nb = 1\n")
    language = F.when((k % 4) < 2, "python").when(k % 4 == 2, "json").otherwise("ini")
    return ch.syntax_levels(table(spark, sf_dir, "customer").select(k.alias("file_id"), F.lit("x").alias("path"), language.alias("language"), content.alias("content"))).select("file_id", "level")


# Streams over all available events: what the watermark has passed at the end is there.
def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.read_events(spark, f"{sf_dir}/events.parquet*", 1000)  # a pattern may name one file, which a stream's path may not


_MARK = "mark AS (SELECT max(epoch_us(ts) // 1000) - 3600000 AS at FROM events)"


@query("streamed_sessions", f"""
WITH {_MARK}, e AS (SELECT user_id AS key, epoch_us(ts) // 1000 AS x, epoch_us(ts) // 1000 + CASE WHEN event_type = 'purchase' THEN event_id % 9000 ELSE 0 END * 1000 AS y FROM events),
g AS (SELECT *, CASE WHEN max(y) OVER w IS NULL OR x - max(y) OVER w >= 20000000 THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY key ORDER BY x, y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY x, y ROWS UNBOUNDED PRECEDING) AS k FROM g),
d AS (SELECT key, k, min(x) AS started, max(y) + 20000000 AS ended, count(*) AS n_events FROM s GROUP BY key, k)
SELECT key, started, ended, n_events FROM d, mark WHERE ended <= mark.at""")
def streamed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users by event-time timers; purchases keep a session busy for a while."""
    busy = F.when(F.col("event_type") == "purchase", F.col("event_id") % 9000).otherwise(0) * 1000
    activity = _stream(spark, sf_dir).select(F.col("user_id").alias("key"), "ts", F.unix_millis("ts").alias("t"), busy.alias("busy")).withWatermark("ts", "1 hour")
    return stateful.all_available(stateful.sessions(activity, 20_000), "sessions")


@query("streamed_admissions", f"""{_RATES} SELECT w.key, event_id AS call_id, w.t, outcome FROM w WHERE w.t * 1000 <= (SELECT max(epoch_us(ts) // 1000) - 3600000 FROM events)""")
def streamed_admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls admitted or refused as a stream, each once the watermark passed it."""
    calls = _stream(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("event_id").alias("call_id"), F.unix_seconds("ts").alias("t"), "ts").withWatermark("ts", "1 hour")
    return stateful.all_available(stateful.admissions(calls, 3, 50_000), "admissions")


@query("streamed_pairs", """
SELECT a.user_id, a.event_id AS left_id, b.event_id AS right_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR
WHERE a.event_type = 'view' AND b.event_type = 'purchase'""")
def streamed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases within six hours of a view: a stream joined to a stream."""
    of = lambda kind: _stream(spark, sf_dir).where(F.col("event_type") == kind)
    return stateful.all_available(streams.joined_streams(of("view"), of("purchase"), "6 hours").select("user_id", "left_id", "right_id"), "pairs")


@query("streamed_windows", f"""
WITH {_MARK}, e AS (SELECT event_type, CAST(floor(epoch(ts) / 21600) AS BIGINT) * 21600 - 21600 * j AS started FROM events, range(4) t(j))
SELECT started, event_type, count(*) AS n FROM e, mark WHERE (started + 86400) * 1000 <= mark.at GROUP BY 1, 2""")
def streamed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type in sliding windows of a day, closed by the watermark."""
    counted = streams.tumbling(_stream(spark, sf_dir), "1 day", "6 hours").select(F.unix_seconds("w.start").alias("started"), "event_type", "n")
    return stateful.all_available(counted, "windows")
