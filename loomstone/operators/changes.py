"""Change tracking: skip gates, reconciliation, drift, integrity, versions, diffs, undo, edit replay, validation levels."""

from __future__ import annotations

import ast
import bisect
import configparser
import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parse_gate(seen: DataFrame, stored: DataFrame, version: str) -> DataFrame:
    """``skip``: the stored hash is equal, its extractor version current, and it has modules.

    seen(file_id, hash), stored(file_id, hash, extractor_version, n_modules).
    """
    old = stored.select("file_id", F.col("hash").alias("old_hash"), "extractor_version", "n_modules")
    same = F.col("hash").eqNullSafe(F.col("old_hash")) & F.col("extractor_version").eqNullSafe(F.lit(version)) & (F.coalesce("n_modules", F.lit(0)) > 0)
    return seen.join(old, "file_id", "left").select("file_id", "hash", F.coalesce(same, F.lit(False)).alias("skip"))


def reconcile(stored: DataFrame, walked: DataFrame) -> DataFrame:
    """Rows by path: stored ones are kept, ``present`` tells whether the walk found them; new ones are added."""
    s, w = stored.select("path", F.lit(True).alias("was")), walked.select("path", F.lit(True).alias("is")).distinct()
    both = s.join(w, "path", "full_outer")
    state = F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "absent").otherwise("kept")
    return both.select("path", F.col("is").isNotNull().alias("present"), state.alias("state"))


def drifted(stored: DataFrame, disk: DataFrame) -> DataFrame:
    """Files whose time on disk is later than the stored one: stored(file_id, mtime), disk(file_id, mtime)."""
    return stored.select("file_id", F.col("mtime").alias("known")).join(disk, "file_id").where("mtime > known").select("file_id")


def integrity(stored: DataFrame, disk: DataFrame) -> DataFrame:
    """Reason for which a file differs from its stored row: missing, size, hash; null if it does not."""
    found = disk.select("file_id", F.col("size").alias("now_size"), F.col("hash").alias("now_hash"))
    why = F.when(F.col("now_size").isNull(), "missing").when(F.col("now_size") != F.col("size"), "size").when(F.col("now_hash") != F.col("hash"), "hash")
    return stored.join(found, "file_id", "left").select("file_id", why.alias("reason"))


def latest_versions(versions: DataFrame) -> DataFrame:
    """The newest version of each file and the number of the next."""
    top = versions.groupBy("file_id").agg(F.max("version_number").alias("version_number"), F.max_by("hash", "version_number").alias("hash"))
    return top.withColumn("next_version", F.col("version_number") + 1)


def newest_changes(changes: DataFrame, most: int = 10) -> DataFrame:
    """The newest ``most`` changes of each project."""
    nth = F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("change_id")))
    return changes.withColumn("nth", nth).where(F.col("nth") <= most)


def undo_until_conflict(changes: DataFrame, most: int = 10) -> DataFrame:
    """Of the newest changes, those that undo can take back: up to, not with, the first whose hash on disk differs."""
    latest = newest_changes(changes, most)
    so_far = F.max(F.when(F.col("hash_now") != F.col("hash_after"), 1).otherwise(0)).over(Window.partitionBy("project_id").orderBy("nth"))
    return latest.withColumn("conflict", so_far).where("conflict = 0").drop("conflict")


def blockers(ops: DataFrame) -> DataFrame:
    """``blocked_by``: later structural operations on the same path; undo takes the last first."""
    later = Window.partitionBy("path").orderBy(F.desc("op_id")).rowsBetween(Window.unboundedPreceding, -1)
    return ops.withColumn("blocked_by", F.coalesce(F.sum(F.col("structural").cast("long")).over(later), F.lit(0)))


def verification_states(events: DataFrame) -> DataFrame:
    """Status of each file by its last event: events(file_id, at, event) of edit, verify, check."""
    last = events.groupBy("file_id").agg(F.max_by("event", F.struct("at", "event_id")).alias("event"))
    return last.select("file_id", F.when(F.col("event") == "verify", "verified").when(F.col("event") == "check", "not_verifiable").otherwise("unverified").alias("status"))


def in_order(ranks: list[int]) -> list[bool]:
    """Which of distinct numbers belong to their longest increasing subsequence (of several the one that stands farthest back)."""
    length, tails = [], []
    for x in ranks:
        at = bisect.bisect_left(tails, x)
        tails[at : at + 1] = [x]
        length.append(at + 1)
    kept, want, bound = [False] * len(ranks), len(tails), math.inf
    # Numbers that end equally long subsequences fall from left to right: the last one before the bound's place fits if any does.
    for i in range(len(ranks) - 1, -1, -1):
        if length[i] == want and ranks[i] < bound:
            kept[i], bound, want = True, ranks[i], want - 1
    return kept


def moved_segments(shared: DataFrame) -> DataFrame:
    """(doc_id, seg_id) of the fewest segments whose moves explain a new order: all but a longest increasing subsequence.

    shared(doc_id, seg_id, old_ord, new_ord): segments on both sides. Only documents with a segment before one that it
    followed are looked into; a task holds the segments of one such document at a time.
    """
    by_doc = Window.partitionBy("doc_id").orderBy("new_ord", "old_ord", "seg_id")
    falls = shared.withColumn("falls", F.lag("old_ord").over(by_doc) > F.col("old_ord"))
    lists = falls.groupBy("doc_id").agg(F.max("falls").alias("falls"), F.collect_list(F.struct("new_ord", "old_ord", "seg_id")).alias("segments")).where("falls")
    lists = lists.select("doc_id", F.array_sort("segments").alias("segments"))
    schema = shared.select("doc_id", F.array("seg_id").alias("moved")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            moved = []
            for segments in batch.column("segments").to_pylist():
                # Equal old places: by segment, so that none counts as moved for a tie.
                rank = {i: r for r, i in enumerate(sorted(range(len(segments)), key=lambda i: (segments[i]["old_ord"], i)))}
                kept = in_order([rank[i] for i in range(len(segments))])
                moved.append([s["seg_id"] for s, k in zip(segments, kept, strict=True) if not k])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(moved, type=pa.list_(batch.schema.field("segments").type.value_type.field("seg_id").type))], names=["doc_id", "moved"])

    return lists.mapInArrow(run, schema).select("doc_id", F.explode("moved").alias("seg_id"))


def segment_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changes between two states of documents: (doc_id, seg_id, ord, text) before and after, an id once in each.

    Rows (doc_id, seg_id, change, from_ord, to_ord): NEW (no such segment before), INSERTED (it was empty and is not any more),
    CHANGED (another text), DELETED (gone, and was not empty), and beside these MOVED for the fewest segments
    whose moves give the new order. A null text is an empty one; null orders come first.
    """
    side = lambda df, o, t: df.select("doc_id", "seg_id", F.coalesce("ord", F.lit(-1)).cast("long").alias(o), F.coalesce("text", F.lit("")).alias(t))
    old, new = side(before, "from_ord", "old"), side(after, "to_ord", "new")
    both = old.join(new, ["doc_id", "seg_id"], "full_outer")
    text = (
        F.when(F.col("from_ord").isNull(), "NEW").when(F.col("to_ord").isNull(), F.when(F.col("old") != "", "DELETED"))
        .when(F.col("old") == F.col("new"), None).when(F.col("old") == "", "INSERTED").otherwise("CHANGED")
    )
    changed = both.select("doc_id", "seg_id", text.alias("change"), "from_ord", "to_ord").where("change IS NOT NULL")
    shared = old.join(new, ["doc_id", "seg_id"]).select("doc_id", "seg_id", F.col("from_ord").alias("old_ord"), F.col("to_ord").alias("new_ord"))
    places = shared.select("doc_id", "seg_id", F.lit("MOVED").alias("change"), F.col("old_ord").alias("from_ord"), F.col("new_ord").alias("to_ord"))
    return changed.union(places.join(moved_segments(shared), ["doc_id", "seg_id"]))


def deleted_segments(before: DataFrame, after: DataFrame) -> DataFrame:
    return before.join(after, ["doc_id", "seg_id"], "left_anti")


#: Operations of the edit log, each with its inverse.
INVERSES = {"insert": "delete", "delete": "insert", "replace": "replace", "move": "move", "comment_out": "uncomment", "uncomment": "comment_out", "paste": "delete"}


def apply_op(segments: list[tuple[str, str]], op: dict) -> tuple[list[tuple[str, str]], dict | None]:
    """One edit of a list of (id, text): the new list and the inverse edit; None if the target is not there."""
    at = {s[0]: i for i, s in enumerate(segments)}
    kind, target, out = op["op"], op.get("seg"), list(segments)
    if kind in ("insert", "paste"):
        after = op.get("after")
        if after is not None and after not in at:
            return out, None
        out.insert(at[after] + 1 if after is not None else 0, (target, op.get("text", "")))
        return out, {"op": "delete", "seg": target}
    if target not in at:
        return out, None
    i = at[target]
    if kind == "delete":
        text = out.pop(i)[1]
        return out, {"op": "insert", "seg": target, "text": text, "after": segments[i - 1][0] if i else None}
    if kind == "move":
        after = op.get("after")
        if after == target or (after is not None and after not in at):
            return list(segments), None
        moved = out.pop(i)
        spot = next((k + 1 for k, s in enumerate(out) if s[0] == after), 0)
        out.insert(spot, moved)
        return out, {"op": "move", "seg": target, "after": segments[i - 1][0] if i else None}
    text = out[i][1]
    if kind == "replace":
        new = op.get("text", "")
    elif kind == "comment_out":
        new = "\n".join(f"# [off] {line}" for line in text.split("\n"))
    elif kind == "uncomment":
        new = "\n".join(line.removeprefix("# [off] ") for line in text.split("\n"))
    else:
        return out, None
    out[i] = (target, new)
    return out, {"op": "replace", "seg": target, "text": text}


REPLAYED = "path string, content string, n_applied long, n_refused long, restored boolean"


def replay_edits(files: DataFrame, edits: DataFrame) -> DataFrame:
    """Contents after each file's edit log, folded in order, and whether its inverse log gives the start back.

    files(path, segments array<struct<id, text>>), edits(path, edit_id, payload JSON). A log is bounded by its file.
    """
    logs = edits.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("edit_id", "payload"))), lambda x: x["payload"]).alias("log"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, start, log in zip(*(batch.column(c).to_pylist() for c in ("path", "segments", "log")), strict=True):
                now = begin = [(s["id"], s["text"]) for s in start or []]
                undo, refused = [], 0
                for payload in log or []:
                    now, inverse = apply_op(now, json.loads(payload))
                    undo += [inverse] if inverse else []
                    refused += inverse is None
                back = now
                for inverse in reversed(undo):
                    back, _ = apply_op(back, inverse)
                rows.append((path, "\n".join(t for _, t in now), len(undo), refused, back == begin))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(columns, types, strict=True)], names=["path", "content", "n_applied", "n_refused", "restored"])

    return files.join(logs, "path", "left").select("path", "segments", "log").mapInArrow(run, REPLAYED)


def edit_token(location: Column, file_hash: Column) -> Column:
    """Token of an edit: it holds as long as the file's hash is the same."""
    return F.substring(F.sha2(F.concat_ws(":", location, file_hash).cast("binary"), 256), 1, 12)


def stale_tokens(tokens: DataFrame, files: DataFrame) -> DataFrame:
    """``stale``: the file's hash now gives another token. tokens(token, path, location), files(path, hash)."""
    return tokens.join(files, "path", "left").select("token", F.coalesce(F.col("token") != edit_token(F.col("location"), F.col("hash")), F.lit(True)).alias("stale"))


def read_before_write(events: DataFrame) -> DataFrame:
    """``allowed`` of each edit: the address was read since the path's last change. events(event_id, path, address, kind)."""
    path = Window.partitionBy("path").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("path", "address").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    changed = F.max(F.when(F.col("kind") == "edit", F.col("event_id"))).over(path)
    read = F.max(F.when(F.col("kind") == "read", F.col("event_id"))).over(own)
    return events.withColumn("allowed", F.coalesce(read > F.coalesce(changed, F.lit(-1)), F.lit(False))).where("kind = 'edit'").select("event_id", "allowed")


def repeated_failures(calls: DataFrame, times: int = 3) -> DataFrame:
    """Calls at which the same call failed ``times`` times in a row: calls(session, call_id, call, failed)."""
    s = Window.partitionBy("session").orderBy("call_id")
    new = F.when(F.col("failed") & F.lag("failed").over(s).eqNullSafe(F.lit(True)) & F.lag("call").over(s).eqNullSafe(F.col("call")), 0).otherwise(1)
    runs = calls.withColumn("new", new).withColumn("run", F.sum("new").over(s))
    nth = F.row_number().over(Window.partitionBy("session", "run").orderBy("call_id"))
    return runs.withColumn("nth", nth).where(F.col("failed") & (F.col("nth") == times)).select("session", "call_id", "call")


def syntax_level(path: str, language: str | None, text: str) -> tuple[int, str | None]:
    """(level reached, problem): 1 if the text parses, 2 if structured data is also well-formed; 0 with the problem."""
    try:
        if language == "python":
            ast.parse(text)
            return 1, None
        if language == "json" or path.endswith(".json"):
            json.loads(text)
            return 2, None
        if language == "ini" or path.endswith((".ini", ".cfg")):
            configparser.ConfigParser(strict=False, interpolation=None, allow_no_value=True).read_string(text)
            return 2, None
        if language == "yaml" or path.endswith((".yml", ".yaml")):
            import yaml

            yaml.safe_load(text)
            return 2, None
    except ImportError:
        return 1, "not checked: no YAML parser"
    except Exception as problem:  # parsers raise many kinds
        return 0, f"{type(problem).__name__}: {problem}".split("\n")[0]
    return 1, "not checked: no parser"


def syntax_levels(files: DataFrame) -> DataFrame:
    """(file_id, level, problem) of files(file_id, path, language, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [syntax_level(p or "", lang, t or "") for p, lang, t in zip(*(batch.column(c).to_pylist() for c in ("path", "language", "content")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("file_id"), pa.array([f[0] for f in found], type=pa.int32()), pa.array([f[1] for f in found], type=pa.string())], names=["file_id", "level", "problem"])

    return files.select(F.col("file_id").cast("long").alias("file_id"), "path", "language", "content").mapInArrow(run, "file_id long, level int, problem string")


def verified_level(checks: DataFrame) -> DataFrame:
    """Highest level that passed with all below it: checks(file_id, level, passed)."""
    first = checks.groupBy("file_id").agg(F.min(F.when(~F.col("passed"), F.col("level"))).alias("failed"), F.max("level").alias("top"))
    return first.select("file_id", F.coalesce(F.col("failed") - 1, F.col("top")).alias("level"))


def split_problems(problems: DataFrame) -> DataFrame:
    """``outcome``: problems that only say that something could not be checked are no failures."""
    soft = F.col("problem").rlike("(?i)not checked|no database inferred|not implemented|no parser")
    return problems.withColumn("outcome", F.when(soft, "not_checked").otherwise("problem"))


def unknown_imports(imports: DataFrame, packages: DataFrame, standard: DataFrame) -> DataFrame:
    """External imports whose first part is neither an installed package nor in the standard library."""
    top = F.split_part("import_path", F.lit("."), F.lit(1))
    known = packages.select(F.col("name").alias("top")).union(standard.select("name")).distinct()
    return imports.where("is_external").withColumn("top", top).join(known, "top", "left_anti").drop("top")
