"""SQLite files as tables: schemas and rows read in tasks, a table by ranges of its row ids, so one large file is read by many tasks.

Files lie in folders that all machines share (``tree.list_tree`` finds them) and are opened read-only; those that are no databases are
left out, as are tables that a file lacks; columns that a file lacks are null. SQLite types values and not columns: by the declared
type a column is a long, a double, bytes or text; a number in a column of text is its text, any other value of another type is null.
"""

from __future__ import annotations

import os
import re
import sqlite3
from collections.abc import Iterator
from contextlib import closing
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Row ids of a range, ranges of a file at most (wider ones beyond), and rows of a batch.
RANGE_ROWS = 100_000
RANGES_PER_FILE = 10_000
BATCH_ROWS = 10_000

_ARROW = {"long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "string": pa.string()}
_SCHEMA = "path string, table_name string, is_view boolean, position int, column_name string, declared string, type string, not_null boolean, key_position int"


def _local(path: str) -> str:
    return os.path.abspath(re.sub("^file:/+", "/", path))


def _open(path: str) -> sqlite3.Connection:
    found = sqlite3.connect(f"file:{quote(_local(path))}?mode=ro", uri=True)
    found.text_factory = lambda raw: raw.decode("utf-8", "replace")
    return found


def _name(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def spark_type(declared: str) -> str:
    """The type of a column by what its declaration holds, in SQLite's order of affinities."""
    text = declared.upper()
    if "INT" in text:
        return "long"
    if any(x in text for x in ("CHAR", "CLOB", "TEXT")):
        return "string"
    if "BLOB" in text:
        return "binary"
    return "double" if any(x in text for x in ("REAL", "FLOA", "DOUB", "NUM", "DEC")) else "string"


def _value(value, kind: str):
    if kind == "long":
        return value if isinstance(value, int) else None
    if kind == "double":
        return float(value) if isinstance(value, int | float) else None
    if kind == "binary":
        return value if isinstance(value, bytes) else None
    return None if value is None or isinstance(value, bytes) else str(value)


def _columns(database: sqlite3.Connection, table: str) -> list[tuple]:
    """(position, name, declared type, not null, place in the key) of a table or view."""
    return [(n, name, declared or "", bool(strict), key) for n, name, declared, strict, _, key in database.execute(f"PRAGMA table_info({_name(table)})")]


def _row_id(database: sqlite3.Connection, table: str) -> str | None:
    """The name by which a table's row ids are asked for, if it has any that no column hides."""
    own = {c[1].lower() for c in _columns(database, table)}
    for name in ("rowid", "_rowid_", "oid"):
        if name not in own:
            try:
                database.execute(f"SELECT {name} FROM {_name(table)} LIMIT 0")
            except sqlite3.OperationalError:
                return None
            return name
    return None


def _rows(rows: list[tuple], like: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(like)], schema=like)


def sqlite_schema(files: DataFrame) -> DataFrame:
    """A row for each column of each table and view of files(path), SQLite's own left out."""
    like = pa.schema([("path", pa.string()), ("table_name", pa.string()), ("is_view", pa.bool_()), ("position", pa.int32()), ("column_name", pa.string()), ("declared", pa.string()), ("type", pa.string()), ("not_null", pa.bool_()), ("key_position", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    with closing(_open(path)) as database:
                        tables = database.execute("SELECT name, type = 'view' FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite\\_%' ESCAPE '\\' ORDER BY name").fetchall()
                        rows = [(path, t, bool(view), n, c, declared, spark_type(declared), strict, key) for t, view in tables for n, c, declared, strict, key in _columns(database, t)]
                except sqlite3.Error:
                    continue
                yield _rows(rows, like)

    return files.select("path").where("path IS NOT NULL").mapInArrow(run, _SCHEMA)


def _ranges(files: DataFrame, table: str) -> DataFrame:
    """(path, low, high): ranges of row ids; one without bounds where a table has no row ids, or for a view."""
    like = pa.schema([("path", pa.string()), ("low", pa.int64()), ("high", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    with closing(_open(path)) as database:
                        found = database.execute("SELECT type FROM sqlite_master WHERE name = ? COLLATE NOCASE AND type IN ('table', 'view')", (table,)).fetchone()
                        if found is None:
                            continue
                        key, rows = _row_id(database, table) if found[0] == "table" else None, [(path, None, None)]
                        if key is not None:
                            low, high = database.execute(f"SELECT (SELECT min({key}) FROM {_name(table)}), (SELECT max({key}) FROM {_name(table)})").fetchone()
                            width = max(RANGE_ROWS, -(-(high - low + 1) // RANGES_PER_FILE)) if low is not None else 1
                            rows = [(path, a, min(a + width - 1, high)) for a in range(low, high + 1, width)] if low is not None else []
                except sqlite3.Error:
                    continue
                if rows:
                    yield _rows(rows, like)

    return files.select("path").where("path IS NOT NULL").mapInArrow(run, "path string, low long, high long")


def read_sqlite(files: DataFrame, table: str, columns: dict[str, str] | None = None) -> DataFrame:
    """Rows of ``table`` in files(path), with the path of each; only ``columns`` (name to long, double, binary or string) are read.

    Without ``columns``: those of all files, a column with differing types as text.
    """
    if columns is None:
        known = sqlite_schema(files).where(F.lower("table_name") == table.lower()).groupBy("column_name")
        found = known.agg(F.min("position").alias("n"), F.when(F.count_distinct("type") == 1, F.min("type")).otherwise("string").alias("type"))
        columns = {r.column_name: r.type for r in found.orderBy("n", "column_name").collect()}  # as many rows as a table has columns
    if "path" in columns:
        raise ValueError("a column is called path: name the columns to read, without it")
    like = pa.schema([("path", pa.string()), *((c, _ARROW[t]) for c, t in columns.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, low, high in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with closing(_open(path)) as database:
                    own = {c[1] for c in _columns(database, table)}
                    wanted = ", ".join(_name(c) if c in own else "NULL" for c in columns) or "NULL"
                    cursor = database.execute(f"SELECT {wanted} FROM {_name(table)}" + (f" WHERE {_row_id(database, table)} BETWEEN ? AND ?" if low is not None else ""), (low, high) if low is not None else ())
                    while rows := cursor.fetchmany(BATCH_ROWS):
                        yield _rows([(path, *(_value(v, t) for v, t in zip(r, columns.values(), strict=False))) for r in rows], like)

    cores = files.sparkSession.sparkContext.defaultParallelism
    ranges = _ranges(files, table)
    return ranges.repartition(4 * cores, "path", "low").mapInArrow(run, ", ".join(["path string", *(f"`{c}` {t}" for c, t in columns.items())]))


def write_sqlite(rows: DataFrame, folder: str, table: str) -> DataFrame:
    """``rows`` (of longs, doubles, bytes and text) as a SQLite file for each partition below a shared folder: (path, n_rows).

    A file gets its name when it is complete, the same in each attempt at its partition.
    """
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    declared = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "binary": "BLOB", "string": "TEXT"}
    create = f"CREATE TABLE {_name(table)} ({', '.join(f'{_name(c)} {declared[t]}' for c, t in types.items())})"
    insert = f"INSERT INTO {_name(table)} VALUES ({', '.join('?' * len(types))})"
    top = _local(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, n = TaskContext.get(), 0
        os.makedirs(top, exist_ok=True)
        path = f"{top}/part-{task.partitionId():06d}.db"
        draft = f"{path}.{task.taskAttemptId()}"
        with closing(sqlite3.connect(draft, isolation_level=None)) as database:
            database.execute("PRAGMA journal_mode = OFF")
            database.execute("PRAGMA synchronous = OFF")
            database.execute("BEGIN")
            database.execute(create)
            for batch in batches:
                database.executemany(insert, zip(*(c.to_pylist() for c in batch.columns), strict=True))
                n += batch.num_rows
            database.execute("COMMIT")
        os.replace(draft, path)
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], names=["path", "n_rows"])

    return rows.mapInArrow(run, "path string, n_rows long")
