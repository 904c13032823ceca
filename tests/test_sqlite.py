"""SQLite files read in tasks against what SQLite itself answers."""

import sqlite3
from contextlib import closing

import pytest
from pyspark.sql import functions as F

from loomstone.sources import sqlite
from loomstone.sources.tree import list_tree


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("databases")
    (root / "with space #1").mkdir()
    scripts = {
        "a.db": """CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT NOT NULL, price REAL, raw BLOB, any_);
            INSERT INTO t VALUES (-5, 'é', 1.5, x'00ff', 3), (7, '', NULL, NULL, 'x'), (900000, 12, 'no', 'text', x'01');
            CREATE VIEW v AS SELECT name AS n FROM t; CREATE TABLE none (x INT); CREATE INDEX i ON t (name);""",
        "with space #1/b.db": """CREATE TABLE t (name VARCHAR(9), id BIGINT); INSERT INTO t VALUES ('only', 1), ('wide', 5000000000), (NULL, 'word');
            CREATE TABLE w (k TEXT PRIMARY KEY, n INT) WITHOUT ROWID; INSERT INTO w VALUES ('a', 1), ('b', 2);
            CREATE TABLE "odd ""name" (rowid TEXT, oid INT); INSERT INTO "odd ""name" VALUES ('z', 4), ('y', 5);""",
        "empty.db": "",
    }
    for path, script in scripts.items():
        with closing(sqlite3.connect(root / path)) as database:
            database.executescript(script)
    (root / "no.db").write_text("this is no database, only some text " * 100)
    return root


def files(spark, folder):
    return list_tree(spark, str(folder)).select(F.concat(F.lit(f"{folder}/"), "path").alias("path"))


def test_schemas(spark, folder):
    rows = sqlite.sqlite_schema(files(spark, folder)).collect()
    found = {(r.path.rsplit("/", 1)[1], r.table_name, r.column_name): (r.type, r.declared, r.is_view, r.not_null, r.key_position) for r in rows}
    assert len(found) == len(rows) == 5 + 1 + 1 + 2 + 2 + 2
    assert found["a.db", "t", "id"] == ("long", "INTEGER", False, False, 1) and found["a.db", "t", "name"] == ("string", "TEXT", False, True, 0)
    assert found["a.db", "v", "n"][:3] == ("string", "TEXT", True) and found["b.db", "t", "name"][0] == "string" and found["a.db", "t", "any_"][:2] == ("string", "")


def test_rows(spark, folder, monkeypatch):
    rows = lambda table, columns=None: sorted((tuple(r)[1:] for r in sqlite.read_sqlite(files(spark, folder), table, columns).collect()), key=str)
    typed = {"id": "long", "name": "string", "price": "double", "raw": "binary", "any_": "string"}
    every = [(-5, "é", 1.5, bytearray(b"\x00\xff"), "3"), (7, "", None, None, "x"), (900000, "12", None, None, None), (1, "only", None, None, None), (5000000000, "wide", None, None, None), (None, None, None, None, None)]
    assert rows("t", typed) == sorted(every, key=str) and rows("T", {"id": "long"}) == sorted(((r[0],) for r in every), key=str)
    inferred = sqlite.read_sqlite(files(spark, folder), "t")
    assert {f.name: f.dataType.simpleString() for f in inferred.schema} == {"path": "string", "id": "bigint", "name": "string", "price": "double", "raw": "binary", "any_": "string"} and inferred.count() == 6
    assert rows("v") == [("",), ("12",), ("é",)] and rows("w") == [("a", 1), ("b", 2)] and rows('odd "name') == [("y", 5), ("z", 4)]
    assert rows("none") == [] and rows("unknown", {"x": "long"}) == []
    monkeypatch.setattr(sqlite, "RANGE_ROWS", 2)
    assert rows("t", typed) == sorted(every, key=str)


def test_round_trip(spark, tmp_path):
    rows = spark.range(0, 1000, 1, 3).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("n'"), "id")).alias('a "b'), (F.col("id") / 7).alias("f"), F.col("id").cast("string").cast("binary").alias("raw"))
    written = sqlite.write_sqlite(rows, f"file://{tmp_path}/out", "t").collect()
    assert [r.n_rows for r in written] == [333, 333, 334] and len(list((tmp_path / "out").iterdir())) == 3
    back = sqlite.read_sqlite(spark.createDataFrame(written), "t").drop("path")
    assert back.exceptAll(rows).isEmpty() and back.count() == 1000
    assert sqlite.read_sqlite(sqlite.write_sqlite(rows.limit(0), f"{tmp_path}/none", "t"), "t", {"id": "long"}).count() == 0
