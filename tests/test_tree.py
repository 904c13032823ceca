"""Listing of trees in tasks, and import graphs after changes, against what the plainest way gives."""

import os

import pytest
from pyspark.sql import functions as F

from loomstone import api
from loomstone.operators import facts
from loomstone.sources.tree import list_tree, with_content

FILES = {
    "a.py": b"x = 1\n", "_private.py": b"y = 2\n", ".hidden": b"h", "empty.txt": b"", "deep/er/_/..x/a b+%20#.txt": "äö".encode(), "deep/bytes.bin": b"\xff\xfe\x00",
    "node_modules/m/index.js": b"no", "my.egg-info/top.py": b"no", "wide/" + "n" * 200: b"long name",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    for path, content in FILES.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(content)
    (root / "none").mkdir()
    os.symlink(root, root / "deep" / "loop")
    os.symlink(root / "a.py", root / "link.py")
    return root


def test_every_file_is_listed_once(spark, tree):
    for path in (str(tree), f"{tree}/", f"file://{tree}", f"file:{tree}"):
        rows = list_tree(spark, path).collect()
        assert {r.path: r.size for r in rows} == {p: len(c) for p, c in FILES.items()} and len(rows) == len(FILES)
    assert abs(rows[0].modified.timestamp() - (tree / rows[0].path).stat().st_mtime) < 1
    assert list_tree(spark, str(tree / "none")).count() == 0
    with pytest.raises(FileNotFoundError):
        list_tree(spark, str(tree / "nowhere"))


def test_contents(spark, tree):
    listed = list_tree(spark, str(tree))
    assert {r.path: bytes(r.content) for r in with_content(listed, str(tree), text_only=False).collect()} == FILES
    texts = {r.path: r.content for r in with_content(listed.withColumn("more", F.lit(1)), str(tree)).collect()}
    assert texts["deep/bytes.bin"] is None and texts["empty.txt"] == "" and texts["deep/er/_/..x/a b+%20#.txt"] == "äö" and len(texts) == len(FILES)
    gone = listed.unionByName(listed.limit(1).withColumn("path", F.lit("not/there")))
    assert with_content(gone, str(tree)).count() == len(FILES)
    assert with_content(listed.limit(0), str(tree)).count() == 0


def test_a_scan_opens_only_what_it_reads(spark, tree):
    assert {r.path for r in list_tree(spark, str(tree), facts.entered).collect()} == {p for p in FILES if "node_modules" not in p and "egg-info" not in p}
    assert {r.path for r in facts.scan_tree(spark, str(tree)).collect()} == {"a.py", "_private.py", "empty.txt", "deep/er/_/..x/a b+%20#.txt"}


BEFORE = {"lib/a.py": "import lib.b\nimport os\nimport tool\nfrom . import c\n", "lib/b.py": "from lib import a\n", "web/x.js": "import './y';\nimport './z.js';\n", "web/z.js": "", "h/u.h": "int a;\n", "h/m.c": '#include "./u.h"\n#include "./v.h"\n'}
AFTER = {"lib/a.py": BEFORE["lib/a.py"], "lib/c.py": "", "lib/b/__init__.py": "", "tool.py": "import lib.b\n", "web/x.js": "import './y';\n\nimport './z.js';\n", "web/y/index.js": "import '../x.js';\n", "h/u.h": "class A { public: int a; };\n", "h/m.c": BEFORE["h/m.c"], "h/v.h": ""}


@pytest.mark.parametrize(("first", "then"), [(BEFORE, AFTER), (AFTER, BEFORE), (BEFORE, BEFORE)])
def test_a_refreshed_import_graph_is_that_of_a_scan(spark, first, then):
    rows = lambda tree: spark.createDataFrame(list(tree.items()), "path string, content string")
    links = lambda c: sorted(map(str, c.imports.collect()))
    scanned, refreshed = api.scan(spark, rows(then)), api.scan(spark, rows(first)).refresh(rows(then))
    assert links(scanned) == links(refreshed)
    assert sorted(map(str, scanned.candidates.collect())) == sorted(map(str, refreshed.candidates.collect()))


def test_only_what_may_have_changed_is_resolved_again(spark):
    imports = spark.createDataFrame([(1, "/r/a.js", "/r", "javascript", "./b.js"), (2, "/r/a.js", "/r", "javascript", "./c.js"), (3, "/r/p.py", "/r", "python", "pkg.x"), (4, "/r/p.py", "/r", "python", "os")], "import_id long, file_path string, root string, language string, import_path string")
    files = lambda *paths: spark.createDataFrame([(len(p) * 100 + ord(p[3]), p, "/r") for p in paths], "file_id long, path string, root string")
    before, after = files("/r/a.js", "/r/b.js", "/r/p.py"), files("/r/a.js", "/r/b.js", "/r/c.js", "/r/p.py", "/r/pkg/y.py")
    # Outcomes that are marked: what is not resolved again keeps its mark.
    marked = facts.resolve_imports(imports, before).withColumn("resolved_file_id", F.lit(-1).cast("long")).where("import_id <> 4").unionByName(spark.createDataFrame([(9, "gone", None, True)], "import_id long, import_path string, resolved_file_id long, is_external boolean"))
    out = {r.import_id: (r.resolved_file_id, r.is_external) for r in facts.relink_imports(imports, marked, facts.import_candidates(imports), before, after).collect()}
    assert out == {1: (-1, False), 2: (len("/r/c.js") * 100 + ord("c"), False), 3: (None, False), 4: (None, True)}
