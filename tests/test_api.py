import pytest
from pyspark.sql import functions as F

from loomstone import api

TREE = {
    "app.py": 'import sqlite3\nfrom lib import util\nimport requests\n\ndef main():\n    con = sqlite3.connect("a.db")\n    con.execute("SELECT 1")\n    con.execute("INSERT INTO t VALUES (1)")\n    return util.go("http://svc.local:8080")\n',
    "lib/__init__.py": "",
    "lib/util.py": "from . import gone\n\nclass U:\n    def go(self):\n        pass\n",
    "web/index.js": "import { x } from './x';\nimport y from './nothing.js';\nconst db = new Database('w.db');\ndb.exec('DELETE FROM t');\napp.listen(3000);\nfor (const f of readdirSync('./plugins')) if (f.endsWith('.js')) await import(f);\n",
    "web/x.js": "import i from './index.js';\nexport function x() {}\n",
    "web/plugins/p.js": "export const p = () => 1;\n",
    "node_modules/a/b.js": "function ignored() {}\n",
    "etc/conf.d/site.conf": "server {\n listen 80;\n location / { proxy_pass http://127.0.0.1:3000; }\n}\n",
    "notes.md": "# Title\ntext\n",
    "x.unknown": "?",
}


@pytest.fixture(scope="module")
def catalog(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, content in TREE.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(content)
    return api.scan_folder(spark, str(root))


def ids(catalog):
    return {r.path: r.file_id for r in catalog.files.select("path", "file_id").collect()}


def test_scan(catalog):
    assert set(ids(catalog)) == set(TREE) - {"node_modules/a/b.js", "x.unknown"}
    addresses = {r.path: r.address for r in catalog.files.select("path", "address").collect()}
    assert addresses["app.py"] == "d" and addresses["lib/util.py"] == "b.b" and addresses["web/plugins/p.js"] == "c.a.a" and addresses["notes.md"] == "e"
    by = ids(catalog)
    names = {v: k for k, v in by.items()}
    found = {(names[r.file_id], r.import_path): (names.get(r.resolved_file_id), r.is_external) for r in catalog.imports.collect()}
    assert found["web/index.js", "./x"] == ("web/x.js", False) and found["web/index.js", "./nothing.js"] == (None, False)
    assert found["app.py", "requests"] == (None, True) and found["app.py", "lib"] == ("lib/__init__.py", False)
    assert found["web/index.js", "(load)"] == ("web/plugins/p.js", False)
    assert [r.import_path for r in catalog.missing().collect() if names[r.file_id] == "web/index.js"] == ["./nothing.js"]


def test_questions(catalog):
    by = ids(catalog)
    linked = catalog.connections(by["app.py"])
    assert [(r.name, r.direction, r.n_queries) for r in linked["databases"].collect()] == [("a.db", "both", 2)]
    assert {(r.kind, r.locator) for r in linked["endpoints"].collect()} == {("server", "svc.local:8080"), ("binary", "sqlite3")}
    assert {r.from_file_id for r in catalog.connections(by["web/x.js"])["incoming"].collect()} == {by["web/index.js"]}
    ends = {(r.hop, r.terminus) for r in catalog.ping(by["web/index.js"]).collect()}
    assert (1, "follow") in ends and (2, "cycle") in ends and (1, "unresolved") in ends and (2, "leaf") in ends
    ends = [r.hops for r in catalog.routes(by["web/index.js"]).collect()]
    assert ends == sorted(ends) and len(ends) >= 3
    found, root = catalog.register(by["web/index.js"])
    assert {r.path for r in found.collect()} == {"web/index.js", "web/x.js", "web/plugins/p.js"} and root.first()[0] == "web"
    assert catalog.crawl(by["web/x.js"]).count() == 3
    nodes, edges = catalog.topology()
    assert ("external", "port:3000") in {(r.kind, r.id) for r in nodes.collect()} and edges.where("kind = 'db_connection'").count() == 2
    assert {r.name for r in catalog.data_flow().collect()} >= {"app.py", "site.conf"}
    assert [r.name for r in catalog.bones("util.py").where("fact = 'method'").collect()] == ["go"]
    assert {r.declared for r in catalog.full_skeleton().where("path = 'lib/util.py'").collect()} == {"U", "go"}
    with pytest.raises(IsADirectoryError):
        catalog.navigate("b")
    assert catalog.data_flow(by["web/index.js"]).count() >= 3 and catalog.navigate("d", "d.4").count() == 2
    assert [r.source for r in catalog.navigate("d.4").collect()] and "def main" in catalog.navigate("d.4").first().source
    assert {r.line for r in catalog.search("LISTEN").collect()} == {2, 5}
    assert [r.path for r in catalog.structure("plugins").collect()] == ["web", "web/plugins", "web/plugins/p.js"]
    assert catalog.stats().count() == 6 and catalog.estimate().count() >= 3 and catalog.overview().count() >= 3 and catalog.languages().count() > 20


def test_refresh_and_what_if(spark, catalog):
    tree = catalog.files.select("path", "content")
    later = catalog.refresh(tree.where("path <> 'web/x.js'").withColumn("content", F.when(F.col("path") == "app.py", "def other(): pass\n").otherwise(F.col("content"))))
    assert {r.name for r in later.facts.where("fact = 'module'").collect()} == {"other", "U", "p", "server"} | {r.name for r in later.facts.where("fact = 'module'").collect() if r.name not in ("x", "main")}
    assert later.missing().where("import_path = './x'").count() == 1
    unsaved = spark.createDataFrame([("web/nothing.js", "export class N {}")], "path string, content string")
    assert catalog.what_if(unsaved).missing().where("import_path = './nothing.js'").count() == 0
    assert catalog.missing().where("import_path = './nothing.js'").count() == 1


def test_pages(spark):
    rows = [(1, "https://a.org", "<h1>Hi</h1><p>some words here</p>"), (2, "http://a.org", "<p>refused</p>")]
    pages = api.Pages(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r.page_id for r in pages.elements.collect()} == {1}
    assert [r.element_id for r in pages.search("some words").collect()] == ["e2"]
    assert pages.read("e1").first().text == "Hi" and "Hi" in pages.skeleton().first().skeleton


@pytest.fixture(scope="module")
def workspace(spark):
    projects = spark.createDataFrame([(1, "shop", "/srv/shop"), (2, "lib", "/srv/shop/lib")], "project_id long, name string, root string")
    files = spark.createDataFrame([(10, "/srv/shop/a.py", 1), (11, "/srv/shop/lib/b.py", None), (12, "/tmp/x.py", None)], "file_id long, abs_path string, project_id long")
    return api.Workspace(projects, files)


def test_projects_and_targets(spark, workspace):
    paths = spark.createDataFrame([("/srv/shop/a.py",), ("/srv/shop/lib/b.py",), ("/srv/shop/lib/new.py",), ("/else",)], "path string")
    assert {r.path: r.project_id for r in workspace.project_for(paths).collect()} == {"/srv/shop/a.py": 1, "/srv/shop/lib/b.py": 2, "/srv/shop/lib/new.py": 2, "/else": None}
    assert {(r.name, r.n_files) for r in workspace.project_list().collect()} == {("shop", 1), ("lib", 0), ("unknown", 2)}
    meant = lambda what: sorted((r.kind, r.project_id) for r in workspace.target(what).collect())
    assert meant("lib") == meant("/srv/shop/lib/") == [("project", 2)] and meant("/tmp/x.py") == [("file", None)]
    assert meant("/tmp") == [("folder", None)] and meant("/nowhere") == [("unscanned", None)]
    links = spark.createDataFrame([(12, 1)], "file_id long, project_id long")
    assert {r.file_id: (r.placement, r.project_id) for r in workspace.membership(links).collect()} == {10: ("existing", 1), 11: ("root_match", 2), 12: ("linked", 1)}
    added = workspace.associate(spark.createDataFrame([("/tmp/x.py",), ("/tmp/y.py",)], "path string"), 1)
    assert {r.abs_path: r.project_id for r in added.collect()} == {"/srv/shop/a.py": 1, "/srv/shop/lib/b.py": None, "/tmp/x.py": 1, "/tmp/y.py": 1}
    asked = spark.createDataFrame([("/srv/shop/a.py", 1), ("/srv/n.py", 9), ("/srv/n.py", None), ("/srv/ok.py", 2)], "path string, project_id long")
    assert sorted(str(r.refused) for r in workspace.write_refusals(asked).collect()) == ["None", "file exists", "project missing", "project unknown"]


def test_edits_by_log(spark):
    files = spark.createDataFrame([("a", [("1", "one"), ("2", "two")]), ("b", [("1", "x")])], "path string, segments array<struct<id:string,text:string>>")
    log = [("a", 1, '{"op": "replace", "seg": "1", "text": "uno"}'), ("a", 2, '{"op": "delete", "seg": "2"}'), ("a", 3, '{"op": "delete", "seg": "gone"}')]
    editor = api.Editor(files, spark.createDataFrame(log, "path string, edit_id long, payload string"))
    contents = lambda e: {r.path: r.content for r in e.apply().collect()}
    assert contents(editor) == {"a": "uno", "b": "x"} and contents(editor.undo(2)) == {"a": "uno\ntwo", "b": "x"} and contents(editor.discard()) == {"a": "one\ntwo", "b": "x"}
    assert {(r.path, r.status, r.n_edits) for r in editor.status().collect()} == {("a", "edited", 3), ("b", "committed", 0)}
    assert [(r.path, r.lines_before, r.lines_after) for r in editor.diff().collect()] == [("a", 2, 1)]
    tokens = editor.tokens(spark.createDataFrame([("a", "1"), ("b", "1")], "path string, location string")).cache()
    assert {r.stale for r in editor.stale(tokens.where("path = 'a'")).collect()} == {True} and {r.stale for r in editor.stale(tokens.where("path = 'b'")).collect()} == {False}
    assert contents(editor.commit()) == {"a": "uno", "b": "x"} and editor.commit().status().where("n_edits > 0").count() == 0


def test_router_status(spark):
    rows = spark.createDataFrame([("big@10", 5, 100), ("big@50", 7, 100), ("small@0", 3, 20), ("413", 9, 1)], "served string, tokens long, seconds long")
    assert {(r.backend, r.active, r.tokens) for r in api.router_status(rows, 60).collect()} == {("big", 2, 12), ("small", 0, 0)}


def test_search_by_meaning_comes_between_word_and_any_word(spark):
    pages = spark.createDataFrame([(1, "https://x.org/", "<body><p>the feline sat</p>" + "".join(f"<p>item number {i} here</p>" for i in range(12)))], "page_id long, url string, html string")
    vector = lambda rows: rows.select("*", F.when(F.col("text").contains("feline") | F.col("text").contains("cat"), F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))).alias("vector"))
    assert [(r.element_id, r.rung) for r in api.Pages(pages, embed=vector).search("cat nowhere").collect()] == [("e1", "meaning")]
    assert api.Pages(pages).search("cat nowhere").collect() == []
    assert {r.rung for r in api.Pages(pages, embed=vector).search("feline").collect()} == {"word"}
