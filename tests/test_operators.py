"""Rules and replays that SQL oracles do not cover, and every query on the smallest tables."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomstone import registry
from loomstone.functions import net, text
from loomstone.operators import accounting, changes, facts, graph, html, retrieval, validate
from loomstone.plans.fixtures import graph as fixture_graph

PASS = "https://example.com https://claude.ai/chat http://localhost:3000 http://127.0.0.1:8080 http://[::1]:5000 http://0.0.0.0:4000 http://192.168.1.100:3000 http://10.0.0.5:8080 http://172.16.0.1:9090 http://172.31.255.255 http://169.254.1.1".split()
FAIL = ["http://example.com", "http://8.8.8.8", "http://172.32.0.1", "http://172.15.0.1", "file:///etc/passwd", "file:///tank/projects/mcp-servers/.oauth_tokens.json", "chrome://settings", "javascript:alert(1)", "data:text/html,<h1>hi</h1>", "ftp://files.example.com", "not a url"]


def test_url_rule(spark):
    df = spark.createDataFrame([(u,) for u in PASS + FAIL], "u string")
    got = [r[0] for r in df.select(F.coalesce(net.url_allowed(F.col("u")), F.lit(False))).collect()]
    assert got == [True] * len(PASS) + [False] * len(FAIL)
    public = {r[0]: r[1] for r in df.select("u", F.coalesce(net.url_allowed(F.col("u"), True), F.lit(False))).collect()}
    assert public["http://example.com"] and not public["http://localhost:3000"] and public["https://example.com"]


def test_letters_and_text(spark):
    names = [r[0] for r in spark.range(20_000).select(text.letters(F.col("id"))).collect()]
    assert names[:3] == ["a", "b", "c"] and names[25:28] == ["z", "aa", "ab"] and names[701:703] == ["zz", "aaa"] and len(set(names)) == 20_000
    back = spark.range(20_000).select((text.letter_index(text.letters(F.col("id"))) == F.col("id")).alias("ok"))
    assert back.where("NOT ok").count() == 0
    row = spark.createDataFrame([("a/b/c.TXT", "x\n\n\n y \n", "installations")], "p string, t string, w string").select(
        text.basename(F.col("p")), text.dirname(F.col("p")), text.extension(F.col("p")), text.line_count(F.col("t")), text.word_root(F.col("w")), text.line_of(F.col("t"), F.lit(5)), text.ellipsis(F.lit("abcdef"), 5), text.fold_blank_lines(F.col("t"))
    ).first()
    assert tuple(row) == ("c.TXT", "a/b", ".txt", 5, "install", 4, "ab...", "x\n\n y")


def edges(rows):
    """(import_id, file, target or None, external) -> imports with lines in order."""
    return [(i, f, f"p{i}", t, e, i) for i, f, t, e in rows]


SCHEMA = "import_id long, file_id long, import_path string, resolved_file_id long, is_external boolean, line int"


def brute_trace(imports, start, most):
    """The trace as a queue, edge by edge."""
    seen, queue, out = {start}, [(start, 0)], []
    while queue:
        node, hop = queue.pop(0)
        if hop >= most:
            continue
        own = sorted((x for x in imports if x[1] == node), key=lambda x: (x[5], x[0]))
        if not own:
            out.append((hop + 1, node, None, "leaf"))
        for _, _, _, target, external, _ in own:
            if external:
                end = "external"
            elif target is None:
                end = "unresolved"
            elif target in seen:
                end = "cycle"
            else:
                end = "follow"
                seen.add(target)
                queue.append((target, hop + 1))
            out.append((hop + 1, node, target, end))
    return sorted(out, key=str)


CHAIN = edges([(i, i, i + 1, False) for i in range(1, 27)])
GRAPHS = {
    "diamond": edges([(1, 1, 2, False), (2, 1, 3, False), (3, 2, 4, False), (4, 3, 4, False)]),
    "cycle": edges([(1, 1, 2, False), (2, 2, 1, False), (3, 2, None, False), (4, 2, None, True)]),
    "self": edges([(1, 1, 1, False)]),
    "chain": CHAIN,
}


def test_traces_match_the_queue(spark):
    rng = random.Random(2)
    cases = dict(GRAPHS)
    for seed in range(2):
        cases[f"random{seed}"] = [(i, rng.randrange(1, 12), f"p{i}", rng.choice([None, *range(1, 12)]), rng.random() < 0.1, rng.randrange(4)) for i in range(26)]
    for name, rows in cases.items():
        imports = spark.createDataFrame(rows, SCHEMA)
        starts = spark.createDataFrame([(1,)], "start_id long")
        most = 25 if name == "chain" else 5
        got = graph.trace(imports.select("file_id").distinct(), imports, starts, most)
        assert sorted(((r.hop, r.from_id, r.to_id, r.terminus) for r in got.collect()), key=str) == brute_trace(rows, 1, most), name


def test_counts_of_traces_match_the_queue_for_more_starts_than_a_set(spark):
    linked = [(i, i, i % 75 + 1 if i % 7 else None, i % 14 == 0) for i in range(1, 75)] + [(200 + i, i, i // 2, False) for i in range(2, 75, 3)]
    rows = edges(linked)
    starts = [*range(1, 76), 99]
    want = Counter((s, hop, end) for s in starts for hop, _, _, end in brute_trace(rows, s, 4))
    got = graph.trace_counts(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(s,) for s in starts], "start_id long"), 4)
    assert {(r.start_id, r.hop, r.terminus): r.n for r in got.collect()} == want


@pytest.mark.parametrize("name", ["trace_hops", "discover_files"])
def test_traces_and_discoveries_start_from_every_file(spark, name):
    found = registry.queries()[name](spark, "/root/testdata/sf0.001")
    files = fixture_graph(spark, "/root/testdata/sf0.001")["files"]
    assert found.select("start_id").distinct().count() == files.count()


def test_self_imports_and_other_projects_disqualify_entries(spark):
    files = spark.createDataFrame([(1, 1, True), (2, 1, True), (3, 2, True), (4, 1, False)], "file_id long, project_id long, is_readable_text boolean")
    imports = spark.createDataFrame(edges([(1, 1, 1, False), (2, 3, 2, False)]), SCHEMA)
    assert [r.file_id for r in graph.entry_files(files, imports).collect()] == [3]


def folded(events, keys, fold):
    out = {}
    for key in {tuple(e[k] for k in keys) for e in events}:
        own = sorted((e for e in events if tuple(e[k] for k in keys) == key), key=lambda e: (e["t"], e["id"]))
        for e, o in zip(own, fold(own), strict=True):
            out[e["id"]] = o
    return out


def test_rate_limit_and_cache_match_simple_folds(spark):
    rng = random.Random(4)
    events = [{"key": rng.randrange(3), "t": rng.randrange(900), "id": i, "url": rng.choice("abcdef"), "slot": rng.randrange(2)} for i in range(300)]

    def limit(own):
        admitted = []
        for e in own:
            if sum(e["t"] - 300 < t for t in admitted) < 3:
                admitted.append(e["t"])
                yield "admitted"
            else:
                yield "refused"

    rows = spark.createDataFrame([(e["key"], e["t"], e["id"]) for e in events], "key long, t long, call_id long")
    got = {r.call_id: r.outcome for r in accounting.rate_limit(rows).collect()}
    assert got == folded(events, ["key"], limit)

    def cache(own):
        known = []
        for e in own:
            old = next((k for k in known if k[0] == e["url"]), None)
            known = [k for k in known if k[0] != e["url"]]
            fresh = old is not None and e["t"] - old[1] < 300
            known.append((e["url"], old[1] if fresh else e["t"]))
            known = known[-3:]
            yield "hit" if fresh else "expired" if old else "miss"

    rows = spark.createDataFrame([(e["slot"], e["t"], e["url"], e["id"]) for e in events], "slot long, t long, url string, id long")
    order = lambda own: sorted(own, key=lambda e: (e["t"], e["url"], e["id"]))
    want = {}
    for slot in (0, 1):
        own = order([e for e in events if e["slot"] == slot])
        want |= {e["id"]: o for e, o in zip(own, cache(own), strict=True)}
    assert {r.id: r.outcome for r in accounting.page_cache(rows, 3).collect()} == want


def test_slots_routes_and_locks(spark):
    q = spark.createDataFrame([("p", 0, 10, 1), ("p", 1, 10, 2), ("p", 2, 5, 3), ("p", 30, 1, 4)], "pool string, t long, seconds long, id long")
    assert [r.started for r in accounting.slot_queue(q, 2).orderBy("id").collect()] == [0, 1, 10, 30]
    r = spark.createDataFrame([(0, 0, 400, 100, 1), (0, 1, 400, 100, 2), (0, 2, 400, 10, 3), (0, 3, 2000, 1, 4)], "router long, t long, tokens long, seconds long, id long")
    assert [x.served for x in accounting.route_requests(r, [("a", 1, 500), ("b", 2, 1000)]).orderBy("id").collect()] == ["a@0", "b@1", "b@2", "413"]
    locks = spark.createDataFrame([(1, 0, 50), (1, 10, 60), (1, 50, 70), (2, 5, None), (2, 604, None), (2, 605, None)], "user_id long, t long, ended long")
    assert [x.outcome for x in accounting.scan_locks(locks).orderBy("user_id", "t").collect()] == ["STARTED", "BLOCKED", "STARTED", "STARTED", "BLOCKED", "STARTED"]


def test_edits_and_their_inverses():
    rng = random.Random(6)
    for _ in range(200):
        start = now = [(f"s{i}", f"t{i}\nx") for i in range(rng.randrange(4))]
        undo = []
        for n in range(8):
            ids = [s[0] for s in now] + ["none"]
            op = {"op": rng.choice(sorted(changes.INVERSES)), "seg": rng.choice(ids), "text": f"n{n}", "after": rng.choice([None, *ids])}
            if op["op"] in ("insert", "paste"):
                op["seg"] = f"new{n}"
            now, inverse = changes.apply_op(now, op)
            undo += [inverse] if inverse else []
        for inverse in reversed(undo):
            now, _ = changes.apply_op(now, inverse)
        assert now == start


def test_segment_changes(spark):
    schema = "doc_id long, seg_id string, ord int, text string"
    before = spark.createDataFrame([(1, s, i, t) for i, (s, t) in enumerate(zip("abcde", ["x", "x", "x", "", None], strict=True))], schema)
    after = spark.createDataFrame([(1, s, i, t) for i, (s, t) in enumerate(zip("cabdz", ["y", "x", "x", "now", ""], strict=True))], schema)
    got = {(r.seg_id, r.change, r.from_ord, r.to_ord) for r in changes.segment_diff(before, after).collect()}
    # The last one in front is one move; it is changed as well. An empty segment that goes is no deletion.
    assert got == {("c", "MOVED", 2, 0), ("c", "CHANGED", 2, 0), ("d", "INSERTED", 3, 3), ("z", "NEW", None, 4)}


def test_fewest_moves(spark):
    rng, rows = random.Random(8), {}
    for doc in range(40):
        ids = list(range(rng.choice([0, 1, 2, 7, 9])))
        rows[doc] = (ids, rng.sample(ids, len(ids)) if doc % 4 else ids)
    rows[99] = (list(range(20_000)), [19_999, *range(19_999)])
    schema = "doc_id long, seg_id long, ord long, text string"
    table = lambda k: spark.createDataFrame([(d, s, i, "t") for d, r in rows.items() for i, s in enumerate(r[k])], schema).repartition(3)
    moved = {}
    for r in changes.segment_diff(table(0), table(1)).collect():
        assert r.change == "MOVED"
        moved.setdefault(r.doc_id, set()).add(r.seg_id)
    assert moved.pop(99) == {19_999}
    for doc, (ids, order) in rows.items():
        if doc == 99:
            continue
        rest = [s for s in order if s not in moved.get(doc, set())]
        assert rest == sorted(rest)
        best = max(len(c) for n in range(1 << len(ids)) if (c := [s for i, s in enumerate(order) if n >> i & 1]) == sorted(c))
        assert len(rest) == best


PAGE = """<html><head><title> My  page </title><style>p{}</style></head><body>
<nav><ul><li><a href="/a">One</a><li><a href="#x">Two</a></ul></nav>
<div id="main"><h1>Head &amp; tail</h1><p>First para<p>Second <b>bold</b> para<script>var s = "</p>";</script>
<pre class="language-python">def f():
  pass</pre><table><tr><th>A<th>B<tr><td>1<td>2</table><div><p>inner</div></div><img alt="pic"><button>Go</button>
<footer><p>end</p></footer></body></html>"""


def test_page_elements():
    title, rows = html.elements_of(PAGE)
    assert title == "My page"
    shown = [(r[2], r[3], r[4]) for r in rows]
    assert shown[:6] == [("navigation", 0, ""), ("list", 1, ""), ("item", 2, "One"), ("link", 3, "One"), ("item", 2, "Two"), ("link", 3, "Two")]
    assert ("region", 0, "") in shown and ("heading", 1, "Head & tail") in shown and ("code", 1, "python") in shown and ("image", 0, "pic") in shown
    by = {r[4]: r for r in rows}
    assert by["Two"][7] == "scroll down" and by["Go"][6] and next(r for r in rows if r[2] == "table")[8] == "A | B\n1 | 2"
    assert [r[5] for r in rows if r[2] == "text"] == ["First para", "Second", "inner", "end"]
    assert html.elements_of(None) == ("", []) and html.elements_of("<p>x")[1][0][2] == "text"


def test_structure_ladder_and_skeleton(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, "<p>installing the package"), (3, None)], "page_id long, html string")
    e = retrieval.with_structure(html.page_elements(pages)).cache()
    rows = {r.ord: r for r in e.where("page_id = 1").collect()}
    for r in rows.values():  # by definition
        later = [x.ord for x in rows.values() if x.ord > r.ord and x.depth <= r.depth]
        assert r.end_ord == (min(later) - 1 if later else max(rows))
        above = [x.ord for x in rows.values() if x.ord < r.ord and x.depth < r.depth]
        assert r.parent_ord == (max(above) if above else None) or rows[r.parent_ord].depth < r.depth
    q = spark.createDataFrame([(1, "first para"), (2, "para second"), (3, "bold"), (4, "zzz qqq tail"), (5, "installation"), (6, "nope")], "query_id long, query string")
    found = {(r.query_id, r.page_id): r.rung for r in retrieval.search_ladder(e, q).collect()}
    assert found == {(1, 1): "exact phrase", (2, 1): "all words", (3, 1): "word", (4, 1): "any word", (5, 2): "word root"}
    lines = [r.line for r in retrieval.skeleton_lines(e).where("page_id = 1").orderBy("ord").collect()]
    assert lines[0].endswith('nav "navigation" (2 links)') and any("code" in x and "(2 lines)" in x for x in lines)
    assert retrieval.outline(e, 400).where("page_id = 1").count() >= 4


def test_sql_findings(spark):
    a = validate.AnalyserAdapter(spark, "sqlite", {"t": [("a", "int"), ("b", "string")], "u": [("a", "int")]})
    kinds = lambda sql: a.check(sql).kind
    assert kinds("SELECT a FROM t WHERE b = ?") == "" and kinds("SELECT x.a FROM t x, u WHERE x.a = u.a") == "" and kinds("SELECT t.a FROM t JOIN u ON t.a = u.a") == ""
    assert kinds("SELECT nope FROM t") == "unknown_column" and kinds("SELECT a FROM gone") == "unknown_table" and kinds("SELECT a FRM t t t") == "syntax"
    assert kinds("DROP TABLE t") == "not_checked" and kinds("INSERT INTO gone VALUES (1)") == "unknown_table" and kinds("DELETE FROM t") == ""
    a.close()
    assert validate.split_statements("a ';' ; b -- ; x\n; /* ; */ ;c") == ["a ';'", "b -- ; x", "c"]
    assert validate.bind_placeholders("a = %s AND b = '%s' AND c = $1", "postgres") == "a = NULL AND b = '%s' AND c = NULL"


def test_schemas_and_touched_tables(spark):
    spark.createDataFrame([(1, "x")], "a int, b string").createOrReplaceTempView("touched_t")
    assert [tuple(r) for r in validate.schema_table(spark, ["touched_t"]).orderBy("ord").collect()] == [("touched_t", 0, "a", "int"), ("touched_t", 1, "b", "string")]
    assert len(validate.tables_touched(spark, "SELECT x.a FROM touched_t x JOIN touched_t y ON x.a = y.a")) == 2
    found = validate.dispatch([(1, "redis", "GET a"), (2, "lmdb", "names"), (3, "lmdb", "gone")], {"lmdb": validate.NamedSetAdapter("lmdb", {"names"})})
    assert [(i, f.ok, f.kind) for i, _, f in found] == [(1, True, "not_checked"), (2, True, ""), (3, False, "unknown_table")]


def test_streams_agree_with_batches(spark, tmp_path):
    from loomstone.streaming import streams

    source = str(tmp_path / "events")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(3).write.parquet(source)
    batch = streams.zoned(spark.read.parquet(source))
    stream = streams.read_events(spark, source)
    costs = streams.run_once(streams.running_costs(stream), "costs", "complete", str(tmp_path / "a"))
    want = {(r.day, r.event_type): r.calls for r in streams.running_costs(batch).collect()}
    assert {(r.day, r.event_type): r.calls for r in costs.collect()} == want
    calls = lambda df: df.select(F.col("user_id").alias("key"), F.unix_seconds("ts").alias("t"), F.col("event_id").alias("call_id"))
    one = streams.read_events(spark, source, 100)
    got = streams.run_once(streams.admissions(calls(one), 2, 40_000), "admitted", "append", str(tmp_path / "b"))
    expected = accounting.rate_limit(calls(batch), 2, 40_000)
    assert {(r.call_id, r.outcome) for r in got.collect()} == {(r.call_id, r.outcome) for r in expected.collect()}
    distinct = streams.run_once(streams.distinct_events(streams.read_events(spark, source, 100)), "distinct_events", "append", str(tmp_path / "c"))
    assert distinct.count() == batch.select("event_id").distinct().count()
    assert streams.run_once(streams.idle_sessions(streams.read_events(spark, source, 100)), "idle", "append", str(tmp_path / "d")).count() > 0


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_every_query_runs_on_the_smallest_tables(spark, name):
    out = registry.queries()[name](spark, "/root/testdata/sf0.001")
    assert out.columns and out.count() >= 0


def test_fixture_graph_has_all_termini(spark):
    t = fixture_graph(spark, "/root/testdata/sf0.001")
    assert t["imports"].where("is_external").count() and graph.missing_imports(t["imports"]).count()


def test_deeply_nested_pages_and_open_paragraphs():
    deep = "<body>" + "<div>" * 3000 + "<p>low</p><ul><li>x"
    assert [e[2] for e in html.elements_of(deep)[1]] == ["text", "list", "item"]
    many = "<body>" + "<section>" * 40 + "<p>too low</p>"
    assert {e[3] for e in html.elements_of(many)[1]} == set(range(html.MAX_DEPTH + 1))
    assert [(e[2], e[3]) for e in html.elements_of("<body><p><b>one<br><p>two</p><p><i>three<ul><li>four")[1]] == [("text", 0)] * 3 + [("list", 0), ("item", 1)]


def test_letters_globs_and_relative_paths(spark):
    numbers = [0, 25, 26, 701, 702, 475253, 475254, 12356629, 12356630, 10**12]
    rows = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", text.letters(F.col("n")).alias("t"))
    rows = rows.select("n", "t", text.letter_index(F.col("t")).alias("back")).collect()
    assert [r.back for r in rows] == numbers and [r.t for r in rows][:8] == ["a", "z", "aa", "zz", "aaa", "zzzz", "aaaaa", "zzzzz"]
    names = ["a.py", "b.txt", "dir/a.py", "[x].py", "ab"]
    paths = spark.createDataFrame([(n,) for n in names], "p string")
    hit = lambda g: [r.p for r in paths.where(text.glob_match(F.col("p"), g)).collect()]
    assert hit("*.py") == ["a.py", "dir/a.py", "[x].py"] and hit("?b") == ["ab"] and hit("[ab]*") == ["a.py", "b.txt", "ab"] and hit("[^ab]*") == ["dir/a.py", "[x].py"] and hit("[[]x].py") == ["[x].py"]
    pairs = spark.createDataFrame([("/a/b/c", "/a/b"), ("/a/x", "/a/b/c"), ("/a", "/a"), ("/q/r", "/a")], "p string, f string")
    assert [r[0] for r in pairs.select(text.relative_path(F.col("p"), F.col("f"))).collect()] == ["c", "../../x", "", "../q/r"]


@pytest.mark.parametrize("pairs", [facts.PAIRS_A_KEY, 6])
def test_shared_endpoints_are_made_once_without_a_shuffle_of_the_pairs(spark, monkeypatch, pairs):
    monkeypatch.setattr(facts, "PAIRS_A_KEY", pairs)
    rng = random.Random(5)
    side = lambda n: [(rng.choice(["port", "host", None]), rng.choice([":1", ":2", None]), rng.choice([*range(12), None])) for _ in range(n)]
    a, b = side(40), side(60)
    frame = lambda rows: spark.createDataFrame(rows, "kind string, locator string, file_id long")
    found = facts.shared_endpoints(frame(a), frame(b))
    want = {(x[1], x[2], y[2]) for x in a for y in b if None not in (*x, *y) and x[:2] == y[:2] and x[2] != y[2]}
    assert sorted(map(tuple, found.collect())) == sorted(want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Distinct" not in plan


def test_a_crawl_takes_few_sets_of_starts_at_a_time(spark, monkeypatch):
    """Rows that a hop rewrites are those of some sets only; starts are reached as by one walk, also where it ends early."""
    n, sizes, cut = 200, [], graph.cut

    def noted(rows, label, **options):
        table = cut(rows, label, **options)
        if label == "reach":
            sizes.append(table.count())
        return table

    monkeypatch.setattr(graph, "cut", noted)
    monkeypatch.setattr(graph, "SETS", 1)
    pairs = [(i, i + 1) for i in range(n - 1) if i % 50] + [(i, 7) for i in range(0, n, 9)]
    near = {i: set() for i in range(n)}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    imports = spark.createDataFrame([*pairs, (5, None)], "file_id long, resolved_file_id long")
    starts = spark.createDataFrame([(i,) for i in range(0, n, 2)] + [(None,)], "start_id long")
    for depth in (2, 14):
        want = set()
        for s in range(0, n, 2):
            seen, level = {s}, {s}
            want.add((s, s, 0))
            for d in range(1, depth + 1):
                level = {y for x in level for y in near[x]} - seen
                seen |= level
                want |= {(s, x, d) for x in level}
        got = [tuple(r) for r in graph.crawl(imports, starts, depth).select("start_id", "node", "depth").collect()]
        assert len(got) == len(want) and set(got) == want
    assert max(sizes) <= n
    assert graph.crawl(imports, starts.where("start_id < 0"), 3).count() == 0


@pytest.mark.parametrize(("links", "kinds"), [(9, 1 << 18), (9, 1), (1, 1 << 18)])
def test_a_crawl_of_many_starts_goes_by_hubs(spark, monkeypatch, links, kinds):
    """By hubs, by the hubs among many files that could be some, by walks where kinds are too many: the same pairs, no pair twice."""
    n, labels, cut, few = 300, [], graph.cut, 64
    for name, value in {"SETS": 1, "FEW_STARTS": few, "IN_ROW": 7, "HUB_LINKS": links, "FEW_KINDS": kinds}.items():
        monkeypatch.setattr(graph, name, value)
    monkeypatch.setattr(graph, "cut", lambda rows, label, **options: labels.append(label) or cut(rows, label, **options))
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(n - 1) if i % 40] + [(i, rng.choice((3, 90, 211))) for i in range(0, n, 5)] + [(rng.randrange(n), rng.randrange(n)) for _ in range(25)]
    near = {i: set() for i in range(n)}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    imports = spark.createDataFrame([*pairs, (5, None)], "file_id long, resolved_file_id long")
    # Starts at one file, at two, at a hub, at a file that has no links, at none.
    at = {s: {s} for s in range(0, n, 2)} | {1000: {4, 250}, 1001: {90}, 1002: {999}}
    starts = spark.createDataFrame([(s, x) for s, own in at.items() for x in own] + [(None, 1)], "start_id long, node long")
    depth, want = 5, set()
    for s, own in at.items():
        seen, level = set(own), set(own)
        want |= {(s, x, 0) for x in own}
        for d in range(1, depth + 1):
            level = {y for x in level for y in near.get(x, ())} - seen
            seen |= level
            want |= {(s, x, d) for x in level}
    got = [tuple(r) for r in graph.crawl(imports, starts, depth).select("start_id", "node", "depth").collect()]
    assert len(got) == len(want) and set(got) == want
    assert ("hub-apart" in labels) == (kinds > 1)
