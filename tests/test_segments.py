from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomstone.operators import segments as s

SAMPLES = {
    "lines": ("/etc/fstab", "# Disks\n/dev/a /mnt ext4\nB=2\n\nexport C=3\n", None),
    "ini": ("a.ini", "top=1\n\n# about\n[one]\nx = [1,\n 2]\ny=2\n\n[two]\nz: 3\n", None),
    "ssh": ("sshd_config", "Port 22\n\n# c\nHost a b\n  User x\n  # y\n  Port 1\n", None),
    "dockerfile": ("Dockerfile", "ARG A\nFROM x AS y\nRUN a \\\n  b\n# c\nCOPY . .\nFROM z\n", None),
    "yaml": ("a.yml", "---\na: 1\nb:\n  c: 2\n  d:\n    - e\n# x\nf: {}\n", None),
    "json": ("a.json", '{"a": 1, "b": {"c": [1, 2]}, "d": "x,y"}', None),
    "blocks": ("/etc/nginx/n.conf", "user a;\nhttp { # c\n  server { listen 80; }\n  x y;\n}\n", None),
    "braces": ("/etc/logrotate.d/x", "weekly\n/var/log/a {\n  rotate 4\n}\n", None),
    "tags": ("/etc/apache2/a", "Listen 80\n<VirtualHost *:80>\n  <Directory /a>\n    X y\n  </Directory>\n</VirtualHost>\n", None),
    "js": ("a.js", "import x from 'y';\n\n// about f\nfunction f() {\n  return { a: 1 };\n}\n\nclass C {\n  x = 1;\n  /* m */\n  m() {\n    f();\n  }\n}\nconst g = () => {\n};\n", "javascript"),
    "java": ("A.java", "package a;\n\npublic class A {\n  // runs\n  public void run() {\n  }\n}\n\ninterface B {\n}\n", "java"),
    "python": ("a.py", "import a\nimport b\n\n# about f\n@x\ndef f():\n    pass\n\nclass C:\n    y = 1\n    # m\n    def m(self): ...\nz = 1; w = 2\n", "python"),
}


def leaves(found, text):
    return "".join(text[x.start : x.end] if not x.children else leaves(x.children, text) for x in found)


def shown(found):
    return [(x.kind, x.name, shown(x.children)) if x.children else (x.kind, x.name) for x in found if x.kind not in ("whitespace", "gap")]


def test_every_flavour_covers_its_text_and_names_its_parts():
    for flavor, (path, text, language) in SAMPLES.items():
        if flavor not in ("python", "js", "java"):
            assert s.config_flavor(path, text, language) == flavor
        assert leaves(s.scan_segments(text, path, language), text) == text
    tree = lambda k: shown(s.scan_segments(SAMPLES[k][1], SAMPLES[k][0], SAMPLES[k][2]))
    assert tree("ini") == [("section", "(top)", [("entry", "top")]), ("section", "[one]", [("entry", "x"), ("entry", "y")]), ("section", "[two]", [("entry", "z")])]
    assert tree("ssh") == [("entry", "Port 22"), ("block", "Host a b", [("directive", "User"), ("directive", "Port")])]
    assert tree("dockerfile") == [("instruction", "ARG A"), ("stage", "FROM x AS y", [("instruction", "RUN a"), ("instruction", "COPY . .")]), ("stage", "FROM z")]
    assert tree("json") == [("mapping", "a"), ("mapping", "b"), ("mapping", "d")]
    assert tree("blocks") == [("directive", "user a"), ("block", "http", [("block", "server", [("directive", "listen 80")]), ("directive", "x y")])]
    assert tree("python") == [("import", "import a"), ("import", "import b"), ("function", "f"), ("class", "C", [("statement", "y = 1"), ("function", "m")]), ("statement", "z = 1; w = 2")]
    assert tree("lines") == [("group", "Disks", [("entry", "/mnt (/dev/a)"), ("entry", "B")]), ("entry", "C")]
    assert tree("yaml") == [("document", "---"), ("mapping", "a"), ("mapping", "b", [("mapping", "b.c"), ("mapping", "b.d", [("item", "b.d.- e")])]), ("mapping", "f")]
    assert tree("js") == [("function", "f"), ("class", "C", [("field", "x"), ("method", "m")]), ("arrow_function", "g")]
    assert tree("java") == [("class", "A", [("method", "A.run")]), ("interface", "B")]
    assert s.config_flavor("x.conf", "a {\n b;\n}\n") == "blocks" and s.config_flavor("x.conf", "[a]\nb=1\n") == "ini" and s.config_flavor("notes.txt", "x") is None


@settings(max_examples=120, deadline=None)
@given(st.sampled_from(sorted(SAMPLES)), st.lists(st.sampled_from(["a: 1", "# c", "", "[x]", "}", "{", "b {", "k=v", "<A b>", "</A>", "  y: 2", "FROM q", '"', "def f(): pass", "x;", "\\", "Host h", "- i", "function f() {", "class A {", "// c"]), max_size=14))
def test_any_text_is_covered(flavor, lines):
    path, _, language = SAMPLES[flavor]
    text = "\n".join(lines)
    assert leaves(s.scan_segments(text, path, language), text) == text
    rows = s.segment_rows(1, path, text, language)
    assert len({r[1] for r in rows}) == len(rows) and len({r[5] for r in rows if r[5]}) == sum(bool(r[5]) for r in rows)


def test_comment_classes():
    assert s.comment_class("# [off] x") == s.comment_class("# y = f(1)\n# return_value(y)") == "deactivated"
    assert s.comment_class("# plain words here") == s.comment_class("# word") == "prose"


def test_plain_segments_cover_and_classify(spark):
    texts = ["# Title\nbody\n\n\n1. one\nINTRO PART\ntext: x\n- item\n", "", "\n\n", "only", None, "a\n---\nb"]
    docs = spark.createDataFrame([(i, t, "plaintext") for i, t in enumerate(texts)], "doc_id long, text string, language string")
    got = s.plain_segments(docs)
    assert all(r.covered for r in s.covers(got, docs).collect())
    rows = [(r.kind, r.name, r.start_line, r.end_line) for r in got.where("doc_id = 0").orderBy("ord").collect()]
    assert rows == [("heading", "Title", 1, 2), ("whitespace", "(blank)", 3, 4), ("section", "one", 5, 5), ("heading", "INTRO PART", 6, 8), ("whitespace", "(blank)", 9, 9)]


def test_windows_gaps_and_snippets(spark):
    text = "\n".join("" if i % 7 == 0 else f"x{i}" for i in range(1, 101))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    w = s.windows_of_lines(docs, 20, 30).orderBy("window").collect()
    assert [(r.start_line, r.end_line) for r in w] == [(1, 21), (22, 42), (43, 63), (64, 84), (85, 100)]
    spans = spark.createDataFrame([(1, 3, 5), (1, 4, 9), (1, 12, 12)], "doc_id long, start_line long, end_line long")
    totals = spark.createDataFrame([(1, 14), (2, 3)], "doc_id long, lines long")
    assert sorted((r.doc_id, r.start_line, r.end_line) for r in s.fill_lines(spans, totals).collect()) == [(1, 1, 2), (1, 10, 11), (1, 13, 14), (2, 1, 3)]
    code = spark.createDataFrame([("x", "PY"), ("$ ls\ncd a\nfoo", None), ("def f(a):\n  pass", None), ("plain words", None)], "t string, h string")
    assert [r[0] for r in code.select(s.snippet_language(F.col("t"), F.col("h"))).collect()] == ["python", "shell", "python", "plaintext"]


def test_snippet_parts(spark):
    code = "import a\n\nclass C:\n    def m(self): ...\n\ndef f(): pass\n"
    rows = spark.createDataFrame([(1, "e12", code, "py"), (1, "e13", None, None)], "page_id long, element_id string, text string, hint string")
    got = {(r.address, r.kind, r.name) for r in s.snippet_parts(rows).collect()}
    assert got == {("e12.1", "import", "import a"), ("e12.2", "class", "C"), ("e12.2.1", "function", "m"), ("e12.3", "function", "f")}
