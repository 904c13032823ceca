from pyspark.sql import functions as F

from loomstone.operators.extract import EXTRACTORS, analyze, extract_facts

PY = '''import sqlite3, os.path as p
from .pkg import a, b

@deco
class A(Base):
    @staticmethod
    def s(): pass
    @property
    def q(self): return 1
    async def plain(self): ...
    @deco
    async def m(self): ...

async def go():
    con = sqlite3.connect("x.db")
    con.execute("SELECT 1")
    con.execute(f"DELETE FROM {t}")
    env = lmdb.open(PATH)
    env.open_db(b"names")
def f(): pass
'''

JS = """// import x from 'nope'
import fs from 'node:fs';
export { y } from './y.js';
const z = require('../z');
export class Store extends Base {
  static make(a) { return new Store(a); }
  get(k) { if (k) { return 1; } }
  field = 3;
}
export const run = async (a) => {
  const db = new Database('data.db', { readonly: true });
  db.prepare(`SELECT * FROM t WHERE a = ${a}`).all();
  db.exec("INSERT INTO t VALUES (1)");
  el.get("nothing here");
};
function* walk() { return "class Fake {"; }
const PORT = process.env.PORT || 8080;
app.listen(PORT);
for (const f of readdirSync(dir)) { if (f.endsWith('.js')) await import(f); }
"""


def facts(text, language, kind):
    return [(f.name, f.kind) for f in analyze(text, language).facts if f.fact == kind]


def test_python():
    assert facts(PY, "python", "module") == [("A", "class"), ("go", "async_function"), ("f", "function")]
    assert facts(PY, "python", "method") == [("s", "static_method"), ("q", "property"), ("plain", "method"), ("m", "async_method")]
    assert facts(PY, "python", "import") == [("sqlite3", "import"), ("os.path", "import"), (".pkg", "from")]
    assert sorted(facts(PY, "python", "database")) == [("dynamic:PATH", "lmdb"), ("x.db", "sqlite")]
    queries = [(f.detail, f.dynamic) for f in analyze(PY, "python").facts if f.fact == "query"]
    assert queries == [("SELECT 1", False), ("DELETE FROM {}", True)]
    assert facts(PY, "python", "subdb") == [("names", "lmdb")]
    spans = {f.name: (f.line_start, f.line_end) for f in analyze(PY, "python").facts if f.fact == "module"}
    assert spans["A"] == (4, 12)
    bad = analyze("def ok(): pass\nclass (:\n", "python")
    assert bad.error and [(f.name, f.kind) for f in bad.facts] == [("ok", "function")]


def test_javascript():
    assert facts(JS, "javascript", "module") == [("Store", "class"), ("run", "arrow_function"), ("walk", "function")]
    assert facts(JS, "javascript", "method") == [("make", "static_method"), ("get", "method"), ("field", "field")]
    assert [n for n, _ in facts(JS, "javascript", "import")] == ["node:fs", "./y.js", "../z"]
    assert facts(JS, "javascript", "database") == [("data.db", "sqlite")]
    q = [(f.receiver, f.name, f.dynamic) for f in analyze(JS, "javascript").facts if f.fact == "query"]
    assert q == [("db", "prepare", True), ("db", "exec", False)]
    assert facts(JS, "javascript", "listener") == [("8080", "port")]
    assert facts(JS, "javascript", "load") == [("dir", ".js")]
    assert facts("export class T { private a: string;\n async go(x: number): Promise<void> { }\n}\ninterface I { }\n", "typescript", "module") == [("T", "class"), ("I", "interface")]


CASES = {
    "go": ('package m\nimport (\n  "fmt"\n  x "a/b"\n)\nfunc F(a int) {\n if a { }\n}\nfunc (s *Srv) Run() {}\ntype Srv struct { a int }\ntype R interface { X() }\ntype N int\nvar d, _ = sql.Open("pg", "dsn://x")\n',
           [("F", "function"), ("(*Srv).Run", "method"), ("Srv", "struct"), ("R", "interface"), ("N", "type")], ["fmt", "a/b"]),
    "java": ("import java.util.*;\npublic class A {\n  public A() { if (x) { } }\n  int m(String s) { return f(s); }\n  interface I { void x(); }\n}\nenum E { P }\n",
             [("A", "class"), ("A.A", "constructor"), ("A.m", "method"), ("A.I", "interface"), ("A.I.x", "method"), ("E", "enum")], ["java.util.*"]),
    "rust": ('use std::io;\npub struct S { a: u8 }\nimpl S {\n  pub fn new() -> S { S { a: 1 } }\n}\nimpl fmt::Display for S { fn fmt(&self) {} }\nfn main() { let x = 1; }\nenum E { A }\ntrait T { fn t(&self); }\nmod m;\n',
             [("S", "struct"), ("impl S", "impl"), ("S::new", "method"), ("impl fmt::Display for S", "impl"), ("S::fmt", "method"), ("main", "function"), ("E", "enum"), ("T", "trait"), ("T::t", "method"), ("m", "mod")], ["std::io"]),
    "c": ('#include <stdio.h>\n#include "a.h"\nstruct P { int x; };\ntypedef int myint;\nenum E { A };\nstatic int f(int a)\n{\n  if (a) { return 1; }\n  return 0;\n}\n',
          [("P", "struct"), ("myint", "typedef"), ("E", "enum"), ("f", "function")], ["stdio.h", "a.h"]),
    "cpp": ("#include <x>\nnamespace n {\nclass C {\n public:\n  void go(int a) { if (a) {} }\n};\nint free_one() { return 1; }\n}\nvoid C::out() { }\nenum class K { A };\n",
            [("n", "namespace"), ("n::C", "class"), ("n::C::go", "method"), ("n::free_one", "function"), ("C::out", "method"), ("K", "enum")], ["x"]),
    "csharp": ("using System;\nnamespace N {\n public class A {\n  public A(int x) { }\n  public int P { get; set; }\n  public void M() { if (a) { } }\n }\n interface I { void X(); }\n}\n",
               [("N", "namespace"), ("N.A", "class"), ("N.A.A", "constructor"), ("N.A.P", "property"), ("N.A.M", "method"), ("N.I", "interface"), ("N.I.X", "method")], ["System"]),
    "kotlin": ("import a.b.C\ndata class D(val x: Int)\nclass K {\n  fun m() { if (a) { } }\n  companion object { fun make() = 1 }\n}\nobject O { }\nfun top(x: Int) = x\n",
               [("D", "data_class"), ("K", "class"), ("K.m", "method"), ("K.Companion", "companion_object"), ("K.Companion.make", "method"), ("O", "object"), ("top", "function")], ["a.b.C"]),
    "swift": ("import UIKit\nclass V: UIView {\n  override func draw() { if x { } }\n}\nstruct S { }\nprotocol P { func q() }\nfunc free() { }\nenum E { case a }\n",
              [("V", "class"), ("V.draw", "method"), ("S", "struct"), ("P", "protocol"), ("P.q", "method"), ("free", "function"), ("E", "enum_declaration")], ["UIKit"]),
    "php": ("<?php\nnamespace App;\nuse Foo\\Bar;\nclass A {\n  public function m($x) { if ($x) { } }\n}\ninterface I { }\nfunction f() { }\n",
            [("A", "class"), ("A::m", "method"), ("I", "interface"), ("f", "function")], ["App", "Foo\\Bar"]),
    "ruby": ("require 'json'\nrequire_relative 'x'\nmodule M\n  class C\n    def go\n      if a\n      end\n    end\n    def self.make; end\n  end\nend\n",
             [("M", "module"), ("M::C", "class"), ("M::C#go", "method"), ("M::C.make", "singleton_method")], ["json", "x"]),
    "shell": ("source ./a.sh\nf() {\n  echo {x}\n}\nfunction g {\n  h() { :; }\n}\n. b.sh\n", [("f", "function"), ("g", "function"), ("h", "function")], ["./a.sh", "b.sh"]),
    "objc": ('#import "A.h"\n@interface C : NSObject\n- (void)go:(int)a with:(int)b;\n@end\n@implementation C\n+ (id)make { return nil; }\n@end\n@protocol P\n@end\n',
             [("C", "interface"), ("-[C go:with:]", "method"), ("C", "class"), ("+[C make]", "method"), ("P", "protocol")], ["A.h"]),
    "sql": ("CREATE TABLE IF NOT EXISTS t (a int);\ncreate or replace view v as select 1;\nCREATE UNIQUE INDEX i ON t(a);\n", [("t", "table"), ("v", "view"), ("i", "index")], []),
    "nginx": ("include mime.types;\nupstream app { server 10.0.0.1:8000; }\nserver {\n  listen 80;\n  server_name ex.org www.ex.org;\n  location / { proxy_pass http://app:9000/x; }\n}\n",
              [("app", "upstream"), ("ex.org", "server")], ["mime.types"]),
}


def test_other_languages():
    for language, (text, modules, imports) in CASES.items():
        assert facts(text, language, "module") == modules, language
        assert [n for n, _ in facts(text, language, "import")] == imports, language
        for f in analyze(text, language).facts:
            assert 1 <= f.line_start <= f.line_end
    assert facts(CASES["nginx"][0], "nginx", "endpoint") == [("10.0.0.1:8000", "server"), ("0.0.0.0:80", "port"), ("app:9000", "server")]
    assert facts(CASES["go"][0], "go", "database") == [("dsn://x", "go_db")]


def test_extract_over_a_table(spark):
    rows = [(i, language, text) for i, (language, (text, _, _)) in enumerate(CASES.items())] + [(100, "python", PY), (101, "python", "def ("), (102, None, "x"), (103, "python", None), (104, "cobol", "x")]
    out = extract_facts(spark.createDataFrame(rows, "file_id long, language string, content string"))
    assert out.where("fact = 'error'").select("file_id").collect()[0][0] == 101
    assert out.where("file_id > 101").count() == 0
    assert out.where("file_id = 100").groupBy("fact").agg(F.count("*")).count() >= 5
    assert len(EXTRACTORS) >= 16
