"""Python: modules, methods, imports, databases, SQL strings and LMDB names, from the standard parser.

A syntax error gives declarations by line instead, and is reported.
"""

from __future__ import annotations

import ast
import re
import textwrap

from loomstone.operators.extract import Analysis, extractor

# Call names that take SQL first, and connecting calls by library.
SQL_CALLS = {"execute", "executemany", "executescript", "sql"}
CONNECTS = {("sqlite3", "connect"): "sqlite", ("lmdb", "open"): "lmdb", ("lmdb", "Environment"): "lmdb", ("duckdb", "connect"): "duckdb", ("pymysql", "connect"): "mysql", ("MySQLdb", "connect"): "mysql", ("mysql.connector", "connect"): "mysql"}


def _text(node: ast.AST | None) -> tuple[str | None, bool]:
    """(text, dynamic) of a string expression; ``text(...)`` is unwrapped."""
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        return node.value, False
    if isinstance(node, ast.JoinedStr):
        return "".join(v.value if isinstance(v, ast.Constant) else "{}" for v in node.values), True
    if isinstance(node, ast.Call) and node.args and (getattr(node.func, "id", "") == "text" or getattr(node.func, "attr", "") == "text"):
        return _text(node.args[0])
    if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Add):
        (a, x), (b, y) = _text(node.left), _text(node.right)
        if a is not None or b is not None:
            return (a or "{}") + (b or "{}"), x or y or a is None or b is None
    return None, False


def _dotted(node: ast.AST) -> str:
    if isinstance(node, ast.Attribute):
        return f"{_dotted(node.value)}.{node.attr}"
    return node.id if isinstance(node, ast.Name) else ""


def _method_kind(node: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
    names = [_dotted(d.func if isinstance(d, ast.Call) else d) for d in node.decorator_list]
    for name, kind in (("staticmethod", "static_method"), ("classmethod", "class_method"), ("property", "property")):
        if name in names:
            return kind
    if any(n.endswith((".setter", ".getter", ".deleter")) for n in names):
        return "property"
    return "async_method" if isinstance(node, ast.AsyncFunctionDef) and names else "method"


def _start(node) -> int:
    return min([node.lineno, *(d.lineno for d in node.decorator_list)])


@extractor("python")
def python_facts(text: str) -> Analysis:
    out = Analysis()
    try:
        tree = ast.parse(textwrap.dedent(text) if text[:1] in " \t" else text)
    except (SyntaxError, ValueError) as problem:
        out.error = f"syntax: {problem}"
        for n, line in enumerate(text.split("\n"), 1):
            if m := re.match(r"(async\s+def|def|class)\s+(\w+)", line):
                out.add("module", m[2], {"class": "class", "def": "function"}.get(m[1], "async_function"), n, n)
        return out
    for node in tree.body:
        if isinstance(node, ast.ClassDef):
            out.add("module", node.name, "class", _start(node), node.end_lineno)
            for member in node.body:
                if isinstance(member, ast.FunctionDef | ast.AsyncFunctionDef):
                    out.add("method", member.name, _method_kind(member), _start(member), member.end_lineno, parent=node.name)
        elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            out.add("module", node.name, "async_function" if isinstance(node, ast.AsyncFunctionDef) else "function", _start(node), node.end_lineno)
    aliases: dict[str, str] = {}
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            for a in node.names:
                aliases[(a.asname or a.name).split(".")[0] if not a.asname else a.asname] = a.name if a.asname else a.name.split(".")[0]
                out.add("import", a.name, "import", node.lineno, node.lineno)
        elif isinstance(node, ast.ImportFrom):
            out.add("import", "." * node.level + (node.module or ""), "from", node.lineno, node.lineno, detail=",".join(a.name for a in node.names))
    for node in ast.walk(tree):
        if not isinstance(node, ast.Call):
            continue
        name = _dotted(node.func)
        head, _, last = name.rpartition(".")
        library = ".".join([aliases.get(head.split(".")[0], head.split(".")[0]), *head.split(".")[1:]]) if head else ""
        first = node.args[0] if node.args else None
        if kind := CONNECTS.get((library, last)):
            keyed = {k.arg: _text(k.value)[0] for k in node.keywords if k.arg}
            if kind == "mysql":
                where = "{}:{}/{}".format(keyed.get("host") or "localhost", next((str(k.value.value) for k in node.keywords if k.arg == "port" and isinstance(k.value, ast.Constant)), "3306"), keyed.get("database") or keyed.get("db") or "")
                out.add("database", where, "mysql", node.lineno, node.lineno)
            else:
                path, _ = _text(first) if first is not None else (keyed.get("database") or keyed.get("path"), False)
                shown = path if path is not None else f"dynamic:{ast.unparse(first)}" if first is not None else ":memory:"
                if kind != "duckdb" or shown != ":memory:":
                    out.add("database", shown, kind, node.lineno, node.lineno)
        elif last in SQL_CALLS and first is not None:
            sql, dynamic = _text(first)
            if sql is not None:
                out.add("query", last, "sql", node.lineno, node.lineno, detail=sql, dynamic=dynamic)
            else:
                out.add("query", last, "sql", node.lineno, node.lineno, detail=None, dynamic=True)
        elif last == "open_db":
            value = first.value if isinstance(first, ast.Constant) else next((k.value.value for k in node.keywords if k.arg == "key" and isinstance(k.value, ast.Constant)), None)
            if isinstance(value, str | bytes):
                out.add("subdb", value.decode(errors="replace") if isinstance(value, bytes) else value, "lmdb", node.lineno, node.lineno, receiver=head or None)
    return out
