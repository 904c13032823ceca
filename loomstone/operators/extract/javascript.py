"""JavaScript and TypeScript: declarations, imports, plugin loads, listeners, databases and SQL, by a masking scanner.

Comments and the insides of strings and templates are blanked (offsets stay), so braces and keywords can
be matched safely; string contents are then read from the original at the same offsets.
"""

from __future__ import annotations

import re
from bisect import bisect_right

from loomstone.operators.extract import Analysis, extractor

_TOKENS = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
_SQL_HEAD = re.compile(r"\s*(select|with|insert|update|delete|replace|create|alter|drop|pragma|explain|truncate|merge)\b", re.I)
# Methods that take SQL for sure, and those that may.
SURE_METHODS, LIKELY_METHODS = {"prepare", "executeSql", "queryRaw"}, {"query", "exec", "execute", "run", "all", "get", "each"}
DATABASES = (
    (re.compile(r"new\s+(?:Database|DatabaseSync|BetterSqlite3|sqlite3\.Database|sqlite3\.cached\.Database)\s*\(\s*"), "sqlite"),
    (re.compile(r"new\s+duckdb\.Database\s*\(\s*|DuckDBInstance\.create\s*\(\s*"), "duckdb"),
    (re.compile(r"new\s+(?:pg\.)?(?:Pool|Client)\s*\(\s*"), "postgres"),
    (re.compile(r"mysql2?\.create(?:Connection|Pool)\s*\(\s*"), "mysql"),
)


def mask(text: str) -> str:
    """The text with comments and the insides of strings blanked; every newline and offset stays."""
    blank = lambda s: re.sub(r"[^\n]", " ", s)
    return _TOKENS.sub(lambda m: blank(m[0]) if m[0][0] == "/" else m[0][0] + blank(m[0][1:-1]) + m[0][-1], text)


class Brackets:
    """The brackets of a masked text: where each closes, and what encloses a place. One pass over the text."""

    def __init__(self, masked: str) -> None:
        self.masked, self.close, self.spans, open_ = masked, {}, [], []
        for m in re.finditer(r"[{}()\[\]]", masked):
            if m[0] in "{([":
                open_.append(m.start())
            elif open_:
                self.close[open_.pop()] = m.start() + 1
        braces = sorted((a, b) for a, b in self.close.items() if masked[a] == "{")
        self.opened, depth_end = [a for a, _ in braces], []
        # For each brace the one around it: the last that is still open there.
        self.around: list[int] = []
        for a, _ in braces:
            while depth_end and self.close[depth_end[-1]] <= a:
                depth_end.pop()
            self.around.append(depth_end[-1] if depth_end else -1)
            depth_end.append(a)
        self.outer = [a for a, around in zip(self.opened, self.around, strict=True) if around < 0]
        self.inner: dict[int, list[int]] = {}
        for a, around in zip(self.opened, self.around, strict=True):
            self.inner.setdefault(around, []).append(a)

    def end(self, at: int) -> int:
        """Offset behind the bracket that closes the one at ``at``; the end of the text if none does."""
        return self.close.get(at, len(self.masked))

    def scope_end(self, at: int) -> int:
        """The end of the innermost braces around a place."""
        i = bisect_right(self.opened, at) - 1
        brace = self.opened[i] if i >= 0 else -1
        while brace >= 0 and self.close[brace] <= at:
            brace = self.around[bisect_right(self.opened, brace) - 1]
        return self.close[brace] if brace >= 0 else len(self.masked)

    def surface(self, brace: int = -1) -> str:
        """The masked text with everything inside braces blanked; of one block, or of the whole text."""
        start, stop = (brace + 1, self.end(brace) - 1) if brace >= 0 else (0, len(self.masked))
        out, at = [re.sub(r"[^\n]", " ", self.masked[:start])], start
        for a in self.inner.get(brace, []):
            out += [self.masked[at : a + 1], re.sub(r"[^\n]", " ", self.masked[a + 1 : self.close[a] - 1])]
            at = self.close[a] - 1
        return "".join([*out, self.masked[at:stop]])


class _Lines:
    def __init__(self, text: str) -> None:
        self.starts = [0, *[m.end() for m in re.finditer("\n", text)]]

    def __call__(self, offset: int) -> int:
        return bisect_right(self.starts, offset)


_DECLARED = re.compile(r"^[ \t]*(export\s+(?:default\s+)?)?(?:(?:abstract\s+)?(class)\s+(\w+)|(?:async\s+)?(function)\s*\*?\s*(\w+)|(?:const|let|var)\s+(\w+)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=\n]+)?(=>)|(interface|enum|type)\s+(\w+))", re.M)
_MEMBER = re.compile(r"^[ \t]*((?:(?:public|private|protected|readonly|override|async|get|set|abstract)\s+)*)(static\s+)?((?:async|get|set)\s+)?\*?\s*(#?\w+)\s*(?:<[^>\n]*>)?\s*(\(|=|;|:)", re.M)
_KEYWORDS = {"if", "for", "while", "switch", "catch", "return", "function", "else", "new", "do"}
_IMPORTS = re.compile(r"\bimport\s+(?:[\w*{}\s,$]+?\s+from\s+)?([\"'])|\bexport\s+[\w*{}\s,$]+?\s+from\s+([\"'])|\b(?:require|import)\s*\(\s*([\"'])")
_LISTEN = re.compile(r"\.listen\s*\(\s*(?:(\d{2,5})|(?:Number\(|parseInt\()?\s*process\.env\.(\w+)[^,)|?]*\)?\s*(?:\|\||\?\?)\s*(\d{2,5})|(\w+))")


def _string_at(text: str, at: int) -> str | None:
    m = _TOKENS.match(text, at)
    return m[0][1:-1] if m and m[0][0] in "\"'`" else None


@extractor("javascript", "typescript")
def javascript_facts(text: str) -> Analysis:
    out, masked, line = Analysis(), mask(text), _Lines(text)
    brackets = Brackets(masked)
    closing = brackets.end
    for m in _DECLARED.finditer(brackets.surface()):
        name = m[3] or m[5] or m[6] or m[9]
        kind = "class" if m[2] else "function" if m[4] else "arrow_function" if m[7] else m[8]
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        brace = masked.find("{", m.end() - 1)
        arrow_body = kind != "arrow_function" or re.match(r"\s*\{", masked[m.end() :])
        end = closing(brace) if brace >= 0 and arrow_body and kind != "type" else (masked.find("\n", m.end()) + 1 or len(text))
        out.add("module", name, kind, line(start), line(max(start, end - 1)), detail="exported" if m[1] else None)
        if kind == "class" and brace >= 0:
            body = brackets.surface(brace)
            for member in _MEMBER.finditer(body):
                if member[4] in _KEYWORDS or member.start(4) < brace:
                    continue
                is_call = member[5] == "("
                if is_call and not re.match(r"[^{};]*\{", masked[closing(member.end() - 1) : closing(member.end() - 1) + 4096]):
                    continue
                at = member.start(4)
                stop = closing(masked.find("{", closing(member.end() - 1))) if is_call else (masked.find("\n", at) if masked.find("\n", at) >= 0 else len(text))
                kind = ("static_method" if member[2] else "method") if is_call else "field"
                out.add("method", member[4], kind, line(at), line(max(at, stop - 1)), parent=name)
    for m in _IMPORTS.finditer(masked):
        quote = next(i for i in (1, 2, 3) if m[i])
        value = _string_at(text, m.start(quote))
        if value:
            out.add("import", value, ("import", "export", "require")[quote - 1], line(m.start()), line(m.start()))
    for m in re.finditer(r"\breaddir(?:Sync)?\s*\(\s*([^,)]+)", masked):
        window = text[m.start() : brackets.scope_end(m.start())]
        ext = re.search(r"\.endsWith\(\s*[\"'](\.\w+)[\"']\s*\)|/\\\.(\w+)\$/", window)
        if ext and re.search(r"\b(import|require)\s*\(", window):
            out.add("load", text[m.start(1) : m.end(1)].strip(), ext[1] or f".{ext[2]}", line(m.start()), line(m.start()))
    constants = {m[1]: m[2] for m in re.finditer(r"\b(?:const|let|var)\s+(\w+)\s*=\s*(?:(?:Number|parseInt)\()?\s*(?:process\.env\.\w+[^\n;|?]*(?:\|\||\?\?)\s*)?(\d{2,5})\b", text)}
    for m in _LISTEN.finditer(masked):
        port = m[1] or m[3] or constants.get(m[4] or "")
        if port:
            out.add("listener", port, "port", line(m.start()), line(m.start()), detail=f"env:{m[2]}" if m[2] else None)
    for pattern, kind in DATABASES:
        for m in pattern.finditer(masked):
            # What the statement assigns to.
            statement = max(masked.rfind(c, 0, m.start()) for c in ";{}") + 1
            handle = re.search(r"(?:(?:const|let|var)\s+|this\.)?(\w+)\s*(?::[^=\n]+)?=\s*(?:await\s+)?$", masked[statement : m.start()])
            stop = closing(masked.rfind("(", 0, m.end()))
            call = text[m.end() : stop - 1]
            path = _string_at(text, m.end())
            if kind in ("postgres", "mysql"):
                parts = dict(re.findall(r"(\w+)\s*:\s*[\"']([^\"']+)[\"']", call))
                path = path or parts.get("connectionString") or f"{parts.get('host', 'localhost')}/{parts.get('database', '')}"
            shown = path if path is not None and "${" not in path else f"dynamic:{call.split(',')[0].strip()}"
            out.add("database", shown, kind, line(m.start()), line(m.start()), detail="readonly" if re.search(r"readonly\s*:\s*true", call) else None, receiver=handle[1] if handle else None)
    for m in re.finditer(r"(?:(\w+)\s*\.\s*)(\w+)\s*\(\s*(?=[\"'`])", masked):
        if m[2] in SURE_METHODS or m[2] in LIKELY_METHODS:
            sql = _string_at(text, m.end())
            if sql and (m[2] in SURE_METHODS or (len(sql.strip()) >= 6 and _SQL_HEAD.match(sql))):
                out.add("query", m[2], "sql", line(m.start()), line(m.start()), detail=sql, receiver=m[1], dynamic=text[m.end()] == "`" and "${" in sql)
    return out
