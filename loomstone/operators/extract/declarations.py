"""Other languages at the level of declarations: scoped rules over masked lines.

A language is a comment style and an ordered list of rules; a rule that opens a scope qualifies what its
braces hold. Start and end lines are always stored. Not reproduced: what needs a full grammar
(macros, several declarations in one line, generics over several lines).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from loomstone.operators.extract import Analysis, extractor, line_at


@dataclass
class Rule:
    kind: str
    pattern: str
    scope: bool = False  # names inside are qualified by this one
    inside: tuple[str, ...] | None = None  # only in scopes of these kinds; (): only at top level
    member: bool = False  # named with its scope


@dataclass
class Language:
    rules: list[Rule]
    imports: str
    join: str = "."
    line_comment: str = "//"
    databases: list[tuple[str, str]] = field(default_factory=list)
    deep: bool = True  # declarations below other blocks count, too


_MOD = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|open|override|virtual|async|partial|readonly|extern|unsafe|synchronized|native|default|fileprivate|inline|suspend|data|inner|const|mutating|required|convenience|class|lateinit|operator)\s+)*"
_ATTR = r"(?:@\w+(?:\([^)]*\))?\s+)*"

LANGUAGES: dict[str, Language] = {
    "go": Language(
        [Rule("method", r"func\s*\(\s*\w*\s*(\*?\w+)[^)]*\)\s*(\w+)"), Rule("function", r"func\s+(\w+)"), Rule("struct", r"type\s+(\w+)\s+struct\b"), Rule("interface", r"type\s+(\w+)\s+interface\b"), Rule("type", r"type\s+(\w+)\s+[\w\[\]*.]")],
        r"^\s*import\s+(?:\w+\s+)?\"([^\"]+)\"|^\s+(?:[\w.]+\s+)?\"([^\"]+)\"\s*$",
        databases=[("go_db", r"\b(?:sql|gorm|sqlx|pgx|mongo|redis|bolt|badger)\.(?:Open|Connect|New|Init)\(\s*(?:\"\w+\"\s*,\s*)?\"([^\"]+)\"")],
    ),
    "java": Language(
        [Rule("class", _ATTR + _MOD + r"class\s+(\w+)", True, member=True), Rule("interface", _ATTR + _MOD + r"@?interface\s+(\w+)", True, member=True), Rule("enum", _ATTR + _MOD + r"enum\s+(\w+)", True, member=True),
         Rule("constructor", _ATTR + r"(?:public|private|protected)\s+(\w+)\s*\([^;{}]*\)\s*(?:throws[\w\s,.]+)?\{", inside=("class", "enum"), member=True),
         Rule("method", _ATTR + _MOD + r"(?:<[^>]+>\s*)?[\w<>\[\],.?]+\s+(\w+)\s*\([^;{}]*\)\s*(?:throws[\w\s,.]+)?[{;]", inside=("class", "interface", "enum"), member=True)],
        r"^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;",
        databases=[("java_db", r"\b(?:getConnection|connect|open|createConnection)\(\s*\"([^\"]+)\"")],
    ),
    "rust": Language(
        [Rule("impl", r"(?:unsafe\s+)?impl(?:<[^>]*>)?\s+([\w:<>, ]+?\s+for\s+[\w:<>, ]+?|[\w:<>, ]+?)\s*(?:where[^{]*)?\{", True), Rule("method", r"(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+)*fn\s+(\w+)", inside=("impl", "trait"), member=True),
         Rule("function", r"(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+|extern\s+\"C\"\s+)*fn\s+(\w+)"), Rule("struct", r"(?:pub(?:\([^)]*\))?\s+)?struct\s+(\w+)"), Rule("enum", r"(?:pub(?:\([^)]*\))?\s+)?enum\s+(\w+)"),
         Rule("trait", r"(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(\w+)", True), Rule("mod", r"(?:pub(?:\([^)]*\))?\s+)?mod\s+(\w+)")],
        r"^\s*(?:pub\s+)?use\s+([^;]+);", "::",
        databases=[("rust_db", r"\b(?:rusqlite|sqlx|diesel|mongodb|redis|postgres|sled)\b[\w:]*::(?:open|connect|connect_lazy|new|establish|from_str)\(\s*\"([^\"]+)\"")],
    ),
    "c": Language(
        [Rule("struct", r"(?:typedef\s+)?struct\s+(\w+)\s*\{"), Rule("union", r"(?:typedef\s+)?union\s+(\w+)\s*\{"), Rule("enum", r"(?:typedef\s+)?enum\s+(\w+)\s*\{"), Rule("typedef", r"typedef\s+(?:struct|union|enum)?\s*[\w\s*]+?\b(\w+)\s*;"),
         Rule("function", r"(?:[A-Za-z_][\w*]*[\s*]+)+\**(\w+)\s*\([^;{}]*\)\s*\{", inside=())],
        r"^\s*#\s*include\s+[<\"]([^>\"]+)[>\"]",
        databases=[("c_io", r"\bsqlite3_open(?:_v2)?\(\s*\"([^\"]+)\"")],
    ),
    "cpp": Language(
        [Rule("namespace", r"(?:inline\s+)?namespace\s+([\w:]+)\s*\{", True, member=True), Rule("template", r"template\s*<[^{};]*>\s*(?:class|struct)\s+(\w+)", True, member=True), Rule("class", r"class\s+(\w+)[^;{]*\{", True, member=True), Rule("struct", r"(?:typedef\s+)?struct\s+(\w+)[^;{]*\{", True, member=True), Rule("enum", r"enum\s+(?:class\s+|struct\s+)?(\w+)[^;{]*\{", member=True),
         Rule("method", r"(?:[A-Za-z_][\w:<>,*&]*[\s*&]+)*(\w+::~?\w+)\s*\([^;{}]*\)[^;{}]*\{"), Rule("method", r"(?:[A-Za-z_][\w:<>,*&]*[\s*&]+)*(~?\w+)\s*\([^;{}]*\)[^;{}]*[{;]", inside=("class", "struct", "template"), member=True),
         Rule("function", r"(?:[A-Za-z_][\w:<>,*&]*[\s*&]+)+(\w+)\s*\([^;{}]*\)[^;{}]*\{", inside=("namespace", ""), member=True)],
        r"^\s*#\s*include\s+[<\"]([^>\"]+)[>\"]", "::",
    ),
    "csharp": Language(
        [Rule("namespace", r"namespace\s+([\w.]+)\s*\{", True, member=True), Rule("class", _MOD + r"class\s+(\w+)", True, member=True), Rule("struct", _MOD + r"struct\s+(\w+)", True, member=True), Rule("record", _MOD + r"record\s+(?:class\s+|struct\s+)?(\w+)", True, inside=("namespace", "class", "struct"), member=True), Rule("interface", _MOD + r"interface\s+(\w+)", True, member=True), Rule("enum", _MOD + r"enum\s+(\w+)", member=True),
         Rule("constructor", r"(?:public|private|protected|internal)\s+(\w+)\s*\([^;{}]*\)\s*(?::[^{]*)?\{", inside=("class", "struct", "record"), member=True), Rule("property", _MOD + r"[\w<>\[\],.?]+\s+(\w+)\s*\{\s*(?:get|set|init)\b", inside=("class", "struct", "interface", "record"), member=True),
         Rule("method", _MOD + r"[\w<>\[\],.?]+\s+(\w+)\s*(?:<[^>]*>)?\([^;{}]*\)\s*(?:where[^{]*)?(?:[{;]|=>)", inside=("class", "struct", "interface", "record"), member=True)],
        r"^\s*using\s+(?:static\s+)?([\w.]+)\s*;",
    ),
    "kotlin": Language(
        [Rule("companion_object", r"companion\s+object(?:\s+(\w+))?", True, member=True), Rule("data_class", _ATTR + r"(?:\w+\s+)*data\s+class\s+(\w+)", True, member=True), Rule("sealed_class", _ATTR + r"(?:\w+\s+)*sealed\s+(?:class|interface)\s+(\w+)", True, member=True), Rule("enum", _ATTR + r"(?:\w+\s+)*enum\s+class\s+(\w+)", True, member=True), Rule("class", _ATTR + _MOD + r"class\s+(\w+)", True, member=True), Rule("interface", _ATTR + _MOD + r"(?:fun\s+)?interface\s+(\w+)", True, member=True), Rule("object", _ATTR + _MOD + r"object\s+(\w+)", True, member=True),
         Rule("method", _ATTR + _MOD + r"fun\s+(?:<[^>]*>\s*)?(?:[\w<>?.]+\.)?(\w+)\s*\(", inside=("class", "data_class", "sealed_class", "enum", "interface", "object", "companion_object"), member=True), Rule("function", _ATTR + _MOD + r"fun\s+(?:<[^>]*>\s*)?(?:[\w<>?.]+\.)?(\w+)\s*\(")],
        r"^\s*import\s+([\w.]+(?:\.\*)?)",
    ),
    "swift": Language(
        [Rule("class", _ATTR + r"(?:(?:public|private|open|final|internal|fileprivate)\s+)*(?:class|actor)\s+(?!func\b|var\b)(\w+)", True, member=True), Rule("struct", _ATTR + _MOD + r"struct\s+(\w+)", True, member=True), Rule("enum_declaration", _ATTR + _MOD + r"(?:indirect\s+)?enum\s+(\w+)", True, member=True), Rule("protocol", _ATTR + _MOD + r"protocol\s+(\w+)", True, member=True),
         Rule("method", _ATTR + _MOD + r"func\s+(\w+)", inside=("class", "struct", "enum_declaration", "protocol"), member=True), Rule("function", _ATTR + _MOD + r"func\s+(\w+)")],
        r"^[ \t]*(?:@\w+[ \t]+)?import[ \t]+(?:\w+[ \t]+)?([\w.]+)",
    ),
    "php": Language(
        [Rule("class", r"(?:(?:abstract|final|readonly)\s+)*class\s+(\w+)", True), Rule("interface", r"interface\s+(\w+)", True), Rule("trait", r"trait\s+(\w+)", True),
         Rule("method", r"(?:(?:public|private|protected|static|abstract|final)\s+)*function\s+&?(\w+)", inside=("class", "interface", "trait"), member=True), Rule("function", r"function\s+&?(\w+)", inside=())],
        r"^\s*(?:use|namespace)\s+(?:function\s+|const\s+)?([\w\\]+)", "::",
    ),
    "objc": Language(
        [Rule("interface", r"@interface\s+(\w+\s*\(\s*\w*\s*\)|\w+)"), Rule("class", r"@implementation\s+(\w+)"), Rule("protocol", r"@protocol\s+(\w+)(?!\s*[;,])"), Rule("method", r"([-+]\s*\([^)]*\)\s*[^;{]+)(?=[;{])")],
        r"^\s*#\s*(?:import|include)\s+[<\"]([^>\"]+)[>\"]|^\s*@import\s+([\w.]+)",
    ),
}


def mask_code(text: str, line_comment: str = "//") -> str:
    """Comments and insides of strings blanked; offsets and newlines stay."""
    pattern = re.compile(rf"{re.escape(line_comment)}[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])'", re.S)
    blank = lambda s: re.sub(r"[^\n]", " ", s)
    return pattern.sub(lambda m: blank(m[0]) if m[0][0] not in "\"'" else m[0][0] + blank(m[0][1:-1]) + m[0][-1], text)


_CONTROL = {"if", "for", "while", "switch", "return", "catch", "else", "do", "new", "throw", "sizeof", "defined", "case", "foreach", "using", "lock", "when", "match", "loop", "delete", "await"}


def _name_of(rule: Rule, m: re.Match, language: str) -> str:
    if language == "go" and rule.kind == "method":
        return f"({m[1]}).{m[2]}"
    if language == "rust" and rule.kind == "impl":
        return f"impl {' '.join(m[1].split())}"
    if language == "objc" and rule.kind == "method":
        return m[1]
    return " ".join(m[1].split()) if m[1] else "Companion"


def declared(text: str, language: str) -> Analysis:
    """Walk the declarations of a brace language: at each statement start, the first rule that matches."""
    spec, out = LANGUAGES[language], Analysis()
    masked = mask_code(text, spec.line_comment)
    if language == "cpp":
        masked = re.sub(r"\b(?:public|private|protected)\s*:(?!:)", lambda m: " " * len(m[0]), masked)
    rules = [(r, re.compile(r.pattern)) for r in spec.rules]
    # Scopes: (kind, name, brace depth). Statement starts: the beginning, and behind { } ; and line breaks.
    scopes: list[tuple[str, str, int]] = []
    depth, seen = 0, set()
    starts = [0, *[m.end() for m in re.finditer(r"[{};\n]", masked)]]
    events = sorted({(s, 0) for s in starts} | {(m.start(), 1 if m[0] == "{" else 2) for m in re.finditer(r"[{}]", masked)})
    pending: tuple[str, str] | None = None
    objc_class = ""
    for offset, what in events:
        if what == 1:
            depth += 1
            if pending:
                scopes.append((*pending, depth))
                pending = None
            continue
        if what == 2:
            while scopes and scopes[-1][2] >= depth:
                scopes.pop()
            depth = max(0, depth - 1)
            continue
        begin = offset + len(masked[offset:]) - len(masked[offset:].lstrip()) if masked[offset : offset + 1].isspace() else offset
        if begin >= len(masked) or begin in seen:
            continue
        seen.add(begin)
        kind = scopes[-1][0] if scopes else ""
        level = scopes[-1][2] if scopes else 0
        for rule, pattern in rules:
            if rule.inside is not None and ((rule.inside == () and depth) or (rule.inside and kind not in rule.inside)):
                continue
            if depth > level and rule.kind in ("method", "function", "constructor", "property") and rule.inside != ():
                continue  # inside a body
            m = pattern.match(masked, begin)
            if not m:
                continue
            name = _name_of(rule, m, language)
            if (language != "rust" and name.split("::")[-1].split(".")[-1] in _CONTROL) or masked[begin:].split(None, 1)[0] in _CONTROL:
                continue
            if rule.kind == "constructor" and scopes and name != scopes[-1][1].split(spec.join)[-1]:
                continue
            if language == "objc":
                name, objc_class = _objc_name(rule.kind, name, objc_class)
            elif rule.member and scopes:
                outer = scopes[-1][1].removeprefix("impl ").split(" for ")[-1]
                name = f"{outer}{spec.join}{name}"
            elif rule.kind == "method" and language == "php" and scopes:
                name = f"{scopes[-1][1]}::{name}"
            brace = masked.find("{", m.end() - 1)
            stop = masked.find(";", m.end() - 1)
            has_body = brace >= 0 and (stop < 0 or brace < stop)
            end = _closing(masked, brace) if has_body and language != "objc" else (stop + 1 if stop >= 0 else m.end())
            out.add("module", name, rule.kind, line_at(text, begin), line_at(text, max(begin, end - 1)))
            if rule.scope and has_body:
                pending = (rule.kind, name)
            break
    for m in re.finditer(spec.imports, text, re.M):
        value = next(g for g in m.groups() if g)
        n = line_at(text, m.start() + len(m[0]) - len(m[0].lstrip()))
        if language == "go" and not m[1] and not re.search(r"import\s*\([^)]*$", text[: m.start()]):
            continue
        out.add("import", " ".join(value.split()), "import", n, n)
    for kind, pattern in spec.databases:
        for m in re.finditer(pattern, text):
            n = line_at(text, m.start())
            out.add("database", m[1], kind, n, n)
    return out


def _objc_name(kind: str, name: str, current: str) -> tuple[str, str]:
    if kind == "method":
        sign = name[0]
        body = re.sub(r"\([^)]*\)", " ", name[1:])
        parts = re.findall(r"(\w+)\s*:", body)
        selector = "".join(f"{p}:" for p in parts) if parts else body.split()[0]
        return f"{sign}[{current} {selector}]", current
    name = re.sub(r"\s*\(\s*(\w*)\s*\)", r"(\1)", name)
    return name, name.split("(")[0]


def _closing(masked: str, brace: int) -> int:
    depth = 0
    for m in re.compile(r"[{}]").finditer(masked, brace):
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return m.end()
    return len(masked)


for _language in LANGUAGES:
    extractor(_language)(lambda text, language=_language: declared(text, language))


@extractor("ruby")
def ruby_facts(text: str) -> Analysis:
    """Modules and classes (A::B), methods A#m, singleton methods A.m, requires."""
    out, scopes = Analysis(), []
    openers = re.compile(r"^\s*(?:if|unless|while|until|case|begin|for)\b|\bdo\s*(?:\|[^|]*\|)?\s*$")
    for n, line in enumerate(text.split("\n"), 1):
        code = re.sub(r"#.*$", "", line)
        if m := re.match(r"\s*(module|class)\s+([A-Z][\w:]*)", code):
            name = "::".join([*(s[1] for s in scopes if s[0] in ("module", "class")), m[2]])
            out.add("module", name, m[1], n, n)
            scopes.append((m[1], m[2], len(out.facts) - 1))
        elif m := re.match(r"\s*def\s+(self\.)?([\w?!=]+)", code):
            owner = "::".join(s[1] for s in scopes if s[0] in ("module", "class"))
            out.add("module", f"{owner}{'.' if m[1] else '#'}{m[2]}" if owner else m[2], "singleton_method" if m[1] else "method" if owner else "function", n, n)
            scopes.append(("def", m[2], len(out.facts) - 1))
        elif openers.search(code):
            scopes.append(("block", "", None))
        elif re.match(r"\s*end\b", code) and scopes:
            at = scopes.pop()[2]
            if at is not None:
                out.facts[at].line_end = n
        if m := re.match(r"\s*require(?:_relative)?\s*\(?\s*[\"']([^\"']+)", code):
            out.add("import", m[1], "require", n, n)
    return out


@extractor("shell")
def shell_facts(text: str) -> Analysis:
    """Functions at any depth, and sourced files."""
    out = Analysis()
    lines = text.split("\n")
    for n, line in enumerate(lines, 1):
        if m := re.match(r"\s*(?:function\s+([\w:.-]+)\s*(?:\(\s*\))?|([\w:.-]+)\s*\(\s*\))\s*(\{)?", line):
            depth, end = 0, n
            for i in range(n - 1, len(lines)):
                depth += lines[i].count("{") - lines[i].count("}")
                end = i + 1
                if depth <= 0 and "}" in lines[i]:
                    break
            out.add("module", m[1] or m[2], "function", n, end)
        if m := re.match(r"\s*(?:source|\.)\s+[\"']?([^\s\"';]+)", line):
            out.add("import", m[1], "source", n, n)
    return out
