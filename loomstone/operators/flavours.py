"""Configuration files as outlines: which flavour a file is, and the named parts of each flavour.

A flavour of lines is a ``Layout``: which lines head a group, how entries are named, and which lines join the one
before. One assembler turns any layout into segments. Brackets, tags and indentation have scanners of their own.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import groupby


@dataclass
class Seg:
    kind: str
    name: str
    start: int
    end: int
    children: list[Seg] = field(default_factory=list)


class Text:
    """Lines with their offsets; the end of a line is before its newline."""

    def __init__(self, text: str) -> None:
        self.text, self.lines, self.start = text, text.split("\n"), [0]
        for line in self.lines[:-1]:
            self.start.append(self.start[-1] + len(line) + 1)
        self.bare = [line.strip() for line in self.lines]

    def end(self, i: int) -> int:
        return self.start[i] + len(self.lines[i])

    def blank(self, i: int) -> bool:
        return not self.bare[i]

    def comment(self, i: int) -> bool:
        return self.bare[i][:1] in ("#", ";")

    def lead(self, i: int, least: int = 0) -> int:
        """The first of the comment lines directly above line i, which belong to it."""
        while i > least and self.comment(i - 1):
            i -= 1
        return i

    def last_filled(self, a: int, b: int) -> int:
        """The last line of [a, b) that is not blank; a if there is none."""
        return next((i for i in range(b - 1, a, -1) if self.bare[i]), a)


# What tells a flavour, in this order: flavour, names of files, suffixes, languages, and paths.
FLAVOUR_RULES = (
    ("dockerfile", r"(dockerfile|containerfile)(\..*)?", ".dockerfile", "", ""),
    ("json", "", ".json", "json", ""),
    ("yaml", "", ".yaml .yml", "yaml", ""),
    ("ini", r"\.?gitconfig|\.editorconfig", ".service .timer .socket .mount .automount .target .path .slice .scope .network .netdev .link .desktop .repo .ini .cnf .toml", "toml", ""),
    ("ssh", r"sshd?_config", "", "", r"/\.ssh/config$|/ssh/sshd?_config\.d/"),
    ("lines", r"\.env(\..*)?", ".env", "env", ""),
    ("blocks", "", ".nginx", "", "/nginx/"),
    ("braces", r"logrotate\.conf", "", "", r"/logrotate\.d/"),
    ("tags", "", "", "", "/(apache2|httpd)/"),
    ("lines", r"fstab|hosts|crontab|sudoers|resolv\.conf|sysctl\.conf|limits\.conf|exports|environment|hostname|hosts\.allow|hosts\.deny|modules|crypttab", "", "", r"/etc/(sysctl\.d|security|cron\.d|sudoers\.d|modprobe\.d)/"),
    ("by text", "", ".conf .cfg", "ini", ""),
)

#: Shapes of lines that tell a flavour by its text.
_SHAPES = {
    "opening tag": re.compile(r"\s*<[A-Za-z]\w*\b[^>]*>\s*"), "closing tag": re.compile(r"\s*</[A-Za-z].*"), "opening brace": re.compile(r".*\{\s*(#.*)?"),
    "closing brace": re.compile(r"\s*\}\s*;?\s*"), "section": re.compile(r"\s*\[[^\]]+\]\s*"),
}


def flavour_by_text(text: str) -> str:
    """Tags, braces with or without semicolons, sections, or plain lines: by the shapes that the lines have."""
    shapes: Counter[str] = Counter()
    for line in text.split("\n"):
        shapes.update(name for name, shape in _SHAPES.items() if shape.fullmatch(line))
        code = line.partition("#")[0].strip()
        if code and code not in ("{", "}") and code[-1] != "{":
            shapes["statement"] += 1
            shapes["closed statement"] += code[-1] == ";"
    if shapes["opening tag"] and shapes["closing tag"]:
        return "tags"
    if shapes["opening brace"] and shapes["closing brace"]:
        return "blocks" if 2 * shapes["closed statement"] >= shapes["statement"] else "braces"
    return "ini" if shapes["section"] else "lines"


def config_flavor(path: str, text: str, language: str | None = None) -> str | None:
    """Flavour of a configuration file by path and language, else by its text; None for other files."""
    name = path.rsplit("/", 1)[-1].lower()
    stem, dot, tail = name.rpartition(".")
    suffix = dot + tail if stem else ""
    for flavour, names, suffixes, languages, paths in FLAVOUR_RULES:
        evidence = (names and re.fullmatch(names, name)) or (suffix and suffix in suffixes.split()) or (language and language in languages.split()) or (paths and re.search(paths, path))
        if evidence:
            return flavour_by_text(text) if flavour == "by text" else flavour
    return flavour_by_text(text) if language == "plaintext" and path.startswith("/etc/") else None


@dataclass(frozen=True)
class Layout:
    """A flavour of lines. What stands before the first head is one group (``before`` is its title), paragraphs, or entries alone."""

    group: str = "group"
    entry: str = "entry"
    head: re.Pattern | None = None
    title: Callable[[str], str] = str
    name: Callable[[str], str] = str
    #: Whether a line joins the next one, by the line and the depth of brackets that are open behind it.
    joins: Callable[[str, int], bool] = lambda line, depth: False
    before: str | None = None
    paragraphs: bool = False
    #: Heads are lines wherever they stand; otherwise a line that joins the one before is no head, and groups end with entries.
    strict_heads: bool = True


def _depth(line: str) -> int:
    return sum((c in "[{") - (c in "]}") for c in line)


def _entries(t: Text, a: int, b: int, layout: Layout) -> Iterator[tuple[int, int]]:
    """[first, last] lines of the entries in lines [a, b): no blank lines, no comments; joined lines are one entry."""
    start, depth = None, 0
    for i in range(a, b):
        if start is None:
            if t.blank(i) or t.comment(i):
                continue
            start, depth = i, 0
        depth += _depth(t.lines[i])
        if i + 1 == b or not layout.joins(t.lines[i], depth):
            yield start, i
            start = None


def _children(t: Text, a: int, b: int, layout: Layout) -> list[Seg]:
    return [Seg(layout.entry, layout.name(t.bare[i]), t.start[t.lead(i, a)], t.end(j)) for i, j in _entries(t, a, b, layout)]


def _paragraphs(t: Text, b: int, layout: Layout) -> Iterator[Seg]:
    """Runs of filled lines: a group of entries, one entry, or comments alone; a short comment on top names a run."""
    for blank, run in groupby(range(b), t.blank):
        lines = list(run)
        if blank:
            continue
        a, end = lines[0], lines[-1] + 1
        entries = _children(t, a, end, layout)
        heading = re.sub(r"^[#;]+\s*", "", t.bare[a]) if t.comment(a) else ""
        short = heading if len(heading) <= 40 else ""
        listed = ", ".join([*dict.fromkeys(e.name for e in entries)][:4])
        kind = {0: "comment_block", 1: layout.entry}.get(len(entries), layout.group)
        yield Seg(kind, short or listed or heading or "(comments)", t.start[a], t.end(end - 1), entries if len(entries) > 1 else [])


def outline(t: Text, layout: Layout) -> list[Seg]:
    """The segments of a text by a layout of lines."""
    n = len(t.lines)
    starts = range(n) if layout.strict_heads else [i for i, _ in _entries(t, 0, n, layout)]
    heads = [i for i in starts if layout.head and layout.head.match(t.lines[i])]
    borders = [t.lead(h) for h in heads] + [n]
    out: list[Seg] = []
    first = borders[0]
    if layout.paragraphs:
        out += _paragraphs(t, first, layout)
    elif layout.before is None:
        out += _children(t, 0, first, layout)
    elif filled := [i for i in range(first) if not t.blank(i)]:
        out.append(Seg(layout.group, layout.before, t.start[filled[0]], t.end(filled[-1]), _children(t, filled[0], filled[-1] + 1, layout)))
    for h, a, b in zip(heads, borders, borders[1:], strict=False):
        last = t.last_filled(h, b)
        if layout.strict_heads:
            entries, end = _children(t, h + 1, last + 1, layout), t.end(last)
        else:
            head, *rest = _entries(t, h, b, layout)
            entries = [Seg(layout.entry, layout.name(t.bare[i]), t.start[t.lead(i)], t.end(j)) for i, j in rest]
            end = entries[-1].end if entries else t.end(head[1])
        out.append(Seg(layout.group, layout.title(t.bare[h]), t.start[a], end, entries))
    return out


def _assigned(line: str) -> str:
    """The name of an assignment, a mount point with its device, or the line."""
    if m := re.match(r"(?:export\s+)?([A-Za-z_][\w.\-]*)\s*[=:]", line):
        return m[1]
    words = line.split()
    return f"{words[1]} ({words[0]})" if len(words) > 1 and words[1].startswith("/") else line[:60]


def _key(line: str) -> str:
    m = re.match(r"([^=:\s]+)\s*[=:]", line)
    return m[1] if m else line[:40]


def _one_line(line: str) -> str:
    return " ".join(re.sub(r"\\\s*$", "", line).split())


_LINES = Layout(name=_assigned, paragraphs=True)
LAYOUTS = {
    "lines": _LINES,
    "ini": Layout("section", head=re.compile(r"\s*\[\[?[^\]]+\]\]?\s*(#.*)?$"), title=lambda x: re.sub(r"\s*#.*$", "", x), name=_key, joins=lambda x, depth: depth > 0 or x.rstrip().endswith("\\"), before="(top)"),
    "dockerfile": Layout("stage", "instruction", re.compile(r"\s*FROM(?![A-Za-z])", re.IGNORECASE), _one_line, _one_line, lambda x, _: x.rstrip().endswith("\\"), strict_heads=False),
}
_SSH = Layout("block", "directive", re.compile(r"\s*(Host|Match)\s+\S", re.IGNORECASE), lambda x: " ".join(x.split()), lambda x: x.split()[0])


def _ssh_flavor(t: Text) -> list[Seg]:
    """Global directives as paragraphs, then blocks of hosts and matches."""
    found = outline(t, _SSH)
    blocks = [x for x in found if x.kind == _SSH.group]
    end = next((i for i in range(len(t.lines)) if blocks and t.start[i] >= blocks[0].start), len(t.lines))
    return [*_paragraphs(t, end, _LINES), *blocks]


def _indent_flavor(t: Text) -> list[Seg]:
    """YAML by indentation: an entry holds the deeper lines below it, three levels in all; names are paths from the top."""
    indent = [len(x) - len(x.lstrip(" ")) for x in t.lines]
    note = [x.startswith("#") for x in t.bare]
    entry = [bool(re.match(r"-(\s|$)|(\"[^\"]*\"|'[^']*'|[^\s#][^:#]*?)\s*:(\s|$)", x)) and not c for x, c in zip(t.bare, note, strict=True)]

    def name(line: str) -> str:
        item = re.match(r"-\s*([^:#]+?)\s*:\s*(.*)$", line)
        if line.startswith("-"):
            return (item[2].strip() if item[1] == "name" else f"- {item[1]}") if item else line[:50]
        key = re.match(r"(\"[^\"]*\"|'[^']*'|[^:#]+?)\s*:", line)
        return key[1].strip("\"'") if key else line[:50]

    def level(a: int, b: int, depth: int, path: str, more: int) -> list[Seg]:
        heads = [i for i in range(a, b) if (entry[i] and indent[i] == depth) or (not depth and t.lines[i].startswith("---"))]
        leads = [next((j + 1 for j in range(i - 1, a - 1, -1) if not note[j]), a) if not t.lines[i].startswith("---") else i for i in heads]
        out = []
        for h, lead, stop in zip(heads, leads, [*leads[1:], b], strict=False):
            if t.lines[h].startswith("---") and not depth:
                out.append(Seg("document", "---", t.start[h], t.end(h)))
                continue
            # Blank lines and comments that are not deeper than the entry do not belong to its end.
            last = next((i for i in range(stop - 1, h, -1) if t.bare[i] and not (note[i] and indent[i] <= depth)), h)
            own = f"{path}.{name(t.bare[h])}" if path else name(t.bare[h])
            inner = next((indent[i] for i in range(h + 1, last + 1) if t.bare[i] and not note[i]), -1)
            children = level(h + 1, last + 1, inner, own, more - 1) if inner > depth and more else []
            out.append(Seg("item" if t.bare[h].startswith("-") else "mapping", own[:80], t.start[lead], t.end(last), children))
        return out

    return level(0, len(t.lines), 0, "", 2)


def _json_flavor(t: Text) -> list[Seg]:
    """Top-level members of an object or array, by a scanner over strings and brackets."""
    text = t.text
    top = re.match(r"\s*[\[{]", text)
    if not top:
        return [Seg("value", "(value)", 0, len(text))] if text.strip() else []
    try:
        json.loads(text)
    except ValueError:
        return [Seg("block", "(invalid)", 0, len(text))]
    out, depth, begin, at, index = [], 0, None, top.end(), 0
    is_object = text[top.end() - 1] == "{"
    for m in re.compile(r'"(?:\\.|[^"\\])*"|[\[\]{},]|[^\s"\[\]{},]+').finditer(text, at):
        c = m[0]
        if begin is None and not (depth == 0 and c in "]},"):
            begin = m.start()
        if depth == 0 and c in ",]}":
            if begin is not None:
                body = text[begin : m.start()].rstrip()
                key = re.match(r'"((?:\\.|[^"\\])*)"', body)
                out.append(Seg("mapping" if is_object else "item", key[1] if is_object and key else f"[{index}]", begin, begin + len(body)))
                index += 1
            begin = None
            if c != ",":
                break
        depth += (c in "[{") - (c in "]}")
    return out


def _brace_flavor(t: Text, a: int = 0, b: int | None = None, depth: int = 0, ends: str = ";") -> list[Seg]:
    """Blocks in braces; statements end with a semicolon, or (ends = newline) with their line."""
    text, out, begin = t.text, [], None
    b = len(text) if b is None else b
    pattern = re.compile(r"#[^\n]*|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|[{};\n]|[^\s{};#\"']+")
    pos, open_ = a, []
    for m in iter(lambda: pattern.search(text, pos, b), None):
        pos, c = m.end(), m[0]
        if c[0] == "#" or (c == "\n" and (begin is None or ends != "\n" or open_)):
            continue
        if c == "{":
            open_.append(m.start())
        elif c == "}" and open_:
            head = open_.pop()
            if not open_ and begin is not None:
                kids = _brace_flavor(t, head + 1, m.start(), depth + 1, ends) if depth < 3 else []
                out.append(Seg("block", " ".join(text[begin:head].split())[:60] or "(block)", begin, m.end(), kids))
                begin = None
        elif not open_ and c in (";", "\n"):
            if begin is not None:
                stop = m.end() if c == ";" else m.start()
                out.append(Seg("directive", " ".join(text[begin : m.start()].split())[:60], begin, stop))
            begin = None
        elif begin is None and c not in ";}":
            begin = m.start()
    if begin is not None:
        out.append(Seg("directive", " ".join(text[begin:b].split())[:60], begin, begin + len(text[begin:b].rstrip())))
    return out


def _tag_flavor(t: Text) -> list[Seg]:
    out, stack = [], []
    for i, line in enumerate(t.lines):
        s = line.strip()
        if not s or s.startswith("#"):
            continue
        if m := re.match(r"<([A-Za-z]\w*)\b([^>]*)>$", s):
            stack.append(Seg("block", f"{m[1]}{m[2]}".strip(), t.start[t.lead(i)], t.end(i)))
        elif s.startswith("</") and stack:
            done = stack.pop()
            done.end = t.end(i)
            (stack[-1].children if stack else out).append(done)
        else:
            (stack[-1].children if stack else out).append(Seg("directive", s.split()[0], t.start[t.lead(i)] if not stack else t.start[i], t.end(i)))
    while stack:  # blocks that nothing closes end with what they hold
        done = stack.pop()
        done.end = max([done.end, *(c.end for c in done.children)])
        (stack[-1].children if stack else out).append(done)
    return out


FLAVORS: dict[str, Callable[[Text], list[Seg]]] = {
    **{name: lambda t, layout=layout: outline(t, layout) for name, layout in LAYOUTS.items()},
    "ssh": _ssh_flavor,
    "yaml": _indent_flavor,
    "json": _json_flavor,
    "blocks": _brace_flavor,
    "braces": lambda t: _brace_flavor(t, ends="\n"),
    "tags": _tag_flavor,
}
