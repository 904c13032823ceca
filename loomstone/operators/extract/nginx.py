"""nginx: server and upstream blocks, includes, and endpoints that are listened on or passed to."""

from __future__ import annotations

import re
from collections.abc import Iterator

from loomstone.operators.extract import Analysis, extractor

_TOKEN = re.compile(r"#[^\n]*|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|[{};]|[^\s{};\"'#]+|\n")
PASSES = {"proxy_pass": "server", "fastcgi_pass": "server", "grpc_pass": "server", "uwsgi_pass": "server", "scgi_pass": "server"}


def _statements(text: str) -> Iterator[tuple[list[str], str, int]]:
    """(words, what ends them, line of the first)."""
    words, line, first = [], 1, 1
    for m in _TOKEN.finditer(text):
        token = m[0]
        if token == "\n":
            line += 1
        elif token in "{};":
            yield words, token, first if words else line
            words = []
        elif token[0] != "#":
            if not words:
                first = line
            words.append(token.strip("\"'"))
            line += token.count("\n")


@extractor("nginx")
def nginx_facts(text: str) -> Analysis:
    out, stack = Analysis(), []
    ends: dict[int, int] = {}
    for words, end, line in _statements(text):
        if end == "{":
            stack.append((words, line, len(out.facts)))
            if words and words[0] in ("server", "upstream"):
                out.add("module", words[1] if len(words) > 1 else "server", words[0], line, line)
            continue
        if end == "}":
            if stack:
                block, _, at = stack.pop()
                if block and block[0] in ("server", "upstream"):
                    ends[at] = line
            continue
        if not words:
            continue
        inside = [s[0][0] for s in stack if s[0]]
        if words[0] == "include" and len(words) > 1:
            out.add("import", words[1], "include", line, line)
        elif words[0] == "server_name" and "server" in inside and len(words) > 1:
            at = next(s[2] for s in reversed(stack) if s[0] and s[0][0] == "server")
            out.facts[at].name = words[1]
        elif words[0] == "listen" and len(words) > 1:
            out.add("endpoint", re.sub(r"^(?=\d+$)", "0.0.0.0:", words[1]), "port", line, line, detail="listen")
        elif words[0] in PASSES and len(words) > 1:
            target = re.sub(r"^\w+://", "", words[1]).split("/")[0] if not words[1].startswith("unix:") else words[1]
            out.add("endpoint", target, PASSES[words[0]], line, line, detail=words[0])
        elif words[0] == "server" and inside[-1:] == ["upstream"] and len(words) > 1:
            out.add("endpoint", words[1], "server", line, line, detail="upstream")
    for at, line in ends.items():
        out.facts[at].line_end = line
    return out
