"""SQL files: objects that CREATE statements name."""

from __future__ import annotations

import re

from loomstone.operators.extract import Analysis, extractor, line_at

_OBJECTS = re.compile(r"\bcreate\s+(?:or\s+replace\s+)?(?:(?:temp|temporary|unique|materialized)\s+)*(table|view|procedure|function|index|trigger)\s+(?:if\s+not\s+exists\s+)?([\"`\[]?[\w.]+[\"`\]]?(?:\.[\"`\[]?\w+[\"`\]]?)?)", re.I)


@extractor("sql")
def sql_facts(text: str) -> Analysis:
    out = Analysis()
    for m in _OBJECTS.finditer(text):
        n = line_at(text, m.start())
        out.add("module", m[2].strip('"`[]'), m[1].lower(), n, n)
    return out
