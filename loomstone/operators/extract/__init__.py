"""Facts from source text: a registry of extractors, run over whole tables in Arrow batches.

An extractor is a function of the text that returns an ``Analysis``; the registry maps a language to it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.sources.tables import spread


@dataclass
class Fact:
    """One fact: what it is, its name, and the lines that it spans (1-based; 0: unknown)."""

    fact: str  # module, method, import, database, query, listener, load, subdb, endpoint
    name: str
    kind: str = ""
    line_start: int = 0
    line_end: int = 0
    parent: str | None = None
    detail: str | None = None
    receiver: str | None = None
    dynamic: bool = False


@dataclass
class Analysis:
    facts: list[Fact] = field(default_factory=list)
    error: str | None = None

    def add(self, *args, **kw) -> None:
        self.facts.append(Fact(*args, **kw))


EXTRACTORS: dict[str, Callable[[str], Analysis]] = {}


def extractor(*languages: str):
    """Register a function as the extractor of some languages."""

    def put(f: Callable[[str], Analysis]):
        for language in languages:
            EXTRACTORS[language] = f
        return f

    return put


def analyze(text: str | None, language: str | None) -> Analysis:
    """Facts of one text; an unknown language has none, an extractor's failure becomes ``error``."""
    load()
    f = EXTRACTORS.get(language or "")
    if f is None or not text:
        return Analysis()
    try:
        return f(text)
    except (RecursionError, MemoryError) as problem:
        return Analysis(error=f"{type(problem).__name__}: nested too deeply")


def load() -> None:
    from loomstone.operators.extract import declarations, javascript, nginx, python_source, sql_objects  # noqa: F401


FACTS = "file_id long, fact string, name string, kind string, line_start int, line_end int, parent string, detail string, receiver string, dynamic boolean, error string"
_NAMES = [c.split()[0] for c in FACTS.split(", ")]


def extract_facts(files: DataFrame) -> DataFrame:
    """One row for each fact of files(file_id, language, content), and one for each failed file.

    Write the result once and derive all node and edge tables from it: every branch over an unwritten result
    would parse all files again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for file_id, language, content in zip(*(batch.column(c).to_pylist() for c in ("file_id", "language", "content")), strict=True):
                found = analyze(content, language)
                rows += [(file_id, f.fact, f.name, f.kind, f.line_start, f.line_end, f.parent, f.detail, f.receiver, f.dynamic, None) for f in found.facts]
                if found.error:
                    rows.append((file_id, "error", "", "", 0, 0, None, None, None, False, found.error))
            columns = list(zip(*rows, strict=True)) or [[]] * len(_NAMES)
            types = [pa.int64(), *[pa.string()] * 3, pa.int32(), pa.int32(), *[pa.string()] * 3, pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(columns, types, strict=True)], names=_NAMES)

    return spread(files.select(F.col("file_id").cast("long").alias("file_id"), "language", "content")).mapInArrow(run, FACTS)


def line_at(text: str, offset: int) -> int:
    return text.count("\n", 0, offset) + 1
