"""Trees of files as tables: folders are listed in tasks, level by level, and files are read only after what is not wanted is filtered out.

Spark's own file readers leave out empty files and all whose names begin with ``_`` or ``.``, which trees of sources are full of.
Each level of folders is one job, so its folders spread over all tasks whatever shape the tree has; a folder that ``descend`` refuses
is not listed. One folder is listed by one task. Symbolic links are not followed; folders and files that may not be read or are gone,
and names that are not UTF-8, are left out. The tree must lie where tasks can open it: a path that all machines share, or a URI that
pyarrow's file systems know.
"""

from __future__ import annotations

import datetime
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.sources.scratch import cut, discard

#: Folders of a task, bytes of files that a task reads, and bytes of contents that a batch holds before it is handed on.
FOLDERS_PER_TASK = 1_000
BYTES_PER_TASK = 64 << 20
BYTES_PER_BATCH = 16 << 20
ENTRIES_PER_BATCH = 10_000

_ENTRY = pa.schema([("path", pa.string()), ("is_folder", pa.bool_()), ("size", pa.int64()), ("modified", pa.timestamp("us", "UTC"))])
_ENTRIES = "path string, is_folder boolean, size long, modified timestamp"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path and not path.startswith("file:"):
        system, top = fs.FileSystem.from_uri(path)
        return system, top.rstrip("/")
    return fs.LocalFileSystem(), os.path.abspath(re.sub("^file:/+", "/", path)).rstrip("/")


def _entries(system: fs.FileSystem, folder: str) -> Iterator[tuple[str, bool, int | None, datetime.datetime | None]]:
    """(name, is_folder, size, modified) of a folder's entries."""
    utc = datetime.timezone.utc
    if isinstance(system, fs.LocalFileSystem):
        try:
            with os.scandir(folder) as found:
                for entry in found:
                    try:
                        if entry.is_dir(follow_symlinks=False):
                            yield entry.name, True, None, None
                        elif entry.is_file(follow_symlinks=False):
                            stat = entry.stat(follow_symlinks=False)
                            yield entry.name, False, stat.st_size, datetime.datetime.fromtimestamp(stat.st_mtime, utc)
                    except OSError:
                        continue
        except OSError:
            return
    else:
        try:
            found = system.get_file_info(fs.FileSelector(folder))
        except (FileNotFoundError, PermissionError):
            return
        for info in found:
            if info.type in (fs.FileType.Directory, fs.FileType.File):
                yield info.base_name, info.type == fs.FileType.Directory, info.size, info.mtime


def _is_text(name: str) -> bool:
    try:
        name.encode()
    except UnicodeEncodeError:
        return False
    return True


def _lister(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = _opened(path)
        rows: list[tuple] = []
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                for name, *rest in _entries(system, f"{top}/{folder}".rstrip("/") or "/"):
                    if _is_text(name):
                        rows.append((f"{folder}/{name}" if folder else name, *rest))
                    if len(rows) >= ENTRIES_PER_BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _ENTRY, strict=True)], schema=_ENTRY)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _ENTRY, strict=True)], schema=_ENTRY)

    return run


def list_tree(spark: SparkSession, path: str, descend: Callable[[Column], Column] | None = None) -> DataFrame:
    """(path, size, modified) of all files below a folder, paths relative to it; ``descend``: which folders are entered, by their path.

    FileNotFoundError where there is no such folder.
    """
    system, top = _opened(path)
    if system.get_file_info(top or "/").type != fs.FileType.Directory:
        raise FileNotFoundError(f"{path} is no folder")
    cores = spark.sparkContext.defaultParallelism
    level, levels = spark.createDataFrame([("",)], "path string"), []
    while True:
        listed = cut(level.mapInArrow(_lister(path), _ENTRIES), "listing")
        levels.append(listed)
        folders = listed.where("is_folder").select("path")
        folders = folders if descend is None else folders.where(descend(F.col("path")))
        n = folders.count()
        if not n:
            break
        level = folders.repartition(max(min(n, 4 * cores), n // FOLDERS_PER_TASK), "path")
    files = levels[0]
    for table in levels[1:]:
        files = files.unionAll(table)
    files = cut(files.where("NOT is_folder").drop("is_folder").coalesce(max(cores, len(levels))), "tree")
    discard(*levels)
    return files


def with_content(files: DataFrame, path: str, text_only: bool = True) -> DataFrame:
    """``files`` of ``list_tree`` below ``path``, or some of them, with their content; files that are gone meanwhile are left out.

    ``text_only``: content as text, null where it is not UTF-8; else as bytes. A file is one value, so at most 2 GB.
    """
    total = files.agg(F.sum("size")).first()[0] or 0
    tasks = max(files.sparkSession.sparkContext.defaultParallelism, -(-total // BYTES_PER_TASK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = _opened(path)
        for batch in batches:
            names, at, held, contents = batch.column(batch.schema.get_field_index("path")).to_pylist(), 0, 0, []
            for i, name in enumerate(names):
                try:
                    with system.open_input_stream(f"{top}/{name}") as file:
                        contents.append(file.read())
                except (FileNotFoundError, PermissionError):
                    contents.append(None)
                held += len(contents[-1] or b"")
                if held >= BYTES_PER_BATCH or i == len(names) - 1:
                    part = batch.slice(at, len(contents))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(contents, pa.binary())], names=[*batch.schema.names, "content"])
                    at, held, contents = i + 1, 0, []

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema), "content binary"])
    rows = files.repartition(tasks, "path").mapInArrow(run, schema).where("content IS NOT NULL")
    return rows.withColumn("content", F.try_validate_utf8(F.col("content").cast("string"))) if text_only else rows
