"""Record files of a directory as a table.

Folders are listed and files are read by tasks: a folder is listed as a stream, its files are dealt over all cores, and neither
the driver nor one task holds all paths. Rows are (path, frontmatter VARIANT, body, mtime_ns, size, error). A file that can't
be read fails the query, or with mode=PERMISSIVE gives a row with its error. Each action lists and reads anew.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import islice
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.errors import FrontMatterError, RecordError
from quirefold.functions import frontmatter
from quirefold.operators.shared import spread

if TYPE_CHECKING:
    import pyarrow as pa

SCHEMA_FILE = "schema.md"
# Directories that hold no records.
SKIPPED_DIRS = frozenset({"node_modules", "target", "__pycache__"})
READ = "path string, head string, body string, mtime_ns long, size long, error string"
LISTED = 20_000  # paths in a batch
BATCH, BATCH_BYTES = 2_000, 8 << 20  # records in a batch, and their bytes


def entries(root: str, at: str, links: bool = False) -> Iterator[tuple[str, bool]]:
    """(relative path, whether it is a folder) of what a folder holds: record files and folders, or with `links` all links in their place and all folders."""
    try:
        found = os.scandir(os.path.join(root, at))
    except OSError:
        return
    with found:
        for entry in found:
            name = entry.name
            try:
                name.encode()
            except UnicodeEncodeError:
                continue
            if name.startswith(".") and not links:
                continue
            rel = f"{at}/{name}" if at else name
            if entry.is_symlink():
                if links:
                    yield rel, False
            elif entry.is_dir(follow_symlinks=False):
                if links or name not in SKIPPED_DIRS:
                    yield rel, True
            elif not links and entry.is_file(follow_symlinks=False) and name != SCHEMA_FILE:
                yield rel, False


def below(root: str, at: str = "", links: bool = False) -> Iterator[str]:
    """The paths below a folder, at any depth."""
    todo = [at]
    while todo:
        for rel, folder in entries(root, todo.pop(), links):
            if folder:
                todo.append(rel)
            else:
                yield rel


def walk(root: str) -> list[str]:
    """Relative paths of the record files below a directory, ordered by their components."""
    return sorted(below(root), key=lambda p: p.encode().split(b"/"))


def guard(path: str) -> str:
    """A relative path that stays below its root, or an error."""
    if not path or path.startswith("/") or "\\" in path or ".." in path.split("/"):
        raise RecordError(f"not a record path: {path!r}")
    return path


def paths(spark: SparkSession, root: str, links: bool = False) -> DataFrame:
    """(path) of the record files below a directory, dealt over all cores; with `links`, of the links there.

    The directory and each folder of its first level are listed by a task each, what lies deeper by the task that gets its folder.
    """
    root = root.removeprefix("file://")

    def listing(deep: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import pyarrow as pa

            def rows() -> Iterator[tuple[str, bool]]:
                for batch in batches:
                    for rel, folder in zip(batch["path"].to_pylist(), batch["folder"].to_pylist()):
                        if not folder:
                            yield rel, False
                        elif deep:
                            yield from ((p, False) for p in below(root, rel, links))
                        else:
                            yield from entries(root, rel, links)

            found = rows()
            while some := list(islice(found, LISTED)):
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in some]), pa.array([d for _, d in some])], ["path", "folder"])

        return run

    at = spark.createDataFrame([("", True)], "path string, folder boolean")
    for deep in (False, False, True):
        at = spread(at.mapInArrow(listing(deep), at.schema), "path")
    return at.select("path")


def stats(paths: DataFrame, root: str) -> DataFrame:
    """(path, mtime_ns, size) of files, which aren't opened; NULLs for one that is gone."""
    root = root.removeprefix("file://")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        def stat(path: str) -> tuple[int | None, int | None]:
            try:
                found = os.stat(os.path.join(root, path))
            except OSError:
                return None, None
            return found.st_mtime_ns, found.st_size

        for batch in batches:
            found = [stat(p) for p in batch["path"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["path"], pa.array([m for m, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())], ["path", "mtime_ns", "size"])

    return paths.mapInArrow(run, "path string, mtime_ns long, size long")


def read_paths(paths: DataFrame, root: str, mode: str = "FAILFAST", body: str = "true") -> DataFrame:
    """The records at the paths of a table."""
    root, permissive, with_body = root.removeprefix("file://"), mode.upper() == "PERMISSIVE", body.lower() != "false"

    def one(path: str) -> tuple:
        try:
            with open(os.path.join(root, path), "rb", buffering=0) as f:
                raw, stat = f.read(), os.fstat(f.fileno())
            head, text = frontmatter.parse(raw.decode("utf-8"))
            return path, head, text if with_body else None, stat.st_mtime_ns, stat.st_size, None
        except (OSError, UnicodeDecodeError, FrontMatterError) as e:
            if not permissive:
                raise RecordError(f"{path}: {e}") from e
            return path, None, None, None, None, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        kinds = pa.schema([("path", pa.string()), ("head", pa.string()), ("body", pa.string()), ("mtime_ns", pa.int64()), ("size", pa.int64()), ("error", pa.string())])

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(column, k.type) for column, k in zip(zip(*rows), kinds)], schema=kinds)

        rows, held = [], 0
        for batch in batches:
            for path in batch["path"].to_pylist():
                rows.append(one(path))
                held += rows[-1][4] or 0
                if len(rows) == BATCH or held >= BATCH_BYTES:
                    yield packed(rows)
                    rows, held = [], 0
        if rows:
            yield packed(rows)

    return paths.select("path").mapInArrow(run, READ).select("path", F.parse_json("head").alias("frontmatter"), "body", "mtime_ns", "size", "error")


def read_records(spark: SparkSession, root: str, only: str | None = None, **options: str) -> DataFrame:
    """The records of a directory, or one of them. Options: mode, body (false leaves bodies out)."""
    found = paths(spark, root) if only is None else spark.createDataFrame([(only,)], "path string")
    return read_paths(found, root, **options)


def records_from_texts(texts: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """(path, frontmatter VARIANT, body) of records whose contents are a string column."""

    @F.pandas_udf("struct<head: string, body: string>")
    def parsed(content):
        import pandas as pd

        return pd.DataFrame([frontmatter.parse(c) if c is not None else (None, None) for c in content], columns=["head", "body"])

    return texts.select(F.col(path_col).alias("path"), parsed(content_col).alias("p")).select("path", F.parse_json("p.head").alias("frontmatter"), "p.body")
