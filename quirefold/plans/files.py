"""Databases of record files for the registered queries, in the shared folder."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession

from quirefold.operators.shared import fresh, spread
from quirefold.sources.database import Database
from quirefold.sources.records import paths

if TYPE_CHECKING:
    import pyarrow as pa


@dataclass
class Written:
    root: str
    db: Database


def put(made: Written, files: dict[str, str]) -> None:
    for name, text in files.items():
        at = os.path.join(made.root, name)
        os.makedirs(os.path.dirname(os.path.normpath(at)), exist_ok=True)
        with open(os.path.normpath(at), "w", encoding="utf-8") as f:
            f.write(text)


def write(spark: SparkSession, rows: DataFrame, files: dict[str, str]) -> Written:
    """Writes (path, content) rows as the records of `parts`, by tasks on all cores, and a few more files."""
    root = fresh(spark, "db").removeprefix("file://")
    if ":" in root.split("/")[0]:
        raise ValueError("record files need a shared folder that is mounted as a file system")
    os.makedirs(os.path.join(root, "parts"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
                at = os.path.join(root, "parts", path)
                try:
                    f = open(at, "wb")
                except FileNotFoundError:
                    os.makedirs(os.path.dirname(at), exist_ok=True)
                    f = open(at, "wb")
                with f:
                    f.write(content.encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    spread(rows.select("path", "content"), "path").mapInArrow(each, "n long").write.format("noop").mode("overwrite").save()
    made = Written(root, None)
    put(made, files)
    made.db = Database(spark, root)
    return made


def link(made: Written, target: str, name: str) -> None:
    os.symlink(os.path.normpath(os.path.join(made.root, target)), os.path.join(made.root, name))


def generations(made: Written) -> int:
    return len(os.listdir(os.path.join(made.root, "views", ".generations")))


def read_links(spark: SparkSession, made: Written, view: str) -> DataFrame:
    """(link, content) of a published view: what is read through each link."""
    root = os.path.join(made.root, "views", view)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for batch in batches:
            content = []
            for name in batch["path"].to_pylist():
                with open(os.path.join(root, name), encoding="utf-8") as f:
                    content.append(f.read())
            yield pa.RecordBatch.from_arrays([batch["path"], pa.array(content, pa.string())], ["link", "content"])

    return paths(spark, root, links=True).mapInArrow(read, "link string, content string")
