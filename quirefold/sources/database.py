"""Databases and collections of record files."""

from __future__ import annotations

import os
import threading
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.errors import CollectionError, DatabaseError, RecordError, SchemaError, ViewError
from quirefold.functions import predicates as P
from quirefold.operators import validate, views
from quirefold.operators.index import PostingIndex, postings_of_records
from quirefold.operators.query import Query
from quirefold.sources.records import SCHEMA_FILE, guard, paths, read_paths, read_records, stats
from quirefold.sources.schema import Schema, parse_schema

INDEX_DIR = ".quirefold-index"
_locks: dict[str, threading.Lock] = {}


@dataclass
class Collection:
    spark: SparkSession
    path: str
    schema: Schema = field(init=False)

    def __post_init__(self) -> None:
        try:
            with open(os.path.join(self.path, SCHEMA_FILE), encoding="utf-8") as f:
                self.schema = parse_schema(f.read())
        except (OSError, UnicodeDecodeError, SchemaError) as e:
            raise CollectionError(f"{self.path}: {e}") from e

    @property
    def name(self) -> str:
        """The schema's name, which may differ from the folder's."""
        return self.schema.collection

    @property
    def folder(self) -> str:
        return os.path.basename(os.path.realpath(self.path)) if os.path.islink(self.path) else os.path.basename(self.path.rstrip("/"))

    def paths(self) -> DataFrame:
        return paths(self.spark, self.path)

    def records(self, **options: str) -> DataFrame:
        return read_records(self.spark, self.path, **options)

    def record(self, rel: str) -> DataFrame:
        """One record by its path."""
        full = os.path.join(self.path, guard(rel))
        root = os.path.realpath(self.path)
        if os.path.islink(full) or not os.path.realpath(full).startswith(root + os.sep):
            raise RecordError(f"not a record path: {rel!r}")
        if not os.path.isfile(full):
            raise RecordError(f"no such record: {rel!r}")
        return self.records(only=rel)

    def query(self) -> Query:
        """A query over the records; one that an index narrows reads its candidates alone."""
        return Query(self.records(), "path", "frontmatter", keyed=self.paths(), read=lambda some: read_paths(some, self.path))

    def build_index(self) -> int:
        """Builds and stores the index beside the records; returns how many were indexed."""
        # Signatures are stored first: a file that changes while it is indexed is stale, not missed.
        index = PostingIndex(postings_of_records(self.records(body="false")), self.signatures())
        index.save(f"file://{os.path.abspath(self.path)}/{INDEX_DIR}")
        return self.load_index().record_count()

    def load_index(self) -> PostingIndex:
        return PostingIndex.load(self.spark, f"file://{os.path.abspath(self.path)}/{INDEX_DIR}")

    def signatures(self) -> DataFrame:
        """(path, mtime_ns, size) of the files as they are now; none is opened."""
        return stats(self.paths(), self.path)

    def validate(self, root: str | None = None) -> DataFrame:
        """Findings of the records by themselves, and records that can't be read, in one pass; with the database's root, references too."""
        rows = self.records(mode="PERMISSIVE", body="false")
        refs = [d for d in self.schema.fields if d.type.kind == "ref"] if root else []
        found = validate.all_findings(rows, self.schema, refs)
        return validate.placed(found, root) if refs else found.drop("ref")


class Database:
    def __init__(self, spark: SparkSession, root: str):
        if not os.path.isdir(root):
            raise DatabaseError(f"not a directory: {root}")
        self.spark, self.root = spark, os.path.realpath(root)
        self._lock = _locks.setdefault(self.root, threading.Lock())

    def collections(self) -> list[str]:
        def is_one(e: os.DirEntry) -> bool:
            return not e.name.startswith(".") and e.name != views.VIEWS and e.is_dir() and os.path.isfile(os.path.join(e.path, SCHEMA_FILE))

        return sorted(e.name for e in os.scandir(self.root) if is_one(e))

    def collections_df(self) -> DataFrame:
        return self.spark.createDataFrame([(n,) for n in self.collections()], "name string")

    def collection(self, name: str) -> Collection:
        if not name or "/" in name or "\\" in name or name in (".", ".."):
            raise DatabaseError(f"not a collection name: {name!r}")
        return Collection(self.spark, os.path.join(self.root, name))

    def materialize_view(self, name: str, collection: Collection, query: Query | None = None, group_by: str | None = None) -> str:
        """Publishes the records of a query over a collection as links, fanned out by a field if one is given."""
        views.check_name(name)
        inside = os.path.relpath(os.path.realpath(collection.path), self.root)
        if inside.startswith(".."):
            raise ViewError("the collection is outside the database")
        rows = (query or collection.query()).to_df()
        groups = real = None
        if group_by is not None:
            v = P.field(F.col("frontmatter"), group_by)
            groups = views.groups_of_variant(v)
            real = F.size(F.filter(F.transform(F.when(P.type_name(v) == "array", F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array(v)), views.value_text), lambda x: x.isNotNull())) > 0
        with self._lock:
            return views.materialize(self.root, name, views.links(rows, inside, groups, real))

    def validate(self, name: str | None = None) -> DataFrame:
        """Findings (collection, path, field, message, severity), references included."""
        out = self.spark.createDataFrame([], "collection string, " + validate.FINDING)
        for n in [name] if name else self.collections():
            try:
                c = self.collection(n)
            except CollectionError as e:
                out = out.unionByName(self.spark.createDataFrame([(n, "-", "-", f"cannot open collection: {e}", "error")], out.schema))
                continue
            found = c.validate(self.root)
            out = out.unionByName(found.withColumn("collection", F.lit(n)).select(out.columns))
        return out
