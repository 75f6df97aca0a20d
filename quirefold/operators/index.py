"""A secondary index: a table of postings (field, typed key, path), and the signatures of what was indexed.

Integers keep an exact key beside their double, so a look-up never misses. An index narrows a query to candidate paths
by semi-joins; the query's filters are applied to the candidates again, so a stale index gives no false match.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirefold.errors import IndexError_
from quirefold.functions import predicates as P

VERSION = 1
SERVED = ("eq", "contains", "lt", "le", "gt", "ge")
SELECTIVE = 16  # an index is used if its candidates times this are at most the records


def _keys(v: Column) -> list[Column]:
    kind = P.type_name(v)
    return [
        F.when(kind == "number", "n").when(kind == "string", "s").when(kind == "boolean", "b").alias("ktype"),
        F.when(F.schema_of_variant(v) == "BIGINT", F.try_variant_get(v, "$", "bigint")).alias("k_long"),
        F.when(kind == "number", F.try_variant_get(v, "$", "double")).alias("k_dbl"),
        F.when(kind == "string", F.try_variant_get(v, "$", "string")).alias("k_str"),
        F.when(kind == "boolean", F.try_variant_get(v, "$", "boolean")).alias("k_bool"),
    ]


def postings_of_records(records: DataFrame) -> DataFrame:
    """(field, ktype, k_long, k_dbl, k_str, k_bool, path): one row for each scalar and each array element; null and mappings have none."""
    fields = records.sparkSession.sql("SELECT r.path, f.key AS field, f.value AS v FROM {r} AS r, LATERAL variant_explode(r.frontmatter) AS f", r=records.select("path", "frontmatter").where(F.schema_of_variant("frontmatter").startswith("OBJECT")))
    one = F.when(P.type_name(F.col("v")) == "array", F.try_variant_get("v", "$", "array<variant>")).otherwise(F.array("v"))
    values = fields.select("path", "field", F.explode(one).alias("v"))
    return values.select("field", *_keys(F.col("v")), "path").where("ktype IS NOT NULL").distinct()


def postings_of_table(table: DataFrame, path_col: str, fields: list[str]) -> DataFrame:
    """The same for columns of a table, without VARIANT."""
    parts = []
    for name in fields:
        kind = table.schema[name].dataType
        rows = table.select(F.col(path_col).cast("string").alias("path"), (F.explode(name) if isinstance(kind, T.ArrayType) else F.col(name)).alias("v"))
        kind = kind.elementType if isinstance(kind, T.ArrayType) else kind
        none = lambda t: F.lit(None).cast(t)
        text, flag, number = (isinstance(kind, T.StringType), isinstance(kind, T.BooleanType), isinstance(kind, P.NUMERIC))
        if not (text or flag or number):
            continue
        parts.append(rows.where("v IS NOT NULL").select(F.lit(name).alias("field"), F.lit("s" if text else "b" if flag else "n").alias("ktype"), (F.col("v").cast("long") if isinstance(kind, P.WHOLE) else none("long")).alias("k_long"), (F.col("v").cast("double") if number else none("double")).alias("k_dbl"), (F.col("v") if text else none("string")).alias("k_str"), (F.col("v") if flag else none("boolean")).alias("k_bool"), "path").distinct())
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def key_predicate(op: str, value: Any) -> Column:
    kind = P.kind_of(value)
    test = (lambda c, v: c == v) if op in ("eq", "contains") else P.RANGES[op]
    if kind == "number":
        exact = isinstance(value, int) and -(2**63) <= value < 2**63
        by_double = test(F.col("k_dbl"), F.lit(float(value))) & ~F.isnan("k_dbl")
        hit = F.when(F.col("k_long").isNotNull(), test(F.col("k_long"), F.lit(value))).otherwise(by_double) if exact else by_double
        return (F.col("ktype") == "n") & hit
    column = "k_str" if kind == "string" else "k_bool"
    return (F.col("ktype") == kind[0]) & test(F.col(column), F.lit(value))


@dataclass
class PostingIndex:
    postings: DataFrame
    signatures: DataFrame  # (path, mtime_ns, size)

    @classmethod
    def build(cls, records: DataFrame) -> PostingIndex:
        return cls(postings_of_records(records), _signatures(records))

    @classmethod
    def of_table(cls, table: DataFrame, path_col: str, fields: list[str]) -> PostingIndex:
        paths = table.select(F.col(path_col).cast("string").alias("path")).distinct()
        return cls(postings_of_table(table, path_col, fields), paths.select("path", F.lit(0).cast("long").alias("mtime_ns"), F.lit(0).cast("long").alias("size")))

    def record_count(self) -> int:
        return self.signatures.count()

    def posting(self, field: str, op: str, value: Any) -> DataFrame:
        """Paths that hold a value for which the op is true."""
        return self.postings.where((F.col("field") == field) & key_predicate(op, value)).select("path").distinct()

    def candidates(self, filters: tuple[tuple[str, str, Any], ...]) -> DataFrame | None:
        """Paths that all serviceable filters allow, or None if there is none of these."""
        served = [f for f in filters if f[1] in SERVED and not isinstance(f[2], (tuple, list))]
        out = None
        for f in served:
            found = self.posting(*f)
            out = found if out is None else out.join(found, "path", "left_semi")
        return out

    def selected(self, filters: tuple[tuple[str, str, Any], ...], always: bool = False) -> DataFrame | None:
        """The candidates if the index is selective enough, or None where all rows are to be read."""
        found = self.candidates(filters)
        return found if found is not None and (always or found.count() * SELECTIVE <= self.record_count()) else None

    def narrow(self, rows: DataFrame, path_col: str, filters: tuple[tuple[str, str, Any], ...], always: bool = False) -> DataFrame:
        """The rows that can match: a semi-join if the index is selective enough, else all rows."""
        found = self.selected(filters, always)
        return rows if found is None else rows.join(found.withColumnRenamed("path", "__path"), F.col(path_col) == F.col("__path"), "left_semi")

    def save(self, folder: str) -> None:
        """Writes a new generation of the index. Postings are sorted by field and key, so that a look-up skips most row groups; the
        version is written last and makes the generation the current one. Readers of an older one are not disturbed, and a
        write that fails leaves the older one current."""
        at = f"{folder.rstrip('/')}/gen-{time.time_ns()}-{uuid.uuid4().hex[:8]}"
        self.signatures.write.parquet(f"{at}/signatures")
        self.postings.repartitionByRange("field", "ktype", "k_dbl", "k_str").sortWithinPartitions("field", "ktype", "k_dbl", "k_str").write.parquet(f"{at}/postings")
        self.postings.sparkSession.range(1).select(F.lit(VERSION).alias("version"), F.lit(at).alias("at")).write.parquet(f"{at}/version")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> PostingIndex:
        """The newest whole generation in a folder."""
        found = spark.read.parquet(f"{folder.rstrip('/')}/gen-*/version").orderBy(F.desc(F.regexp_extract("at", "gen-([0-9]+)-[^/]*$", 1).cast("long"))).first()
        if found is None or found["version"] != VERSION:
            raise IndexError_(f"an index of another version: {folder}")
        return cls(spark.read.parquet(f"{found['at']}/postings"), spark.read.parquet(f"{found['at']}/signatures"))

    def reconcile(self, changed: DataFrame, current: DataFrame) -> PostingIndex:
        """The index after the paths in `changed` were added, edited or removed; `current` has their records now."""
        changed = changed.select("path").distinct()
        now = current.join(changed, "path", "left_semi")
        return PostingIndex(self.postings.join(changed, "path", "left_anti").unionByName(postings_of_records(now)), self.signatures.join(changed, "path", "left_anti").unionByName(_signatures(now)))

    def stale(self, signatures: DataFrame) -> DataFrame:
        """Paths that were added, removed or changed since the index was built."""
        now = signatures.select("path", F.col("mtime_ns").alias("m"), F.col("size").alias("s"))
        both = self.signatures.join(now, "path", "full_outer")
        return both.where(~(F.col("mtime_ns").eqNullSafe(F.col("m")) & F.col("size").eqNullSafe(F.col("s"))) | F.col("m").isNull() | F.col("mtime_ns").isNull()).select("path")

    def is_fresh(self, signatures: DataFrame) -> bool:
        return self.stale(signatures).isEmpty()


def _signatures(records: DataFrame) -> DataFrame:
    have = [c if c in records.columns else F.lit(0).cast("long").alias(c) for c in ("mtime_ns", "size")]
    return records.select("path", *have)
