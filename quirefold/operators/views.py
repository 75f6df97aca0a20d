"""Materialized views: matching records, fanned out by the values of a field, published atomically.

A view is built in a generation folder of its own and then becomes visible in one rename of a link; readers see the old
generation or the new one. Links are made by the tasks that hold their rows. The folder must be a file system that has links and that
all executors share; elsewhere publish_table() writes the same rows as a partitioned dataset.
"""

from __future__ import annotations

import itertools
import os
import shutil
import time
from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.errors import ViewError
from quirefold.functions import predicates as P

if TYPE_CHECKING:
    import pyarrow as pa

UNGROUPED = "_ungrouped"
VIEWS, GENERATIONS = "views", ".generations"
LONGEST = 240
_serial = itertools.count()


def check_name(name: str) -> str:
    if not name or "/" in name or "\\" in name or name.startswith("."):
        raise ViewError(f"not a view name: {name!r}")
    return name


def value_text(v: Column) -> Column:
    """A VARIANT scalar as group text; NULL for null, mappings and nested arrays. 4, 4.0 and "4" are one group."""
    kind = P.type_name(v)
    whole = F.schema_of_variant(v) == "BIGINT"
    number = F.try_variant_get(v, "$", "double")
    as_number = F.when(whole, F.try_variant_get(v, "$", "bigint").cast("string")).otherwise(F.coalesce(F.when(number.cast("decimal(38,0)").cast("double") == number, number.cast("decimal(38,0)").cast("string")), F.regexp_replace(F.try_variant_get(v, "$", "string"), r"\.0+$", "")))
    return F.when(kind == "string", F.try_variant_get(v, "$", "string")).when(kind == "boolean", F.try_variant_get(v, "$", "boolean").cast("string")).when(kind == "number", as_number)


def groups_of_variant(v: Column) -> Column:
    """Distinct group texts of a field, `_ungrouped` where there are none."""
    items = F.when(P.type_name(v) == "array", F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array(v))
    return _or_ungrouped(F.array_distinct(F.filter(F.transform(items, value_text), lambda x: x.isNotNull())))


def groups_of_column(df: DataFrame, field: str) -> Column:
    """The same for a column of a table."""
    kind = df.schema[field].dataType
    name = kind.typeName()
    if name == "array":
        return _or_ungrouped(F.array_distinct(F.filter(F.transform(field, lambda x: x.cast("string")), lambda x: x.isNotNull())))
    if name in ("double", "float"):
        return _or_ungrouped(F.filter(F.array(value_text(F.col(field).cast("double").cast("variant"))), lambda x: x.isNotNull()))
    return _or_ungrouped(F.filter(F.array(F.col(field).cast("string")), lambda x: x.isNotNull()))


def _or_ungrouped(found: Column) -> Column:
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(UNGROUPED)))


def encode_segment(text: Column) -> Column:
    """Percent-encoding of all bytes but `A-Z a-z 0-9 . _ ~ -`."""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def segment(group: Column, real: Column) -> Column:
    """The folder name of a group; an error for names that can't be one. `real` tells a value from the ungrouped bucket."""
    coded = encode_segment(group)
    bad = F.when(real & (group == UNGROUPED), F.lit("is reserved")).when(group == "", F.lit("is empty")).when(group.isin(".", ".."), F.lit("is not a name")).when(F.octet_length(coded) > LONGEST, F.lit("is too long"))
    return F.when(bad.isNull(), coded).otherwise(F.raise_error(F.concat(F.lit("group value `"), F.coalesce(group, F.lit("")), F.lit("` "), bad)).cast("string"))


def link_target(collection: str, path: Column, grouped: bool) -> Column:
    """Relative target of a record's link: up from the link's own depth, then down to the record."""
    depth = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))) + (4 if grouped else 3)
    return F.concat(F.repeat(F.lit("../"), depth), F.lit(f"{collection}/"), path)


def fan_out(rows: DataFrame, groups: Column, path_col: str = "path") -> DataFrame:
    """(group, path): a row for each distinct group of each row."""
    return rows.select(F.col(path_col).alias("path"), F.explode(groups).alias("group")).select("group", "path")


def group_counts(fanned: DataFrame) -> DataFrame:
    return fanned.groupBy("group").agg(F.count(F.lit(1)).alias("n"))


def links(rows: DataFrame, collection: str, groups: Column | None = None, has_values: Column | None = None) -> DataFrame:
    """(link, target) of a view, links relative to the view."""
    if groups is None:
        return rows.select(F.col("path").alias("link"), link_target(collection, F.col("path"), False).alias("target"))
    fanned = rows.select("path", F.explode(groups).alias("group"), (has_values if has_values is not None else F.lit(True)).alias("real"))
    return fanned.select(F.concat(segment(F.col("group"), F.col("real")), F.lit("/"), F.col("path")).alias("link"), link_target(collection, F.col("path"), True).alias("target"))


def _again(target: str, at: str) -> None:
    """Makes a link, also where a task that runs again finds its own."""
    if os.path.lexists(at):
        os.unlink(at)
    os.symlink(target, at)


def materialize(root: str, name: str, table: DataFrame) -> str:
    """Publishes (link, target) rows as the view `name`; returns its generation. An error leaves the old view in place."""
    check_name(name)
    views = os.path.join(root, VIEWS)
    generation = os.path.join(views, GENERATIONS, f"gen-{time.time_ns()}-{next(_serial)}")
    os.makedirs(generation)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for link, target in zip(batch["link"].to_pylist(), batch["target"].to_pylist()):
                at = os.path.join(generation, link)
                try:
                    os.symlink(target, at)
                except FileNotFoundError:
                    os.makedirs(os.path.dirname(at), exist_ok=True)
                    _again(target, at)
                except FileExistsError:
                    _again(target, at)
            yield batch.select(["link"])

    try:
        table.select("link", "target").mapInArrow(make, "link string").write.format("noop").mode("overwrite").save()
        swap = os.path.join(views, f".swap-{os.path.basename(generation)}")
        os.symlink(os.path.join(GENERATIONS, os.path.basename(generation)), swap)
        try:
            os.replace(swap, os.path.join(views, name))
        except OSError:
            os.unlink(swap)
            raise
    except Exception:
        shutil.rmtree(generation, ignore_errors=True)
        raise
    collect_garbage(root)
    return generation


def collect_garbage(root: str) -> list[str]:
    """Removes generations that no view points to and links that a broken swap left."""
    views = os.path.join(root, VIEWS)
    used, gone = set(), []
    for e in os.scandir(views):
        if e.is_symlink():
            if e.name.startswith(".swap-"):
                os.unlink(e.path)
            else:
                used.add(os.path.basename(os.readlink(e.path)))
    for e in os.scandir(os.path.join(views, GENERATIONS)):
        if e.name.startswith("gen-") and e.name not in used:
            shutil.rmtree(e.path, ignore_errors=True)
            gone.append(e.name)
    return gone


def publish_table(fanned: DataFrame, folder: str, view: str) -> None:
    """The same view without links: a generation partitioned by group, and a catalog view that is replaced to point to it."""
    spark = fanned.sparkSession
    generation = f"{folder.rstrip('/')}/gen-{time.time_ns()}-{next(_serial)}"
    fanned.withColumn("segment", encode_segment(F.col("group"))).write.partitionBy("segment").parquet(generation)
    spark.read.parquet(generation).createOrReplaceTempView(view)
