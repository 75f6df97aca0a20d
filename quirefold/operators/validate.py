"""Diagnostic validation of records against a schema: one row (path, field, message, severity) for each finding.

Every declared field is checked in the same pass over the records; fields that aren't declared never are. References between
tables are checked by one anti-join for each, those between files by looking for the file in the same pass.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions import predicates as P
from quirefold.functions.types import FieldType
from quirefold.sources.schema import FieldDef, Schema

DATE = r"^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])$"
DATETIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}"
FINDING = "path string, field string, message string, severity string"


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def bad_path(path: Column) -> Column:
    """Not a relative path below its root."""
    return (path == "") | path.startswith("/") | F.contains(path, F.lit("\\")) | F.array_contains(F.split(path, "/"), "..")


def mismatch(v: Column, kind: FieldType) -> Column:
    """What is wrong with a value that is present and not null, or NULL."""
    name = P.type_name(v)
    expected = F.concat(F.lit(f"expected {kind}, got "), name)
    text = _text(v)
    if kind.kind in ("string", "boolean"):
        return F.when(name != kind.kind, expected)
    if kind.kind == "float":
        return F.when(name != "number", expected)
    if kind.kind == "integer":
        return F.when(F.schema_of_variant(v) != "BIGINT", expected)
    if kind.kind in ("date", "datetime"):
        shape, want = (DATE, "YYYY-MM-DD") if kind.kind == "date" else (DATETIME, "RFC 3339")
        return F.when(name != "string", expected).when(~text.rlike(shape), F.concat(F.lit(f"invalid {kind.kind} `"), text, F.lit(f"` (expected {want})")))
    if kind.kind == "enum":
        return F.when(name != "string", expected).when(~text.isin(*kind.choices), F.concat(F.lit("`"), text, F.lit(f"` not in: {'|'.join(kind.choices)}")))
    if kind.kind == "ref":
        shown = F.concat(F.lit("reference `"), text, F.lit("`"))
        return F.when(name != "string", expected).when(bad_path(text), F.concat(shown, F.lit(" is empty or has forbidden components"))).when(~text.startswith(f"{kind.target}/"), F.concat(shown, F.lit(f" must target the `{kind.target}` collection")))
    items = F.try_variant_get(v, "$", "array<variant>")
    found = F.transform(items, lambda x, i: F.when(F.coalesce(P.type_name(x), F.lit("null")) == "null", F.concat(F.lit("["), i, F.lit(f"]: expected {kind.item}, got null"))).otherwise(F.concat(F.lit("["), i, F.lit("]: "), mismatch(x, kind.item))))
    return F.when(name != "array", expected).otherwise(F.get(F.filter(found, lambda m: m.isNotNull()), F.lit(0)))


def finding(v: Column, definition: FieldDef) -> Column:
    """The message about one field of one record, or NULL."""
    absent = v.isNull() | (P.type_name(v) == "null")
    out = F.when(absent, F.lit("required field is missing or null") if definition.required else F.lit(None))
    wrong = mismatch(v, definition.type)
    out = out.when(wrong.isNotNull(), wrong)
    if definition.range:
        lo, hi = definition.range
        number = F.try_variant_get(v, "$", "double")
        shown = _text(v)
        out = out.when(F.isnan(number) | (F.abs(number) == float("inf")), F.concat(F.lit("value "), shown, F.lit(" is not finite")))
        out = out.when(~number.between(lo, hi), F.concat(F.lit("value "), shown, F.lit(f" outside range [{lo:g}, {hi:g}]")))
    return out


def _findings(records: DataFrame, schema: Schema, variant_col: str | None) -> list[Column]:
    found = []
    for d in schema.fields:
        if variant_col:
            v = P.field(F.col(variant_col), d.name)
        else:
            v = F.col(f"`{d.name}`").cast("variant") if d.name in records.columns else F.parse_json(F.lit(None).cast("string"))
        found.append(F.struct(F.lit(d.name).alias("field"), finding(v, d).alias("message"), F.lit(None).cast("string").alias("ref")))
    return found


def violations(records: DataFrame, schema: Schema, variant_col: str | None = "frontmatter", path_col: str = "path") -> DataFrame:
    """Errors of all declared fields. Without a VARIANT column the fields are columns, cast to VARIANT one by one."""
    found = _findings(records, schema, variant_col)
    rows = records.select(F.col(path_col).alias("path"), F.explode(F.filter(F.array(*found), lambda x: x["message"].isNotNull())).alias("x")) if found else None
    if rows is None:
        return records.sparkSession.createDataFrame([], FINDING)
    return rows.select("path", "x.field", "x.message", F.lit("error").alias("severity"))


def _ref(v: Column, target: str) -> Column:
    """A well-formed reference to a collection, or NULL."""
    text = F.when(P.type_name(v) == "string", _text(v))
    return F.when(text.isNotNull() & ~bad_path(text) & text.startswith(f"{target}/"), text)


def all_findings(records: DataFrame, schema: Schema, refs: list[FieldDef]) -> DataFrame:
    """(path, field, message, severity, ref) of a permissive read, in one pass: what is wrong with the fields, read errors, and, without a
    message yet, the well-formed references of `refs`."""
    none = F.lit(None).cast("string")
    found = _findings(records, schema, "frontmatter")
    found += [F.struct(F.lit(d.name).alias("field"), none.alias("message"), _ref(P.field(F.col("frontmatter"), d.name), d.type.target).alias("ref")) for d in refs]
    unread = F.struct(F.lit("-").alias("field"), F.concat(F.lit("read error: "), F.col("error")).alias("message"), none.alias("ref"))
    items = F.when(F.col("error").isNotNull(), F.array(unread)).otherwise(F.array(*found)) if found else F.array(unread)
    rows = records.select("path", F.explode(F.filter(items, lambda x: x["message"].isNotNull() | x["ref"].isNotNull())).alias("x"))
    return rows.select("path", "x.field", "x.message", F.lit("error").alias("severity"), "x.ref")


def placed(found: DataFrame, root: str) -> DataFrame:
    """Findings with the references looked up below a database's root: dangling ones, and those whose file lies outside."""

    @F.pandas_udf("string")
    def place(refs):
        def one(ref: str | None) -> str | None:
            if not ref:
                return None
            full = os.path.join(root, ref)
            if not os.path.lexists(full):
                return "missing"
            real = os.path.realpath(full)
            if real != root and not real.startswith(root + os.sep):
                return "outside"
            return "found" if os.path.exists(full) else "unresolved"

        return refs.map(one)

    shown = F.concat(F.lit("reference `"), F.col("ref"), F.lit("` "))
    message = F.when(F.col("place") == "missing", F.concat(shown, F.lit("does not exist (dangling reference)"))).when(F.col("place") == "outside", F.concat(shown, F.lit("resolves outside the database root"))).when(F.col("place") == "unresolved", F.concat(shown, F.lit("cannot be resolved")))
    rows = found.withColumn("place", place("ref")).withColumn("message", F.coalesce("message", message)).where("message IS NOT NULL")
    return rows.select("path", "field", "message", F.when(F.col("place").isin("missing", "unresolved"), "warning").otherwise("error").alias("severity"))


def dangling(records: DataFrame, definition: FieldDef, targets: DataFrame, variant_col: str | None = "frontmatter", path_col: str = "path") -> DataFrame:
    """Warnings for well-formed references to no record; `targets` has the paths of the target collection."""
    v = P.field(F.col(variant_col), definition.name) if variant_col else F.col(f"`{definition.name}`").cast("variant")
    target = definition.type.target
    refs = records.select(F.col(path_col).alias("path"), F.when(P.type_name(v) == "string", _text(v)).alias("ref")).where(F.col("ref").isNotNull() & ~bad_path(F.col("ref")) & F.col("ref").startswith(f"{target}/"))
    known = targets.select(F.concat(F.lit(f"{target}/"), F.col("path")).alias("ref"))
    lost = refs.join(known, "ref", "left_anti")
    return lost.select("path", F.lit(definition.name).alias("field"), F.concat(F.lit("reference `"), F.col("ref"), F.lit("` does not exist (dangling reference)")).alias("message"), F.lit("warning").alias("severity"))


def resolved(records: DataFrame, ref_col: str, targets: DataFrame, target_col: str) -> DataFrame:
    """Rows whose reference exists."""
    return records.join(targets.select(F.col(target_col).alias("__t")).distinct(), F.col(ref_col) == F.col("__t"), "left_semi")


def counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
