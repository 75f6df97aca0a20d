"""Typed predicates as Spark columns, over native columns and over VARIANT fields.

A missing field (SQL NULL) matches nothing. Values of different types are never equal and never ordered, so `ne` is true and
ranges are false; for native columns that is decided from the schema, so what remains is pushed down to the scan.
NaN equals nothing and is not ordered.
"""

from __future__ import annotations

import math
from datetime import date, datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANGES = {"lt": lambda c, v: c < v, "le": lambda c, v: c <= v, "gt": lambda c, v: c > v, "ge": lambda c, v: c >= v}
OPS = ("eq", "ne", *RANGES, "contains", "contains_any", "contains_all")
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
NUMERIC = (*WHOLE, T.FloatType, T.DoubleType, T.DecimalType)


def _false() -> Column:
    return F.lit(False)


def kind_of(value: Any) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, str):
        return "string"
    if isinstance(value, (date, datetime)):
        return "time"
    raise TypeError(f"no literal of type {type(value).__name__}")


def _kind_of_type(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, NUMERIC):
        return "number"
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        return "string"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "time"
    return "other"


def _native(col: Column, kind: T.DataType, value: Any) -> tuple[Column, Column, bool] | None:
    """(column, literal, whether NaN is possible) of one common type, or None where the types don't compare."""
    have, want = _kind_of_type(kind), kind_of(value)
    if have == "time" and want in ("string", "time"):
        return col, F.lit(value).cast(kind), False  # an ISO literal takes the column's type
    if have != want:
        return None
    if have == "number":
        if isinstance(value, float) or not isinstance(kind, WHOLE):
            return (col if isinstance(kind, T.DoubleType) else col.cast("double")), F.lit(float(value)), isinstance(kind, (T.FloatType, T.DoubleType))
        return (col, F.lit(value), False) if -(2**63) <= value < 2**63 else (col.cast("double"), F.lit(float(value)), False)
    return col, F.lit(value), False


def _scalar(col: Column, kind: T.DataType, op: str, value: Any) -> Column:
    present = col.isNotNull()
    sides = None if isinstance(value, float) and math.isnan(value) else _native(col, kind, value)
    if op == "ne":
        return present if sides is None else present & (sides[0] != sides[1])
    if sides is None:
        return _false()
    c, v, nan = sides
    out = c == v if op == "eq" else RANGES[op](c, v)
    return out & ~F.isnan(c) if nan and op in ("gt", "ge") else out


def native(col: Column, kind: T.DataType, op: str, value: Any) -> Column:
    """A predicate over a column of a known type. Lists are the argument of contains_any and contains_all."""
    if isinstance(kind, T.VariantType):
        return variant(col, op, value)
    if op in ("contains_any", "contains_all"):
        parts = [native(col, kind, "contains", v) for v in value]
        if op == "contains_any":
            return reduce(lambda a, b: a | b, parts, _false())
        return reduce(lambda a, b: a & b, parts, col.isNotNull())
    if isinstance(kind, T.ArrayType):
        if op == "ne":
            return col.isNotNull()
        if op != "contains":
            return _false()
        if _native(F.lit(None), kind.elementType, value) is None:
            return _false()
        if _kind_of_type(kind.elementType) == "string":
            return F.array_contains(col, value)
        return F.coalesce(F.exists(col, lambda x: F.coalesce(_scalar(x, kind.elementType, "eq", value), _false())), _false())
    return _scalar(col, kind, "eq" if op == "contains" else op, value)


def field(frontmatter: Column, name: str) -> Column:
    """A top-level VARIANT field by any name."""
    quoted = name.replace("\\", "\\\\").replace('"', '\\"')
    return F.try_variant_get(frontmatter, f'$["{quoted}"]', "variant")


def type_name(v: Column) -> Column:
    """null, boolean, number, string, array, object or other; NULL for a missing value."""
    s = F.schema_of_variant(v)
    return F.when(v.isNull(), F.lit(None)).when(F.is_variant_null(v) | (s == "VOID"), "null").when(s == "BOOLEAN", "boolean").when(s.isin("BIGINT", "DOUBLE", "FLOAT") | s.startswith("DECIMAL"), "number").when(s == "STRING", "string").when(s.startswith("ARRAY"), "array").when(s.startswith("OBJECT"), "object").otherwise("other")


def _variant_scalar(v: Column, op: str, value: Any) -> Column:
    if isinstance(value, (date, datetime)):
        value = value.isoformat()
    kind = kind_of(value)
    if isinstance(value, float) and math.isnan(value):
        return v.isNotNull() if op == "ne" else _false()
    same = type_name(v) == kind
    test = (lambda c, x: c == x) if op in ("eq", "ne") else RANGES[op]
    if kind == "number":
        exact = isinstance(value, int) and -(2**63) <= value < 2**63
        as_double = test(F.try_variant_get(v, "$", "double"), F.lit(float(value)))
        holds = F.when(F.schema_of_variant(v) == "BIGINT", test(F.try_variant_get(v, "$", "bigint"), F.lit(value))).otherwise(as_double) if exact else as_double
    else:
        holds = test(F.try_variant_get(v, "$", kind), F.lit(value))
    holds = F.coalesce(F.when(same, holds), _false())
    return v.isNotNull() & ~holds if op == "ne" else holds


def variant(v: Column, op: str, value: Any) -> Column:
    """A predicate over a VARIANT value that may be missing."""
    if op == "contains_any":
        return reduce(lambda a, b: a | b, [variant(v, "contains", x) for x in value], _false())
    if op == "contains_all":
        return reduce(lambda a, b: a & b, [variant(v, "contains", x) for x in value], v.isNotNull())
    if op == "contains":
        member = F.exists(F.try_variant_get(v, "$", "array<variant>"), lambda x: _variant_scalar(x, "eq", value))
        return F.coalesce(F.when(type_name(v) == "array", member).otherwise(_variant_scalar(v, "eq", value)), _false())
    return _variant_scalar(v, op, value)


def parse_filter(spec: str) -> tuple[str, str, Any]:
    """`field:op:value` as typed on a command line: integer, then float, then boolean, else string."""
    parts = spec.split(":", 2)
    if len(parts) != 3 or parts[1] not in OPS[:7]:
        raise ValueError(f"not field:op:value with a known op: {spec!r}")
    name, op, raw = parts
    if raw.isascii() and raw.lstrip("+-").isdigit() and raw.lstrip("+-") and len(raw) - len(raw.lstrip("+-")) <= 1 and -(2**63) <= int(raw) < 2**63:
        return name, op, int(raw)
    try:
        if raw == raw.strip() and "_" not in raw:
            return name, op, float(raw)
    except ValueError:
        pass
    return name, op, {"true": True, "false": False}.get(raw, raw)
