"""Schemas of collections: the head of `schema.md`."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import types as T

from quirefold.errors import FrontMatterError, SchemaError
from quirefold.functions import frontmatter
from quirefold.functions.types import FieldType, parse_type


@dataclass(frozen=True)
class FieldDef:
    name: str
    type: FieldType
    required: bool = False
    range: tuple[float, float] | None = None

    def spark(self) -> T.StructField:
        return T.StructField(self.name, self.type.spark(), True, self.type.metadata() | {"required": self.required} | ({"range": list(self.range)} if self.range else {}))


@dataclass(frozen=True)
class Schema:
    collection: str
    fields: tuple[FieldDef, ...]

    def field(self, name: str) -> FieldDef | None:
        return next((f for f in self.fields if f.name == name), None)

    def spark(self) -> T.StructType:
        return T.StructType([f.spark() for f in self.fields])


def _number(v: Any) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def _field(entry: Any) -> FieldDef:
    if not isinstance(entry, dict):
        raise SchemaError("a field must be a mapping")
    for key in ("name", "type"):
        if not isinstance(entry.get(key), str):
            raise SchemaError(f"a field needs a `{key}` string")
    required, optional = (entry.get(k) is True for k in ("required", "optional"))
    if required and optional:
        raise SchemaError(f"`{entry['name']}` is both required and optional")
    kind, limits = parse_type(entry["type"]), entry.get("range")
    ranged = kind.kind in ("integer", "float") and isinstance(limits, list) and len(limits) == 2 and all(map(_number, limits))
    return FieldDef(entry["name"], kind, required, (float(limits[0]), float(limits[1])) if ranged else None)


def parse_schema(content: str) -> Schema:
    try:
        head, _ = frontmatter.split(content)
        value = frontmatter.load(head) if head is not None else None
    except FrontMatterError as e:
        raise SchemaError(str(e)) from e
    if head is None:
        raise SchemaError("a schema needs front matter")
    if not isinstance(value, dict):
        raise SchemaError("the front matter of a schema must be a mapping")
    if not isinstance(value.get("collection"), str):
        raise SchemaError("a schema needs a `collection` string")
    if not isinstance(value.get("fields"), list):
        raise SchemaError("a schema needs a `fields` list")
    fields = tuple(map(_field, value["fields"]))
    names = [f.name for f in fields]
    if twice := next((n for n in names if names.count(n) > 1), None):
        raise SchemaError(f"field `{twice}` is defined twice")
    return Schema(value["collection"], fields)
