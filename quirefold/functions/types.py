"""Declared field types and their text form."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from quirefold.errors import SchemaError

SCALARS = {"string": T.StringType(), "integer": T.LongType(), "float": T.DoubleType(), "boolean": T.BooleanType(), "date": T.StringType(), "datetime": T.StringType()}


@dataclass(frozen=True)
class FieldType:
    """kind is a scalar name, `array` (of `item`), `enum` (with `choices`) or `ref` (to `target`)."""

    kind: str
    item: FieldType | None = None
    choices: tuple[str, ...] = ()
    target: str = ""

    def __str__(self) -> str:
        inner = {"array": lambda: str(self.item), "enum": lambda: "|".join(self.choices), "ref": lambda: self.target}.get(self.kind)
        return f"{self.kind}<{inner()}>" if inner else self.kind

    def spark(self) -> T.DataType:
        return T.ArrayType(self.item.spark()) if self.kind == "array" else SCALARS.get(self.kind, T.StringType())

    def metadata(self) -> dict:
        return {"declared": str(self)} | ({"enum": list(self.choices)} if self.choices else {}) | ({"ref": self.target} if self.target else {})


def parse_type(text: str) -> FieldType:
    text = text.strip()
    if text in SCALARS:
        return FieldType(text)
    kind, bracket, rest = text.partition("<")
    if not bracket or not rest.endswith(">"):
        raise SchemaError(f"unknown type `{text}`")
    inner = rest[:-1].strip()
    if kind == "array":
        return FieldType("array", item=parse_type(inner))
    if kind == "enum":
        choices = tuple(c.strip() for c in inner.split("|"))
        if not all(choices):
            raise SchemaError("an enum needs choices, none of them empty")
        return FieldType("enum", choices=choices)
    if kind == "ref":
        if not inner:
            raise SchemaError("a ref needs a collection")
        return FieldType("ref", target=inner)
    raise SchemaError(f"unknown type `{text}`")
