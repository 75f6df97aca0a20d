"""Front matter: splitting a text into its head and body, and loading the head as YAML 1.2 core."""

from __future__ import annotations

import json
import math
import re
from typing import Any

from quirefold.errors import FrontMatterError

BOM = "﻿"
OPENING = re.compile(r"---\r?\n")
CLOSING = re.compile(r"^---\s*$", re.MULTILINE)
# The scalar shapes of the YAML 1.2 core schema.
SHAPES = (
    ("null", re.compile(r"(?:~|null|Null|NULL|)\Z"), list("~nN") + [""]),
    ("bool", re.compile(r"(?:true|True|TRUE|false|False|FALSE)\Z"), list("tTfF")),
    ("int", re.compile(r"(?:[-+]?(?:0|[1-9][0-9]*)|0x[0-9a-fA-F]+|0o[0-7]+)\Z"), list("-+0123456789")),
    ("float", re.compile(r"(?:[-+]?(?:[0-9]+\.[0-9]*|\.[0-9]+|[0-9]+(?=[eE]))(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))\Z"), list("-+.0123456789")),
)


def split(content: str) -> tuple[str | None, str]:
    """(head or None, body). Without a head the body is the whole content; a blank head is None."""
    text = content.removeprefix(BOM)
    opened = OPENING.match(text)
    if not opened:
        if text.rstrip("\r\n") == "---" and text == "---":
            raise FrontMatterError("front matter is not closed")
        return None, content
    at = opened.end()
    while True:
        end = text.find("\n", at)
        line = text[at:] if end < 0 else text[at:end]
        if line.rstrip() == "---":
            head = text[opened.end() : at]
            return (head if head.strip() else None), ("" if end < 0 else text[end + 1 :])
        if end < 0:
            raise FrontMatterError("front matter is not closed")
        at = end + 1


def _loader() -> type:
    try:
        import yaml
    except ImportError as e:  # pragma: no cover
        raise FrontMatterError("reading front matter needs PyYAML") from e

    class Core(yaml.SafeLoader):
        yaml_implicit_resolvers: dict = {}

        def flatten_mapping(self, node):  # a merge key is a plain key
            pass

        def construct_mapping(self, node, deep=False):
            seen = set()
            for key, _ in node.value:
                k = self.construct_object(key, deep=True)
                k = json.dumps(plain(k)) if isinstance(k, (list, dict)) else (type(k).__name__, k)
                if k in seen:
                    raise FrontMatterError(f"duplicate key {key.value!r}")
                seen.add(k)
            return {self._name(k): self.construct_object(v, deep=True) for k, v in node.value}

        def _name(self, key):
            k = self.construct_object(key, deep=True)
            return k if isinstance(k, str) else ("\0", json.dumps(plain(k), default=str))

    def number(loader, node):
        v = node.value
        return int(v, 0) if v.startswith(("0x", "0o")) else int(v)

    def real(loader, node):
        v = node.value.lower()
        return math.nan if v == ".nan" else float(v.replace(".inf", "inf"))

    for tag, shape, first in SHAPES:
        Core.add_implicit_resolver(f"tag:yaml.org,2002:{tag}", shape, first)
    Core.add_constructor("tag:yaml.org,2002:int", number)
    Core.add_constructor("tag:yaml.org,2002:float", real)
    Core.add_constructor("tag:yaml.org,2002:map", lambda loader, node: loader.construct_mapping(node))
    Core.add_constructor("tag:yaml.org,2002:timestamp", lambda loader, node: node.value)
    generic = {yaml.ScalarNode: lambda lo, n: lo.construct_scalar(n), yaml.SequenceNode: lambda lo, n: lo.construct_sequence(n, deep=True), yaml.MappingNode: lambda lo, n: lo.construct_mapping(n)}
    Core.add_multi_constructor("!", lambda loader, suffix, node: generic[type(node)](loader, node))
    return Core


_CORE: type | None = None


def load(head: str) -> Any:
    """The value of a head. Keys that aren't strings are kept apart, under tuples, as no name addresses them."""
    global _CORE
    import yaml

    _CORE = _CORE or _loader()
    try:
        return yaml.load(head, Loader=_CORE)  # noqa: S506  (a subclass of the safe loader)
    except (yaml.YAMLError, ValueError, TypeError) as e:
        raise FrontMatterError(str(e)) from e


def plain(value: Any) -> Any:
    """A value with what JSON can hold. NaN becomes an object: present, of no comparable type, equal to nothing."""
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items() if isinstance(k, str)}
    if isinstance(value, (list, tuple, set)):
        return [plain(v) for v in value]
    if isinstance(value, float) and math.isnan(value):
        return {"$float": "nan"}
    if isinstance(value, (str, bool, int, float)) or value is None:
        return value
    return str(value)


_encode = json.JSONEncoder(ensure_ascii=False).encode  # made once: json.dumps makes one for each value


def to_json(value: Any) -> str:
    """JSON text that Spark parses into VARIANT; infinities are numbers beyond the range of doubles."""
    text = _encode(plain(value))
    if "Infinity" not in text:
        return text
    return re.sub(r'"(?:[^"\\]|\\.)*"|-?Infinity', lambda m: {"Infinity": "1e400", "-Infinity": "-1e400"}.get(m[0], m[0]), text)


# A line that needs no YAML loader: a name, and a plain scalar or a list of plain scalars without anything that YAML could read
# in another way. Words with a space inside are text, whatever they are.
_PLAIN = r"[A-Za-z0-9_./+-](?:[A-Za-z0-9_./+ -]*[A-Za-z0-9_./+-])?"
_SIMPLE = re.compile(rf"([A-Za-z_][A-Za-z0-9_-]*): +({_PLAIN}|\[(?:{_PLAIN}(?:, ?{_PLAIN})*)?\])[ \t]*\r?\n?")
_LIST_SEPARATOR = re.compile(", ?")
_SHAPED = frozenset(c for _, _, first in SHAPES for c in first)  # how a scalar that isn't text begins


def scalar(text: str) -> Any:
    """The value of a plain scalar."""
    if text[:1] not in _SHAPED:
        return text
    for kind, shape, first in SHAPES:
        if text[:1] in first and shape.match(text):
            if kind == "null":
                return None
            if kind == "bool":
                return text[0] in "tT"
            if kind == "int":
                return int(text, 0) if text.startswith(("0x", "0o")) else int(text)
            return math.nan if text.lower() == ".nan" else float(text.lower().replace(".inf", "inf"))
    return text


def simple(head: str) -> dict[str, Any] | None:
    """The value of a head whose every line is `name: scalar` or `name: [scalar, ...]`, or None if it has any other."""
    out: dict[str, Any] = {}
    at = 0
    while at < len(head):
        line = _SIMPLE.match(head, at)
        if not line or line[2].startswith(("-", "+ ")) and " " in line[2] or line.end() < len(head) and not line[0].endswith("\n"):
            return None
        name, value = line.groups()
        if name in out or name[0] in _SHAPED and (SHAPES[0][1].match(name) or SHAPES[1][1].match(name)):
            return None
        if value.startswith("["):
            items = _LIST_SEPARATOR.split(value[1:-1]) if len(value) > 2 else []
            if any(x.startswith("-") and (" " in x or x == "-") for x in items):
                return None
            out[name] = [scalar(x) for x in items]
        elif value in ("-", "--", "---"):
            return None
        else:
            out[name] = scalar(value)
        at = line.end()
    return out


def parse(content: str) -> tuple[str, str]:
    """(front matter as JSON, body); `null` without a head. Heads of simple lines skip the YAML loader."""
    head, body = split(content)
    if head is None:
        return "null", body
    value = simple(head)
    return to_json(load(head) if value is None else value), body
