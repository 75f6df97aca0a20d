import math

import pytest
from hypothesis import given
from hypothesis import strategies as st

from quirefold.errors import FrontMatterError, SchemaError
from quirefold.functions import frontmatter as fm
from quirefold.functions.types import parse_type
from quirefold.sources.schema import parse_schema


@pytest.mark.parametrize(
    "text, head, body",
    [
        ("hello\n", None, "hello\n"),
        ("", None, ""),
        ("--- not\nx", None, "--- not\nx"),
        ("---\na: 1\n---\nbody\n---\nmore", "a: 1\n", "body\n---\nmore"),
        ("---\n---\nbody", None, "body"),
        ("---\n  \n---\nbody", None, "body"),
        ("---\na: 1\n---", "a: 1\n", ""),
        ("---\r\na: 1\r\n---\r\nb", "a: 1\r\n", "b"),
        ("---\na: 1\n---  \nb", "a: 1\n", "b"),
        ("﻿---\na: 1\n---\nb", "a: 1\n", "b"),
        ("﻿plain", None, "﻿plain"),
        ("---  \na: 1\n---\n", None, "---  \na: 1\n---\n"),
    ],
)
def test_split(text, head, body):
    assert fm.split(text) == (head, body)


def test_unclosed():
    with pytest.raises(FrontMatterError):
        fm.split("---\na: 1\n")


@pytest.mark.parametrize(
    "text, value",
    [("true", True), ("TRUE", True), ("False", False), ("null", None), ("~", None), ("", None), ("4", 4), ("+4", 4), ("-4", -4), ("0x1F", 31), ("0o17", 15), ("4.5", 4.5), (".5", 0.5), ("5.", 5.0), ("1e5", 1e5), ("1.5e3", 1500.0), (".inf", math.inf), ("-.inf", -math.inf), ("[a, b]", ["a", "b"]), ("[]", []), ("[1, a, 2024-01-01]", [1, "a", "2024-01-01"])]
    + [(s, s) for s in ("yes", "no", "on", "off", "y", "n", "04", "0123", "1_000", "1abc", "v1.2.3", "inf", "nan", "2024-01-01", "2024-12-31T23:59:59Z", "mid:colon", "1:30")],
)
def test_scalars(text, value):
    got = fm.load(f"k: {text}")["k"]
    assert got == value and type(got) is type(value)


def test_nan_and_duplicates():
    assert math.isnan(fm.load("k: .nan")["k"])
    assert "$float" in fm.to_json(fm.load("k: .nan"))
    with pytest.raises(FrontMatterError):
        fm.load("a: 1\na : 2")
    with pytest.raises(FrontMatterError):
        fm.load("a: [")


@given(st.dictionaries(st.from_regex(r"[a-z]{1,8}", fullmatch=True).filter(lambda k: k not in ("y", "n", "null", "true", "false")), st.integers(-(2**63), 2**63 - 1) | st.booleans() | st.none(), max_size=5), st.text(max_size=30))
def test_round_trip(fields, body):
    head = "".join(f"{k}: {'null' if v is None else str(v).lower()}\n" for k, v in fields.items())
    text = f"---\n{head}---\n{body}"
    got, rest = fm.split(text)
    assert rest == body and (fm.load(got) if got else {}) == fields


@pytest.mark.parametrize("text", ["string", "integer", "float", "boolean", "date", "datetime", "array<array<integer>>", "enum<a|b>", "ref<books>", "array<ref<books>>"])
def test_type_text(text):
    assert str(parse_type(text)) == text


@pytest.mark.parametrize("text", ["blob", "enum<>", "enum<a|>", "ref<>", "array<blob>", "String"])
def test_bad_types(text):
    with pytest.raises(SchemaError):
        parse_type(text)


def test_schema():
    s = parse_schema("---\ncollection: notes\nfields:\n  - {name: title, type: string, required: true, range: [1, 2]}\n  - {name: rating, type: integer, range: [1, 5]}\n---\n")
    assert s.collection == "notes" and s.field("title").required and s.field("title").range is None
    assert s.field("rating").range == (1.0, 5.0) and s.spark()["rating"].metadata["range"] == [1.0, 5.0]


@pytest.mark.parametrize("head", ["fields: []", "collection: x", "collection: x\nfields: [{name: a, type: string}, {name: a, type: string}]", "collection: x\nfields: [{name: a, type: string, required: true, optional: true}]", "- a", "collection: x\nfields: [{name: a}]", "collection: x\nfields: [1]"])
def test_bad_schemas(head):
    with pytest.raises(SchemaError):
        parse_schema(f"---\n{head}\n---\n")
    with pytest.raises(SchemaError):
        parse_schema("no front matter")


def test_simple_heads_equal_the_loader():
    """Heads of simple lines give what the YAML loader gives, and any other goes to the loader."""
    import random

    r = random.Random(11)
    bits = ["a", "-", "--", "1", "04", "-4", "+4", "4.5", ".5", "5.", "1e5", "0x1F", "0o17", "true", "True", "yes", "null", "~", ".inf", "-.inf", ".nan", "1_000", "2024-01-01", "a/b", "x y", "- x", "+ x", ".", "..", "...", "---", "[a, b]", "[]", "[1,2]", "[- a]", "[-]", "[a, -1]", "[a,  b]", "[a b, .nan]", "a: b", "'q'", "#c", "a #c", "&a", "*a", "!t", "|", ">", "{a: 1}", "", " ", "a,b", "é", "1 2", "a\tb", "12:30"]
    keys = ["a", "b_c", "d-e", "_f", "true", "null", "on", "a", "1", "x y", "é", "No"]
    taken = 0
    for _ in range(6000):
        head = "".join(f"{r.choice(keys)}:{r.choice([' ', '  ', ''])}{r.choice(bits)}{r.choice([chr(10), chr(13) + chr(10), ' ' + chr(10), ''])}" for _ in range(r.randint(1, 3)))
        got = fm.simple(head)
        if got is None:
            continue
        taken += 1
        want = fm.load(head)
        assert repr(got) == repr(want) and [type(v) for v in got.values()] == [type(v) for v in want.values()], head
    assert taken > 500
