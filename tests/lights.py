"""A collection of lighthouses. Expectations are computed from LIGHTS, not written beside it."""

LIGHTS = {
    "arran": {"place": "Holy Isle", "signals": ["red", "fixed"], "metres": 41, "lit": "1901-05-02"},
    "bressay": {"place": "Kirkabister Ness", "signals": ["white", "flash", "fog"], "metres": 16, "lit": "1858-07-31"},
    "corsewall": {"place": "Corsewall Point", "signals": ["white", "red"], "metres": 34},
    "dunnet": {"place": "Easter Head", "signals": [], "metres": 20, "lit": "1831-10-01"},
    "elie": {"place": "Elie Ness", "metres": 11, "lit": "1908-10-02"},
    "fife": {"place": "Crail", "signals": ["flash"], "lit": "1844-09-01"},
}


def _head(fields: dict) -> str:
    return "".join(f"{k}: {'[' + ', '.join(v) + ']' if isinstance(v, list) else v}\n" for k, v in fields.items())


FILES = {f"{n}.md": f"---\n{_head(x)}---\nLog of {n}.\n" for n, x in LIGHTS.items()}
FILES["schema.md"] = "---\ncollection: lights\nfields:\n  - {name: place, type: string, required: true}\n  - {name: signals, type: array<string>}\n  - {name: metres, type: integer, range: [5, 60]}\n  - {name: lit, type: date}\n---\n"


def names(query) -> list[str]:
    return [r.path.removesuffix(".md") for r in query.iterate()]


def having(field: str, rule) -> list[str]:
    """The lights that have the field and whose value fits the rule, in order of their paths."""
    return [n for n in sorted(LIGHTS) if field in LIGHTS[n] and rule(LIGHTS[n][field])]


def ranked(field: str, down: bool = False) -> list[str]:
    """All lights by the field, those without it last."""
    there = sorted(having(field, lambda v: True), key=lambda n: LIGHTS[n][field], reverse=down)
    return there + [n for n in sorted(LIGHTS) if n not in there]
