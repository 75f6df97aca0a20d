import os

import pytest
from lights import FILES, LIGHTS, having, names, ranked

from quirefold.errors import CollectionError, DatabaseError, RecordError
from quirefold.operators.index import PostingIndex
from quirefold.operators.query import Query
from quirefold.sources.database import Database
from quirefold.sources.records import walk


@pytest.fixture
def lights(spark, make_db):
    return Database(spark, make_db({"lights": FILES})).collection("lights")


def test_filters(lights):
    q = lights.query()
    place, signals, metres = (q.filter(f) for f in ("place", "signals", "metres"))
    assert sorted(names(q)) == sorted(LIGHTS)
    assert names(metres.ge(20)) == having("metres", lambda v: v >= 20) and names(metres.le(20)) == having("metres", lambda v: v <= 20)
    assert names(place.eq("Crail")) == ["fife"] and names(place.ne("Crail")) == having("place", lambda v: v != "Crail")
    assert names(metres.gt(11).filter("metres").lt(41)) == having("metres", lambda v: 11 < v < 41)
    for some in (["fog", "fixed"], ["red"], ["white", "red"], ["none"], []):
        assert names(signals.contains_any(some)) == having("signals", lambda v: bool(set(v) & set(some)))
        assert names(signals.contains_all(some)) == having("signals", lambda v: set(v) >= set(some))
    assert names(signals.contains("flash")) == having("signals", lambda v: "flash" in v)
    assert names(signals.ne("flash")) == having("signals", lambda v: True) and names(signals.eq("flash")) == []
    assert names(metres.eq("41")) == names(metres.lt("99")) == names(q.filter("keeper").ne(1)) == [] and names(metres.eq(41.0)) == ["arran"]


def test_order_and_limit(lights):
    q = lights.query()
    for field in ("metres", "lit", "place"):
        assert names(q.order_by(field).asc()) == ranked(field) and names(q.order_by(field).desc()) == ranked(field, True)
    assert names(q.order_by("place").asc().order_by("metres").desc()) == ranked("metres", True)
    red = having("signals", lambda v: "red" in v)
    assert names(q.filter("signals").contains("red").order_by("metres").asc()) == [n for n in ranked("metres") if n in red]
    for k in (0, 2, 5, 8):
        assert names(q.order_by("metres").desc().limit(k)) == ranked("metres", True)[:k]
    assert names(q.limit(4).limit(2)) == sorted(LIGHTS)[:2]


def test_missing_null_nan_and_big_numbers(spark, make_db):
    heads = {"null": "x: null", "nan": "x: .nan", "big": "x: 9007199254740993", "small": "x: 9007199254740992", "four": "x: 4.0", "inf": "x: .inf", "text": 'x: "4"', "none": "y: 1", "flag": "x: true", "zero": "x: -0.0"}
    files = {f"{k}.md": f"---\n{v}\n---\n" for k, v in heads.items()} | {"schema.md": "---\ncollection: c\nfields: []\n---\n"}
    q = Database(spark, make_db({"c": files})).collection("c").query()
    assert names(q.filter("x").eq(9007199254740993)) == ["big"] and names(q.filter("x").gt(9007199254740992)) == ["big", "inf"]
    assert names(q.filter("x").eq(4)) == ["four"] and names(q.filter("x").eq("4")) == ["text"]
    assert "none" not in names(q.filter("x").ne(1)) and {"null", "nan", "flag"} <= set(names(q.filter("x").ne(1)))
    assert names(q.filter("x").eq(float("nan"))) == [] and len(names(q.filter("x").ne(float("nan")))) == 9
    assert names(q.filter("x").contains_all([]).filter("x").eq(True)) == ["flag"] and names(q.filter("x").eq(0)) == ["zero"]


def test_walk_and_lookup(spark, make_db, tmp_path):
    root = make_db({"lights": FILES | {".hidden.md": "x", "node_modules/a.md": "x", "a/x.md": "x", "a-b.md": "x", "a.md": "x", "_draft.md": "x", "_d/u.md": "x", "sub/schema.md": "x", "readme.txt": "plain"}})
    os.symlink(tmp_path / "lights" / "arran.md", tmp_path / "lights" / "link.md")
    os.symlink(tmp_path / "lights", tmp_path / "lights" / "cycle")
    found = walk(os.path.join(root, "lights"))
    assert {"a/x.md", "_draft.md", "_d/u.md", "readme.txt"} <= set(found)
    assert not {".hidden.md", "schema.md", "sub/schema.md", "link.md"} & set(found) and not any("node_modules" in p or "cycle" in p for p in found)
    assert found.index("a/x.md") < found.index("a-b.md") < found.index("a.md")
    c = Database(spark, root).collection("lights")
    assert c.record("arran.md").first().body == "Log of arran.\n"
    for bad in ("../etc/passwd", "/etc/passwd", "..\\..\\secret", "lights/../x", "", "link.md", "cycle/arran.md/../x", "missing.md"):
        with pytest.raises(RecordError):
            c.record(bad)


def test_fail_fast_and_permissive(spark, make_db):
    c = Database(spark, make_db({"lights": FILES | {"bad.md": "---\na: [\n---\n", "open.md": "---\na: 1\n"}})).collection("lights")
    with pytest.raises(Exception, match="bad.md|open.md"):
        c.query().filter("place").eq("Crail").to_df().collect()
    assert {r.path for r in c.records(mode="PERMISSIVE").where("error IS NOT NULL").collect()} == {"bad.md", "open.md"}
    assert {(r.path, r.field) for r in c.validate().collect()} == {("bad.md", "-"), ("open.md", "-")}


def test_database(spark, make_db, tmp_path):
    root = make_db({"lights": FILES, "books": {"schema.md": "---\ncollection: library\nfields: []\n---\n"}, "plain": {"a.md": "x"}, ".hidden": {"schema.md": "x"}, "views": {"schema.md": "x"}, "broken": {"schema.md": "x"}})
    db = Database(spark, root)
    assert db.collections() == ["books", "broken", "lights"] == [r.name for r in db.collections_df().collect()]
    assert db.collection("books").name == "library"
    for bad in ("../other", "a/b", "..", ""):
        with pytest.raises(DatabaseError):
            db.collection(bad)
    with pytest.raises(DatabaseError):
        Database(spark, root + "/nope")
    with pytest.raises(CollectionError):
        db.collection("broken")
    assert [r.message[:11] for r in db.validate("broken").collect()] == ["cannot open"]


def test_references(spark, make_db, tmp_path):
    files = {n: f"---\nsource: bookmarks/{s}.md\n---\n" for n, s in (("good.md", "rust"), ("dangling.md", "missing"), ("escape.md", "evil"))}
    root = make_db({"db/notes": files | {"schema.md": "---\ncollection: notes\nfields: [{name: source, type: ref<bookmarks>}]\n---\n"}, "db/bookmarks": {"rust.md": "x", "schema.md": "---\ncollection: bookmarks\nfields: []\n---\n"}, "out": {"x.md": "x"}})
    os.symlink(tmp_path / "out" / "x.md", tmp_path / "db" / "bookmarks" / "evil.md")
    got = {r.path: (r.severity, r.message) for r in Database(spark, root + "/db").validate("notes").collect()}
    assert got["dangling.md"][0] == "warning" and "dangling" in got["dangling.md"][1]
    assert got["escape.md"][0] == "error" and "outside" in got["escape.md"][1] and "good.md" not in got


@pytest.mark.parametrize(
    "head, kind, message",
    [
        ("x: Hello", "string", None), ("y: 1", "string!", "required"), ("x: null", "string!", "required"), ("y: 1", "integer", None), ("x: high", "integer", "expected integer, got string"), ("x: 4.0", "integer", "expected integer"),
        ("x: 10", "integer[1,5]", "outside range [1, 5]"), ("x: 3", "integer[1,5]", None), ("x: .inf", "float[1,5]", "not finite"), ("x: 3", "float", None), ("x: 2024-03-15", "date", None), ("x: March 15", "date", "invalid date"), ("x: 2024-02-31", "date", None),
        ("x: 2024-03-15 10:00:00", "datetime", None), ("x: 2024-03-15", "datetime", "invalid datetime"), ("x: published", "enum<draft|published>", None), ("x: deleted", "enum<draft|published>", "not in"), ("x: books/a.md", "ref<books>", None),
        ("x: notes/x.md", "ref<books>", "must target"), ("x: ../../../etc/passwd", "ref<books>", "forbidden"), ("x: [rust, 5]", "array<string>", "[1]: expected string, got number"), ("x: []", "array<string>", None), ("x: true", "boolean", None), ("x: {a: 1}", "string", "got object"),
    ],
)
def test_validator(spark, head, kind, message):
    from quirefold.functions.types import parse_type
    from quirefold.operators.validate import violations
    from quirefold.sources.records import records_from_texts
    from quirefold.sources.schema import FieldDef, Schema

    kind, _, limits = kind.partition("[")
    d = FieldDef("x", parse_type(kind.rstrip("!")), kind.endswith("!"), tuple(map(float, limits[:-1].split(","))) if limits else None)
    rows = records_from_texts(spark.createDataFrame([("a.md", f"---\n{head}\n---\n")], "path string, content string"))
    got = [r.message for r in violations(rows, Schema("c", (d,))).collect()]
    assert (not got) if message is None else (len(got) == 1 and message in got[0])


def test_index(spark, lights, tmp_path):
    assert lights.build_index() == len(LIGHTS)
    index = lights.load_index()
    shapes = [(("metres", "eq", 34),), (("metres", "ge", 20),), (("signals", "contains", "white"),), (("place", "gt", "D"), ("metres", "lt", 30)), (("metres", "ne", 16),), (("signals", "contains_any", ["fog", "fixed"]),), (("metres", "eq", 20.0),), (("metres", "eq", "20"),)]
    for filters in shapes:
        scan, found = lights.query(), index.narrow(lights.records(), "path", filters, always=True)
        narrowed = Query(found, "path", "frontmatter")
        for f in filters:
            scan, narrowed = scan.where(*f), narrowed.where(*f)
        assert names(scan) == names(narrowed) == names(scan.using_index(index))
    assert index.is_fresh(lights.signatures())
    for name in ("bressay.md", "girdle.md"):
        with open(os.path.join(lights.path, name), "w") as f:
            f.write("---\nplace: Rebuilt\nmetres: 41\n---\n")
    os.remove(os.path.join(lights.path, "arran.md"))
    assert not index.is_fresh(lights.signatures())
    changed = spark.createDataFrame([("bressay.md",), ("girdle.md",), ("arran.md",)], "path string")
    now = index.reconcile(changed, lights.records())
    assert {r.path for r in now.posting("metres", "eq", 41).collect()} == {"bressay.md", "girdle.md"} and now.record_count() == len(LIGHTS)
    assert {r.path for r in now.postings.where("field = 'signals'").select("path").distinct().collect()} == {"corsewall.md", "fife.md"}


def test_large_integers_in_index(spark, make_db):
    files = {"schema.md": "---\ncollection: c\nfields: []\n---\n", "big.md": "---\nx: 9007199254740993\n---\n", "small.md": "---\nx: 9007199254740992\n---\n", "null.md": "---\nx: null\n---\n", "map.md": "---\nx: {a: 1}\n---\n"}
    index = PostingIndex.build(Database(spark, make_db({"c": files})).collection("c").records())
    assert [r.path for r in index.posting("x", "gt", 9007199254740992).collect()] == ["big.md"]
    assert {r.path for r in index.postings.collect()} == {"big.md", "small.md"}


def test_views(spark, make_db):
    from quirefold.errors import ViewError

    root = make_db({"old-lights": FILES | {"deep/e.md": "---\nsignals: [a/b, x y, café, flash, flash]\n---\n"}})
    db = Database(spark, root)
    c = db.collection("old-lights")
    at = os.path.join(root, "views")
    db.materialize_view("all", c)
    assert sorted(os.listdir(f"{at}/all")) == sorted(["deep", *(f"{n}.md" for n in LIGHTS)])
    assert open(f"{at}/all/deep/e.md").read().startswith("---") and open(f"{at}/all/arran.md").read() == FILES["arran.md"]
    db.materialize_view("by", c, group_by="signals")
    kinds = {s for x in LIGHTS.values() for s in x.get("signals", [])}
    assert set(os.listdir(f"{at}/by")) == kinds | {"_ungrouped", "a%2Fb", "caf%C3%A9", "x%20y"}
    assert os.path.exists(f"{at}/by/flash/deep/e.md") and sorted(os.listdir(f"{at}/by/_ungrouped")) == ["dunnet.md", "elie.md"]
    for kind in kinds:
        assert {p for p in os.listdir(f"{at}/by/{kind}") if p != "deep"} == {f"{n}.md" for n in having("signals", lambda v: kind in v)}
    before = os.readlink(f"{at}/by")
    db.materialize_view("by", c, c.query().filter("metres").ge(30), "signals")
    assert os.readlink(f"{at}/by") != before and sorted(os.listdir(f"{at}/by")) == ["fixed", "red", "white"]
    assert len(os.listdir(f"{at}/.generations")) == 2
    db.materialize_view("empty", c, c.query().filter("metres").ge(100))
    assert os.listdir(f"{at}/empty") == []
    for bad in ("../escape", "sub/dir", ".hidden", ""):
        with pytest.raises(ViewError):
            db.materialize_view(bad, c)


@pytest.mark.parametrize("tag", ["_ungrouped", ".", "..", '""', "x" * 241])
def test_view_errors(spark, make_db, tag):
    root = make_db({"lights": FILES | {"z.md": f"---\nsignals: [{tag}]\n---\n"}})
    db = Database(spark, root)
    with pytest.raises(Exception, match="group value"):
        db.materialize_view("v", db.collection("lights"), group_by="signals")
    assert os.listdir(os.path.join(root, "views", ".generations")) == [] and not os.path.lexists(os.path.join(root, "views", "v"))


def test_view_numbers_share_a_group(spark, make_db):
    files = {"schema.md": "---\ncollection: c\nfields: []\n---\n", "a.md": "---\nx: 4\n---\n", "b.md": "---\nx: 4.0\n---\n", "c.md": '---\nx: "4"\n---\n', "d.md": "---\nx: 2.5\n---\n", "e.md": "---\nx: []\n---\n"}
    root = make_db({"c": files})
    db = Database(spark, root)
    db.materialize_view("v", db.collection("c"), group_by="x")
    assert sorted(os.listdir(f"{root}/views/v")) == ["2.5", "4", "_ungrouped"] and len(os.listdir(f"{root}/views/v/4")) == 3


def test_cli(spark, make_db, capsys):
    from quirefold.__main__ import main

    root = make_db({"lights": FILES})
    run = lambda *a: (main(["--db", root, *a], spark), capsys.readouterr())
    assert run("collections")[1].out == "lights\n"
    assert run("query", "lights", "--filter", "metres:ge:20", "--order-by", "metres", "--direction", "desc")[1].out.split() == ["arran.md", "corsewall.md", "dunnet.md"]
    assert run("query", "lights", "--filter", "metres:any:4")[0] == 1 and run("records", "nope")[0] == 1
    assert run("validate")[0] == 0 and f"indexed {len(LIGHTS)}" in run("index", "lights")[1].out
    assert run("materialize", "lights", "v", "--group-by", "signals")[0] == 0


def test_stream_maintenance(spark, lights, tmp_path):
    from quirefold.streaming.maintenance import maintain

    folder = f"file://{tmp_path}/index"
    PostingIndex.build(lights.records()).save(f"{folder}/base")
    with open(os.path.join(lights.path, "elie.md"), "w") as f:
        f.write("---\nmetres: 41\n---\n")
    spark.createDataFrame([("elie.md",)], "path string").write.json(str(tmp_path / "changes"))
    q = maintain(spark.readStream.schema("path string").json(str(tmp_path / "changes")), folder, lights.records, f"{tmp_path}/cp")
    q.awaitTermination(60)
    assert {r.path for r in PostingIndex.load(spark, f"{folder}/0").posting("metres", "eq", 41).collect()} == {"arran.md", "elie.md"}
