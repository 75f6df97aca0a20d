"""Record files are written, listed and read by many tasks, whatever the number of files or row groups they come from."""

import os

import pytest

from quirefold.plans import files


def tasks(spark, action) -> list[int]:
    """Tasks of the stages that an action runs."""
    sc, group = spark.sparkContext, f"group-{os.urandom(8).hex()}"
    sc.setJobGroup(group, "")
    try:
        action()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    found = [sc.statusTracker().getStageInfo(s) for j in sc.statusTracker().getJobIdsForGroup(group) for s in sc.statusTracker().getJobInfo(j).stageIds]
    return [s.numTasks for s in found if s]


@pytest.fixture(scope="module")
def made(spark):
    rows = spark.range(300).coalesce(1).selectExpr("concat(id % 3, '/', id, '.md') AS path", "concat('---\\nsize: ', id, '\\nkin: parts/', id % 3, '/', id, '.md\\n---\\nné ', id) AS content")
    return files.write(spark, rows, {"parts/schema.md": "---\ncollection: parts\nfields: [{name: size, type: integer, range: [0, 250]}, {name: kin, type: ref<parts>}]\n---\n"})


def test_writing_is_spread(spark):
    rows = spark.range(300).coalesce(1).selectExpr("concat(id % 3, '/', id, '.md') AS path", "concat('né ', id) AS content")
    made = []
    assert max(tasks(spark, lambda: made.append(files.write(spark, rows, {})))) > 1
    for i in range(300):
        with open(f"{made[0].root}/parts/{i % 3}/{i}.md", encoding="utf-8") as f:
            assert f.read() == f"né {i}"


def test_reading_is_spread(spark, made):
    assert made.db.collection("parts").records().rdd.getNumPartitions() > 1
    assert max(tasks(spark, lambda: made.db.collection("parts").query().filter("size").ge(30).count())) > 1


def test_listing_at_every_depth(spark, tmp_path):
    from quirefold.sources.records import paths, walk

    for rel in ("a.md", "b/a.md", "b/c/a.md", "b/c/d/a.md", "b/c/d/e/f/a.md", "b/.hid/a.md", "b/c/target/a.md", "b/c/schema.md"):
        (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / rel).write_text("x")
    os.symlink("b/a.md", tmp_path / "link.md")
    os.symlink("b", tmp_path / "loop")
    os.symlink("../../../a.md", tmp_path / "b/c/target/x.md")
    os.symlink("../../a.md", tmp_path / "b/.hid/x.md")
    assert sorted(r.path for r in paths(spark, str(tmp_path)).collect()) == sorted(walk(str(tmp_path))) == ["a.md", "b/a.md", "b/c/a.md", "b/c/d/a.md", "b/c/d/e/f/a.md"]
    assert sorted(r.path for r in paths(spark, str(tmp_path), links=True).collect()) == ["b/.hid/x.md", "b/c/target/x.md", "link.md", "loop"]


def test_validation_reads_once(spark, made):
    found = made.db.validate("parts")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 4  # three of the listing, one of the reading
    assert {(r.path, r.field, r.severity) for r in found.collect()} == {(f"{i % 3}/{i}.md", "size", "error") for i in range(251, 300)}


def test_index_reads_candidates_alone(spark, make_db):
    from quirefold.sources.database import Database

    members = {f"{i}.md": f"---\nsize: {i}\n---\n" for i in range(40)}
    c = Database(spark, make_db({"c": {"schema.md": "---\ncollection: c\nfields: []\n---\n", **members}})).collection("c")
    assert c.build_index() == 40 and c.load_index().is_fresh(c.signatures())
    with open(os.path.join(c.path, "9.md"), "w") as f:
        f.write("---\na: [\n---\n")
    assert [r.path for r in c.load_index().stale(c.signatures()).collect()] == ["9.md"]
    q = c.query().filter("size").eq(7)
    assert [r.path for r in q.using_index(c.load_index()).to_df().collect()] == ["7.md"]  # 9.md can't be read, and needn't be
    os.remove(os.path.join(c.path, "7.md"))
    assert q.using_index(c.load_index()).to_df().collect() == []


def test_view_is_read_by_tasks(spark, made):
    c = made.db.collection("parts")
    made.db.materialize_view("by-size", c, c.query().filter("size").lt(20), "size")
    found = files.read_links(spark, made, "by-size")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 4  # no list of links from the driver
    assert {r.link for r in found.collect()} == {f"{i}/{i % 3}/{i}.md" for i in range(20)}


def test_order_computes_keys_once(spark, made):
    """Keys are columns below the sort; within its order they would be computed at each comparison."""
    q = made.db.collection("parts").query().order_by("size").desc()
    for rows in (q.to_df(), q.limit(5).to_df(), q.limit(5).ranked_df(columns=["path"])):
        sorts = [line for line in rows._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Sort [" in line]
        assert sorts and not any("variant" in line for line in sorts)
        assert not any(c.startswith("__") for c in rows.columns)
    best = [f"{i % 3}/{i}.md" for i in range(299, 294, -1)]
    assert [r.path for r in q.limit(5).to_df().collect()] == best
    assert [(r.path, r.rank) for r in q.limit(5).ranked_df(columns=["path"]).collect()] == [(p, i + 1) for i, p in enumerate(best)]
