"""Registered queries of the record and table engine, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.functions.types import parse_type
from quirefold.operators import validate, views
from quirefold.operators.index import PostingIndex, key_predicate
from quirefold.operators.query import Query
from quirefold.operators.shared import fresh
from quirefold.plans import files
from quirefold.sources.records import records_from_texts
from quirefold.sources.schema import FieldDef, Schema

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def over(spark: SparkSession, sf_dir: str, name: str, path_col: str) -> Query:
    return Query(read(spark, sf_dir, name), path_col)


@register("topk_entry_orders", "SELECT o_orderkey, o_totalprice, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rank FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 100000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = over(spark, sf_dir, "orders", "o_orderkey").filter("o_orderstatus").eq("F").filter("o_totalprice").ge(100000)
    return q.order_by("o_totalprice").desc().limit(20).ranked_df().select("o_orderkey", "o_totalprice", "rank")


# Filters


def _filter(name: str, tab: str, key: str, conditions: list[tuple], show: list[str], where: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        q = over(spark, sf_dir, tab, key)
        for c in conditions:
            q = q.where(*c)
        return q.to_df().select(*show)

    register(name, f"SELECT {', '.join(show)} FROM {tab} WHERE {where}")(run)


_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"]
_filter("filter_eq_string", "customer", "c_custkey", [("c_mktsegment", "eq", "BUILDING")], ["c_custkey", "c_name"], "c_mktsegment = 'BUILDING'")
_filter("filter_lt", "lineitem", "l_orderkey", [("l_quantity", "lt", 10)], _LINE, "l_quantity < 10")
_filter("filter_le", "part", "p_partkey", [("p_size", "le", 10)], ["p_partkey", "p_size"], "p_size <= 10")
_filter("filter_gt", "lineitem", "l_orderkey", [("l_discount", "gt", 0.05)], _LINE, "l_discount > 0.05")
_filter("filter_ge", "part", "p_partkey", [("p_retailprice", "ge", 950)], ["p_partkey", "p_retailprice"], "p_retailprice >= 950")
_filter("filter_between", "lineitem", "l_orderkey", [("l_quantity", "gt", 10), ("l_quantity", "lt", 20)], _LINE, "l_quantity > 10 AND l_quantity < 20")
_filter("filter_date_range", "orders", "o_orderkey", [("o_orderdate", "ge", "1995-01-01"), ("o_orderdate", "lt", "1996-01-01")], ["o_orderkey", "o_custkey"], "o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'")
_filter("filter_type_mismatch_eq", "part", "p_partkey", [("p_size", "eq", "11")], ["p_partkey"], "false")
_filter("filter_type_mismatch_ne", "part", "p_partkey", [("p_size", "ne", "11")], ["p_partkey"], "p_size IS NOT NULL")
_filter("filter_type_mismatch_range", "part", "p_partkey", [("p_size", "lt", "99")], ["p_partkey"], "false")
_filter("filter_int_float_unify", "part", "p_partkey", [("p_size", "eq", 11.0)], ["p_partkey", "p_size"], "p_size = 11.0")
_filter("filter_nan_literal", "part", "p_partkey", [("p_retailprice", "ne", float("nan"))], ["p_partkey"], "p_retailprice IS NOT NULL")
_filter("filter_undeclared_field", "part", "p_partkey", [("no_such_field", "ne", 1)], ["p_partkey"], "false")
_filter("contains_scalar", "customer", "c_custkey", [("c_mktsegment", "contains", "MACHINERY")], ["c_custkey"], "c_mktsegment = 'MACHINERY'")
_filter("contains_any_scalar", "customer", "c_custkey", [("c_mktsegment", "contains_any", ["MACHINERY", "BUILDING"])], ["c_custkey"], "c_mktsegment IN ('MACHINERY', 'BUILDING')")
_filter("filter_conjunction", "orders", "o_orderkey", [("o_orderstatus", "eq", "O"), ("o_totalprice", "gt", 150000), ("o_custkey", "lt", 500)], ["o_orderkey", "o_totalprice"], "o_orderstatus = 'O' AND o_totalprice > 150000 AND o_custkey < 500")


@register("filter_ne_missing", "SELECT o_orderkey FROM orders WHERE nullif(o_orderstatus, 'P') IS NOT NULL AND nullif(o_orderstatus, 'P') <> 'F'")
def _(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").withColumn("status", F.expr("nullif(o_orderstatus, 'P')"))
    return Query(orders, "o_orderkey").filter("status").ne("F").to_df().select("o_orderkey")


@register("filter_bigint_exact", "SELECT o_orderkey FROM orders WHERE o_orderkey + 9007199254740992 > 9007199254741000")
def _(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").withColumn("big", F.col("o_orderkey") + 9007199254740992)
    return Query(orders, "o_orderkey").filter("big").gt(9007199254741000).to_df().select("o_orderkey")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as records: a path and the words of the name as tags."""
    return read(spark, sf_dir, "part").withColumns({"path": F.concat(F.lit("part/"), F.lpad(F.col("p_partkey").cast("string"), 8, "0"), F.lit(".md")), "tags": F.split("p_name", " ")})


PATH = "concat('part/', lpad(CAST(p_partkey AS VARCHAR), 8, '0'), '.md')"
TAGS = "string_split(p_name, ' ')"


def _tags(name: str, op: str, value, where: str) -> None:
    @register(name, f"SELECT {PATH} AS path, p_name FROM part WHERE {where}")
    def _(spark, sf_dir):
        return Query(parts(spark, sf_dir)).where("tags", op, value).to_df().select("path", "p_name")


_tags("contains_array", "contains", "red", f"list_contains({TAGS}, 'red')")
_tags("contains_any", "contains_any", ["red", "blue"], f"list_has_any({TAGS}, ['red', 'blue'])")
_tags("contains_any_empty", "contains_any", [], "false")
_tags("contains_all", "contains_all", ["ring", "blue"], f"list_has_all({TAGS}, ['ring', 'blue'])")
_tags("contains_all_empty", "contains_all", [], f"{TAGS} IS NOT NULL")
_tags("array_eq_scalar", "eq", "green", "false")
_tags("array_ne_scalar", "ne", "green", f"{TAGS} IS NOT NULL")


# Order, limit, top-k


def _ranked(name: str, build: Callable[[SparkSession, str], Query], show: list[str], sql: str) -> None:
    register(name, sql)(lambda spark, sf_dir: build(spark, sf_dir).ranked_df(columns=show))


def _row_number(order: str) -> str:
    return f"CAST(row_number() OVER (ORDER BY {order}) AS BIGINT) AS rank"


_ranked("order_by_asc", lambda s, d: over(s, d, "orders", "o_orderkey").order_by("o_totalprice").asc(), ["o_orderkey"], f"SELECT o_orderkey, {_row_number('o_totalprice, o_orderkey')} FROM orders")
_ranked("order_by_desc", lambda s, d: over(s, d, "orders", "o_orderkey").order_by("o_totalprice").desc(), ["o_orderkey"], f"SELECT o_orderkey, {_row_number('o_totalprice DESC, o_orderkey')} FROM orders")
_ranked("order_ties_by_path", lambda s, d: Query(parts(s, d)).order_by("p_size").desc(), ["path"], f"SELECT {PATH} AS path, {_row_number('p_size DESC, p_partkey')} FROM part")
_ranked("order_replaced", lambda s, d: over(s, d, "customer", "c_custkey").order_by("c_name").desc().order_by("c_acctbal").asc(), ["c_custkey"], f"SELECT c_custkey, {_row_number('c_acctbal, c_custkey')} FROM customer")
_ranked("limit_path_order", lambda s, d: over(s, d, "customer", "c_custkey").limit(25), ["c_custkey"], f"SELECT c_custkey, {_row_number('c_custkey')} FROM customer ORDER BY c_custkey LIMIT 25")
_ranked("limit_zero", lambda s, d: over(s, d, "region", "r_regionkey").limit(0), ["r_regionkey"], "SELECT r_regionkey, CAST(1 AS BIGINT) AS rank FROM region LIMIT 0")
_ranked("topk_filter", lambda s, d: Query(parts(s, d)).filter("p_size").ge(10).order_by("p_retailprice").desc().limit(10), ["path", "p_retailprice"], f"SELECT {PATH} AS path, p_retailprice, {_row_number('p_retailprice DESC, p_partkey')} FROM part WHERE p_size >= 10 ORDER BY p_retailprice DESC, p_partkey LIMIT 10")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their label's quality, which many lack."""
    return read(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")


_LABELLED = "documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"
_ranked("order_missing_last_asc", lambda s, d: Query(labelled(s, d), "doc_id").order_by("quality").asc(), ["doc_id", "quality"], f"SELECT d.doc_id, quality, {_row_number('quality ASC NULLS LAST, d.doc_id')} FROM {_LABELLED}")
_ranked("order_missing_last_desc", lambda s, d: Query(labelled(s, d), "doc_id").order_by("quality").desc(), ["doc_id", "quality"], f"SELECT d.doc_id, quality, {_row_number('quality DESC NULLS LAST, d.doc_id')} FROM {_LABELLED}")


@register("query_count", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
def _(spark, sf_dir):
    return over(spark, sf_dir, "orders", "o_orderkey").filter("o_orderstatus").eq("F").to_df().agg(F.count(F.lit(1)).alias("n"))


# VARIANT fields


@register("dynamic_field_filter", "SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 50")
def _(spark, sf_dir):
    events = read(spark, sf_dir, "events").withColumn("frontmatter", F.parse_json("props"))
    return Query(events, "event_id", "frontmatter").filter("k").ge(50).to_df().select("event_id")


@register("dynamic_field_no_coercion", "SELECT event_id FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def _(spark, sf_dir):
    events = read(spark, sf_dir, "events").withColumn("frontmatter", F.parse_json("props"))
    return Query(events, "event_id", "frontmatter").filter("k").ne("50").to_df().select("event_id")


@register("dynamic_field_order", f"SELECT event_id, {_row_number('CAST(json_extract(props, $$$.k$$) AS BIGINT) DESC, event_id')} FROM events ORDER BY CAST(json_extract(props, '$.k') AS BIGINT) DESC, event_id LIMIT 50")
def _(spark, sf_dir):
    events = read(spark, sf_dir, "events").withColumn("frontmatter", F.parse_json("props"))
    return Query(events, "event_id", "frontmatter").order_by("k").desc().limit(50).ranked_df().select("event_id", "rank")


# Views

_GROUPS = f"SELECT DISTINCT {PATH} AS path, unnest({TAGS}) AS \"group\", p_partkey FROM part"


@register("view_fanout_tags", f'SELECT path, "group" FROM ({_GROUPS})')
def _(spark, sf_dir):
    rows = parts(spark, sf_dir)
    return views.fan_out(rows, views.groups_of_column(rows, "tags"))


@register("view_fanout_ungrouped", f"SELECT CAST(d.doc_id AS VARCHAR) AS path, coalesce(CAST(quality AS VARCHAR), '_ungrouped') AS \"group\" FROM {_LABELLED}")
def _(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    return views.fan_out(rows.withColumn("path", F.col("doc_id").cast("string")), views.groups_of_column(rows, "quality"))


@register("view_fanout_float", "SELECT concat(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), '') AS \"group\", count(*) AS n FROM lineitem GROUP BY 1")
def _(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").withColumn("path", F.col("l_orderkey").cast("string"))
    return views.group_counts(views.fan_out(rows, views.groups_of_column(rows, "l_quantity")))


@register("view_group_counts", 'SELECT o_orderpriority AS "group", count(*) AS n FROM orders GROUP BY 1')
def _(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").withColumn("path", F.col("o_orderkey").cast("string"))
    return views.group_counts(views.fan_out(rows, views.groups_of_column(rows, "o_orderpriority")))


@register("view_encode_segment", "SELECT DISTINCT v, url_encode(v) AS segment FROM (SELECT o_orderpriority AS v FROM orders UNION ALL SELECT url FROM pages)")
def _(spark, sf_dir):
    values = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("v")).unionByName(read(spark, sf_dir, "pages").select(F.col("url").alias("v")))
    return values.distinct().select("v", views.encode_segment(F.col("v")).alias("segment"))


@register("view_links_flat", f"SELECT {PATH} AS link, '../../../../parts/' || {PATH} AS target FROM part")
def _(spark, sf_dir):
    return views.links(parts(spark, sf_dir), "parts")


@register("view_links_grouped", f"SELECT \"group\" || '/' || path AS link, '../../../../../parts/' || path AS target FROM ({_GROUPS})")
def _(spark, sf_dir):
    rows = parts(spark, sf_dir)
    return views.links(rows, "parts", views.groups_of_column(rows, "tags"))


@register("view_of_query", f"SELECT path, \"group\" FROM ({_GROUPS}) JOIN part USING (p_partkey) WHERE p_size > 25")
def _(spark, sf_dir):
    rows = Query(parts(spark, sf_dir)).filter("p_size").gt(25).to_df()
    return views.fan_out(rows, views.groups_of_column(rows, "tags"))


# Validation

FINDINGS = "path, field, message, 'error' AS severity"


def _schema(*fields: tuple) -> Schema:
    return Schema("x", tuple(FieldDef(n, parse_type(t), *rest) for n, t, *rest in fields))


def _validated(spark, rows: DataFrame, schema: Schema) -> DataFrame:
    return validate.violations(rows, schema, None)


@register("validate_required", f"SELECT CAST(d.doc_id AS VARCHAR) AS path, 'quality' AS field, 'required field is missing or null' AS message, 'error' AS severity FROM {_LABELLED} WHERE quality IS NULL")
def _(spark, sf_dir):
    rows = labelled(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), "quality")
    return _validated(spark, rows, _schema(("quality", "integer", True)))


@register("validate_range", f"SELECT {PATH} AS path, 'p_size' AS field, 'value ' || p_size || ' outside range [5, 40]' AS message, 'error' AS severity FROM part WHERE p_size NOT BETWEEN 5 AND 40")
def _(spark, sf_dir):
    return _validated(spark, parts(spark, sf_dir), _schema(("p_size", "integer", False, (5.0, 40.0))))


@register("validate_type", f"SELECT {PATH} AS path, 'p_name' AS field, 'expected integer, got string' AS message, 'error' AS severity FROM part")
def _(spark, sf_dir):
    return _validated(spark, parts(spark, sf_dir), _schema(("p_name", "integer")))


@register("validate_enum", "SELECT CAST(o_orderkey AS VARCHAR) AS path, 'o_orderstatus' AS field, '`' || o_orderstatus || '` not in: F|O' AS message, 'error' AS severity FROM orders WHERE o_orderstatus NOT IN ('F', 'O')")
def _(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("path"), "o_orderstatus")
    return _validated(spark, rows, _schema(("o_orderstatus", "enum<F|O>")))


@register("validate_date", "SELECT CAST(o_orderkey AS VARCHAR) AS path, 'd' AS field, 'invalid date `' || d || '` (expected YYYY-MM-DD)' AS message, 'error' AS severity FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN strftime(o_orderdate, '%Y/%m/%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d FROM orders) WHERE NOT regexp_matches(d, '^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])$')")
def _(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.when(F.col("o_orderkey") % 10 == 0, F.date_format("o_orderdate", "yyyy/MM/dd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("d"))
    return _validated(spark, rows, _schema(("d", "date")))


@register("validate_array_elem", f"SELECT {PATH} AS path, 'tags' AS field, CASE WHEN {TAGS}[1] NOT IN ('green', 'blue') THEN '[0]: `' || {TAGS}[1] ELSE '[1]: `' || {TAGS}[2] END || '` not in: green|blue' AS message, 'error' AS severity FROM part WHERE NOT list_has_all(['green', 'blue'], {TAGS})")
def _(spark, sf_dir):
    return _validated(spark, parts(spark, sf_dir), _schema(("tags", "array<enum<green|blue>>")))


@register("validate_ref_shape", "SELECT CAST(o_orderkey AS VARCHAR) AS path, 'ref' AS field, 'reference `orders/' || o_custkey || '` must target the `customer` collection' AS message, 'error' AS severity FROM orders WHERE o_custkey % 7 = 0")
def _(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.concat(F.when(F.col("o_custkey") % 7 == 0, "orders/").otherwise("customer/"), F.col("o_custkey")).alias("ref"))
    return _validated(spark, rows, _schema(("ref", "ref<customer>")))


@register("validate_ref_dangling", "SELECT CAST(doc_id AS VARCHAR) AS path, 'label' AS field, 'reference `labels/' || doc_id || '` does not exist (dangling reference)' AS message, 'warning' AS severity FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def _(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.concat(F.lit("labels/"), "doc_id").alias("label"))
    return validate.dangling(rows, FieldDef("label", parse_type("ref<labels>")), read(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("path")), None)


@register("validate_counts", f"SELECT 'error' AS severity, count(*) AS n FROM {_LABELLED} WHERE quality IS NULL OR quality <> 1")
def _(spark, sf_dir):
    rows = labelled(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), "quality")
    return validate.counts(_validated(spark, rows, _schema(("quality", "integer", True, (1.0, 1.0)))))


@register("ref_resolved", "SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c_acctbal > 0)")
def _(spark, sf_dir):
    return validate.resolved(read(spark, sf_dir, "orders"), "o_custkey", read(spark, sf_dir, "customer").where("c_acctbal > 0"), "c_custkey").select("o_orderkey")


# Front matter


def part_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts rendered as record files."""
    return parts(spark, sf_dir).select("path", F.concat(F.lit("---\ntitle: "), "p_name", F.lit("\ntags: ["), F.array_join("tags", ", "), F.lit("]\nsize: "), "p_size", F.lit("\nprice: "), F.col("p_retailprice").cast("string"), F.lit("\n---\nA "), "p_type", F.lit(" part.\n")).alias("content"))


@register("frontmatter_roundtrip", f"SELECT {PATH} AS path, p_name AS title, CAST(p_size AS BIGINT) AS size, p_retailprice AS price, {TAGS}[2] AS tag, 'A ' || p_type || ' part.' || chr(10) AS body FROM part")
def _(spark, sf_dir):
    rows = records_from_texts(part_texts(spark, sf_dir))
    got = lambda n, t: F.try_variant_get("frontmatter", f"$.{n}", t)
    return rows.select("path", got("title", "string").alias("title"), got("size", "long").alias("size"), got("price", "double").alias("price"), got("tags[1]", "string").alias("tag"), "body")


@register("frontmatter_query", f"SELECT {PATH} AS path FROM part WHERE p_size >= 30 AND list_contains({TAGS}, 'red')")
def _(spark, sf_dir):
    rows = records_from_texts(part_texts(spark, sf_dir))
    return Query(rows, "path", "frontmatter").filter("size").ge(30).filter("tags").contains("red").to_df().select("path")


@register("body_verbatim", "SELECT doc_id, text AS body, false AS has_frontmatter FROM documents")
def _(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    return records_from_texts(docs).select(F.col("path").alias("doc_id"), "body", (~F.is_variant_null("frontmatter")).alias("has_frontmatter"))


@register("frontmatter_json", f"SELECT {PATH} AS path, '{{\"size\":' || p_size || ',\"title\":\"' || p_name || '\"}}' AS json FROM part")
def _(spark, sf_dir):
    texts = parts(spark, sf_dir).select("path", F.concat(F.lit("---\ntitle: "), "p_name", F.lit("\nsize: "), "p_size", F.lit("\n---\n")).alias("content"))
    return records_from_texts(texts).select("path", F.to_json("frontmatter").alias("json"))


# Index

INDEXED = ["p_size", "p_brand", "p_retailprice", "tags"]


_STORED: dict[tuple[str, str], str] = {}


def part_index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, PostingIndex]:
    """Parts and their index, which is built once a session and table, and then read from where it was saved."""
    rows, key = parts(spark, sf_dir), (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        at = fresh(spark, "part-index")
        PostingIndex.of_table(rows, "path", INDEXED).save(at)
        _STORED[key] = at
    return rows, PostingIndex.load(spark, _STORED[key])


@register("index_postings", f"SELECT 'p_size' AS field, 'n' AS ktype, CAST(p_size AS VARCHAR) AS key, {PATH} AS path FROM part UNION ALL SELECT 'p_brand', 's', p_brand, {PATH} FROM part UNION ALL SELECT DISTINCT 'tags', 's', unnest({TAGS}), {PATH} FROM part")
def _(spark, sf_dir):
    rows = parts(spark, sf_dir)
    index = PostingIndex.of_table(rows, "path", ["p_size", "p_brand", "tags"])
    return index.postings.select("field", "ktype", F.coalesce(F.col("k_long").cast("string"), "k_str").alias("key"), "path")


def _lookup(name: str, filters: tuple, where: str) -> None:
    @register(name, f"SELECT {PATH} AS path FROM part WHERE {where}")
    def _(spark, sf_dir):
        rows, index = part_index(spark, sf_dir)
        found = index.narrow(rows, "path", filters, always=True)
        q = Query(found)
        for f in filters:
            q = q.where(*f)
        return q.to_df().select("path")


_lookup("index_eq_lookup", (("p_size", "eq", 7),), "p_size = 7")
_lookup("index_range_lookup", (("p_retailprice", "ge", 990.0),), "p_retailprice >= 990")
_lookup("index_contains_lookup", (("tags", "contains", "red"),), f"list_contains({TAGS}, 'red')")
_lookup("index_intersect", (("p_size", "lt", 20), ("tags", "contains", "blue"), ("p_brand", "ne", "Brand#11")), f"p_size < 20 AND list_contains({TAGS}, 'blue') AND p_brand <> 'Brand#11'")


@register("index_guarded_query", f"SELECT {PATH} AS path FROM part WHERE p_size = 7 AND p_retailprice > 950")
def _(spark, sf_dir):
    rows, index = part_index(spark, sf_dir)
    return Query(rows).using_index(index).filter("p_size").eq(7).filter("p_retailprice").gt(950).to_df().select("path")


@register("index_guard_scan", f"SELECT {PATH} AS path FROM part WHERE p_size > 3")
def _(spark, sf_dir):
    """Too many candidates: the guard leaves the look-up out and scans."""
    rows, index = part_index(spark, sf_dir)
    return Query(rows).using_index(index).filter("p_size").gt(3).to_df().select("path")


@register("index_record_count", "SELECT count(*) AS n FROM part")
def _(spark, sf_dir):
    return part_index(spark, sf_dir)[1].signatures.agg(F.count(F.lit(1)).alias("n"))


def _records(spark, sf_dir, size) -> DataFrame:
    return records_from_texts(parts(spark, sf_dir).select("path", F.concat(F.lit("---\nsize: "), size.cast("string"), F.lit("\n---\n")).alias("content")))


@register("index_reconcile", f"SELECT {PATH} AS path, CASE WHEN p_partkey % 10 = 0 THEN CAST(p_size + 1 AS BIGINT) ELSE CAST(p_size AS BIGINT) END AS k FROM part WHERE p_partkey % 10 <> 5")
def _(spark, sf_dir):
    """Parts ending in 0 are edited, those ending in 5 removed."""
    old = _records(spark, sf_dir, F.col("p_size"))
    new = _records(spark, sf_dir, F.when(F.col("p_partkey") % 10 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    digit = F.substring("path", -4, 1)
    new = new.where(digit != "5")
    changed = old.where(digit.isin("0", "5")).select("path")
    return PostingIndex.build(old).reconcile(changed, new).postings.select("path", F.col("k_long").alias("k"))


@register("index_freshness", f"SELECT {PATH} AS path FROM part WHERE p_partkey % 10 IN (0, 5)")
def _(spark, sf_dir):
    rows = parts(spark, sf_dir).select("path", F.col("p_partkey").alias("mtime_ns"), F.col("p_size").cast("long").alias("size"))
    digit = F.substring("path", -4, 1)
    now = rows.where(digit != "5").withColumn("size", F.when(digit == "0", F.col("size") + 1).otherwise(F.col("size")))
    return PostingIndex(rows.limit(0), rows).stale(now)


@register("index_posting_counts", "SELECT 'p_size' AS field, count(*) AS n FROM part WHERE p_size > 25")
def _(spark, sf_dir):
    _, index = part_index(spark, sf_dir)
    return index.postings.where((F.col("field") == "p_size") & key_predicate("gt", 25)).groupBy("field").agg(F.count(F.lit(1)).alias("n"))


# Listings


@register("records_listing", f"SELECT {PATH} AS path, {_row_number('p_partkey')} FROM part")
def _(spark, sf_dir):
    return Query(parts(spark, sf_dir)).ranked_df(columns=["path"])


@register("path_guard", "SELECT url AS path, NOT (url = '' OR starts_with(url, '/') OR contains(url, chr(92)) OR list_contains(string_split(url, '/'), '..')) AS ok FROM pages")
def _(spark, sf_dir):
    return read(spark, sf_dir, "pages").select(F.col("url").alias("path"), (~validate.bad_path(F.col("url"))).alias("ok"))


# Record files, views and stored indexes: parts written as files and read back

def _brought(text: str = "p_name") -> str:
    return f"'---' || chr(10) || 'title: ' || {text} || chr(10) || 'size: ' || p_size || chr(10) || 'price: ' || CAST(p_retailprice AS VARCHAR) || chr(10) || '---' || chr(10) || 'A ' || p_type || ' part.' || chr(10)"


def part_database(spark: SparkSession, sf_dir: str, **more: str) -> files.Written:
    """A database of one collection `parts`, a file for each part, and the files of `more` beside them."""
    rows = parts(spark, sf_dir).select(F.concat(F.substring("path", 6, 2), F.lit("/"), F.substring("path", 6, 100)).alias("path"), F.concat(F.lit("---\ntitle: "), "p_name", F.lit("\ntags: ["), F.array_join("tags", ", "), F.lit("]\nsize: "), "p_size", F.lit("\nprice: "), F.col("p_retailprice").cast("string"), F.lit("\nadded: 2024-02-"), F.lpad((F.col("p_partkey") % 40).cast("string"), 2, "0"), F.lit("\n---\nA "), "p_type", F.lit(" part.\n")).alias("content"))
    schema = "---\ncollection: parts\nfields:\n  - {name: title, type: string, required: true}\n  - {name: tags, type: array<string>}\n  - {name: size, type: integer, range: [5, 40]}\n  - {name: price, type: float}\n  - {name: added, type: date}\n  - {name: seen, type: datetime}\n  - {name: kin, type: ref<parts>}\n---\n"
    return files.write(spark, rows, {"parts/schema.md": schema} | {f"parts/{k}": v for k, v in more.items()})


_REL = "substr(lpad(CAST(p_partkey AS VARCHAR), 8, '0'), 1, 2) || '/' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') || '.md'"


@register("source_scan", f"SELECT {_REL} AS path, p_name AS title, CAST(p_size AS BIGINT) AS size, p_retailprice AS price, 'A ' || p_type || ' part.' || chr(10) AS body FROM part")
def _(spark, sf_dir):
    rows = part_database(spark, sf_dir).db.collection("parts").records()
    got = lambda n, t: F.try_variant_get("frontmatter", f"$.{n}", t)
    return rows.select("path", got("title", "string").alias("title"), got("size", "long").alias("size"), got("price", "double").alias("price"), "body")


@register("source_query", f"SELECT {_REL} AS path FROM part WHERE p_size >= 30 AND list_contains({TAGS}, 'red')")
def _(spark, sf_dir):
    return part_database(spark, sf_dir).db.collection("parts").query().filter("size").ge(30).filter("tags").contains("red").to_df().select("path")


@register("source_order", f"SELECT {_REL} AS path, {_row_number('p_size DESC, p_partkey')} FROM part ORDER BY p_size DESC, p_partkey LIMIT 40")
def _(spark, sf_dir):
    return part_database(spark, sf_dir).db.collection("parts").query().order_by("size").desc().limit(40).ranked_df(columns=["path"])


@register("source_walk", f"SELECT {_REL} AS path FROM part UNION ALL SELECT unnest(['_draft.md', 'deep/er/x.md', 'notes.txt'])")
def _(spark, sf_dir):
    """What is a record: no hidden file, no schema, nothing below folders that hold none, no link; drafts and texts without a head are."""
    made = part_database(spark, sf_dir, **{"_draft.md": "x", "deep/er/x.md": "x", "notes.txt": "x", ".hidden.md": "x", "node_modules/m.md": "x", "deep/schema.md": "x"})
    files.link(made, "parts/notes.txt", "parts/link.md")
    return made.db.collection("parts").records(body="false").select("path")


@register("source_point_lookup", f"SELECT {_REL} AS path, 'A ' || p_type || ' part.' || chr(10) AS body FROM part WHERE p_partkey = 42")
def _(spark, sf_dir):
    return part_database(spark, sf_dir).db.collection("parts").record("00/00000042.md").select("path", "body")


@register("source_collections", "SELECT 'parts' AS name, 'parts' AS collection, 7 AS fields")
def _(spark, sf_dir):
    db = part_database(spark, sf_dir, **{"../plain/a.md": "x"}).db
    found = db.collections_df().where(F.col("name") == "parts").select("name")
    c = db.collection("parts")
    return found.select("name", F.lit(c.name).alias("collection"), F.lit(len(c.schema.fields)).alias("fields"))


@register("source_validate", f"SELECT {_REL} AS path, 'size' AS field, 'value ' || p_size || ' outside range [5, 40]' AS message, 'error' AS severity FROM part WHERE p_size NOT BETWEEN 5 AND 40 UNION ALL SELECT {_REL}, 'added', 'invalid date `2024-02-' || lpad(CAST(p_partkey % 40 AS VARCHAR), 2, '0') || '` (expected YYYY-MM-DD)', 'error' FROM part WHERE p_partkey % 40 = 0 OR p_partkey % 40 > 31 UNION ALL SELECT * FROM (VALUES ('a.md', 'seen', 'invalid datetime `2024-02-01` (expected RFC 3339)', 'error'), ('b.md', 'kin', 'reference `../../x` is empty or has forbidden components', 'error'), ('c.md', 'kin', 'reference `parts/none.md` does not exist (dangling reference)', 'warning'), ('d.md', 'kin', 'reference `parts/out.md` resolves outside the database root', 'error'), ('e.md', '-', 'read error', 'error'), ('f.md', 'kin', 'reference `parts/loop.md` cannot be resolved', 'warning'), ('g.md', 'kin', 'reference `notes/x.md` must target the `parts` collection', 'error'))")
def _(spark, sf_dir):
    """Every kind of finding of a whole database, on files."""
    head = lambda line: f"---\ntitle: x\n{line}\n---\n"
    made = part_database(spark, sf_dir, **{"a.md": head("seen: 2024-02-01"), "b.md": head("kin: ../../x"), "c.md": head("kin: parts/none.md"), "d.md": head("kin: parts/out.md"), "e.md": "---\na: [\n---\n", "f.md": head("kin: parts/loop.md"), "g.md": head("kin: notes/x.md"), "../../outside.md": "x"})
    files.link(made, "../outside.md", "parts/out.md")
    files.link(made, "parts/loop.md", "parts/loop.md")
    return made.db.validate("parts").select("path", "field", F.when(F.col("message").startswith("read error"), "read error").otherwise(F.col("message")).alias("message"), "severity")


@register("source_index", f"SELECT {_REL} AS path FROM part WHERE p_size = 7 AND p_retailprice > 910")
def _(spark, sf_dir):
    """Built beside the records, stored, loaded again and used by a query."""
    c = part_database(spark, sf_dir).db.collection("parts")
    c.build_index()
    return c.query().using_index(c.load_index()).filter("size").eq(7).filter("price").gt(910).to_df().select("path")


@register("source_index_fresh", f"SELECT {_REL} AS path FROM part WHERE p_partkey = 42 UNION ALL SELECT 'new.md'")
def _(spark, sf_dir):
    """Paths that changed since the index was built: one edited, one added."""
    made = part_database(spark, sf_dir)
    c = made.db.collection("parts")
    c.build_index()
    files.put(made, {"parts/00/00000042.md": "---\nsize: 1\n---\n", "parts/new.md": "x"})
    return c.load_index().stale(c.signatures())


@register("view_published", f"SELECT \"group\" || '/' || {_REL} AS link, {_brought()} AS content FROM (SELECT DISTINCT unnest({TAGS}) AS \"group\", p_partkey, p_name, p_size, p_retailprice, p_type FROM part WHERE p_size > 45)")
def _(spark, sf_dir):
    """A view by tag, published as links and read back through them; publishing again leaves one generation."""
    made = part_database(spark, sf_dir)
    c = made.db.collection("parts")
    for _ in range(2):
        made.db.materialize_view("by-tag", c, c.query().filter("size").gt(45), "tags")
    if files.generations(made) != 1:
        raise RuntimeError("an old generation was left")
    return files.read_links(spark, made, "by-tag").select("link", F.regexp_replace("content", r"(?m)^(tags|added): .*\n", "").alias("content"))


@register("view_published_table", f'SELECT "group", count(*) AS n FROM ({_GROUPS}) GROUP BY 1')
def _(spark, sf_dir):
    rows = parts(spark, sf_dir)
    views.publish_table(views.fan_out(rows, views.groups_of_column(rows, "tags")), fresh(spark, "views"), "parts_by_tag")
    return spark.table("parts_by_tag").groupBy("group").agg(F.count(F.lit(1)).alias("n"))
