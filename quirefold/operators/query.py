"""The query builder: conjunctive typed filters, one sort key, one limit, an optional index.

A query is immutable and compiles to one DataFrame. It works over any table: over columns, or, for records, over the fields
of a VARIANT column.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirefold.functions import predicates as P
from quirefold.operators.shared import checkpoint, spread

if TYPE_CHECKING:
    from quirefold.operators.index import PostingIndex

KEYS = tuple(f"__key{i}" for i in range(5))


@dataclass(frozen=True)
class Query:
    """`path_col` identifies a row and breaks ties, by path components. `variant_col` holds the fields of records.

    Where rows are costly to read, `keyed` has all values of `path_col` and `read` reads the rows of some of them.
    """

    source: DataFrame
    path_col: str = "path"
    variant_col: str | None = None
    filters: tuple[tuple[str, str, Any], ...] = ()
    order: tuple[str, bool] | None = None
    k: int | None = None
    index: PostingIndex | None = None
    keyed: DataFrame | None = None
    read: Callable[[DataFrame], DataFrame] | None = None

    def filter(self, field: str) -> FilterBuilder:
        return FilterBuilder(self, field)

    def where(self, field: str, op: str, value: Any) -> Query:
        if op not in P.OPS:
            raise ValueError(f"unknown op {op!r}")
        return replace(self, filters=(*self.filters, (field, op, tuple(value) if op in ("contains_any", "contains_all") else value)))

    def order_by(self, field: str) -> OrderBuilder:
        return OrderBuilder(self, field)

    def limit(self, k: int) -> Query:
        return replace(self, k=k)

    def using_index(self, index: PostingIndex) -> Query:
        return replace(self, index=index)

    def value(self, field: str) -> Column | None:
        """A field as a column, or None if no row has it."""
        if self.variant_col:
            return P.field(F.col(self.variant_col), field)
        return F.col(f"`{field}`") if field in self.source.columns else None

    def predicate(self, field: str, op: str, value: Any) -> Column:
        column = self.value(field)
        if column is None:
            return F.lit(False)
        return P.variant(column, op, value) if self.variant_col else P.native(column, self.source.schema[field].dataType, op, value)

    def path_key(self) -> Column:
        return F.split(F.col(f"`{self.path_col}`").cast("string"), "/") if self.source.schema[self.path_col].dataType.typeName() == "string" else F.col(f"`{self.path_col}`")

    def _keyed(self, rows: DataFrame) -> tuple[DataFrame, list[Column]]:
        """The rows, and their order: missing last in both directions; a descending order reverses the key and not the ties.

        Keys of a VARIANT field become columns of their own; as expressions they would be computed at each comparison.
        """
        column = self.value(self.order[0]) if self.order else None
        if column is None:
            return rows, [self.path_key()]
        keys = [column]
        if self.variant_col:  # no order over VARIANT: by type first, then by the value of that type
            kind = P.type_name(column)
            rank = F.when(column.isNotNull(), F.coalesce(F.array_position(F.array(*map(F.lit, ("boolean", "number", "string", "array", "object", "null"))), kind), F.lit(7)))
            typed = [F.when(kind == k, F.try_variant_get(column, "$", t)) for k, t in (("boolean", "boolean"), ("number", "double"), ("number", "bigint"), ("string", "string"))]
            rows, keys = rows.withColumns(dict(zip(KEYS, (rank, *typed)))), [F.col(k) for k in KEYS]
        return rows, [*(k.desc_nulls_last() if self.order[1] else k.asc_nulls_last() for k in keys), self.path_key()]

    def _ordered(self, rows: DataFrame) -> DataFrame:
        rows, order = self._keyed(rows)
        return rows.orderBy(*order).drop(*(KEYS if self.variant_col else ()))

    def _narrowed(self, index: PostingIndex) -> DataFrame:
        if self.read is None:
            return index.narrow(self.source, self.path_col, self.filters)
        found = index.selected(self.filters)
        # Candidates that are still there; they are few, so they are dealt out anew.
        return self.source if found is None else self.read(spread(self.keyed.join(found, self.path_col, "left_semi"), self.path_col))

    def _matching(self) -> DataFrame:
        rows = self.source
        if self.index is not None and self.filters:
            rows = self._narrowed(self.index)
        for f in self.filters:
            rows = rows.where(self.predicate(*f))
        return rows

    def to_df(self) -> DataFrame:
        """Matching rows; ordered only where a sort key or a limit asks for it."""
        rows = self._matching()
        if self.order or self.k is not None:
            rows = self._ordered(rows)
        return rows if self.k is None else rows.limit(self.k)

    def ranked_df(self, rank_col: str = "rank", columns: list[str] | None = None) -> DataFrame:
        """to_df(), or some of its columns, with each row's place from 1.

        With a limit only the top k rows meet in one task. Without one the rows are sorted by range and stay dealt out: a row's
        place is its place in its partition, and the rows in the partitions before, one small row for each, are added.
        """
        if self.k is not None:
            rows, order = self._keyed(self.to_df())
            return rows.withColumn(rank_col, F.row_number().over(W.orderBy(*order)).cast("long")).select(*(columns or self.source.columns), rank_col)
        rows = self._ordered(self._matching()).select(*(columns or self.source.columns), F.monotonically_increasing_id().alias("__at"))
        rows = checkpoint(rows).withColumn("__part", F.shiftright("__at", 33))  # sorted once: another run may cut the ranges elsewhere
        sizes = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
        before = sizes.select("__part", (F.sum("n").over(W.orderBy("__part")) - F.col("n")).alias("__before"))
        place = F.col("__at") - F.shiftleft("__part", 33) + F.col("__before") + 1
        return rows.join(F.broadcast(before), "__part").withColumn(rank_col, place.cast("long")).drop("__at", "__part", "__before")

    def in_order(self) -> DataFrame:
        """to_df() in path order where no other order is asked for."""
        return self.to_df() if self.order or self.k is not None else self.to_df().orderBy(self.path_key())

    def iterate(self) -> Iterator[Row]:
        """Rows one after the other, a partition at a time."""
        return self.in_order().toLocalIterator()

    def count(self) -> int:
        return self.to_df().count()


@dataclass(frozen=True)
class FilterBuilder:
    query: Query
    field: str

    def _add(self, op: str, value: Any) -> Query:
        return self.query.where(self.field, op, value)

    def eq(self, v: Any) -> Query:
        return self._add("eq", v)

    def ne(self, v: Any) -> Query:
        return self._add("ne", v)

    def lt(self, v: Any) -> Query:
        return self._add("lt", v)

    def le(self, v: Any) -> Query:
        return self._add("le", v)

    def gt(self, v: Any) -> Query:
        return self._add("gt", v)

    def ge(self, v: Any) -> Query:
        return self._add("ge", v)

    def contains(self, v: Any) -> Query:
        return self._add("contains", v)

    def contains_any(self, vs: list[Any]) -> Query:
        return self._add("contains_any", vs)

    def contains_all(self, vs: list[Any]) -> Query:
        return self._add("contains_all", vs)


@dataclass(frozen=True)
class OrderBuilder:
    query: Query
    field: str

    def asc(self) -> Query:
        return replace(self.query, order=(self.field, False))

    def desc(self) -> Query:
        return replace(self.query, order=(self.field, True))
