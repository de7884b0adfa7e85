"""The fluent document query: builder calls collect a logical plan, ``all()`` lowers it to one lazy DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelbase.operators import aggregates, textsearch, vectors
from kestrelbase.operators.aggregates import Agg
from kestrelbase.plans import expressions as ex


@dataclass(frozen=True)
class Query:
    """Immutable; every call returns a new query.  Several conditions are AND-ed."""

    df: DataFrame
    name: str = "collection"
    conditions: tuple[ex.Expr, ...] = ()
    order: tuple[tuple[str, bool], ...] = ()
    limit_to: int = 0
    skip: int = 0
    columns: tuple[str, ...] = ()
    without: tuple[str, ...] = ()
    groups: tuple[str, ...] = ()
    aggs: tuple[Agg, ...] = ()
    mode: str = "rows"
    conditions_after: tuple[ex.Expr, ...] = ()
    unique: bool = False
    near: tuple[str, tuple[float, ...], str] | None = None
    words: tuple[str, str | None] | None = None
    key: str = field(default="_id")

    def where(self, condition: str | ex.Expr) -> Field | Query:
        """A field name opens a comparison, an expression is added as it is."""
        return Field(self, condition) if isinstance(condition, str) else replace(self, conditions=(*self.conditions, condition))

    def order_by(self, name: str, descending: bool = False) -> Query:
        return replace(self, order=(*self.order, (name, descending)))

    def limit(self, n: int) -> Query:
        """0 or less: no limit."""
        return replace(self, limit_to=n)

    def offset(self, n: int) -> Query:
        return replace(self, skip=n)

    def top_k(self, k: int) -> Query:
        return self.limit(k)

    def select(self, *names: str) -> Query:
        return replace(self, columns=names)

    def exclude(self, *names: str) -> Query:
        return replace(self, without=names)

    def distinct(self) -> Query:
        return replace(self, unique=True)

    def group_by(self, *names: str) -> Query:
        return replace(self, groups=names)

    def agg(self, *aggs: Agg, mode: str = "rows") -> Query:
        return replace(self, aggs=aggs, mode=mode)

    def having(self, condition: ex.Expr) -> Query:
        return replace(self, conditions_after=(*self.conditions_after, condition))

    def vector_near(self, name: str, vector: list[float], metric: str = "cosine") -> Query:
        """Rank what passes the conditions by distance; with ``top_k`` the nearest k."""
        return replace(self, near=(name, tuple(vector), metric))

    def text(self, query: str, name: str | None = None) -> Query:
        """Rank what passes the conditions by BM25 with the statistics of all documents; no name: all string fields."""
        return replace(self, words=(query, name))

    def keyed(self, key: str) -> Query:
        """The column that breaks ties in rankings."""
        return replace(self, key=key)

    def all(self) -> DataFrame:
        df = self.df
        condition = ex.compile_expr(ex.And(*self.conditions), df.schema) if self.conditions else None
        if self.words:
            df = textsearch.bm25(df, self.words[0], 0, self.words[1], self.key, condition)
        elif condition is not None:
            df = df.filter(condition)
        if self.near:
            name, vector, metric = self.near
            df = df.filter(F.size(name) == len(vector)).withColumn("distance", vectors.distance(F.col(name), list(vector), metric))
        if self.groups or self.aggs:
            df = aggregates.group(df, list(self.groups), list(self.aggs), self.mode)
        if self.conditions_after:
            df = df.filter(ex.compile_expr(ex.And(*self.conditions_after), df.schema))
        if self.columns:
            df = df.select(*(F.col(f"`{c}`") for c in self.columns))
        if self.without:
            df = df.drop(*self.without)
        if self.unique:
            df = df.distinct()
        order = [F.col(f"`{n}`").desc() if down else F.col(f"`{n}`").asc() for n, down in self.order]
        if self.near and not order:
            order = [F.col("distance"), F.col(self.key)]
        if order:
            df = df.orderBy(*order)
        if self.skip > 0:
            df = df.offset(self.skip)
        return df.limit(self.limit_to) if self.limit_to > 0 else df

    def first(self) -> DataFrame:
        """At most one row; none where nothing matches."""
        return replace(self, limit_to=1).all()

    def count(self) -> DataFrame:
        """One row, ``count``: the rows after offset and limit."""
        return self.all().agg(F.count(F.lit(1)).alias("count"))

    def describe(self) -> str:
        """The logical plan on one line, outermost first."""
        parts = [f"{'TextScan' if self.words else 'CollectionScan'}({self.name})"]
        if self.conditions:
            parts.append("Filter")
        if self.near:
            parts.append(f"VectorNear({self.near[0]}, {self.near[2]})")
        if self.groups or self.aggs:
            parts.append(f"Aggregate({', '.join(self.groups)})")
        if self.conditions_after:
            parts.append("Having")
        if self.columns or self.without:
            parts.append("Project")
        if self.unique:
            parts.append("Distinct")
        if self.order:
            parts.append("Sort")
        if self.limit_to > 0 or self.skip > 0:
            parts.append(f"Limit({self.limit_to}, offset={self.skip})")
        return " -> ".join(reversed(parts))

    def explain(self) -> str:
        """The one-line plan and Spark's formatted physical plan."""
        physical = self.df.sparkSession._jvm.PythonSQLUtils.explainString(self.all()._jdf.queryExecution(), "formatted")
        return f"{self.describe()}\n{physical}"


@dataclass(frozen=True)
class Field:
    """An opened condition on one field."""

    query: Query
    name: str

    def _with(self, e: ex.Expr) -> Query:
        return self.query.where(e)

    def eq(self, v: Any) -> Query:
        return self._with(ex.eq(self.name, v))

    def ne(self, v: Any) -> Query:
        return self._with(ex.ne(self.name, v))

    def gt(self, v: Any) -> Query:
        return self._with(ex.gt(self.name, v))

    def gte(self, v: Any) -> Query:
        return self._with(ex.gte(self.name, v))

    def lt(self, v: Any) -> Query:
        return self._with(ex.lt(self.name, v))

    def lte(self, v: Any) -> Query:
        return self._with(ex.lte(self.name, v))

    def between(self, low: Any, high: Any) -> Query:
        return self._with(ex.between(self.name, low, high))

    def in_(self, *v: Any) -> Query:
        return self._with(ex.in_(self.name, *v))

    def not_in(self, *v: Any) -> Query:
        return self._with(ex.not_in(self.name, *v))

    def contains(self, v: str) -> Query:
        return self._with(ex.contains(self.name, v))

    def starts_with(self, v: str) -> Query:
        return self._with(ex.starts_with(self.name, v))

    def ends_with(self, v: str) -> Query:
        return self._with(ex.ends_with(self.name, v))

    def equal_fold(self, v: str) -> Query:
        return self._with(ex.equal_fold(self.name, v))

    def exists(self) -> Query:
        return self._with(ex.exists(self.name))

    def missing(self) -> Query:
        return self._with(ex.missing(self.name))
