"""JSON requests to lazy DataFrames: the shapes that an HTTP layer would pass on."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelbase.operators import textsearch, timeseries, vectors
from kestrelbase.plans import expressions as ex
from kestrelbase.plans.query import Query
from kestrelbase.sources.catalog import Catalog


def documents(catalog: Catalog, request: dict[str, Any]) -> DataFrame:
    """{collection, filters: [{field, op, value}], order_by, order_desc, limit, offset, select}."""
    q = Query(catalog.get("collection", request["collection"]), request["collection"])
    if request.get("filters"):
        q = q.where(ex.from_json(request["filters"]))
    if request.get("order_by"):
        q = q.order_by(request["order_by"], bool(request.get("order_desc")))
    if request.get("select"):
        q = q.select(*request["select"])
    return q.offset(int(request.get("offset", 0))).limit(int(request.get("limit", 0))).all()


def vector_search(catalog: Catalog, request: dict[str, Any]) -> DataFrame:
    """{collection, field, vector, k, metric, filters, key}: the nearest k with distance and similarity in percent."""
    df = catalog.get("collection", request["collection"])
    if request.get("filters"):
        df = df.filter(ex.compile_expr(ex.from_json(request["filters"]), df.schema))
    hits = vectors.top_k(df, request["vector"], int(request.get("k", 10)), request["field"], request.get("key", "_id"), request.get("metric", "cosine"))
    return hits.withColumn("similarity", vectors.similarity_percent(F.col("distance")))


def text_search(catalog: Catalog, request: dict[str, Any]) -> DataFrame:
    """{collection, query, field, k, key}; without a field all string fields are searched."""
    return textsearch.bm25(catalog.get("collection", request["collection"]), request["query"], int(request.get("k", 10)), request.get("field") or None, request.get("key", "_id"))


def time_series(catalog: Catalog, request: dict[str, Any]) -> DataFrame:
    """{series, start, end, tags, desc, limit, aggregate: {field, seconds, op}}; an empty time leaves a side open."""
    q = timeseries.TimeQuery(catalog.get("series", request["series"])).range(*(F.to_timestamp(F.lit(t)) if t else None for t in (request.get("start"), request.get("end"))))
    for name, value in (request.get("tags") or {}).items():
        q = q.tag(name, value)
    if request.get("desc"):
        q = q.desc()
    q = q.limit(int(request.get("limit", 0)))
    if a := request.get("aggregate"):
        return q.aggregate(a["field"], int(a["seconds"]), a["op"])
    return q.all()


def listing(catalog: Catalog, kind: str) -> DataFrame:
    """One row for each object of a kind, by name."""
    return catalog.spark.createDataFrame([(n,) for n in catalog.names(kind)], "name string")
