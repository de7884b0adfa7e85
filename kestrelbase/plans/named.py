"""Named queries over the driver's tables and the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrelbase.functions import rules
from kestrelbase.operators import dedup, keyvalue, mutate, queue, textsearch, timeseries, topics, vectors
from kestrelbase.operators.aggregates import Agg
from kestrelbase.operators.timeseries import TimeQuery
from kestrelbase.plans import api
from kestrelbase.plans import expressions as ex
from kestrelbase.plans.query import Query
from kestrelbase.sources.catalog import Catalog
from kestrelbase.streaming import pipelines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

LINE_KEY = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
#: A fixed 64-dimensional query vector.
PROBE = [((i * 37) % 64 - 31.5) / 64 for i in range(64)]
SQL_PROBE = "[" + ", ".join(map(str, PROBE)) + "]::DOUBLE[]"
WORDS = "the thand in the"
NOW = datetime(2024, 1, 20)


def query(sql: str | None = None):
    """Register a function under its name, with the SQL it must agree with."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# documents


@query("SELECT * FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45 ORDER BY l_extendedprice DESC, l_orderkey, l_partkey, l_suppkey, l_linenumber LIMIT 20")
def doc_filter_sort_limit(s, d):
    q = Query(table(s, d, "lineitem"), "lineitem").where("l_returnflag").eq("R").where("l_quantity").gte(45).order_by("l_extendedprice", True)
    for k in LINE_KEY[:4]:
        q = q.order_by(k)
    return q.limit(20).all()


def _orders(s, d):
    """Orders with a field that some documents lack."""
    return table(s, d, "orders").withColumn("note", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority"))).withColumn("score", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice")))


SQL_ORDERS = "(SELECT *, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS note, CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END AS score FROM orders)"


def _on_orders(name: str, expr: ex.Expr, condition: str) -> None:
    def run(s, d):
        return Query(_orders(s, d), "orders").where(expr).select("o_orderkey", "note", "score").all()

    run.__name__ = name
    query(f"SELECT o_orderkey, note, score FROM {SQL_ORDERS} WHERE {condition}")(run)


_on_orders("doc_eq", ex.eq("note", "1-URGENT"), "note = '1-URGENT'")
_on_orders("doc_ne_missing", ex.ne("note", "1-URGENT"), "note IS DISTINCT FROM '1-URGENT'")
_on_orders("doc_gt", ex.gt("score", 150000.0), "score > 150000")
_on_orders("doc_gte", ex.gte("score", 150000), "score >= 150000")
_on_orders("doc_lt", ex.lt("score", 20000.0), "score < 20000")
_on_orders("doc_lte", ex.lte("score", 20000), "score <= 20000")
_on_orders("doc_eq_nil", ex.eq("note", None), "note IS NULL")
_on_orders("doc_ne_nil", ex.ne("note", None), "note IS NOT NULL")
_on_orders("doc_and_or_not", (ex.eq("note", "2-HIGH") | ex.gt("score", 200000.0)) & ~ex.lt("score", 100000.0), "(note = '2-HIGH' OR score > 200000) AND NOT coalesce(score < 100000, false)")
_on_orders("doc_not_in", ex.not_in("note", "1-URGENT", "2-HIGH"), "NOT coalesce(note IN ('1-URGENT', '2-HIGH'), false)")
_on_orders("doc_in_nil", ex.in_("note", "1-URGENT", None), "note = '1-URGENT' OR note IS NULL")
_on_orders("doc_exists", ex.exists("score"), "score IS NOT NULL")
_on_orders("doc_missing", ex.missing("score"), "score IS NULL")
_on_orders("doc_json_filters", ex.from_json([{"field": "note", "op": "startsWith", "value": "1"}, {"field": "score", "op": "lte", "value": 100000.0}]), "starts_with(note, '1') AND score <= 100000")


def _on_part(name: str, expr: ex.Expr, condition: str) -> None:
    def run(s, d):
        return Query(table(s, d, "part"), "part").where(expr).select("p_partkey", "p_name", "p_size").all()

    run.__name__ = name
    query(f"SELECT p_partkey, p_name, p_size FROM part WHERE {condition}")(run)


_on_part("doc_between", ex.between("p_size", 10, 20), "p_size BETWEEN 10 AND 20")
_on_part("doc_in", ex.in_("p_size", 1, 5, 9), "p_size IN (1, 5, 9)")
_on_part("doc_contains", ex.contains("p_name", "old"), "contains(p_name, 'old')")
_on_part("doc_startswith", ex.starts_with("p_type", "S"), "starts_with(p_type, 'S')")
_on_part("doc_endswith", ex.ends_with("p_name", "widget"), "ends_with(p_name, 'widget')")
_on_part("doc_equal_fold", ex.equal_fold("p_brand", "bRAND#1"), "lower(p_brand) = 'brand#1'")


def _on_tags(name: str, expr: ex.Expr, condition: str) -> None:
    def run(s, d):
        return Query(_tagged(s, d), "orders").where(expr).select("o_orderkey", "tags").all()

    run.__name__ = name
    query(f"SELECT o_orderkey, tags FROM {SQL_TAGGED} WHERE {condition}")(run)


def _tagged(s, d):
    """Orders with an array of one or two tags, or none at all."""
    both = F.array("o_orderstatus", "o_orderpriority")
    return table(s, d, "orders").withColumn("tags", F.when(F.col("o_orderkey") % 3 == 0, F.array("o_orderstatus")).when(F.col("o_orderkey") % 7 != 0, both))


SQL_TAGGED = "(SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN [o_orderstatus] WHEN o_orderkey % 7 <> 0 THEN [o_orderstatus, o_orderpriority] END AS tags FROM orders)"
_on_tags("doc_array_contains", ex.array_contains("tags", "F"), "list_contains(tags, 'F')")
_on_tags("doc_array_any", ex.array_any("tags", "F", "1-URGENT"), "list_has_any(tags, ['F', '1-URGENT'])")
_on_tags("doc_array_all", ex.array_all("tags", "F", "1-URGENT"), "list_has_all(tags, ['F', '1-URGENT'])")
_on_tags("doc_array_size", ex.array_size("tags", 2), "len(tags) = 2")


@query("SELECT * FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 25")
def doc_offset_page(s, d):
    return Query(table(s, d, "customer")).order_by("c_custkey").offset(25).limit(10).all()


@query("SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey LIMIT 50")
def doc_multi_sort(s, d):
    return Query(table(s, d, "customer")).select("c_custkey", "c_mktsegment", "c_acctbal").order_by("c_mktsegment").order_by("c_acctbal", True).order_by("c_custkey").limit(50).all()


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS bal FROM customer ORDER BY bal NULLS FIRST, c_custkey LIMIT 40")
def doc_sort_nulls(s, d):
    df = table(s, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("bal"))
    return Query(df).order_by("bal").order_by("c_custkey").limit(40).all()


@query("SELECT count(*) AS count FROM (SELECT 1 FROM orders WHERE o_orderstatus = 'F' LIMIT 100 OFFSET 7)")
def doc_count_after_limit(s, d):
    return Query(table(s, d, "orders")).where("o_orderstatus").eq("F").offset(7).limit(100).count()


@query("SELECT * FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def doc_first(s, d):
    return Query(table(s, d, "orders")).where("o_orderstatus").eq("O").order_by("o_totalprice", True).order_by("o_orderkey").first()


@query("SELECT * FROM customer WHERE c_custkey = 42")
def doc_point_get(s, d):
    return keyvalue.get(table(s, d, "customer"), 42, "c_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 5000")
def doc_select(s, d):
    return Query(table(s, d, "customer")).where("c_acctbal").gt(5000.0).select("c_custkey", "c_name").all()


@query("SELECT * EXCLUDE (c_name, c_acctbal) FROM customer")
def doc_exclude(s, d):
    return Query(table(s, d, "customer")).exclude("c_name", "c_acctbal").all()


# aggregates

ALL_AGGS = [Agg("count", alias="n"), Agg("sum", "l_quantity"), Agg("avg", "l_extendedprice"), Agg("min", "l_discount"), Agg("max", "l_tax")]
SQL_AGGS = "count(*) AS n, round(sum(l_quantity), 6) AS l_quantity_sum, round(avg(l_extendedprice), 6) AS l_extendedprice_avg, round(min(l_discount), 6) AS l_discount_min, round(max(l_tax), 6) AS l_tax_max"
AGG_DOUBLES = ("l_quantity_sum", "l_extendedprice_avg", "l_discount_min", "l_tax_max")


@query(f"SELECT l_returnflag, l_linestatus, {SQL_AGGS} FROM lineitem GROUP BY ALL")
def agg_group_all(s, d):
    return rounded(Query(table(s, d, "lineitem")).group_by("l_returnflag", "l_linestatus").agg(*ALL_AGGS).all(), *AGG_DOUBLES)


@query(f"SELECT {SQL_AGGS} FROM lineitem HAVING count(*) > 0")
def agg_global(s, d):
    return rounded(Query(table(s, d, "lineitem")).agg(*ALL_AGGS).all(), *AGG_DOUBLES)


@query(f"SELECT o_orderstatus, count(*) AS n, round(coalesce(sum(score), 0.0) / count(*), 6) AS score_avg FROM {SQL_ORDERS} GROUP BY ALL")
def agg_avg_rows(s, d):
    return rounded(Query(_orders(s, d)).group_by("o_orderstatus").agg(Agg("count", alias="n"), Agg("avg", "score")).all(), "score_avg")


@query(f"SELECT note, round(avg(score), 6) AS score_avg FROM {SQL_ORDERS} GROUP BY ALL")
def agg_avg_values(s, d):
    return rounded(Query(_orders(s, d)).group_by("note").agg(Agg("avg", "score"), mode="values").all(), "score_avg")


@query("SELECT l_suppkey, count(*) AS n, round(sum(l_quantity), 6) AS l_quantity_sum FROM lineitem GROUP BY ALL HAVING count(*) > 60")
def agg_having(s, d):
    q = Query(table(s, d, "lineitem")).group_by("l_suppkey").agg(Agg("count", alias="n"), Agg("sum", "l_quantity")).having(ex.gt("n", 60))
    return rounded(q.all(), "l_quantity_sum")


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def agg_distinct(s, d):
    return Query(table(s, d, "lineitem")).select("l_returnflag", "l_linestatus").distinct().all()


@query("SELECT l_returnflag, count(DISTINCT l_suppkey) AS l_suppkey_count_distinct FROM lineitem GROUP BY ALL")
def agg_count_distinct(s, d):
    return Query(table(s, d, "lineitem")).group_by("l_returnflag").agg(Agg("count_distinct", "l_suppkey")).all()


# time series


def _events(s, d):
    return TimeQuery(table(s, d, "events"), key="event_id")


@query("SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-06' ORDER BY ts, event_id")
def ts_range(s, d):
    return _events(s, d).range(datetime(2024, 1, 5), datetime(2024, 1, 6)).all()


@query("SELECT * FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 25")
def ts_tag_desc_limit(s, d):
    return _events(s, d).tag("event_type", "click").desc().limit(25).all()


def _sql_rollup(width: str, value: str, source: str = "events") -> str:
    return f"SELECT b AS start, b + INTERVAL {width} AS \"end\", count(*) AS count, round({value}, 6) AS value FROM (SELECT *, time_bucket(INTERVAL {width}, ts, TIMESTAMP '0001-01-01') AS b FROM {source}) GROUP BY b"


def _rollup(name: str, op: str, seconds: int, width: str, value: str) -> None:
    def run(s, d):
        return rounded(_events(s, d).aggregate("value", seconds, op), "value")

    run.__name__ = name
    query(_sql_rollup(width, value))(run)


for _op, _value in (("count", "count(*)::DOUBLE"), ("sum", "sum(value)"), ("avg", "avg(value)"), ("min", "min(value)"), ("max", "max(value)")):
    _rollup(f"ts_rollup_{_op}", _op, 3600, "1 HOUR", _value)
_rollup("ts_rollup_weekly", "avg", 7 * 86400, "7 DAY", "avg(value)")
_rollup("ts_rollup_7min", "sum", 420, "7 MINUTE", "sum(value)")


@query(_sql_rollup("1 DAY", "coalesce(avg(value), 0.0)", "(SELECT * REPLACE (CASE WHEN event_type <> 'error' AND event_id % 2 = 0 THEN value END AS value) FROM events WHERE event_type IN ('error', 'view'))"))
def ts_rollup_missing_field(s, d):
    df = table(s, d, "events").filter(F.col("event_type").isin("error", "view")).withColumn("value", F.when((F.col("event_type") != "error") & (F.col("event_id") % 2 == 0), F.col("value")))
    return rounded(TimeQuery(df).aggregate("value", 86400, "avg"), "value")


@query("SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-15'")
def ts_prune(s, d):
    return timeseries.prune(table(s, d, "events"), datetime(2024, 1, 15))[0]


@query("SELECT count(*) AS removed FROM events WHERE ts < TIMESTAMP '2024-01-15'")
def ts_prune_count(s, d):
    return timeseries.prune(table(s, d, "events"), datetime(2024, 1, 15))[1]


@query(
    "SELECT b AS start, b + INTERVAL 1 DAY AS \"end\", count(*) AS count, round(avg(value), 6) AS value FROM (SELECT value, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '0001-01-01') AS b FROM "
    "(SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 500)) GROUP BY b"
)
def ts_limit_then_rollup(s, d):
    return rounded(TimeQuery(table(s, d, "events"), key="event_id").desc().limit(500).aggregate("value", 86400, "avg"), "value")


@query(
    "SELECT ts, event_id, value, NULL::VARCHAR AS unit FROM events UNION ALL SELECT coalesce(CASE WHEN event_id % 10 <> 0 THEN ts END, TIMESTAMP '2024-01-20'), event_id + 1000000, NULL::DOUBLE, 'new' FROM events WHERE event_id % 5 = 0"
)
def ts_write(s, d):
    events = table(s, d, "events").select("ts", "event_id", "value")
    points = events.filter("event_id % 5 = 0").select(F.when(F.col("event_id") % 10 != 0, F.col("ts")).alias("ts"), (F.col("event_id") + 1000000).alias("event_id"), F.lit("new").alias("unit"))
    return timeseries.write(events, points, NOW)


# vectors


def _nearest(name: str, metric: str, sql: str) -> None:
    def run(s, d):
        return rounded(vectors.top_k(table(s, d, "embeddings"), PROBE, 10, metric=metric).select("vec_id", "distance"), "distance")

    run.__name__ = name
    query(f"SELECT vec_id, round({sql}, 6) AS distance FROM embeddings ORDER BY {sql}, vec_id LIMIT 10")(run)


SQL_COSINE = f"(1 - list_cosine_similarity(embedding::DOUBLE[], {SQL_PROBE}))"
SQL_L2 = f"list_distance(embedding::DOUBLE[], {SQL_PROBE})"
_nearest("vec_topk_cosine", "cosine", SQL_COSINE)
_nearest("vec_topk_l2", "l2", SQL_L2)
_nearest("vec_topk_l2_squared", "l2_squared", f"({SQL_L2} * {SQL_L2})")
_nearest("vec_topk_dot", "dot", f"(-list_dot_product(embedding::DOUBLE[], {SQL_PROBE}))")


@query(f"SELECT vec_id, label, round({SQL_COSINE}, 6) AS distance FROM embeddings WHERE label = 3 ORDER BY {SQL_COSINE}, vec_id LIMIT 5")
def vec_filtered_topk(s, d):
    q = Query(table(s, d, "embeddings"), key="vec_id").where("label").eq(3).vector_near("embedding", PROBE).top_k(5)
    return rounded(q.all().select("vec_id", "label", "distance"), "distance")


@query(f"SELECT vec_id, round(CASE WHEN x <= 0 THEN 100 WHEN x <= 1 THEN (1 - x) * 100 ELSE 100 / (1 + x) END, 6) AS similarity FROM (SELECT vec_id, {SQL_L2} AS x FROM embeddings)")
def vec_similarity_pct(s, d):
    df = table(s, d, "embeddings")
    return df.select("vec_id", F.round(vectors.similarity_percent(vectors.distance(F.col("embedding"), PROBE, "l2")), 6).alias("similarity"))


@query()
def vec_inverted_file_search(s, d):
    df = table(s, d, "embeddings")
    index = vectors.inverted_file(df)
    return rounded(index.search_all(df.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 10), "distance")


# text

TERMS = textsearch.query_terms(WORDS)


def _sql_bm25(k: int, condition: str = "true", text: str = "text", table: str = "documents") -> str:
    terms = ", ".join(f"('{t}', {m})" for t, m in TERMS.items())
    return rf"""
WITH tok AS (SELECT doc_id, lang, list_transform(regexp_extract_all({text}, '[\p{{L}}\p{{Nd}}]+'), lambda w: lower(w)) AS t FROM {table}),
t2 AS (SELECT doc_id, lang, len(t) AS dl, unnest(t) AS w FROM tok WHERE len(t) > 0),
st AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS avgdl FROM tok WHERE len(t) > 0),
qt(w, m) AS (VALUES {terms}),
ps AS (SELECT doc_id, lang, dl, w, count(*) AS tf FROM t2 WHERE w IN (SELECT w FROM qt) GROUP BY ALL),
df AS (SELECT w, count(*) AS df FROM ps GROUP BY w)
SELECT doc_id, round(sum(m * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * 0.25 + 1.2 * 0.75 / avgdl * dl)), 6) AS score
FROM ps JOIN df USING (w) JOIN qt USING (w), st WHERE {condition} GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT {k}"""


@query(_sql_bm25(10))
def text_bm25_topk(s, d):
    return rounded(textsearch.bm25(table(s, d, "documents"), WORDS, 10).select("doc_id", "score"), "score")


@query(_sql_bm25(10, "lang = 'en'"))
def text_bm25_filtered(s, d):
    q = Query(table(s, d, "documents"), key="doc_id").where("lang").eq("en").text(WORDS, "text").limit(10)
    return rounded(q.all().select("doc_id", "score"), "score")


@query(_sql_bm25(10, text="concat_ws(' ', text, lang, source)"))
def text_bm25_all_fields(s, d):
    return rounded(textsearch.bm25(table(s, d, "documents"), WORDS, 10, None).select("doc_id", "score"), "score")


@query(_sql_bm25(10))
def text_bm25_stored_index(s, d):
    return rounded(textsearch.search_index(textsearch.build_index(table(s, d, "documents")), WORDS, 10), "score")


@query(_sql_bm25(10, table="(SELECT * FROM documents WHERE doc_id % 3 <> 0)"))
def text_bm25_after_removal(s, d):
    docs = table(s, d, "documents")
    return rounded(textsearch.search_index(textsearch.remove(textsearch.build_index(docs), docs.filter("doc_id % 3 = 0")), WORDS, 10), "score")


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{Nd}]+')) AS n_tokens FROM documents")
def text_token_counts(s, d):
    return table(s, d, "documents").select("doc_id", F.size(textsearch.tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query(
    f"WITH t AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM ({_sql_bm25(50)})), "
    f"v AS (SELECT vec_id AS id, row_number() OVER (ORDER BY {SQL_COSINE}, vec_id) AS r FROM embeddings ORDER BY r LIMIT 50) "
    "SELECT id, round(sum(1.0::DOUBLE / (60 + r)), 6) AS score FROM (SELECT * FROM t UNION ALL SELECT * FROM v) GROUP BY id ORDER BY sum(1.0::DOUBLE / (60 + r)) DESC, id LIMIT 10"
)
def hybrid_rrf(s, d):
    hits = rounded(textsearch.bm25(table(s, d, "documents"), WORDS, 50).select("doc_id", "score"), "score")
    near = vectors.top_k(table(s, d, "embeddings"), PROBE, 50)
    return rounded(textsearch.fuse([(hits, "doc_id", F.desc("score")), (near, "vec_id", F.asc("distance"))], 10), "score")


# key/value


@query("SELECT c_name AS key, c_mktsegment AS value FROM customer WHERE c_name >= 'Customer#000000010' AND c_name < 'Customer#000000031' ORDER BY 1")
def kv_range(s, d):
    kv = table(s, d, "customer").select(F.col("c_name").alias("key"), F.col("c_mktsegment").alias("value"))
    return keyvalue.scan_range(kv, "Customer#000000010", "Customer#000000031")


@query("SELECT c_name AS key, c_acctbal AS value FROM customer WHERE starts_with(c_name, 'Customer#00000001') ORDER BY 1")
def kv_prefix(s, d):
    return keyvalue.scan_prefix(table(s, d, "customer").select(F.col("c_name").alias("key"), F.col("c_acctbal").alias("value")), "Customer#00000001")


@query("SELECT c_name AS key, c_custkey AS value FROM customer ORDER BY 1 DESC LIMIT 30")
def kv_reverse(s, d):
    return keyvalue.scan_reverse(table(s, d, "customer").select(F.col("c_name").alias("key"), F.col("c_custkey").alias("value"))).limit(30)


def _log(s, d):
    return table(s, d, "events").select(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"), "value")


SQL_LOG = "(SELECT 'user:' || user_id AS key, event_id AS seq, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op, value FROM events)"


@query(f"SELECT key, seq, op, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM {SQL_LOG}) WHERE r = 1 AND op <> 'delete'")
def kv_latest_wins(s, d):
    return keyvalue.latest(_log(s, d))


@query("SELECT 'user:' || user_id AS key, sum(CASE WHEN event_type = 'click' THEN 2 ELSE -1 END)::BIGINT AS value FROM events GROUP BY 1")
def kv_counter(s, d):
    log = table(s, d, "events").select(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"), F.when(F.col("event_type") == "click", 2).otherwise(-1).alias("delta"))
    return keyvalue.counters(log)


@query("SELECT event_id, ts + INTERVAL 10 DAY AS expire_at FROM events WHERE ts + INTERVAL 10 DAY > TIMESTAMP '2024-01-20'")
def kv_ttl_live(s, d):
    return keyvalue.live(table(s, d, "events").select("event_id", (F.col("ts") + F.expr("INTERVAL 10 DAYS")).alias("expire_at")), NOW)


@query(
    "WITH RECURSIVE o AS (SELECT 'user:' || user_id AS key, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'put_if_absent' WHEN 'error' THEN 'delete' WHEN 'click' THEN 'incr' WHEN 'view' THEN 'cas' ELSE 'put' END AS op, (event_id % 7)::VARCHAR AS value, "
    "CASE WHEN event_id % 4 <> 0 THEN (event_id % 3)::VARCHAR END AS expected, "
    "row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events), "
    "f AS (SELECT key, seq, op, r, op <> 'delete' AND (op <> 'cas' OR expected IS NULL) AS applied, CASE WHEN op = 'delete' OR (op = 'cas' AND expected IS NOT NULL) THEN NULL ELSE value END AS state FROM o WHERE r = 1 "
    "UNION ALL SELECT o.key, o.seq, o.op, o.r, CASE WHEN o.op = 'put_if_absent' THEN f.state IS NULL WHEN o.op = 'delete' THEN f.state IS NOT NULL WHEN o.op = 'cas' THEN f.state IS NOT DISTINCT FROM o.expected ELSE true END, "
    "CASE WHEN o.op = 'cas' AND f.state IS DISTINCT FROM o.expected THEN f.state WHEN o.op = 'put_if_absent' THEN coalesce(f.state, o.value) WHEN o.op = 'delete' THEN NULL WHEN o.op = 'incr' THEN (coalesce(f.state, '0')::BIGINT + o.value::BIGINT)::VARCHAR ELSE o.value END "
    "FROM f JOIN o ON o.key = f.key AND o.r = f.r + 1) SELECT key, seq, op, applied FROM f"
)
def kv_conditional_writes(s, d):
    kind = F.when(F.col("event_type") == "purchase", "put_if_absent").when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "click", "incr").when(F.col("event_type") == "view", "cas").otherwise("put")
    log = table(s, d, "events").select(
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"), F.col("event_id").alias("seq"), kind.alias("op"), (F.col("event_id") % 7).cast("string").alias("value"), F.when(F.col("event_id") % 4 != 0, (F.col("event_id") % 3).cast("string")).alias("expected")
    )
    return keyvalue.replay(log)[0]


# updates and schema rules


@query(
    "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority, "
    "o_totalprice + 1.5 AS o_totalprice, list_filter(list_append([o_orderstatus], 'new'), lambda x: x <> 'F') AS tags FROM orders"
)
def upd_set_unset_inc_push_remove(s, d):
    df = table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice", F.array("o_orderstatus").alias("tags"))
    df = mutate.set_(df, "o_orderstatus", "X", F.col("o_orderkey") % 2 == 0)
    df = mutate.unset(df, "o_orderpriority", F.col("o_orderkey") % 3 == 0)
    return mutate.remove(mutate.push(mutate.increment(df, "o_totalprice", 1.5), "tags", "new"), "tags", "F")


@query("SELECT c_custkey, greatest(c_acctbal, 0.0) AS low, least(c_acctbal, 5000.0) AS high, c_nationkey - 2 AS c_nationkey, CASE WHEN c_custkey % 2 = 0 THEN 'none' ELSE c_mktsegment END AS segment FROM customer")
def upd_min_max_dec_rename(s, d):
    df = table(s, d, "customer").select("c_custkey", F.col("c_acctbal").alias("low"), F.col("c_acctbal").alias("high"), "c_nationkey", F.when(F.col("c_custkey") % 2 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    df = mutate.decrement(mutate.at_most(mutate.at_least(df, "low", 0.0), "high", 5000.0), "c_nationkey", 2)
    return mutate.rename(mutate.set_if_missing(df, "c_mktsegment", "none"), "c_mktsegment", "segment")


@query("SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_suppkey % 4 = 0 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier WHERE s_suppkey % 5 <> 0")
def upd_upsert_delete(s, d):
    df = table(s, d, "supplier")
    new = df.filter("s_suppkey % 4 = 0").withColumn("s_acctbal", F.lit(0.0))
    return mutate.delete(mutate.upsert(df, new, "s_suppkey"), df.filter("s_suppkey % 5 = 0"), "s_suppkey").select(*df.columns)


@query("SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_suppkey % 4 = 0 THEN 1.0 WHEN s_suppkey % 6 = 0 THEN 2.0 ELSE s_acctbal END AS s_acctbal FROM supplier UNION ALL SELECT s_suppkey + 1000000, s_name, s_nationkey, 2.0 FROM supplier WHERE s_suppkey % 6 = 0")
def upd_insert_replace(s, d):
    df = table(s, d, "supplier")
    six = df.filter("s_suppkey % 6 = 0").withColumn("s_acctbal", F.lit(2.0))
    added = mutate.insert(df, six.union(six.withColumn("s_suppkey", F.col("s_suppkey") + 1000000)), "s_suppkey")
    # replacing ignores what has no predecessor
    four = df.filter("s_suppkey % 4 = 0").withColumn("s_acctbal", F.lit(1.0))
    return mutate.replace(added, four.union(four.withColumn("s_suppkey", F.col("s_suppkey") + 2000000)), "s_suppkey").select(*df.columns)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN [o_orderstatus] WHEN o_orderstatus = 'F' THEN ['F'] ELSE [o_orderstatus, 'F'] END AS a, CASE WHEN o_orderkey % 5 = 0 THEN ['x'] ELSE [o_orderpriority, 'x'] END AS b FROM orders")
def upd_pop_add_to_set(s, d):
    df = table(s, d, "orders").select("o_orderkey", F.array("o_orderstatus", "o_orderpriority").alias("a"), F.when(F.col("o_orderkey") % 5 != 0, F.array("o_orderpriority")).alias("b"))
    df = mutate.add_to_set(mutate.pop(df, "a"), "a", "F", F.col("o_orderkey") % 2 != 0)
    return mutate.add_to_set(df, "b", "x")


@query(f"SELECT note, NULL::DOUBLE AS score, count(*) AS n FROM {SQL_ORDERS} WHERE note IS NOT NULL GROUP BY note HAVING count(*) > 1")
def unique_violations_sparse(s, d):
    return mutate.unique_violations(_orders(s, d).withColumn("score", F.lit(None).cast("double")), ["note", "score"], sparse=True)


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def unique_violations(s, d):
    return mutate.unique_violations(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'c_acctbal: below minimum' WHEN c_acctbal > 9000 THEN 'c_acctbal: above maximum' WHEN NOT regexp_matches(c_mktsegment, '^[A-M]') THEN 'c_mktsegment: pattern' END AS violation FROM customer WHERE violation IS NOT NULL")
def schema_violations(s, d):
    known = {"c_custkey": rules.Rule(required=True, type="int"), "c_acctbal": rules.Rule(type="float", min=0, max=9000), "c_mktsegment": rules.Rule(type="string", pattern="^[A-M]")}
    return rules.validate(table(s, d, "customer"), known)[1].select("c_custkey", "violation")


# queues and topics


def _messages(s, d):
    return table(s, d, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("queue"), (F.col("user_id") % 4 * 60).alias("priority"), F.col("ts").alias("visible_at"), F.col("ts").alias("created_at"),
        F.when(F.col("event_id") % 5 == 0, F.col("ts") + F.expr("INTERVAL 12 DAYS")).alias("expire_at"), (F.col("event_id") % 7).alias("retry_count"), F.lit(5).alias("max_retries"),
        F.when(F.col("event_id") % 11 == 0, "in_flight").when(F.col("event_id") % 13 == 0, "dead").otherwise("ready").alias("state"),
    )


SQL_MESSAGES = (
    "(SELECT event_id AS id, event_type AS queue, user_id % 4 * 60 AS priority, ts AS visible_at, ts AS created_at, CASE WHEN event_id % 5 = 0 THEN ts + INTERVAL 12 DAY END AS expire_at, event_id % 7 AS retry_count, 5 AS max_retries, "
    "CASE WHEN event_id % 11 = 0 THEN 'in_flight' WHEN event_id % 13 = 0 THEN 'dead' ELSE 'ready' END AS state FROM events)"
)


@query(
    f"SELECT id, priority, visible_at FROM {SQL_MESSAGES} WHERE visible_at <= TIMESTAMP '2024-01-20' AND (expire_at IS NULL OR expire_at > TIMESTAMP '2024-01-20') AND (state = 'ready' OR (state = 'in_flight' AND retry_count < max_retries)) "
    "ORDER BY priority DESC, visible_at, id LIMIT 50"
)
def queue_dequeue_order(s, d):
    return queue.dequeue(_messages(s, d), NOW, 50).select("id", "priority", "visible_at")


@query(f"SELECT queue, state, count(*) AS n FROM {SQL_MESSAGES} GROUP BY ALL")
def queue_state_counts(s, d):
    return queue.state_counts(_messages(s, d))


@query(f"SELECT id, queue FROM {SQL_MESSAGES} WHERE state = 'dead' OR (state = 'in_flight' AND retry_count >= 5 AND id % 2 = 0)")
def queue_dlq(s, d):
    m = _messages(s, d)
    return queue.dead_letters(queue.nack(m, m.filter("id % 2 = 0"))).select("id", "queue")


@query(f"SELECT id, CASE WHEN state = 'in_flight' AND id % 3 <> 0 AND visible_at <= TIMESTAMP '2024-01-20' THEN CASE WHEN retry_count >= 5 THEN 'dead' ELSE 'ready' END ELSE state END AS state, CASE WHEN state = 'in_flight' AND id % 3 = 0 THEN TIMESTAMP '2024-01-20 00:01:00' ELSE visible_at END AS visible_at FROM {SQL_MESSAGES} WHERE NOT (state = 'in_flight' AND id % 2 = 0)")
def queue_ack_extend_expire(s, d):
    m = _messages(s, d)
    open_ = queue.extend(queue.ack(m, m.filter("id % 2 = 0")), m.filter("id % 3 = 0"), NOW, 60.0)
    return queue.expire_leases(open_, NOW).select("id", "state", F.col("visible_at").cast("timestamp_ntz").alias("visible_at"))


@query()
def queue_replay(s, d):
    kind = F.when(F.col("event_type").isin("view", "signup", "purchase"), "enqueue").when(F.col("event_type") == "click", "dequeue").otherwise("nack")
    log = table(s, d, "events").select(
        (F.col("user_id") % 20).cast("string").alias("queue"), F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("at"), kind.alias("op"), F.col("event_id").cast("string").alias("id"),
        F.to_json(F.struct((F.col("event_id") % 256).alias("priority"), F.col("user_id").cast("string").alias("dedup_id"))).alias("args"),
    )
    return queue.replay(log.withColumn("at", F.col("at") / 1e6))


@query(
    "WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, ts FROM events), a AS (SELECT user_id, event_type, min(ts) AS ts FROM e GROUP BY ALL UNION ALL "
    "SELECT a.user_id, a.event_type, min(e.ts) FROM a JOIN e ON e.user_id = a.user_id AND e.event_type = a.event_type AND e.ts >= a.ts + INTERVAL 1 DAY GROUP BY a.user_id, a.event_type, a.ts) "
    "SELECT user_id, event_type, ts FROM a"
)
def dedup_fixed_window(s, d):
    return dedup.fixed_window(table(s, d, "events"), ["user_id", "event_type"], 86400, tie="event_id").select("user_id", "event_type", "ts")


def _published(s, d):
    return table(s, d, "events").select("event_id", "ts", F.concat_ws(".", F.lit("events"), "event_type", F.col("user_id").cast("string")).alias("topic"))


SQL_PUBLISHED = "(SELECT event_id, ts, 'events.' || event_type || '.' || user_id AS topic FROM events)"
SUBSCRIPTIONS = [topics.Subscription("all", "events.>"), topics.Subscription("clicks", "events.click.*"), topics.Subscription("seven", "events.*.7"), topics.Subscription("exact", "events.view.3")]
SQL_ROUTED = (
    f"(SELECT *, unnest(list_filter([CASE WHEN regexp_matches(topic, '^events(\\..*)?$') THEN 'all' END, CASE WHEN regexp_matches(topic, '^events\\.click\\.[^.]*$') THEN 'clicks' END, "
    f"CASE WHEN regexp_matches(topic, '^events\\.[^.]*\\.7$') THEN 'seven' END, CASE WHEN topic = 'events.view.3' THEN 'exact' END], lambda x: x IS NOT NULL)) AS subscriber FROM {SQL_PUBLISHED})"
)


@query(f"SELECT event_id, topic, subscriber FROM {SQL_ROUTED}")
def topic_route_wildcard(s, d):
    return topics.route(_published(s, d), SUBSCRIPTIONS).select("event_id", "topic", "subscriber")


@query("SELECT event_id, ['m0', 'm1', 'm2'][(row_number() OVER (ORDER BY ts, event_id)) % 3 + 1] AS member FROM events WHERE event_type = 'click'")
def topic_group_round_robin(s, d):
    sent = table(s, d, "events").withColumn("topic", F.col("event_type"))
    return topics.round_robin(sent, "click", ["m0", "m1", "m2"], ["ts", "event_id"], F.date_trunc("day", "ts")).select("event_id", "member")


@query(f"SELECT event_id, subscriber FROM (SELECT *, row_number() OVER (PARTITION BY subscriber ORDER BY ts DESC, event_id DESC) AS r FROM {SQL_ROUTED}) WHERE r <= 16")
def topic_drop_oldest(s, d):
    return topics.bounded(topics.route(_published(s, d), SUBSCRIPTIONS), 16, [F.col("ts"), F.col("event_id")]).select("event_id", "subscriber")


@query(f"SELECT event_id, subscriber FROM (SELECT *, row_number() OVER (PARTITION BY subscriber ORDER BY ts, event_id) AS r FROM {SQL_ROUTED}) WHERE r <= 16")
def topic_drop_newest(s, d):
    return topics.bounded(topics.route(_published(s, d), SUBSCRIPTIONS), 16, [F.col("ts"), F.col("event_id")], "drop_newest").select("event_id", "subscriber")


@query(f"SELECT event_id, count(subscriber)::INTEGER AS deliveries FROM {SQL_PUBLISHED} LEFT JOIN (SELECT event_id, subscriber FROM {SQL_ROUTED}) USING (event_id) GROUP BY event_id")
def topic_publish_counts(s, d):
    return topics.deliveries(_published(s, d), SUBSCRIPTIONS).select("event_id", "deliveries")


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def json_props_extract(s, d):
    return table(s, d, "events").select("event_id", F.try_variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"))


@query("SELECT * FROM (VALUES ('customer'), ('orders')) AS t(name)")
def catalog_names(s, d):
    known = Catalog(s)
    for name in ("orders", "customer"):
        known.register("collection", name, table(s, d, name))
    known.register("series", "events", table(s, d, "events"))
    return api.listing(known, "collection")


# streams


@query(
    "SELECT b AS start, b + INTERVAL 1 DAY AS \"end\", event_type, count(*) AS count, round(sum(value), 6) AS total FROM (SELECT *, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '0001-01-01') AS b FROM events) GROUP BY b, event_type"
)
def stream_rollup(s, d):
    out = pipelines.drain(pipelines.rollup(pipelines.read_table(s, d, "events"), "value", 86400, by=["event_type"]), "complete")
    return rounded(out, "total").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query(
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 DAY THEN 0 ELSE 1 END AS new FROM events), "
    "n AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) "
    "SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 1 DAY AS \"end\", count(*) AS count FROM n GROUP BY user_id, k"
)
def stream_session(s, d):
    out = pipelines.drain(pipelines.sessions(pipelines.read_table(s, d, "events"), "user_id", "1 day"), "complete")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query(
    "WITH RECURSIVE a AS (SELECT user_id, min(ts) AS ts FROM events GROUP BY user_id UNION ALL SELECT a.user_id, min(e.ts) FROM a JOIN events e ON e.user_id = a.user_id AND e.ts >= a.ts + INTERVAL 1 DAY GROUP BY a.user_id, a.ts) SELECT user_id, ts FROM a"
)
def stream_dedup(s, d):
    out = pipelines.drain(pipelines.fixed_window_dedup(pipelines.read_table(s, d, "events"), ["user_id"], 86400))
    return out.select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
