"""Full-text search: tokens, BM25, a stored index, and rank fusion with vector hits."""

from __future__ import annotations

from collections import Counter
from functools import reduce

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

K1, B = 1.2, 0.75
TOKEN = r"[\p{L}\p{Nd}]+"


def tokens(text: Column) -> Column:
    """Runs of letters and decimal digits, lower-cased after they are cut; null for null."""
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), 0), F.lower)


def query_terms(query: str) -> dict[str, int]:
    """Terms of a query and how often each is asked for."""
    return dict(Counter(t.lower() for t in regex.findall(TOKEN, query)))


def all_text(df: DataFrame) -> Column:
    """All top-level string columns, joined by blanks."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return F.concat_ws(" ", *(F.col(f"`{n}`") for n in names))


def score_expr(tf: Column, dl: Column, df: Column, n: Column, avgdl: Column) -> Column:
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B) + K1 * B * dl / avgdl)


def _equals(term: str):
    return lambda x: x == F.lit(term)


def _counts(text: Column, terms: dict[str, int]) -> Column:
    """__dl and __tf0, __tf1, ... of a text, generated from one token array: a filter on them can't be moved below it, which would cut the text again."""
    own = lambda t: F.struct(F.coalesce(F.size(t), F.lit(0)).alias("dl"), F.filter(t, lambda x: x.isin(*terms)).alias("held"))
    of = lambda r: F.struct(r["dl"].alias("__dl"), *(F.size(F.filter(r["held"], _equals(x))).alias(f"__tf{i}") for i, x in enumerate(terms)))
    return F.inline(F.transform(F.transform(F.array(tokens(text)), own), of))


def bm25(df: DataFrame, query: str, k: int = 10, text: str | None = "text", key: str = "doc_id", only: Column | None = None) -> DataFrame:
    """``df``'s rows that hold a query term, with ``score``, best first; ties go by key; k <= 0 gives all.

    Statistics are those of all rows; ``only`` restricts the hits.  A row's counts of the few query terms are
    taken from its token array, so nothing is exploded or shuffled: one aggregate gives the
    statistics, one row wide, and a second pass cuts and scores the rows that hold a term as a substring.
    """
    terms = query_terms(query)
    if not terms:
        return df.withColumn("score", F.lit(0.0)).limit(0)
    source = F.col(f"`{text}`") if text else all_text(df)
    held = reduce(lambda a, b: a | b, (F.col(f"__tf{i}") > 0 for i in range(len(terms))))
    stats = (
        df.select(_counts(source, terms)).filter("__dl > 0")
        .agg(F.count(F.lit(1)).cast("double").alias("__n"), F.avg("__dl").alias("__avgdl"), *(F.count_if(F.col(f"__tf{i}") > 0).cast("double").alias(f"__df{i}") for i in range(len(terms))))
    )
    hits = df if only is None else df.filter(only)
    if all(t.isascii() for t in terms):
        # lower-casing can depend on the letters around for other scripts only
        hits = hits.filter(reduce(lambda a, b: a | b, (F.lower(source).contains(t) for t in terms)))
    hits = hits.select("*", _counts(source, terms)).filter(held)
    # one row wide: a scalar subquery, computed once
    scored = hits.withColumn("__st", stats.select(F.struct(*stats.columns)).scalar())
    st = lambda name: F.col("__st")[name]
    score = reduce(
        lambda a, b: a + b,
        (F.lit(float(m)) * score_expr(F.col(f"__tf{i}").cast("double"), F.col("__dl").cast("double"), st(f"__df{i}"), st("__n"), st("__avgdl")) for i, m in enumerate(terms.values())),
    )
    out = scored.withColumn("score", score).select(*(f"`{c}`" for c in df.columns), "score").orderBy(F.desc("score"), key)
    return out.limit(k) if k > 0 else out


def build_index(df: DataFrame, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(postings: term, key, tf) and (lengths: key, dl); rows without tokens aren't counted."""
    held = df.select(key, tokens(F.col(text)).alias("t")).filter(F.size("t") > 0)
    lengths = held.select(key, F.size("t").alias("dl"))
    postings = held.select(key, F.explode("t").alias("term")).groupBy("term", key).agg(F.count(F.lit(1)).alias("tf"))
    return postings, lengths


def remove(index: tuple[DataFrame, DataFrame], keys: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The index without the documents in ``keys``."""
    return tuple(x.join(keys.select(key), key, "left_anti") for x in index)


def search_index(index: tuple[DataFrame, DataFrame], query: str, k: int = 10, key: str = "doc_id") -> DataFrame:
    """(key, score) by BM25 from a stored index; only the query terms' postings are read."""
    postings, lengths = index
    terms = query_terms(query)
    weights = postings.sparkSession.createDataFrame(list(terms.items()) or [("", 0)], "term string, m int")
    found = postings.filter(F.col("term").isin(*terms)) if terms else postings.limit(0)
    df = found.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df"))
    stats = lengths.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("dl").alias("avgdl"))
    # a row for each term of the query
    per_term = F.broadcast(df.join(weights, "term").withColumn("st", stats.select(F.struct("n", "avgdl")).scalar()))
    out = found.join(per_term, "term").join(lengths, key).groupBy(key).agg(F.sum(F.col("m") * score_expr(F.col("tf").cast("double"), F.col("dl").cast("double"), F.col("df"), F.col("st.n"), F.col("st.avgdl"))).alias("score"))
    out = out.orderBy(F.desc("score"), key)
    return out.limit(k) if k > 0 else out


def fuse(ranked: list[tuple[DataFrame, str, Column]], k: int, constant: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of top lists (hits, key, order): (id, score), best first.

    Each list is already cut to its top, so ranking it in one task is bounded by that cut.
    """
    parts = [hits.select(F.col(key).alias("id"), (1.0 / (constant + F.row_number().over(Window.orderBy(order, F.col(key))))).alias("s")) for hits, key, order in ranked]
    return reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.sum("s").alias("score")).orderBy(F.desc("score"), "id").limit(k)
