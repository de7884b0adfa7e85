"""From documents to packed training sequences: filter, deduplicate twice, decontaminate, pack.

Each stage takes what its predecessor kept, written as Parquet and read again.  Stages look at the columns doc_id and text and
pass all others through, whatever their names; texts are taken whole, however long; an empty table stays empty.  A row without an
id can't be named by a decision that goes by id, so it stays where it would be a near duplicate or a leak; by its own text it is
judged and cut like others.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from kestrelbase.llm import decontaminate, ngram_join, packing, quality, substring
from kestrelbase.llm.common import keep


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    A null or empty text has the score of the share of good labels alone.  Repeated rows get one score and go or stay together.
    """
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays: the one with the least id, and of rows that share it any one.

    Null and empty texts are similar to nothing and stay.
    """
    return ngram_join.one_of_each(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat earlier text are cut out of the texts; all rows stay.

    Earlier is by id (null last), then by the text's hash, then by place.  Null texts stay null; rows with one id and text are one text.
    """
    return substring.cut_texts(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold copies of test items go.

    Null and empty texts hold none; items without an id or text are left out.
    """
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into sequences of several lengths: a row for each piece of each text.

    A null or empty text is a piece of one token.  Pieces that tie in length go by id (null first) and piece.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", filter_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("substring dedup", cut_repeated_passages),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("best-fit packing", pack_sequences),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir))
    return docs
