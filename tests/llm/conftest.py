import random

import pytest
from pyspark.sql import types as T

#: A table of documents with columns that could clash with operators' own.
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
        T.StructField("size", T.StringType()), T.StructField("score", T.StringType()), T.StructField("n", T.StringType()), T.StructField("shard", T.StringType()), T.StructField("cid", T.StringType()),
    ]
)


@pytest.fixture(scope="session")
def make(spark):
    """(doc_id, text) pairs as a documents table."""

    def build(rows, slices=3):
        full = [(i, t, None, "src", None, "x", None, "y", "z", "c") for i, t in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(slices) if full else spark.createDataFrame([], SCHEMA)

    return build


def prose(rnd, n, vocabulary=400):
    return " ".join(f"w{rnd.randrange(vocabulary):03d}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty, blank, tiny, very long, tied and repeated rows."""
    rnd = random.Random(5)
    long = prose(rnd, 60_000, 5000)
    same = prose(rnd, 80)
    return [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one two"), (6, "one two three"), (7, long), (8, same), (9, same), (9, same), (None, same), (None, None), (10, "é漢🙂 ﬁn " * 30), (11, "x" * 50_000), (12, "<|endoftext|> it's  ok\r\n\r\n")]
