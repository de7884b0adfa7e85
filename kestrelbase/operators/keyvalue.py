"""Key/value views over an append-only log of operations.

The log has (key, seq, op, value) rows, and more columns as operations need them.  Last-write-wins and
counters are partial aggregates.  Conditional writes depend on the state before them, so
those logs are replayed in order, key by key, streaming through sorted partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(log: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """The last operation of every key; a last ``delete`` leaves none."""
    rest = [c for c in log.columns if c != key]
    last = log.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("v"))
    return last.select(key, *(F.col(f"v.{c}").alias(c) for c in rest)).filter("op <> 'delete'")


def counters(log: DataFrame, key: str = "key", delta: str = "delta") -> DataFrame:
    """The sum of all increments and decrements of every key."""
    return log.groupBy(key).agg(F.sum(delta).cast("long").alias("value"))


def live(kv: DataFrame, now: Any, expire_at: str = "expire_at") -> DataFrame:
    """Entries without an expiry or with a later one than ``now``."""
    return kv.filter(F.col(expire_at).isNull() | (F.col(expire_at) > F.lit(now)))


def expired(kv: DataFrame, now: Any, expire_at: str = "expire_at") -> DataFrame:
    return kv.filter(F.col(expire_at) <= F.lit(now))


def scan_range(kv: DataFrame, start: Any = None, end: Any = None, key: str = "key") -> DataFrame:
    """[start, end) in ascending key order; None leaves a side open."""
    if start is not None:
        kv = kv.filter(F.col(key) >= F.lit(start))
    if end is not None:
        kv = kv.filter(F.col(key) < F.lit(end))
    return kv.orderBy(key)


def scan_prefix(kv: DataFrame, prefix: str, key: str = "key") -> DataFrame:
    return kv.filter(F.col(key).startswith(prefix)).orderBy(key)


def scan_reverse(kv: DataFrame, key: str = "key") -> DataFrame:
    return kv.orderBy(F.desc(key))


def get(kv: DataFrame, value: Any, key: str = "key") -> DataFrame:
    return kv.filter(F.col(key) == F.lit(value)).limit(1)


def replay(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results: key, seq, op, applied) and (state: key, value) of a log with conditional writes.

    The log has key string, seq long, op, value string, expected string.  put and delete always
    apply, put_if_absent where the key has no value, cas where the value is ``expected`` (NULL:
    no value), incr adds value to a counter.  Rows stream through sorted partitions; a key's
    state is all that is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, waiting = None, None, None
        kinds = [pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.bool_()]

        def send(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 6, kinds, strict=True)], names=["key", "seq", "op", "applied", "value", "last"])

        for rb in batches:
            out = []
            for key, seq, op, value, expected in zip(*(rb.column(c).to_pylist() for c in ("key", "seq", "op", "value", "expected")), strict=True):
                if waiting is not None:
                    # a key's last operation is the one before another key's first
                    out.append((*waiting, key != now))
                if key != now or waiting is None:
                    now, state = key, None
                applied = True
                if op == "put":
                    state = value
                elif op == "delete":
                    applied, state = state is not None, None
                elif op == "put_if_absent":
                    applied = state is None
                    state = value if applied else state
                elif op == "cas":
                    applied = state == expected
                    state = value if applied else state
                elif op == "incr":
                    state = str(_number(state) + _number(value))
                else:
                    raise ValueError(f"unknown operation: {op}")
                waiting = (key, seq, op, applied, state)
            yield send(out)
        if waiting is not None:
            yield send([(*waiting, True)])

    sorted_log = log.select("key", "seq", "op", "value", "expected").repartition("key").sortWithinPartitions("key", "seq")
    ran = sorted_log.mapInArrow(run, "key string, seq long, op string, applied boolean, value string, last boolean")
    return ran.select("key", "seq", "op", "applied"), ran.filter("last and value is not null").select("key", "value")


def _number(text: str | None) -> int:
    try:
        return int(text or 0)
    except ValueError:
        return 0
