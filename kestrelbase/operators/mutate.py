"""Document updates as transformations of columns, and whole-row writes as joins.

``when`` picks the rows an update touches; all others stay as they are.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _change(df: DataFrame, field: str, new: Column, when: Column | None) -> DataFrame:
    if when is None:
        return df.withColumn(field, new)
    old = F.col(field) if field in df.columns else F.lit(None)
    return df.withColumn(field, F.when(when, new).otherwise(old))


def _as(df: DataFrame, field: str, value: Any) -> Column:
    c = F.lit(value)
    return c.cast(df.schema[field].dataType) if field in df.columns else c


def set_(df: DataFrame, field: str, value: Any, when: Column | None = None) -> DataFrame:
    return _change(df, field, value if isinstance(value, Column) else _as(df, field, value), when)


def unset(df: DataFrame, field: str, when: Column | None = None) -> DataFrame:
    """Drop the field, or make it missing in some rows."""
    return df.drop(field) if when is None else _change(df, field, F.lit(None), when)


def increment(df: DataFrame, field: str, delta: float, when: Column | None = None) -> DataFrame:
    """A missing field counts as 0; the field keeps its type."""
    if field not in df.columns:
        return _change(df, field, F.lit(delta), when)
    return _change(df, field, (F.coalesce(F.col(field), F.lit(0)) + F.lit(delta)).cast(df.schema[field].dataType), when)


def decrement(df: DataFrame, field: str, delta: float, when: Column | None = None) -> DataFrame:
    return increment(df, field, -delta, when)


def at_least(df: DataFrame, field: str, value: Any, when: Column | None = None) -> DataFrame:
    """Raise the field to ``value`` where it is less or missing."""
    return _change(df, field, F.greatest(F.col(field), _as(df, field, value)), when)


def at_most(df: DataFrame, field: str, value: Any, when: Column | None = None) -> DataFrame:
    return _change(df, field, F.least(F.col(field), _as(df, field, value)), when)


def push(df: DataFrame, field: str, value: Any, when: Column | None = None) -> DataFrame:
    """Append; a missing array becomes one of the value."""
    return _change(df, field, F.when(F.col(field).isNull(), F.array(F.lit(value))).otherwise(F.array_append(field, F.lit(value))), when)


def pop(df: DataFrame, field: str, when: Column | None = None) -> DataFrame:
    """Drop the last element."""
    return _change(df, field, F.slice(field, F.lit(1), F.greatest(F.size(field) - 1, F.lit(0))), when)


def remove(df: DataFrame, field: str, value: Any, when: Column | None = None) -> DataFrame:
    """Drop all elements that equal ``value``."""
    return _change(df, field, F.array_remove(field, value), when)


def add_to_set(df: DataFrame, field: str, value: Any, when: Column | None = None) -> DataFrame:
    held = F.when(F.col(field).isNull(), F.array(F.lit(value))).when(F.array_contains(field, value), F.col(field)).otherwise(F.array_append(field, F.lit(value)))
    return _change(df, field, held, when)


def rename(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.withColumnRenamed(old, new)


def set_if_missing(df: DataFrame, field: str, value: Any) -> DataFrame:
    return df.withColumn(field, F.coalesce(F.col(field), _as(df, field, value)) if field in df.columns else F.lit(value))


def upsert(df: DataFrame, new: DataFrame, key: str = "_id") -> DataFrame:
    """Rows of ``new`` take the place of those with their key; columns that one side lacks are null there."""
    return df.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def replace(df: DataFrame, new: DataFrame, key: str = "_id") -> DataFrame:
    """Like ``upsert``, but rows of ``new`` without a predecessor are ignored."""
    return upsert(df, new.join(df.select(key), key, "left_semi"), key)


def delete(df: DataFrame, keys: DataFrame, key: str = "_id") -> DataFrame:
    return df.join(keys.select(key), key, "left_anti")


def insert(df: DataFrame, new: DataFrame, key: str = "_id") -> DataFrame:
    """Insert rows; those without a key get one, and of equal keys the new row stays."""
    if key not in new.columns:
        new = new.withColumn(key, F.uuid() if hasattr(F, "uuid") else F.expr("uuid()"))
    return upsert(df, new.withColumn(key, F.coalesce(F.col(key), F.expr("uuid()"))), key)


def unique_violations(df: DataFrame, fields: list[str], sparse: bool = False) -> DataFrame:
    """Combinations that a unique index on ``fields`` forbids; a sparse one ignores rows that lack all of them."""
    if sparse:
        df = df.filter(F.coalesce(*(F.col(f).cast("string") for f in fields)).isNotNull())
    return df.groupBy(*fields).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
