"""Time series: inclusive ranges, exact tags, rollups on fixed intervals, retention."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Seconds from the Unix epoch to 0001-01-01 00:00 UTC, which all buckets are aligned to.
ORIGIN_SECONDS = -62135596800
OPS = ("count", "sum", "avg", "min", "max")


def bucket(ts: Column, seconds: int) -> Column:
    """The half-open window [start, end) of fixed width that holds ``ts``."""
    if seconds <= 0:
        raise ValueError("the interval must be positive")
    return F.window(ts, f"{seconds} seconds", startTime=f"{ORIGIN_SECONDS % seconds} seconds")


def rollup_value(value: Column, op: str) -> Column:
    """count counts points; the others look at numeric values only and give 0.0 without any."""
    if op == "count":
        return F.count(F.lit(1)).cast("double")
    if op not in OPS:
        raise ValueError(f"unknown rollup: {op}")
    return F.coalesce({"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[op](value), F.lit(0.0))


def rollup(df: DataFrame, value: str, seconds: int, op: str, ts: str = "ts") -> DataFrame:
    """start, end, count, value of every bucket that has points."""
    numeric = isinstance(df.schema[value].dataType, T.NumericType) if value in df.columns else False
    x = F.col(value).cast("double") if numeric else F.lit(None).cast("double")
    grouped = df.groupBy(bucket(F.col(ts), seconds).alias("w")).agg(F.count(F.lit(1)).alias("count"), rollup_value(x, op).alias("value"))
    return grouped.select("w.start", "w.end", "count", "value")


def prune(df: DataFrame, cutoff: Any, ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """(what stays, one row ``removed``): points strictly before the cutoff go."""
    old = F.col(ts) < F.lit(cutoff)
    return df.filter(~F.coalesce(old, F.lit(False))), df.agg(F.count_if(old).alias("removed"))


def write(series: DataFrame, points: DataFrame, now: Any = None, ts: str = "ts") -> DataFrame:
    """``series`` with ``points`` added; a point without a time gets ``now`` (by default when the query runs), and tags or fields that one side lacks are null."""
    when = F.lit(now) if now is not None else F.current_timestamp()
    given = F.col(ts) if ts in points.columns else F.lit(None)
    stamped = points.withColumn(ts, F.coalesce(given.cast(series.schema[ts].dataType), when.cast(series.schema[ts].dataType)))
    return series.unionByName(stamped, allowMissingColumns=True)


@dataclass(frozen=True)
class TimeQuery:
    """Range, tags, order and limit apply to points, before any rollup."""

    df: DataFrame
    ts: str = "ts"
    key: str | None = None
    start: Any = None
    end: Any = None
    tags: tuple[tuple[str, str], ...] = ()
    descending: bool = False
    limit_to: int = 0

    def range(self, start: Any = None, end: Any = None) -> TimeQuery:
        """Inclusive at both ends; None leaves a side open."""
        return replace(self, start=start, end=end)

    def tag(self, name: str, value: str) -> TimeQuery:
        """Exact equality; the last value given for a name holds."""
        return replace(self, tags=(*(t for t in self.tags if t[0] != name), (name, value)))

    def desc(self) -> TimeQuery:
        return replace(self, descending=True)

    def limit(self, n: int) -> TimeQuery:
        return replace(self, limit_to=n)

    def _tag(self, name: str) -> Column:
        if "tags" in self.df.columns and isinstance(self.df.schema["tags"].dataType, T.MapType):
            return F.col("tags")[name]
        return F.col(name)

    def points(self, ordered: bool = True) -> DataFrame:
        df = self.df
        if self.start is not None:
            df = df.filter(F.col(self.ts) >= F.lit(self.start))
        if self.end is not None:
            df = df.filter(F.col(self.ts) <= F.lit(self.end))
        for name, value in self.tags:
            df = df.filter(self._tag(name) == value)
        if ordered or self.limit_to > 0:
            keys = [self.ts, *([self.key] if self.key else [])]
            df = df.orderBy(*(F.col(k).desc() if self.descending else F.col(k).asc() for k in keys))
        return df.limit(self.limit_to) if self.limit_to > 0 else df

    def all(self) -> DataFrame:
        return self.points()

    def aggregate(self, value: str, seconds: int, op: str) -> DataFrame:
        return rollup(self.points(ordered=False), value, seconds, op, self.ts).orderBy("start")
