"""Publish/subscribe routing: exact topics, wildcards, consumer groups and bounded buffers."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from kestrelbase.operators.numbering import numbered

#: Subscriptions compiled into one pass over the messages.
BLOCK = 256


@dataclass(frozen=True)
class Subscription:
    subscriber: str
    pattern: str


def pattern_regex(pattern: str) -> str:
    """``*`` is one segment, ``>`` all that remain, also none; what follows ``>`` is ignored."""
    parts = []
    for i, segment in enumerate(pattern.split(".")):
        if segment == ">":
            return "^" + ("" if i == 0 else r"\.".join(parts) + r"(\..*)?") + ("" if i else ".*") + "$"
        parts.append("[^.]*" if segment == "*" else re.escape(segment))
    return "^" + r"\.".join(parts) + "$"


def matches(topic: Column, pattern: str) -> Column:
    return topic.rlike(pattern_regex(pattern)) if any(s in ("*", ">") for s in pattern.split(".")) else topic == pattern


def route(messages: DataFrame, subscriptions: list[Subscription]) -> DataFrame:
    """A row with ``subscriber`` for every delivery of every message.

    The subscriptions are the stated query set: blocks of them are compiled into one expression each, so messages are
    neither shuffled nor joined.
    """
    out = None
    for i in range(0, len(subscriptions), BLOCK):
        who = F.array_compact(F.array(*(F.when(matches(F.col("topic"), s.pattern), F.lit(s.subscriber)) for s in subscriptions[i : i + BLOCK])))
        part = messages.withColumn("subscriber", F.explode(who))
        out = part if out is None else out.unionAll(part)
    return messages.withColumn("subscriber", F.lit(None).cast("string")).limit(0) if out is None else out


def deliveries(messages: DataFrame, subscriptions: list[Subscription]) -> DataFrame:
    """Messages with the number of subscribers each reaches."""
    return messages.withColumn("deliveries", sum((F.coalesce(matches(F.col("topic"), s.pattern), F.lit(False)).cast("int") for s in subscriptions), F.lit(0)))


def round_robin(messages: DataFrame, topic: str, members: list[str], order: list[str], part: Column) -> DataFrame:
    """Messages of exactly ``topic`` with the group member each goes to; the first goes to the second member."""
    own = numbered(messages.filter(F.col("topic") == topic), ["topic"], order, part)
    return own.withColumn("member", F.element_at(F.array(*map(F.lit, members)), (F.pmod("nth", F.lit(len(members))) + 1).cast("int")))


def bounded(delivered: DataFrame, size: int, order: list[Column], policy: str = "drop_oldest", by: str = "subscriber") -> DataFrame:
    """What a buffer of ``size`` holds for each subscriber when none is taken out: the last (drop_oldest) or first (drop_newest) ones.

    Spark limits each task's groups to ``size`` rows before it shuffles.
    """
    if policy not in ("drop_oldest", "drop_newest"):
        raise ValueError(f"unknown policy: {policy}")
    keys = [o.desc() if policy == "drop_oldest" else o.asc() for o in order]
    return delivered.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(*keys))).filter(F.col("__n") <= size).drop("__n")
