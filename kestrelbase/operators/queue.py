"""Message queues as tables: what is ready and in which order, states, and a replay of queue operations.

A message has id, queue, payload, priority, visible_at, created_at, expire_at, retry_count,
max_retries, state (ready, in_flight, dead), and dedup_id.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRIORITY, MAX_RETRIES, LEASE_SECONDS, DEDUP_SECONDS = 128, 5, 30.0, 600.0


def ready(messages: DataFrame, now: Any) -> DataFrame:
    """Ready, visible and unexpired messages, and leases that have run out with retries left."""
    now = F.lit(now)
    due = (F.col("visible_at") <= now) & (F.col("expire_at").isNull() | (F.col("expire_at") > now))
    return messages.filter(due & ((F.col("state") == "ready") | ((F.col("state") == "in_flight") & (F.col("retry_count") < F.col("max_retries")))))


def dequeue(messages: DataFrame, now: Any, n: int) -> DataFrame:
    """The next n messages: by falling priority, then by when they became visible, then by id."""
    return ready(messages, now).orderBy(F.desc("priority"), "visible_at", "id").limit(n)


def lease(messages: DataFrame, taken: DataFrame, now: Any, seconds: float = LEASE_SECONDS) -> DataFrame:
    """The table after ``taken`` was handed out: in flight, one more try, invisible until the lease ends."""
    own = taken.select("id", F.lit(True).alias("__taken"))
    j = messages.join(own, "id", "left")
    t = F.coalesce("__taken", F.lit(False))
    until = F.lit(now) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))
    return (
        j.withColumn("state", F.when(t, "in_flight").otherwise(F.col("state")))
        .withColumn("retry_count", F.col("retry_count") + t.cast("int"))
        .withColumn("visible_at", F.when(t, until).otherwise(F.col("visible_at")))
        .drop("__taken")
    )


def ack(messages: DataFrame, ids: DataFrame) -> DataFrame:
    """Acknowledged messages go; only those in flight can be."""
    done = messages.filter("state = 'in_flight'").join(ids.select("id"), "id", "left_semi").select("id")
    return messages.join(done, "id", "left_anti")


def nack(messages: DataFrame, ids: DataFrame, requeue: bool = True) -> DataFrame:
    """Back to ready, or to the dead letters without requeue or retries left."""
    own = ids.select("id", F.lit(True).alias("__n"))
    hit = F.coalesce("__n", F.lit(False)) & (F.col("state") == "in_flight")
    dead = F.lit(not requeue) | (F.col("retry_count") >= F.col("max_retries"))
    return messages.join(own, "id", "left").withColumn("state", F.when(hit & dead, "dead").when(hit, "ready").otherwise(F.col("state"))).drop("__n")


def extend(messages: DataFrame, ids: DataFrame, now: Any, seconds: float) -> DataFrame:
    """The table after the leases of ``ids`` were extended: they end ``seconds`` from now; only those in flight can be."""
    own = ids.select("id", F.lit(True).alias("__n"))
    hit = F.coalesce("__n", F.lit(False)) & (F.col("state") == "in_flight")
    until = F.lit(now) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))
    return messages.join(own, "id", "left").withColumn("visible_at", F.when(hit, until).otherwise(F.col("visible_at"))).drop("__n")


def expire_leases(messages: DataFrame, now: Any) -> DataFrame:
    """The table after a timer ran: leases that have run out go back to ready, or to the dead letters without retries left."""
    over = (F.col("state") == "in_flight") & (F.col("visible_at") <= F.lit(now))
    return messages.withColumn("state", F.when(over & (F.col("retry_count") >= F.col("max_retries")), "dead").when(over, "ready").otherwise(F.col("state")))


def dead_letters(messages: DataFrame) -> DataFrame:
    return messages.filter("state = 'dead'")


def state_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy("queue", "state").agg(F.count(F.lit(1)).alias("n"))


@dataclass
class Broker:
    """One queue's state while its operations are replayed in order of time (seconds).

    Messages wait in a heap by when they become visible, then in one by priority; leases and deduplication ids end in the order
    of their own heaps.  So an operation costs the logarithm of what is open, and what has ended is forgotten: of dead letters
    only their number is kept.
    """

    lease_seconds: float = LEASE_SECONDS
    dedup_seconds: float = DEDUP_SECONDS
    heap: list[tuple] = field(default_factory=list)
    delayed: list[tuple] = field(default_factory=list)
    flying: dict[str, dict] = field(default_factory=dict)
    leases: list[tuple] = field(default_factory=list)
    held: dict[str, dict] = field(default_factory=dict)
    dead: int = 0
    seen: dict[str, float] = field(default_factory=dict)
    ends: list[tuple] = field(default_factory=list)

    def dump(self) -> str:
        return json.dumps(vars(self))

    @classmethod
    def load(cls, text: str) -> Broker:
        state = json.loads(text)
        for name in ("heap", "delayed", "leases", "ends"):
            state[name] = [tuple(x) for x in state[name]]
        return cls(**state)

    def tick(self, now: float) -> None:
        """Leases that have run out go back to ready, or to the dead letters; what is due becomes visible; old ids are forgotten."""
        while self.leases and self.leases[0][0] <= now:
            _, key = heapq.heappop(self.leases)
            m = self.flying.get(key)
            if m is not None and m["visible"] <= now:
                self._back(self.flying.pop(key), now)
        while self.delayed and self.delayed[0][0] <= now:
            visible, key = heapq.heappop(self.delayed)
            m = self.held.get(key)
            if m is not None and m["visible"] == visible:
                heapq.heappush(self.heap, (-m["priority"], visible, key))
        while self.ends and self.ends[0][0] <= now:
            end, dup = heapq.heappop(self.ends)
            if self.seen.get(dup) == end:
                del self.seen[dup]

    def _wait(self, m: dict, now: float) -> None:
        self.held[m["id"]] = m
        if m["visible"] > now:
            heapq.heappush(self.delayed, (m["visible"], m["id"]))
        else:
            heapq.heappush(self.heap, (-m["priority"], m["visible"], m["id"]))

    def _back(self, m: dict, now: float) -> None:
        if m["tries"] >= m["max"]:
            self.dead += 1
        else:
            m["visible"] = min(m["visible"], now)
            self._wait(m, now)

    def apply(self, now: float, op: str, key: str | None, args: dict) -> tuple[bool, str | None]:
        """(whether it took effect, the message's id)."""
        self.tick(now)
        if op == "enqueue":
            dup = args.get("dedup_id")
            if dup is not None:
                if dup in self.seen:
                    return False, None
                self.seen[dup] = now + float(args.get("dedup_window", self.dedup_seconds))
                heapq.heappush(self.ends, (self.seen[dup], dup))
            self._wait({"id": key, "priority": args.get("priority", PRIORITY), "visible": now + args.get("delay", 0.0), "max": args.get("max_retries", MAX_RETRIES), "tries": 0, "expire": now + args["ttl"] if "ttl" in args else None}, now)
            return True, key
        if op == "dequeue":
            got = None
            while self.heap and got is None:
                _, visible, k = heapq.heappop(self.heap)
                m = self.held.get(k)
                if m is None or m["visible"] != visible:
                    continue
                del self.held[k]
                if m["expire"] is None or m["expire"] > now:
                    got = m
            if got is None:
                return False, None
            got["tries"] += 1
            got["visible"] = now + float(args.get("lease", self.lease_seconds))
            self.flying[got["id"]] = got
            heapq.heappush(self.leases, (got["visible"], got["id"]))
            return True, got["id"]
        m = self.flying.get(key)
        if m is None:
            return False, key
        if op == "ack":
            del self.flying[key]
        elif op == "nack":
            del self.flying[key]
            if not args.get("requeue", True):
                m["tries"] = m["max"]
            m["visible"] = now
            self._back(m, now)
        elif op == "extend":
            m["visible"] = now + float(args["by"])
            heapq.heappush(self.leases, (m["visible"], key))
        else:
            raise ValueError(f"unknown operation: {op}")
        return True, key


def replay(log: DataFrame) -> DataFrame:
    """queue, seq, op, applied, id of every operation of a log (queue, seq, at seconds, op, id, args JSON).

    Operations on a queue are sequential by nature; each queue streams through one sorted
    partition and only its open messages are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, broker = None, Broker()
        for rb in batches:
            out = []
            for queue, seq, at, op, key, args in zip(*(rb.column(c).to_pylist() for c in ("queue", "seq", "at", "op", "id", "args")), strict=True):
                if queue != now:
                    now, broker = queue, Broker()
                done, which = broker.apply(at, op, key, json.loads(args) if args else {})
                out.append((queue, seq, op, done, which))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 5, kinds, strict=True)], names=["queue", "seq", "op", "applied", "id"])

    return log.repartition("queue").sortWithinPartitions("queue", "seq").mapInArrow(run, "queue string, seq long, op string, applied boolean, id string")
