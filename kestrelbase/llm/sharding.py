"""Sharding by minimax contiguous partition of ordered atomic groups.

Groups of equal texts are atomic and ordered by the MD5 of the text.  The smallest
capacity for which a greedy left-to-right fill needs at most ``shards`` shards is found
by binary search; the order is then cut within that capacity.

The group sizes never come to the driver as a whole.  The order is first summed into
4096 segments by the digest's first three hex digits.  Treating segments as atoms gives a
capacity that suffices, ``high``; every partition with a capacity up to ``high`` has its
k-th cut between total - (shards-k)*high and k*high.  Only segments in those intervals are
split by two more hex digits, until no segment there holds more than one group.  What the
driver sees is a few thousand sums at any corpus size.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelbase.llm.common import keep, ranked

FIRST, MORE = 3, 2


def greedy(sums: list[int], capacity: int, shards: int) -> bool:
    """Whether a greedy fill up to ``capacity`` needs at most ``shards`` shards. sums: prefix sums from 0."""
    at = 0
    for _ in range(shards):
        at = bisect_right(sums, sums[at] + capacity) - 1
        if at == len(sums) - 1:
            return True
    return False


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """The least capacity that ``greedy`` accepts."""
    sums = [0, *accumulate(sizes)]
    low, high = max([-(-sums[-1] // shards), *sizes]), sums[-1]
    while low < high:
        middle = (low + high) // 2
        if greedy(sums, middle, shards):
            high = middle
        else:
            low = middle + 1
    return low


def cuts(sizes: list[int], capacity: int, shards: int) -> list[int]:
    """Positions of the shards - 1 cuts, each as near to its even share as ``capacity`` permits."""
    sums = [0, *accumulate(sizes)]
    earliest = [len(sizes)]
    for _ in range(shards - 1):
        earliest.append(bisect_left(sums, sums[earliest[-1]] - capacity))
    earliest = earliest[:0:-1]
    out: list[int] = []
    for k in range(1, shards):
        since = out[-1] if out else 0
        latest = bisect_right(sums, sums[since] + capacity) - 1
        ideal = sums[-1] * k / shards
        at = bisect_left(sums, ideal)
        if at > 0 and (at == len(sums) or ideal - sums[at - 1] <= sums[at] - ideal):
            at -= 1
        out.append(min(max(at, earliest[k - 1], since), latest))
    return out


def cut_keys(groups: DataFrame, shards: int) -> tuple[int, list[str]]:
    """The smallest capacity and the first key of every shard but the first; groups: (key, size)."""

    def sums(of: DataFrame, digits: int) -> list[tuple[str, int, int, int]]:
        rows = of.groupBy(F.substring("key", 1, digits).alias("p")).agg(F.sum("size"), F.count(F.lit(1)), F.max("size")).collect()
        return [(p, int(s), int(n), int(m)) for p, s, n, m in rows]

    segments = sorted(sums(groups, FIRST))
    if not segments:
        return 0, ["~"] * (shards - 1)
    while True:
        sizes = [s[1] for s in segments]
        high, total = smallest_capacity(sizes, shards), sum(sizes)
        wanted, at = set(), 0
        for p, size, n, _ in segments:
            # strictly inside the segment, or at either end: any cut that a partition within `high` may make
            if n > 1 and any(total - (shards - k) * high <= at + size and at <= k * high for k in range(1, shards)):
                wanted.add(p)
            at += size
        if not wanted:
            return high, [segments[i][0] if i < len(segments) else "~" for i in cuts(sizes, high, shards)]
        finer = []
        for digits in sorted({len(p) for p in wanted}):
            prefixes = sorted(p for p in wanted if len(p) == digits)
            finer += sums(groups.filter(F.substring("key", 1, digits).isin(prefixes)), digits + MORE)
        segments = sorted([s for s in segments if s[0] not in wanted] + finer)


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``.

    The law is ``bytes``: shard sizes are as equal as whole groups of equal texts permit.
    A null text counts as the empty one: size 1, crc 0, one group.  Null and repeated ids
    are rows like others; a very long text is one group of its size, be it larger than an even share.
    Columns besides doc_id and text are ignored, whatever their names.  An empty table gives no rows.
    Slots number the rows of a shard from 0 without gaps by doc_id (null first), then by the text's digest; rows that tie
    in both are alike in all that is returned.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = keep(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.md5(text.cast("binary")).alias("key"),
        )
    )
    groups = keep(base.groupBy("key").agg(F.sum("size").alias("size")))
    _, firsts = cut_keys(groups, shards)
    at = F.lit(0)
    for k in firsts:
        at = at + (F.col("key") >= F.lit(k)).cast("int")
    placed = ranked(base.select("doc_id", "size", "text_crc32", "key", at.alias("shard")), "shard", ["doc_id", "key"], "slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
