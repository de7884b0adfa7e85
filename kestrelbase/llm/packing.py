"""Variable-capacity best-fit packing.

Texts are packed whole into sequences of one of several permitted lengths; one longer
than the longest is first cut into pieces of that length and a rest.  Best-fit decreasing takes
pieces by falling length: a piece goes into the open bin that it leaves the least room in; if
none has room, a bin of the size that costs least per token is opened.  At the end each
bin shrinks to the smallest permitted length that holds its contents.  All choices of which sizes
may be opened are tried and the cheapest kept.

As lengths are bounded, the whole packing follows from how many pieces have each length: equal
bins are handled as ranges, not one by one.  The driver sees a histogram of at most as
many entries as the longest sequence has tokens, at any corpus size; pieces then find
their bin by length and rank.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelbase.llm import textvec as tv
from kestrelbase.llm.common import keep, map_texts, ranked
from kestrelbase.llm.tokencount import Lengths, count_pass

CAPACITIES = (512, 1024, 2048, 4096)
#: Cost of a sequence of c tokens: OVERHEAD + c + QUADRATIC * c * c.
OVERHEAD, QUADRATIC = 128.0, 1 / 8192


def cost(c: int) -> float:
    return OVERHEAD + c + QUADRATIC * c * c


def pack_with(histogram: dict[int, int], opened: tuple[int, ...], capacities: tuple[int, ...]) -> tuple[list[tuple[int, int, int, int, int, int]], list[tuple[int, int, int]], float]:
    """Best-fit decreasing of a histogram of lengths, opening only sizes of ``opened``.

    Returns placements (length, first rank, pieces a bin, first bin, bins, offset in the bin), final
    bins (first bin, bins, contents), and the cost after every bin has shrunk.
    """
    room: dict[int, list[list[int]]] = {}  # by room left: ranges [first bin, bins, contents]
    open_rooms = np.zeros(max(opened) + 1, bool)
    placed: list[tuple[int, int, int, int, int, int]] = []
    bins = 0

    def put(left: int, first: int, n: int, contents: int) -> None:
        room.setdefault(left, []).append([first, n, contents])
        open_rooms[left] = True

    for length in sorted(histogram, reverse=True):
        rank, rest = 0, histogram[length]
        while rest:
            fits = open_rooms[length:].argmax() + length
            if not open_rooms[fits]:
                size = min((c for c in opened if c >= length), key=lambda c: (cost(c) / c, c))
                each = size // length
                n = -(-rest // each)
                put(size, bins, n, 0)
                bins += n
                continue
            ranges = room[fits]
            first, n, contents = ranges.pop()
            each = fits // length
            whole = min(n, rest // each)
            if whole:
                placed.append((length, rank, each, first, whole, contents))
                put(fits - each * length, first, whole, contents + each * length)
                rank += whole * each
                rest -= whole * each
                first, n = first + whole, n - whole
            if n and rest:
                placed.append((length, rank, rest, first, 1, contents))
                put(fits - rest * length, first, 1, contents + rest * length)
                first, n, rest = first + 1, n - 1, 0
            if n:
                room[fits].append([first, n, contents])
            if not room[fits]:
                del room[fits]
                open_rooms[fits] = False
    final = sorted((f, n, c) for ranges in room.values() for f, n, c in ranges)
    total = sum(n * cost(min(c for c in capacities if c >= contents)) for _, n, contents in final)
    return placed, final, total


def pack_histogram(histogram: dict[int, int], capacities: tuple[int, ...] = CAPACITIES):
    """The cheapest of ``pack_with`` over all subsets of sizes that include the longest."""
    longest = max(capacities)
    others = [c for c in capacities if c != longest]
    choices = [(*some, longest) for k in range(len(others) + 1) for some in combinations(others, k)]
    return min((pack_with(histogram, c, capacities) for c in choices), key=lambda x: x[2])


def token_lengths(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, tokens): every row's tokens and one for the end of the text."""

    def score(column: pa.Array) -> dict[str, np.ndarray]:
        table = _worker_table(tokenizer_path)
        parts = [count_pass(buf, offs, tokenizer_path, table) + 1 for _, _, buf, offs in tv.passes(column)]
        return {"tokens": np.concatenate(parts) if parts else np.zeros(0, np.int64)}

    return map_texts(docs.select("doc_id", "text"), score, {"tokens": pa.int64()}, "doc_id long, tokens long")


_tables: dict[str, Lengths] = {}


def _worker_table(path: str) -> Lengths:
    if path not in _tables:
        _tables[path] = Lengths([], np.zeros(0, np.int32))
    return _tables[path]


def pack(docs: DataFrame, tokenizer_path: str, capacities: tuple[int, ...] = CAPACITIES) -> DataFrame:
    """doc_id, piece, first_token, n_tokens, bin_id, bin_offset, bin_capacity: one row for every piece of every row of ``docs``.

    n_tokens counts an end-of-text token after each text's last one, so a null or empty text
    is a piece of one token; a text longer than the longest sequence is several pieces.  Null and repeated ids are packed like
    others; columns besides doc_id and text are ignored, whatever their names; an empty table gives no rows.
    Pieces of one length take their places by doc_id (null first), then piece; those that tie in both are alike but for
    their places.
    """
    longest = max(capacities)
    lengths = token_lengths(docs, tokenizer_path)
    pieces = keep(
        lengths.select("doc_id", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("tokens") - 1) / longest))).alias("piece")).select(
            "doc_id", F.col("piece").cast("int").alias("piece"), (F.col("piece") * longest).alias("first_token"), F.least(F.lit(longest), F.col("tokens") - F.col("piece") * longest).cast("int").alias("n_tokens")
        )
    )
    histogram = {int(k): int(n) for k, n in pieces.groupBy("n_tokens").agg(F.count(F.lit(1))).collect()}
    schema = "doc_id long, piece int, first_token long, n_tokens int, bin_id long, bin_offset int, bin_capacity int"
    if not histogram:
        return docs.sparkSession.createDataFrame([], schema)
    placed, final, _ = pack_histogram(histogram, capacities)
    where = np.array(sorted(placed), np.int64)
    ends = np.array(final, np.int64)
    sizes = np.array(sorted(capacities))
    shared = docs.sparkSession.sparkContext.broadcast((where, ends[:, 0], sizes[np.searchsorted(sizes, ends[:, 2])]))
    numbered = ranked(pieces, "n_tokens", ["doc_id", "piece"], "rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, firsts, capacity = shared.value
        keys = table[:, 0] * (1 << 44) + table[:, 1]
        for rb in batches:
            n, rank = rb.column("n_tokens").to_numpy().astype(np.int64), rb.column("rank").to_numpy()
            row = table[np.searchsorted(keys, n * (1 << 44) + rank, side="right") - 1]
            since = rank - row[:, 1]
            bin_id = row[:, 3] + since // row[:, 2]
            offset = row[:, 5] + since % row[:, 2] * n
            size = capacity[np.searchsorted(firsts, bin_id, side="right") - 1]
            yield pa.RecordBatch.from_arrays(
                [*(rb.column(c) for c in ("doc_id", "piece", "first_token", "n_tokens")), pa.array(bin_id), pa.array(offset.astype(np.int32)), pa.array(size.astype(np.int32))],
                names=["doc_id", "piece", "first_token", "n_tokens", "bin_id", "bin_offset", "bin_capacity"],
            )

    return numbered.mapInArrow(place, schema)
