"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

From every word of a test item starts a seed: the shortest n-gram, of two words or more, that is rare among the
items.  So the seeds of an item overlap by all but one word, and edited copies keep many: one with every third word changed
still holds a third of the item's pairs.  A pass finds the seeds in the training texts, and
wherever enough seeds of an item lie near one diagonal it aligns the item's words with the
words there.  The local alignment's score, over that of a perfect copy, decides, so
that edited copies with changed, lost or added words are found too.

The items are the stated query set: they are taken in blocks of bounded size, each broadcast
for a pass over all texts, so a larger benchmark means more passes and no larger broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelbase.llm import textvec as tv
from kestrelbase.llm.common import without_ids

U = np.uint64
#: Words of a seed, at least and at most, and items of a block that may share one for it to be rare: a seed of two words, and a longer one.
SEED, LONGEST = 2, 5
RARE_PAIR, RARE = 4, 64
#: Bytes of item text in a block, at most (a longer single item is a block of its own).
BLOCK_BYTES = 8 << 20
TABLE_BITS = 22
MATCH, MISMATCH, GAP = 2, -1, -1
#: Cells that one batch of alignments may have in a row.
CELLS = 1 << 18


@dataclass
class Items:
    """A block of items: ids, word hashes by item, and seeds sorted by hash with their item and place."""

    ids: list[int]
    words: list[np.ndarray]
    seeds: np.ndarray
    item: np.ndarray
    place: np.ndarray
    sizes: list[int]

    def __post_init__(self) -> None:
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        self.known = np.zeros(1 << TABLE_BITS, bool)
        self.known[(self.seeds >> U(64 - TABLE_BITS)).astype(np.int64)] = True

    def find(self, grams: np.ndarray) -> np.ndarray:
        """Indices of the grams that are seeds."""
        at = np.flatnonzero(self.known[(grams >> U(64 - TABLE_BITS)).astype(np.int64)])
        if not len(at) or not len(self.seeds):
            return at[:0]
        lo = np.minimum(np.searchsorted(self.seeds, grams[at]), len(self.seeds) - 1)
        return at[self.seeds[lo] == grams[at]]


def split_words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes, bounds) of words: letters and digits, lower-cased in A-Z, without ASCII punctuation."""
    starts, ends = tv.spans_of(tv.PLAIN[buf], offs)
    return starts, ends, tv.span_hashes(buf, starts, ends, lower=True), np.searchsorted(starts, offs)


def grams_of(h: np.ndarray, text: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, hashes of the n-grams that start at each word, whether they lie in one text) for n from 1; text: each word's text."""
    g = h
    for n in range(1, longest + 1):
        if n > 1:
            if len(h) < n:
                return
            g = tv.mix(g[:-1] * U(0x9FB21C651E98DF25) + h[n - 1 :])
        yield n, tv.mix(g + U(n)), text[: len(g)] == text[n - 1 :]


def prepare(rows: list[tuple[int, str]]) -> Items:
    """The seeds of a block of items.  Where no longer n-gram fits into the item a seed may be common, or a single word."""
    ids, words = [], []
    for key, text in rows:
        buf = np.frombuffer((text or "").encode(), np.uint8)
        _, _, h, _ = split_words(buf, np.array([0, len(buf)]))
        if len(h):
            ids.append(key)
            words.append(h)
    if not ids:
        return Items([], [], np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), [])
    h, sizes = np.concatenate(words), np.array([len(w) for w in words])
    item = np.repeat(np.arange(len(ids)), sizes)
    place = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    open_ = np.ones(len(h), bool)  # places that have no seed yet
    seeds, at, used = [], [], []
    for n, g, whole in grams_of(h, item, LONGEST):
        here = open_[: len(g)] & whole
        if n < SEED:
            here &= sizes[item[: len(g)]] == n
        elif n < LONGEST:
            # in how many items each n-gram lies
            own = np.flatnonzero(whole)
            both = np.unique(np.stack([g[own], item[own].astype(np.uint64)]), axis=1)[0] if len(own) else g[:0]
            known, held = np.unique(both, return_counts=True)
            few = held[np.minimum(np.searchsorted(known, g), max(len(known) - 1, 0))] <= (RARE_PAIR if n == SEED else RARE) if len(known) else np.zeros(len(g), bool)
            here &= few | (sizes[item[: len(g)]] == n)
        found = np.flatnonzero(here)
        if len(found):
            seeds.append(g[found])
            at.append(found)
            used.append(n)
            open_[found] = False
    s, at = np.concatenate(seeds), np.concatenate(at)
    order = np.argsort(s, kind="stable")
    return Items(ids, words, s[order], item[at][order], place[at][order], used)


def least_seeds(n: np.ndarray) -> np.ndarray:
    """Seeds that must lie near one diagonal for an item of n words."""
    return np.where(n >= 8, np.maximum(2, n // 8), 1)


def candidates(h: np.ndarray, wb: np.ndarray, items: Items) -> list[tuple[int, int, int, int, int]]:
    """(text, item, first word, last word + 1, seeds) of the stretches where an item's seeds lie near one diagonal."""
    owner = tv.owner(wb)
    at, k = [], []
    for n, g, whole in grams_of(h, owner, max(items.sizes)):
        if n not in items.sizes:
            continue
        hits = items.find(g)
        hits = hits[whole[hits]]
        lo, hi = np.searchsorted(items.seeds, g[hits], side="left"), np.searchsorted(items.seeds, g[hits], side="right")
        at.append(np.repeat(hits, hi - lo))
        k.append(np.arange(len(at[-1])) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo))
    if not at:
        return []
    at, k = np.concatenate(at), np.concatenate(k)
    text, item = owner[at], items.item[k]
    begin = at - wb[text] - items.place[k]
    order = np.lexsort((begin, item, text))
    text, item, begin, k = text[order], item[order], begin[order], k[order]
    length = items.lengths
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (begin[1:] - begin[:-1] > np.maximum(4, length[item[1:]] // 4))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(text))
    least = least_seeds(length[item[first]]) if len(first) else first
    out = []
    for a, b, enough in zip(*(x[last - first >= least].tolist() for x in (first, last, least)), strict=True):
        seeds = len(np.unique(k[a:b]))
        if seeds >= enough:
            i, t = int(item[a]), int(text[a])
            n = int(length[i])
            pad = 4 + n // 4
            words = int(wb[t + 1] - wb[t])
            out.append((t, i, max(0, int(begin[a]) - pad), min(words, int(begin[b - 1]) + n + pad), seeds))
    return out


def align(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smith-Waterman scores of (item words, text words), over the score of a perfect copy of the item."""
    scores = np.zeros(len(pairs))
    order = sorted(range(len(pairs)), key=lambda i: (len(pairs[i][0]), len(pairs[i][1])))
    i = 0
    while i < len(order):
        widest, j = 0, i
        while j < len(order) and max(widest, len(pairs[order[j]][1])) * (j - i + 1) <= max(CELLS, len(pairs[order[j]][1])):
            widest = max(widest, len(pairs[order[j]][1]))
            j += 1
        j = max(j, i + 1)
        part = order[i:j]
        i = j
        tall = max(len(pairs[p][0]) for p in part)
        widest = max(len(pairs[p][1]) for p in part)
        a = np.zeros((len(part), tall), np.uint64)
        b = np.zeros((len(part), widest), np.uint64)
        for r, p in enumerate(part):
            a[r, : len(pairs[p][0])] = pairs[p][0]
            b[r, : len(pairs[p][1])] = pairs[p][1]
        # a filled-up place matches nothing
        void = b == 0
        slope = (np.arange(widest + 1) * -GAP).astype(np.int32)
        row = np.zeros((len(part), widest + 1), np.int32)
        best = np.zeros(len(part), np.int32)
        for c in range(tall):
            step = np.where((b == a[:, c : c + 1]) & ~void, MATCH, MISMATCH).astype(np.int32)
            new = np.zeros_like(row)
            np.maximum(row[:, :-1] + step, row[:, 1:] + GAP, out=new[:, 1:])
            np.maximum(new, 0, out=new)
            # gaps along the text: the best of all earlier places less the way from there
            new += slope
            np.maximum.accumulate(new, axis=1, out=new)
            new -= slope
            row = new
            np.maximum(best, row.max(1), out=best)
        for r, p in enumerate(part):
            scores[p] = best[r] / (MATCH * len(pairs[p][0]))
    return scores


def _match(items, threshold: float):
    names = ["doc_id", "item_id", "score", "n_seeds", "first_word", "last_word"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Items = items.value
        for rb in batches:
            ids = rb.column("doc_id")
            for lo, _, buf, offs in tv.passes(rb.column("text")):
                _, _, h, wb = split_words(buf, offs)
                found = candidates(h, wb, own)
                if not found:
                    continue
                scores = align([(own.words[i], h[wb[t] + a : wb[t] + b]) for t, i, a, b, _ in found])
                best: dict[tuple[int, int], tuple] = {}
                for (t, i, a, b, n), s in zip(found, scores.tolist(), strict=True):
                    if s >= threshold and s > best.get((t, i), (0.0,))[0]:
                        best[t, i] = (s, n, a, b)
                if best:
                    rows = [(ids[lo + t].as_py(), own.ids[i], *v) for (t, i), v in best.items()]
                    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most BLOCK_BYTES; only one block is on the driver at a time."""
    block, held = [], 0
    items = benchmark.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").distinct()
    for r in items.orderBy("item_id", "text").toLocalIterator():
        if block and held + len(r[1]) > BLOCK_BYTES:
            yield block
            block, held = [], 0
        block.append((int(r[0]), r[1]))
        held += len(r[1])
    if block:
        yield block


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, item_id, score, n_seeds, first_word, last_word of every training text and item that it holds a copy of.

    score: the best local alignment's, 1 for a verbatim copy; the words of the text where
    the alignment was made count from 0.  Null and empty texts and items leak nothing; an item with a null id
    can't be named and is left out.  A null doc_id and repeated rows give rows like
    others.  A text of any length is searched as a whole; of several copies of an item in it the best scored one is reported, of
    equal ones the first.  Columns besides doc_id, item_id and text are ignored, whatever their names.  Without items or texts there are no rows.
    """
    spark, out = docs.sparkSession, None
    only = docs.select("doc_id", "text")
    for block in item_blocks(benchmark):
        items = prepare(block)
        if not items.ids:
            continue
        shared = spark.sparkContext.broadcast(items)
        part = only.mapInArrow(_match(shared, threshold), "doc_id long, item_id long, score double, n_seeds long, first_word long, last_word long")
        out = part if out is None else out.union(part)
    if out is None:
        return spark.createDataFrame([], "doc_id long, item_id long, score double, n_seeds long, first_word long, last_word long")
    return out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that hold no copy of an item, with all their columns; a row without an id stays."""
    return without_ids(docs, leaks(docs, benchmark, threshold))
