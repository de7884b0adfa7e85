"""Substring deduplication by content-defined chunking.

A gear rolling hash over the last 32 bytes ends a chunk at a word's end where it is
divisible by ``mean_words``, so that a chunk's ends depend on the text around them alone and an
insertion moves no later boundary.  A stretch without white space is cut by the same hash at
any character, and no chunk is longer than LONGEST bytes.  From every chunk a window of adjacent chunks
reaches just ``least_bytes`` or further, and another ends with the text; its digest is that of the sequence.  Of each digest's occurrences
the first (by id, then text hash, then place) stays, and later ones go, so that what goes is contiguous
in an earlier text too.  A shorter repeat may be chance and stays, as do the parts of a passage that lie in
chunks it shares with the text around it.

Within a slice of a task's windows a digest's later occurrences are known to be repeats at once.  Only its
first one there is judged by the shuffle; the others go as the stretches they cover, so a passage that a
third of all texts share is one row a slice and one a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from kestrelbase.llm import textvec as tv

U = np.uint64
MEAN_WORDS, LEAST_BYTES = 4, 144
#: Bytes without white space after which any character may end a chunk, and the bytes of the longest chunk.
SOLID, LONGEST = 64, 128
#: Windows in a slice: what a task holds at a time.
SLICE = 1 << 18

_GEAR = np.random.Generator(np.random.PCG64(97)).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte: the sum of gear[b] << age over the last 32 bytes, by doubling; it starts anew in each text."""
    h = _GEAR[buf]
    n = len(buf)
    since = np.arange(n) - np.repeat(offs[:-1], np.diff(offs))
    for step in (1, 2, 4, 8, 16):
        add = np.zeros(n, np.uint32)
        add[step:] = h[:-step] << np.uint32(step) if step < n else 0
        # nothing reaches over the start of a text
        add[since < step] = 0
        h = h + add
    return h


def chunk_ends(buf: np.ndarray, offs: np.ndarray, mean_words: int = MEAN_WORDS) -> np.ndarray:
    """Ends of the chunks of a pass; every text's end is one."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64)
    h = gear(buf, offs)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    space = tv.SPACE[buf]
    at = np.arange(n)
    last = np.maximum.accumulate(np.where(space, at, -1))
    last = np.maximum(last, np.repeat(offs[:-1], np.diff(offs)) - 1)
    # the last white space byte before a word
    gap = space.copy()
    gap[:-1] &= ~space[1:]
    whole = np.ones(n, bool)
    whole[:-1] = (buf[1:] & 0xC0) != 0x80
    end = (gap & (h % np.uint32(mean_words) == 0)) | (whole & (at - last >= SOLID) & (h % np.uint32(16) == 0))
    end[offs[1:][np.diff(offs) > 0] - 1] = True
    ends = np.flatnonzero(end) + 1
    long = np.flatnonzero(np.diff(ends, prepend=0) > LONGEST)
    if len(long):
        more, words = [], np.flatnonzero(gap) + 1
        for i in long.tolist():
            b = int(ends[i - 1]) if i else 0
            while ends[i] - b > LONGEST:
                # what repeats itself has no boundary of its own: cut at the last word within reach, so that its
                # pieces are alike, or where there is none at the last whole character
                k = int(np.searchsorted(words, b + LONGEST, side="right")) - 1
                if k >= 0 and words[k] > b:
                    b = int(words[k])
                else:
                    b += LONGEST
                    while buf[b] & 0xC0 == 0x80:
                        b -= 1
                more.append(b)
        ends = np.unique(np.concatenate([ends, np.array(more, np.int64)]))
    return ends


def chunks(buf: np.ndarray, offs: np.ndarray, mean_words: int = MEAN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, digests, bounds by text)."""
    ends = chunk_ends(buf, offs, mean_words)
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    return starts, ends, tv.span_hashes(buf, starts, ends, lower=False).view(np.int64), np.searchsorted(starts, offs)


def windows(starts: np.ndarray, ends: np.ndarray, digests: np.ndarray, bounds: np.ndarray, least_bytes: int = LEAST_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, digests, bounds by text) of the windows of chunks: one from every chunk that as much text follows, and one that ends with the text."""
    if not len(starts):
        return starts, ends, digests, bounds
    last = np.searchsorted(ends, starts + least_bytes, side="left")
    a = np.flatnonzero(last < np.repeat(bounds[1:], np.diff(bounds)))
    b = last[a]
    final = bounds[1:][np.diff(bounds) > 0] - 1
    back = np.searchsorted(starts, ends[final] - least_bytes, side="right") - 1
    own = (back >= bounds[:-1][np.diff(bounds) > 0]) & (last[back] != final)
    at = np.searchsorted(a, back[own], side="right")
    a, b = np.insert(a, at, back[own]), np.insert(b, at, final[own])
    d = digests.view(np.uint64)
    h = tv.mix(d[a])
    rows, step = np.flatnonzero(b > a), 0
    while len(rows):
        step += 1
        h[rows] = tv.mix(h[rows] * U(0x9FB21C651E98DF25) + d[a[rows] + step])
        rows = rows[b[rows] > a[rows] + step]
    return starts[a], ends[b], h.view(np.int64), np.searchsorted(a, bounds)


SPOTS = "doc_id long, text_hash long, at int, size int, digest long, source long, late boolean"


def text_hash() -> Column:
    """A text's identity among those that share its id, or have none."""
    return F.xxhash64("text")


def _merged(key: np.ndarray, at: np.ndarray, end: np.ndarray, source: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First members and ends of the stretches that windows of one text and source cover without a gap; sorted by (key, source, at)."""
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (source[1:] != source[:-1])
    # the furthest end so far, within a text and source
    group = np.cumsum(new) - 1
    reach = np.maximum.accumulate(end + group * (1 << 33)) - group * (1 << 33)
    new[1:] |= at[1:] > reach[:-1]
    lead = np.flatnonzero(new)
    return lead, reach[np.append(lead[1:], len(key)) - 1]


def _occurrences(mean_words: int, least_bytes: int):
    """Rows SPOTS of all windows that are their digest's first in a slice, and of the stretches of the others, which are late.

    A late row repeats an earlier one of its slice, whose id is its source; it needs no judgement, so its
    digest only spreads it.
    """
    names = [c.split()[0] for c in SPOTS.split(", ")]

    def rows(ids, null, th, at, size, digest, source=None, source_null=None) -> Iterator[pa.RecordBatch]:
        late = source is not None
        for i in range(0, len(ids), 1 << 16):
            s = slice(i, i + (1 << 16))
            own = pa.array(source[s], mask=source_null[s]) if late else pa.nulls(len(ids[s]), pa.int64())
            columns = [pa.array(ids[s], mask=null[s]), pa.array(th[s]), pa.array(at[s].astype(np.int32)), pa.array(size[s].astype(np.int32)), pa.array(digest[s]), own, pa.array(np.full(len(ids[s]), late))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh: list[tuple[np.ndarray, ...]] = []
        held = 0

        def close() -> Iterator[pa.RecordBatch]:
            digest, ids, null, th, at, size = (np.concatenate(x) for x in zip(*fresh, strict=True))
            order = np.lexsort((at, th, ids, null, digest))
            digest, ids, null, th, at, size = (x[order] for x in (digest, ids, null, th, at, size))
            new = np.ones(len(digest), bool)
            new[1:] = digest[1:] != digest[:-1]
            # the same row twice is one text: its windows don't repeat each other
            lead = np.flatnonzero(new)[np.cumsum(new) - 1]
            late = np.flatnonzero(~new & ~((ids == ids[lead]) & (null == null[lead]) & (th == th[lead]) & (at == at[lead])))
            lead = lead[late]
            order = np.lexsort((at[late], null[lead], ids[lead], th[late], ids[late], null[late]))
            late, lead = late[order], lead[order]
            if len(late):
                other = lambda x: np.concatenate([[False], x[1:] != x[:-1]])
                text = np.cumsum(other(null[late]) | other(ids[late]) | other(th[late]))
                source = np.cumsum(other(null[lead]) | other(ids[lead]))
                first, end = _merged(text, at[late], at[late] + size[late], source)
                late, lead = late[first], lead[first]
                spread = tv.mix(th[late].view(np.uint64) + at[late].astype(np.uint64)).view(np.int64)
                yield from rows(ids[late], null[late], th[late], at[late], end - at[late], spread, ids[lead], null[lead])
            yield from rows(ids[new], null[new], th[new], at[new], size[new], digest[new])

        for rb in batches:
            doc = rb.column("doc_id")
            null_id = doc.is_null().to_numpy(zero_copy_only=False)
            doc = doc.fill_null(0).to_numpy()
            hashes = rb.column("text_hash").to_numpy()
            for lo, hi, buf, offs in tv.passes(rb.column("text")):
                starts, ends, digest, bounds = windows(*chunks(buf, offs, mean_words), least_bytes)
                n = np.diff(bounds)
                fresh.append((digest, np.repeat(doc[lo:hi], n), np.repeat(null_id[lo:hi], n), np.repeat(hashes[lo:hi], n), starts - np.repeat(offs[:-1], n), ends - starts))
                held += len(digest)
                if held > SLICE:
                    yield from close()
                    fresh, held = [], 0
        if fresh:
            yield from close()

    return run


def repeats(docs: DataFrame, mean_words: int = MEAN_WORDS, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(doc_id, text_hash, at, size, source) of every stretch that isn't its digests' first occurrence; source: the id of a row with an earlier one.

    One shuffle by digest; the window looks at a row and at the first one of its digest only.
    """
    found = docs.select("doc_id", "text", text_hash().alias("text_hash")).mapInArrow(_occurrences(mean_words, least_bytes), SPOTS)
    order = Window.partitionBy("digest").orderBy("late", F.col("doc_id").isNull(), "doc_id", "text_hash", "at")
    first = F.first(F.struct("doc_id", "text_hash", "at")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    judged = found.withColumn("first", first).withColumn("nth", F.row_number().over(order))
    # two identical rows in two slices are one text
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash")) & (F.col("at") == F.col("first.at"))
    return judged.filter(F.col("late") | ((F.col("nth") > 1) & ~same)).select(
        "doc_id", "text_hash", "at", "size", F.when(F.col("late"), F.col("source")).otherwise(F.col("first.doc_id")).alias("source")
    )


def runs(docs: DataFrame, mean_words: int = MEAN_WORDS, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(doc_id, text_hash, removed_bytes, spans, sources) of every text that loses something.

    spans: byte ranges [start, end) of the text that go, in order.  sources: ids of rows that hold an earlier
    occurrence of what goes, one for each window, each once.
    """
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            out, removed, sources = [], [], []
            for found in rb.column("windows").to_pylist():
                own: list[list] = []
                for c in found:
                    if own and own[-1][1] >= c["at"]:
                        own[-1][1] = max(own[-1][1], c["at"] + c["size"])
                        own[-1][2].add(c["source"])
                    else:
                        own.append([c["at"], c["at"] + c["size"], {c["source"]}])
                out.append([{"start": a, "end": b} for a, b, _ in own])
                removed.append(sum(b - a for a, b, _ in own))
                sources.append(sorted({s for x in own for s in x[2] if s is not None}))
            yield pa.RecordBatch.from_arrays(
                [rb.column("doc_id"), rb.column("text_hash"), pa.array(removed, pa.int64()), pa.array(out, pa.list_(span)), pa.array(sources, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "removed_bytes", "spans", "sources"],
            )

    grouped = repeats(docs, mean_words, least_bytes).groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set(F.struct("at", "size", "source"))).alias("windows"))
    return grouped.mapInArrow(join, "doc_id long, text_hash long, removed_bytes long, spans array<struct<start:int,end:int>>, sources array<long>").filter(F.size("spans") > 0)


def report(docs: DataFrame, mean_words: int = MEAN_WORDS, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """doc_id, removed_bytes, spans, sources of every text that repeats earlier text.

    spans: UTF-8 byte ranges of the text that repeat earlier text, within it or in rows with a
    lesser id (a null id comes last); sources: ids of rows that hold that earlier text.
    Null and empty texts repeat nothing.  Rows with the same id and text are one text; an
    empty table gives no rows.
    """
    return runs(docs, mean_words, least_bytes).select("doc_id", "removed_bytes", "spans", "sources")


def cut_texts(docs: DataFrame, mean_words: int = MEAN_WORDS, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``docs`` with the repeated runs cut out of ``text``; all rows and other columns stay.

    A text that loses nothing is not shuffled apart from the join by id that finds so.  A null text stays null.
    """
    order = docs.columns
    gone = runs(docs, mean_words, least_bytes).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("spans").alias("__spans"))
    # several texts may share an id, or have none: each finds its own spans by its hash
    joined = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (text_hash() == F.col("__hash")), "left")

    def trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            at = rb.schema.get_field_index("text")
            spans = rb.column("__spans")
            new = rb.column(at)
            if spans.null_count < len(spans):
                hit = spans.is_valid()
                values = new.filter(hit).to_pylist()
                for i, own in enumerate(spans.filter(hit).to_pylist()):
                    raw = values[i].encode()
                    out, last = [], 0
                    for s in own:
                        out.append(raw[last : s["start"]])
                        last = s["end"]
                    values[i] = b"".join([*out, raw[last:]]).decode("utf-8", "replace")
                new = pc.replace_with_mask(new, hit, pa.array(values, new.type))
            columns = [new if i == at else rb.column(i) for i in range(rb.num_columns) if rb.schema.names[i] != "__spans"]
            yield pa.RecordBatch.from_arrays(columns, names=order)

    return joined.select(*order, "__spans").mapInArrow(trim, docs.schema)
