"""N-gram Jaccard self-join by vertical partitioning of one global n-gram order.

An n-gram is a 58-bit hash led by 6 bits of how frequent it is, so that sorting these
keys sorts n-grams from rare to frequent.  Frequencies come from a counting sketch over the
whole corpus; a wrong estimate only moves an n-gram in the order, never changes a result.

1. Every text gives its set's size and signature, and its part of the sketch.  Texts with
   one set are one class; from here on only classes count.
2. The order is cut into fragments of equal mass.  Each class sends the rare end of its set
   to those fragments, packed by task and fragment.  What it sends are signatures of two
   n-grams that are neighbours in its sorted set: sufficiently similar sets must share some
   in their rare ends, while unrelated texts that have a few n-grams in common hardly
   ever do.  Classes that meet at a signature are linked in a chain, in the task that made their
   entries as far as they meet there, so a signature is never listed pair by pair, however many classes share it.
3. Linked classes form components.  The whole sets of their classes are cut by the same
   order into vertical segments; a component's partial overlaps are counted a segment after the
   other and summed per pair.  A large component is split by the sizes of sets into blocks of
   classes, and pairs of blocks of near sizes, so that no task holds more than two blocks of one segment.
4. 100 * overlap >= threshold * union decides, on the exact sum, in the task that counted it.  Of
   its links each class passes on how many they are and one class that they reach, so neither candidates nor
   links are ever stored pair by pair, however many they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from kestrelbase.llm import textvec as tv
from kestrelbase.llm.common import EDGES, STARS, connected, connected_stars, forest, keep, stars, texts, without_ids

U = np.uint64
SKETCH_BITS = 22
CHUNK = 1 << 16
#: Entries that one fragment of the order should hold.
FRAGMENT = 1 << 18
#: Entries that a task packs at a time.
HELD = 1 << 19
#: Vertical segments of the counting step, and classes and n-grams in a block of it, on average at most.  Every class is sent to
#: each block that it may have links to, so the larger blocks are, the less is sent; a task holds BLOCK^2 counts.
SEGMENTS, BLOCK, BLOCK_NGRAMS = 4, 2048, 1 << 22
BLOOM_BITS = 1 << 25
#: Candidate classes that may be broadcast, of about 40 bytes each.
BROADCAST_MEMBERS = 500_000


def ngram_hashes(buf: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows, repeats included; a shorter text with words is one window of all its words."""
    _, _, h, wb = tv.words(buf, offs, lower=True)
    grams, gb = tv.chain(h, wb, n)
    short = np.flatnonzero((np.diff(wb) > 0) & (np.diff(wb) < n))
    if not len(short):
        return grams, gb
    own = np.empty(len(short), np.uint64)
    for i, t in enumerate(short.tolist()):
        x = U(0x51ED270B9F652295) + U(int(wb[t + 1] - wb[t]))
        for w in h[wb[t] : wb[t + 1]]:
            x = tv.mix(np.array([x ^ w], np.uint64))[0]
        own[i] = x
    counts = np.diff(gb)
    counts[short] = 1
    out = np.zeros(len(gb), np.int64)
    np.cumsum(counts, out=out[1:])
    grams = np.insert(grams, gb[short], own)
    return grams, out


def ordered_sets(buf: np.ndarray, offs: np.ndarray, n: int, level: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Each text's set as sorted keys of the global order, and the bounds of the sets."""
    keys, gb = ngram_hashes(buf, offs, n)
    if level is not None:
        keys = (level[(keys >> U(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << U(58)) | (keys >> U(6))
    else:
        keys = keys >> U(6)
    tv.sort_within(keys, gb)
    first = tv.first_of_runs(keys, gb)
    sizes = tv.per_text(first, gb)
    bounds = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=bounds[1:])
    return keys[first], bounds


def signatures(keys: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit identity of each set (used together with its size): the sum of its members' hashes."""
    sums = np.zeros(len(keys) + 1, np.uint64)
    np.cumsum(tv.mix(keys ^ U(0x2545F4914F6CDD1D)), out=sums[1:])
    return (sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64)


def _summaries(n: int):
    """Per text: id, set size, signature; per task: its part of the sketch in compressed chunks."""
    schema = "doc_id long, n long, cid long, chunk int, counts binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
        for rb in batches:
            sizes, sigs = [], []
            for _, _, buf, offs in tv.passes(rb.column("text")):
                keys, bounds = ordered_sets(buf, offs, n, None)
                np.add.at(sketch, (keys >> U(58 - SKETCH_BITS)).astype(np.int64), np.uint32(1))
                sizes.append(np.diff(bounds))
                sigs.append(signatures(keys, bounds))
            m = rb.num_rows
            yield pa.RecordBatch.from_arrays(
                [rb.column("doc_id"), pa.array(np.concatenate(sizes) if sizes else np.zeros(0, np.int64)), pa.array(np.concatenate(sigs) if sigs else np.zeros(0, np.int64)), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())],
                names=["doc_id", "n", "cid", "chunk", "counts"],
            )
        if sketch.any():
            width = np.uint8 if sketch.max() < 256 else np.uint32
            parts = [pa.compress(c.astype(width).tobytes(), "zstd", asbytes=True) for c in sketch.reshape(-1, CHUNK)]
            parts = [bytes([np.dtype(width).itemsize]) + p for p in parts]
            k = len(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array(range(k), pa.int32()), pa.array(parts, pa.binary())],
                names=["doc_id", "n", "cid", "chunk", "counts"],
            )

    return run, schema


def _sum_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for rb in batches:
        for chunk, packed in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
            kind = np.uint8 if packed[0] == 1 else np.uint32
            raw = pa.decompress(packed[1:], CHUNK * packed[0], "zstd", asbytes=True)
            sums.setdefault(chunk, np.zeros(CHUNK, np.int64)).__iadd__(np.frombuffer(raw, kind))
    if sums:
        total = [int(s.sum()) for s in sums.values()]
        # levels double: what matters is telling shared passages from the rest
        level = [np.minimum(np.frexp(s.astype(np.float64))[1], 63).astype(np.uint8) for s in sums.values()]
        mass = [np.bincount(x, weights=s, minlength=64).astype(np.int64).tolist() for x, s in zip(level, sums.values(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in level], pa.binary()), pa.array(total, pa.int64()), pa.array(mass, pa.list_(pa.int64()))],
            names=["chunk", "level", "total", "mass"],
        )


def fragment_cuts(mass: np.ndarray, fragments: int) -> np.ndarray:
    """fragments - 1 keys that cut the order into parts of equal mass; within a level hashes are uniform."""
    whole = mass.sum()
    if not whole:
        return np.zeros(0, np.uint64)
    ends = np.cumsum(mass)
    out = []
    for k in range(1, fragments):
        target = whole * k / fragments
        lv = int(np.searchsorted(ends, target, side="right"))
        lv = min(lv, 63)
        inside = (target - (ends[lv] - mass[lv])) / max(1, mass[lv])
        out.append((lv << 58) + int(min(max(inside, 0.0), 0.999999) * (1 << 58)))
    return np.array(out, np.uint64)


def prefix_lengths(n: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Rare-end lengths, in signatures, that must meet in any similar pair: of the larger set, and of the smaller (or equal) one.

    Let two sets share o n-grams and differ in s.  Similar ones have
    s <= (100 - threshold) * o / threshold, and the n-grams that differ cut the shared ones into at most s + 1 runs
    of the merged order, so at least o - s - 1 neighbouring n-grams are neighbours in both.
    """
    n = n.astype(np.int64)
    out = []
    for o in (-(-threshold * n // 100), -(-2 * threshold * n // (100 + threshold))):
        sure = o - (100 - threshold) * o // threshold - 1 if by_neighbours(threshold) else o
        out.append(np.maximum(np.minimum(n - sure + (0 if by_neighbours(threshold) else 1), n - by_neighbours(threshold)), 0))
    return out[0], out[1]


def by_neighbours(threshold: int) -> bool:
    """Whether two neighbouring n-grams make a signature: from here on o - s - 1 is at least 1 for any two sets that differ."""
    return threshold >= 67


def _prefixes(n: int, threshold: int, level, cut_at: np.ndarray):
    """Rows (fragment, packed, edges): the entries that a task's texts have in a fragment, less those that are linked here already, and those links."""
    fragments = len(cut_at) + 1

    def pack(found: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        if not found:
            return
        fragment, sign, node, size, small = (np.concatenate(x) for x in zip(*found, strict=True))
        order, edges, sent = meet(sign, node, size, small, threshold)
        fragment, sign, node, size, small = (x[order[sent]] for x in (fragment, sign, node, size, small))
        # what meets in one batch goes on as links, so a signature that a third of all texts share is a few entries a batch
        rows, blobs, links = [0] * bool(edges.size), [None] * bool(edges.size), [_edge_bytes(edges)] * bool(edges.size)
        order = np.lexsort((sign, fragment))
        fragment, sign, node, size, small = (x[order] for x in (fragment, sign, node, size, small))
        at = np.searchsorted(fragment, np.arange(fragments + 1))
        for f in np.flatnonzero(np.diff(at)).tolist():
            a, b = int(at[f]), int(at[f + 1])
            # byte planes, and differences of what is sorted, so that the shuffle's compression finds the zeros
            blobs.append(_planes(np.diff(sign[a:b], prepend=U(0)), 6) + _planes(node[a:b], 5) + (size[a:b] * 2 + small[a:b]).tobytes())
            rows.append(f)
            links.append(None)
        if edges.size:
            # any task may pass links on
            rows[0] = int(edges[0, 0] % fragments)
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(blobs, pa.binary()), pa.array(links, pa.binary())], names=["fragment", "packed", "edges"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = level.value
        found: list[tuple[np.ndarray, ...]] = []
        held = 0
        for rb in batches:
            for _, _, buf, offs in tv.passes(rb.column("text")):
                keys, bounds = ordered_sets(buf, offs, n, levels)
                sizes = np.diff(bounds)
                sig = signatures((keys & U((1 << 58) - 1)), bounds)
                larger, smaller = prefix_lengths(sizes, threshold)
                place = np.arange(len(keys)) - np.repeat(bounds[:-1], sizes)
                take = np.flatnonzero(place < np.repeat(larger, sizes))
                small = (place < np.repeat(smaller, sizes))[take]
                sign = tv.mix(keys[take] + tv.mix(keys[take + 1])) if by_neighbours(threshold) else tv.mix(keys[take])
                node = np.repeat(sig.view(np.uint64) >> U(24), sizes)[take]
                found.append((np.searchsorted(cut_at, keys[take], side="right").astype(np.int32), sign >> U(16), node, np.repeat(size_levels(sizes), sizes)[take], small))
                held += len(small)
                if held > HELD:
                    yield from pack(found)
                    found, held = [], 0
        yield from pack(found)

    return run


def size_levels(n: np.ndarray) -> np.ndarray:
    """Set sizes on a scale of steps of a tenth, in 7 bits; the largest share the last step."""
    return np.minimum(np.log(np.maximum(n, 1)) / np.log(1.1), 127).astype(np.uint8)


def _planes(x: np.ndarray, n: int) -> bytes:
    """The n low bytes of 64-bit integers, byte by byte."""
    return x.astype(np.uint64).view(np.uint8).reshape(-1, 8).T[:n].tobytes()


def _from_planes(raw: bytes, at: int, m: int, n: int) -> np.ndarray:
    out = np.zeros((m, 8), np.uint8)
    out[:, :n] = np.frombuffer(raw, np.uint8, n * m, at).reshape(n, m).T
    return out.view(np.uint64).ravel()


def unpack(packed: bytes) -> tuple[np.ndarray, ...]:
    """(signature, node, size level, within the smaller prefix) of a blob's entries."""
    m = len(packed) // 12
    size = np.frombuffer(packed, np.uint8, m, 11 * m)
    return np.cumsum(_from_planes(packed, 0, m, 6), dtype=np.uint64), _from_planes(packed, 6 * m, m, 5), size >> 1, (size & 1) > 0


def _edge_bytes(edges: np.ndarray) -> bytes:
    """Links (2, m) as byte planes; nodes have 40 bits."""
    return _planes(edges[0], 5) + _planes(edges[1], 5)


def _edges_of(raw: bytes) -> np.ndarray:
    m = len(raw) // 10
    return np.stack([_from_planes(raw, 0, m, 5), _from_planes(raw, 5 * m, m, 5)])


def meet(sign: np.ndarray, node: np.ndarray, level: np.ndarray, small: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, links (2, m), places in the order of the entries that may meet others elsewhere).

    Two classes with one signature may be similar if their size levels are near and the smaller set has
    the signature within its smaller prefix.  Within a signature's run, ordered by size level, every entry is linked to the nearest
    such smaller one only: as any two of those that an entry could be linked to are near each other, this connects
    what all pairs would connect, with at most one link an entry.

    An entry linked to a smaller one here need not meet others elsewhere, unless it is the first of its level
    that may itself be a smaller one.
    """
    order = np.lexsort((node, ~small, level, sign))
    sign, node, small = sign[order], node[order], small[order]
    lv = level[order].astype(np.int64)
    apart = int(np.ceil(np.log(100 / threshold) / np.log(1.1))) + 1
    m = len(sign)
    if not m:
        return order, np.zeros((2, 0), np.uint64), np.zeros(0, np.int64)
    at = np.arange(m)
    new = np.ones(m, bool)
    new[1:] = sign[1:] != sign[:-1]
    begin = np.maximum.accumulate(np.where(new, at, 0))
    # the last entry before this one that is within its smaller prefix
    last = np.maximum.accumulate(np.where(small, at, -1))
    near = np.full(m, -1)
    near[1:] = last[:-1]
    linked = (near >= begin) & (lv - lv[np.maximum(near, 0)] <= apart)
    rows = np.flatnonzero(linked)
    a, b = node[near[rows]], node[rows]
    apart_nodes = a != b
    edges = np.stack([np.minimum(a, b), np.maximum(a, b)])[:, apart_nodes]
    if edges.size:
        edges = np.unique(edges, axis=1)
    leads = np.ones(m, bool)
    leads[1:] = new[1:] | (lv[1:] != lv[:-1])
    return order, edges, np.flatnonzero(~linked | (small & leads))


def _find_stars(threshold: int):
    """Rows (node, label): stars that connect what meets in a fragment, and what met earlier."""

    def links(edges: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, edges.shape[1], 1 << 16):
            part = edges[:, i : i + (1 << 16)].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in part], names=["a", "b"])

    def finish(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        entries = [np.concatenate(x) for x in zip(*map(unpack, blobs), strict=True)]
        # most signatures occur once: only those that two entries share can give a pair
        order = np.argsort(entries[0])
        k = entries[0][order]
        shared = np.zeros(len(k), bool)
        shared[1:] = k[1:] == k[:-1]
        shared[:-1] |= shared[1:]
        order = order[shared]
        yield from links(meet(*(x[order] for x in entries), threshold)[1])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = None, []
        for rb in batches:
            for f, packed, edges in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), rb.column(2).to_pylist(), strict=True):
                if edges is not None:
                    yield from links(_edges_of(edges))
                    continue
                if f != now and blobs:
                    yield from finish(blobs)
                    blobs = []
                now = f
                blobs.append(packed)
        if blobs:
            yield from finish(blobs)

    return lambda batches: stars(pairs(batches))


def _bloom(ids: np.ndarray, bits: np.ndarray | None = None) -> np.ndarray:
    h = tv.mix(ids.view(np.uint64))
    spots = np.concatenate([h & U(BLOOM_BITS - 1), (h >> U(32)) & U(BLOOM_BITS - 1)]).astype(np.int64)
    if bits is None:
        bits = np.zeros(BLOOM_BITS // 8, np.uint8)
    np.bitwise_or.at(bits, spots >> 3, (1 << (spots & 7)).astype(np.uint8))
    return bits


def _may_hold(ids: np.ndarray, bits: np.ndarray) -> np.ndarray:
    h = tv.mix(ids.view(np.uint64))
    out = np.ones(len(ids), bool)
    for s in (h & U(BLOOM_BITS - 1), (h >> U(32)) & U(BLOOM_BITS - 1)):
        s = s.astype(np.int64)
        out &= (bits[s >> 3] >> (s & 7).astype(np.uint8)) & 1 > 0
    return out


def _bloom_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = None
    for rb in batches:
        if rb.num_rows:
            bits = _bloom(rb.column(0).to_numpy(), bits)
    if bits is not None:
        parts = bits.reshape(64, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(64), pa.int32()), pa.array([pa.compress(p.tobytes(), "zstd", asbytes=True) for p in parts], pa.binary())], names=["part", "bits"])


def _join_blooms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for rb in batches:
        for part, packed in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
            x = np.frombuffer(pa.decompress(packed, BLOOM_BITS // 512, "zstd", asbytes=True), np.uint8)
            sums[part] = sums[part] | x if part in sums else x
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([pa.compress(x.tobytes(), "zstd", asbytes=True) for x in sums.values()], pa.binary())], names=["part", "bits"])


def bloom_of(ids: DataFrame) -> np.ndarray:
    """A fixed-size Bloom filter of a column of longs, built on the executors."""
    rows = ids.mapInArrow(_bloom_parts, "part int, bits binary").repartition("part").mapInArrow(_join_blooms, "part int, bits binary").collect()
    bits = np.zeros((64, BLOOM_BITS // 512), np.uint8)
    for part, packed in rows:
        bits[part] = np.frombuffer(pa.decompress(bytes(packed), BLOOM_BITS // 512, "zstd", asbytes=True), np.uint8)
    return bits.ravel()


def _segments(n: int, level, cut_at: np.ndarray, wanted):
    """Rows (cid, n, segment, keys): the whole sets of the texts that a candidate class may own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, bits = level.value, wanted.value
        for rb in batches:
            ids = rb.column("doc_id").fill_null(-1).to_numpy()
            rb = rb.filter(pa.array(_may_hold(ids, bits)))
            cids, sizes, segs, blobs = [], [], [], []
            for _, _, buf, offs in tv.passes(rb.column("text")):
                keys, bounds = ordered_sets(buf, offs, n, levels)
                size = np.diff(bounds)
                sig = signatures((keys & U((1 << 58) - 1)), bounds)
                for t in np.flatnonzero(size).tolist():
                    own = keys[bounds[t] : bounds[t + 1]]
                    at = [0, *np.searchsorted(own, cut_at).tolist(), len(own)]
                    for s in range(len(at) - 1):
                        if at[s] < at[s + 1]:
                            cids.append(int(sig[t]))
                            sizes.append(int(size[t]))
                            segs.append(s)
                            blobs.append(own[at[s] : at[s + 1]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(segs, pa.int32()), pa.array(blobs, pa.binary())], names=["cid", "n", "segment", "keys"])

    return run


def add_overlaps(total: np.ndarray, one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray] | None, most: int = 1 << 20) -> None:
    """Add to total[x, y] how many n-grams x of the first side and y of the second share.

    A side: its n-grams, and the row or column that each belongs to; None: the first side once more.  N-grams that many hold are
    counted by products of matrices, the others by listing who meets at them, ``most`` at a time.
    """
    sides = [one] if two is None else [one, two]
    if not all(len(k) for k, _ in sides):
        return
    _, col = np.unique(np.concatenate([k for k, _ in sides]), return_inverse=True)
    cols = [col[: len(one[0])], col[len(one[0]) :] if two is not None else col]
    whos = [one[1], two[1] if two is not None else one[1]]
    columns = int(col.max()) + 1
    times = [np.bincount(c, minlength=columns) for c in cols]
    met = (times[0] > 1) if two is None else (times[0] > 0) & (times[1] > 0)
    crowded = met & (times[0] * times[1] > total.size // 128)
    for picked in (crowded, met & ~crowded):
        number = np.cumsum(picked) - 1
        columns = int(picked.sum())
        if not columns:
            continue
        ordered = []
        for c, who in zip(cols, whos, strict=True):
            own = np.flatnonzero(picked[c])
            own = own[np.argsort(c[own], kind="stable")]
            ordered.append((number[c[own]], who[own]))
        (c1, w1), (c2, w2) = ordered
        if picked is crowded:
            step = min(columns, max(64, (most << 1) // sum(total.shape)))
            for c in range(0, columns, step):
                parts = []
                for m, cs, ws in zip(total.shape, (c1, c2), (w1, w2), strict=True):
                    a, b = np.searchsorted(cs, [c, c + step])
                    parts.append(np.zeros((m, step), np.float32))
                    parts[-1][ws[a:b], cs[a:b] - c] = 1
                total += (parts[0] @ parts[1].T).astype(total.dtype)
            continue
        begin = np.searchsorted(c2, np.arange(columns + 1))
        partners = np.diff(begin)[c1]
        ends = np.cumsum(partners)
        a = 0
        while a < len(c1):
            b = max(a + 1, int(np.searchsorted(ends, ends[a] - partners[a] + most, side="right")))
            k = partners[a:b]
            place = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
            y = w2[np.repeat(begin[c1[a:b]], k) + place]
            np.add.at(total.reshape(-1), np.repeat(w1[a:b], k) * total.shape[1] + y, total.dtype.type(1))
            a = b


class _Blocks:
    """Overlaps of the classes of one block, or across two, summed over segments in turn."""

    def __init__(self, alone: bool) -> None:
        self.sides: list[dict[tuple[int, int], int]] = [{}] if alone else [{}, {}]
        self.times: list[list[int]] = [[] for _ in self.sides]
        self.total = np.zeros((0, 0), np.int32)

    def add(self, rows: list[tuple]) -> None:
        """rows: (side, cid, size, times, keys), all of a segment that has not been added yet."""
        found: list[tuple[list[np.ndarray], list[int]]] = [([], []) for _ in self.sides]
        for side, cid, size, times, keys in rows:
            at = self.sides[side].setdefault((cid, size), len(self.sides[side]))
            if at == len(self.times[side]):
                self.times[side].append(times)
            found[side][0].append(np.frombuffer(keys, np.uint64))
            found[side][1].append(at)
        m, k = len(self.sides[0]), len(self.sides[-1])
        self.total = np.pad(self.total, ((0, m - self.total.shape[0]), (0, k - self.total.shape[1])))
        entries = [(np.concatenate(k), np.repeat(np.array(w), [len(x) for x in k])) if k else (np.zeros(0, np.uint64), np.zeros(0, np.int64)) for k, w in found]
        add_overlaps(self.total, entries[0], entries[1] if len(entries) > 1 else None)

    def links(self, threshold: int) -> np.ndarray:
        """(cid, size, others, near) of each class with links here: how many rows it is linked to, and the least class id that its links reach."""
        cids, sizes = ([np.array([c[p] for c in side], np.int64) for side in self.sides] for p in (0, 1))
        times = [np.array(t, np.int64) for t in self.times]
        others = [np.zeros(len(c), np.int64) for c in cids]
        reached = [(np.zeros(0, np.int64),) * 2]
        step = max(1, EDGES // max(1, len(cids[-1])))
        for a in range(0, len(cids[0]), step):
            both = self.total[a : a + step].astype(np.int64)
            hit = (both > 0) & (100 * both >= threshold * (sizes[0][a : a + step, None] + sizes[-1][None, :] - both))
            if len(self.sides) == 1:
                hit[np.arange(len(hit)), np.arange(a, a + len(hit))] = False
            else:
                others[1] += times[0][a : a + step] @ hit
            others[0][a : a + step] = hit @ times[-1]
            x, y = np.nonzero(hit)
            reached.append(forest(cids[0][a + x], cids[-1][y]))
        nodes, labels = forest(*(np.concatenate(x) for x in zip(*reached, strict=True)))
        linked = [(c[o > 0], n[o > 0], o[o > 0]) for c, n, o in zip(cids, sizes, others, strict=True)]
        return np.concatenate([np.stack([c, n, o, labels[np.searchsorted(nodes, c)]]) for c, n, o in linked], axis=1)


def _count(threshold: int):
    names = ["cid", "n", "others", "near"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, segment, rows, last, blocks, out = None, None, [], None, None, []

        def send() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in np.concatenate(out, axis=1)], names=names)

        for rb in batches:
            for label, i, j, s, block, cid, size, times, keys in zip(*(c.to_pylist() for c in rb.columns), strict=True):
                if ((label, i, j), s) != (group, segment):
                    if rows:
                        blocks.add(rows)
                    rows, last, segment = [], None, s
                if (label, i, j) != group:
                    if blocks:
                        out.append(blocks.links(threshold))
                        if sum(x.shape[1] for x in out) > 1 << 16:
                            yield send()
                            out = []
                    group, blocks = (label, i, j), _Blocks(i == j)
                # rows of one class follow each other
                if last != (block, cid, size):
                    rows.append((int(block != i), cid, size, times, keys))
                    last = (block, cid, size)
        if blocks:
            blocks.add(rows)
            out.append(blocks.links(threshold))
            yield send()

    return run


def in_blocks(components: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """(cid, n, members, label, block, low, high) of each class of a component.

    Blocks of a component are cut from its classes in the order of their sizes, and hold BLOCK classes and BLOCK_NGRAMS n-grams
    on average at most; a size that fills several spreads over them by hash.  low to high are the blocks whose sizes
    permit similarity.
    """
    share = F.greatest(F.lit(1 / BLOCK), F.col("n") / BLOCK_NGRAMS)
    placed = components.join(classes.select(F.shiftrightunsigned("cid", 24).alias("node"), "cid", "n", "members"), "node").select("cid", "n", "members", "label")
    smaller = Window.partitionBy("label").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    widths = placed.groupBy("label", "n").agg(F.count(F.lit(1)).alias("k")).withColumn("width", F.col("k") * share)
    begins = widths.select("label", "n", "width", F.coalesce(F.sum("width").over(smaller), F.lit(0.0)).alias("begin"))
    spread = F.pmod(F.xxhash64("cid", "n"), F.lit(1 << 20)) / (1 << 20)
    placed = keep(placed.join(begins, ["label", "n"]).select("cid", "n", "members", "label", F.floor(F.col("begin") + F.col("width") * spread).cast("int").alias("block")))
    ends = keep(placed.groupBy("label", "block").agg(F.min("n").alias("least"), F.max("n").alias("most")))
    others = ends.select("label", F.col("block").alias("other"), F.col("least").alias("other_least"), F.col("most").alias("other_most"))
    meets = ends.join(others, "label").filter(F.least("most", "other_most") * 100 >= F.greatest("least", "other_least") * threshold)
    return placed.join(meets.groupBy("label", "block").agg(F.min("other").alias("low"), F.max("other").alias("high")), ["label", "block"])


def linked_classes(classes: DataFrame, docs: DataFrame, level: np.ndarray, mass: np.ndarray, n: int, threshold: int) -> DataFrame:
    """(cid, n, others, near): rows that a class is linked to, in parts to be summed, and a class id that its links reach.

    Links are those of any two classes whose sets satisfy the threshold; the ids reached connect the same classes. classes:
    (cid, n, rep, members).  Candidates go by node, the first 40 bits of a class id; should two classes share one, both are counted.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    shared_level = sc.broadcast(level)
    share = prefix_lengths(np.array([1000]), threshold)[0][0] / 1000
    fragments = int(max(1, mass.sum() * share // FRAGMENT))
    prefix = texts(docs).select("text").mapInArrow(_prefixes(n, threshold, shared_level, fragment_cuts(mass, fragments)), "fragment int, packed binary, edges binary")
    found = prefix.repartition(fragments, "fragment").sortWithinPartitions("fragment").mapInArrow(_find_stars(threshold), STARS)
    members = keep(in_blocks(connected_stars(found), classes, threshold))
    reps = classes.join(members.select("cid", "n"), ["cid", "n"], "left_semi").select(F.coalesce("rep", F.lit(-1)).alias("rep"))
    wanted = sc.broadcast(bloom_of(reps))
    segments = texts(docs).mapInArrow(_segments(n, shared_level, fragment_cuts(mass, SEGMENTS), wanted), "cid long, n long, segment int, keys binary")
    # so many members or fewer go to the segments, else the segments to them
    near = F.broadcast(members) if members.limit(BROADCAST_MEMBERS + 1).count() <= BROADCAST_MEMBERS else members
    # a class meets every other block of its component that has sets of near sizes once, on either side
    held = (
        segments.join(near, ["cid", "n"])
        .withColumn("other", F.explode(F.sequence("low", "high")))
        .select("label", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "segment", "block", "cid", "n", "members", "keys")
    )
    return (
        held.repartition(F.col("label"), F.col("i"), F.col("j"))
        .sortWithinPartitions("label", "i", "j", "segment", "block", "cid", "n")
        .mapInArrow(_count(threshold), "cid long, n long, others long, near long")
    )


def near_duplicates(docs: DataFrame, n: int = 3, threshold: int = 70) -> DataFrame:
    """doc_id, n_shingles, n_similar, component_id for every row of ``docs``.

    Words are lower-cased in A-Z and split at ASCII white space; a set holds distinct
    n-word shingles, or with fewer words the whole sequence.  Two rows are linked when
    100 * intersection >= threshold * union.  Null and empty texts have an empty set and
    no links.  A row with a null id is linked like others, but never names a component; a
    component without any id has a null one.  Repeated rows count as separate rows.  An
    empty table gives no rows.  A set is identified by its size and a 64-bit sum of
    58-bit n-gram hashes.
    """
    spark = docs.sparkSession
    run, schema = _summaries(n)
    summary = keep(texts(docs).mapInArrow(run, schema))
    level = np.zeros(1 << SKETCH_BITS, np.uint8)
    mass = np.zeros(64, np.int64)
    chunks = summary.filter("chunk is not null").select("chunk", "counts").repartition("chunk").mapInArrow(_sum_chunks, "chunk int, level binary, total long, mass array<long>")
    for chunk, packed, _, part in chunks.collect():
        level[chunk * CHUNK : (chunk + 1) * CHUNK] = np.frombuffer(bytes(packed), np.uint8)
        mass += np.array(part, np.int64)
    rows = summary.filter("chunk is null").select("doc_id", "n", "cid")
    classes = keep(rows.filter("n > 0").groupBy("cid", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("members")))
    links = keep(linked_classes(classes, docs, level, mass, n, threshold))
    degree = links.groupBy("cid", "n").agg(F.sum("others").alias("others"))
    labels = connected(links.filter("cid != near").select(F.col("cid").alias("a"), F.col("near").alias("b")))
    named = labels.withColumnRenamed("node", "cid").join(classes.select("cid", "rep"), "cid")
    component = named.join(named.groupBy("label").agg(F.min("rep").alias("component_id")), "label").select("cid", "component_id").distinct()
    result = (
        classes.join(degree, ["cid", "n"], "left")
        .join(component, "cid", "left")
        .select("cid", "n", (F.col("members") - 1 + F.coalesce("others", F.lit(0))).alias("n_similar"), F.coalesce("component_id", "rep").alias("component_id"))
    )
    joined = rows.join(result, ["cid", "n"], "left")
    return joined.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("n_similar", F.lit(0)).cast("long").alias("n_similar"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, n: int = 3, threshold: int = 70) -> DataFrame:
    """``docs`` with one row of each component of linked texts, the one with the least id; all columns stay.

    Of repeated rows with that id one stays.  Rows without an id or without words stay.
    """
    found = keep(near_duplicates(docs, n, threshold))
    left = without_ids(docs, found.filter("component_id <> doc_id"))
    # an id that several rows share can't tell them apart: of those with words one stays
    again = found.filter("doc_id is not null and n_shingles > 0 and component_id = doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id")
    again = keep(again)
    if not again.limit(1).count():
        return left
    return without_ids(left, again).unionByName(left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns))
