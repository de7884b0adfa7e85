"""Token counts by a map-side two-tier lookup.

A byte-level BPE never merges across pre-tokens, so a text's count is the sum of its
pre-tokens' lengths.  Pre-tokens are cut on the byte buffer with numpy.  Tier one is a
compact broadcast table (bytes -> length) of frequent pre-tokens; tier two is each worker's own
table, which starts as a copy of it and learns what it missed by asking the tokenizer.
Keys are compared byte by byte, so no two pre-tokens are ever taken for one.  There is one pass over the
texts, and no pre-token is shuffled.

The frequent pre-tokens are those of a bounded sample of texts, read until there are enough.  Which texts
these are decides how often the first passes of a worker ask the tokenizer, and never a count.

A text in which the tokenizer would see an added token, or that holds a code point whose class
the tables don't know for sure, is counted by the tokenizer itself.
"""

from __future__ import annotations

import json
import os
import sys
import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelbase.llm import textvec as tv
from kestrelbase.llm.common import map_texts, texts

U = np.uint64
LETTER, NUMBER, WHITE, OTHER, UNSURE = range(5)
#: Frequent pre-tokens in the broadcast table, and the sample they are counted in: texts, and bytes of the longest of them.
FREQUENT, SAMPLE_TEXTS, SAMPLE_BYTES = 1 << 16, 1024, 1 << 15
#: Slots of a worker's table, of 17 bytes each; bytes of a pre-token that has a place there.
SLOTS, KEY_BYTES = 1 << 20, 16
#: Longer pre-tokens that a worker remembers, and the bytes of the longest such.
RARE, RARE_BYTES = 1 << 14, 256
#: White space to the pattern's \s.
_WHITE = {*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}


_classes = np.zeros(sys.maxunicode + 1, np.uint8)
_known = np.zeros((sys.maxunicode + 1) >> 8, bool)


def classes(codes: np.ndarray) -> np.ndarray:
    """The class of every code point of ``codes``; the table is filled 256 code points at a time, as texts ask for them."""
    for block in np.flatnonzero(np.bincount(codes >> 8, minlength=1)).tolist():
        if not _known[block]:
            for c in range(block << 8, (block + 1) << 8):
                kind = unicodedata.category(chr(c))
                # what this version of Unicode doesn't know another one may
                _classes[c] = WHITE if c in _WHITE else UNSURE if kind == "Cn" else {"L": LETTER, "N": NUMBER}.get(kind[0], OTHER)
            _known[block] = True
    return _classes[codes]


@lru_cache(maxsize=4)
def tokenizer(path: str):
    # a worker has one core: threads of the library's own would only hold memory
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def added_tokens(path: str) -> tuple[bytes, ...]:
    """The strings that the tokenizer cuts out of a text before anything else; checks that the file is of the kind this module knows."""
    with open(path) as f:
        spec = json.load(f)
    pre = spec["pre_tokenizer"]
    if spec.get("normalizer") or spec["model"]["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True):
        raise ValueError("the vectorised pre-tokens are those of a byte-level BPE without normaliser or prefix space")
    return tuple(t["content"].encode() for t in spec["added_tokens"])


def byte_classes(buf: np.ndarray) -> np.ndarray:
    """Each byte's class: that of the code point it belongs to."""
    cls = classes(np.arange(256))[buf]
    lead = np.flatnonzero(buf >= 0xC0)
    if len(lead):
        n = np.where(buf[lead] >= 0xF0, 4, np.where(buf[lead] >= 0xE0, 3, 2))
        cp = (buf[lead] & np.where(n == 2, 0x1F, np.where(n == 3, 0x0F, 0x07))).astype(np.int64)
        for i in range(1, 4):
            has = n > i
            cp[has] = (cp[has] << 6) | (buf[lead[has] + i] & 0x3F)
        of = classes(np.minimum(cp, sys.maxunicode))
        for i in range(4):
            has = n > i
            cls[lead[has] + i] = of[has]
    return cls


def pre_tokens(buf: np.ndarray, offs: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Starts of all pre-tokens of a pass: 's 't 're 've 'm 'll 'd, or an optional space before a run of letters, numbers or others, or white space that leaves the last one to what follows."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64)
    first = np.zeros(n + 1, bool)
    first[offs[:-1]] = True
    first[n] = True
    start = first[:n].copy()
    start[1:] |= cls[1:] != cls[:-1]
    white = cls == WHITE
    ends_text = first[1:]
    # the last white code point before something else stands alone ...
    last = np.zeros(n, bool)
    last[:-1] = white[:-1] & ~white[1:] & ~ends_text[:-1]
    at = np.flatnonzero(last)
    multi = at[(buf[at] & 0xC0) == 0x80]
    one = at[(buf[at] & 0xC0) != 0x80]
    start[one] = True
    for i in multi.tolist():
        while buf[i] & 0xC0 == 0x80:
            i -= 1
        start[i] = True
    # ... and, if it is a space, begins the next pre-token
    joined = one[buf[one] == 0x20] + 1
    start[joined] = False
    mark = np.flatnonzero((buf[:-1] == 0x27) & start[:-1] & (cls[1:] == LETTER) & ~ends_text[:-1])
    if len(mark):
        room = np.searchsorted(offs, mark, side="right")
        end = offs[room]
        b1 = buf[mark + 1]
        b2 = np.where(mark + 2 < end, buf[np.minimum(mark + 2, n - 1)], 0)
        single = np.isin(b1, np.frombuffer(b"stmd", np.uint8))
        double = ((b1 == ord("r")) & (b2 == ord("e"))) | ((b1 == ord("v")) & (b2 == ord("e"))) | ((b1 == ord("l")) & (b2 == ord("l")))
        for which, size in ((single, 2), (double & ~single, 3)):
            m = mark[which]
            start[m + 1] = False
            after = m + size
            start[after[after < n]] = True
    return np.flatnonzero(start)


def cut(buf: np.ndarray, offs: np.ndarray, added: tuple[bytes, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, bounds by text, texts to leave to the tokenizer)."""
    cls = byte_classes(buf)
    odd = tv.per_text(cls == UNSURE, offs) > 0
    if added and len(buf):
        raw = buf.tobytes()
        for token in added:
            at = raw.find(token)
            while at >= 0:
                t = int(np.searchsorted(offs, at, side="right")) - 1
                odd[t] = True
                at = raw.find(token, int(offs[t + 1]))
    starts = pre_tokens(buf, offs, cls)
    ends = np.append(starts[1:], len(buf)) if len(starts) else starts
    return starts, ends, np.searchsorted(starts, offs), odd


def keys_of(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(spans, 2) words of the first KEY_BYTES bytes of spans, zero behind their ends."""
    blocks = np.lib.stride_tricks.sliding_window_view(np.concatenate([buf, np.zeros(KEY_BYTES, np.uint8)]), KEY_BYTES)
    keys = blocks[starts].view(np.uint64)
    keys[:, 0] &= _FIRST[np.minimum(sizes, 8)]
    keys[:, 1] &= _FIRST[np.clip(sizes - 8, 0, 8)]
    return keys


_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class Lengths:
    """Pre-token lengths: a direct-mapped table of short pre-tokens, whose slots hold what came last, and a dict of longer ones."""

    def __init__(self, words: list[bytes], lengths: np.ndarray, slots: int = SLOTS) -> None:
        self.mask = U(slots - 1)
        self.keys = np.zeros((slots, 2), np.uint64)
        # bytes and tokens of the pre-token, each from 1 to KEY_BYTES; an empty slot says that the byte 0 is one token, which is so
        self.codes = np.zeros(slots, np.uint8)
        self.rare: dict[bytes, int] = {}
        self.learn(words, lengths)

    def _slots(self, keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return (tv.mix(keys[:, 0] ^ tv.mix(keys[:, 1] + sizes.astype(np.uint64))) & self.mask).astype(np.int64)

    def learn(self, words: list[bytes], lengths: np.ndarray) -> None:
        size = np.array([len(w) for w in words], np.int64)
        for i in np.flatnonzero((size > KEY_BYTES) & (size <= RARE_BYTES)).tolist():
            if len(self.rare) >= RARE:
                self.rare.clear()
            self.rare[words[i]] = int(lengths[i])
        short = np.flatnonzero(size <= KEY_BYTES)
        if not len(short):
            return
        raw = np.frombuffer(b"".join(words[i].ljust(KEY_BYTES, b"\0") for i in short.tolist()), np.uint64).reshape(-1, 2)
        at, pick = np.unique(self._slots(raw, size[short]), return_index=True)
        self.keys[at], self.codes[at] = raw[pick], (size[short][pick] - 1) * 16 + np.asarray(lengths)[short][pick] - 1

    def find(self, buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, whether known) of spans, by the table."""
        keys = keys_of(buf, starts, sizes)
        at = self._slots(keys, sizes)
        own, codes = self.keys[at], self.codes[at].astype(np.int32)
        return (codes & 15) + 1, ((codes >> 4) + 1 == sizes) & (own[:, 0] == keys[:, 0]) & (own[:, 1] == keys[:, 1])


_own: dict[str, Lengths] = {}


def _encode(path: str, words: list[bytes]) -> np.ndarray:
    t = tokenizer(path)
    many = getattr(t, "encode_batch_fast", t.encode_batch)
    return np.array([len(e) for e in many([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)], np.int32)


def count_pass(buf: np.ndarray, offs: np.ndarray, path: str, table: Lengths) -> np.ndarray:
    """Token counts of the texts of a pass."""
    starts, ends, bounds, odd = cut(buf, offs, added_tokens(path))
    sizes = ends - starts
    lengths, hit = table.find(buf, starts, sizes) if len(starts) else (np.zeros(0, np.int32), np.zeros(0, bool))
    miss = np.flatnonzero(~hit)
    if len(miss):
        raw = buf.tobytes()
        words = [raw[a:b] for a, b in zip(starts[miss].tolist(), ends[miss].tolist(), strict=True)]
        known = {w: table.rare[w] for w in set(words) if w in table.rare}
        new = [w for w in dict.fromkeys(words) if w not in known]
        got = _encode(path, new)
        known.update(zip(new, got.tolist(), strict=True))
        lengths[miss] = [known[w] for w in words]
        table.learn(new, got)
    counts = tv.per_text(lengths, bounds)
    for t in np.flatnonzero(odd).tolist():
        counts[t] = _encode(path, [buf[offs[t] : offs[t + 1]].tobytes()])[0]
    return counts


def frequent_lengths(docs: DataFrame, path: str, most: int = FREQUENT, sample: int = SAMPLE_TEXTS, longest: int = SAMPLE_BYTES) -> tuple[list[bytes], np.ndarray]:
    """The most frequent pre-tokens of at most ``sample`` texts of at most ``longest`` bytes, and their lengths."""
    found = docs.select("text").filter(F.octet_length("text") <= longest).take(sample)
    seen: Counter[bytes] = Counter()
    for _, _, buf, offs in tv.passes(pa.array([r[0] for r in found], pa.string())):
        starts, ends, _, _ = cut(buf, offs, ())
        raw = buf.tobytes()
        seen.update(raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True) if b - a <= KEY_BYTES)
    words = [w for w, n in seen.most_common(most) if n > 1]
    return words, _encode(path, words)


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``.

    Counts are those of the tokenizer file at ``path`` for the whole text, without begin,
    end or added special tokens; strings of special tokens inside a text count as the
    library counts them by default.  A null or empty text has 0 bytes and 0 tokens.  A very long text is
    cut as a whole in a pass of its own.  Null and repeated ids are rows like others; columns
    besides doc_id and text are ignored, whatever their names; nothing depends on the order of ties; an empty table gives no rows.
    """
    added_tokens(path)
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path))

    def score(column: pa.Array) -> dict[str, np.ndarray]:
        if path not in _own:
            _own[path] = Lengths(*table.value)
        sizes, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for _, _, buf, offs in tv.passes(column):
            sizes.append(np.diff(offs))
            counts.append(count_pass(buf, offs, path, _own[path]))
        return {"n_bytes": np.concatenate(sizes), "n_tokens": np.concatenate(counts)}

    counted = map_texts(texts(docs), score, {"n_bytes": pa.int64(), "n_tokens": pa.int64()}, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
