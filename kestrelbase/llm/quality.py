"""Quality classifier: supervised subword embeddings.

Hashed word, word-pair and character n-gram vectors are learned together with a softmax
layer by stochastic gradient descent in numpy.  A text's vector is the mean of its four
families' mean vectors.  As the output is linear in that mean, scoring needs one number per
hashed n-gram, the difference of its two logits; the vectors never leave the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelbase.llm import textvec as tv
from kestrelbase.llm.common import held_out, map_texts, texts, training_rows

U = np.uint64
BITS = 18
FAMILIES = 4
#: Labelled texts that the model learns from, at most.
TRAIN_ROWS = 3000
#: Gradient steps, at least.
LEAST_STEPS = 300
AGAIN = U(0x5851F42D4C957F2D)


def _slots(h: np.ndarray, family: int) -> np.ndarray:
    return (tv.mix(h ^ U(0x9E3779B9 * (family + 1))) >> U(64 - BITS)).astype(np.int64)


def features(buf: np.ndarray, offs: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each family (slots, bounds by text): words, word pairs, character 3-grams and 4-grams.

    A pair of equal words is one feature whatever the word.  Characters are code points;
    white space of all kinds counts as one kind.
    """
    _, _, h, wb = tv.words(buf, offs, lower=False)
    out = [(_slots(h, 0), wb)]
    counts = np.maximum(np.diff(wb) - 1, 0)
    pb = np.zeros(len(wb), np.int64)
    np.cumsum(counts, out=pb[1:])
    at = np.arange(pb[-1]) + np.repeat(wb[:-1] - pb[:-1], counts)
    pair = np.where(h[at] == h[at + 1], AGAIN, tv.mix(h[at] * U(3) + h[at + 1])) if len(at) else np.zeros(0, np.uint64)
    out.append((_slots(pair, 1), pb))
    lead = (buf & 0xC0) != 0x80
    first = np.flatnonzero(lead)
    cb = np.searchsorted(first, offs)
    # a character's code: its bytes, most of them one
    code = np.where(tv.SPACE[buf], 32, buf).astype(np.uint64)[first]
    size = np.diff(first, append=len(buf))
    for i in range(1, 4):
        more = np.flatnonzero(size > i)
        if len(more):
            code[more] = (code[more] << U(8)) | buf[first[more] + i].astype(np.uint64)
    for family, n in ((2, 3), (3, 4)):
        counts = np.maximum(np.diff(cb) - (n - 1), 0)
        gb = np.zeros(len(cb), np.int64)
        np.cumsum(counts, out=gb[1:])
        if not gb[-1]:
            out.append((np.zeros(0, np.int64), gb))
            continue
        rolled = code[: len(code) - n + 1].copy()
        for i in range(1, n):
            rolled *= U(0x100000001B3)
            rolled += code[i : len(code) - n + 1 + i]
        at = np.arange(gb[-1]) + np.repeat(cb[:-1] - gb[:-1], counts)
        out.append((_slots(rolled, family)[at], gb))
    return out


def train(found: list[str], y: np.ndarray, dim: int = 8, epochs: int = 5, rate: float = 2.0, batch: int = 32, seed: int = 7) -> tuple[np.ndarray, float]:
    """One number per slot and an intercept: the log odds of label 1 are their mean of means plus it."""
    bags = []
    for text in found:
        buf = np.frombuffer(text.encode(), np.uint8)
        ids, weights = [], []
        for slots, _ in features(buf, np.array([0, len(buf)])):
            if len(slots):
                u, n = np.unique(slots, return_counts=True)
                ids.append(u)
                weights.append(n / (len(slots) * FAMILIES))
        bags.append((np.concatenate(ids), np.concatenate(weights).astype(np.float32)) if ids else (np.zeros(0, np.int64), np.zeros(0, np.float32)))
    # few labelled texts are gone over more often
    epochs = max(epochs, -(-LEAST_STEPS * batch // max(1, len(bags))))
    rng = np.random.default_rng(seed)
    # n-grams of a single labelled text teach nothing about others
    seen = np.bincount(np.concatenate([b[0] for b in bags]), minlength=1 << BITS)
    used = np.flatnonzero(seen > 1)
    place = np.full(1 << BITS, -1, np.int32)
    place[used] = np.arange(len(used))
    bags = [(place[i][place[i] >= 0], w[place[i] >= 0]) for i, w in bags]
    vectors = ((rng.random((len(used), dim), np.float32) - 0.5) / dim).astype(np.float32)
    out = ((rng.random((2, dim), np.float32) - 0.5) / dim).astype(np.float32)
    share = np.clip(y.mean(), 0.01, 0.99)
    bias = np.log(np.array([1 - share, share], np.float32))
    steps, done = epochs * -(-len(bags) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for i in range(0, len(order), batch):
            chosen = order[i : i + batch]
            lr = rate * (1 - done / steps)
            done += 1
            ids = np.concatenate([bags[k][0] for k in chosen])
            w = np.concatenate([bags[k][1] for k in chosen])
            who = np.repeat(np.arange(len(chosen)), [len(bags[k][0]) for k in chosen])
            mean = np.zeros((len(chosen), dim), np.float32)
            for d in range(dim):
                mean[:, d] = np.bincount(who, weights=vectors[ids, d] * w, minlength=len(chosen))
            logits = mean @ out.T + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(chosen)), y[chosen]] -= 1
            back = p @ out
            out -= lr * (p.T @ mean) / np.sqrt(len(chosen))
            bias -= np.float32(lr * 0.05) * p.mean(0)
            w *= lr
            for d in range(dim):
                vectors[:, d] -= np.bincount(ids, weights=w * back[who, d], minlength=len(used))
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = vectors @ (out[1] - out[0])
    return weights, float(bias[1] - bias[0])


def score_pass(buf: np.ndarray, offs: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    """Probabilities of label 1 of the texts of a pass."""
    z = np.full(len(offs) - 1, bias)
    for slots, bounds in features(buf, offs):
        sums = np.zeros(len(slots) + 1)
        np.cumsum(weights[slots], dtype=np.float64, out=sums[1:])
        n = np.diff(bounds)
        z += (sums[bounds[1:]] - sums[bounds[:-1]]) / (np.maximum(n, 1) * FAMILIES)
    return 1 / (1 + np.exp(-z))


def _model(docs: DataFrame, labels: DataFrame, train_rows: int):
    found, y = training_rows(docs, labels, "quality", train_rows)
    model = train(found, y) if len(found) else (np.zeros(1 << BITS, np.float32), 0.0)
    return docs.sparkSession.sparkContext.broadcast(model)


def scores(column: pa.Array, model: tuple[np.ndarray, float]) -> np.ndarray:
    parts = [score_pass(buf, offs, *model) for _, _, buf, offs in tv.passes(column)]
    return np.concatenate(parts) if parts else np.zeros(0)


def classify(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    The model learns from at most ``train_rows`` labelled texts that aren't held out.  A
    null or empty text gets the intercept's score; without labelled rows every text gets
    0.5.  Null and repeated ids are rows like others; an empty table gives no rows.
    """
    shared = _model(docs, labels, train_rows)
    scored = map_texts(texts(docs), lambda column: {"score": scores(column, shared.value)}, {"score": pa.float64()}, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, with all their columns; nothing is shuffled."""
    shared = _model(docs, labels, train_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            yield rb.filter(pa.array(scores(rb.column("text"), shared.value) >= threshold))

    return docs.mapInArrow(run, docs.schema)
