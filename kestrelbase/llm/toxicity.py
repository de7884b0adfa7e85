"""Toxicity: a factorization machine over hashed terms.

log odds = w0 + sum of w_i + sum over pairs of <v_i, v_j> over the distinct terms of a text: words, lower-cased
in A-Z and stripped of ASCII punctuation at their ends, and the words' first characters.  The pair
term is computed as half of (sum of v)^2 - sum of v^2, so it costs no more than the linear one.

Terms that say nothing in training have no weight at all, so that a long text doesn't gather noise.  A term says
something where its own texts are toxic more or less often than all are, or where the texts that it shares with
another word are toxic more or less often than the two words' own rates would have it: an insult together with
a group, say, while either alone is harmless.  The evidence asked for is fixed; how many terms meet it is not.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelbase.llm import textvec as tv
from kestrelbase.llm.common import held_out, map_texts, texts, training_rows

U = np.uint64
BITS = 20
#: Labelled texts that the model learns from, at most.
TRAIN_ROWS = 12000
#: Log-likelihood ratios asked of a term that speaks for toxicity, of one that speaks against it, and of a pair of words.
FOR, AGAINST, PAIR = 12.0, 20.0, 30.0
#: The share of training texts that hold a word whose pairs are tested, at least, and words in a block of pairs.
PAIR_SHARE, PAIR_BLOCK = 0.05, 256
#: Lengths of the word beginnings that are terms besides the word.
HEADS = (4, 5, 6)


def terms(buf: np.ndarray, offs: np.ndarray, heads: tuple[int, ...] = HEADS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct term slots of each text, sorted, and their bounds."""
    starts, ends = tv.spans_of(tv.PLAIN[buf], offs)
    wb = np.searchsorted(starts, offs)
    kinds = [tv.span_hashes(buf, starts, ends, lower=True)]
    for n in heads:
        stop = np.minimum(starts + n, ends)
        kinds.append(tv.mix(tv.span_hashes(buf, starts, stop, lower=True) + U(n)))
    slots = np.stack([(h >> U(64 - BITS)) for h in kinds], axis=1).ravel()
    bounds = wb * len(kinds)
    tv.sort_within(slots, bounds)
    first = tv.first_of_runs(slots, bounds)
    out = np.zeros(len(bounds), np.int64)
    np.cumsum(tv.per_text(first, bounds), out=out[1:])
    return slots[first].astype(np.int64), out


def _ratio(n1: np.ndarray, n: np.ndarray, rate) -> np.ndarray:
    """Twice the log-likelihood ratio of n1 of n being toxic against ``rate``."""
    n0 = n - n1
    with np.errstate(divide="ignore", invalid="ignore"):
        return 2 * (np.where(n1 > 0, n1 * np.log(n1 / (n * rate)), 0) + np.where(n0 > 0, n0 * np.log(n0 / (n * (1 - rate))), 0))


def telling_terms(ids: np.ndarray, who: np.ndarray, y: np.ndarray, words: np.ndarray, holders: np.ndarray) -> np.ndarray:
    """Slots of terms whose presence depends on the label, either way, and of words that interact with another word.

    ids and who: all terms of all texts, and the texts; words and holders: whole words alone.
    """
    n1 = np.bincount(ids, weights=y[who], minlength=1 << BITS)
    n = np.bincount(ids, minlength=1 << BITS).astype(float)
    rate = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    g = _ratio(n1, n, rate)
    telling = (n >= 2) & np.where(n1 > n * rate, g > FOR, g > AGAINST)
    telling[_pairs(words, holders, y, rate)] = True
    return np.flatnonzero(telling)


def _pairs(ids: np.ndarray, who: np.ndarray, y: np.ndarray, rate: float) -> np.ndarray:
    """Slots of words that occur in some pair whose texts are toxic more or less often than the two words' odds multiplied."""
    texts = len(y)
    n1 = np.bincount(ids, weights=y[who], minlength=1 << BITS)
    n = np.bincount(ids, minlength=1 << BITS).astype(float)
    common = np.flatnonzero((n >= max(5.0, PAIR_SHARE * texts)) & (n < texts))
    if len(common) < 2:
        return common[:0]
    place = np.full(1 << BITS, -1, np.int32)
    place[common] = np.arange(len(common))
    mine = place[ids] >= 0
    col, row = place[ids[mine]], who[mine]
    odds = np.log((n1[common] + rate) / (n[common] - n1[common] + 1 - rate))
    base = np.log(rate / (1 - rate))
    found = np.zeros(len(common), bool)
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    edge = np.searchsorted(col, np.arange(0, len(common) + PAIR_BLOCK, PAIR_BLOCK))

    def block(k: int) -> np.ndarray:
        x = np.zeros((texts, min(PAIR_BLOCK, len(common) - k * PAIR_BLOCK)), np.float32)
        x[row[edge[k] : edge[k + 1]], col[edge[k] : edge[k + 1]] - k * PAIR_BLOCK] = 1
        return x

    toxic = y > 0
    for i in range(len(edge) - 1):
        left = block(i)
        for j in range(i, len(edge) - 1):
            right = left if i == j else block(j)
            both, bad = left.T @ right, left[toxic].T @ right[toxic]
            a, b = slice(i * PAIR_BLOCK, i * PAIR_BLOCK + both.shape[0]), slice(j * PAIR_BLOCK, j * PAIR_BLOCK + both.shape[1])
            # words that always go together say no more than one of them
            apart = both <= 0.9 * np.minimum(n[common[a]][:, None], n[common[b]][None])
            want = 1 / (1 + np.exp(-np.clip(odds[a][:, None] + odds[b][None] - base, -8, 8)))
            x, z = np.nonzero(apart & (both >= 5) & (_ratio(bad, np.maximum(both, 1), want) > PAIR))
            found[a.start + x] = found[b.start + z] = True
    return common[found]


def train(found: list[str], y: np.ndarray, rank: int = 4, epochs: int = 12, rate: float = 0.15, l2: float = 2e-4, batch: int = 64, seed: int = 11) -> tuple[np.ndarray, np.ndarray, float]:
    """(place of each slot in the weights, or -1; weights (terms, 1 + rank); intercept)."""
    bags, words = [], []
    for text in found:
        buf = np.frombuffer(text.encode(), np.uint8)
        offs = np.array([0, len(buf)])
        bags.append(terms(buf, offs)[0].astype(np.int32))
        words.append(terms(buf, offs, ())[0].astype(np.int32))
    owners = lambda x: np.repeat(np.arange(len(x), dtype=np.int32), [len(b) for b in x])
    chosen = telling_terms(np.concatenate(bags), owners(bags), y, np.concatenate(words), owners(words))
    place = np.full(1 << BITS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    bags = [place[b][place[b] >= 0] for b in bags]
    rng = np.random.default_rng(seed)
    w = np.zeros((len(chosen), 1 + rank))
    w[:, 1:] = rng.normal(0, 0.05, (len(chosen), rank))
    share = np.clip(y.mean(), 0.01, 0.99)
    w0 = float(np.log(share / (1 - share)))
    grown = np.full_like(w, 1e-2)
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for i in range(0, len(order), batch):
            part = order[i : i + batch]
            ids = np.concatenate([bags[k] for k in part])
            who = np.repeat(np.arange(len(part)), [len(bags[k]) for k in part])
            z, sums = _logits(w, ids, who, len(part), w0)
            e = 1 / (1 + np.exp(-z)) - y[part]
            w0 -= rate * 0.3 * float(e.mean())
            if not len(ids):
                continue
            grad = np.empty((len(ids), w.shape[1]))
            grad[:, 0] = e[who]
            grad[:, 1:] = e[who][:, None] * (sums[who] - w[ids, 1:])
            u, back = np.unique(ids, return_inverse=True)
            g = np.zeros((len(u), w.shape[1]))
            np.add.at(g, back, grad)
            g += l2 * w[u] * len(part)
            grown[u] += g * g
            w[u] -= rate * g / np.sqrt(grown[u])
    return place, w.astype(np.float32), w0


def _logits(w: np.ndarray, ids: np.ndarray, who: np.ndarray, n: int, w0: float) -> tuple[np.ndarray, np.ndarray]:
    z = w0 + np.bincount(who, weights=w[ids, 0], minlength=n)
    sums = np.empty((n, w.shape[1] - 1))
    for f in range(1, w.shape[1]):
        v = w[ids, f].astype(np.float64)
        sums[:, f - 1] = np.bincount(who, weights=v, minlength=n)
        z += 0.5 * (sums[:, f - 1] ** 2 - np.bincount(who, weights=v * v, minlength=n))
    return z, sums


def score_pass(buf: np.ndarray, offs: np.ndarray, place: np.ndarray, w: np.ndarray, w0: float) -> np.ndarray:
    """Probabilities of toxicity of the texts of a pass."""
    starts, ends = tv.spans_of(tv.PLAIN[buf], offs)
    wb = np.searchsorted(starts, offs)
    owner = tv.owner(wb)
    ids, who = [], []
    for n in (0, *HEADS):
        h = tv.span_hashes(buf, starts, np.minimum(starts + n, ends) if n else ends, lower=True)
        if n:
            h = tv.mix(h + U(n))
        at = place[(h >> U(64 - BITS)).astype(np.int64)]
        known = at >= 0
        ids.append(at[known])
        who.append(owner[known])
    both = np.unique(np.concatenate(who) * (1 << 32) + np.concatenate(ids))
    ids, who = both & 0xFFFFFFFF, both >> 32
    z, _ = _logits(w, ids, who, len(offs) - 1, w0) if len(ids) else (np.full(len(offs) - 1, w0), None)
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def classify(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    The model learns from at most ``train_rows`` labelled texts that aren't held out.  A
    null or empty text gets the intercept's score; without labelled rows every text gets
    0.5.  A very long text is scored as a whole by its distinct terms.  Null and repeated ids are rows like others; an id labelled
    twice counts once, with the higher label; columns besides doc_id and text are ignored, whatever their names; nothing depends on
    the order of ties; an empty table gives no rows.
    """
    found, y = training_rows(docs, labels, "toxic", train_rows)
    model = train(found, y) if len(found) else (np.full(1 << BITS, -1, np.int32), np.zeros((1, 2), np.float32), 0.0)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(column: pa.Array) -> dict[str, np.ndarray]:
        parts = [score_pass(buf, offs, *shared.value) for _, _, buf, offs in tv.passes(column)]
        return {"score": np.concatenate(parts) if parts else np.zeros(0)}

    scored = map_texts(texts(docs), score, {"score": pa.float64()}, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
