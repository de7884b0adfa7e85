"""Quality rules combined by weak supervision.

Each rule votes good, votes bad or abstains.  Expectation-maximisation over the counts of the
distinct vote patterns (at most 3 ** rules of them, whatever the corpus size) estimates the rules'
accuracies and the share of good texts; a text's posterior probability of being good
then decides, in place of a demand that it pass every rule.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelbase.llm import textvec as tv
from kestrelbase.llm.common import keep, map_texts, texts

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
ALPHA = UPPER.copy()
ALPHA[97:123] = True
WINDOW = 5

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_alpha", "n_lines", "n_adjacent", "n_marks", "n_symbol_words")


def measure(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """All counts of the texts of a pass."""
    starts, ends, h, wb = tv.words(buf, offs, lower=False)
    n_words = np.diff(wb)
    lead = (buf & 0xC0) != 0x80
    out = {"n_words": n_words, "word_chars": tv.per_text(lead & ~tv.SPACE[buf], offs), "n_symbols": tv.per_text(SYMBOLS[buf], offs), "n_upper": tv.per_text(UPPER[buf], offs), "n_alpha": tv.per_text(ALPHA[buf], offs), "n_marks": tv.per_text(buf == 0x21, offs)}
    marked = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(SYMBOLS[buf], out=marked[1:])
    out["n_symbol_words"] = tv.per_text(marked[ends] > marked[starts], wb)
    # lines: runs of bytes other than \n; an empty line holds no word and doesn't count
    ls, le = tv.spans_of(buf != 0x0A, offs)
    words_before = np.searchsorted(starts, np.stack([ls, le]))
    full = words_before[0] < words_before[1]
    ls, le = ls[full], le[full]
    lh = tv.span_hashes(buf, ls, le, lower=False)
    lb = np.searchsorted(ls, offs)
    out["n_lines"] = np.diff(lb)
    order = lh.copy()
    tv.sort_within(order, lb)
    out["n_dup_lines"] = tv.per_text(~tv.first_of_runs(order, lb), lb)
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    same[wb[:-1][n_words > 0]] = False
    out["n_adjacent"] = tv.per_text(same, wb)
    out["n_repeat_words"] = _repeated(h, wb)
    return out


def _repeated(h: np.ndarray, wb: np.ndarray) -> np.ndarray:
    """Words of each text that lie in a window of WINDOW words found twice or more in it."""
    g, gb = tv.chain(h, wb, WINDOW)
    if not len(g):
        return np.zeros(len(wb) - 1, np.int64)
    ordered = g.copy()
    tv.sort_within(ordered, gb)
    fresh = tv.first_of_runs(ordered, gb)
    again = np.flatnonzero(~fresh)
    mark = np.zeros(len(wb) - 1, bool)
    mark[np.searchsorted(gb, again, side="right") - 1] = True
    out = np.zeros(len(wb) - 1, np.int64)
    for t in np.flatnonzero(mark).tolist():
        own = ordered[gb[t] : gb[t + 1]]
        many = np.unique(own[~fresh[gb[t] : gb[t + 1]]])
        at = np.searchsorted(many, g[gb[t] : gb[t + 1]])
        hit = many[np.minimum(at, len(many) - 1)] == g[gb[t] : gb[t + 1]]
        spread = np.zeros(len(hit) + WINDOW, np.int64)
        np.add.at(spread, np.flatnonzero(hit), 1)
        np.add.at(spread, np.flatnonzero(hit) + WINDOW, -1)
        out[t] = int((np.cumsum(spread)[:-1] > 0).sum())
    return out


def counts(docs: DataFrame) -> DataFrame:
    """doc_id and all COUNTS of every row."""

    def score(column: pa.Array) -> dict[str, np.ndarray]:
        parts = [measure(buf, offs) for _, _, buf, offs in tv.passes(column)]
        return {c: np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.int64) for c in COUNTS}

    return map_texts(texts(docs), score, dict.fromkeys(COUNTS, pa.int64()), "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def votes() -> dict[str, tuple]:
    """For each rule: (votes good, votes bad) as conditions over the counts; neither is an abstention.

    A rule abstains where its evidence is thin (short texts) or between its two bounds.
    """
    n, c = F.col, F.col("n_words")
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    long_enough = c >= 20
    mean = per("word_chars", "n_words")
    return {
        "symbols": (per("n_symbols", "n_words") <= 0.02, per("n_symbols", "n_words") >= 0.1),
        "symbol_share": (per("n_symbols", "word_chars") <= 0.005, per("n_symbols", "word_chars") >= 0.03),
        "symbol_words": (long_enough & (per("n_symbol_words", "n_words") <= 0.02), long_enough & (per("n_symbol_words", "n_words") >= 0.15)),
        "repeated_windows": (long_enough & (n("n_repeat_words") * 20 <= c), n("n_repeat_words") * 100 > c * 15),
        "repeated_lines": ((n("n_lines") >= 3) & (n("n_dup_lines") == 0), (n("n_lines") >= 3) & (n("n_dup_lines") * 10 >= n("n_lines") * 3)),
        "capitals": ((n("n_alpha") >= 40) & (per("n_upper", "n_alpha") <= 0.2), (n("n_alpha") >= 40) & (per("n_upper", "n_alpha") >= 0.5)),
        "stutter": (long_enough & (n("n_adjacent") * 50 <= c), long_enough & (n("n_adjacent") * 10 >= c)),
        "exclamation": (long_enough & (per("n_marks", "n_words") <= 0.05), long_enough & (per("n_marks", "n_words") >= 0.4)),
        "word_length": (long_enough & mean.between(3, 10), long_enough & ((mean < 2.5) | (mean > 14))),
        "length": (c >= 50, c < 10),
    }


def learn(patterns: np.ndarray, weights: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray]:
    """(log odds of good, log-likelihood ratios (rules, 3) of votes bad / abstain / good) by expectation-maximisation.

    patterns: (p, rules) of 0 bad, 1 abstain, 2 good; weights: how many texts gave each.  Rules are taken
    to vote independently given a text's true quality.  Pseudo-counts carry the prior that a rule is
    right more often than wrong, which also settles which of the two classes is the good one.
    """
    p, rules = patterns.shape
    one = np.zeros((p, rules, 3))
    one[np.arange(p)[:, None], np.arange(rules)[None], patterns] = 1
    prior = {True: np.array([1.0, 2.0, 7.0]), False: np.array([7.0, 2.0, 1.0])}
    # start from the prior belief that rules seldom vote bad in error
    q = np.array([0.95, 0.25, 0.05])[np.minimum((patterns == 0).sum(1), 2)]
    for _ in range(rounds):
        mass = weights * q
        rest = weights * (1 - q)
        share = (mass.sum() + 8.0) / (weights.sum() + 10.0)
        yes = np.einsum("p,prv->rv", mass, one) + prior[True]
        no = np.einsum("p,prv->rv", rest, one) + prior[False]
        ratio = np.log(yes / yes.sum(1, keepdims=True)) - np.log(no / no.sum(1, keepdims=True))
        # a vote for good never speaks for bad, nor the reverse
        ratio[:, 2] = np.maximum(ratio[:, 2], 0.0)
        ratio[:, 0] = np.minimum(ratio[:, 0], 0.0)
        ratio[:, 1] = 0.0
        odds = float(np.log(share / (1 - share)))
        new = 1 / (1 + np.exp(-(odds + np.einsum("prv,rv->p", one, ratio))))
        done = np.abs(new - q).max() < 1e-9
        q = new
        if done:
            break
    return odds, ratio


def judge(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, posterior for every row.

    Words are runs of anything but ASCII white space.  A null or empty text has no words,
    fails the base rules and isn't kept.  Null and repeated ids are rows like others; an
    empty table gives no rows.
    """
    measured = keep(counts(docs))
    rules = votes()
    for name, (good, bad) in rules.items():
        measured = measured.withColumn(f"vote_{name}", F.when(bad, 0).when(good, 2).otherwise(1))
    seen = measured.groupBy(*(f"vote_{n}" for n in rules)).agg(F.count(F.lit(1)).alias("n")).collect()
    if seen:
        table = np.array([list(r) for r in seen], np.int64)
        odds, ratio = learn(table[:, :-1], table[:, -1].astype(float))
    else:
        odds, ratio = 0.0, np.zeros((len(rules), 3))
    total = F.lit(odds)
    for (name, _), r in zip(rules.items(), ratio.tolist(), strict=True):
        v = F.col(f"vote_{name}")
        total = total + F.when(v == 0, F.lit(r[0])).when(v == 2, F.lit(r[2])).otherwise(F.lit(r[1]))
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    posterior = 1 / (1 + F.exp(-total))
    return measured.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (posterior >= least)).alias("kept"), posterior.alias("posterior")
    )


