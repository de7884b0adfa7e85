"""URL filter: policy rules first, gradient-boosted trees on lexical features for the rest.

A rule names a host and a path beginning; it fits the host with all subdomains, and the
longest rule that fits wins.  URLs that no rule fits are judged by boosted regression trees
learned from labelled URLs: logistic loss, histogram splits, all in numpy.  The features say
nothing of a URL's words, only of their shape and of how its host's suffixes fared in training.
A third of all hosts are held out of training, so that what the trees say of them is no echo of a label.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrelbase.llm import textvec as tv
from kestrelbase.llm.common import map_texts

#: (rule, verdict).
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
#: Labelled URLs that the model learns from, at most.
TRAIN_ROWS = 20_000
#: Words of a host that label it as unwanted, as public block lists sort their categories.
SEED_TERMS = ("ads", "track", "casino", "bet", "bets", "poker", "pills", "viagra", "spam", "porn", "warez", "free")
NAMES = ("length", "host_length", "path_length", "depth", "labels", "digit_ratio", "host_digit_ratio", "hyphens", "entropy", "host_entropy", "parameters", "query_length", "fragment", "longest_label", "vowel_ratio", "suffix_rate", "suffix_count")
BINS = 32


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, lower-cased in A-Z; empty for null or without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.coalesce(_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls; of equally long ones the first listed."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(reversed(rules), key=lambda r: len(r[0])):
        name, _, begin = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + begin)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


@dataclass
class Suffixes:
    """How often hosts under each suffix were bad in training, smoothed towards the whole; unknown suffixes take their parent's."""

    rate: dict[str, float] = field(default_factory=dict)
    count: dict[str, int] = field(default_factory=dict)
    whole: float = 0.5

    @classmethod
    def learn(cls, hosts: list[str], y: np.ndarray, least: int = 5) -> Suffixes:
        n, bad = Counter(), defaultdict(float)
        for h, v in zip(hosts, y.tolist(), strict=True):
            for s in suffixes(h)[:2]:
                n[s] += 1
                bad[s] += v
        whole = float(y.mean()) if len(y) else 0.5
        kept = {s: c for s, c in n.items() if c >= least}
        return cls({s: (bad[s] + 10 * whole) / (c + 10) for s, c in kept.items()}, kept, whole)

    def look(self, host: str) -> tuple[float, float]:
        for s in reversed(suffixes(host)[:2]):
            if s in self.rate:
                return self.rate[s], float(np.log1p(self.count[s]))
        return self.whole, 0.0


def suffixes(host: str) -> list[str]:
    """com, example.com, www.example.com."""
    labels = host.split(".")
    return [".".join(labels[i:]) for i in range(len(labels) - 1, -1, -1)]


def _entropy(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bits a byte of each span."""
    size = ends - starts
    who = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(who)) + np.repeat(starts - np.cumsum(size) + size, size)
    n = np.bincount(who * 256 + buf[at], minlength=256 * len(size)).reshape(-1, 256)
    p = n / np.maximum(size, 1)[:, None]
    return -(p * np.log2(np.where(n > 0, p, 1))).sum(1)


def _next(places: np.ndarray, since: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The first of ``places`` at or after ``since``, or ``end`` if it comes before."""
    return np.minimum(np.append(places, np.iinfo(np.int64).max)[np.searchsorted(places, since)], end)


def _features(buf: np.ndarray, offs: np.ndarray, stats: Suffixes) -> np.ndarray:
    first, last = offs[:-1], offs[1:]
    where = lambda chars: np.flatnonzero(np.isin(buf, np.frombuffer(chars, np.uint8)))
    count = lambda places, a, b: np.searchsorted(places, b) - np.searchsorted(places, a)
    colon = where(b":")
    colon = colon[(colon + 2 < len(buf))]
    colon = colon[(buf[colon + 1] == 47) & (buf[colon + 2] == 47)]
    scheme = _next(colon, first, last)
    host = np.where(scheme + 3 <= last, scheme + 3, first)
    path = _next(where(b"/?#"), host, last)
    stop = _next(where(b"?#"), path, last)
    asks = (stop < last) & (buf[np.minimum(stop, len(buf) - 1)] == 63) if len(buf) else stop < last
    query = stop + asks
    end = np.where(asks, _next(where(b"#"), query, last), query)
    ands, dots, digits = where(b"&"), where(b"."), where(b"0123456789")
    begins = np.flatnonzero(np.diff(buf == 38, prepend=True) & (buf != 38))
    # a parameter that starts the query or follows a &
    parameters = count(begins, query + 1, end) + ((end > query) & (buf[np.minimum(query, max(len(buf) - 1, 0))] != 38) if len(buf) else 0)
    k = count(dots, host, path)
    at = np.searchsorted(dots, path)
    far = np.append(dots, 0)
    own = np.where(k >= 2, far[np.maximum(at - 2, 0)], np.where(k == 1, far[np.maximum(at - 1, 0)], path))
    letters = own - host - count(dots, host, own)
    # the longest label: between the dots of a host
    inner = dots[np.searchsorted(host, dots, side="right") > 0] if len(host) else dots
    owner = np.searchsorted(host, inner, side="right") - 1
    inner, owner = inner[inner < path[owner]], owner[inner < path[owner]]
    edges = np.sort(np.concatenate([host * 2, inner * 2 + 1]), kind="stable")
    begin = np.where(edges % 2 == 1, edges // 2 + 1, edges // 2)
    mine = np.sort(np.concatenate([np.arange(len(host)), owner]), kind="stable")
    finish = np.minimum(np.append(begin[1:] - 1, np.iinfo(np.int64).max), path[mine])
    longest = np.zeros(len(host), np.int64)
    np.maximum.at(longest, mine, np.maximum(finish - begin, 0))
    hashes, one, back = np.unique(tv.span_hashes(buf, host, path, lower=True), return_index=True, return_inverse=True)
    looked = np.array([stats.look(tv.LOWER[buf[host[i] : path[i]]].tobytes().decode("utf-8", "replace")) for i in one.tolist()]).reshape(-1, 2)[back]
    size, host_size = last - first, path - host
    return np.stack(
        [
            size, host_size, stop - path, count(where(b"/"), path, stop), k + 1, count(digits, first, last) / np.maximum(size, 1), count(digits, host, path) / np.maximum(host_size, 1), count(where(b"-"), host, path),
            _entropy(buf, first, last), _entropy(buf, host, path), parameters, end - query, count(where(b"#"), path, last) > 0, longest, count(where(b"aeiouAEIOU"), host, own) / np.maximum(letters, 1), looked[:, 0], looked[:, 1],
        ],
        axis=1,
    ).astype(np.float32)


def features(urls: pa.Array | list[str | None], stats: Suffixes) -> np.ndarray:
    """(urls, NAMES); a null counts as an empty URL.  Lengths are in bytes; a URL without :// is all host up to / ? or #."""
    column = urls if isinstance(urls, (pa.Array, pa.ChunkedArray)) else pa.array(urls, pa.string())
    parts = [_features(buf, offs, stats) for _, _, buf, offs in tv.passes(column, 1 << 15)]
    return np.concatenate(parts) if parts else np.zeros((0, len(NAMES)), np.float32)


@dataclass
class Trees:
    """Boosted regression trees as arrays: node -> feature (or -1 at a leaf), bound, value; children are 2i+1 and 2i+2."""

    start: float
    feature: np.ndarray
    bound: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, b, v in zip(self.feature, self.bound, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(f) + 1)) - 1):
                inner = f[at] >= 0
                right = x[rows, np.maximum(f[at], 0)] > b[at]
                at = np.where(inner, 2 * at + 1 + right, at)
            z += v[at]
        return 1 / (1 + np.exp(-z))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, l2: float = 1.0, least: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss over quantile bins."""
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)], axis=1)
    z = np.full(len(x), start)
    nodes = (1 << (depth + 1)) - 1
    all_f, all_b, all_v = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, p * (1 - p)
        feat, bound, value = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes)
        at = np.zeros(len(x), np.int64)
        for node in range(nodes):
            own = np.flatnonzero(at == node)
            if not len(own):
                continue
            gs, hs = g[own].sum(), h[own].sum()
            value[node] = -rate * gs / (hs + l2)
            if node >= nodes // 2:
                continue
            best, choice = 1e-6, None
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                gl = np.cumsum(np.bincount(binned[own, f], weights=g[own], minlength=len(e) + 1))[:-1]
                hl = np.cumsum(np.bincount(binned[own, f], weights=h[own], minlength=len(e) + 1))[:-1]
                gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
                gain[(hl < least) | (hs - hl < least)] = 0
                k = int(gain.argmax())
                if gain[k] > best:
                    best, choice = gain[k], (f, k)
            if choice:
                f, k = choice
                feat[node], bound[node] = f, edges[f][k]
                at[own] = 2 * node + 1 + (x[own, f] > edges[f][k])
        z += value[at]
        all_f.append(feat)
        all_b.append(bound)
        all_v.append(value)
    return Trees(start, np.array(all_f), np.array(all_b), np.array(all_v))


def seed_labels(urls: DataFrame, terms: tuple[str, ...] = SEED_TERMS) -> DataFrame:
    """(url, bad): 1 where a word of the host is a seed term, else 0; null URLs and ones without a host are left out."""
    words = F.split(F.col("host"), "[^a-z0-9]+")
    return urls.select("url", host_of(F.col("url")).alias("host")).filter("host <> ''").select("url", F.arrays_overlap(words, F.array(*map(F.lit, terms))).cast("int").alias("bad"))


def held_out(host: Column) -> Column:
    """A third of all hosts, by crc32: no label of their URLs is learned from."""
    return F.crc32(host.cast("binary")) % 3 == 1


def train(labelled: DataFrame, most: int = TRAIN_ROWS) -> tuple[Suffixes, Trees]:
    """The model from at most ``most`` labelled URLs (url, bad) whose hosts aren't held out, picked by a hash of the URL."""
    usable = labelled.filter("url is not null and bad is not null").filter(~held_out(host_of(F.col("url"))))
    rows = usable.groupBy("url").agg(F.max("bad").alias("bad")).orderBy(F.xxhash64("url"), "url").limit(most).collect()
    urls, y = [r[0] for r in rows], np.array([float(r[1]) for r in rows])
    stats = Suffixes.learn([u.split("://", 1)[-1].split("/", 1)[0].lower() for u in urls], y)
    if not urls or y.min() == y.max():
        # nothing to tell apart: allow
        return stats, Trees(-10.0, np.full((1, 1), -1), np.zeros((1, 1)), np.zeros((1, 1)))
    return stats, boost(features(urls, stats), y)


def judge(pages: DataFrame, labelled: DataFrame, rules: tuple[tuple[str, str], ...], train_rows: int = TRAIN_ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict, score, held_out for every row of ``pages``.

    score: the model's probability that the URL is unwanted; it decides, at 0.5, where no
    rule fits.  held_out: whether the labels of the URL's host were kept from training.  A null URL or one without :// has an
    empty host and path, no rule, and is judged by the model like others, as is a very long one.  Null and repeated ids are rows
    like others; of rules that tie in length the first listed wins; a URL labelled twice counts once, as unwanted if either label
    says so; columns besides page_id and url are ignored, whatever their names.  An empty table gives
    no rows; without labelled URLs the model allows all.
    """
    shared = pages.sparkSession.sparkContext.broadcast(train(labelled, train_rows))

    def score(column: pa.Array) -> dict[str, np.ndarray]:
        stats, trees = shared.value
        return {"score": trees.predict(features(column, stats))}

    url = F.col("url")
    parts = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), url.alias("text"))
    scored = map_texts(parts, score, {"score": pa.float64()}, "page_id long, host string, path string, score double")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "score", held_out(F.col("host")).alias("held_out"))
