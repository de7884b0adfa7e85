import random
import re
import zlib
from itertools import combinations

import numpy as np
import pytest

from kestrelbase.llm import ngram_join, sharding
from tests.llm.conftest import prose


def brute(rows, n=3, threshold=70):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    degree = [0] * len(rows)
    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
            degree[i] += 1
            degree[j] += 1
            up[root(i)] = root(j)
    out = []
    for i, (d, _) in enumerate(rows):
        own = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), degree[i], (min(own) if own else None) if sets[i] else d))
    return out


def as_set(df):
    return sorted(map(str, map(tuple, df.select("doc_id", "n_shingles", "n_similar", "component_id").collect())))


def copies(seed, n=40):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        text = prose(rnd, rnd.randrange(1, 60)).split()
        for k in range(rnd.randrange(1, 5)):
            edited = list(text)
            for _ in range(rnd.randrange(4)):
                edited[rnd.randrange(len(edited))] = f"E{rnd.randrange(9)}"
            rows.append((10 * i + k, " ".join(edited)))
    return rows


@pytest.mark.parametrize(("seed", "threshold"), [(1, 70), (2, 85), (3, 40)])
def test_near_duplicates_against_brute_force(make, seed, threshold):
    rows = copies(seed)
    assert as_set(ngram_join.near_duplicates(make(rows), 3, threshold)) == sorted(map(str, brute(rows, 3, threshold)))


def test_near_duplicates_of_odd_rows(make, odd_rows):
    assert as_set(ngram_join.near_duplicates(make(odd_rows))) == sorted(map(str, brute(odd_rows)))
    assert ngram_join.near_duplicates(make([])).count() == 0


def test_large_components_are_counted_in_blocks(make, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    rows = copies(4, 6) + [(1000 + i, "same words here and there in a row " + f"t{i}") for i in range(12)]
    assert as_set(ngram_join.near_duplicates(make(rows), 3, 60)) == sorted(map(str, brute(rows, 3, 60)))


def test_a_segment_held_by_one_block_counts_once(make, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 6)
    monkeypatch.setattr(ngram_join, "SEGMENTS", 64)
    rnd, rows = random.Random(9), []
    for c in range(0, 800, 100):
        # of twelve near copies two share a passage, and are just short of similar to each other
        body, own = prose(rnd, 62, 50_000).split(), prose(rnd, 8, 50_000)
        rows += [(c + i, " ".join(body[i % 4 : 62 - i // 4])) for i in range(10)]
        rows += [(c + 10, " ".join([*body[9:], own, prose(rnd, 2, 50_000)])), (c + 11, " ".join([own, prose(rnd, 2, 50_000), *body[:-9]]))]
    want = brute(rows)
    assert as_set(ngram_join.near_duplicates(make(rows))) == sorted(map(str, want)) and all(n > 1 for _, _, n, _ in want)


def near_copies(seed, n):
    """One text with a few words changed in every copy, cut short in some."""
    rnd = random.Random(seed)
    body, rows = prose(rnd, 80, 50_000).split(), []
    for i in range(n):
        own = list(body)
        for k in rnd.sample(range(80), rnd.randrange(4)):
            own[k] = f"e{rnd.randrange(10**6)}"
        rows.append((i, " ".join(own[: 80 - rnd.randrange(4) * rnd.randrange(8)])))
    return rows + rows[:9]


def shuffled(spark, after=-1):
    """(rows written to shuffles by stages later than ``after``, the last stage)."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    stages = [stages.apply(i) for i in range(stages.size())]
    return sum(x.shuffleWriteRecords() for x in stages if x.stageId() > after), max([-1, *(x.stageId() for x in stages)])


def test_links_of_many_near_copies_are_not_shuffled_pair_by_pair(spark, make):
    rows = near_copies(6, 400)
    docs, (_, last) = make(rows), shuffled(spark)
    got = as_set(ngram_join.near_duplicates(docs))
    sent = shuffled(spark, last)[0]
    want = brute(rows)
    links = sum(n for _, _, n, _ in want) // 2
    assert got == sorted(map(str, want)) and links > 40_000
    assert 0 < sent < links / 2


def test_blocks_of_near_sizes_hold_all_links(make, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 20)
    rnd = random.Random(7)
    body = prose(rnd, 300, 50_000).split()
    # sizes from 20 to 300, of which only near ones are similar, and many of one size
    rows = [(i, " ".join(body[: 20 + 2 * i])) for i in range(140)] + [(200 + i, " ".join([*body[:60], f"x{i}"])) for i in range(60)] + near_copies(8, 60)
    assert as_set(ngram_join.near_duplicates(make(rows))) == sorted(map(str, brute(rows)))


def test_overlaps_of_rare_and_common_ngrams():
    rng = np.random.default_rng(4)
    for most in (1, 50, 1 << 20):
        sets = [[np.unique(np.concatenate([rng.integers(0, 12, 8), rng.integers(20, 2000, 60)])).astype(np.uint64) for _ in range(m)] for m in (40, 23)]
        one, two = ((np.concatenate(x), np.repeat(np.arange(len(x)), [len(k) for k in x])) for x in sets)
        for b, side in ((sets[0], None), (sets[1], two)):
            total = np.zeros((40, len(b)), np.int32)
            ngram_join.add_overlaps(total, one, side, most)
            want = np.array([[len(np.intersect1d(x, y)) for y in b] for x in sets[0]])
            if side is None:
                np.fill_diagonal(total, 0)
                np.fill_diagonal(want, 0)
            assert (total == want).all()


def test_one_of_each(make, odd_rows):
    kept = [(r["doc_id"], r["text"]) for r in ngram_join.one_of_each(make(odd_rows)).collect()]
    ids = [k[0] for k in kept]
    assert ids.count(8) == 1 and 9 not in ids and {1, 2, 3, 4, 5, 6, 7, 10, 11, 12} <= set(ids)
    twice = make([(1, "a b c d"), (1, "a b c d"), (2, None), (2, None)])
    assert sorted(r["doc_id"] for r in ngram_join.one_of_each(twice).collect()) == [1, 2, 2]


def test_prefixes_always_meet():
    rng = np.random.default_rng(3)
    for _ in range(3000):
        t = int(rng.choice([67, 70, 80, 95, 50]))
        a = np.sort(rng.choice(10**6, rng.integers(1, 40), replace=False))
        b = np.union1d(np.delete(a, rng.choice(len(a), rng.integers(0, len(a) // 3 + 1), replace=False)), rng.choice(10**6, rng.integers(0, len(a) // 3 + 1)))
        both, any_ = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        if not len(b) or both == any_ or 100 * both < t * any_:
            continue
        s, g = (a, b) if len(a) <= len(b) else (b, a)
        ps, pg = ngram_join.prefix_lengths(np.array([len(s)]), t)[1][0], ngram_join.prefix_lengths(np.array([len(g)]), t)[0][0]
        sign = (lambda x, p: {(x[i], x[i + 1]) for i in range(p)}) if ngram_join.by_neighbours(t) else (lambda x, p: set(x[:p]))
        assert sign(s, ps) & sign(g, pg)


def test_smallest_capacity_against_all_cuts():
    rnd = random.Random(2)
    for _ in range(60):
        sizes = [rnd.randrange(1, 30) for _ in range(rnd.randrange(3, 9))]
        k = rnd.randrange(1, 4)
        best = min(max(sum(sizes[a:b]) for a, b in zip((0, *c), (*c, len(sizes)), strict=True)) for c in combinations(range(len(sizes) + 1), k - 1))
        got = sharding.smallest_capacity(sizes, k)
        at = [0, *sharding.cuts(sizes, got, k), len(sizes)]
        assert got == best and max(sum(sizes[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)) <= best


def test_shards_against_a_direct_partition(make):
    import hashlib

    rnd = random.Random(8)
    rows = [(i, prose(rnd, rnd.randrange(0, 40))) for i in range(900)] + [(1000 + i, "copied text") for i in range(300)]
    got = {r["doc_id"]: r for r in sharding.shard(make(rows), 7).collect()}
    groups = {}
    for _, t in rows:
        k = hashlib.md5(t.encode()).hexdigest()
        groups[k] = groups.get(k, 0) + len(t.encode()) + 1
    sizes = [groups[k] for k in sorted(groups)]
    total = [sum(r["size"] for r in got.values() if r["shard"] == s) for s in range(7)]
    assert max(total) <= sharding.smallest_capacity(sizes, 7)
    for i, t in rows:
        assert got[i]["text_crc32"] == zlib.crc32(t.encode()) and got[i]["size"] == len(t.encode()) + 1 and got[i]["law"] == "bytes" and got[i]["grown_shard"] is None
    for s in range(7):
        slots = sorted(r["slot"] for r in got.values() if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert len({got[1000 + i]["shard"] for i in range(300)}) == 1


def test_shards_of_odd_rows(make, odd_rows):
    got = sharding.shard(make(odd_rows), 16).collect()
    assert len(got) == len(odd_rows)
    for s in {r["shard"] for r in got}:
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots))) and 0 <= s < 16
    assert {r["size"] for r in got if r["doc_id"] in (1, 2)} == {1}
    assert sharding.shard(make([]), 16).count() == 0
