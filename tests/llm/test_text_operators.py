import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kestrelbase.llm import decontaminate, packing, quality, rules, substring, tokencount, toxicity
from tests.llm.conftest import prose

BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(BPE)
    return lambda texts: [len(e.ids) for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_token_counts_are_the_library_s(make, odd_rows, library):
    rnd = random.Random(2)
    alphabet = [*"ab'sdtmrevl 'l  \n\t12½é漢🙂!-\u3000\u200b\u0301", "'re", " '", "<|endoftext|>", "\r\n", "\xa0"]
    rows = odd_rows + [(100 + i, "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(40)))) for i in range(500)]
    got = tokencount.token_counts(make(rows), BPE, 100).collect()
    want = sorted((str(i), len((t or "").encode()), n, n > 100) for (i, t), n in zip(rows, library([t for _, t in rows]), strict=True))
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == want
    assert tokencount.token_counts(make([]), BPE).count() == 0


def test_small_tables_of_lengths_lose_nothing(library):
    import pyarrow as pa
    from kestrelbase.llm import textvec as tv

    rnd = random.Random(3)
    texts = [prose(rnd, 50) for _ in range(40)]
    texts += [" ".join(rnd.choice("ab") * rnd.randrange(1, 40) + "\0" * rnd.randrange(3) for _ in range(30)) for _ in range(40)]
    table = tokencount.Lengths([], np.zeros(0, np.int32), 4)
    got = np.concatenate([tokencount.count_pass(b, o, BPE, table) for _, _, b, o in tv.passes(pa.array(texts), 500)])
    assert got.tolist() == library(texts)


def test_words_that_cancel_in_polynomial_hashes_have_counts_of_their_own(make, library):
    word, rows = "a", []
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
        rows += [(len(rows), word), (len(rows) + 1, word.translate(str.maketrans("ab", "ba")))]
    got = {r["doc_id"]: r["n_tokens"] for r in tokencount.token_counts(make(rows, 1), BPE).collect()}
    assert [got[i] for i, _ in rows] == library([t for _, t in rows])


def base_counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = {x for x in windows if windows.count(x) > 1} if len(windows) < 3000 else {x for x, n in __import__("collections").Counter(windows).items() if n > 1}
    covered = {j for i, x in enumerate(windows) if x in often for j in range(i, i + 5)}
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed


def test_rules_against_direct_counts(make, odd_rows):
    rnd = random.Random(4)
    part = "a b c d e f g"
    rows = odd_rows + [(20, part + "\n" + part + "\nx\nx\n \n\n"), (21, (prose(rnd, 30) + "\n") * 2), (22, "# " + prose(rnd, 40) + " <b>&"), (23, "a a a a a a a a a a a a"), (24, "a a a a a b")]
    got = rules.judge(make(rows)).collect()
    have = sorted(str((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])) for r in got)
    assert have == sorted(str((i, *base_counts(t))) for i, t in rows)
    assert not any(r["kept"] for r in got if r["base_failed"])
    assert rules.judge(make([])).count() == 0


def test_rules_keep_prose_and_drop_junk(make):
    rnd = random.Random(6)
    clean = [(i, "\n".join(prose(rnd, 30) + "." for _ in range(4))) for i in range(300)]
    junk = [(1000 + i, " ".join(w + "$$$" for w in prose(rnd, 90).split())) for i in range(30)]
    kept = {r["doc_id"] for r in rules.judge(make(clean + junk)).collect() if r["kept"]}
    assert kept == set(range(300))


def test_expectation_maximisation_finds_planted_accuracies():
    rng = np.random.default_rng(1)
    good = rng.random(20_000) < 0.8
    right = np.array([0.95, 0.9, 0.8, 0.7])
    votes = np.where((rng.random((20_000, 4)) < right) == good[:, None], 2, 0)
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    odds, ratio = rules.learn(patterns, n.astype(float))
    assert abs(1 / (1 + np.exp(-odds)) - 0.8) < 0.05
    assert np.all(np.diff(-ratio[:, 0]) < 0), "the more accurate a rule, the more its vote weighs"


def labelled(rnd, n, good, bad, column):
    texts, labels = [], []
    for i in range(n):
        y = int(rnd.random() < 0.3)
        texts.append((i, (bad if y else good)(rnd)))
        labels.append((i, y))
    return texts, labels


def auc(p, y):
    order = np.argsort(np.argsort(p))
    pos = y == 1
    return (order[pos].sum() - pos.sum() * (pos.sum() - 1) / 2) / (pos.sum() * (~pos).sum())


def test_quality_learns_and_ignores_held_out_labels(spark, make, odd_rows):
    rnd = random.Random(7)
    texts, labels = labelled(rnd, 400, lambda r: prose(r, 40).upper(), lambda r: prose(r, 40), "quality")
    held = {i for i, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1}
    table = lambda flip: spark.createDataFrame([(i, 1 - y if flip and i in held else y) for i, y in labels] + [(None, 1), (5, None)], "doc_id long, quality int")
    rows = texts + [(None if i is None else 10_000 + i, t) for i, t in odd_rows]
    one, two = (sorted(quality.classify(make(rows), table(f)).collect(), key=str) for f in (False, True))
    assert one == two and len(one) == len(rows)
    got = {r["doc_id"]: r for r in one}
    y = dict(labels)
    assert auc(np.array([got[i]["score"] for i in sorted(held)]), np.array([y[i] for i in sorted(held)])) > 0.99
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) and r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in one)
    kept = quality.accepted(make(rows), table(False))
    assert kept.columns == make(rows).columns and kept.count() == sum(r["predicted"] for r in one)
    assert {r["score"] for r in quality.classify(make(texts[:3]), table(False).limit(0)).collect()} == {0.5}


def test_factorization_machine_learns_interactions(spark, make, odd_rows):
    rnd = random.Random(8)

    def build(r):
        a, b = r.random() < 0.5, r.random() < 0.5
        return " ".join([prose(r, 20), *(["insult"] if a else []), *(["group"] if b else [])]), int(a and b)

    made = [(i, *build(rnd)) for i in range(900)]
    labels = spark.createDataFrame([(i, y) for i, _, y in made], "doc_id long, toxic int")
    rows = [(i, t) for i, t, _ in made] + [(None if i is None else 10_000 + i, t) for i, t in odd_rows]
    got = {r["doc_id"]: r for r in toxicity.classify(make(rows), labels).collect()}
    held = [(i, y) for i, _, y in made if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([got[i]["predicted"] == y for i, y in held]) > 0.97
    assert toxicity.classify(make([]), labels).count() == 0
    assert {r["score"] for r in toxicity.classify(make(rows[:3]), labels.limit(0)).collect()} == {0.5}


@pytest.mark.parametrize("others", [0.0, 0.11])
def test_factorization_machine_learns_pairs_whose_terms_say_nothing_alone(spark, make, others):
    rnd = random.Random(31)

    def build(r):
        a, b, c = r.random() < 0.5, r.random() < 0.5, r.random() < others
        return " ".join([prose(r, 20), *(["insult"] if a else []), *(["group"] if b else []), *(["slur"] if c else [])]), int(a != b or c)

    made = [(i, *build(rnd)) for i in range(3000)]
    got = {r["doc_id"]: r for r in toxicity.classify(make([(i, t) for i, t, _ in made]), spark.createDataFrame([(i, y) for i, _, y in made], "doc_id long, toxic int")).collect()}
    held = [(i, y) for i, _, y in made if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i]["score"] >= 0.5) == (y == 1) for i, y in held]) > 0.97


def test_terms_of_harmless_texts_have_weights():
    rng = np.random.default_rng(3)
    texts, y = [], []
    for _ in range(1500):
        insult, quote = rng.random() < 0.4, rng.random() < 0.4
        texts.append(" ".join([*(["insult"] if insult else []), *(["quoted"] if quote else []), *(f"w{k}" for k in rng.integers(0, 200, 15))]))
        y.append(int(insult and not quote))
    place, w, w0 = toxicity.train(texts, np.array(y))
    score = lambda t: toxicity.score_pass(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]), place, w, w0)[0]
    assert score("insult w1 w2") > 0.7 and score("insult quoted w1 w2") < 0.3 and score("quoted") < score("w1 w2") + 1e-6


@pytest.mark.parametrize(("model", "label", "least"), [(toxicity, "toxic", 0.8), (quality, "quality", 0.98)])
def test_held_out_rows_of_the_given_tables(spark, model, label, least):
    d = "/root/testdata/sf0.1"
    labels = {r[0]: r[1] for r in spark.read.parquet(f"{d}/labels.parquet").select("doc_id", label).collect() if zlib.crc32(str(r[0]).encode()) % 3 == 1}
    got = model.classify(spark.read.parquet(f"{d}/documents.parquet").filter(F.col("doc_id").isin(list(labels)) | (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)), spark.read.parquet(f"{d}/labels.parquet"))
    rows = [(labels[r["doc_id"]], r["predicted"]) for r in got.filter("held_out").collect()]
    hit = [p for y, p in rows if y == 1]
    clean = [1 - p for y, p in rows if y == 0]
    assert len(rows) == len(labels) and np.mean(hit) >= least and np.mean(clean) >= 0.98


def brute_align(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max() / (2 * len(a))


def test_alignment_against_the_textbook():
    rng = np.random.default_rng(4)
    pairs = [(rng.integers(1, 5, rng.integers(1, 12)).astype(np.uint64), rng.integers(1, 5, rng.integers(1, 20)).astype(np.uint64)) for _ in range(200)]
    assert np.allclose(decontaminate.align(pairs), [brute_align(a.tolist(), b.tolist()) for a, b in pairs])


def test_leaks_against_brute_force(spark, make, odd_rows, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 900)
    rnd = random.Random(12)
    items = [(i, prose(rnd, 40, 2000)) for i in range(12)] + [(50, "tiny item"), (51, ""), (52, None), (None, "no id at all here")]
    rows = list(odd_rows)
    for i in range(80):
        body = prose(rnd, 120, 2000).split()
        if i % 2:
            copy = items[i % 12][1].split()
            for _ in range(i % 9):
                k = rnd.randrange(len(copy))
                copy[k : k + 1] = rnd.choice([[], ["new"], [copy[k], "more"]])
            body[40:40] = copy
        rows.append((100 + i, (" " if i % 4 else ", ").join(body).title()))
    rows.append((300, "so a Tiny, item here"))
    plain = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    want = set()
    for d, t in rows:
        w = plain(t)[:400]
        for k, x in items:
            if k is not None and x and w and brute_align(plain(x), w) >= 0.5:
                want.add((d, k))
    found = decontaminate.leaks(make(rows), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == want
    left = decontaminate.clean(make(rows), spark.createDataFrame(items, "item_id long, text string"))
    assert left.count() == len(rows) - len({d for d, _ in want}) and left.columns == make(rows).columns
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(make(rows), none).count() == 0 and decontaminate.clean(make([]), none).count() == 0


def test_leaks_of_an_only_copy_with_many_changed_words(spark, make):
    rnd = random.Random(21)
    items = [(i, prose(rnd, 40, 50_000)) for i in range(20)]
    rows = []
    for i, text in items:
        copy = text.split()
        for k in rnd.sample(range(40), 8 + i % 5):
            copy[k] = f"changed{i}x{k}"
        rows.append((100 + i, " ".join([prose(rnd, 30, 50_000), *copy, prose(rnd, 30, 50_000)])))
    want = {(d, k) for d, t in rows for k, x in items if brute_align(x.split(), t.split()) >= 0.5}
    found = decontaminate.leaks(make(rows), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == want and len(want) == 20


@pytest.mark.parametrize("share", [0.1, 0.2, 0.3, 0.35])
def test_recall_of_edited_items_against_full_alignment(spark, make, share):
    rnd = random.Random(int(share * 100))
    items = [(i, prose(rnd, rnd.randrange(6, 60), 3000)) for i in range(60)]
    rows = []
    for i, text in items:
        copy = text.split()
        for k in sorted(rnd.sample(range(len(copy)), round(share * len(copy))), reverse=True):
            copy[k : k + 1] = rnd.choice([["new"], [f"other{k}"], [], [copy[k], "more"]])
        rows.append((100 + i, " ".join([prose(rnd, 30, 3000), *copy, prose(rnd, 30, 3000)])))
    thirds = [(500 + i, " ".join("other" if k % 3 == 2 else w for k, w in enumerate(t.split()))) for i, t in items if len(t.split()) >= 9]
    want = {(d, k) for d, t in rows + thirds for k, x in items if brute_align(x.split(), t.split()) >= 0.5}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(make(rows + thirds), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got <= want and len(got) >= 0.98 * len(want) and len(want) > 40


def test_items_of_one_template_are_told_apart(spark, make):
    rnd = random.Random(41)
    head, tail = prose(rnd, 12, 900), prose(rnd, 9, 900)
    items = [(i, f"{head} name{i} {tail} end{i}") for i in range(200)] + [(300, "of the"), (301, "of"), (302, "of the")]
    rows = [(1000 + i, f"{prose(rnd, 20)} {items[i][1]} {prose(rnd, 20)}") for i in range(0, 200, 20)] + [(2000, "some of the words")]
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.leaks(make(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert all(got[1000 + i, i] == 1 for i in range(0, 200, 20)) and {k for k in got if k[0] == 2000} == {(2000, 300), (2000, 301), (2000, 302)}
    assert set(got) == {(d, k) for d, t in rows for k, x in items if brute_align(x.split(), t.split()) >= 0.5}


def window_reference(docs):
    """Repeats by the definition: every later occurrence of a window of chunks, in order of id, text hash and place; their union by text."""
    seen, out = set(), {}
    rows = {tuple(r) for r in docs.select("doc_id", F.xxhash64("text"), F.coalesce("text", F.lit(""))).collect()}
    for i, h, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        raw = t.encode()
        starts, ends, _, _ = substring.chunks(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        pieces, found = [raw[a:b] for a, b in zip(starts, ends, strict=True)], set()
        for x in range(len(pieces)):
            y = next((y for y in range(x, len(pieces)) if ends[y] - starts[x] >= substring.LEAST_BYTES), None)
            found |= {(x, y)} if y is not None else set()
        z = next((z for z in range(len(pieces) - 1, -1, -1) if len(raw) - starts[z] >= substring.LEAST_BYTES), None)
        found |= {(z, len(pieces) - 1)} if z is not None else set()
        gone = set()
        for x, y in sorted(found):
            key = tuple(pieces[x : y + 1])
            if key in seen:
                gone |= set(range(starts[x], ends[y]))
            seen.add(key)
        if gone:
            edge = sorted(gone)
            first = [k for k in edge if k - 1 not in gone]
            out[i, h] = list(zip(first, [k + 1 for k in edge if k + 1 not in gone], strict=True))
    return out


def spans_of(docs):
    return {(r["doc_id"], r["text_hash"]): [(s["start"], s["end"]) for s in r["spans"]] for r in substring.runs(docs).collect()}


def test_substrings_against_the_definition(make, odd_rows):
    rnd = random.Random(13)
    passage = prose(rnd, 70, 5000)
    rows = odd_rows + [(100 + i, prose(rnd, rnd.randrange(5, 60), 5000) + " " + passage + " " + prose(rnd, 20, 5000)) for i in range(20)] + [(200, "漢字" * 4000), (None, "other " + passage), (None, passage)]
    want = window_reference(make(rows))
    assert spans_of(make(rows)) == want and {k[0] for k in want} >= set(range(101, 120)) and 100 not in {k[0] for k in want}
    cut = {r["doc_id"]: r["text"] for r in substring.cut_texts(make(rows)).collect() if r["doc_id"] is not None}
    assert cut[100].count(passage) == 1 and all(len(cut[i]) < len(dict(rows)[i]) - 200 for i in range(101, 120))
    nameless = sorted(r["text"] or "" for r in substring.cut_texts(make(rows)).collect() if r["doc_id"] is None)
    assert len(nameless) == 4 and passage not in nameless and all(passage not in t for t in nameless)
    assert cut[1] is None and substring.cut_texts(make(rows)).columns == make(rows).columns
    assert substring.cut_texts(make(rows)).count() == len(rows) and substring.report(make([])).count() == 0 and substring.cut_texts(make([])).count() == 0
    report = {r["doc_id"]: r for r in substring.report(make(rows)).collect()}
    assert all(set(report[i]["sources"]) & set(range(100, 120)) for i in range(101, 120))


SOLID = ["x" * 5000, "x" * 5000 + " ", "=" * 700 + "\n", "ab" * 900 + "\t end", "word " + "漢字" * 900, "漢字" * 900 + "\u3000\n", "-" * 129, "-" * 128, "-" * 513, "_" * 30_000 + " _", "\n" * 3000, " " * 2000 + "z"]


@pytest.mark.parametrize("size", [1 << 19, 6000, 1])
def test_long_runs_without_white_space_are_cut_by_their_own_text_alone(make, monkeypatch, size):
    from kestrelbase.llm import textvec as tv

    for around in ([], ["tiny words here "], ["a b "] * 50):
        texts = [*around, *SOLID, *around, *SOLID[::-1], *around]
        for _, _, buf, offs in tv.passes(__import__("pyarrow").array(texts), size):
            starts, ends, digests, bounds = substring.chunks(buf, offs)
            assert np.all(ends - starts <= substring.LONGEST) and np.array_equal(starts[1:], ends[:-1])
            for t in range(len(offs) - 1):
                own = buf[offs[t] : offs[t + 1]]
                alone = substring.chunks(own, np.array([0, len(own)]))
                assert (ends[bounds[t] : bounds[t + 1]] - offs[t]).tolist() == alone[1].tolist() and digests[bounds[t] : bounds[t + 1]].tolist() == alone[2].tolist()
    rows = [(i, t) for i, t in enumerate([*SOLID, "tiny words here ", *SOLID])]
    got = spans_of(make(rows, 1))
    assert got == spans_of(make(rows, 7)) == window_reference(make(rows))
    left = {r["doc_id"]: r["text"] for r in substring.cut_texts(make(rows, 2)).collect()}
    # the second copy of every text of a window or more is gone as a whole
    assert all(left[len(SOLID) + 1 + i] == "" for i, t in enumerate(SOLID) if len(t.encode()) >= substring.LEAST_BYTES)


def test_pieces_of_unrelated_texts_are_no_repeat(make):
    rnd = random.Random(22)
    cut = lambda t: [t[a:b] for a, b in zip(*(x.tolist() for x in substring.chunks(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[:2]), strict=True)]
    rows = [(i, prose(rnd, 60, 5000)) for i in range(200)]
    mixed = []
    for _, t in rows:
        # one short chunk of each text, where it stays a chunk behind those before it
        fit = [c for c in cut(t)[1:-1] if len(c) < substring.LEAST_BYTES and cut("".join([*mixed, c, "end"]))[:-1] == [*mixed, c]]
        mixed += fit[:1] if len(mixed) < 32 else []
    assert len(mixed) == 32 and len("".join(mixed)) > 3 * substring.LEAST_BYTES
    later = {500: "".join([*mixed, "end"]), 501: " ".join([prose(rnd, 20, 5000), rows[150][1], prose(rnd, 20, 5000)])}
    got = {r["doc_id"]: [later[r["doc_id"]][s["start"] : s["end"]] for s in r["spans"]] for r in substring.report(make(rows + list(later.items()))).collect()}
    assert set(got) == {501} and all(x in rows[150][1] for x in got[501]) and len("".join(got[501])) > 150


def test_insertions_move_no_later_boundary():
    rnd = random.Random(14)
    text = prose(rnd, 500, 5000)
    ends = lambda t: {len(t) - int(e) for e in substring.chunk_ends(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))}
    a, b = ends(text), ends("some words put in front " + text)
    assert len(a - b) <= 2


def direct_best_fit(lengths, opened, capacities):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [b for b in bins if b[0] >= n]
        if fit:
            b = min(fit, key=lambda x: x[0])
        else:
            size = min((c for c in opened if c >= n), key=lambda c: (packing.cost(c) / c, c))
            b = [size, 0]
            bins.append(b)
        b[0] -= n
        b[1] += n
    return sum(packing.cost(min(c for c in capacities if c >= b[1])) for b in bins)


def test_packing_by_ranges_costs_what_piece_by_piece_does():
    rnd = random.Random(15)
    for _ in range(30):
        lengths = [rnd.choice([rnd.randrange(1, 65), rnd.randrange(1, 12), 7]) for _ in range(rnd.randrange(1, 200))]
        hist = {n: lengths.count(n) for n in set(lengths)}
        for opened in ((16, 64), (64,), (16, 32, 64)):
            placed, final, total = packing.pack_with(hist, opened, (16, 32, 64))
            assert total == pytest.approx(direct_best_fit(lengths, opened, (16, 32, 64)))
            assert sum(each * n for _, _, each, _, n, _ in placed) == len(lengths) and sum(n * c for _, n, c in final) == sum(lengths)


def test_packed_pieces_fill_bins_without_gaps(make, odd_rows, library):
    rnd = random.Random(16)
    rows = odd_rows + [(100 + i, prose(rnd, rnd.randrange(1, 400))) for i in range(200)] + [(None, "x y z")] * 3
    got = packing.pack(make(rows), BPE).collect()
    want = sorted((str(i), n + 1) for (i, _), n in zip(rows, library([t for _, t in rows]), strict=True))
    assert sum(r["n_tokens"] for r in got) == sum(n for _, n in want)
    assert sorted((str(r["doc_id"])) for r in got if r["piece"] == 0) == [i for i, _ in want]
    bins = {}
    for r in got:
        bins.setdefault(r["bin_id"], []).append(r)
    assert sorted(bins) == list(range(len(bins)))
    for own in bins.values():
        own.sort(key=lambda r: r["bin_offset"])
        at = 0
        for r in own:
            assert r["bin_offset"] == at
            at += r["n_tokens"]
        assert own[0]["bin_capacity"] == min(c for c in packing.CAPACITIES if c >= at)
    assert packing.pack(make([]), BPE).count() == 0
