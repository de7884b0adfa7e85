import random
import re

import numpy as np
import pyarrow as pa

from kestrelbase.llm import textvec as tv


def test_words_match_the_pattern_and_hashes_match_equality():
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("ab é\t\n漢 ") for _ in range(rnd.randrange(30))) for _ in range(400)] + ["", None]
    seen = {}
    at = 0
    for lo, hi, buf, offs in tv.passes(pa.array(texts), 200):
        assert lo == at
        at = hi
        starts, ends, h, wb = tv.words(buf, offs, lower=False)
        for t in range(hi - lo):
            got = [buf[a:b].tobytes().decode() for a, b in zip(starts[wb[t] : wb[t + 1]], ends[wb[t] : wb[t + 1]], strict=True)]
            assert got == re.findall(r"[^\x20\x09-\x0D]+", texts[lo + t] or "")
            for w, x in zip(got, h[wb[t] : wb[t + 1]].tolist(), strict=True):
                assert seen.setdefault(w, x) == x
    assert at == len(texts) and len(set(seen.values())) == len(seen)


def test_chains_stay_inside_texts():
    buf = np.frombuffer(b"a b ca b c d", np.uint8)
    _, _, h, wb = tv.words(buf, np.array([0, 5, 5, 12]), lower=True)
    g, gb = tv.chain(h, wb, 3)
    assert gb.tolist() == [0, 1, 1, 3] and g[0] == g[1] and g[0] != g[2]


def test_passes_of_a_sliced_array_and_of_none():
    a = pa.array(["aa", None, "bb", "cc"]).slice(1, 2)
    assert [(lo, hi, b.tobytes()) for lo, hi, b, _ in tv.passes(a)] == [(0, 2, b"bb")]
    assert list(tv.passes(pa.array([], pa.string()))) == []


def test_hashes_tell_words_apart_that_cancel_in_powers_of_an_odd_number():
    # the Thue-Morse words and their complements share every polynomial hash modulo 2 ** 64 from some length on
    word = b"a"
    while len(word) < 4096:
        word += word.translate(bytes.maketrans(b"ab", b"ba"))
        other = word.translate(bytes.maketrans(b"ab", b"ba"))
        buf = np.frombuffer(word + b" " + other, np.uint8)
        h = tv.span_hashes(buf, np.array([0, len(word) + 1]), np.array([len(word), len(buf)]), lower=False)
        assert h[0] != h[1], len(word)


def test_hashes_see_every_byte_and_nothing_around():
    rng = np.random.default_rng(6)
    for n in (1, 7, 8, 9, 16, 63, 64, 255, 256, 257, 1000):
        word = rng.integers(97, 123, n, dtype=np.uint8)
        seen = set()
        for i in [*range(min(n, 40)), n - 1]:
            other = word.copy()
            other[i] ^= 1
            buf = np.concatenate([rng.integers(0, 255, 5, dtype=np.uint8), other, rng.integers(0, 255, 3, dtype=np.uint8)])
            seen |= {int(tv.span_hashes(buf, np.array([5]), np.array([5 + n]), lower=x)[0]) for x in (False, True)}
            assert tv.span_hashes(other, np.array([0]), np.array([n]), lower=False)[0] == tv.span_hashes(buf, np.array([5]), np.array([5 + n]), lower=False)[0]
        base = int(tv.span_hashes(word, np.array([0]), np.array([n]), lower=False)[0])
        assert base not in seen and len(seen) == len({*range(min(n, 40)), n - 1}) + 0
        assert tv.span_hashes(word - 32, np.array([0]), np.array([n]), lower=True)[0] == np.uint64(base)
