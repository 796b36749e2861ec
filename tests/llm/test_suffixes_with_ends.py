"""Suffix order and repeated strings with end marks: many texts in one array, long carries, ties, repeated ranks."""

import random

import numpy as np
import pytest

from duelframe.llm import repeats, suffixes


def table(rng, n, letters, longest):
    core = ["".join(rng.choice(letters) for _ in range(60)) for _ in range(3)]
    out = []
    for _ in range(n):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, longest)))
        if rng.random() < 0.5:
            c = rng.choice(core)
            t += c[rng.randint(0, 20) : rng.randint(30, 60)] + "".join(rng.choice(letters) for _ in range(rng.randint(0, longest)))
        out.append(t.encode())
    return out


def brute(texts, ranks, length):
    least = {}
    for t, r in zip(texts, ranks):
        for i in range(len(t) - length + 1):
            s = t[i : i + length]
            least[s] = min(r, least.get(s, r))
    return {(k, i) for k, (t, r) in enumerate(zip(texts, ranks)) for i in range(len(t) - length + 1) if least[t[i : i + length]] < r}


def starts(found):
    return {(t, i) for t, a, b in found for i in range(a, b + 1)}


@pytest.mark.parametrize("letters", ["a", "ab", "abcdefghijklmnopqrst"])
@pytest.mark.parametrize("lanes", [1, 3, 4096])
def test_repeated_strings_of_small_tables(monkeypatch, letters, lanes):
    monkeypatch.setattr(suffixes, "_LANES", lanes)
    rng = random.Random(len(letters) * 10 + lanes)
    for _ in range(40):
        texts = [t for t in table(rng, rng.randint(2, 12), letters, 30) if t] or [b"a"]
        ranks = np.array([rng.choice([k, k, 1]) for k in range(len(texts))], dtype=np.int64)
        length = rng.choice([3, 10, 24])
        assert starts(repeats.repeated_strings(texts, ranks, length)) == brute(texts, ranks.tolist(), length)


def test_repeated_strings_of_a_large_table():
    """More than half a megabyte, so that every lane carries lengths over many places."""
    rng = random.Random(77)
    texts = table(rng, 7_500, "etaoin srhldcumf", 70)
    assert sum(map(len, texts)) > 500_000
    ranks = np.arange(len(texts), dtype=np.int64)
    assert starts(repeats.repeated_strings(texts, ranks, 30)) == brute(texts, ranks.tolist(), 30)


def test_order_with_end_marks():
    rng = random.Random(5)
    for _ in range(60):
        texts = [t for t in table(rng, 6, "ab", 12)]
        joined = b"\0".join([*texts, b""])
        codes = np.frombuffer(joined, dtype=np.uint8).astype(np.int64) + 1
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        codes[ends] = 0
        order = suffixes.doubling_suffix_array(codes, len(codes) + 1, ends=ends)
        marks = {int(e): k for k, e in enumerate(ends)}
        # end marks are smaller than all else, and earlier ones are smaller
        whole = lambda i: [(0, marks[j]) if j in marks else (1, int(codes[j])) for j in range(i, len(codes))]
        assert order.tolist() == sorted(range(len(codes)), key=whole)
