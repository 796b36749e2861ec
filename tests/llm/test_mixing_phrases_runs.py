"""Mixing, collocations and periodic runs against plain Python: nulls, empty and long texts, ties, repeated rows, clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from duelframe.llm import collocations, mixing, periodic, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, len(t or "")) for i, t, lang, src in rows], DOCS)


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


# --- 11 ------------------------------------------------------------------------------------


def filled(sizes, weights, wanted, epochs):
    """Water-filling one source at a time, in exact fractions."""
    target, open_sources = {}, {s for s in sizes if sizes[s] and weights[s]}
    for s in sizes:
        target[s] = Fraction(0)
    left = Fraction(wanted)
    while open_sources:
        level = left / sum(weights[s] for s in open_sources)
        over = {s for s in open_sources if weights[s] * level >= epochs * sizes[s]}
        if not over:
            for s in open_sources:
                target[s] = weights[s] * level
            break
        for s in over:
            target[s] = Fraction(epochs * sizes[s])
            left -= target[s]
        open_sources -= over
    return target


SOURCES = [
    {"a": 1000, "b": 1000, "c": 1000},
    {"a": 10, "b": 1000, "c": 30, "é": 5, None: 700},
    {"only": 40},
    {"a": 3, "b": 7, "c": 900, "d": 11, "e": 1, None: 2},
]


@pytest.mark.parametrize("case", range(len(SOURCES)))
def test_targets_and_sizes_taken(spark, case):
    rng = random.Random(case)
    rows, k = [], 0
    for source, total in SOURCES[case].items():
        while total:
            n = min(total, rng.choice([1, 2, 5, 60]))
            rows.append((k, " ".join(rng.choice(["w", "xy", "é"]) for _ in range(n)) + rng.choice(["", " ", "\n"]), "en", source))
            total, k = total - n, k + 1
        rows += [(k, None, "en", source), (k + 1, " \t\x0b", "en", source), (k + 2, "", "en", source)]
        k += 3
    docs = documents(spark, rows)
    sized = mixing.sized(docs)
    sizes = {s: sum(n_words(t) for _, t, _, of in rows if of == s) for s in SOURCES[case]}
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weights = {s: [5, 2, 1][i % 3] for i, s in enumerate(order)}
    for share in (0.2, 1.5, 9.0):
        found = mixing.taken(sized, mixing.mix_plan(sized, [5, 2, 1], share=share)).collect()
        want = filled(sizes, weights, Fraction(share) * sum(sizes.values()), 2)
        text = {i: t for i, t, _, _ in rows}
        assert len(found) == len(rows)
        sums = defaultdict(int)
        for r in found:
            assert r["size"] == n_words(text[r["id"]]) and r["source_size"] == sizes[r["source"]]
            assert r["target"] == pytest.approx(float(want[r["source"]]), rel=1e-12)
            assert 0 <= r["taken"] <= 2 * r["size"] and r["repeats"] * r["size"] <= r["taken"]
            sums[r["source"]] += r["taken"]
        for s in sizes:  # every key is of its own here, so the target is met to the word
            assert sums[s] == int(want[s] + Fraction(1, 2)) if want[s].denominator < 1000 else abs(sums[s] - want[s]) <= 1


def test_sample_is_the_smallest_keys_and_ties_share(spark):
    rows = [(i % 7 if i < 300 else None, "w " * (1 + i % 4), "en", "hot" if i % 3 else "b") for i in range(500)]
    sized = mixing.sized(documents(spark, rows))
    weights = spark.createDataFrame([("hot", 1.0), ("gone", 3.0)], "source string, weight double")
    found = mixing.taken(sized, mixing.mix_plan(sized, weights, share=0.5)).collect()
    assert {r["taken"] for r in found if r["source"] == "b"} == {0}
    hot = [r for r in found if r["source"] == "hot"]
    by_key = defaultdict(list)
    for r in hot:
        by_key[r["key"]].append(r)
        assert r["key"] == hashlib.md5(":".join(str(x) for x in (17, r["id"], r["size"]) if x is not None).encode()).hexdigest()
    left = int(hot[0]["target"] + 0.5) % hot[0]["source_size"]
    whole = int(hot[0]["target"] + 0.5) // hot[0]["source_size"]
    for key in sorted(by_key):
        group = by_key[key]
        size = sum(r["size"] for r in group)
        part = group[0]["size"] if size <= left else left // len(group)
        assert {r["taken"] for r in group} == {whole * group[0]["size"] + part}
        left = left - size if size <= left else 0
    again = mixing.taken(sized.repartition(5), mixing.mix_plan(sized.repartition(3), weights, share=0.5)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, found))


def test_mixed_rows_are_whole_texts_and_one_part(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(1 + i % 9)), "en", "s") for i in range(60)] + [(99, None, "en", None)]
    docs = documents(spark, rows).withColumn("size", F.lit("mine")).withColumn("key", F.lit(1))
    out = mixing.mix(docs, [1], share=1.37)
    assert out.columns == [*docs.columns, "copy"]
    got, text, cut = out.collect(), {i: t for i, t, _, _ in rows}, 0
    for r in got:
        assert r["size"] == "mine" and r["key"] == 1 and text[r["doc_id"]].startswith(r["text"])
        cut += r["text"] != text[r["doc_id"]]
    total = sum(n_words(t) for t in text.values())
    assert cut <= 1 and sum(n_words(r["text"]) for r in got) == int(total * 1.37 + 0.5)
    assert len({(r["doc_id"], r["copy"]) for r in got}) == len(got)


def test_nothing_to_mix(spark):
    for rows in ([], [(1, None, "en", "a"), (None, "", None, None)]):
        sized = mixing.sized(documents(spark, rows))
        found = mixing.taken(sized, mixing.mix_plan(sized, [5, 2, 1])).collect()
        assert [(r["taken"], r["target"]) for r in found] == [(0, 0.0)] * len(rows)


# --- 12 ------------------------------------------------------------------------------------


def plain_collocations(rows, min_count, max_words, top):
    count, total = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        lowered = (text or "").encode().lower().decode()
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, max_words + 1):
                for i in range(len(w) - k + 1):
                    count[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, c in count.items():
        own = {p: a for p, a in c.items() if len(p) > 1 and a >= min_count}
        found = []
        for p, a in own.items():
            held = any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in own.items())
            if not held:
                score, cut = min((1000 * a * total[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), c[p[:cut]], c[p[cut:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


def phrase_rows(rng, n):
    words = ["The", "of", "new", "york", "city", "éa", "a" * 40, "x\x00y", "日本"]
    rows = []
    for i in range(n):
        text = ""
        for _ in range(rng.randint(0, 30)):
            text += rng.choice(words[: rng.choice([3, 5, 9])]) + rng.choice([" ", "  ", "\t", ", ", ".", "\n", " ", " "])
        rows.append((rng.choice([i, 3, None]), rng.choice([text, text.upper(), text]), rng.choice(["en", "de", None, "", "und"]), "s"))
    return rows + [(1, None, "en", "s"), (2, "", None, "s"), (4, " . , ;", "zz", "s")] + rows[:5]


@pytest.mark.parametrize("min_count,max_words", [(2, 5), (5, 5), (4, 2), (30, 3), (1, 4)])
def test_collocations(spark, min_count, max_words):
    rows = phrase_rows(random.Random(min_count), 120)
    docs = documents(spark, rows).withColumn("n", F.lit(1)).withColumn("w1", F.lit("x")).repartition(7)
    got = collocations.collocations(docs, min_count=min_count, max_words=max_words, top=25)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain_collocations(rows, min_count, max_words, 25)


def test_products_beyond_64_bits(spark):
    counts = spark.createDataFrame([("en", 10**13, 3 * 10**12, 9 * 10**11, 4 * 10**12)], "lang string, n long, a long, l long, r long")
    score = "(1000 * cast(a as decimal(20, 0)) * cast(n as decimal(20, 0))) div (cast(l as decimal(20, 0)) * cast(r as decimal(20, 0)))"
    assert counts.selectExpr(f"{score} s").first()["s"] == 1000 * 3 * 10**12 * 10**13 // (9 * 10**11 * 4 * 10**12)


def test_no_phrases(spark):
    assert collocations.collocations(documents(spark, [])).count() == 0
    assert collocations.collocations(documents(spark, [(1, "a b c", "en", "s"), (2, None, None, None)])).count() == 0


def test_rare_pairs_shorten_windows_only(spark):
    """Windows stop at rare pairs, and every frequent phrase still has its count."""
    rows = [(i, "one two three " + f"rare{i} four five", "en", "s") for i in range(10)]
    counts = {(r["size"], r["phrase"]): r["f"] for r in collocations.phrase_counts(documents(spark, rows), min_count=10).collect()}
    assert counts == {
        (0, None): 60, **{(1, w): 10 for w in ("one", "two", "three", "four", "five")}, (2, "one two"): 10, (2, "two three"): 10, (2, "four five"): 10, (3, "one two three"): 10,
    }


# --- 13 ------------------------------------------------------------------------------------


def plain_runs(w, min_length=6, exponent=4):
    out, n = [], len(w)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            start, length = i, j - i + q
            if length >= max(min_length, exponent * q) and not any(all(w[t] == w[t + p] for t in range(start, start + length - p)) for p in range(1, q)):
                out.append((start, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def some_words(rng):
    n = rng.choice([0, 1, 5, 6, 7, 8, 12, 33, 90, 200])
    w = [rng.choice("abcdefgh"[: rng.choice([1, 2, 3, 8])]) for _ in range(n)]
    for _ in range(rng.randint(0, 3) if n else 0):
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randint(3, 11)
        for i in range(a, rng.randint(a, n)):
            w[i] = w[a + (i - a) % p]
    return w


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_many_texts_at_once(seed):
    rng = random.Random(seed)
    for _ in range(60):
        texts = [some_words(rng) for _ in range(rng.randint(1, 8))]
        sizes = np.array([len(w) for w in texts])
        codes = np.array([ord(c) for w in texts for c in w], dtype=np.int64)
        got = [tuple(int(x) for x in r) for r in zip(*periodic.word_runs(codes, sizes))] if len(codes) else []
        ends = np.cumsum(sizes) - sizes
        assert got == [(int(e) + s, n, q) for e, w in zip(ends, texts) for s, n, q in plain_runs(w)]


def test_one_long_text_of_periods():
    rng = random.Random(9)
    base = [rng.randrange(50) for _ in range(1_500)]
    w = [rng.randrange(50) for _ in range(700)] + base * 4 + [rng.randrange(9_000) for _ in range(500)] + [7] * 900
    got = [tuple(int(x) for x in r) for r in zip(*periodic.word_runs(np.array(w), np.array([len(w)])))]
    assert (len(w) - 900, 900, 1) in got and any(q == 1_500 and n >= 6_000 for _, n, q in got)


def test_range_successor():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 8, 100):
        values = rng.permutation(n)
        tree = periodic.RangeSuccessor(values)
        low = rng.integers(0, n, 200)
        high = np.minimum(n, low + rng.integers(1, n + 1, 200))
        own = values[low + rng.integers(0, 1 << 30, 200) % (high - low)]
        want = [min((v for v in values[a:b] if v > x), default=-1) for a, b, x in zip(low, high, own)]
        assert tree.after(low, high, own).tolist() == want


def test_runs_of_documents(spark):
    rng = random.Random(4)
    texts = [None, "", " \n ", "a b", "x " * 6, "x " * 5, "é ñ " * 8, "tie tie tie tie tie tie end q q q q q q"] + [" ".join(some_words(rng)) + "\x0b" for _ in range(40)]
    rows = [(rng.choice([i, 5, None]), t, "en", "s") for i, t in enumerate(texts + texts[:3])]
    docs = documents(spark, rows).withColumn("start", F.lit("mine")).withColumn("at", F.monotonically_increasing_id())
    found = {r["at"]: r for r in periodic.periodic_runs(docs).collect()}
    assert set(found[0].asDict()) == {"doc_id", "lang", "source", "n_chars", "at", *periodic.RESULTS.names}
    ordered = [found[k] for k in sorted(found)]
    for (i, text, _, _), r in zip(rows, ordered, strict=True):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        runs = plain_runs(w)
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if runs else (None,) * 3
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        assert (r["doc_id"], r["n_words"], r["n_runs"], [tuple(x) for x in r["runs"]]) == (i, len(w), len(runs), runs)
        assert (r["start"], r["length"], r["period"]) == best
        assert r["collapsed"] == " ".join(x for k, x in enumerate(w) if k not in gone)


def test_strongest_run_is_compared_exactly():
    length, period = np.array([12_000_001, 16_000_002, 40]), np.array([3_000_000, 4_000_001, 10])
    want = max(range(3), key=lambda k: (Fraction(int(length[k]), int(period[k])), -k))
    assert periodic._strongest(np.zeros(3, np.int64), np.arange(3), length, period).tolist() == [want]


def test_query_replaces_words_and_digests(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in queries.table(spark, sf, "documents").collect()}
    rows = queries.LLM_QUERIES["op13_runs"](spark, sf).collect()
    assert len(rows) == len(docs)
    replaced = 0
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", docs[r["doc_id"]] or "")
        h = zlib.crc32(str(r["doc_id"]).encode())
        n, g = len(w), h // 10
        if n > 3_000:
            continue
        if h % 10 == 0 and n:
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            replaced += 1
        runs = plain_runs(w)
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()
        assert r["exponent_milli"] == (1000 * r["length"] // r["period"] if runs else None)
    assert replaced > 5


def test_no_documents_no_runs(spark):
    assert periodic.periodic_runs(documents(spark, [])).count() == 0
    with pytest.raises(ValueError):
        periodic.word_runs(np.zeros(9, np.int64), np.array([9]), min_exponent=3)
