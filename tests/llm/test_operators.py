"""Each operator against plain Python on small tables: nulls, empty and long texts, ties, repeated rows, clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from duelframe.llm import bitplanes, decontaminate, langid, language_model, near_duplicates, pieces, quality, queries, repeats, secrets, syncmers
from duelframe.llm.graph import components
from duelframe.llm.suffixes import common_prefixes, doubling_suffix_array

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["the", "of", "and", "ration", "Blehe", "stone", "éclair", "ñu", "thing", "wh"]


def documents(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(rng, n):
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "re", "ble", "st"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [prose(rng, rng.randint(1, 120)) for _ in range(40)]
    line = prose(rng, 14)
    near = base[3].split()
    near[5:6] = ["changed"]
    long = prose(rng, 6_000)
    return [None, "", " \n\t", "one", *base, base[0], base[0], base[1].upper(), " ".join(near), line + ". " + base[7], base[8] + " " + line + ". ", long, long + " end", "x" * 30_000]


# --- 1 -------------------------------------------------------------------------------------


def secret_base(text):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


SECRET_TEXTS = [
    None, "", "é password: \"abcdefgh1\" and TOKEN='x' api_key=12345678", "token=token=abcdefgh", "password:secret:abcdefgh123", "AKIAAKIA123 AKIA1234567890AB",
    "ab" * 16 + " " + "0" * 31, "secret = " + "deadbeef" * 5, "tokentokentoken=12345678", "ñ" * 50 + "passwd=  \"A.b-c_d=e/\"", "apikey=12345678" * 40,
]


def test_secret_forms(spark):
    df = documents(spark, SECRET_TEXTS + SECRET_TEXTS)
    for row, text in zip(secrets.digest(secrets.secret_spans(df)).orderBy("doc_id").collect(), SECRET_TEXTS * 2):
        want = secret_base(text or "")
        kinds = Counter(s.split(":")[0] for s in want.split(",") if s)
        assert (row["n_assign"], row["n_access"], row["n_hex"]) == (kinds["assign"], kinds["access"], kinds["hex"])
        assert row["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert ",".join(s for s in row["spans"].split(",") if not s.startswith("entropy")) == want


def window_ranges(text, rule=secrets.EntropyRule()):
    """Windows judged from scratch."""
    out = []
    for i in range(len(text) - rule.window + 1):
        w = text[i : i + rule.window]
        bits = -sum(c / len(w) * math.log2(c / len(w)) for c in Counter(w).values())
        digits = sum(c.isdigit() for c in w)
        hexadecimal = all(c in "0123456789abcdefABCDEF" for c in w)
        bad = (hexadecimal and bits >= rule.hex_bits and 3 <= digits <= rule.window - 3) or (not hexadecimal and bits >= rule.mixed_bits and digits >= 2 and digits + 4 <= rule.window)
        if bad and out and out[-1][1] >= i:
            out[-1][1] = i + rule.window
        elif bad:
            out.append([i, i + rule.window])
    return [tuple(x) for x in out]


def test_entropy_windows_by_increments(spark):
    rng = random.Random(2)
    alphabets = ["0123456789abcdef", "ABCDEFabcdefghijklmnopqrstuvwxyz0123456789+/_-", "aaab1", "thern12"]
    cases = ["".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(20, 90))) for _ in range(60)]
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    for row in df.select("c", secrets.window_spans(F.col("c"), secrets.EntropyRule()).alias("s")).collect():
        assert [tuple(s) for s in row["s"]] == window_ranges(row["c"])


def test_entropy_adds_and_allow_list_suppresses(spark):
    secret, plain = "q9Zk3vT7xW2mB8nR4jL6", ["550e8400-e29b-41d4-a716-446655440000", "the-quick-brown-fox-jumps", "2023-01-02-03-04-05-06", "Donaudampfschifffahrtsgesellschaft"]
    df = documents(spark, [f"see {secret} here", " ".join(plain), "token=" + secret])
    rows = [r["spans"] for r in secrets.digest(secrets.secret_spans(df)).orderBy("doc_id").collect()]
    assert rows == ["entropy:4:24", "", "assign:0:26"]
    shown = [r["text"] for r in secrets.redact(documents(spark, [f"é {secret}!", None, "token=abcdefgh password=12345678 AKIA1234567890AB"])).orderBy("doc_id").collect()]
    assert shown == ["é [SECRET]!", None, "[SECRET] [SECRET] [SECRET]"]


# --- 2 -------------------------------------------------------------------------------------


def kneser_ney(train, asked):
    tokens = lambda t: (t or "").encode().lower().split() + [b"\n"]
    count, pair = Counter(), Counter()
    for t in train:
        own = tokens(t)
        count.update(own)
        pair.update(zip([b"\n", *own], own))
    n, v = sum(count.values()), len(count)
    seen, after, left = Counter(), Counter(), defaultdict(lambda: [0, 0, 0])
    for (a, b), k in pair.items():
        seen[b] += 1
        after[a] += k
        left[a][min(k, 3) - 1] += 1
    of = lambda values: language_model.discounts(*(sum(x == k for x in values) for k in (1, 2, 3, 4)))
    dp, dw, kinds = of(list(pair.values())), of(list(seen.values())), max(1, len(pair))
    rest = sum(dw[min(x, 3) - 1] for x in seen.values()) / kinds

    def word(w):
        if not v:
            return 1.0
        return (seen[w] - dw[min(seen[w], 3) - 1] if seen[w] else 0) / kinds + rest / (v + 1)

    def both(a, w):
        if a not in after:
            return word(w)
        k = pair[a, w]
        return (k - dp[min(k, 3) - 1] if k else 0) / after[a] + sum(d * m for d, m in zip(dp, left[a])) / after[a] * word(w)

    for t in asked:
        own = tokens(t)
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        yield len(own), sum(count[w] > 0 for w in own), n, base, sum(math.log10(both(a, w)) for a, w in zip([b"\n", *own], own))


@pytest.mark.parametrize("empty", [False, True])
def test_language_model(spark, texts, empty):
    train = [] if empty else texts[:30] + texts[:4]
    model = language_model.fit(documents(spark, train))
    got = language_model.score_texts(documents(spark, texts), model).orderBy("doc_id").collect()
    for row, want in zip(got, kneser_ney(train, texts)):
        assert tuple(row)[1:4] == want[:3]
        assert row["base_score"] == pytest.approx(want[3], abs=1e-9) and row["score"] == pytest.approx(want[4], abs=1e-9)


# --- 3 -------------------------------------------------------------------------------------


def test_quality_learns_and_handles_odd_rows(spark):
    rng = random.Random(1)
    good = [prose(rng, 80) for _ in range(150)]
    bad = [" ".join([w + "***" for w in prose(rng, 60).split()]) for _ in range(75)] + ["spam " * 80 for _ in range(75)]
    texts = good + bad + [None, ""]
    labels = spark.createDataFrame([(i, int(i < 150), "x") for i in range(300)] + [(None, 1, "x"), (301, None, "x")], "doc_id long, quality int, text string")
    rows = quality.quality_scores(documents(spark, texts), labels).collect()
    assert len(rows) == 302 and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] < 300]
    assert sum(r["predicted"] == int(r["doc_id"] < 150) for r in held) >= 0.95 * len(held)
    none = quality.quality_scores(documents(spark, texts[:3]), labels.where("false")).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality.quality_scores(documents(spark, []), labels).count() == 0


def test_isotonic():
    x, y = quality.isotonic(np.array([0.0, 1, 2, 3]), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert (np.diff(y) >= 0).all() and np.interp(1.5, x, y) == 0.5


# --- 4 -------------------------------------------------------------------------------------


def near_classes(texts, n):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    label = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    return [len(s) for s in sets], label


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates(spark, texts, n):
    rng = random.Random(9)
    base = prose(rng, 120).split()
    family = []
    for _ in range(25):
        copy = list(base)
        for _ in range(rng.randint(0, 12)):
            copy[rng.randrange(len(copy))] = prose(rng, 1)
        family.append(" ".join(copy))
    every = texts + family
    sizes, label = near_classes(every, n)
    rows = near_duplicates.near_duplicates(documents(spark, every), n_words=n).orderBy("doc_id").collect()
    assert [(r["n_shingles"], r["component_id"], r["kept"]) for r in rows] == [(s, c, c == i) for i, (s, c) in enumerate(zip(sizes, label))]


def test_near_duplicates_null_and_repeated_ids(spark):
    df = documents(spark, ["a b c d e f", "a b c d e f", "x y", None], ids=[7, 7, None, 3])
    rows = sorted(near_duplicates.near_duplicates(df).collect(), key=str)
    assert [(r["doc_id"], r["component_id"], r["kept"]) for r in rows] == [(3, 3, True), (7, 7, True), (7, 7, True), (None, None, True)]
    assert near_duplicates.near_duplicates(documents(spark, [])).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100)], "a long, b long")
    assert {r["node"]: r["component"] for r in components(links).collect()} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


# --- 5 -------------------------------------------------------------------------------------


def test_language_profiles(spark):
    rng = random.Random(4)
    make = {"en": ["the ", "and ", "of ", "ing ", "th"], "fr": ["le ", "é", "que ", "eau ", "les "], "de": ["der ", "sch", "ung ", "ü", "ein "]}
    rows = [(i, "".join(rng.choice(make[lang]) for _ in range(80)), lang) for i, lang in enumerate(["en", "fr", "de"] * 40)]
    rows += [(500, None, "en"), (501, "", None), (502, "123 !!", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = langid.learn_profiles(df.where(~langid.is_held_out(F.col("doc_id"))))
    got = {r["doc_id"]: r for r in langid.predict_language(df, profiles).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows[:120])
    assert [(got[i]["lang_pred"], got[i]["score"]) for i in (500, 501, 502)] == [("und", 0.0)] * 3
    assert {r["lang_pred"] for r in langid.predict_language(df, {}).collect()} == {"und"}
    counts = Counter()
    for _, text, lang in rows:
        if text and lang:
            counts.update((lang, g) for g in langid.grams(text).tolist())
    assert {(r["lang"], r["gram"]): r["n"] for r in langid.gram_counts(df).collect()} == counts


# --- 6 -------------------------------------------------------------------------------------


def test_edited_texts_and_fingerprints(spark, texts):
    rows = {r["doc_id"]: r for r in syncmers.edited_fingerprints(documents(spark, texts)).collect()}
    order = sorted(range(len(texts)), reverse=True)
    for place, i in enumerate(order):
        own, follow = texts[i] or "", texts[order[(place + 1) % len(order)]] or ""
        edited = own[: len(own) - len(own) // 2] + follow[: len(own) // 2]
        assert rows[i]["n_chars"] == len(own) and rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= rows[i]["near_edited"] <= 1 and 0 <= rows[i]["near_next"] <= 1
    same = defaultdict(set)
    for i, t in enumerate(texts):
        same[t or ""].add(rows[i]["fingerprint"])
    assert all(len(f) == 1 for f in same.values())
    assert rows[50 - 4]["near_edited"] > rows[50 - 4]["near_next"]


def test_fingerprints_with_null_and_repeated_ids(spark):
    df = documents(spark, ["a b c", "d e f", "g", None], ids=[5, 5, None, 1])
    rows = syncmers.edited_fingerprints(df).collect()
    assert Counter(r["doc_id"] for r in rows) == {5: 2, None: 1, 1: 1}
    assert syncmers.edited_fingerprints(documents(spark, [])).count() == 0


def test_syncmers_are_context_free(spark):
    rng = random.Random(8)
    middle = prose(rng, 60)
    df = documents(spark, [prose(rng, 40) + " " + middle + " " + prose(rng, 30), prose(rng, 10) + " " + middle])
    a, b = (r["anchors"] for r in syncmers.fingerprints(df).orderBy("doc_id").collect())
    assert len(set(a) & set(b)) >= 8
    pair = spark.createDataFrame([(1, a, b)], "doc_id int, a array<int>, b array<int>")
    best = syncmers.position_matches(pair, "a", "b").first()
    assert best["agree"] >= 8 and best["shift"] < 0


# --- 7 -------------------------------------------------------------------------------------


def contaminated(texts, items, n=13):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for k, t in items:
        w = split(t)
        for i in range(max(1, len(w) - n + 1)) if w else ():
            windows[tuple(w[i : i + n])].add(k)
    for t in texts:
        w, hit, met = split(t), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if own := windows.get(tuple(w[i : i + size])):
                    hit |= set(range(i, i + size))
                    met |= own
        yield len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(map(str, met))).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def test_decontamination(spark, texts):
    rng = random.Random(11)
    items = [(10, texts[6]), (9, "Short item; here"), (2, None), (3, "..."), (100, prose(rng, 20)), (101, " ".join(texts[50].split()[40:70])), (11, texts[6])]
    every = [*texts, "xx short ITEM-here xx", items[4][1] + " " + prose(rng, 400), prose(rng, 5) + " " + items[4][1].upper()]
    frame = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    rows = decontaminate.digest(decontaminate.contamination(documents(spark, every), frame)).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in rows] == list(contaminated(every, items))


def smallest_intervals(text, items, slack, n):
    """Every interval judged from scratch."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, found = split(text), Counter()
    for own in {tuple(x[i : i + n]) for x in map(split, items) if x for i in range(max(1, len(x) - n + 1))}:
        whole = lambda a, b: set(own) <= set(w[a : b + 1])
        for a in range(len(w)):
            for b in range(a, min(len(w), a + len(own) + slack)):
                if whole(a, b) and not whole(a + 1, b) and not whole(a, b - 1):
                    found[a, b] += 1
    return sum(found.values())


def test_proximity_matches_are_all_found(spark):
    rng = random.Random(13)
    items = ["a b c", "d e d f", "solo", None, "g h i j k", "missing a"]
    far = ["b", *"vwxyz", *["a"], *"vwxyz", "b", "c"]  # the nearest b stands on the wrong side
    every = [" ".join(far[0:1] + far[1:5] + far[6:]), "c x b x a", "a x x x x x x x x b c", None, "", "solo Solo. a b"]
    every += [" ".join(rng.choice("aabbbcdefghijkxyz") for _ in range(rng.randint(1, 150))) for _ in range(40)]
    frame = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for length, slack in ((3, 5), (13, 2)):
        rows = decontaminate.digest(decontaminate.contamination(documents(spark, every), frame, length=length, slack=slack)).orderBy("doc_id").collect()
        assert [r["n_near"] for r in rows] == [smallest_intervals(t, items, slack, length) for t in every]


def test_decontamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    rows = decontaminate.digest(decontaminate.contamination(documents(spark, ["a b", None], ids=[None, None]), none)).collect()
    assert sorted((r["n_words"], r["n_hit"], r["contaminated"]) for r in rows) == [(0, 0, False), (2, 0, False)]
    assert decontaminate.contamination(documents(spark, []), none).count() == 0


# --- 8 -------------------------------------------------------------------------------------


def without_repeats(texts, n=50):
    first = {}
    for t in texts:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        doc = len(first.setdefault("docs", []))
        first["docs"].append(doc)
        for i in range(len(raw) - n + 1):
            if first.setdefault(raw[i : i + n], doc) < doc:
                gone[i : i + n] = b"\1" * n
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        yield len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest()


def test_repeats(spark, texts):
    rng = random.Random(3)
    passage = prose(rng, 40)
    more = [prose(rng, rng.randint(3, 40)) + passage[rng.randint(0, 60) : rng.randint(90, 200)] + prose(rng, rng.randint(3, 40)) for _ in range(30)]
    every = texts + more + ["a" * 49, "a" * 50, "a" * 51, "ab" * 200, "é" * 60]
    rows = repeats.remove_repeats(documents(spark, every)).orderBy("doc_id").collect()
    assert [tuple(r)[1:5] for r in rows] == list(without_repeats(every))


def test_repeats_with_null_and_repeated_ids(spark):
    text = prose(random.Random(1), 30)
    rows = repeats.remove_repeats(documents(spark, [text, text, text, text], ids=[2, 2, None, 9])).collect()
    assert sorted((str(r["doc_id"]), r["n_removed"] > 0) for r in rows) == [("2", False), ("2", False), ("9", True), ("None", True)]
    assert repeats.remove_repeats(documents(spark, [])).count() == 0


def test_hot_anchors_are_dealt_by_string(spark, texts):
    rng = random.Random(17)
    core = prose(rng, 20)
    every = [prose(rng, 12) + core[:45] + prose(rng, 12) for _ in range(60)]  # shared anchors, neighbours differ
    every += [prose(rng, 12) + core[:60] + prose(rng, 12) for _ in range(30)] + ["x" * 400 + prose(rng, 5) for _ in range(10)] + texts
    ids = [*range(len(every) - 3), 5, 5, None]
    rows = repeats.remove_repeats(documents(spark, every), hot_runs=8).orderBy("doc_id").collect()
    assert [tuple(r)[1:5] for r in rows] == list(without_repeats(every))
    odd = documents(spark, every, ids=ids)
    least, raw = {}, [((t or "").encode(), 1 << 62 if k is None else k) for t, k in zip(every, ids)]
    for text, rank in raw:
        for i in range(len(text) - 49):
            least[text[i : i + 50]] = min(rank, least.get(text[i : i + 50], rank))
    want = []
    for k, (text, rank) in zip(ids, raw):
        gone = {p for i in range(len(text) - 49) if least[text[i : i + 50]] < rank for p in range(i, i + 50)}
        want.append((str(k), len(text), len(gone)))
    got = [(str(r["doc_id"]), r["n_bytes"], r["n_removed"]) for r in repeats.remove_repeats(odd, hot_runs=8).collect()]
    assert sorted(got) == sorted(want)
    alone = documents(spark, every[:60]).selectExpr("doc_id key", "doc_id rank", "text")
    most = [repeats._dealt_runs(alone, repeats.repeated_anchors(alone, 50, 2), 50, n).groupBy("anchor").count().agg({"count": "max"}).first()[0] for n in (8, 1000)]
    assert most[0] <= 8 and most[1] >= 30


@pytest.mark.parametrize("size", [1, 2, 3, 40, 2_000])
@pytest.mark.parametrize("letters", [1, 2, 5])
def test_suffix_array_and_common_prefixes(size, letters):
    raw = bytes(random.Random(size).choice(b"abcde"[:letters]) for _ in range(size))
    codes = np.frombuffer(raw, dtype=np.uint8).astype(np.int64)
    order = doubling_suffix_array(codes, size + 1)
    want = sorted(range(size), key=lambda i: raw[i:])
    assert order.tolist() == want
    def shared(a, b):
        k = 0
        while k < 50 and a + k < size and b + k < size and raw[a + k] == raw[b + k]:
            k += 1
        return k

    assert common_prefixes(codes, order, 50).tolist() == [0, *(shared(a, b) for a, b in zip(want, want[1:]))]


def test_large_anchors_are_cut_and_merged(monkeypatch):
    monkeypatch.setattr(repeats, "_SHARD_BYTES", 200)
    rng = random.Random(6)
    core = prose(rng, 12).encode()
    rows = [(1, k, k, 0, prose(rng, 6).encode() + core + prose(rng, 6).encode()) for k in range(20)]
    hit = defaultdict(set)
    for batch in repeats._ranges(rows, 50):
        for key, a, b in zip(*(batch.column(c).to_pylist() for c in ("key", "start", "stop"))):
            hit[key] |= set(range(a, b))
    first = {}
    for _, key, _, _, text in rows:
        want = set()
        for i in range(len(text) - 49):
            if first.setdefault(text[i : i + 50], key) < key:
                want |= set(range(i, i + 50))
        assert hit[key] == want


# --- 9 -------------------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_planes_round_trip(kind):
    for n in (0, 1, 7, 8, 1000):
        ids = np.random.default_rng(n).integers(0, 1 << 32 if n < 100 else 50_000, n, dtype=np.uint32)
        assert bitplanes.from_planes(bitplanes.to_planes(ids, kind), n, kind).tolist() == ids.tolist()


def test_token_files(spark, texts):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("words")
    tokenizer = Tokenizer.from_file(path)
    every = [*texts, "a|b <|endoftext|> don't  İ\r\nx　y"]
    manifest = bitplanes.write_token_files(documents(spark, every), path, planes="bit", block_ids=100)
    rows = bitplanes.read_token_files(manifest, with_ids=True).orderBy("doc_id").collect()
    start = 0
    for row, text in zip(rows, every, strict=True):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        assert (row["start"], row["n_tokens"], row["ids"], row["ids_crc32"]) == (start, len(ids), ids, zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert bitplanes.read_token_files(bitplanes.write_token_files(documents(spark, []), path)).count() == 0


# --- 10 ------------------------------------------------------------------------------------


def test_pieces_are_the_library_s(spark, texts):
    import sentencepiece

    path = queries.tokenizer_path("pieces")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = ["  a  b ", " ", "a\nb\tc", "ﬁ Å", "▁x", "<s>", "x\0y", "日本語", "<0x41>", "🙂 x🙂", "aaaa" * 100, "é" * 70]
    every = [*texts, *odd]
    df = documents(spark, every).withColumn("tokens", F.lit(1))
    rows = pieces.encode_texts(df, path, decoded_col="decoded", round_trip_col="same").orderBy("doc_id").collect()
    for row, text in zip(rows, every, strict=True):
        ids = model.encode(text or "")
        assert row["ids"] == ids and row["decoded"] == model.decode(ids) and row["same"] == (row["decoded"] == (text or ""))
        assert row["tokens"] == 1
    again = pieces.decode_ids(spark.createDataFrame([(rows[5]["ids"],), (None,)], "ids array<int>"), path).collect()
    assert [r["decoded"] for r in again] == [rows[5]["decoded"], None]
    with pytest.raises(ValueError):
        pieces.encode_texts(df.withColumn("ids", F.lit(1)), path)
    assert pieces.encode_texts(documents(spark, []), path).count() == 0
