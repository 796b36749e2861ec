"""Identity, suggestions and the strict as-of join on literal tables."""

import random
from datetime import date, timedelta
from difflib import get_close_matches

import pytest
from pyspark.sql import functions as F

from duelframe.functions.skew import hot_key_hashes, salted_lookup
from duelframe.functions.text import class_label, display_label, id_key, name_key, simple_name_key
from duelframe.functions.values import experience_band, iso_date, probability_band
from duelframe.operators import asof, identity, suggest
from duelframe.operators.serving import redact_ids


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column("v").alias("r")).first()["r"]


@pytest.mark.parametrize("text, key", [
    ("José  Aldo-Jr.", "jose aldo jr"), ("Straße", "strasse"), ("ﬁve", "five"), ("Łukasz", "ukasz"), ("Ｆｕｌｌ", "full"), ("--", ""), ("A B", "a b"),
])
def test_name_key(spark, text, key):
    assert one(spark, text, name_key) == key


def test_simple_name_key_keeps_punctuation(spark):
    assert one(spark, " Jo  O'Neil-ẞ ", simple_name_key) == "jo o'neil-ss"


@pytest.mark.parametrize("text, key", [
    (" http://x/y/ABCDEF0123456789// ", "abcdef0123456789"), ("ABCDEF012345678", "ABCDEF012345678"), ("Keep Case/", "Keep Case"), (" / ", None),
])
def test_id_key(spark, text, key):
    assert one(spark, text, id_key) == key


@pytest.mark.parametrize("text, day", [("2024-02-30", None), (" 2024-02-29T10:00", date(2024, 2, 29)), ("20240229", date(2024, 2, 29)), ("", None), ("x", None)])
def test_iso_date(spark, text, day):
    assert one(spark, text, iso_date) == day


@pytest.mark.parametrize("text, label", [("UFC Interim Women's_Flyweight Title Bout", "interim womens flyweight title"), ("  catch_weight ", "catch weight")])
def test_class_label(spark, text, label):
    # " interim " needs a space on both sides when its turn comes
    got = one(spark, text, class_label)
    want = text.strip().replace("_", " ").casefold().replace("'", "")
    for noise in ("ufc ", " interim ", " title ", " tournament ", " superfight ", " bout"):
        want = want.replace(noise, " ")
    assert got == " ".join(want.split())


def test_display_label(spark):
    df = spark.createDataFrame([("m_fly",), ("some_new-code",), (None,), ("ko/tko",)], "v string")
    got = [r["r"] for r in df.select(display_label("v", "division").alias("r")).collect()]
    assert got == ["Male Flyweight", "Some New Code", "Unknown", "KO/TKO"]


def test_bands(spark):
    df = spark.createDataFrame([(0.0,), (2.0,), (2.5,), (5.0,), (11.0,), (-1.0,), (float("nan"),), (None,)], "v double")
    got = [r["r"] for r in df.select(experience_band("v").alias("r")).collect()]
    assert got == ["debut", "1_to_2", "11_plus", "3_to_5", "11_plus", None, None, None]
    df = spark.createDataFrame([(0.5,), (0.6,), (0.4,), (0.25,), (0.2,), (1.0,), (1.1,)], "v double")
    got = [r["r"] for r in df.select(probability_band("v").alias("r")).collect()]
    assert got == ["0.50_to_0.60", "0.60_to_0.70", "0.60_to_0.70", "0.70_to_0.80", "0.80_plus", "0.80_plus", None]


PEOPLE = [("u1", "Ann Lee", None), ("u2", "Bob Ray", "The Ray"), ("u3", "Ann  Lee", ""), ("u4", "Zoë Q", None)]


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(PEOPLE, "fighter_id string, fighter_name string, display_name string")


def test_resolution(spark, people):
    index, ids = identity.search_index(people), identity.entity_ids(people)
    asked = [("ann lee", None), ("the RAY", None), ("zoe q", None), ("u1", None), ("nobody", None), (" ", None),
             ("ann lee", "u3"), ("ann lee", "u2"), ("nobody", "u2"), ("u1", "u2"), ("bob ray", "zzz")]
    df = spark.createDataFrame(asked, "query string, explicit_id string")
    got = {(r["query"], r["explicit_id"]): (r["entity_id"], r["error_code"]) for r in identity.resolve(df, index, ids, explicit_id="explicit_id").collect()}
    assert got == {
        ("ann lee", None): (None, "ambiguous"), ("the RAY", None): ("u2", None), ("zoe q", None): ("u4", None), ("u1", None): ("u1", None),
        ("nobody", None): (None, "not_found"), (" ", None): (None, "invalid_query"), ("ann lee", "u3"): ("u3", None),
        ("ann lee", "u2"): (None, "identity_mismatch"), ("nobody", "u2"): ("u2", None), ("u1", "u2"): (None, "identity_mismatch"),
        ("bob ray", "zzz"): (None, "not_found"),
    }


def test_aliases(spark, people):
    index, ids = identity.search_index(people), identity.entity_ids(people)
    aliases = spark.createDataFrame([("The Boss", "u1"), ("The Boss", "u2"), ("Solo", "u4"), ("Solo2", "nope")], "alias string, target string")
    both = identity.add_aliases(index, aliases, ids)
    out = {r["query"]: r["status"] for r in identity.lookup(spark.createDataFrame([("the boss",), ("solo",), ("solo2",)], "query string"), both, ids).collect()}
    assert out == {"the boss": "ambiguous", "solo": "resolved", "solo2": "not_found"}
    assert {r["finding"] for r in identity.alias_findings(aliases, ids).collect()} == {"unknown_target"}


def test_suggestions_match_brute_force(spark):
    rng = random.Random(5)
    letters = "abcdeinorst "
    keys = sorted({" ".join("".join(rng.choices(letters, k=rng.randint(1, 12))).split()) for _ in range(160)} - {""})
    keys += ["supplier 000000%03d" % i for i in range(12)]
    queries = sorted({k[:-1] + rng.choice("xyzab") for k in keys[::3]} | {"a", "ab", "zzzz", "supplier 00000"})
    index = spark.createDataFrame([(k, f"id{i % 50:02d}") for i, k in enumerate(keys)], "name_key string, entity_id string")
    got = {}
    near = suggest.close_keys(spark.createDataFrame([(q,) for q in queries], "name_key string"), index)
    for r in near.orderBy("query_key", "key_rank").collect():
        got.setdefault(r["query_key"], []).append(r["name_key"])
    for query in queries:
        assert got.get(query, []) == get_close_matches(query, sorted(set(keys)), n=10, cutoff=0.65), query
    ids = {}
    for k, i in ((r["name_key"], r["entity_id"]) for r in index.collect()):
        ids.setdefault(k, set()).add(i)
    listed = {}
    for r in suggest.suggestions(spark.createDataFrame([(q,) for q in queries], "name_key string"), index).orderBy("query_key", "suggestion_rank").collect():
        listed.setdefault(r["query_key"], []).append(r["entity_id"])
    for query in queries:
        want = []
        for key in get_close_matches(query, sorted(set(keys)), n=10, cutoff=0.65):
            for i in sorted(ids[key]):
                if i not in want:
                    want.append(i)
        assert listed.get(query, []) == want[:5], query


SNAPS = [
    ("e1", "2024-01-01", 1.0), ("e1", "2024-01-05", 2.0), ("e1", "2024-01-09", 3.0), ("e2", "2024-01-05", 4.0), ("e2", "2024-01-05", 5.0),
    ("e2", "2024-01-08", 6.0), ("e3", None, 7.0),
]


def test_strict_asof_edges(spark):
    snaps = spark.createDataFrame(SNAPS, "entity_id string, d string, v double").withColumn("as_of", F.to_date("d"))
    asked = [
        (1, "e1", "2024-01-05"), (2, "e1", "2024-01-06"), (3, "e1", "2024-01-01"), (4, "e2", "2024-01-06"), (5, "e2", "2024-01-09"),
        (6, "e3", "2024-01-09"), (7, "e9", "2024-01-09"), (8, None, "2024-01-09"), (9, "e1", "2024-01-05"),
    ]
    req = spark.createDataFrame(asked, "request_id int, entity_id string, r string").withColumn("ref_date", F.to_date("r"))
    for spread in ([], ["request_id"]):
        out = asof.strict_asof(req, snaps, spread_by=spread)
        got = {r["request_id"]: (r["snapshot_status"], r["snapshot"]["v"] if r["snapshot"] else None) for r in out.collect()}
        assert got == {
            1: ("ok", 1.0), 2: ("ok", 2.0), 3: ("snapshot_unavailable", None), 4: ("duplicate_snapshot", None), 5: ("ok", 6.0),
            6: ("snapshot_unavailable", None), 7: ("not_found", None), 8: ("not_found", None), 9: ("ok", 1.0),
        }


def test_asof_matches_brute_force_with_a_hot_entity(spark):
    rng = random.Random(3)
    start = date(2024, 1, 1)
    snaps = sorted({(rng.choice(["hot", "hot", f"e{rng.randint(0, 9)}"]), start + timedelta(days=rng.randint(0, 60))) for _ in range(200)})
    reqs = [(i, rng.choice(["hot", "hot", f"e{rng.randint(0, 11)}"]), start + timedelta(days=rng.randint(0, 70))) for i in range(600)]
    out = asof.strict_asof(
        spark.createDataFrame(reqs, "request_id int, entity_id string, ref_date date"),
        spark.createDataFrame(snaps, "entity_id string, as_of date"), spread_by=["request_id"],
    )
    got = {r["request_id"]: r["snapshot"]["as_of"] if r["snapshot"] else None for r in out.collect()}
    for i, entity, day in reqs:
        earlier = [d for e, d in snaps if e == entity and d < day]
        assert got[i] == (max(earlier) if earlier else None)


def test_salted_lookup_equals_plain_join(spark):
    left = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50).alias("k"))
    right = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    hot = hot_key_hashes(left, ["k"], share=0.1)
    assert len(hot) == 1
    salted = salted_lookup(left, right, ["k"], spread_by=["id"], hot=hot, salts=5)
    plain = left.join(right, "k", "left")
    assert sorted(map(tuple, salted.select("id", "k", "v").collect()), key=str) == sorted(map(tuple, plain.select("id", "k", "v").collect()), key=str)


def test_refresh_edges(spark):
    rows = [("2024-01-10", "2024-01-10", None, 30.0), ("2024-01-10", None, None, None), ("2024-01-10", "2000-01-10", "2023-01-09", 1.0), ("2024-01-10", "2000-01-10", "2024-01-11", 1.0)]
    df = spark.createDataFrame(rows, "r string, b string, l string, age double").selectExpr("date(r) r", "date(b) b", "date(l) l", "age")
    values = asof.refreshed_values(F.col("r"), dob=F.col("b"), last_event=F.col("l"), stored_age=F.col("age"), activity={"feature_activity_365d": F.lit(4.0), "feature_activity_730d": F.lit(5.0)})
    got = df.select(*[v.alias(k) for k, v in values.items()]).collect()
    assert [r["refresh_error"] for r in got] == ["birth_not_before_reference", "age_missing", None, "event_after_reference"]
    assert (got[2]["feature_activity_365d"], got[2]["feature_activity_730d"]) == (0.0, 5.0)
    assert got[2]["layoff_days"] == 366 and got[1]["layoff_days"] is None


@pytest.mark.parametrize("cutoff", [0.1, 0.3, 0.5, 0.72, 0.95])
def test_close_keys_at_any_cutoff(spark, cutoff):
    from difflib import SequenceMatcher

    rng = random.Random(int(cutoff * 100))
    names = sorted({"".join(rng.choice("abcxy") for _ in range(rng.randint(1, 6))) for _ in range(60)} | {"a", "abc", "axy"})
    frame = spark.createDataFrame([(n,) for n in names], "name_key string")
    got = {(r["query_key"], r["name_key"]) for r in suggest.close_keys(frame, frame, cutoff=cutoff, limit=1_000).collect()}
    want = {(q, n) for q in names for n in names if SequenceMatcher(None, n, q).ratio() >= cutoff}
    assert got == want


def test_cutoff_must_be_a_share(spark):
    frame = spark.createDataFrame([("a",)], "name_key string")
    with pytest.raises(ValueError):
        suggest.close_keys(frame, frame, cutoff=0.0)


def test_class_label_folds_case(spark):
    assert one(spark, "Straße Bout", class_label) == "strasse"


def test_asof_windows_are_narrow_and_fetch_late(spark):
    """Windows see ids, days and counts; unasked entities are dropped first; wide rows are fetched for chosen days only."""
    from duelframe.operators.asof import strict_asof

    snaps = spark.range(5_000).select(
        (F.col("id") % 500).cast("string").alias("entity_id"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 37).cast("int")).alias("as_of"),
        F.sha2(F.col("id").cast("string"), 512).alias("feature_wide"),
    )
    asked = spark.createDataFrame([("7", "2020-02-20"), ("7", "2020-01-01"), ("nobody", "2020-03-01")], "entity_id string, ref_date string")
    out = strict_asof(asked, snaps, spread_by=["ref_date"])
    plan = out._jdf.queryExecution().sparkPlan().toString()
    windows = [line for line in plan.splitlines() if "Window " in line or "SortAggregate" in line]
    assert windows and not any("feature_wide" in line or "SortAggregate" in line for line in windows)
    per_day = plan[plan.index("Window "):]
    assert per_day.index("HashAggregate") < per_day.index("LeftSemi")
    got = {(r["entity_id"], r["ref_date"]): (r["snapshot_status"], r["snapshot"] and str(r["snapshot"]["as_of"])) for r in out.collect()}
    days = sorted(r["as_of"] for r in snaps.where("entity_id = '7'").select("as_of").collect())
    assert got[("7", "2020-02-20")] == ("ok", str(days[-1])) and got[("nobody", "2020-03-01")][0] == "not_found" and got[("7", "2020-01-01")][0] == "snapshot_unavailable"


def test_repeated_ids_and_keys_do_not_break_redaction(spark):
    known, lost = "0123456789abcdef", "fedcba9876543210"
    messages = spark.createDataFrame([(1, f"a {known}"), (1, f"b {known}, {lost}"), (2, known.upper())], "k int, m string")
    names = spark.createDataFrame([(1, known, " "), (1, known, "Zoe"), (2, known, "Ann")], "k int, entity_id string, display_name string")
    got = {(r["k"], r["safe_message"]) for r in redact_ids(messages, names.drop("k"), key="k", message="m").collect()}
    assert got == {(1, "a Ann"), (1, "b Ann, Unknown Fighter"), (2, "Ann")}
    own = {(r["k"], r["safe_message"]) for r in redact_ids(messages, names, key="k", message="m", own_names=True).collect()}
    assert own == {(1, "a Zoe"), (1, "b Zoe, Unknown Fighter"), (2, "Ann")}


def test_high_cutoffs_first_give_the_same_close_keys(spark):
    rng = random.Random(8)
    keys = sorted({f"supplier {rng.randrange(400):09d}" for _ in range(150)} | {f"the supplier {rng.randrange(400):09d}" for _ in range(60)} | {"blue anvil", "x" * 80, "red bolt"})
    queries = sorted({k + "zz" for k in keys[::4]} | {f"the supplier {i:09d}" for i in range(0, 400, 23)} | {"blue anvils", "x" * 79 + "y", "x" * 65, "q"})
    asked, index = (spark.createDataFrame([(k,) for k in x], "name_key string") for x in (queries, keys))
    got = {}
    for r in suggest.close_keys(asked, index, many=1).orderBy("query_key", "key_rank").collect():
        got.setdefault(r["query_key"], []).append(r["name_key"])
    for query in queries:
        assert got.get(query, []) == get_close_matches(query, keys, n=10, cutoff=0.65), query


def test_bound_of_the_ratio_rules_most_pairs_out():
    import numpy as np
    from difflib import SequenceMatcher

    rng = random.Random(4)
    names = ["".join(rng.choice("abcé0") for _ in range(rng.randint(0, 70))) for _ in range(120)]
    pairs = [(rng.randrange(120), rng.randrange(120)) for _ in range(800)]
    most, total = suggest._matched_at_most([names[a] for a, _ in pairs], names, np.array([b for _, b in pairs]))
    assert all(2 * m >= SequenceMatcher(None, names[a], names[b]).ratio() * t - 1e-9 for (a, b), m, t in zip(pairs, most, total))
    # the same letters in another order: the bags are equal, the ratio cannot reach 0.9
    most, total = suggest._matched_at_most(["supplier 000004321"], ["supplier 000001234"], np.array([0]))
    assert list(most) == [15] and list(total) == [36]


def test_tokens_are_made_of_distinct_keys(spark):
    """Repeated keys are counted first; the optimizer would otherwise make tokens of every row."""
    keys = spark.range(20).select(F.concat(F.lit("name "), (F.col("id") % 3).cast("string")).alias("name_key"))
    near = suggest.close_keys(keys, keys)
    assert {(r["query_key"], r["name_key"]) for r in near.collect()} == {(f"name {a}", f"name {b}") for a in range(3) for b in range(3)}
    lines = near._jdf.queryExecution().optimizedPlan().toString().splitlines()
    for leaf in (i for i, line in enumerate(lines) if "Range (" in line):
        top = max(i for i in range(leaf) if "Aggregate [name_key" in lines[i])
        assert not any("instr(" in line for line in lines[top + 1:leaf])
