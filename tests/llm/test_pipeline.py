"""The stages of the pipeline on planted rows against plain Python: which rows stay, what is masked, which ids come out."""

import random

import corpus_pipeline
from duelframe.llm import queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string"


def prose(rng, n):
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "re", "ble", "st"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def shingles(text, n=5):
    w = (text or "").encode().lower().decode().split()
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def planted():
    rng = random.Random(8)
    clean = [prose(rng, rng.randint(30, 80)) for _ in range(12)]
    item = prose(rng, 20)
    near = clean[0].split()
    near[3] = "changed"
    near = " ".join(near)
    hit = prose(rng, 20) + " " + item
    secret = "token=abcdefgh " + prose(rng, 40)
    texts = [*clean, near, clean[1], clean[1], hit, hit, secret, None, ""]
    return texts, item


def run_from_second(spark, monkeypatch, texts, ids, item):
    rows = [(i, t, "en", "s", len(t or ""), "own") for i, t in zip(ids, texts)]
    docs = spark.createDataFrame(rows, DOCS)
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    monkeypatch.setattr(corpus_pipeline, "table", lambda spark, sf, name: items)
    for name, stage in corpus_pipeline.STAGES[1:]:
        docs = corpus_pipeline.saved(stage(spark, docs, ""), f"test-{name}")
    return docs.collect()


def test_rows_that_stay(spark, monkeypatch):
    import sentencepiece

    texts, item = planted()
    ids = list(range(len(texts)))
    rows = {r["doc_id"]: r for r in run_from_second(spark, monkeypatch, texts, ids, item)}
    kept = []
    for i, t in enumerate(texts):
        own = shingles(t)
        if not any(own and shingles(texts[k]) and 100 * len(own & shingles(texts[k])) >= 80 * len(own | shingles(texts[k])) for k in range(i)):
            kept.append(i)
    kept = [i for i in kept if item not in (texts[i] or "")]
    assert sorted(rows) == kept and 12 in range(len(texts)) and len(kept) < len(texts) - 4
    model = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("pieces"))
    for i in kept:
        shown = texts[i] and texts[i].replace("token=abcdefgh", "[SECRET]")
        assert rows[i]["text"] == shown and rows[i]["ids"] == model.encode(shown or "")
        assert rows[i]["n_chars"] == (None if shown is None else len(shown))


def test_rows_are_decided_by_themselves(spark, monkeypatch):
    """Null and repeated ids: one of each group stays, contaminated rows go with any id, clean rows stay beside them."""
    texts, item = planted()
    ids = [None] * len(texts)
    ids[0] = ids[15] = 7  # a clean row and a contaminated one
    got = [r["text"] for r in run_from_second(spark, monkeypatch, texts, ids, item)]
    assert not any(item in (t or "") for t in got)
    assert sum(t in (texts[0], texts[12]) for t in got) == 1 and got.count(texts[1]) == 1
    assert len(got) == 12 + 1 + 2  # clean texts, the one with a secret, null and empty


def test_nothing_stays_nothing(spark, monkeypatch):
    assert run_from_second(spark, monkeypatch, [], [], "a b c") == []


def test_contaminated_rows_go_without_python(spark, monkeypatch, capsys):
    """Decontamination is DataFrame operations only: its plan, and every step that it writes, run no Python."""
    texts, item = planted()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "own") for i, t in enumerate(texts)], DOCS)
    docs = corpus_pipeline.saved(docs, "test-documents")
    items = corpus_pipeline.saved(spark.createDataFrame([(1, item)], "item_id long, text string"), "test-items")
    monkeypatch.setattr(corpus_pipeline, "table", lambda spark, sf, name: items)
    monkeypatch.setattr(type(docs), "mapInArrow", lambda *a, **k: (_ for _ in ()).throw(AssertionError("mapInArrow")))
    left = corpus_pipeline.drop_contaminated(spark, docs, "")
    left.explain()
    plan = capsys.readouterr().out
    assert "Physical Plan" in plan and not [k for k in ("Python", "Pandas", "Arrow") if k in plan]
    assert sorted(r["doc_id"] for r in left.collect()) == [i for i, t in enumerate(texts) if item not in (t or "")]
    assert left.columns == docs.columns
