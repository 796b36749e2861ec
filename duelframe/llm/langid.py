"""Language of a document by rank-order profiles.

A profile is the list of the most frequent letter n-grams (one to three letters, word ends marked) of a
language, most frequent first. A document's own list is held against each profile: the distance is the
sum, over the document's n-grams, of how far out of place each one is, and the length of a profile for one
that is not there. The nearest profile is the language.

Defined results: null texts and texts without a letter are `und` with score 0; equal counts are ordered by
n-gram, equal distances by language name; without profiles every document is `und`; repeated rows get
equal answers; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelframe.llm.common import slices

PROFILE_LENGTH = 400
UNKNOWN = "und"
_CHUNK_CHARS = 1 << 20
_HELD_GRAMS = 1 << 20
_LETTERS: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Code point + 2 for letters, 1 (a word end) for everything else."""
    global _LETTERS
    if _LETTERS is None:
        codes = np.arange(0x110000, dtype=np.int64)
        letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
        _LETTERS = np.where(letter, codes + 2, 1)
    return _LETTERS


def grams(text: str) -> np.ndarray:
    """All n-grams of a text as integers; empty without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    marks = _letters()[codes]
    padded = np.concatenate([[1], marks, [1]])
    keep = np.ones(len(padded), dtype=bool)
    keep[1:] = (padded[1:] != 1) | (padded[:-1] != 1)
    row = padded[keep]
    if len(row) < 3:
        return np.zeros(0, dtype=np.int64)
    pairs = (row[:-1] << 21) | row[1:]
    return np.concatenate([row[row != 1], pairs, (pairs[:-1] << 21) | row[2:]])


def _tally(found: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, place = np.unique(np.concatenate(found), return_inverse=True)
    return keys, np.bincount(place, weights=np.concatenate(counts)).astype(np.int64)


def gram_counts(docs: DataFrame, *, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Occurrences of every n-gram in every language, over all rows with a language."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches):
        held: dict[str, tuple[list, list]] = {}
        size = 0
        for batch in slices(batches, "text", _CHUNK_CHARS):
            by_lang: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                by_lang.setdefault(lang, []).append(grams(text))
            for lang, parts in by_lang.items():
                keys, n = np.unique(np.concatenate(parts), return_counts=True)
                held.setdefault(lang, ([], []))
                held[lang][0].append(keys)
                held[lang][1].append(n)
                size += len(keys)
            if size > _HELD_GRAMS:
                held = {lang: tuple([x] for x in _tally(*parts)) for lang, parts in held.items()}
                size = sum(len(parts[0][0]) for parts in held.values())
                if size > _HELD_GRAMS // 2:
                    yield from _rows(held)
                    held, size = {}, 0
        yield from _rows(held)

    def _rows(held):
        for lang, parts in held.items():
            keys, n = _tally(*parts)
            for a in range(0, len(keys), 50_000):
                k = keys[a : a + 50_000]
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(k), "gram": k, "n": n[a : a + 50_000]})

    return rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn_profiles(docs: DataFrame, *, lang_col: str = "lang", text_col: str = "text", length: int = PROFILE_LENGTH) -> dict[str, np.ndarray]:
    """Most frequent n-grams of each language. What reaches the driver is `length` numbers a language."""
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = gram_counts(docs, lang_col=lang_col, text_col=text_col).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= length)
    profiles: dict[str, list[tuple[int, int]]] = {}
    for row in top.select("lang", "rank", "gram").collect():
        profiles.setdefault(row["lang"], []).append((row["rank"], row["gram"]))
    return {lang: np.array([g for _, g in sorted(found)], dtype=np.int64) for lang, found in sorted(profiles.items())}


def distances(text: str, index: tuple[np.ndarray, np.ndarray], length: int) -> np.ndarray | None:
    """Out-of-place distance to every profile as a share of the largest one; None without a letter."""
    found = grams(text)
    if not len(found):
        return None
    keys, n = np.unique(found, return_counts=True)
    top = keys[np.lexsort((keys, -n))[:length]]
    all_grams, ranks = index
    if not len(all_grams):
        return None
    place = np.minimum(np.searchsorted(all_grams, top), len(all_grams) - 1)
    there = all_grams[place] == top
    away = np.where(there[:, None], np.abs(ranks[place] - np.arange(len(top))[:, None]), length)
    return np.minimum(away, length).sum(axis=0) / (len(top) * length)


def profile_index(profiles: dict[str, np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted n-grams of all profiles and their rank in each one (far away where it is absent)."""
    all_grams = np.unique(np.concatenate(list(profiles.values()))) if profiles else np.zeros(0, np.int64)
    ranks = np.full((len(all_grams), len(profiles)), 4 * length, dtype=np.int64)
    for k, found in enumerate(profiles.values()):
        ranks[np.searchsorted(all_grams, found), k] = np.arange(len(found))
    return all_grams, ranks


def predict_language(
    docs: DataFrame,
    profiles: dict[str, np.ndarray],
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = PROFILE_LENGTH,
) -> DataFrame:
    """doc_id, lang_pred and score (1 less the share of the largest distance) of every row."""
    names, index = list(profiles), profile_index(profiles, length)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches):
        for batch in slices(batches, "text", _CHUNK_CHARS):
            langs, scores = [], []
            for text in batch.column("text").to_pylist():
                away = distances(text, index, length) if text else None
                k = None if away is None else int(away.argmin())
                langs.append(UNKNOWN if k is None else names[k])
                scores.append(0.0 if k is None else float(1.0 - away[k]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def is_held_out(id_column: Column) -> Column:
    """Rows that profiles are not learnt from: crc32 of the id as text leaves 2 when divided by 4."""
    from duelframe.llm.common import remainder

    return remainder(id_column, 4) == 2
