"""Phrase collocations of every language, by counting only the longest windows.

Every word of a piece starts one window of `max_words` words, its own word and the next ones side by side as lead columns,
padded with nulls behind the end of the piece. Windows are counted, and one ROLLUP over their columns sums the counts of
ever shorter prefixes: the sum over (lang, w1, ..., wk) is how often that phrase of k words occurs, and the sum over
(lang) is the number of words. No order is exploded or counted on its own.

A phrase that holds a rare pair of neighbours is rare itself, so windows are padded from the first pair on that stands
fewer than `min_count` times in its language. That changes no count that is asked for, and leaves few different
windows. The frequent pairs are sorted 64-bit hashes in files of the shared folder, which tasks map and search; two pairs
with one hash would only make some windows longer.

A candidate is a phrase of 2 to `max_words` words with at least `min_count` occurrences. Its score is the least over its cuts of
floor(1000 * a * n / (l * r)), computed in whole decimals. It goes where a longer candidate holds it and is
as frequent in percent as `absorbed_at` says; one word more is enough to look at, as counts fall with length.

Defined results: null texts have no words; null languages count as `und`; repeated rows count each time; ties between
scores are told apart by frequency and then by the bytes of the phrase; an empty table, or one without frequent
phrases, gives no rows. Other columns of the caller are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelframe.llm.common import byte_hashes, mix64, new_folder, saved, slices
from duelframe.llm.hash_arrays import FILES, by_range, collect_ranges, file_list, opened, signed, write_file

NO_LANGUAGE = "und"
_ENDS = np.zeros(256, dtype=bool)
_ENDS[list(b".,;:!?\n\x0b\x0c\r")] = True
_GAPS = _ENDS.copy()
_GAPS[list(b" \t")] = True
_FIRST, _SECOND, _LANGUAGE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_HELD_KEYS, _KEYS_A_FILE = 1_500_000, 4_000_000
_SLICE_BYTES = 3 << 20


class _Words:
    """The words of a slice of texts: distinct words, their codes in order, languages, and which word follows in the same piece."""

    def __init__(self, batch: pa.RecordBatch):
        raw = [(t or b"").lower() for t in batch.column("text").cast(pa.binary()).to_pylist()]  # bytes: A-Z only
        codes = np.frombuffer(b"\n".join([*raw, b""]), dtype=np.uint8)
        gap = _GAPS[codes]
        inside = ~gap
        start = np.flatnonzero(inside & np.concatenate([[True], gap[:-1]])) if len(codes) else np.zeros(0, dtype=np.int64)
        length = np.flatnonzero(inside & np.concatenate([gap[1:], [True]])) + 1 - start
        piece = np.cumsum(_ENDS[codes])[start]
        offsets = np.concatenate([[0], np.cumsum(length)])
        letters = np.ascontiguousarray(codes[inside])
        words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
        self.distinct = words.dictionary
        self.code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(np.array([len(r) + 1 for r in raw], dtype=np.int64))
        lang = pc.fill_null(batch.column("lang"), NO_LANGUAGE).dictionary_encode()
        self.languages = lang.dictionary
        sizes = np.diff(np.searchsorted(start, ends), prepend=0)
        self.lang = np.repeat(lang.indices.to_numpy(zero_copy_only=False).astype(np.int64), sizes)
        self.followed = np.zeros(len(start), dtype=bool)
        self.followed[:-1] = piece[1:] == piece[:-1]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of words that have a next one, and hashes of (language, word, next word)."""
        at = np.flatnonzero(self.followed)
        word, lang = (byte_hashes(a.cast(pa.large_binary())) for a in (self.distinct, self.languages))
        return at, mix64(word[self.code[at]] * _FIRST + word[self.code[at + 1]] * _SECOND + lang[self.lang[at]] * _LANGUAGE)


def _count_pairs(batches):
    """Summed (key, n) of the pairs of a task, with about `_HELD_KEYS` keys in memory."""
    held, size = [], 0

    def emit():
        k, c = np.unique(np.concatenate(held), return_counts=True)
        for a in range(0, len(k), 200_000):
            yield pa.RecordBatch.from_arrays([signed(k[a : a + 200_000]), pa.array(c[a : a + 200_000])], names=["key", "n"])

    for batch in slices(batches, "text", _SLICE_BYTES):
        keys = _Words(batch).pairs()[1]
        held.append(keys)
        size += len(keys)
        if size > _HELD_KEYS:
            yield from emit()
            held, size = [], 0
    if held:
        yield from emit()


def frequent_pairs(rows: DataFrame, min_count: int) -> list[tuple[int, int, int, str]]:
    """Files of the sorted hashes of pairs with at least `min_count` occurrences in (lang, text) rows."""
    folder = new_folder(rows.sparkSession, "pairs")
    counted = rows.mapInArrow(_count_pairs, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    often = saved(counted.where(F.col("n") >= min_count), "frequent-pairs")

    def write(batches):
        for p, keys, counts in collect_ranges(batches):
            yield pa.RecordBatch.from_pydict({"part": [p], "low": [int(keys[:1].view(np.int64)[0])], "n": [len(keys)], "path": [write_file(folder, keys, counts)]})

    parts = max(1, -(-often.count() // _KEYS_A_FILE))
    return file_list(saved(by_range(often, parts).mapInArrow(write, FILES), "pair-files"))


def _window_rows(words: _Words, files, max_words: int) -> pa.RecordBatch:
    """Distinct padded windows of a slice with their numbers."""
    n, v = len(words.code), len(words.distinct)
    at, keys = words.pairs()
    distinct, back = np.unique(keys, return_inverse=True)
    linked = np.zeros(n + max_words, dtype=bool)
    linked[at] = (opened(files).find(distinct)[0] >= 0)[back]
    reach, on = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    for k in range(max_words - 1):
        on &= linked[k : k + n]
        reach += on
    # windows of one word are numbers of a word; the others are told apart column by column
    own = words.lang * v + words.code
    alone, times = np.unique(own[reach == 0], return_counts=True)
    long = np.flatnonzero(reach)
    lead = [np.where(reach[long] >= k, words.code[np.minimum(long + k, n - 1)], -1) for k in range(1, max_words)]
    key = own[long]
    for column in lead:
        key = np.unique(key, return_inverse=True)[1] * (v + 1) + column + 1
    _, first, repeats = np.unique(key, return_index=True, return_counts=True)
    texts, names = words.distinct.cast(pa.large_string()).cast(pa.string()), words.languages.cast(pa.string())
    both = np.concatenate([alone, own[long[first]]])
    columns = [names.take(pa.array(both // v if v else both)), texts.take(pa.array(both % v if v else both))]
    for column in lead:
        code = np.concatenate([np.full(len(alone), -1, dtype=np.int64), column[first]])
        columns.append(texts.take(pa.array(code, mask=code < 0)))
    columns.append(pa.array(np.concatenate([times, repeats]).astype(np.int64)))
    return pa.RecordBatch.from_arrays(columns, names=["lang", *(f"w{k}" for k in range(1, max_words + 1)), "n"])


def phrase_counts(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", min_count: int = 100, max_words: int = 5) -> DataFrame:
    """(lang, size, phrase, f): words of a language in all (size 0, no phrase), and every phrase with f >= min_count."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    files = frequent_pairs(rows, min_count)
    lead = [f"w{k}" for k in range(1, max_words + 1)]

    def windows(batches):
        for batch in slices(batches, "text", _SLICE_BYTES):
            yield _window_rows(_Words(batch), files, max_words)

    schema = ", ".join(f"{c} string" for c in ("lang", *lead)) + ", n long"
    longest = rows.mapInArrow(windows, schema).groupBy("lang", *lead).agg(F.sum("n").alias("n"))
    summed = longest.rollup("lang", *lead).agg(F.sum("n").alias("f"), F.grouping_id().alias("rolled"))
    size = F.lit(max_words) - F.length(F.regexp_replace(F.bin("rolled"), "0", ""))
    last = F.coalesce(*(F.when(F.col("size") == k, F.col(c)) for k, c in enumerate(lead, 1)))
    whole = summed.withColumn("size", size.cast("int")).where("size >= 0").where((F.col("size") == 0) | (last.isNotNull() & (F.col("f") >= min_count)))
    return whole.select("lang", "size", F.when(F.col("size") > 0, F.concat_ws(" ", *lead)).alias("phrase"), "f")


def _part(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(
    docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", min_count: int = 100, max_words: int = 5, top: int = 2_000, absorbed_at: int = 100
) -> DataFrame:
    """The `top` phrases of every language: lang, rank, phrase, a, l, r, n, score."""
    counts = saved(phrase_counts(docs, text_col=text_col, lang_col=lang_col, min_count=min_count, max_words=max_words), "phrases")
    phrases = counts.where("size > 0")
    # a row a language, small enough by its measured size to be broadcast, so that no language is one task's
    totals = saved(counts.where("size = 0").select("lang", F.col("f").alias("n")), "phrase-totals")
    candidates = phrases.where("size > 1").select("lang", "phrase", F.col("f").alias("a"), "size", F.split("phrase", " ").alias("words"))

    def looked_up(rows: DataFrame, key: str, name: str) -> DataFrame:
        own = phrases.select("lang", F.col("phrase").alias(key), F.col("f").alias(name))
        return rows.join(own, ["lang", key])

    cuts = candidates.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumn("left", _part(F.col("words"), F.lit(1), F.col("cut"))).withColumn("right", _part(F.col("words"), F.col("cut") + 1, F.col("size") - F.col("cut")))
    cuts = looked_up(looked_up(cuts, "left", "l"), "right", "r").join(totals, "lang")
    score = F.expr("(1000 * cast(a as decimal(20, 0)) * cast(n as decimal(20, 0))) div (cast(l as decimal(20, 0)) * cast(r as decimal(20, 0)))")
    least = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best"))

    longer = candidates.where("size > 2")
    shorter = F.array(_part(F.col("words"), F.lit(1), F.col("size") - 1), _part(F.col("words"), F.lit(2), F.col("size") - 1))
    around = longer.select("lang", F.explode(shorter).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    kept = least.join(around, ["lang", "phrase"], "left").where(F.col("around").isNull() | (100 * F.col("around") < absorbed_at * F.col("a")))

    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    flat = kept.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
    ranked = flat.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
