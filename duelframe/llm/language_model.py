"""Interpolated modified Kneser-Ney model of word pairs.

Words and pairs are counted in Spark. Both become sorted arrays of 64-bit hashes with aligned counts, one
file for each range of hashes, in the shared folder. Scoring tasks map these files into memory and look up
a block of texts at a time by binary search of sorted hashes, so a worker holds only the pages it touches.
No hash table of the corpus is ever in the driver: it sees four counts of counts and the list of files.

    p(w | v) = max(c(v w) - D(c), 0) / c(v) + g(v) p(w),   g(v): what the discounts left in context v
    p(w)     = max(k(w) - D'(k), 0) / K + g' / (V + 1),    k(w): in how many contexts w was seen

The end of a text is a token, and also the context of the first word. Words never seen share the last
term. Defined results: null text counts as empty, that is one end token; null ids learn and score like
others; repeated rows count each time; without training rows V = N = 0 and every token has probability 1.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelframe.llm.common import file_system, new_folder, saved, slices, width, word_hashes
from duelframe.llm.hash_arrays import FILES, SLICE_BYTES, SortedArrays, by_range, collect_ranges, count_rows, file_list, opened, write_file

_END = np.uint64(0x5851F42D4C957F2D)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_UNMIX = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PAIRS_A_PART = 4_000_000


def hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of the texts in order, an end token after each text, and each text's number of tokens."""
    words, sizes = word_hashes(texts)
    sizes = sizes + 1
    flat = np.empty(len(words) + len(sizes), dtype=np.uint64)
    ends = np.cumsum(sizes) - 1
    inner = np.ones(len(flat), dtype=bool)
    inner[ends] = False
    flat[inner], flat[ends] = words, _END
    return flat, sizes


def contexts(ids: np.ndarray, sizes: np.ndarray, end: int) -> np.ndarray:
    """Id of the token before each token; the end token before the first one of a text."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[np.cumsum(sizes) - sizes] = end
    return before


def pair_keys(before: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """One-to-one hash of (context id, word id), spread evenly over 64 bits."""
    return ((before.astype(np.uint64) << np.uint64(32)) | ids.astype(np.uint64)) * _MIX


def _parts_for(rows: float) -> int:
    return int(max(1, -(-rows // _PAIRS_A_PART)))


@dataclass(frozen=True)
class Model:
    """Files of the model, sizes, and discounts."""

    words: list[tuple[int, int, int, str]]
    pairs: list[tuple[int, int, int, str]]
    tables: list[tuple[int, str]]
    ids_a_part: int
    n_tokens: int
    n_words: int
    n_pairs: int
    discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    word_left: float


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from counts of counts; fixed ones where a count of counts is missing."""
    if min(n1, n2, n3) == 0:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(float(min(max(d, 0.05), k + 0.95)) for k, d in enumerate(found))


def fit(docs: DataFrame, *, text_col: str = "text") -> Model:
    """Count all rows and write the model to the shared folder."""
    spark = docs.sparkSession
    folder = new_folder(spark, "language-model")
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = width(spark)

    def write_words(batches):
        for p, keys, counts in collect_ranges(batches):
            yield pa.RecordBatch.from_pydict(
                {"part": [p], "low": [int(keys[:1].view(np.int64)[0])], "n": [len(keys)], "path": [write_file(folder, keys, counts)], "total": [int(counts.sum())]}
            )

    counted = rows.mapInArrow(count_rows(lambda texts: np.unique(hashes(texts)[0], return_counts=True)), "key long, n int")
    manifest = saved(by_range(counted, parts).mapInArrow(write_words, FILES + ", total long"), "lm-words")
    words = file_list(manifest)
    n_words = sum(f[2] for f in words)
    n_tokens = int(manifest.agg(F.sum("total")).first()[0] or 0)
    if n_words >= 1 << 32:
        raise ValueError("more than 2**32 distinct words")
    pair_parts = max(parts, _parts_for(n_tokens))

    def pairs_of(texts):
        store = opened(words)
        return np.unique(_pair_hashes(store, texts), return_counts=True)

    def write_pairs(batches):
        for p, keys, counts in collect_ranges(batches):
            yield _stats(p, keys, counts, write_file(folder, keys, counts))
            yield from _partials(p, keys, counts)

    schema = FILES + ", id long, total long, n1 long, n2 long, n3 long, seen long, ones long, twos long, threes long, fours long"
    paired = by_range(rows.mapInArrow(count_rows(pairs_of), "key long, n int"), pair_parts)
    found = saved(paired.mapInArrow(write_pairs, schema), "lm-pairs")
    pairs = file_list(found)
    moments = found.where("path is not null").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("ones", "twos", "threes", "fours"))).first()

    # what each word was as a context and as a continuation, one row a word, in id order within ranges
    ids_a_part = max(1, -(-n_words // parts))
    by_word = (
        found.where("id is not null")
        .groupBy("id")
        .agg(*(F.sum(c).alias(c) for c in ("total", "n1", "n2", "n3", "seen")))
        .withColumn("part", F.floor(F.col("id") / ids_a_part).cast("int"))
    )
    by_word = saved(by_word, "lm-by-word")
    kinds = {**{f"k{k}": F.col("seen") == k for k in (1, 2, 3, 4)}, "more": F.col("seen") >= 3}
    seen = by_word.agg(*(F.coalesce(F.sum(kind.cast("long")), F.lit(0)).alias(name) for name, kind in kinds.items())).first()
    word_discounts = discounts(*(int(seen[f"k{k}"]) for k in (1, 2, 3, 4)))
    n_pairs = max(1, sum(f[2] for f in pairs))
    left = sum(d * int(seen[name]) for d, name in zip(word_discounts, ("k1", "k2", "more"))) / n_pairs

    def write_table(batches):
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            part = batch.column("part").to_numpy(zero_copy_only=False)
            values = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "total", "n1", "n2", "n3", "seen")], axis=1)
            for p in np.unique(part):
                held.setdefault(int(p), []).append(values[part == p])
        for p, parts_ in held.items():
            values = np.concatenate(parts_)
            values = values[np.argsort(values[:, 0])]
            dense = np.zeros((min(ids_a_part, n_words - p * ids_a_part), 5), dtype="<i8")
            dense[values[:, 0] - p * ids_a_part] = values[:, 1:]
            system, place = file_system(folder)
            name = f"{uuid.uuid4().hex}.words"
            with system.open_output_stream(f"{place}/{name}") as out:
                out.write(dense)
            yield pa.RecordBatch.from_pydict({"part": [p], "path": [f"{folder}/{name}"]})

    tables = saved(by_word.repartition(parts, "part").mapInArrow(write_table, "part long, path string"), "lm-tables")
    pair_discounts = discounts(*(int(moments[c]) for c in ("ones", "twos", "threes", "fours")))
    ordered = sorted((r["part"], r["path"]) for r in tables.collect())
    return Model(words, pairs, ordered, ids_a_part, n_tokens, n_words, n_pairs, pair_discounts, word_discounts, left)


_COLUMNS = ("part", "low", "n", "path", "id", "total", "n1", "n2", "n3", "seen", "ones", "twos", "threes", "fours")


def _batch(rows: int, **columns) -> pa.RecordBatch:
    kinds = {"path": pa.string()}
    arrays = [columns[c] if c in columns else pa.nulls(rows, kinds.get(c, pa.int64())) for c in _COLUMNS]
    return pa.RecordBatch.from_arrays(arrays, names=list(_COLUMNS))


def _stats(part: int, keys: np.ndarray, counts: np.ndarray, path: str) -> pa.RecordBatch:
    """The file of a range, and how many pairs were seen once, twice, three and four times."""
    of = {name: pa.array([int((counts == k).sum())]) for k, name in enumerate(("ones", "twos", "threes", "fours"), 1)}
    return _batch(1, part=pa.array([part]), low=pa.array([int(keys[:1].view(np.int64)[0])]), n=pa.array([len(keys)]), path=pa.array([path]), **of)


def _partials(part: int, keys: np.ndarray, counts: np.ndarray):
    """Sums of this range for every word as a context and as a continuation."""
    both = keys * _UNMIX
    before, after = (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
    order = np.argsort(before, kind="stable")
    ids, first = np.unique(before[order], return_index=True)
    c = counts[order]
    sums = [np.add.reduceat(x.astype(np.int64), first) for x in (c, c == 1, c == 2, c >= 3)]
    words, seen = np.unique(after, return_counts=True)
    for a in range(0, len(ids), 200_000):
        own = slice(a, a + 200_000)
        named = dict(zip(("total", "n1", "n2", "n3"), (pa.array(s[own]) for s in sums)))
        yield _batch(len(ids[own]), id=pa.array(ids[own]), **named)
    for a in range(0, len(words), 200_000):
        own = slice(a, a + 200_000)
        yield _batch(len(words[own]), id=pa.array(words[own]), seen=pa.array(seen[own].astype(np.int64)))


def _word_ids(store: SortedArrays, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Id of each token (-1: unknown) and its count."""
    keys, place = np.unique(flat, return_inverse=True)
    ids, counts = store.find(keys)
    return ids[place], counts[place]


def _pair_hashes(store: SortedArrays, texts: list[str]) -> np.ndarray:
    flat, sizes = hashes(texts)
    ids, _ = _word_ids(store, flat)
    end = int(ids[np.cumsum(sizes)[0] - 1])
    return pair_keys(contexts(ids, sizes, end), ids)


class _Tables:
    """Context and continuation sums of words by id, mapped into memory."""

    def __init__(self, model: Model):
        self.model, self.maps = model, {}

    def get(self, ids: np.ndarray) -> np.ndarray:
        """Rows (total, n1, n2, n3, seen) of sorted ids; zeros for -1."""
        out = np.zeros((len(ids), 5), dtype=np.int64)
        known = np.flatnonzero(ids >= 0)  # their order is that of the hashes
        ids_a_part = self.model.ids_a_part
        part = ids[known] // ids_a_part
        for p, path in self.model.tables:
            a, b = np.searchsorted(part, [p, p + 1])
            if a == b:
                continue
            if p not in self.maps:
                system, place = file_system(path)
                if system.type_name == "local":
                    self.maps[p] = np.memmap(place, dtype="<i8", mode="r").reshape(-1, 5)
                else:
                    with system.open_input_file(place) as source:
                        self.maps[p] = np.frombuffer(source.read(), dtype="<i8").reshape(-1, 5)
            own = known[a:b]
            out[own] = self.maps[p][ids[own] - p * ids_a_part]
        return out


def score_texts(
    docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row's whole text (log10)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches):
        tables = _Tables(model)
        for batch in slices(batches, "text", SLICE_BYTES):
            found = _score_block(model, tables, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x) for x in found)], names=names)

    names = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _score_block(model: Model, tables: _Tables, texts: list[str]):
    flat, sizes = hashes(texts)
    keys, place = np.unique(flat, return_inverse=True)
    ids, counts = opened(model.words).find(keys)
    sums = tables.get(ids)  # hash order is id order
    total, n1, n2, n3, seen = sums.T.astype(np.float64)
    d1, d2, d3 = model.word_discounts
    # word level
    discount = np.select([seen >= 3, seen == 2, seen == 1], [d3, d2, d1], 0.0)
    p_word = np.maximum(seen - discount, 0.0) / model.n_pairs + model.word_left / (model.n_words + 1) if model.n_words else np.full(len(keys), 1.0)
    b1, b2, b3 = model.discounts
    gamma = np.where(total > 0, (b1 * n1 + b2 * n2 + b3 * n3) / np.maximum(total, 1.0), 1.0)
    # pair level
    before = contexts(place, sizes, int(np.searchsorted(keys, _END)))
    both_known = (ids[before] >= 0) & (ids[place] >= 0)
    c_pair = np.zeros(len(flat))
    if both_known.any():
        pairs, where = np.unique(pair_keys(ids[before[both_known]], ids[place[both_known]]), return_inverse=True)
        c_pair[both_known] = opened(model.pairs).find(pairs)[1][where]
    cut = np.select([c_pair >= 3, c_pair == 2, c_pair == 1], [b3, b2, b1], 0.0)
    p = np.maximum(c_pair - cut, 0.0) / np.maximum(total[before], 1.0) + gamma[before] * p_word[place]
    base = np.log10((counts + 0.5) / (model.n_tokens + 0.5 * (model.n_words + 1)))
    first = np.cumsum(sizes) - sizes
    add = np.add.reduceat
    known = add((counts[place] > 0).astype(np.int64), first)
    train = np.full(len(sizes), model.n_tokens, dtype=np.int64)
    return sizes, known, train, add(base[place], first), add(np.log10(p), first)
