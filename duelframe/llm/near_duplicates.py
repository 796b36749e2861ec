"""MinHash near-duplicates with tensored banding.

Two collections of short keys are made from few min-hashes: `m` keys of `k` min-hashes each. Every pair of a key of the
first and a key of the second collection is a table key, so m * m tables cost 2 * m * k min-hashes instead
of 2 * m * m * k. Documents that share a table key are candidates, and candidates are confirmed on their full shingle sets.

Rows with equal shingle sets are one class from the start. Every bucket has a pivot, and a pivot's bucket mates are its
family. Each member is compared with the pivot and with the member next to the pivot. Members that are in
different components after that are compared as well, unless their sizes, the triangle inequality of the Jaccard
distance or bitmaps of their differences from the middle rule a link out. So groups of copies cost two comparisons a member, and no candidate pair is left open.

With k = 3 and m = 14, a pair at similarity 0.8 shares no key with probability 9e-5, at 0.85 with 7e-6.

Defined results: null texts and texts without words have no shingles and are linked with nothing; with fewer words
than a shingle, the whole sequence is the one shingle; rows of one id are one node of the graph, linked if one of
them is, and keep a row each; null ids keep a row each, without links; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelframe.llm.common import mix64, saved, slices, word_hashes
from duelframe.llm.graph import components
from duelframe.llm.set_files import DIFFERENCE_WORDS, shared_sizes, wanted_ids, write_sets

SHINGLE_WORDS = 5
SIMILARITY = 80
KEYS, HASHES_A_KEY = 14, 3
_SLICE_BYTES = 1 << 20
_BLOCK = 4096
_MULTIPLY = np.random.default_rng(41).integers(1, 1 << 62, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[str], n_words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    words, sizes = word_hashes(texts)
    out = []
    for start, m in zip((np.cumsum(sizes) - sizes).tolist(), sizes.tolist()):
        if m == 0:
            out.append(np.zeros(0, dtype=np.uint64))
            continue
        own = words[start : start + m]
        width = min(n_words, m)
        h = own[: m - width + 1].copy()
        for j in range(1, width):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + own[j : m - width + 1 + j])
        out.append(np.unique(h + np.uint64(width)))
    return out


def table_keys(shingles: np.ndarray, keys: int, per_key: int) -> np.ndarray:
    """The keys * keys table keys of a set that is not empty."""
    n_hashes = 2 * keys * per_key
    least = np.full(n_hashes, np.iinfo(np.uint64).max, dtype=np.uint64)
    factors = _MULTIPLY[:n_hashes, None]
    for begin in range(0, len(shingles), _BLOCK):
        h = shingles[None, begin : begin + _BLOCK] * factors
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x94D049BB133111EB)
        np.minimum(least, h.min(axis=1), out=least)
    small = np.zeros(2 * keys, dtype=np.uint64)
    for j in range(per_key):
        small = mix64(small * np.uint64(31) + least[j::per_key])
    first = mix64(small[:keys] + np.arange(keys, dtype=np.uint64))
    second = mix64(small[keys:] + np.arange(keys, 2 * keys, dtype=np.uint64))
    return mix64(first[:, None] * np.uint64(3) + second[None, :]).ravel()


def _shingled(docs: DataFrame, id_col: str, text_col: str, n_words: int, keys: int, per_key: int) -> DataFrame:
    """One row per document: id, n_shingles, set hash and table keys."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        for batch in slices(batches, "text", _SLICE_BYTES):
            sets = shingle_sets(batch.column("text").to_pylist(), n_words)
            found = [table_keys(s, keys, per_key) if len(s) else s for s in sets]
            ends = pa.array(np.cumsum([0, *(len(f) for f in found)]), pa.int32())
            whole = [int(mix64(s).sum(dtype=np.uint64).view(np.int64)) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(whole, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found).view(np.int64)))],
                names=["id", "n_shingles", "set_hash", "keys"],
            )

    return rows.mapInArrow(run, "id long, n_shingles long, set_hash long, keys array<long>")


def _similar() -> Column:
    return F.col("met") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("met")) * SIMILARITY


def _reach(n_a: Column, n_b: Column) -> Column:
    """Whether sets of these sizes can be similar enough at all."""
    return F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * SIMILARITY


def _distance() -> Column:
    """Jaccard distance, which obeys the triangle inequality."""
    return F.lit(1.0) - F.col("met") / F.greatest(F.lit(1), F.col("n_a") + F.col("n_b") - F.col("met"))


def _may_overlap(words: list[str]) -> Column:
    """Whether two sets can be similar enough, by their differences from a third one.

    The sets differ by apart_a + apart_b less twice what their differences share, and that is at most the number
    of common bits of the bitmaps and what collided in the smaller surplus of hashes over bits.
    """
    common = sum((F.bit_count(F.col(f"{w}_a").bitwiseAND(F.col(f"{w}_b"))) for w in words), F.lit(0))
    most = common + F.least(F.col("apart_a") - F.col("bits_a"), F.col("apart_b") - F.col("bits_b"))
    whole = F.lit(100 + SIMILARITY)
    return (F.col("apart_a") + F.col("apart_b") - 2 * most) * whole <= (F.col("n_a") + F.col("n_b")) * (100 - SIMILARITY)


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    n_words: int = SHINGLE_WORDS,
    keys: int = KEYS,
    per_key: int = HASHES_A_KEY,
) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest id that links reach), kept."""
    known = docs.where(F.col(id_col).isNotNull())
    shingled = saved(_shingled(known, id_col, text_col, n_words, keys, per_key), "shingled")
    # equal sets are one class, named by its smallest id
    classes = shingled.where("n_shingles > 0").groupBy("set_hash", "n_shingles").agg(F.min("id").alias("class"))
    heads = shingled.join(classes.select(F.col("class").alias("id")), "id", "left_semi").select("id", F.explode("keys").alias("key"))
    # the pivot of a bucket: its first member in an order that all buckets share, so that pivots repeat
    first = F.min(F.struct(F.xxhash64("id").alias("order"), F.col("id").alias("id"))).over(Window.partitionBy("key"))
    placed = heads.select("key", "id", first.alias("pivot")).where(F.col("pivot.id") != F.col("id"))
    # a family is a pivot with all that share a bucket with it; every two mates of a bucket are in its family
    family = saved(placed.select(F.col("pivot.id").alias("pivot"), "id").distinct(), "families")
    named = family.select(F.col("pivot").alias("id")).union(family.select("id")).distinct()
    texts = known.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    places = write_sets(texts, wanted_ids(named, "wanted"), lambda t: shingle_sets(t, n_words), "sets")

    def compare(pairs: DataFrame, label: str, **more) -> DataFrame:
        return saved(shared_sizes(pairs, places, **more).select("*", _similar().alias("linked"), _distance().alias("far")), label)

    star = compare(family.select(F.col("pivot").alias("a"), F.col("id").alias("b")), "star")
    # the member next to the pivot stands for the middle of the family: compared with everyone
    middle = star.groupBy("a").agg(F.min_by("b", F.struct("far", "b")).alias("middle"))
    around = star.join(middle, "a").where(F.col("b") != F.col("middle")).select(F.col("a").alias("pivot"), F.col("middle").alias("a"), "b")
    second = compare(around, "second-star", differences=True)
    links = star.where("linked").select("a", "b").union(second.where("linked").select("a", "b"))
    joined = components(links)
    # what both left open: family members in different components that no bound parts
    label = joined.select(F.col("node").alias("id"), "component")
    away_from_middle = (F.col("n_a") + F.col("n_b") - 2 * F.col("met")).alias("apart")
    words = [f"d_{k}" for k in range(DIFFERENCE_WORDS)]
    by_middle = second.select(F.col("pivot").alias("a"), "b", F.col("far").alias("far_2"), away_from_middle, "bits", *words)
    inner = star.join(by_middle, ["a", "b"], "left")
    # only the middle itself has no second distance: it is nowhere apart from itself
    members = inner.select(
        F.col("a").alias("pivot"), F.col("b").alias("id"), F.col("n_b").alias("n"), "far",
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("far_2", "apart", "bits", *words)),
    )
    labelled = members.join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = labelled.groupBy("pivot", "component").agg(F.count(F.lit(1)).alias("members"))
    main = sizes.groupBy("pivot").agg(F.max_by("component", F.struct("members", "component")).alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    mixed = saved(labelled.join(main.select("pivot", "main"), "pivot"), "mixed-families")
    away = mixed.where("component <> main")
    one, two = (df.select("pivot", *(F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "far", "far_2", "component", "main", "apart", "bits", *words))) for df, s in ((away, "a"), (mixed, "b")))
    bound = (100 - SIMILARITY) / 100 + 1e-9
    open_pairs = (
        one.join(two, "pivot")
        .where(
            (F.col("component_a") != F.col("component_b"))
            & ((F.col("component_b") == F.col("main_b")) | (F.col("id_a") < F.col("id_b")))
            & _reach(F.col("n_a"), F.col("n_b"))
            & (F.abs(F.col("far_a") - F.col("far_b")) <= bound)
            & (F.abs(F.col("far_2_a") - F.col("far_2_b")) <= bound)
            & _may_overlap(words)
        )
        .select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))
        .distinct()
    )
    more = compare(open_pairs, "open-pairs").where("linked").select("a", "b")
    if more.limit(1).count():
        joined = components(links.union(more))
    result = (
        shingled.join(classes, ["set_hash", "n_shingles"], "left")
        .join(joined.select(F.col("node").alias("class"), "component"), "class", "left")
        .select("id", "n_shingles", F.coalesce("component", "class", "id").alias("component_id"))
    )
    merged = saved(result, "components")
    named = merged.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
    nameless = _shingled(docs.where(F.col(id_col).isNull()), id_col, text_col, n_words, keys, per_key)
    return named.union(nameless.select("id", "n_shingles", F.col("id"), F.lit(True)))
