"""Document fingerprints from closed syncmers of words.

A k-mer is k consecutive words; its inner substrings are its single words (s = 1), ordered by hash. The k-mer is
a closed syncmer if its smallest inner substring lies at one of its edges. Whether a k-mer is chosen depends on
its own words alone, so equal passages give equal anchors wherever they stand, and about two of k - s + 1
k-mers are chosen. Both ends of a text are padded by end marks, which count as largest, so that short texts have anchors too.

A fingerprint is the list of anchor hashes in text order, eight hexadecimal digits each; the likeness of two
fingerprints is the share of distinct anchors that both have. Only built-in functions are used, row by row.

Defined results: null texts count as empty; a text without words has the empty fingerprint; the likeness of two
empty fingerprints is 1, of an empty and another one 0; equal texts have equal fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelframe.llm.common import bound, keyed, saved

KMER_WORDS = 8
_END = (1 << 63) - 1


def anchors(text: Column, k: int = KMER_WORDS) -> Column:
    """Anchor hashes (32 bits) of a text in order, as an array of integers."""
    pad = F.array_repeat(F.lit(_END).cast("long"), k - 1)

    def chosen(row):
        kmers = F.transform(F.sequence(F.lit(1), F.size(row) - k + 1), lambda i: F.slice(row, i, F.lit(k)))
        at_edge = F.filter(kmers, lambda m: F.array_min(m) == F.least(F.get(m, F.lit(0)), F.get(m, F.lit(k - 1))))
        # a text without words is all padding
        return F.transform(F.filter(at_edge, lambda m: F.array_min(m) < _END), lambda m: F.shiftright(F.xxhash64(m), 32).cast("int"))

    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return bound(F.concat(pad, F.transform(words, lambda w: F.xxhash64(w)), pad), chosen)


def fingerprint(anchor: Column) -> Column:
    """Anchors as text, eight hexadecimal digits each."""
    return F.array_join(F.transform(anchor, lambda a: F.lpad(F.hex(a.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of the distinct anchors of both that both have."""
    both, every = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(every == 0, F.lit(1.0)).otherwise(both / every)


def position_matches(rows: DataFrame, a: str, b: str, *, id_col: str = "doc_id") -> DataFrame:
    """Per row: the shift between places of equal anchors on which most anchors agree, and how many do."""
    left = rows.select(id_col, F.posexplode(a).alias("at_a", "anchor"))
    right = rows.select(id_col, F.posexplode(b).alias("at_b", "anchor"))
    shifts = left.join(right, [id_col, "anchor"]).groupBy(id_col, (F.col("at_b") - F.col("at_a")).alias("shift")).agg(F.count(F.lit(1)).alias("agree"))
    return shifts.groupBy(id_col).agg(F.max(F.struct("agree", (-F.abs("shift")).alias("near"), "shift")).alias("best")).select(id_col, "best.shift", "best.agree")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = KMER_WORDS) -> DataFrame:
    """Every row with its anchors and fingerprint."""
    found = docs.withColumn("anchors", anchors(F.coalesce(F.col(text_col), F.lit("")), k))
    return found.withColumn("fingerprint", fingerprint(F.col("anchors")))


def neighbours(rows: DataFrame) -> DataFrame:
    """key, n_chars, next_key, previous_key and previous_n in descending order of (id, key), the last one followed by the first.

    `rows` holds key (distinct), id and n_chars. Rows are dealt in ranges; inside a range a window finds the
    neighbours, and a small table with a row a range finds them across ranges. No text moves.
    """
    ranged = saved(rows.repartitionByRange("id", "key").withColumn("part", F.spark_partition_id()), "id-ranges")
    at = F.struct("id", "key", "n_chars")
    edges = ranged.groupBy("part").agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
    # ranges are few: one row for each task of the exchange
    order = Window.orderBy("lo")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    around = edges.select(
        "part",
        F.coalesce(F.lag("hi").over(order), F.last("hi").over(every)).alias("below"),
        F.coalesce(F.lead("lo").over(order), F.first("lo").over(every)).alias("above"),
    )
    inside = Window.partitionBy("part").orderBy("id", "key")
    near = ranged.select("key", "n_chars", "part", F.lag(at).over(inside).alias("lower"), F.lead(at).over(inside).alias("upper"))
    lower, upper = F.coalesce("lower", "below"), F.coalesce("upper", "above")
    return near.join(around, "part").select(
        "key", "n_chars", lower["key"].alias("next_key"), upper["key"].alias("previous_key"), upper["n_chars"].alias("previous_n")
    )


def edited_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = KMER_WORDS) -> DataFrame:
    """Fingerprints of texts and of their edited texts, and what they have in common.

    The edited text has its last floor(n / 2) characters replaced by as many (or all) of the beginning of the
    next document in descending id order; null ids come last, rows of one id in any order.

    A text is dealt once; its neighbour is sent only the beginning that the edit needs, and the anchors instead of
    the text.
    """
    texts, lengths = keyed(docs, id_col, text_col)
    order = saved(neighbours(lengths), "neighbours")
    own = texts.withColumn("anchors", anchors(F.col("text"), k)).join(order, "key")
    # both uses read the same columns, so that one exchange of the texts serves them
    lent = own.select(
        F.col("previous_key").alias("key"), F.col("id").alias("next_doc_id"), F.substring("text", F.lit(1), F.floor(F.col("previous_n") / 2).cast("int")).alias("lent"), F.col("anchors").alias("next_anchors")
    )
    keep = (F.col("n_chars") - F.floor(F.col("n_chars") / 2)).cast("int")
    both = own.select("key", "id", "n_chars", F.substring("text", F.lit(1), keep).alias("kept"), "anchors").join(lent, "key")
    edited = both.select("id", "n_chars", "anchors", "next_anchors", "next_doc_id", F.concat("kept", "lent").alias("edited"))
    found = edited.select(
        "id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "anchors", anchors(F.col("edited"), k).alias("edited_anchors"), "next_anchors", "next_doc_id"
    )
    return found.select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", fingerprint(F.col("anchors")).alias("fingerprint"),
        fingerprint(F.col("edited_anchors")).alias("edited_fingerprint"), likeness(F.col("anchors"), F.col("edited_anchors")).alias("near_edited"),
        likeness(F.col("anchors"), F.col("next_anchors")).alias("near_next"), "next_doc_id",
    )
