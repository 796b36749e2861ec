"""Mixing sources of documents to target weights by capped water-filling.

Every source has a weight and may be repeated at most `max_epochs` times. The wanted number of words is dealt out by
weight; sources that would get more than they may hold are clamped, and what they leave is dealt out again among the
others by weight, until none is above. A round is one sum over the table of sources, and the driver sees three numbers
of it. A source's target is then met by whole repetitions of all its documents, one more repetition of a seeded sample
of them, and a part of one document, so that the words taken add up to the rounded target.

The sample holds the documents with the smallest keys (md5 of seed, id and size). Where it ends is found from sums by
key prefixes, two hexadecimal digits at a time, so that no task sorts a whole source, however large.

Defined results: null texts have no words and are taken 0 words of; null sources are one source, the last in order;
null ids are ids like others. Documents with the same source, id and size cannot be told apart: those at the end of
the sample get equal parts, rounded down. If all sources together can't hold the wanted words, each is taken in full
`max_epochs` times. A source without words, or of weight 0, has target 0. An empty table gives an empty result.
Columns of the caller are kept; the operator's own are named by it and replace columns of the same names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelframe.llm.common import saved

SEED = 17
_SPACE = " \t\n\x0b\f\r"
_DIGITS = (2, 4, 6, 8, 32)


def n_words(text: Column) -> Column:
    """Number of stretches without the six ASCII white-space characters."""
    text = F.coalesce(text, F.lit(""))
    outer = sum((F.substring(text, at, 1).isin(*_SPACE).cast("int") for at in (1, -1)), F.lit(0))
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, r"[\x20\x09-\x0D]+")) - outer).cast("long")


def sized(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """(id, source, size, key) of every document, without its text."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))
    return rows.withColumn("key", sample_key(F.col("id"), F.col("size"), seed))


def sample_key(id_column: Column, size: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), id_column.cast("string"), size.cast("string")))


def source_sizes(rows: DataFrame) -> DataFrame:
    """(source, source_size), written once."""
    return saved(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")


def cycled_weights(sources: DataFrame, cycle: Sequence[float]) -> DataFrame:
    """Sources with weights that repeat in code point order of the sources, null last.

    Ranges of sources are numbered apart; the window without a key goes over one row a range.
    """
    n = len(cycle)
    dealt = saved(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "mix-ranges")
    parts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    inner = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    placed = dealt.withColumn("place", inner).join(offsets, "part")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in cycle)), F.pmod(F.col("place") + F.col("offset") - 1, F.lit(n)).cast("int") + 1)
    return placed.select("source", "source_size", weight.alias("weight"))


def fill(sources: DataFrame, *, share: float, max_epochs: int) -> DataFrame:
    """Targets by capped water-filling: `share` of all words, at most `max_epochs` of each source.

    `sources` has (source, source_size, weight). Adds target, words (the rounded target), whole (repetitions of all
    documents) and rest (words beyond these).
    """
    sources = saved(sources, "mix-weights")
    cap = F.col("source_size").cast("double") * max_epochs
    first = sources.agg(F.sum("source_size"), F.sum(F.when(cap > 0, F.col("weight")))).first()
    wanted = share * float(first[0] or 0)
    left, weights, clamped = wanted, float(first[1] or 0), -1
    full = F.lit(False)
    while weights > 0:
        full = cap * F.lit(weights) <= F.col("weight") * F.lit(left)
        held = sources.where(cap > 0).agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight"))), F.sum(full.cast("int"))).first()
        if held[2] == clamped:
            break
        left, weights, clamped = wanted - float(held[0] or 0), float(held[1] or 0), held[2]
    else:
        full = F.lit(True)
    by_weight = F.lit(left) * F.col("weight") / F.lit(weights) if weights > 0 else F.lit(0.0)
    target = F.when((F.col("source_size") <= 0) | (F.col("weight") <= 0), F.lit(0.0)).when(full, cap).otherwise(by_weight)
    out = sources.withColumn("target", target).withColumn("words", F.floor(F.col("target") + 0.5).cast("long"))
    some = F.col("source_size") > 0
    return out.select(
        "*",
        F.when(some, F.expr("words div source_size")).otherwise(F.lit(0)).cast("long").alias("whole"),
        F.when(some, F.expr("words % source_size")).otherwise(F.lit(0)).cast("long").alias("rest"),
    )


def cuts(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources with the key at which the sample ends (`cut`) and the words taken of each document with that key (`part`).

    `rows` are those of `sized`. A step sums sizes by longer prefixes of the keys inside the prefix in which the sample
    ends, so a window goes over at most 256 rows a source, and in the last step over the keys with one prefix of eight digits.
    """
    sources = saved(sources, "mix-targets")
    want = sources.where("rest > 0").select("source", "rest", F.lit("").alias("prefix"), F.lit(0).cast("long").alias("n"))
    rows = rows.where("size > 0").select(F.col("source").alias("of"), "size", "key")
    held = 0
    for digits in _DIGITS:
        inside = rows.join(want, F.col("of").eqNullSafe(F.col("source")) & (F.substring("key", 1, held) == F.col("prefix")))
        sums = inside.groupBy("source", "rest", F.substring("key", 1, digits).alias("prefix")).agg(F.sum("size").alias("sum"), F.count(F.lit(1)).alias("n"))
        upto = sums.withColumn("upto", F.sum("sum").over(Window.partitionBy("source").orderBy("prefix")))
        before = F.col("upto") - F.col("sum")
        crossed = upto.where((before <= F.col("rest")) & (F.col("rest") < F.col("upto")))
        want, held = crossed.select("source", (F.col("rest") - before).alias("rest"), "prefix", "n"), digits
    ends = saved(want.select(F.col("source").alias("of"), F.col("prefix").alias("cut"), F.expr("rest div n").alias("part")), "mix-cuts")
    return sources.join(ends, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")


def taken(rows: DataFrame, sources: DataFrame, *, source_col: str = "source") -> DataFrame:
    """Rows with (size, key), of texts or not, joined with what `cuts` gives: adds source_size, target, repeats and taken."""
    own = sources.select(F.col("source").alias("__mix_source"), "source_size", "target", *(F.col(c).alias(f"__mix_{c}") for c in ("whole", "cut", "part")))
    rows = rows.drop("source_size", "target", "repeats", "taken")
    more = F.when(F.col("key") < F.col("__mix_cut"), F.col("size")).when(F.col("key") == F.col("__mix_cut"), F.col("__mix_part")).otherwise(F.lit(0))
    joined = rows.join(own, F.col(source_col).eqNullSafe(F.col("__mix_source")))
    return joined.select(
        *rows.columns,
        "source_size",
        "target",
        (F.col("__mix_whole") + (F.coalesce(F.col("key") < F.col("__mix_cut"), F.lit(False))).cast("long")).alias("repeats"),
        (F.col("__mix_whole") * F.col("size") + F.coalesce(more, F.lit(0))).alias("taken"),
    )


def mix_plan(rows: DataFrame, weights: DataFrame | Sequence[float], *, share: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """Targets and sample ends of all sources of `sized` rows, one row a source.

    `weights` is a table (source, weight), in which a missing source weighs nothing, or a cycle of weights over the sources in order.
    """
    sources = source_sizes(rows)
    if isinstance(weights, DataFrame):
        own = weights.select(F.col("source").alias("of"), F.col("weight").cast("double").alias("weight"))
        sources = sources.join(own, F.col("source").eqNullSafe(F.col("of")), "left").select("source", "source_size", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    else:
        sources = cycled_weights(sources, weights)
    return cuts(rows, fill(sources, share=share, max_epochs=max_epochs))


def mix(
    docs: DataFrame, weights: DataFrame | Sequence[float], *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    share: float = 1.5, max_epochs: int = 2, seed: int = SEED,
) -> DataFrame:
    """The mix: a row for each repetition (`copy`, from 1) of each taken document; a document taken in part is cut after its words."""
    rows = saved(sized(docs, id_col=id_col, text_col=text_col, source_col=source_col, seed=seed), "mix-sizes")
    plan = mix_plan(rows, weights, share=share, max_epochs=max_epochs)
    names = [c for c in docs.columns if c != "copy"]
    own = docs.select(*names, n_words(F.col(text_col)).alias("__mix_size")).withColumn("__mix_key", sample_key(F.col(id_col), F.col("__mix_size"), seed))
    renamed = {c: f"__mix_own_{c}" for c in names if c in ("size", "key", "source_size", "target", "repeats", "taken")}
    own = own.withColumnsRenamed(renamed).withColumnsRenamed({"__mix_size": "size", "__mix_key": "key"})
    found = taken(own, plan, source_col=renamed.get(source_col, source_col))
    left = F.col("taken") - F.col("repeats") * F.col("size")
    copies = found.withColumn("__mix_left", left).withColumn("copy", F.explode(F.sequence(F.lit(1), (F.col("repeats") + (left > 0).cast("long")).cast("int"), F.lit(1))))
    words = F.filter(F.split(F.col(renamed.get(text_col, text_col)), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    text = F.when(F.col("copy") > F.col("repeats"), F.array_join(F.slice(words, F.lit(1), F.col("__mix_left").cast("int")), " ")).otherwise(F.col(renamed.get(text_col, text_col)))
    back = [(text if c == text_col else F.col(renamed.get(c, c))).alias(c) for c in names]
    return copies.where("taken > 0").select(*back, "copy")
