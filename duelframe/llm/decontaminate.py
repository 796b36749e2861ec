"""Benchmark decontamination with a distributed positional inverted index.

Every document word that some test item uses is stored once as a posting (term, row, position), with one
more record for the length of each document. For each window of an item the rarest terms, by postings in
the corpus, are looked up first: their posting lists, shifted by the terms' offsets, give the places where
the window may start. The remaining terms are then intersected by position, and places where all terms
stand are exact phrase matches. Proximity matches (all distinct terms of a window in any order, within its length
and a few words more) come from the same lists, where a slack is given. Only built-in functions are used.

Defined results: null texts have no words; items without words are no windows; equal items count each;
document rows are told apart by a row number, so null and repeated ids and repeated rows each keep their own
row; without items or documents nothing is hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelframe.llm.common import bound, lower_ascii, saved

WINDOW_WORDS = 13
#: a share of 1 / 20 of the words
SHARE = 20
#: words that a proximity match may be longer than its window
SLACK = 5
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text: digits, letters of either case as lower case, and everything beyond ASCII."""
    return F.coalesce(F.regexp_extract_all(lower_ascii(text), F.lit(_WORD), F.lit(0)), F.array().cast("array<string>"))


def item_windows(items: DataFrame, *, item_col: str = "item_id", text_col: str = "text", length: int = WINDOW_WORDS) -> DataFrame:
    """item_id, terms: every distinct window of `length` words; a shorter item is one window."""
    split = items.select(F.col(item_col).alias("item_id"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - length + 1))
    return split.select("item_id", F.explode(starts).alias("at"), "w").select("item_id", F.slice(F.col("w"), F.col("at"), F.lit(length)).alias("terms"))


def build_index(docs: DataFrame, terms: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (row, pos, term_id) of the given terms in all documents; term_id null: pos is the number of words.

    One pass over the texts. The term list goes to the tasks only if Spark finds it small enough to
    broadcast; otherwise both sides are dealt by term.
    """
    split = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("w"))
    length = F.struct(F.lit(None).cast("string").alias("term"))
    tokens = split.select("row", "doc_id", F.size("w").alias("n"), F.posexplode(F.concat(F.col("w"), F.array(length["term"]))).alias("pos", "term"))
    listed = tokens.join(terms, "term", "left").where(F.col("term").isNull() | F.col("term_id").isNotNull())
    return listed.select(
        "row", F.when(F.col("term").isNull(), F.col("doc_id")).alias("doc_id"), F.when(F.col("term").isNull(), F.col("n")).otherwise(F.col("pos")).alias("pos"), "term_id"
    )


def phrase_matches(index: DataFrame, windows: DataFrame, terms: DataFrame) -> DataFrame:
    """(row, start, window_id, n) of every place where a window stands word for word.

    `windows` holds window_id and terms. The two rarest terms of a window are intersected first, and only what
    is left of them is checked at all its positions.
    """
    postings = index.where("term_id is not null").select("row", "pos", "term_id")
    asked = windows.select("window_id", F.size("terms").alias("n"), F.posexplode("terms").alias("offset", "term")).join(terms, "term")
    counts = postings.groupBy("term_id").agg(F.count(F.lit(1)).alias("postings"))
    ranked = asked.join(counts, "term_id", "left").withColumn("postings", F.coalesce("postings", F.lit(0)))
    rare = Window.partitionBy("window_id").orderBy("postings", "offset")
    ranked = ranked.withColumn("rarity", F.row_number().over(rare)).withColumn("fewest", F.min("postings").over(Window.partitionBy("window_id")))
    ranked = saved(ranked.where("fewest > 0").select("window_id", "n", "offset", "term_id", "rarity"), "phrase-terms")

    def starts(rarity: int) -> DataFrame:
        lists = ranked.where(F.col("rarity") == rarity)
        found = postings.join(lists, "term_id")
        return found.select("row", (F.col("pos") - F.col("offset")).alias("start"), "window_id", "n").where("start >= 0")

    single = starts(1)
    first = single.where("n = 1").unionByName(single.where("n > 1").join(starts(2).select("row", "start", "window_id"), ["row", "start", "window_id"], "left_semi"))
    first = saved(first, "phrase-starts")
    wanted = first.join(ranked.select("window_id", "offset", "term_id"), "window_id").select(
        "row", (F.col("start") + F.col("offset")).alias("pos"), "term_id", "start", "window_id", "n"
    )
    # documents with candidates grow with the corpus, so both joins are planned as merge joins at every size
    near = postings.join(first.select("row").distinct().hint("merge"), "row", "left_semi")
    there = wanted.join(near.hint("merge"), ["row", "pos", "term_id"], "left_semi")
    full = there.groupBy("row", "start", "window_id", "n").agg(F.count(F.lit(1)).alias("met"))
    return full.where("met = n").select("row", "start", "window_id", "n")


def proximity_matches(index: DataFrame, windows: DataFrame, terms: DataFrame, *, slack: int = SLACK) -> DataFrame:
    """(row, window_id, first, last): every smallest interval with all distinct terms of a window, in any order.

    An interval is no longer than the window plus `slack` words, and none within it has all terms. Postings of the
    rarest term are kept where one of the second rarest is near; around these, all postings of a document are laid out
    in pairs of neighbouring blocks, as wide as the longest interval, and each interval is found in the block it starts in.
    """
    postings = index.where("term_id is not null").select("row", "pos", "term_id")
    asked = windows.select("window_id", (F.size("terms") + slack).alias("span"), F.explode(F.array_distinct("terms")).alias("term")).join(terms, "term")
    counts = postings.groupBy("term_id").agg(F.count(F.lit(1)).alias("postings"))
    ranked = asked.join(counts, "term_id", "left").withColumn("postings", F.coalesce("postings", F.lit(0)))
    whole = Window.partitionBy("window_id")
    ranked = ranked.withColumn("rarity", F.row_number().over(whole.orderBy("postings", "term_id"))).withColumn("fewest", F.min("postings").over(whole))
    ranked = ranked.withColumn("kinds", F.count(F.lit(1)).over(whole)).where("fewest > 0")
    ranked = saved(ranked.select("window_id", "span", "term_id", "rarity", "kinds"), "near-terms")
    reach = ranked.agg(F.max("span")).first()[0] or 1

    def places(rarity: int) -> DataFrame:
        lists = ranked.where(F.col("rarity") == rarity).drop("rarity")
        return postings.join(lists, "term_id").withColumn("block", F.expr(f"pos div {reach}")).drop("term_id")

    single, second = places(1), places(2).select("row", "window_id", "block", F.col("pos").alias("other"))
    around = single.where("kinds > 1").withColumn("block", F.explode(F.expr("array(block - 1, block, block + 1)")))
    same = [around[c] == second[c] for c in ("row", "window_id", "block")]
    paired = around.join(second, [*same, F.abs(around["pos"] - second["other"]) < around["span"]], "left_semi")
    anchors = single.where("kinds = 1").unionByName(paired)
    begin = F.explode(F.expr(f"array_distinct(array(greatest(0, pos div {reach} - 1), pos div {reach}))"))
    starts = saved(anchors.select("row", "window_id", begin.alias("begin")).distinct(), "near-starts")
    blocks = starts.select("row", "begin").distinct().select("row", "begin", F.explode(F.expr("array(begin, begin + 1)")).alias("block"))
    there = postings.withColumn("block", F.expr(f"pos div {reach}")).join(blocks.hint("merge"), ["row", "block"])
    laid_out = there.groupBy("row", "begin").agg(F.array_sort(F.collect_list(F.struct("pos", "term_id"))).alias("near"))
    sets = ranked.groupBy("window_id", "span").agg(F.collect_list("term_id").alias("ids"))
    found = starts.join(laid_out.hint("merge"), ["row", "begin"]).join(sets, "window_id")
    found = found.where(F.size(F.array_except("ids", F.col("near.term_id"))) == 0)
    found = found.withColumn("near", F.filter("near", lambda y: F.array_contains(F.col("ids"), y["term_id"])))

    def interval(x: Column) -> Column:
        return bound(F.filter("near", lambda y: (y["pos"] >= x["pos"]) & (y["pos"] < x["pos"] + F.col("span"))), smallest)

    def smallest(ahead: Column) -> Column:
        """From the first posting of `ahead` to the one that completes the terms; null if they are not all there or the first comes again before."""
        order = ahead["term_id"]
        kinds = F.array_distinct(order)
        size = F.array_position(order, F.element_at(kinds, -1)).cast("int")
        again = F.array_contains(F.slice(order, F.lit(2), F.greatest(F.lit(0), size - 1)), F.get(order, F.lit(0)))
        ends = F.struct(F.get(ahead, F.lit(0))["pos"].alias("first"), F.get(ahead, size - 1)["pos"].alias("last"))
        return F.when((F.size(kinds) == F.size("ids")) & ~again, ends)

    own = F.filter("near", lambda y: F.floor(y["pos"] / F.lit(reach)) == F.col("begin"))
    return found.select("row", "window_id", F.explode(F.filter(F.transform(own, interval), lambda m: m.isNotNull())).alias("m")).select("row", "window_id", "m.first", "m.last")


def contamination(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    length: int = WINDOW_WORDS,
    share: int = SHARE,
    slack: int | None = None,
) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, items, contaminated; with a `slack` also n_near.

    A word inside any occurrence of a window is hit; a document is contaminated if at least 1 / `share` of its
    words are. `items` is the sorted list of item ids as strings (at most one entry for each item).
    n_near is the number of proximity matches of all distinct windows; it does not bear on `contaminated`.
    """
    own = saved(item_windows(items, item_col=item_col, text_col=item_text_col, length=length), "test-windows")
    windows = saved(own.select("terms").distinct().withColumn("window_id", F.monotonically_increasing_id()), "distinct-windows")
    terms = saved(
        windows.select(F.explode("terms").alias("term")).distinct().withColumn("term_id", F.monotonically_increasing_id()), "test-terms"
    )
    index = saved(build_index(docs, terms, id_col=id_col, text_col=text_col), "postings")
    matches = saved(phrase_matches(index, windows, terms), "phrase-matches")
    hit = matches.select("row", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("pos")).distinct()
    hits = hit.groupBy("row").agg(F.count(F.lit(1)).alias("n_hit"))
    whose = own.join(windows, "terms").select("window_id", "item_id").distinct()
    met = matches.select("row", "window_id").distinct().join(whose, "window_id").select("row", "item_id").distinct()
    listed = met.groupBy("row").agg(F.sort_array(F.collect_list(F.col("item_id").cast("string"))).alias("items"))
    lengths = index.where("term_id is null").select("row", "doc_id", F.col("pos").cast("long").alias("n_words"))
    counted = lengths.join(hits, "row", "left").join(listed, "row", "left")
    near = []
    if slack is not None:
        close = proximity_matches(index, windows, terms, slack=slack).groupBy("row").agg(F.count(F.lit(1)).alias("n_near"))
        counted = counted.join(close, "row", "left")
        near = [F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near")]
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return counted.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"), *near,
    )


def digest(found: DataFrame) -> DataFrame:
    """The items of a document as their number and one hash."""
    near = [c for c in found.columns if c == "n_near"]
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated", *near
    )
