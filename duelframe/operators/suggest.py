"""Close names for queries that matched nothing.

The similarity is the sequence-match ratio 2M / (la + lb). It never exceeds the
overlap of the two names as bags of characters, so a pair at or above the cutoff
shares a known number of (character, occurrence) tokens. With the tokens in one
global order, rare ones first, such a pair must share two tokens in a short head
of both lists. Joining on those token pairs finds every pair at or above the
cutoff without comparing each name with each other name. Names that are the same bag
are joined as one.

Only the best few names of a query are wanted. So where there are many queries, high cutoffs
come first, which compare few pairs; a query that has enough names at one of them is settled, as
no name below it can come before those. What the bags let through is bounded once more by the longest
common subsequence, a few machine words a pair, before the ratio is taken.
"""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duelframe import fixed_values as fv
from duelframe.session import shuffle_width

# any fixed order is correct; rare characters first makes the heads selective
_RARE_FIRST = "zqxj9876543kvbpygfwmu2clrhd1snioate 0"
_MOST_REPEATS = 10_000
#: from so many queries on, cutoffs are lowered step by step and tokens are ordered by how many keys have them
_MANY_QUERIES = 100
_STEPS = (0.94, 0.88, 0.78)


def _short(cutoff: float) -> int:
    """Longest name that can reach the cutoff with a partner of one character by one shared character.

    One shared character is enough only if both lengths together are 2 / cutoff at most, so only if
    both names are this short; every other pair in reach shares two.
    """
    return max(2, int(2.0 / cutoff + 1e-9) - 1)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters modulo 128, a row a text, 128 behind its end; and lengths."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    width = max(1, int(lengths.max(initial=0)))
    points = np.array(texts, dtype=f"U{width}").view(np.uint32).reshape(len(texts), width) % 128
    return np.where(np.arange(width) < lengths[:, None], points, 128), lengths


def _matched_at_most(candidates: list[str], queries: list[str], place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Upper bounds of the matched characters of each candidate and `queries[place]`, and both lengths together.

    The bound is the longest common subsequence, all rows at once, a bit a character of the query; characters that
    are alike modulo 128 count as equal, which only raises it. Queries of more than 63 characters get the shorter length.
    """
    codes, lengths = _codes(candidates)
    asked, asked_lengths = _codes(queries)
    one = np.uint64(1)
    masks = np.zeros((len(queries), 129), dtype=np.uint64)
    rows = np.arange(len(queries))
    for i in range(min(63, asked.shape[1])):
        masks[rows, asked[:, i]] |= one << np.uint64(i)
    masks[:, 128] = 0
    left = np.full(len(candidates), ~np.uint64(0))
    for i in range(codes.shape[1]):
        hit = left & masks[place, codes[:, i]]
        left = (left + hit) | (left - hit)
    size = asked_lengths[place]
    inside = (one << np.minimum(size, 63).astype(np.uint64)) - one
    common = np.bitwise_count(~left & inside).astype(np.int64)
    return np.where(size > 63, np.minimum(size, lengths), common), size + lengths


def _ratio(cutoff: float):
    """Sequence-match ratio where it may reach the cutoff, null elsewhere."""

    def ratios(candidates: pd.Series, queries: pd.Series) -> pd.Series:
        texts = candidates.tolist()
        place, different = pd.factorize(queries)
        out = np.full(len(texts), np.nan)
        if texts:
            most, total = _matched_at_most(texts, list(different), place)
            near = np.flatnonzero(2.0 * most >= total * (cutoff - 1e-9))
            matcher, last = SequenceMatcher(), -1
            # rows of one query together, as the matcher keeps an index of the query
            for row in near[np.argsort(place[near], kind="stable")]:
                if place[row] != last:
                    last = place[row]
                    matcher.set_seq2(different[last])
                matcher.set_seq1(texts[row])
                out[row] = matcher.ratio()
        return pd.Series(out).astype("object").where(~np.isnan(out), None)

    return F.pandas_udf(ratios, T.DoubleType())


def _tokens(key: Column, frequent: Sequence[int] = ()) -> Column:
    """Distinct integers, one per (character, occurrence), in the global order.

    `frequent` has the tokens of the index, rarest first: they come behind all others, in that order.
    """
    letters = F.filter(F.split(key, ""), lambda c: c != "")
    numbered = F.transform(
        letters,
        lambda c, i: F.struct(
            F.instr(F.lit(_RARE_FIRST), c).alias("rank"),
            F.size(F.filter(F.slice(letters, 1, i + 1), lambda d: d == c)).alias("nth"),
        ),
    )
    tokens = F.transform(numbered, lambda t: (F.lit(_MOST_REPEATS) - t["nth"]) * 100 + t["rank"])
    if frequent:
        top = _MOST_REPEATS * 100
        places = [0] * (top - min(frequent) + 1)
        for place, token in enumerate(frequent, 1):
            places[top - token] = place
        # one text, which the optimizer folds to an array once
        listed = F.split(F.lit(" ".join(map(str, places))), " ").cast("array<bigint>")
        tokens = F.transform(tokens, lambda t: F.coalesce(F.get(listed, F.lit(top) - t), F.lit(0)) * (top + 100) + t)
    return F.sort_array(tokens.cast("array<bigint>"))


def _head(cutoff: float) -> Column:
    """The first tokens, enough to hold two shared ones of any partner in reach."""
    length = F.col("len")
    shortest = F.ceil(length * (cutoff / (2.0 - cutoff)))
    shared = F.greatest(F.lit(1), F.ceil((length + shortest) * (cutoff / 2.0) - 1e-9)).cast("int")
    return F.slice("tokens", 1, F.greatest(F.lit(1), F.least(length, length - shared + 2)))


def _block_keys(short: int) -> Column:
    """Pairs of head tokens, and single tokens for names that one shared character may match."""
    head = F.col("head")
    pairs = F.flatten(
        F.transform(
            head,
            lambda t, i: F.transform(F.slice(head, i + 2, F.size(head)), lambda u: F.concat_ws("-", t, u)),
        )
    )
    singles = F.when(F.col("len") <= short, F.transform("tokens", lambda t: t.cast("string"))).otherwise(F.array().cast("array<string>"))
    return F.concat(pairs, singles)


def _blocked(bags: DataFrame, cutoff: float) -> DataFrame:
    framed = bags.withColumn("len", F.size("tokens")).withColumn("head", _head(cutoff))
    return framed.select("len", "tokens", "head", F.explode(_block_keys(_short(cutoff))).alias("block"))


def _first_block(short: int) -> Column:
    """The one block a pair is taken from, so that no pair is produced twice."""
    common = F.array_intersect("qh", "head")
    both_short = (F.col("ql") <= short) & (F.col("len") <= short)
    single = F.get(F.array_intersect("qt", "tokens"), F.lit(0)).cast("string")
    pair = F.concat_ws("-", F.get(common, F.lit(0)), F.get(common, F.lit(1)))
    return F.when(both_short, single).otherwise(pair)


def _close(left: DataFrame, right: DataFrame, cutoff: float, limit: int) -> DataFrame:
    """The best names of every query among all at or above the cutoff; both sides have `name_key` and its `tokens`."""
    # stated widths: a few megabytes here become very many pairs, and what is stated is not coalesced by size
    width = shuffle_width(left.sparkSession)
    asked = _blocked(left.select("tokens").distinct(), cutoff).repartition(width, "block")
    asked = asked.select(F.col("len").alias("ql"), F.col("tokens").alias("qt"), F.col("head").alias("qh"), "block")
    overlap = F.size(F.array_intersect("qt", "tokens"))
    total = F.col("ql") + F.col("len")
    bound = 2.0 * F.least(F.col("ql"), F.col("len")) >= total * (cutoff - 1e-9)
    bags = (
        asked.join(_blocked(right.select("tokens").distinct(), cutoff).repartition(width, "block"), "block")
        .where(bound & (F.col("block") == _first_block(_short(cutoff))) & (2.0 * overlap >= total * (cutoff - 1e-9)))
        .select("qt", "tokens")
    )
    members = left.select(F.col("tokens").alias("qt"), F.col("name_key").alias("query_key")).join(bags, "qt").repartition(width, "tokens")
    pairs = members.join(right, "tokens").select("query_key", "name_key")
    scored = pairs.withColumn("ratio", _ratio(cutoff)("name_key", "query_key")).where(F.col("ratio") >= cutoff)
    best = Window.partitionBy("query_key").orderBy(F.desc("ratio"), F.desc("name_key"))
    # Spark applies the row limit inside each task before the shuffle
    return scored.withColumn("key_rank", F.row_number().over(best)).where(F.col("key_rank") <= limit)


def _different(df: DataFrame) -> DataFrame:
    """Distinct keys, by a count: through a plain distinct, Spark takes what follows, tokens and filters on them, to every row."""
    return df.groupBy("name_key").count().select(F.when(F.col("count") > 0, F.col("name_key")).alias("name_key"))


def _kept(df: DataFrame) -> DataFrame:
    """The rows, computed now, with a plan that starts from them; on executors only where no shared folder is named."""
    return df.checkpoint() if df.sparkSession.conf.get("spark.checkpoint.dir", None) else df.localCheckpoint()


def close_keys(
    queries: DataFrame, index_keys: DataFrame, *, cutoff: float = fv.SUGGESTION_CUTOFF, limit: int = 2 * fv.SUGGESTION_LIMIT,
    many: int = _MANY_QUERIES,
) -> DataFrame:
    """Best index keys of every query key: highest ratio first, then text order descending.

    Every pair at or above the cutoff is found, whatever the cutoff; low cutoffs compare more pairs. With `many` queries
    or more, all but the last step run here, and their few rows a query are checkpointed.
    """
    if not 0.0 < cutoff <= 1.0:
        raise ValueError("a cutoff lies above 0 and is 1 at most")
    asked = _different(queries.where("name_key <> ''"))
    keys = _different(index_keys)
    if asked.limit(many).count() < many:
        return _close(*(side.withColumn("tokens", _tokens(F.col("name_key"))) for side in (asked, keys)), cutoff, limit)
    counts = keys.select(F.explode(_tokens(F.col("name_key"))).alias("t")).groupBy("t").count().orderBy("count", "t").collect()
    frequent = [row["t"] for row in counts]
    rest, right = (_kept(side.withColumn("tokens", _tokens(F.col("name_key"), frequent))) for side in (asked, keys))
    settled = []
    for step in (s for s in _STEPS if s > cutoff):
        near = _kept(_close(rest, right, step, limit))
        full = near.where(F.col("key_rank") == limit).select("query_key")
        settled.append(near.join(full, "query_key", "left_semi"))
        rest = _kept(rest.join(full.withColumnRenamed("query_key", "name_key"), "name_key", "left_anti"))
        if rest.isEmpty():
            break
    found = _close(rest, right, cutoff, limit)
    for near in settled:
        found = found.unionByName(near)
    return found


def suggestions(
    misses: DataFrame, index: DataFrame, *, limit: int = fv.SUGGESTION_LIMIT, cutoff: float = fv.SUGGESTION_CUTOFF
) -> DataFrame:
    """Up to `limit` entity ids per query key: best keys first, ids in text order."""
    near = close_keys(misses, index, cutoff=cutoff, limit=max(2 * limit, limit))
    by_id = Window.partitionBy("name_key").orderBy("entity_id")
    few_ids = index.withColumn("id_rank", F.row_number().over(by_id)).where(F.col("id_rank") <= limit)
    found = near.join(few_ids, "name_key").groupBy("query_key", "entity_id").agg(
        F.min(F.struct("key_rank", "id_rank")).alias("place")
    )
    order = Window.partitionBy("query_key").orderBy("place")
    return (
        found.withColumn("suggestion_rank", F.row_number().over(order))
        .where(F.col("suggestion_rank") <= limit)
        .select("query_key", "entity_id", "suggestion_rank")
    )
