"""Runs of words that repeat with a period, found by internal pattern matching.

A run is a longest stretch of words with smallest period q that is at least `min_length` words and `min_exponent` periods long.
Per block of texts, in numpy:

1. Suffixes are sorted by doubling. Only suffixes whose first four words stand twice in their text take part; all others are alone
   in every order. A step gives for blocks of m = 4, 8, 16, ... words the range of the suffix array with the same m words.
2. A wavelet tree over the suffix array answers range successor queries. Each dyadic block, begun at every multiple of m / 2, asks
   where it occurs next in the window of m words behind its start. Its occurrences there are a progression, so the distance d to
   the first one is the smallest period of the stretch of m + d words, and a candidate.
3. Stretches with one period that share a period of words are joined and grown by comparing words; the growth is less than a block.

Why nothing is missed: take a run with period q and the block length m with m / 2 <= q <= m (m = 4 also for q = 1). Its length of at least
4q words (6 where q = 1) is no less than m + m / 2 - 1 + q, so it holds a block of the grid together with its copy q words on. A block of
at least q words recurs in such a run only at multiples of q. What is found is exact: words are compared by their codes.

Defined results: null and empty texts have no words and no run; ties for the strongest run go to the smallest start and then period;
repeated rows are judged one by one; a text is one unit of work, however long. Columns of the caller are kept, except for the text
and columns with the names of results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from duelframe.llm.common import byte_words, slices

MIN_LENGTH, MIN_EXPONENT = 6, 4
_SLICE_BYTES = 4 << 20
_SHORTEST = 4
_CELLS = 1 << 21
RESULTS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_runs", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("period", T.LongType()),
        T.StructField("runs", T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))),
        T.StructField("collapsed", T.StringType()),
    ]
)


class RangeSuccessor:
    """Wavelet tree, level by level, over a permutation of 0 .. n - 1: next larger values inside ranges of places."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, (max(1, len(values)) - 1).bit_length())
        self.zeros = []
        for b in range(self.bits - 1, -1, -1):
            bit = (values >> b & 1).astype(bool)
            self.zeros.append(np.concatenate([[0], np.cumsum(~bit)]))
            values = np.concatenate([values[~bit], values[bit]])

    def below(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values of places low .. high - 1 are less than `bound` (less than 2 ** bits)."""
        found = np.zeros(len(low), dtype=np.int64)
        for b, zeros in zip(range(self.bits - 1, -1, -1), self.zeros):
            one = (bound >> b & 1).astype(bool)
            z_low, z_high = zeros[low], zeros[high]
            found += np.where(one, z_high - z_low, 0)
            low, high = np.where(one, zeros[-1] + low - z_low, z_low), np.where(one, zeros[-1] + high - z_high, z_high)
        return found

    def smallest(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest value (from 0) of places low .. high - 1."""
        value = np.zeros(len(low), dtype=np.int64)
        for b, zeros in zip(range(self.bits - 1, -1, -1), self.zeros):
            z_low, z_high = zeros[low], zeros[high]
            one = k >= z_high - z_low
            k = k - np.where(one, z_high - z_low, 0)
            value |= one.astype(np.int64) << b
            low, high = np.where(one, zeros[-1] + low - z_low, z_low), np.where(one, zeros[-1] + high - z_high, z_high)
        return value

    def after(self, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The smallest value above `value`, a value inside the range; -1 where there is none."""
        k = self.below(low, high, value) + 1
        there = np.flatnonzero(k < high - low)
        found = np.full(len(low), -1, dtype=np.int64)
        found[there] = self.smallest(low[there], high[there], k[there])
        return found


def _with_twins(codes: np.ndarray, text: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose first four words stand twice in their text, in an order that keeps equal ones together, and group heads."""
    at = np.flatnonzero(left >= _SHORTEST)
    key = text[at].astype(np.uint64)
    for k in range(_SHORTEST):
        key = (key ^ codes[at + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    twin = np.zeros(len(at), dtype=bool)
    twin[order[1:][same]] = True
    twin[order[:-1][same]] = True
    at = at[twin]  # the hash only rules out; the words decide
    order = at[np.lexsort([codes[at + k] for k in range(_SHORTEST - 1, -1, -1)] + [text[at]])] if len(at) else at
    head = np.ones(len(order), dtype=bool)
    if len(order):
        head[1:] = text[order[1:]] != text[order[:-1]]
        for k in range(_SHORTEST):
            head[1:] |= codes[order[1:] + k] != codes[order[:-1] + k]
    return order, head


def _block_ranges(order: np.ndarray, head: np.ndarray, n: int, longest: int):
    """Suffix array of the places in `order` by doubling, and (place, block length, range) of all blocks of the grid that recur."""
    size = len(order)
    places = np.arange(size)
    rank = np.arange(size, size + n + 1)  # a place with no twin differs from all others
    rank[order] = np.maximum.accumulate(np.where(head, places, 0))
    tied, m, blocks = places, _SHORTEST, []
    while m <= max(longest, _SHORTEST):
        bounds = np.append(np.flatnonzero(head), len(tied))
        count = np.diff(bounds)
        many = np.repeat(count > 1, count)
        first, last = np.repeat(tied[bounds[:-1]] if len(tied) else bounds[:-1], count)[many], np.repeat(count, count)[many]
        tied = tied[many]
        if not len(tied):
            break
        grid = order[tied] % (m // 2) == 0
        blocks.append((order[tied][grid], np.full(int(grid.sum()), m), first[grid], (first + last)[grid]))
        suffixes = order[tied]
        both = rank[suffixes] * (size + n + 2) + rank[np.minimum(suffixes + m, n)]  # the group, then what follows
        again = np.argsort(both)
        suffixes, both = suffixes[again], both[again]
        order[tied] = suffixes
        head = np.ones(len(tied), dtype=bool)
        head[1:] = both[1:] != both[:-1]
        rank[suffixes] = tied[np.maximum.accumulate(np.where(head, np.arange(len(tied)), 0))]
        m *= 2
    return [np.concatenate(c) for c in zip(*blocks)] if blocks else None


def _grown(codes: np.ndarray, at: np.ndarray, other: np.ndarray, limit: np.ndarray, step: int) -> np.ndarray:
    """How many words from `at` on, in direction `step` and at most `limit`, equal those from `other` on."""
    grown = np.zeros(len(at), dtype=np.int64)
    active, width = np.flatnonzero(limit > 0), 4
    while len(active):
        width = min(2 * width, max(8, _CELLS // len(active)))
        going = []
        for chunk in np.array_split(active, max(1, len(active) * width // _CELLS)):
            reach = np.arange(width)
            within = reach < (limit[chunk] - grown[chunk])[:, None]
            move = step * np.where(within, grown[chunk][:, None] + reach, 0)
            equal = within & (codes[at[chunk][:, None] + move] == codes[other[chunk][:, None] + move])
            whole = equal.all(axis=1)
            grown[chunk] += np.where(whole, width, np.argmin(equal, axis=1))
            going.append(chunk[whole])
        active = np.concatenate(going)
    return grown


def word_runs(codes: np.ndarray, sizes: np.ndarray, *, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start (over all words), length and period of all runs of texts, given codes of their words, by start and then period."""
    n = len(codes)
    none = tuple(np.zeros(0, dtype=np.int64) for _ in range(3))
    if min_exponent < 4 or min_length < 6:
        raise ValueError("blocks of words find runs of four periods and six words at least")
    text = np.repeat(np.arange(len(sizes)), sizes)
    ends = np.cumsum(sizes)
    order, head = _with_twins(codes, text, ends[text] - np.arange(n))
    if not len(order):
        return none
    blocks = _block_ranges(order, head, n, int(sizes.max()) // 2)
    if blocks is None:
        return none
    place, m, low, high = blocks
    places = np.sort(order)  # values of the tree are numbers of places
    found = RangeSuccessor(np.searchsorted(places, order)).after(low, high, np.searchsorted(places, place))
    near = found >= 0
    place, m, following = place[near], m[near], places[found[near]]
    near = following - place <= m
    place, m, d = place[near], m[near], (following - place)[near]
    if not len(place):
        return none
    by = np.lexsort((place, d))
    place, d, end = place[by], d[by], (place + m + d)[by]
    group = np.cumsum(np.concatenate([[0], d[1:] != d[:-1]]))
    far = np.maximum.accumulate(end + group * (4 * n + 4)) - group * (4 * n + 4)
    first = np.concatenate([[True], (group[1:] != group[:-1]) | (place[1:] + d[1:] > far[:-1])])
    start, d = place[first], d[first]
    end = far[np.append(np.flatnonzero(first)[1:] - 1, len(far) - 1)]
    own = text[start]
    end = end + _grown(codes, np.minimum(end, n - 1), np.minimum(end, n - 1) - d, ends[own] - end, 1)
    left = start - (ends[own] - sizes[own])
    start = start - _grown(codes, np.maximum(start - 1, 0), np.maximum(start - 1, 0) + d, left, -1)
    length = end - start
    long = length >= np.maximum(min_length, min_exponent * d)
    runs = np.unique(np.stack([start[long], d[long], length[long]]), axis=1)
    return runs[0], runs[2], runs[1]


def _strongest(text: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Number of each text's run with the greatest length / period, compared as exact fractions."""
    digits, rest = [-(length // period)], length % period
    for _ in range(2):  # 64 binary digits, more than two different fractions can share
        digits.append(-((rest << 32) // period))
        rest = (rest << 32) % period
    order = np.lexsort((period, start, *digits[::-1], text))
    return order[np.unique(text[order], return_index=True)[1]]


def _judge(batch: pa.RecordBatch, overlay: tuple[str, str] | None, rules: dict) -> list[pa.Array]:
    words, sizes = byte_words([t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()])
    n, n_texts = len(words), len(sizes)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    source = np.arange(n)
    if overlay:
        first, period = (batch.column(c).to_pylist() for c in overlay)
        for t in [t for t in range(n_texts) if first[t] is not None and period[t]]:
            a = int(begins[t]) + first[t]
            source[a : ends[t]] = a + np.arange(max(0, int(ends[t]) - a)) % period[t]
    codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)[source]
    start, length, period = word_runs(codes, sizes, **rules)
    text = np.searchsorted(ends, start, side="right")
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    kept = np.cumsum(change[:-1]) == 0
    left = np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], ends])]
    pieces = pa.LargeListArray.from_arrays(pa.array(left), words.take(pa.array(source[kept])))
    collapsed = pa.compute.binary_join(pieces, pa.scalar(b" ", pa.large_binary())).cast(pa.large_string())
    best = np.full(n_texts, -1, dtype=np.int64)
    if len(start):
        top = _strongest(text, start, length, period)
        best[text[top]] = top
    local = start - begins[text]
    some = pa.array(best, mask=best < 0)
    offsets = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_texts))])
    runs = pa.StructArray.from_arrays([pa.array(a) for a in (local, length, period)], names=["start", "length", "period"])
    return [
        pa.array(sizes),
        pa.array(np.diff(offsets)),
        *(pa.array(a).take(some) for a in (local, length, period)),
        pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), runs),
        collapsed.cast(pa.string()),
    ]


def periodic_runs(
    docs: DataFrame, *, text_col: str = "text", overlay: tuple[str, str] | None = None, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT
) -> DataFrame:
    """Documents with their runs, the strongest of them, and the text without repetitions.

    Adds n_words, n_runs; start, length and period of the run with most periods (null without one); runs; and collapsed: the words,
    joined by one space, without those that some run holds after its first period. `overlay` names two columns, a word number and a period:
    where both are given, the words from that number on are first replaced by repetitions of as many words from there.
    """
    carried = [c for c in docs.columns if c not in {text_col, *RESULTS.names, *(overlay or ())}]
    names = {c: f"__own_{k}" for k, c in enumerate(carried)}
    work = docs.select(*(docs[c].alias(a) for c, a in names.items()), docs[text_col].alias("text"), *(docs[c].cast("long").alias(f"__over_{k}") for k, c in enumerate(overlay or ())))
    over = tuple(f"__over_{k}" for k in range(2)) if overlay else None
    rules = {"min_length": min_length, "min_exponent": min_exponent}

    def run(batches):
        for batch in slices(batches, "text", _SLICE_BYTES):
            own = [batch.column(a) for a in names.values()]
            yield pa.RecordBatch.from_arrays([*own, *_judge(batch, over, rules)], names=[*names.values(), *RESULTS.names])

    schema = T.StructType([T.StructField(a, docs.schema[c].dataType) for c, a in names.items()] + RESULTS.fields)
    return work.mapInArrow(run, schema).withColumnsRenamed({a: c for c, a in names.items()})
