"""Suffix arrays, common prefixes and merging, in numpy.

The suffix array is refined by doubling: suffixes are sorted by their first characters, and only
groups that are still tied are sorted again by the rank of what follows, so that the compared length
doubles each time. Common prefixes follow Kasai's recurrence, run over many stretches in step.
"""

from __future__ import annotations

import numpy as np

_LANES = 4096


def _first_keys(codes: np.ndarray) -> tuple[np.ndarray, int, int]:
    """Sort keys of the first characters of each suffix, as many as fit into 63 bits, how many these are, and bits of one."""
    if int(codes.max()) >= 1 << 12:
        codes = np.unique(codes, return_inverse=True)[1]
    bits = max(1, int(codes.max() + 1).bit_length())
    held = max(1, 63 // bits)
    padded = np.concatenate([codes + 1, np.zeros(held, dtype=np.int64)])  # 0: past the end
    key = np.zeros(len(codes), dtype=np.int64)
    for k in range(held):
        key = (key << bits) | padded[k : k + len(codes)]
    return key, held, bits


def doubling_suffix_array(codes: np.ndarray, depth: int, ends: np.ndarray | None = None) -> np.ndarray:
    """Order of the suffixes of `codes` (not negative) by their first `depth` characters (ties in any order).

    `ends` are places of end marks. They have one code but count as different, earlier ones as smaller.
    """
    n = len(codes)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    key, reach, bits = _first_keys(codes)
    if ends is None or not len(ends):
        order = np.argsort(key)
        mark = None
    else:
        # which end mark is among the first characters, if one is
        following = np.searchsorted(ends, np.arange(n))
        near = np.minimum(following, len(ends) - 1)
        away = ends[near] - np.arange(n)
        marked = (following < len(ends)) & (away < reach)
        mark = np.where(marked, near + 1, 0)
        # the number of the mark decides, so nothing behind it may take part
        behind = np.where(marked, bits * (reach - 1 - away), 0)
        key = (key >> behind) << behind
        order = np.lexsort((mark, key))
    head = np.empty(n, dtype=bool)
    head[0], head[1:] = True, key[order[1:]] != key[order[:-1]]
    if mark is not None:
        head[1:] |= mark[order[1:]] != mark[order[:-1]]
    del key, mark
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    tied = _tied(head)
    while reach < depth and len(tied):
        suffixes = order[tied]
        both = rank[suffixes] * (n + 2) + rank[np.minimum(suffixes + reach, n)] + 1  # group, then what follows
        again = np.argsort(both)
        suffixes, both = suffixes[again], both[again]
        order[tied] = suffixes
        new = np.empty(len(tied), dtype=bool)
        new[0], new[1:] = True, both[1:] != both[:-1]
        rank[suffixes] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
        alone = new.copy()
        alone[:-1] &= new[1:]
        tied = tied[~alone]
        reach *= 2
    return order


def _tied(head: np.ndarray) -> np.ndarray:
    """Places whose group has two members or more."""
    alone = head.copy()
    alone[:-1] &= head[1:]
    return np.flatnonzero(~alone)


def common_prefixes(codes: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of each suffix with the one before it in `order`, up to `depth`.

    Kasai: going through the text, the length falls by one at most from a place to the next, so each
    place starts from what the last one left. The text is cut into stretches that go in step. The
    order must be that of whole suffixes.
    """
    n = len(codes)
    previous = np.full(n, -1, dtype=np.int64)
    previous[order[1:]] = order[:-1]
    padded = np.concatenate([codes, np.full(depth + 1, np.iinfo(np.int64).min, dtype=np.int64)])
    found = np.zeros(n, dtype=np.int32)
    length = -(-n // _LANES)
    lane = np.arange(0, n, length)
    carry = np.zeros(len(lane), dtype=np.int64)
    for step in range(length):
        at = lane + step
        inside = at < n
        at, h = at[inside], carry[inside]
        before = previous[at]
        h = np.where(before < 0, 0, np.maximum(h, 0))
        grow = np.flatnonzero((before >= 0) & (h < depth))
        while len(grow):
            grow = grow[padded[at[grow] + h[grow]] == padded[before[grow] + h[grow]]]
            h[grow] += 1
            grow = grow[h[grow] < depth]
        found[at] = h
        carry[inside] = h - 1
    return found[order]


def merge_sorted(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in `second` (sorted, distinct) of the entries of `first` by binary search, and which are there."""
    place = np.minimum(np.searchsorted(second, first), max(0, len(second) - 1))
    return place, (second[place] == first) if len(second) else np.zeros(len(first), dtype=bool)
