"""SentencePiece encoding and decoding by suffix arrays.

The texts of a batch fall into units that no piece can cross (a run of word marks and the text up to
the next one). Units not seen before are concatenated and their suffixes sorted as deep as the
longest piece; a binary search gives every piece its range of suffixes, that is all its occurrences.
These edges are sorted by position and relaxed: in every unit the best edge over two neighbouring
symbols is taken until none is left, which is the library's own order of merges. Characters without
a piece become byte pieces.

Defined results: null or empty text has no ids and decodes to the empty text; repeated rows are
encoded alike; an empty table gives an empty result; other columns stay as they are.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duelframe.llm.common import slices
from duelframe.llm.suffixes import doubling_suffix_array

MARK = "▁"
_UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_SLICE_BYTES = 4 << 20
_RELAX_CHARS = 200_000
_LOCKSTEP_UNIT = 64
_NONE = np.iinfo(np.int64).max


class Pieces:
    """Vocabulary of a SentencePiece BPE file as arrays."""

    def __init__(self, model_path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        every = range(model.get_piece_size())
        normal = [i for i in every if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.text = {i: model.id_to_piece(i) for i in normal}
        crossing = [p for p in self.text.values() if MARK in p.lstrip(MARK)]
        if crossing:
            raise ValueError("pieces with a word mark inside cannot be encoded unit by unit")
        self.ids = np.array(normal, dtype=np.int32)
        self.longest = max(len(p) for p in self.text.values())
        scores = np.array([model.get_score(i) for i in normal])
        order = np.argsort(-scores, kind="stable")
        self.rank = np.empty(len(normal), dtype=np.int64)  # 0: merged first
        self.rank[order] = np.arange(len(normal))
        self.id_of_rank = self.ids[order]
        self.codes = np.zeros((len(normal), self.longest), dtype=np.int64)
        self.length = np.array([len(self.text[i]) for i in normal], dtype=np.int64)
        for row, i in enumerate(normal):
            self.codes[row, : len(self.text[i])] = [ord(c) + 1 for c in self.text[i]]
        self.single = {self.text[i]: i for i in normal if len(self.text[i]) == 1}
        self.char_codes = np.array(sorted(ord(c) + 1 for c in self.single), dtype=np.int64)
        self.char_ids = np.array([self.single[chr(c - 1)] for c in self.char_codes], dtype=np.int32)
        self.byte = {int(model.id_to_piece(i)[3:5], 16): i for i in every if model.is_byte(i)}
        self.unknown = model.unk_id()
        decoded = {i: p.replace(MARK, " ").encode() for i, p in self.text.items()}
        decoded |= {i: bytes([b]) for b, i in self.byte.items()}
        self.decoded = [decoded.get(i, b"") for i in every]

    def of_char(self, char: str) -> list[int]:
        if char in self.single:
            return [self.single[char]]
        return [self.byte.get(b, self.unknown) for b in char.encode("utf-8", "surrogatepass")]


def occurrences(pieces: Pieces, codes: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one-past-last place in the suffix order of every piece, by binary search."""
    n, deep = len(codes), pieces.longest
    padded = np.concatenate([codes, np.zeros(deep, dtype=np.int64)])
    inside = np.arange(deep) < pieces.length[:, None]

    def compare(at: np.ndarray) -> np.ndarray:
        """-1, 0, 1 for the suffixes at these places against the pieces, over a piece's length."""
        window = padded[order[at][:, None] + np.arange(deep)]
        differs = (window != pieces.codes) & inside
        first = differs.argmax(axis=1)
        rows = np.arange(len(at))
        sign = np.sign(window[rows, first] - pieces.codes[rows, first])
        return np.where(differs[rows, first], sign, 0)

    found = []
    for upper in (False, True):
        low, high = np.zeros(len(pieces.length), dtype=np.int64), np.full(len(pieces.length), n, dtype=np.int64)
        while (low < high).any():
            middle = np.minimum((low + high) // 2, n - 1)
            sign = compare(middle)
            right = (sign <= 0) if upper else (sign < 0)
            going = low < high
            low = np.where(going & right, middle + 1, low)
            high = np.where(going & ~right, middle, high)
        found.append(low)
    return found[0], found[1]


def edges(pieces: Pieces, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and merge rank of every occurrence of a piece of two characters or more, by start."""
    order = doubling_suffix_array(codes, pieces.longest)
    low, high = occurrences(pieces, codes, order)
    counts = np.where(pieces.length > 1, high - low, 0)
    which = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = order[low[which] + within]
    by_place = np.argsort(start, kind="stable")
    return start[by_place], pieces.length[which][by_place], pieces.rank[which][by_place]


def relax(table: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit and start of every symbol of adjoining units, in order; all units go a merge at a time.

    table[start, length] is the merge rank of the edge, or `_NONE`.
    """
    sizes = ends - begins
    unit = np.repeat(np.arange(len(begins)), sizes)
    starts = np.arange(len(unit)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + begins[unit]
    deep = table.shape[1] - 1
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(starts):
        n = len(starts)
        last = np.empty(n, dtype=bool)
        last[:-1], last[-1] = unit[1:] != unit[:-1], True
        stop = ends[unit]  # end of the pair that begins here
        inner = np.flatnonzero(~last[:-2] & ~last[1:-1])
        stop[inner] = starts[inner + 2]
        length = stop - starts
        fits = ~last & (length <= deep)
        rank = np.where(fits, table[starts, np.where(fits, length, 0)], _NONE)
        first = np.flatnonzero(np.concatenate([[True], last[:-1]]))
        best = np.minimum.reduceat(np.where(rank == _NONE, _NONE, (rank << 32) | np.arange(n)), first)
        over = best == _NONE
        keep = np.ones(n, dtype=bool)
        keep[(best[~over] & 0xFFFFFFFF) + 1] = False  # the right symbol of the best pair goes
        if over.any():
            settled = np.repeat(over, np.diff(np.append(first, n)))
            done.append((unit[settled], starts[settled]))
            keep &= ~settled
        starts, unit = starts[keep], unit[keep]
    unit, starts = (np.concatenate(x) for x in zip(*done)) if done else (unit, starts)
    order = np.lexsort((starts, unit))
    return unit[order], starts[order]


def relax_long(ranks: dict[int, dict[int, int]], begin: int, end: int) -> np.ndarray:
    """The same for one long unit, with a heap of pairs; ranks[start][length] is the merge rank."""
    after = {i: i + 1 for i in range(begin, end)}
    before = {i: i - 1 for i in range(begin, end)}
    heap: list[tuple[int, int, int, int]] = []

    def offer(left: int) -> None:
        middle = after[left]
        if middle < end:
            stop = after[middle]
            rank = ranks.get(left, {}).get(stop - left)
            if rank is not None:
                heapq.heappush(heap, (rank, left, middle, stop))

    for i in range(begin, end):
        offer(i)
    while heap:
        _, left, middle, stop = heapq.heappop(heap)
        if after.get(left) != middle or after.get(middle) != stop:
            continue
        after[left] = stop
        del after[middle]
        if stop < end:
            before[stop] = left
        offer(left)
        if left > begin:
            offer(before[left])
    return np.array(sorted(after), dtype=np.int64)


class UnitEncoder(dict):
    """Unit -> its ids as little-endian bytes; the store starts anew when it is full."""

    def __init__(self, model_path: str, limit: int = 600_000):
        super().__init__()
        self.pieces, self.limit = Pieces(model_path), limit

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [_UNIT.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        wanted = set().union(*split)
        new = list(wanted.difference(self))
        if len(self) + len(new) > self.limit:
            self.clear()
            new = list(wanted)
        if new:
            self._learn(new)
        return [np.frombuffer(b"".join(map(self.__getitem__, units)), dtype="<i4") for units in split]

    def _learn(self, units: list[str]) -> None:
        short = [u for u in units if len(u) <= _LOCKSTEP_UNIT]
        units = short + [u for u in units if len(u) > _LOCKSTEP_UNIT]
        # one character between units that no piece holds
        codes = np.frombuffer("\0".join(units).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64) + 1
        sizes = np.array([len(u) for u in units], dtype=np.int64)
        begins = np.cumsum(sizes + 1) - sizes - 1
        start, length, rank = edges(self.pieces, codes)
        step_of = np.cumsum(sizes[: len(short)] + 1) // _RELAX_CHARS
        cuts = [0, *(np.flatnonzero(np.diff(step_of)) + 1), len(short)] if short else []
        for a, b in zip(cuts[:-1], cuts[1:]):
            self._short(units[a:b], codes, begins[a:b], sizes[a:b], start, length, rank)
        for u in range(len(short), len(units)):
            self[units[u]] = self._long(units[u], begins[u], start, length, rank)

    def _short(self, units, codes, begins, sizes, start, length, rank) -> None:
        base, top = begins[0], begins[-1] + sizes[-1]
        i, j = np.searchsorted(start, [base, top])
        table = np.full((top - base, self.pieces.longest + 1), _NONE, dtype=np.int64)
        table[start[i:j] - base, length[i:j]] = rank[i:j]
        ends = begins + sizes - base
        unit, at = relax(table, begins - base, ends)
        stop = ends[unit]
        inner = np.flatnonzero(unit[1:] == unit[:-1])
        stop[inner] = at[inner + 1]
        size = stop - at
        one = size == 1
        ids = np.zeros(len(at), dtype="<i4")
        ids[~one] = self.pieces.id_of_rank[table[at[~one], size[~one]]]
        place = np.minimum(np.searchsorted(self.pieces.char_codes, codes[at[one] + base]), len(self.pieces.char_codes) - 1)
        known = self.pieces.char_codes[place] == codes[at[one] + base]
        ids[one] = np.where(known, self.pieces.char_ids[place], -1)
        cut = np.searchsorted(unit, np.arange(len(units) + 1)).tolist()
        raw = ids.tobytes()
        for k, name in enumerate(units):
            self[name] = raw[4 * cut[k] : 4 * cut[k + 1]]
        for k in np.unique(unit[np.flatnonzero(one)[~known]]):  # characters without a piece
            found: list[int] = []
            for x, place_ in zip(ids[cut[k] : cut[k + 1]].tolist(), at[cut[k] : cut[k + 1]].tolist()):
                found += [x] if x >= 0 else self.pieces.of_char(units[k][place_ + base - begins[k]])
            self[units[k]] = np.array(found, dtype="<i4").tobytes()

    def _long(self, name: str, begin, start, length, rank) -> bytes:
        p, q = np.searchsorted(start, [begin, begin + len(name)])
        ranks: dict[int, dict[int, int]] = {}
        for s, n, r in zip((start[p:q] - begin).tolist(), length[p:q].tolist(), rank[p:q].tolist()):
            ranks.setdefault(s, {})[n] = r
        cuts = relax_long(ranks, 0, len(name)).tolist()
        found: list[int] = []
        for s, e in zip(cuts, [*cuts[1:], len(name)]):
            found += self.pieces.of_char(name[s]) if e - s == 1 else [int(self.pieces.id_of_rank[ranks[s][e - s]])]
        return np.array(found, dtype="<i4").tobytes()

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.pieces.decoded.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_ENCODERS: dict[str, UnitEncoder] = {}


def encoder(model_path: str) -> UnitEncoder:
    """One encoder for each worker and file."""
    if model_path not in _ENCODERS:
        _ENCODERS[model_path] = UnitEncoder(model_path)
    return _ENCODERS[model_path]


def encode_texts(
    docs: DataFrame,
    model_path: str,
    *,
    text_col: str = "text",
    ids_col: str = "ids",
    decoded_col: str | None = None,
    round_trip_col: str | None = None,
) -> DataFrame:
    """Every row with the ids of its whole text, and with what they decode to where that is asked for.

    Row-local: nothing is shuffled. A text with word marks of its own or with a lone surrogate decodes to spaces
    or replacement characters there, as in the library.
    """
    added = [(ids_col, T.ArrayType(T.IntegerType()))]
    added += [(decoded_col, T.StringType())] if decoded_col else []
    added += [(round_trip_col, T.BooleanType())] if round_trip_col else []
    clash = [name for name, _ in added if name in docs.columns]
    if clash:
        raise ValueError(f"columns are there already: {clash}")
    schema = T.StructType([*docs.schema.fields, *(T.StructField(name, kind) for name, kind in added)])

    def run(batches):
        own = encoder(model_path)
        for batch in slices(batches, text_col, _SLICE_BYTES):
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            found = own.encode(texts)
            ends = pa.array(np.cumsum([0, *(len(x) for x in found)]), pa.int32())
            new = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found) if found else [], pa.int32()))]
            if decoded_col or round_trip_col:
                decoded = [own.decode(x) for x in found]
                new += [pa.array(decoded)] if decoded_col else []
                new += [pa.array([d == t for d, t in zip(decoded, texts)])] if round_trip_col else []
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)


def decode_ids(rows: DataFrame, model_path: str, *, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Every row with the text of its ids; null ids give null."""
    schema = T.StructType([*rows.schema.fields, T.StructField(text_col, T.StringType())])

    def run(batches):
        own = encoder(model_path)
        for batch in batches:
            texts = [None if x is None else own.decode(np.array(x, dtype=np.int64)) for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[f.name for f in schema.fields])

    return rows.mapInArrow(run, schema)
