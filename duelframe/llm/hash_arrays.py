"""Counts of 64-bit hashes as sorted arrays in the shared folder, looked up through memory maps.

Tasks count hashes, ranges of hashes go to one task each, and a range becomes a file of sorted keys with aligned
counts. Workers map the files and search sorted batches of keys, so a worker holds only the pages it touches
and the driver only the list of files.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelframe.llm.common import file_system, slices

FILES = "part long, low long, n long, path string"
SLICE_BYTES = 6 << 20
_HELD_KEYS = 4_000_000


def signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64)


def tally(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their summed counts."""
    k = np.concatenate(keys)
    order = np.argsort(k)
    k, c = k[order], np.concatenate(counts)[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(k) else c


def count_rows(of_texts: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], slice_bytes: int = SLICE_BYTES):
    """Task that adds up (distinct keys, counts) of slices of texts, with about `_HELD_KEYS` keys in memory, and yields (key, n)."""

    def emit(keys, counts):
        k, c = tally(keys, counts)
        for a in range(0, len(k), 200_000):
            yield pa.RecordBatch.from_arrays([signed(k[a : a + 200_000]), pa.array(c[a : a + 200_000].astype(np.int32))], names=["key", "n"])

    def run(batches):
        keys, counts, held = [], [], 0
        for batch in slices(batches, "text", slice_bytes):
            k, c = of_texts(batch.column("text").to_pylist())
            keys.append(k)
            counts.append(c)
            held += len(k)
            if held > _HELD_KEYS:
                yield from emit(keys, counts)
                keys, counts, held = [], [], 0
        if keys:
            yield from emit(keys, counts)

    return run


class SortedArrays:
    """Sorted hash ranges over files: keys, and aligned counts, mapped into memory.

    A file holds n keys and then n counts (both uint64). On a file system that is not mounted the
    file is copied to the worker first; the copy is unlinked at once and goes with the worker.
    """

    def __init__(self, files: list[tuple[int, int, int, str]]):
        self.low = np.array([f[1] for f in files], dtype=np.int64).view(np.uint64)
        self.first = np.cumsum([0, *(f[2] for f in files)])
        self.n = int(self.first[-1])
        self.files = files
        self.maps: list[np.ndarray | None] = [None] * len(files)

    def _map(self, k: int) -> np.ndarray:
        if self.maps[k] is None:
            system, place = file_system(self.files[k][3])
            if system.type_name == "local":
                self.maps[k] = np.memmap(place, dtype=np.uint8, mode="r")
            else:
                with tempfile.NamedTemporaryFile() as own, system.open_input_stream(place) as source:
                    while piece := source.read(8 << 20):
                        own.write(piece)
                    own.flush()
                    self.maps[k] = np.memmap(own.name, dtype=np.uint8, mode="r")
        return self.maps[k]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the whole order and counts of sorted keys; -1 and 0 for those that are absent."""
        places, counts = np.full(len(keys), -1, dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        cuts = np.append(np.searchsorted(keys, self.low), len(keys)) if len(self.low) else []
        for k, (_, _, n, _) in enumerate(self.files):
            own = keys[cuts[k] : cuts[k + 1]]
            if not len(own):
                continue
            raw = self._map(k)
            there, tallies = raw[: 8 * n].view(np.uint64), raw[8 * n : 16 * n].view(np.uint64)
            at = np.minimum(np.searchsorted(there, own), n - 1)
            hit = there[at] == own
            places[cuts[k] : cuts[k + 1]] = np.where(hit, at + self.first[k], -1)
            counts[cuts[k] : cuts[k + 1]] = np.where(hit, tallies[at], 0)
        return places, counts


def write_file(folder: str, keys: np.ndarray, counts: np.ndarray) -> str:
    system, place = file_system(folder)
    system.create_dir(place, recursive=True)
    name = f"{uuid.uuid4().hex}.arrays"
    with system.open_output_stream(f"{place}/{name}") as out:
        out.write(np.ascontiguousarray(keys, dtype="<u8"))
        out.write(np.ascontiguousarray(counts, dtype="<u8"))
    return f"{folder}/{name}"


def by_range(rows: DataFrame, parts: int) -> DataFrame:
    """Rows with the number of their hash range, dealt so that a range is in one task."""
    top = F.shiftrightunsigned(F.col("key"), 33)
    return rows.withColumn("part", F.floor(top * F.lit(parts) / F.lit(float(1 << 31))).cast("int")).repartition(parts, "part")


def file_list(rows: DataFrame) -> list[tuple[int, int, int, str]]:
    """File list in the order of ranges; a range is one file, so this is as small as the number of tasks."""
    return sorted((r["part"], r["low"], r["n"], r["path"]) for r in rows.where("path is not null").select("part", "low", "n", "path").collect())


def collect_ranges(batches):
    """Per range: joined keys and counts of a task's rows."""
    held: dict[int, tuple[list, list]] = {}
    for batch in batches:
        part = batch.column("part").to_numpy(zero_copy_only=False)
        key, n = unsigned(batch.column("key")), batch.column("n").to_numpy(zero_copy_only=False)
        for p in np.unique(part):
            own = part == p
            held.setdefault(int(p), ([], []))
            held[int(p)][0].append(key[own])
            held[int(p)][1].append(n[own].astype(np.int64))
    for p in list(held):
        yield p, *tally(*held.pop(p))


_OPEN: dict[str, SortedArrays] = {}


def opened(files) -> SortedArrays:
    """Mapped files, once for each worker; those of an earlier model are let go."""
    key = files[0][3] if files else ""
    if key not in _OPEN:
        if len(_OPEN) > 3:
            _OPEN.clear()
        _OPEN[key] = SortedArrays(files)
    return _OPEN[key]
