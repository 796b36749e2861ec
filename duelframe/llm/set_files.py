"""Shingle sets in files of the shared folder, compared by tasks that map them into memory.

Only ids and places of sets move through joins, never the sets.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelframe.llm.common import file_system, new_folder, saved, slices, width
from duelframe.llm.hash_arrays import FILES, by_range, collect_ranges, file_list, opened, unsigned, write_file

#: 64-bit words of the bitmap of a symmetric difference
DIFFERENCE_WORDS = 8
_SLICE_BYTES = 1 << 20
_MAPS: dict[str, np.ndarray] = {}


def wanted_ids(ids: DataFrame, label: str) -> list[tuple[int, int, int, str]]:
    """Files of the sorted hashes of ids (column id)."""
    folder = new_folder(ids.sparkSession, label)

    def write(batches):
        for p, keys, counts in collect_ranges(batches):
            yield pa.RecordBatch.from_pydict({"part": [p], "low": [int(keys[:1].view(np.int64)[0])], "n": [len(keys)], "path": [write_file(folder, keys, counts)]})

    keyed = ids.select(F.xxhash64("id").alias("key"), F.lit(1).alias("n")).distinct()
    return file_list(saved(by_range(keyed, width(ids.sparkSession)).mapInArrow(write, FILES), label))


def without_ids(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """Rows whose key (a long) is not among the ids of `gone` (column id); rows without a key stay.

    Rows are kept or dropped where they are, by search in the sorted hash files of the ids: no text enters an exchange,
    however many ids there are. The hash of one long is one-to-one.
    """
    files = wanted_ids(gone, "gone")

    @F.arrow_udf("boolean")
    def is_gone(hashes: pa.Array) -> pa.Array:
        keys = unsigned(hashes)
        order = np.argsort(keys)
        found = np.zeros(len(keys), dtype=bool)
        found[order] = opened(files).find(keys[order])[1] > 0
        return pa.array(found)

    # only the hash goes to Python; the row waits in the JVM
    return rows.where(F.col(key).isNull() | ~is_gone(F.xxhash64(F.col(key)))) if files else rows


def write_sets(texts: DataFrame, files, sets_of, label: str) -> DataFrame:
    """(id, path, at, n): where the set of each wanted document is. `texts` holds id and text; one pass, no shuffle."""
    folder = new_folder(texts.sparkSession, label)

    def run(batches):
        stream, name, at = None, "", 0
        for batch in slices(batches, "text", _SLICE_BYTES):
            if not files:
                continue
            keys = batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64)
            order = np.argsort(keys)
            own = np.zeros(len(keys), dtype=bool)
            own[order] = opened(files).find(keys[order])[1] > 0
            own = np.flatnonzero(own)
            if not len(own):
                continue
            if stream is None:
                system, place = file_system(folder)
                system.create_dir(place, recursive=True)
                name = f"{uuid.uuid4().hex}.sets"
                stream = system.open_output_stream(f"{place}/{name}")
            some = batch.take(pa.array(own))
            sets = sets_of(some.column("text").to_pylist())
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            stream.write(np.ascontiguousarray(np.concatenate(sets), dtype="<u8"))
            starts = at + np.cumsum(sizes) - sizes
            at += int(sizes.sum())
            yield pa.RecordBatch.from_arrays(
                [some.column("id"), pa.array([f"{folder}/{name}"] * len(sets)), pa.array(starts), pa.array(sizes)], names=["id", "path", "at", "n"]
            )
        if stream is not None:
            stream.close()

    rows = texts.select("id", "text", F.xxhash64("id").alias("key"))
    return saved(rows.mapInArrow(run, "id long, path string, at long, n long"), label)


def _mapped(path: str) -> np.ndarray:
    if path not in _MAPS:
        if len(_MAPS) > 4096:
            _MAPS.clear()
        system, place = file_system(path)
        if system.type_name == "local":
            _MAPS[path] = np.memmap(place, dtype="<u8", mode="r")
        else:
            with system.open_input_file(place) as source:
                _MAPS[path] = np.frombuffer(source.read(), dtype="<u8")
    return _MAPS[path]


def _bitmap(one: np.ndarray, two: np.ndarray) -> tuple[int, np.ndarray]:
    """Number of bits and bitmap of the hashes that are in one of two sets only."""
    bits = np.zeros(64 * DIFFERENCE_WORDS, dtype=np.uint8)
    bits[(np.setxor1d(one, two, assume_unique=True) >> np.uint64(40)) % np.uint64(len(bits))] = 1
    return int(bits.sum()), np.packbits(bits).view(np.int64)


def shared_sizes(pairs: DataFrame, places: DataFrame, *, differences: bool = False) -> DataFrame:
    """Every pair (a, b, other columns) with met, n_a, n_b: sizes of the intersection and of both sets.

    With `differences`, also a bitmap of the symmetric difference (d_0, d_1, ...) and its number of bits. An id with several rows in `places` (a repeated id) is compared once a row.
    """
    left = places.select(F.col("id").alias("a"), F.col("path").alias("path_a"), F.col("at").alias("at_a"), F.col("n").alias("n_a"))
    right = places.select(F.col("id").alias("b"), F.col("path").alias("path_b"), F.col("at").alias("at_b"), F.col("n").alias("n_b"))
    rows = pairs.join(left, "a").join(right, "b")
    passed = [*pairs.columns, "n_a", "n_b"]
    extra = ["bits", *(f"d_{k}" for k in range(DIFFERENCE_WORDS))] if differences else []
    schema = ", ".join(f"{n} {t}" for n, t in pairs.dtypes) + ", n_a long, n_b long, met long" + "".join(f", {n} long" for n in extra)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = {n: batch.column(n).to_pylist() for n in ("path_a", "at_a", "n_a", "path_b", "at_b", "n_b")}
            met, maps, last, one = [], [], None, None
            for path_a, at_a, n_a, path_b, at_b, n_b in zip(*columns.values()):
                if (path_a, at_a) != last:
                    one, last = np.asarray(_mapped(path_a)[at_a : at_a + n_a]), (path_a, at_a)
                two = np.asarray(_mapped(path_b)[at_b : at_b + n_b])
                if differences:
                    count, words = _bitmap(one, two)
                    maps.append([count, *words.tolist()])
                if not len(one) or not len(two):
                    met.append(0)
                    continue
                place = np.minimum(np.searchsorted(one, two), len(one) - 1)
                met.append(int((one[place] == two).sum()))
            more = [pa.array(column, pa.int64()) for column in zip(*maps)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in passed), pa.array(met, pa.int64()), *more], names=[*passed, "met", *extra])

    return rows.mapInArrow(run, schema)
