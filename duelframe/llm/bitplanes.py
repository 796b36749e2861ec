"""Token ids in files of compressed bit or byte planes.

A file holds blocks of a fixed number of ids. A block is transposed into planes (the k-th byte, or
the k-th bit, of every id), each plane is compressed alone with zstandard, and planes that are all
zero take no space. The footer holds the block index (offset, ids, length of every plane) and the
documents in file order with their number of ids.

Defined results: null or empty text is the end id alone; rows are written in ascending id order, null
ids first, rows of one id in text order; an empty table gives no file and no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duelframe.llm.common import byte_words, file_system, new_folder, saved, slices

MAGIC = b"TOKPLN01"
BLOCK_IDS = 1 << 16
MANIFEST = "path string, part long, n_docs long, n_ids long, n_bytes long"
_SLICE_BYTES = 12 << 20
_WORD_END = "</w>"
#: stretches of letters encoded as one text
_JOINED = 500


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """Planes of uint32 ids, lowest first; empty bytes for a plane of zeros."""
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    planes = [np.ascontiguousarray(raw[:, k]) for k in range(4)]
    if kind == "bit":
        planes = [np.packbits((p >> b) & 1) for p in planes for b in range(8)]
    return [p.tobytes() if p.any() else b"" for p in planes]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    """The ids of `to_planes`."""
    raw = np.zeros((n, 4), dtype=np.uint8)
    for k, plane in enumerate(planes):
        if plane and kind == "bit":
            raw[:, k // 8] |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n) << (k % 8)
        elif plane:
            raw[:, k] = np.frombuffer(plane, np.uint8)
    return raw.view("<u4").ravel()


class PlaneWriter:
    """Streams ids into one file; memory is one block and the document list."""

    def __init__(self, stream, kind: str, block_ids: int, level: int):
        self.stream, self.kind, self.block_ids = stream, kind, block_ids
        self.pack = zstandard.ZstdCompressor(level=level)
        self.pending: list[np.ndarray] = []
        self.n_pending = 0
        self.offset = stream.write(MAGIC)
        self.blocks: list[list] = []
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids))
        self.pending.append(ids)
        self.n_pending += len(ids)
        if self.n_pending >= self.block_ids:
            joined = np.concatenate(self.pending)
            full = len(joined) // self.block_ids * self.block_ids
            for begin in range(0, full, self.block_ids):
                self._block(joined[begin : begin + self.block_ids])
            self.pending, self.n_pending = [joined[full:]], len(joined) - full

    def _block(self, ids: np.ndarray) -> None:
        packed = [self.pack.compress(p) if p else b"" for p in to_planes(ids, self.kind)]
        self.blocks.append([self.offset, len(ids), [len(p) for p in packed]])
        for p in packed:
            self.offset += self.stream.write(p) if p else 0

    def close(self) -> int:
        if self.n_pending:
            self._block(np.concatenate(self.pending))
        footer = {"kind": self.kind, "blocks": self.blocks, "doc_ids": self.doc_ids, "lengths": self.lengths}
        packed = self.pack.compress(json.dumps(footer, separators=(",", ":")).encode())
        self.stream.write(packed)
        self.stream.write(len(packed).to_bytes(8, "little") + MAGIC)
        return self.offset + len(packed) + 16


def read_footer(stream) -> dict:
    size = stream.size()
    stream.seek(size - 16)
    tail = stream.read(16)
    if tail[8:] != MAGIC:
        raise ValueError("not a file of token planes")
    length = int.from_bytes(tail[:8], "little")
    stream.seek(size - 16 - length)
    return json.loads(zstandard.ZstdDecompressor().decompress(stream.read(length)))


def read_blocks(stream, footer: dict) -> Iterator[np.ndarray]:
    unpack = zstandard.ZstdDecompressor()
    for offset, n, lengths in footer["blocks"]:
        stream.seek(offset)
        yield from_planes([unpack.decompress(stream.read(k)) if k else b"" for k in lengths], n, footer["kind"])


def read_documents(stream) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) in file order, one block in memory besides the document at hand."""
    footer = read_footer(stream)
    blocks, rest = read_blocks(stream, footer), np.zeros(0, dtype="<u4")
    for doc_id, need in zip(footer["doc_ids"], footer["lengths"]):
        parts = [rest[:need]]
        have, rest = len(parts[0]), rest[need:]
        while have < need:
            block = next(blocks)
            parts.append(block[: need - have])
            rest = block[need - have :]
            have += len(parts[-1])
        yield doc_id, np.concatenate(parts) if len(parts) > 1 else parts[0]


class PieceCache:
    """White-space-free stretch of text -> its ids.

    The tokenizer's pre-tokens never cross white space, so a text's ids are those of its stretches in
    order. Two generations are kept: a stretch that is met again moves to the young one, and when that is full the
    old one, which holds what was not met for longest, is let go.
    """

    def __init__(self, tokenizer, limit: int = 1_000_000):
        self.tokenizer, self.limit = tokenizer, limit
        self.young: dict[bytes, np.ndarray] = {}
        self.old: dict[bytes, np.ndarray] = {}
        # which ids end a pre-token, where the vocabulary marks that
        vocabulary = tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(_WORD_END)]] = True

    def ids(self, stretches: list[bytes]) -> list[np.ndarray]:
        """Ids of distinct stretches."""
        young, old = self.young, self.old
        found = [young.get(s) for s in stretches]
        missing = [k for k, f in enumerate(found) if f is None]
        new = []
        for k in missing:
            known = old.get(stretches[k])
            if known is None:
                new.append(k)
            else:
                found[k] = young[stretches[k]] = known
        letters = [k for k in new if stretches[k].isalpha()] if self.ends.any() else []
        apart = self._joined(stretches, letters, found)
        apart += [k for k in new if not stretches[k].isalpha()] if self.ends.any() else new
        for begin in range(0, len(apart), 20_000):
            some = apart[begin : begin + 20_000]
            for k, one in zip(some, self.tokenizer.encode_batch_fast([stretches[k].decode("utf-8", "surrogatepass") for k in some], add_special_tokens=False)):
                found[k] = np.array(one.ids, dtype="<u4")
        for k in new:
            young[stretches[k]] = found[k]
        if len(young) > self.limit // 2:
            self.young, self.old = {}, young
        return found


    def _joined(self, stretches: list[bytes], places: list[int], found: list) -> list[int]:
        """Encode stretches of ASCII letters, each a pre-token, many in one text; the ids that end pre-tokens part them again.

        Fills `found` and returns the places where the parts are not as many as the stretches.
        """
        left: list[int] = []
        groups = [places[a : a + _JOINED] for a in range(0, len(places), _JOINED)]
        for begin in range(0, len(groups), 40):
            some = groups[begin : begin + 40]
            joined = [b"\n".join([stretches[k] for k in group]).decode("ascii") for group in some]
            for group, one in zip(some, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
                ids = np.array(one.ids, dtype="<u4")
                stop = np.flatnonzero(self.ends[ids]) + 1
                if len(stop) != len(group) or stop[-1] != len(ids):
                    left += group
                    continue
                for k, part in zip(group, np.split(ids, stop[:-1])):
                    found[k] = part
        return left


_ENCODERS: dict[str, PieceCache] = {}


def word_encoder(tokenizer_path: str) -> Callable[[list[str]], list[np.ndarray]]:
    """Encoder of a list of texts by a tokenizer file; one cache for each worker and file."""
    if tokenizer_path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _ENCODERS[tokenizer_path] = PieceCache(Tokenizer.from_file(tokenizer_path))
    cache = _ENCODERS[tokenizer_path]

    def encode(texts: list[str]) -> list[np.ndarray]:
        stretches, sizes = byte_words([t.encode("utf-8", "surrogatepass") for t in texts])
        coded = stretches.dictionary_encode()
        known = cache.ids(coded.dictionary.to_pylist())
        place = coded.indices.to_numpy(zero_copy_only=False)
        lengths = np.array([len(k) for k in known], dtype=np.int64)
        first = np.cumsum(lengths) - lengths
        pool = np.concatenate([*known, np.zeros(0, dtype="<u4")])
        n = lengths[place]
        upto = np.concatenate([[0], np.cumsum(n)])
        flat = pool[np.repeat(first[place] - upto[:-1], n) + np.arange(upto[-1])]
        cuts = upto[np.concatenate([[0], np.cumsum(sizes)])]
        return [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    return encode


def write_token_files(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 2,
    planes: str = "byte",
    block_ids: int = BLOCK_IDS,
    level: int = 3,
    folder: str | None = None,
) -> DataFrame:
    """Encode whole texts and write them in ascending id order, one file for each task.

    Returns the manifest (one row per file, in the order of `part`). Only files named there count, so
    what a lost or repeated task leaves behind is never read.
    """
    if planes not in ("bit", "byte"):
        raise ValueError("planes must be 'bit' or 'byte'")
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "token-planes")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id", "text").withColumn("part", F.spark_partition_id().cast("long"))

    def write(batches):
        encode, end, writer, part = word_encoder(tokenizer_path), np.array([end_id], dtype="<u4"), None, 0
        for batch in slices(batches, "text", _SLICE_BYTES):
            if writer is None:
                system, place = file_system(folder)
                system.create_dir(place, recursive=True)
                part = batch.column("part")[0].as_py()
                name = f"part-{part:06d}-{uuid.uuid4().hex}.tok"
                stream = system.open_output_stream(f"{place}/{name}")
                writer = PlaneWriter(stream, planes, block_ids, level)
            for doc_id, ids in zip(batch.column("id").to_pylist(), encode(batch.column("text").to_pylist())):
                writer.add(doc_id, np.concatenate([ids, end]))
        if writer is not None:
            size = writer.close()
            stream.close()
            yield pa.RecordBatch.from_pydict(
                {"path": [f"{folder}/{name}"], "part": [part], "n_docs": [len(writer.doc_ids)], "n_ids": [sum(writer.lengths)], "n_bytes": [size]}
            )

    return saved(ordered.mapInArrow(write, MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame, *, with_ids: bool = False) -> DataFrame:
    """Documents of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32[, ids].

    One file is read by one task, block by block. The manifest has a row per file, so its window is small.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("before", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    n_files = max(1, manifest.count())
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def read(batches):
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist()):
                system, place = file_system(path)
                with system.open_input_file(place) as stream:
                    out: list[tuple] = []
                    for doc_id, ids in read_documents(stream):
                        out.append((doc_id, start, len(ids), zlib.crc32(ids), ids))
                        start += len(ids)
                        if len(out) == 5_000:
                            yield _rows(out, with_ids)
                            out = []
                    if out:
                        yield _rows(out, with_ids)

    return files.repartition(n_files).mapInArrow(read, schema)


def _rows(out: list[tuple], with_ids: bool) -> pa.RecordBatch:
    names = ("doc_id", "start", "n_tokens", "ids_crc32")
    columns = {name: pa.array([row[k] for row in out], pa.int64()) for k, name in enumerate(names)}
    if with_ids:
        ends = np.cumsum([0, *(len(row[4]) for row in out)])
        values = pa.array(np.concatenate([row[4] for row in out]).astype(np.int32))
        columns["ids"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
    return pa.RecordBatch.from_pydict(columns)
