"""What the operators share: the shared folder, written steps, hashes of words, rows per task."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_FOLDER = "duelframe.llm.shared"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`.

    A folder of this machine is set only where the cluster names none and the master is local (tests).
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_OWN_FOLDER, None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and every executor can reach")
    own = f"file://{tempfile.mkdtemp(prefix='duelframe-llm-')}"
    spark.conf.set(_OWN_FOLDER, own)
    return own


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write a step to the shared folder and read it back, which cuts its lineage.

    What a task computed once, random row numbers and written files included, stays fixed from here on.
    """
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI of the shared folder, in the driver or in a task."""
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def remainder(id_column: Column, by: int) -> Column:
    """crc32 of the id as text, modulo `by`; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")), F.lit(by))


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def slices(batches: Iterator[pa.RecordBatch], size_of: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of one slice hold about `limit` bytes (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(size_of)), 0), dtype=np.int64)
        filled, begin = 0, 0
        for i in range(n):
            filled += int(lengths[i]) + 16
            if filled >= limit:
                yield batch.slice(begin, i + 1 - begin)
                filled, begin = 0, i + 1
        if begin < n:
            yield batch.slice(begin, n - begin)


_BYTE_KEYS = np.random.default_rng(20_231).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_RATIO = 0xD6E8FEB86659FD93
_POWERS = np.ones(1, dtype=np.uint64)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix64(h: np.ndarray) -> np.ndarray:
    """One-to-one scrambling of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    while len(_POWERS) < n:
        step = np.uint64(pow(_RATIO, len(_POWERS), 1 << 64))
        _POWERS = np.concatenate([_POWERS, _POWERS * step])
    return _POWERS


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in order, and how many words each text has.

    A-Z count as a-z; words are what stands between the six ASCII white-space characters.
    """
    raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    codes = np.frombuffer(b"\n".join([*raw, b""]), dtype=np.uint8)
    space = _IS_SPACE[codes]
    start = np.flatnonzero(np.concatenate([[True], space[:-1]]) & ~space) if len(codes) else np.zeros(0, np.int64)
    if not len(start):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts), dtype=np.int64)
    stop = np.flatnonzero(np.concatenate([~space[:-1] & space[1:], [False]])) + 1
    length = stop - start
    text_end = np.cumsum(np.array([len(r) + 1 for r in raw], dtype=np.int64))
    sizes = np.diff(np.searchsorted(start, text_end), prepend=0)
    letters = codes[~space]
    first = np.cumsum(length) - length
    place = np.arange(len(letters)) - np.repeat(first, length)
    terms = _BYTE_KEYS[letters] * _powers(int(length.max()))[place]
    return mix64(np.add.reduceat(terms, first)), sizes


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often a lambda in `use` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Texts with a distinct key, and (key, id, n_chars). The id is the key where ids are distinct.

    Where some id is null or repeated, rows are written once with a number of their own, which is then the key.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    lengths = saved(texts.select("id", F.length("text").cast("long").alias("n_chars")), "lengths")
    repeated = lengths.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or id is null")
    if repeated.limit(1).count():
        texts = saved(texts.withColumn("key", F.monotonically_increasing_id()), "numbered-texts")
        return texts, texts.select("key", "id", F.length("text").cast("long").alias("n_chars"))
    return texts.withColumn("key", F.col("id")), lengths.select(F.col("id").alias("key"), "id", "n_chars")


def byte_words(raw: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts in order as they stand, and each text's number of words."""
    codes = np.frombuffer(b"\n".join([*raw, b""]), dtype=np.uint8)
    space = _IS_SPACE[codes]
    inside = ~space
    start = np.flatnonzero(inside & np.concatenate([[True], space[:-1]])) if len(codes) else np.zeros(0, dtype=np.int64)
    length = np.flatnonzero(inside & np.concatenate([space[1:], [True]])) + 1 - start if len(codes) else start
    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(codes[inside]))])
    ends = np.cumsum(np.array([len(r) + 1 for r in raw], dtype=np.int64))
    return words, np.diff(np.searchsorted(start, ends), prepend=0)


def byte_hashes(values: pa.Array) -> np.ndarray:
    """64-bit hashes of the values of a large_binary array without nulls."""
    if not len(values):
        return np.zeros(0, dtype=np.uint64)
    offsets = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset : values.offset + len(values) + 1]
    length = np.diff(offsets)
    letters = np.frombuffer(values.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, dtype=np.uint8)
    place = np.arange(len(letters)) - np.repeat(offsets[:-1] - offsets[0], length)
    upto = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_BYTE_KEYS[letters] * _powers(int(length.max()) + 1)[place])])
    at = offsets - offsets[0]
    return mix64(upto[at[1:]] - upto[at[:-1]] + length.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
