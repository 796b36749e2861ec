"""Fingerprints of files and tables."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence
from urllib.parse import quote, urlparse

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelframe.operators.quality import DataCheckError
from duelframe.session import shuffle_width


#: file systems that tasks can read in pieces
_STREAMED = ("", "file", "hdfs", "s3", "gs")
_PIECE = 8 << 20


def _hash_pieces(batches):
    """SHA-256 of the files of a task, a piece of a file in memory at a time."""
    for batch in batches:
        digests = []
        for path in batch.column("path").to_pylist():
            if urlparse(path).scheme in ("", "file"):
                system, place = fs.LocalFileSystem(), re.sub("^file:/*", "/", path)
            else:
                system, place = fs.FileSystem.from_uri(quote(path, safe=":/"))
            digest = hashlib.sha256()
            with system.open_input_stream(place) as stream:
                while piece := stream.read(_PIECE):
                    digest.update(piece)
            digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(digests, pa.string()), batch.column("size_bytes")], names=["path", "sha256", "size_bytes"])


def file_fingerprints(spark: SparkSession, paths: Sequence[str] | str, *, pattern: str | None = None) -> DataFrame:
    """Path, SHA-256 and size of each file; files are hashed in parallel tasks, piece by piece, whatever their size.

    Files of a store that only Spark can open are read as one cell each, which must stay under 2 GB. Spark's reader
    does not list empty files, so they have no row.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    listed = [paths] if isinstance(paths, str) else list(paths)
    files = reader.load(listed)
    if any(urlparse(p).scheme not in _STREAMED for p in listed):
        return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"))
    # only names and lengths are listed here; the contents are opened by the tasks that hash them
    named = files.select("path", F.col("length").alias("size_bytes")).repartition(shuffle_width(spark), "path")
    return named.mapInArrow(_hash_pieces, "path string, sha256 string, size_bytes long")


def relative_to(files: DataFrame, root: str) -> DataFrame:
    """Paths below a root, without the root itself."""
    base = root.rstrip("/") + "/"
    return files.withColumn("path", F.regexp_extract("path", f"^.*?\\Q{base}\\E(.*)$", 1))


def combined_digest(files: DataFrame, *, digits: int = 3) -> DataFrame:
    """One digest over (path, digest, size) of any number of files.

    Files fall into 16 ** digits buckets by the md5 of their path; every bucket hashes its sorted
    lines, and the digest covers the sorted bucket digests. No list grows past its
    bucket, and the result does not depend on the order of files.
    """
    line = F.concat_ws("\x00", "path", "sha256", F.col("size_bytes").cast("string"))
    per_bucket = (
        files.select(F.substring(F.md5("path"), 1, digits).alias("bucket"), line.alias("line"))
        .groupBy("bucket")
        .agg(F.sha2(F.array_join(F.sort_array(F.collect_list("line")), "\n"), 256).alias("digest"))
    )
    ordered = F.sort_array(F.collect_list(F.struct("bucket", "digest")))
    return per_bucket.agg(
        F.sha2(F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["bucket"], s["digest"])), "\n"), 256).alias("combined_sha256")
    )


def digest_mismatches(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Files whose digest differs from the expected one, is missing, or is malformed.

    `expected` has path and sha256.
    """
    wanted = expected.select("path", F.lower(F.trim("sha256")).alias("expected"))
    joined = files.join(wanted, "path", "full_outer")
    finding = (
        F.when(F.col("expected").isNotNull() & ~F.col("expected").rlike("^[0-9a-f]{64}$"), F.lit("bad_digest"))
        .when(F.col("sha256").isNull(), F.lit("missing_file"))
        .when(F.col("expected").isNull(), F.lit("unexpected_file"))
        .when(F.col("sha256") != F.col("expected"), F.lit("mismatch"))
    )
    return joined.select("path", "sha256", "expected", finding.alias("finding")).where("finding IS NOT NULL")


def table_fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Content digest of a table: schema, row count and order-free row hashes.

    Spark rows have no order, so equal multisets of rows give equal digests.
    Partial sums combine inside the tasks; one row leaves each of them.
    """
    names = list(columns or df.columns)
    selected = df.select(*[f"`{n}`" for n in names])
    schema = "\x1f".join(f"{f.name}:{f.dataType.simpleString()}" for f in selected.schema.fields)
    columns_ = [F.col(f"`{n}`") for n in names]
    # a marker per null keeps (null, 'a') and ('a', null) apart
    marks = F.concat(*[F.when(c.isNull(), F.lit("1")).otherwise(F.lit("0")) for c in columns_])
    first, second = F.xxhash64(*columns_, marks), F.xxhash64(F.lit(7919), marks, *reversed(columns_))
    one_row = selected.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum(first.cast("decimal(20,0)")).alias("h1"),
        F.bit_xor(second).alias("h2"),
    )
    text = F.concat_ws("\x1e", F.lit(schema), F.col("row_count").cast("string"), F.coalesce(F.col("h1").cast("string"), F.lit("")), F.coalesce(F.col("h2").cast("string"), F.lit("")))
    return one_row.select("row_count", F.sha2(text, 256).alias("table_sha256"))


def row_sums(df: DataFrame, columns: Sequence[str] | None = None, *, by: Sequence[str] = ()) -> DataFrame:
    """Row count and sums of both halves of each row's md5, for the whole table or for each value of `by`.

    The sums of two sets of rows add up to those of their union, and what left a table can be taken off again, so
    a partition that did not change is never read a second time. Rows are text with a mark per null; sums
    are exact up to 10 ** 18 rows, and are added up inside the tasks first.
    """
    names = list(columns or df.columns)
    cells = [F.coalesce(F.concat(F.lit("1"), F.col(f"`{n}`").cast("string")), F.lit("0")) for n in names]
    hashed = df.select(*(f"`{c}`" for c in by), F.md5(F.concat_ws("\x1f", *cells)).alias("__h"))
    half = lambda at: F.sum(F.conv(F.substring("__h", at, 16), 16, 10).cast("decimal(20,0)"))
    sums = [F.count(F.lit(1)).alias("row_count"), *(F.coalesce(half(at), F.lit(0)).cast("decimal(38,0)").alias(name) for at, name in ((1, "high_sum"), (17, "low_sum")))]
    return hashed.groupBy(*(f"`{c}`" for c in by)).agg(*sums) if by else hashed.agg(*sums)


def combined_sums(added: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """One row of sums out of many: those of `added` less those of `removed`."""
    fields = ("row_count", "high_sum", "low_sum")
    signed = added.select(*fields)
    if removed is not None:
        signed = signed.unionByName(removed.select(*((-F.col(c)).alias(c) for c in fields)))
    kinds = {"row_count": "bigint"}
    return signed.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast(kinds.get(c, "decimal(38,0)")).alias(c) for c in fields))


def sums_digest(sums: DataFrame, schema: str) -> DataFrame:
    """The digest of a table from its sums and a text that names its columns."""
    text = F.concat_ws("\x1e", F.lit(schema), *(F.col(c).cast("string") for c in ("row_count", "high_sum", "low_sum")))
    return sums.select("row_count", F.sha2(text, 256).alias("table_sha256"))


def changed_partitions(recorded: DataFrame, current: DataFrame, by: Sequence[str]) -> DataFrame:
    """Partitions whose sums differ, that are new or that are gone; nulls among `by` are values."""
    keyed = lambda df, name: df.select(F.struct(*(f"`{c}`" for c in by)).alias("__k"), F.struct("row_count", "high_sum", "low_sum").alias(name))
    joined = keyed(recorded, "__was").join(keyed(current, "__is"), "__k", "full_outer")
    finding = F.when(F.col("__was").isNull(), F.lit("new")).when(F.col("__is").isNull(), F.lit("gone")).when(F.col("__was") != F.col("__is"), F.lit("changed"))
    out = joined.select(*(F.col(f"__k.`{c}`").alias(c) for c in by), "__was.row_count", F.col("__is.row_count").alias("current_count"), finding.alias("finding"))
    return out.withColumnRenamed("row_count", "recorded_count").where("finding IS NOT NULL")


def lineage_digest(assets: DataFrame, catalogue_sha256: str) -> DataFrame:
    """Digest over sorted (asset, digest) pairs and the feature catalogue.

    `assets` has name and sha256, one row per input table.
    """
    ordered = F.sort_array(F.collect_list(F.struct("name", "sha256")))
    body = F.array_join(F.transform(ordered, lambda s: F.concat(s["name"], F.lit("\x00"), s["sha256"], F.lit("\n"))), "")
    return assets.agg(F.sha2(F.concat(body, F.lit(catalogue_sha256)), 256).alias("combined_sha256"))


def verify_lineage(recorded: dict, current: dict) -> list[str]:
    """Names of the lineage fields that differ."""
    return sorted(k for k in set(recorded) | set(current) if recorded.get(k) != current.get(k))


def assert_lineage(recorded: dict, current: dict) -> None:
    wrong = verify_lineage(recorded, current)
    if wrong:
        raise DataCheckError(f"the data does not match the recorded run: {wrong}")
