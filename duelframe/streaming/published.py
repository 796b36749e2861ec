"""Snapshot versions published once and looked up by every micro-batch.

A version is four Parquet tables, each split by a bucket of its key: ids, search keys, display names and the snapshot rows
themselves. A micro-batch works out which buckets its requests fall into (never more than there are buckets) and reads only
those folders, so what a batch reads follows from its requests and not from the history of all entities. The
table that names the version is written last: a version without it does not exist, and publishing it again
replaces what a lost job left behind.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duelframe import fixed_values as fv
from duelframe.functions.text import id_key, name_key
from duelframe.operators import identity

BUCKETS = 64
_BUCKET = "__bucket"


def _bucket(key: Column, buckets: int) -> Column:
    """Bucket of a text key; missing keys are in bucket 0."""
    return F.when(key.isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets))).cast("int")


@dataclass(frozen=True)
class Published:
    """A published version, opened for reading."""

    spark: SparkSession
    folder: str
    buckets: int
    ascii_names: bool

    def _table(self, name: str, keys: DataFrame | None = None) -> DataFrame:
        """A table, or only the folders that hold the given keys (a table with one column)."""
        found = self.spark.read.parquet(f"{self.folder}/{name}")
        if keys is not None:
            wanted = keys.select(_bucket(F.col(keys.columns[0]), self.buckets).alias("b")).distinct()
            found = found.where(F.col(_BUCKET).isin([r["b"] for r in wanted.collect()]))
        return found.drop(_BUCKET)

    def ids(self, sides: DataFrame | None = None) -> DataFrame:
        asked = None if sides is None else sides.select(F.explode(F.array(id_key("query"), id_key("explicit_id"))).alias("k"))
        return self._table("ids", asked)

    def index(self, sides: DataFrame | None = None) -> DataFrame:
        asked = None if sides is None else sides.select(name_key("query", ascii_only=self.ascii_names).alias("k"))
        return self._table("index", asked)

    def names(self) -> DataFrame:
        return self._table("names")

    def rows(self, entities: DataFrame | None = None) -> DataFrame:
        """Snapshot rows with their stable id in `__entity`."""
        return self._table("rows", entities)


def publish(
    snapshots: DataFrame, root: str, version: str, *, columns: fv.Columns = fv.Columns(), aliases: DataFrame | None = None,
    ascii_names: bool = False, buckets: int = BUCKETS,
) -> Published:
    """Write a version, unless it is there already, and open it."""
    spark = snapshots.sparkSession
    folder = f"{root}/version={version}"
    try:
        return open_version(spark, root, version)
    except FileNotFoundError:
        pass
    ids = identity.entity_ids(snapshots, columns.entity_id)
    index = identity.search_index(snapshots, entity_id=columns.entity_id, name=columns.entity_name, display_name=columns.display_name, ascii_only=ascii_names)
    if aliases is not None:
        index = identity.add_aliases(index, aliases, ids, ascii_only=ascii_names)
    names = identity.latest_records(snapshots, columns=columns).select("entity_id", "display_name")
    rows = snapshots.withColumn("__entity", id_key(F.col(columns.entity_id).cast("string")))
    for name, table, key in (("ids", ids, "entity_id"), ("index", index, "name_key"), ("names", names, "entity_id"), ("rows", rows, "__entity")):
        bucketed = table.withColumn(_BUCKET, _bucket(F.col(key), buckets))
        # a file or a few a bucket: rows of one bucket meet, and a very large bucket is split by what else is in it
        spread = bucketed.repartition(_BUCKET, F.pmod(F.xxhash64(*bucketed.columns), F.lit(4)))
        spread.write.mode("overwrite").partitionBy(_BUCKET).parquet(f"{folder}/{name}")
    stamp = spark.createDataFrame([(version, buckets, ascii_names)], "version string, buckets int, ascii_names boolean")
    stamp.coalesce(1).write.mode("overwrite").parquet(f"{folder}/stamp")
    return open_version(spark, root, version)


def open_version(spark: SparkSession, root: str, version: str) -> Published:
    try:
        stamp = spark.read.parquet(f"{root}/version={version}/stamp").first()
    except AnalysisException as error:
        raise FileNotFoundError(f"snapshot version {version!r} is not published under {root}") from error
    return Published(spark, f"{root}/version={version}", stamp["buckets"], stamp["ascii_names"])
