from __future__ import annotations

import importlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
MODULES = ("evaluation", "data_checks", "splitting", "catalogue", "identity", "matchups", "fitting", "lineage")


def query(name: str, sql: str | None = None):
    """Register a query; without SQL only its rows are checked."""

    def register(function):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def load_all() -> None:
    for module in MODULES:
        importlib.import_module(f"duelframe.registry.{module}")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder for what a query writes: in the shared folder, or on this machine where none is named and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return f"{named.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and every executor can reach")
    return f"file://{tempfile.mkdtemp(prefix=f'duelframe-{label}-')}"


def r6(value: Column | str) -> Column:
    """Rounded to six places, so that the order of additions does not show."""
    return F.round(F.col(value) if isinstance(value, str) else value, 6)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: r6(name) for name in names})


def as_bigint(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: F.col(name).cast("bigint") for name in names})
