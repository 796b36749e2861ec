"""Typed readers of the four input tables, from CSV or Parquet."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duelframe import fixed_values as fv
from duelframe.operators.quality import DataCheckError, missing_columns, row_checks

RAW = "__raw_"
# fixed values: texts read as missing, beside the empty text
MISSING_WORDS = (
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def _header(spark: SparkSession, path: str) -> list[str]:
    """Column names; only the schema is looked at."""
    return spark.read.option("header", True).csv(path).columns


def read_table(
    spark: SparkSession,
    path: str,
    *,
    dates: Iterable[str] = (),
    required: Iterable[str] = (),
    numbers: Iterable[str] = (),
    number_prefix: str | None = None,
    kind: str | None = None,
) -> DataFrame:
    """Read a table with ids and names kept as text.

    CSV columns are read as text, so ids keep leading zeros. Dates and numbers are
    then parsed without failing the job; a cell that does not parse becomes null
    and its text stays in a `__raw_` column for `parse_findings`.
    """
    kind = kind or ("csv" if path.rstrip("/").lower().endswith((".csv", ".csv.gz")) else "parquet")
    if kind == "csv":
        schema = T.StructType([T.StructField(name, T.StringType()) for name in _header(spark, path)])
        df = spark.read.schema(schema).option("header", True).option("multiLine", False).csv(path)
        df = df.select(*[F.when(~F.col(f"`{c}`").isin("", *MISSING_WORDS), F.col(f"`{c}`")).alias(c) for c in df.columns])
    else:
        df = spark.read.format(kind).load(path)
    dates, numbers = list(dates), list(numbers)
    missing = missing_columns(df, [*required, *dates])
    if missing:
        raise DataCheckError(f"{path} is missing columns {missing}")
    if number_prefix:
        numbers += [c for c in df.columns if c.startswith(number_prefix) and c not in numbers]
    types = dict(df.dtypes)
    parsed = {}
    for name in dates:
        raw = F.col(f"`{name}`")
        parsed[name] = F.try_to_date(raw) if types[name] == "string" else raw.cast("date")
    for name in numbers:
        if name in types:
            parsed[name] = F.col(f"`{name}`").try_cast("double")
    raws = {RAW + name: F.col(f"`{name}`").cast("string") for name in parsed if types[name] == "string"}
    return df.withColumns(raws).withColumns(parsed) if parsed else df


def parse_findings(df: DataFrame, *, limit: int = 5) -> DataFrame:
    """Cells that held text but did not parse, with up to five examples per column."""
    raws = [c for c in df.columns if c.startswith(RAW)]
    if not raws:
        from duelframe.operators.quality import FINDING

        return df.sparkSession.createDataFrame([], FINDING)
    checks = [("cell_unparseable", c[len(RAW):], F.col(c).isNotNull() & F.col(c[len(RAW):]).isNull(), F.col(c)) for c in raws]
    return row_checks(df, checks, limit=limit)


def without_raw(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(RAW)])


def read_contests(spark: SparkSession, path: str, columns: fv.Columns = fv.Columns()) -> DataFrame:
    c = columns
    return read_table(
        spark, path, dates=[c.event_date], required=[c.contest_id, c.event_date, c.target, c.a_id, c.b_id],
        numbers=[c.target, c.title], number_prefix=c.feature_prefix,
    )


def read_snapshots(spark: SparkSession, path: str, columns: fv.Columns = fv.Columns()) -> DataFrame:
    c = columns
    return read_table(
        spark, path, dates=[c.as_of, c.last_event], required=list(c.snapshot_required), number_prefix=c.feature_prefix
    )


def read_profiles(spark: SparkSession, path: str, columns: fv.Columns = fv.Columns()) -> DataFrame:
    c = columns
    return read_table(spark, path, dates=[c.dob], required=[c.entity_id, c.entity_name, c.dob])


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Feature dictionary with its row order in `position`.

    The order of rows is the order of model features. The file is one small CSV, so
    it is read as one split and the row id follows the file.
    """
    df = read_table(spark, path, required=list(fv.DICTIONARY_COLUMNS))
    return df if "position" in df.columns else df.coalesce(1).withColumn("position", F.monotonically_increasing_id())
