"""Training-data pipeline over the documents table: five stages, each a whole operator.

Every stage takes what its predecessor kept and returns the columns of `documents`; the last one adds token ids.
A stage's result is written as Parquet to the shared folder and read again, so a lost executor costs at most one stage.

Each row is decided by itself. Near-duplicates that go are looked up where they stand, so texts are not dealt out again for that.
Contaminated rows go by an anti-join: texts stay where they are while the keys are below Spark's broadcast threshold.

Defined results: null texts are judged as empty texts. Where some id is null or repeated, rows are numbered for the
near-duplicate stage, and of a group one row stays (otherwise the one with the smallest id). Rows with one text share
their contamination. The last stage's columns `ids` and `round_trip` replace columns of these names. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelframe.llm.common import saved
from duelframe.llm.decontaminate import contamination
from duelframe.llm.near_duplicates import near_duplicates
from duelframe.llm.pieces import encode_texts
from duelframe.llm.quality import THRESHOLD, learn_quality, with_quality
from duelframe.llm.queries import table, tokenizer_path
from duelframe.llm.secrets import redact
from duelframe.llm.set_files import without_ids


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    model = learn_quality(docs, table(spark, sf_dir, "labels"))
    return with_quality(docs, model, score_col="__quality").where(F.col("__quality") >= THRESHOLD).drop("__quality")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id."""
    columns, key = docs.columns, "doc_id"
    if docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").limit(1).count():
        docs, key = saved(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered"), "__row"
    gone = near_duplicates(docs, id_col=key).where("not kept").select(F.col("doc_id").alias("id"))
    return without_ids(docs, key, gone).select(*columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages make up less than the tolerated share."""
    keyed = docs.withColumn("__text", F.xxhash64(F.lit(1), "text"))
    hit = contamination(keyed, table(spark, sf_dir, "benchmark"), id_col="__text").where("contaminated").select(F.col("doc_id").alias("__text"))
    # written first, so that Spark knows how small the keys are and deals no text out where it can broadcast them
    return keyed.join(saved(hit.distinct(), "contaminated"), "__text", "left_anti").select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and lengths brought up to date."""
    masked = redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else masked


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the ids of their pieces, and whether these decode to the text."""
    return encode_texts(docs.drop("ids", "round_trip"), tokenizer_path("pieces"), ids_col="ids", round_trip_col="round_trip")


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("pieces", encode),
]
#: fitted classifiers and merges of pieces have no SQL: tests/llm holds the rows of all stages against plain Python
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
