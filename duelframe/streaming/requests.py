"""Scoring of a stream of requests: the batch plan, applied to every micro-batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from duelframe.operators import identity
from duelframe.operators.serving import public_predictions
from duelframe.plans.score import ScoringPlan, prepare_requests, rejection_table, request_sides, score_requests, side_states, split_outcomes
from duelframe.streaming.published import Published, publish


def read_requests(spark: SparkSession, path: str, schema: str, *, kind: str = "json", max_files: int = 1000) -> DataFrame:
    """Request files as a stream. `predicted_at` comes from the request, never from the clock."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).format(kind).load(path)


def published_states(batch: DataFrame, published: Published, plan: ScoringPlan) -> tuple[DataFrame, list[DataFrame]]:
    """Entity states of a batch from the buckets it asks for, and what was persisted on the way."""
    sides = request_sides(prepare_requests(batch)).persist()
    resolved = identity.resolve(sides, published.index(sides), published.ids(sides), explicit_id="explicit_id", ascii_only=plan.ascii_names).persist()
    rows = published.rows(resolved.select("entity_id").where(F.col("entity_id").isNotNull()))
    return side_states(sides, resolved, rows, plan), [sides, resolved]


def score_batch(batch: DataFrame, batch_id: int, published: Published, plan: ScoringPlan, out: str, request_id: str = "request_id") -> None:
    """Predictions, public predictions and rejections of one batch; a batch that runs again replaces its folders."""
    batch = batch.persist()
    states, kept = published_states(batch, published, plan)
    scored = score_requests(batch, None, plan, request_id=request_id, states=states).persist()
    try:
        predictions, rejected = split_outcomes(scored)
        predictions.write.mode("overwrite").parquet(f"{out}/predictions/batch_id={batch_id}")
        public_predictions(predictions, keep=[request_id]).write.mode("overwrite").parquet(f"{out}/public/batch_id={batch_id}")
        refused = rejection_table(rejected, None, columns=plan.columns, names=published.names(), index=published.index(), ascii_names=plan.ascii_names)
        refused.write.mode("overwrite").parquet(f"{out}/rejected/batch_id={batch_id}")
    finally:
        for frame in (scored, *kept, batch):
            frame.unpersist()


def score_stream(
    stream: DataFrame, snapshots: Published | DataFrame, plan: ScoringPlan, out: str, *, checkpoint: str, aliases: DataFrame | None = None,
    request_id: str = "request_id", trigger: dict | None = None,
) -> StreamingQuery:
    """Write predictions, public predictions and rejections per micro-batch, against one published version of the snapshots.

    The query keeps no state of its own. Each batch goes to its own `batch_id` folder and a
    retried batch replaces that folder, so every request appears once. A plain table of snapshots is
    published under `out` when the stream starts, as a version of its own.
    """
    published = snapshots
    if isinstance(snapshots, DataFrame):
        published = publish(snapshots, f"{out}/snapshots", uuid.uuid4().hex, columns=plan.columns, aliases=aliases, ascii_names=plan.ascii_names)
    writer = stream.writeStream.foreachBatch(lambda batch, batch_id: score_batch(batch, batch_id, published, plan, out, request_id))
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
