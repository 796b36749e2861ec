"""Session helper. Every operator also works on a session made elsewhere."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(
    app_name: str = "duelframe",
    *,
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Create or get a session with the settings the operators assume.

    AQE is left on so that joins switch to broadcast only after the measured size
    of a side is below the broadcast threshold, and so that oversized join
    partitions are split. `forceOptimizeSkewedJoin` keeps that split even when it
    costs one more shuffle later in the plan.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(extra or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shuffle_width(spark: SparkSession) -> int:
    """Configured number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
