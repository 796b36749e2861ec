"""Reports, model runs and held-out results as tables under one root folder.

`runs` has one row per run, `components` one row per model file with its digest,
`reports/<table>` the evaluation tables and `final_metrics` the held-out results,
all Parquet; `commits` names the runs and held-out results that count. Models are saved by Spark ML under `models/<run_id>`.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Mapping
from dataclasses import asdict, dataclass
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelframe.operators.calibration import Identity, Isotonic, Sigmoid
from duelframe.operators.quality import DataCheckError
from duelframe.sources import commits
from duelframe.sources.lineage import digest_mismatches, file_fingerprints, relative_to

FORMAT_VERSION = 1
RUN_ID = re.compile(r"^[A-Za-z0-9][A-Za-z0-9_.-]*$")
RUNS_SCHEMA = (
    "run_id string, created_at timestamp, format_version int, feature_names array<string>, feature_groups string, "
    "calibrator string, schema_json string, config string, lineage string, cutoff string, metrics string, "
    "importances string, seeds string, versions string, metadata string"
)


def _maybe(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def finite_json(df: DataFrame) -> DataFrame:
    """Non-finite doubles as null, which JSON can hold."""
    fixed = {n: F.when(F.abs(F.col(f"`{n}`")) < float("inf"), F.col(f"`{n}`")) for n, t in df.dtypes if t in ("double", "float")}
    return df.withColumns(fixed) if fixed else df


def write_report(report: Mapping[str, DataFrame], root: str, run_id: str, stage: str) -> None:
    """Append report tables, one folder per table, partitioned by run and stage; not the sums they come from."""
    for name, frame in ((n, f) for n, f in report.items() if n != "sums"):
        tagged = finite_json(frame).withColumns({"run_id": F.lit(run_id), "stage": F.lit(stage)})
        # a stage of a run is written as a whole, so a retry replaces it
        tagged.write.mode("overwrite").parquet(f"{root}/reports/{name}/run_id={run_id}/stage={stage}")


def read_report(spark: SparkSession, root: str, table: str, run_id: str, stage: str) -> DataFrame:
    return spark.read.parquet(f"{root}/reports/{table}/run_id={run_id}/stage={stage}")


def dump_calibrator(calibrator) -> str:
    return json.dumps({"kind": type(calibrator).__name__, **asdict(calibrator)})


def load_calibrator(text: str):
    values = json.loads(text)
    kind = values.pop("kind")
    if kind == "Isotonic":
        values = {k: tuple(v) for k, v in values.items()}
    return {"Identity": Identity, "Sigmoid": Sigmoid, "Isotonic": Isotonic}[kind](**values)


def check_run_id(run_id: str) -> str:
    if not RUN_ID.fullmatch(run_id):
        raise ValueError("run_id must start with a letter or digit and hold only letters, digits, '.', '_' and '-'")
    return run_id


def save_run(
    spark: SparkSession, root: str, run_id: str, model: PipelineModel, calibrator, feature_names, *,
    cutoff: str, groups=None, schema=None, config=None, lineage=None, metrics=None, importances=None,
    seeds=None, versions=None, metadata=None, overwrite: bool = False, created_at: datetime | None = None,
) -> str:
    """Save the model and append the run; an existing run id is refused unless overwritten."""
    check_run_id(run_id)
    try:  # the id is taken first, so that of two jobs at once one is refused before it writes
        commits.commit(spark, f"{root}/commits/runs", run_id, {"format_version": FORMAT_VERSION}, overwrite=overwrite)
    except FileExistsError as error:
        raise FileExistsError(f"run {run_id!r} exists; pass overwrite=True to replace it") from error
    target = f"{root}/models/{run_id}"
    writer = model.write()
    (writer.overwrite() if overwrite else writer).save(target)
    files = relative_to(file_fingerprints(spark, target), target).withColumn("run_id", F.lit(run_id))
    files.write.mode("overwrite").parquet(f"{root}/components/run_id={run_id}")
    pack = lambda value: json.dumps(value or {}, sort_keys=True, default=str)
    row = (
        run_id, created_at or datetime.now(UTC), FORMAT_VERSION, list(feature_names), pack(groups), dump_calibrator(calibrator),
        pack(schema), pack(config), pack(lineage), cutoff, pack(metrics), pack(importances), pack(seeds), pack(versions), pack(metadata),
    )
    spark.createDataFrame([row], RUNS_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{root}/runs/run={run_id}")
    return target


def list_runs(spark: SparkSession, root: str) -> DataFrame | None:
    """Runs in order of creation time, then id."""
    runs = _maybe(spark, f"{root}/runs")
    return None if runs is None else order_runs(runs.drop("run"))


def order_runs(runs: DataFrame) -> DataFrame:
    return runs.orderBy("created_at", "run_id")


def latest_run(runs: DataFrame) -> DataFrame:
    """The newest run; equal times are told apart by id."""
    return runs.agg(F.max_by("run_id", F.struct("created_at", "run_id")).alias("run_id"))


@dataclass
class LoadedRun:
    run_id: str
    model: PipelineModel
    calibrator: object
    feature_names: list[str]
    cutoff: str
    lineage: dict
    schema: dict
    metadata: dict
    metrics: dict
    config: dict


def run_findings(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    """Model files that are missing, unexpected or changed since the run was saved."""
    target = f"{root}/models/{run_id}"
    recorded = spark.read.parquet(f"{root}/components/run_id={run_id}").select("path", "sha256")
    return digest_mismatches(relative_to(file_fingerprints(spark, target), target), recorded)


def load_run(spark: SparkSession, root: str, run_id: str | None = None, *, verify: bool = True) -> LoadedRun:
    """Load a run (the latest by default) after checking format, features and digests."""
    runs = list_runs(spark, root)
    if runs is None:
        raise FileNotFoundError(f"no runs under {root}")
    if run_id is None:
        run_id = latest_run(runs).first()["run_id"]
    row = runs.where(F.col("run_id") == check_run_id(run_id)).first()
    if row is None:
        raise FileNotFoundError(f"run {run_id!r} is not in {root}")
    if row["format_version"] != FORMAT_VERSION:
        raise DataCheckError(f"run format {row['format_version']} is not supported")
    names = list(row["feature_names"])
    if not names or len(set(names)) != len(names):
        raise DataCheckError("feature names must be non-empty and unique")
    unknown = sorted({m for members in json.loads(row["feature_groups"]).values() for m in members} - set(names))
    if unknown:
        raise DataCheckError(f"feature groups hold unknown features: {unknown}")
    schema, lineage = json.loads(row["schema_json"]), json.loads(row["lineage"])
    if "catalogue_sha256" in schema and "catalogue_sha256" in lineage and schema["catalogue_sha256"] != lineage["catalogue_sha256"]:
        raise DataCheckError("the catalogue digest disagrees between schema and lineage")
    if verify:
        wrong = run_findings(spark, root, run_id).collect()
        if wrong:
            raise DataCheckError("model files changed: " + "; ".join(f"{r['path']}: {r['finding']}" for r in wrong))
    model = PipelineModel.load(f"{root}/models/{run_id}")
    return LoadedRun(
        run_id, model, load_calibrator(row["calibrator"]), names, row["cutoff"], lineage, schema,
        json.loads(row["metadata"]), json.loads(row["metrics"]), json.loads(row["config"]),
    )


def guard_final(spark: SparkSession, root: str, run_id: str, *, overwrite: bool = False) -> None:
    """Refuse a second held-out evaluation before any test row is read."""
    if not overwrite and commits.current(spark, f"{root}/commits/final", run_id):
        raise FileExistsError(f"held-out metrics of {run_id!r} exist; pass overwrite=True to replace them")


def write_final(metrics: DataFrame, root: str, run_id: str, *, overwrite: bool = False) -> None:
    """Write held-out results to a folder of this attempt and commit it; of two jobs at once only one can."""
    spark, attempt = metrics.sparkSession, uuid.uuid4().hex
    folder = f"{root}/final_metrics/run_id={check_run_id(run_id)}/attempt={attempt}"
    metrics.withColumns({"evaluated_at": F.current_timestamp()}).write.parquet(folder)
    commits.commit(spark, f"{root}/commits/final", run_id, {"attempt": attempt, "files": commits.manifest(spark, folder)}, overwrite=overwrite)


def read_final(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    """Committed held-out results; those of attempts that lost are never read."""
    record = commits.current(spark, f"{root}/commits/final", run_id)
    if record is None:
        raise FileNotFoundError(f"no held-out results of {run_id!r}")
    folder = f"{root}/final_metrics/run_id={run_id}/attempt={record['attempt']}"
    if commits.manifest(spark, folder) != record["files"]:
        raise DataCheckError(f"the held-out files of {run_id!r} are not those that were committed")
    return spark.read.parquet(folder)
