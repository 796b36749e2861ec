"""Load, split and check the four tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelframe import fixed_values as fv
from duelframe.operators import catalogue, quality, splits
from duelframe.sources import lineage, tables


@dataclass(frozen=True)
class DataPlan:
    """Where the tables are and what they must look like."""

    contests: str
    snapshots: str
    profiles: str
    dictionary: str
    bounds: splits.SplitBounds
    expected_rows: int | None = None
    expected_features: int | None = None
    single_date_snapshots: bool = True
    columns: fv.Columns = field(default_factory=fv.Columns)

    @property
    def paths(self) -> dict[str, str]:
        return {
            "model_dataset": self.contests, "fighter_snapshots": self.snapshots, "fighter_profiles": self.profiles,
            "feature_dictionary": self.dictionary,
        }


@dataclass
class Prepared:
    contests: DataFrame
    snapshots: DataFrame
    profiles: DataFrame
    catalogue: DataFrame
    features: list[str]
    train: DataFrame
    validation: DataFrame
    test: DataFrame
    findings: DataFrame
    lineage: dict
    plan: DataPlan

    def release(self) -> None:
        self.contests.unpersist()


def asset_digests(spark: SparkSession, plan: DataPlan) -> DataFrame:
    """One digest per input table, whatever number of files it has."""
    frames = [
        lineage.combined_digest(lineage.relative_to(lineage.file_fingerprints(spark, path), _parent(path))).select(
            F.lit(name).alias("name"), F.col("combined_sha256").alias("sha256")
        )
        for name, path in plan.paths.items()
    ]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def _parent(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[0]


def lineage_record(spark: SparkSession, plan: DataPlan, catalogue_table: DataFrame, contests: DataFrame, features: list[str]) -> dict:
    """What a later run must find unchanged."""
    assets = asset_digests(spark, plan)
    catalogue_sha = catalogue.catalogue_digest(catalogue_table).first()["catalogue_sha256"]
    combined = lineage.lineage_digest(assets, catalogue_sha).first()["combined_sha256"]
    # four rows, one per input table
    files = {r["name"]: r["sha256"] for r in assets.collect()}
    return {
        "feature_names": features,
        "files": files,
        "combined_sha256": combined,
        "catalogue_sha256": catalogue_sha,
        "cutoff": plan.bounds.cutoff,
        "table_sha256": lineage.table_fingerprint(contests).first()["table_sha256"],
    }


def prepare(spark: SparkSession, plan: DataPlan, *, strict: bool = True) -> Prepared:
    """Every check of the four tables, and the split contest table kept for later stages.

    `strict` raises when any check finds something; otherwise the findings are
    returned for the caller to read.
    """
    c = plan.columns
    raw_contests = tables.read_contests(spark, plan.contests, c)
    raw_snapshots = tables.read_snapshots(spark, plan.snapshots, c)
    raw_profiles = tables.read_profiles(spark, plan.profiles, c)
    dictionary = tables.read_dictionary(spark, plan.dictionary)
    cells = [tables.parse_findings(f) for f in (raw_contests, raw_snapshots, raw_profiles)]
    contests, snapshots, profiles = (tables.without_raw(f) for f in (raw_contests, raw_snapshots, raw_profiles))
    if c.split not in contests.columns:
        contests = splits.split_by_bounds(contests, plan.bounds, c.event_date, c.split)
    contests = contests.persist()

    listed = catalogue.catalogue_from_dictionary(dictionary)
    features = catalogue.feature_names(listed)
    catalogue.assert_features_match(contests, features, c.feature_prefix)
    snapshot_features = catalogue.discover_features(snapshots, c.feature_prefix)
    findings = quality.combine(
        [
            *cells,
            quality.dictionary_findings(dictionary, target=c.target, expected=plan.expected_features),
            quality.contest_findings(
                contests, features, columns=c, cutoff=plan.bounds.cutoff, expected_rows=plan.expected_rows,
                expected_features=plan.expected_features,
            ),
            splits.split_findings(contests, c.event_date, c.split, bounds=plan.bounds),
            quality.snapshot_findings(
                snapshots, snapshot_features, columns=c, expected_cutoff=plan.bounds.cutoff, single_date=plan.single_date_snapshots
            ),
            quality.duplicate_keys(profiles, [c.entity_id], check="duplicate_profile"),
            quality.id_set_findings(profiles, snapshots, c.entity_id, c.entity_id),
        ]
    )
    if strict:
        quality.assert_valid(findings)
    train, validation, test = splits.split_tables(contests, c.split)
    record = lineage_record(spark, plan, listed, contests, features)
    return Prepared(contests, snapshots, profiles, listed, features, train, validation, test, findings, record, plan)
