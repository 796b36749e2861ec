"""Readers, fingerprints and run tables."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import functions as F

from duelframe.operators import quality
from duelframe.registry import fixtures as fx
from duelframe.registry.base import query, scratch, table
from duelframe.sources import lineage as ln
from duelframe.sources import runs


@query(
    "s01_date_cells",
    """WITH t AS (SELECT CASE WHEN o_orderkey % 17 = 0 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS raw FROM orders)
    SELECT 'cell_unparseable' AS "check", 'd' AS "column", COUNT(*) AS bad_count, 'soon' AS examples FROM t WHERE try_cast(raw AS DATE) IS NULL""",
)
def date_cells(spark, sf):
    from duelframe.sources.tables import RAW, parse_findings

    raw = F.when(F.col("o_orderkey") % 17 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    df = table(spark, sf, "orders").select(raw.alias(RAW + "d")).withColumn("d", F.try_to_date(RAW + "d"))
    return parse_findings(df).select("check", "column", F.col("bad_count").cast("bigint").alias("bad_count"), F.array_join("examples", ",").alias("examples"))


@query(
    "s02_typed_reader",
    "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, o_totalprice FROM orders",
)
def typed_reader(spark, sf):
    from duelframe.sources.tables import read_table, without_raw

    df = read_table(spark, f"{sf}/orders.parquet", dates=["o_orderdate"], required=["o_orderkey"], numbers=["o_totalprice"])
    return without_raw(df).select("o_orderkey", "o_orderdate", "o_totalprice")


@query("s04_file_fingerprints")
def fingerprints(spark, sf):
    return ln.relative_to(ln.file_fingerprints(spark, sf, pattern="*.parquet"), sf)


@query("s05_combined_fingerprint")
def combined(spark, sf):
    return ln.combined_digest(ln.relative_to(ln.file_fingerprints(spark, sf, pattern="*.parquet"), sf))


@query("s06_digest_check")
def digest_check(spark, sf):
    files = ln.relative_to(ln.file_fingerprints(spark, sf, pattern="*.parquet"), sf)
    expected = files.select("path", F.when(F.col("path").startswith("p"), F.sha2("path", 256)).when(F.col("path").startswith("n"), "x").otherwise(F.col("sha256")).alias("sha256"))
    return ln.digest_mismatches(files, expected)


@query("s07_table_fingerprint")
def table_digest(spark, sf):
    return ln.table_fingerprint(table(spark, sf, "lineitem"))


@query("s08_lineage_digest")
def lineage_digest(spark, sf):
    files = ln.relative_to(ln.file_fingerprints(spark, sf, pattern="*.parquet"), sf)
    return ln.lineage_digest(files.select(F.col("path").alias("name"), "sha256"), "0" * 64)


@query(
    "s12_run_order",
    """WITH r AS (SELECT 'run-' || o_orderkey AS run_id, o_orderdate AS created_at FROM orders)
    SELECT run_id FROM r ORDER BY created_at DESC, run_id DESC LIMIT 1""",
)
def run_order(spark, sf):
    rows = table(spark, sf, "orders").select(F.concat(F.lit("run-"), F.col("o_orderkey").cast("string")).alias("run_id"), F.col("o_orderdate").alias("created_at"))
    return runs.latest_run(rows)


@query(
    "q20_id_set_findings",
    """WITH a AS (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS id FROM customer), b AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS id FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01')
    SELECT 'missing_left' AS "check", COUNT(*) AS bad_count FROM b WHERE id NOT IN (SELECT id FROM a) UNION ALL SELECT 'missing_right', COUNT(*) FROM a WHERE id NOT IN (SELECT id FROM b)""",
)
def id_set_findings(spark, sf):
    early = table(spark, sf, "orders").where("o_orderdate < timestamp_ntz'1999-01-01 00:00:00'")
    return quality.id_set_findings(table(spark, sf, "customer"), early, "c_custkey", "o_custkey").select("check", F.col("bad_count").cast("bigint").alias("bad_count"))


@query("q22_lineage_verification")
def lineage_verification(spark, sf):
    contests = fx.contests(spark, sf)
    now = ln.table_fingerprint(contests).select(F.lit("contests").alias("name"), F.col("table_sha256").alias("sha256"))
    before = ln.table_fingerprint(contests.where("target = 1")).select(F.lit("contests").alias("path"), F.col("table_sha256").alias("sha256"))
    return ln.digest_mismatches(now.withColumnRenamed("name", "path"), before)

# Documents as files: a path, the digest of the text and its bytes.
AS_FILES_SQL = "files AS (SELECT 'doc/' || doc_id AS path, sha256(text) AS sha, strlen(text) AS size FROM documents)"


def _as_files(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("bigint").alias("size_bytes"))


@query(
    "s05_combined_documents",
    f"""WITH {AS_FILES_SQL},
    b AS (SELECT substr(md5(path), 1, 3) AS bucket, sha256(string_agg(path || chr(0) || sha || chr(0) || size, chr(10) ORDER BY path)) AS digest FROM files GROUP BY 1)
    SELECT sha256(string_agg(bucket || ':' || digest, chr(10) ORDER BY bucket)) AS combined_sha256 FROM b""",
)
def combined_documents(spark, sf):
    return ln.combined_digest(_as_files(spark, sf))


@query(
    "s06_digest_check_documents",
    f"""WITH {AS_FILES_SQL}, t AS (SELECT *, CAST(substr(path, 5) AS BIGINT) % 5 AS k FROM files),
    e AS (SELECT CASE WHEN k = 4 THEN path || 'x' ELSE path END AS path, CASE k WHEN 1 THEN sha256(path) WHEN 2 THEN 'zz' ELSE upper(sha) || ' ' END AS raw FROM t),
    j AS (SELECT coalesce(t.path, e.path) AS path, t.sha AS sha256, lower(trim(e.raw)) AS expected FROM t FULL JOIN e USING (path))
    SELECT path, sha256, expected, CASE WHEN expected = 'zz' THEN 'bad_digest' WHEN sha256 IS NULL THEN 'missing_file' WHEN expected IS NULL THEN 'unexpected_file' ELSE 'mismatch' END AS finding
    FROM j WHERE sha256 IS NULL OR expected IS NULL OR sha256 <> expected""",
)
def digest_check_documents(spark, sf):
    files = _as_files(spark, sf)
    kind = F.substring("path", 5, 20).cast("bigint") % 5
    path = F.when(kind == 4, F.concat("path", F.lit("x"))).otherwise(F.col("path"))
    raw = F.when(kind == 1, F.sha2("path", 256)).when(kind == 2, "zz").otherwise(F.concat(F.upper("sha256"), F.lit(" ")))
    return ln.digest_mismatches(files, files.select(path.alias("path"), raw.alias("sha256")))


@query(
    "s08_lineage_sources",
    """WITH a AS (SELECT source AS name, sha256(CAST(COUNT(*) AS VARCHAR)) AS sha FROM documents GROUP BY 1)
    SELECT sha256(string_agg(name || chr(0) || sha || chr(10), '' ORDER BY name) || repeat('0', 64)) AS combined_sha256 FROM a""",
)
def lineage_sources(spark, sf):
    assets = table(spark, sf, "documents").groupBy(F.col("source").alias("name")).agg(F.sha2(F.count(F.lit(1)).cast("string"), 256).alias("sha256"))
    return ln.lineage_digest(assets, "0" * 64)


DIGEST_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "day")
ORDER_HASH = """md5(concat_ws(chr(31), '1' || o_orderkey, '1' || {cust}, coalesce('1' || o_orderstatus, '0'), '1' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR)))"""
HALVES = """CAST(COUNT(*) AS BIGINT) AS row_count, SUM(CAST(CAST('0x' || substr(h, 1, 16) AS UBIGINT) AS HUGEINT)) AS hi, SUM(CAST(CAST('0x' || substr(h, 17, 16) AS UBIGINT) AS HUGEINT)) AS lo"""


def _orders_by_day(spark, sf):
    return table(spark, sf, "orders").withColumn("day", F.to_date("o_orderdate"))


@query(
    "s07_incremental_digest",
    f"""WITH r AS (SELECT o_orderpriority AS p, {ORDER_HASH.format(cust="o_custkey")} AS h FROM orders),
    s AS (SELECT 'whole' AS part, h FROM r UNION ALL SELECT 'rest' AS part, h FROM r WHERE p <> '1-URGENT'),
    t AS (SELECT part, {HALVES} FROM s GROUP BY part)
    SELECT part, row_count, sha256('{",".join(DIGEST_COLUMNS)}' || chr(30) || row_count || chr(30) || hi || chr(30) || lo) AS table_sha256 FROM t""",
)
def incremental_digest(spark, sf):
    """Digests of a table and of what is left without one partition, from the sums of its partitions only."""
    parts = ln.row_sums(_orders_by_day(spark, sf), DIGEST_COLUMNS, by=["o_orderpriority"])
    whole = ln.sums_digest(ln.combined_sums(parts), ",".join(DIGEST_COLUMNS)).select(F.lit("whole").alias("part"), "*")
    rest = ln.sums_digest(ln.combined_sums(parts, parts.where("o_orderpriority = '1-URGENT'")), ",".join(DIGEST_COLUMNS)).select(F.lit("rest").alias("part"), "*")
    return whole.unionByName(rest)


@query(
    "q22_changed_partitions",
    f"""WITH was AS (SELECT p, {HALVES} FROM (SELECT o_orderpriority AS p, {ORDER_HASH.format(cust="o_custkey")} AS h FROM orders) GROUP BY p),
    now AS (SELECT p, {HALVES} FROM (
      SELECT CASE WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS p,
        {ORDER_HASH.format(cust="CASE WHEN o_orderpriority = '2-HIGH' AND o_orderkey % 50 = 0 THEN o_custkey + 1 ELSE o_custkey END")} AS h FROM orders WHERE o_orderpriority <> '5-LOW') GROUP BY p),
    j AS (SELECT coalesce(was.p, now.p) AS p, was.row_count AS a, now.row_count AS b, was.hi AS ah, was.lo AS al, now.hi AS bh, now.lo AS bl FROM was FULL JOIN now ON was.p IS NOT DISTINCT FROM now.p)
    SELECT p AS o_orderpriority, a AS recorded_count, b AS current_count, CASE WHEN a IS NULL THEN 'new' WHEN b IS NULL THEN 'gone' ELSE 'changed' END AS finding
    FROM j WHERE a IS NULL OR b IS NULL OR a <> b OR ah <> bh OR al <> bl""",
)
def changed_partitions(spark, sf):
    """Recorded sums against those of a table in which one partition went, one is new and two changed."""
    orders = _orders_by_day(spark, sf)
    cust = F.when((F.col("o_orderpriority") == "2-HIGH") & (F.col("o_orderkey") % 50 == 0), F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))
    moved = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderkey") % 7 == 0)
    now = orders.where("o_orderpriority <> '5-LOW'").withColumn("o_custkey", cust).withColumn("o_orderpriority", F.when(~moved, F.col("o_orderpriority")))
    by = ["o_orderpriority"]
    return ln.changed_partitions(ln.row_sums(orders, DIGEST_COLUMNS, by=by), ln.row_sums(now, DIGEST_COLUMNS, by=by), by)


LINES_SQL = """lines AS (SELECT CAST(l_shipdate AS DATE) AS day, CAST(l_returnflag = 'R' AS INT) AS y, (l_quantity - 0.5) / 50 AS p FROM lineitem)"""


def _saved_runs(spark, sf, label):
    """Two runs of one small model over the line items; the metrics of a run hold its number of rows."""
    from duelframe.operators import models
    from duelframe.operators.calibration import Identity

    root = scratch(spark, label)
    scored = fx.scored(spark, sf)
    fit = models.fit_logistic(scored, ["p", "prior"], "y", models.LogisticCandidate("l2", "l2", 0.1))
    counts = scored.groupBy("flag").count().orderBy("flag").collect()
    for name, n in (("run-a", sum(r["count"] for r in counts)), ("run-b", counts[0]["count"])):
        runs.save_run(
            spark, root, name, fit.model, Identity(), ["p", "prior"], cutoff=fx.CUTOFF, metrics={"rows": n}, groups={"scores": ["p"]},
            created_at=datetime(2024, 1, 1 if name == "run-a" else 2, tzinfo=UTC),
        )
    return root, fit, scored


@query(
    "s10_save_run",
    """SELECT 'run-a' AS run_id, 1 AS format_version, 'p,prior' AS features, 'saved' AS outcome, COUNT(*) AS n_rows FROM lineitem
    UNION ALL SELECT 'run-b', 1, 'p,prior', 'saved', COUNT(*) FROM lineitem WHERE l_returnflag = (SELECT MIN(l_returnflag) FROM lineitem)
    UNION ALL SELECT 'run-b', 1, 'p,prior', 'refused', NULL""",
)
def save_run(spark, sf):
    """Saved runs, and a third save of a known id, which is refused."""
    from duelframe.operators.calibration import Identity

    root, fit, _ = _saved_runs(spark, sf, "save-run")
    try:
        runs.save_run(spark, root, "run-b", fit.model, Identity(), ["p", "prior"], cutoff=fx.CUTOFF)
        outcome = "saved"
    except FileExistsError:
        outcome = "refused"
    n = F.get_json_object("metrics", "$.rows").cast("bigint")
    listed = runs.list_runs(spark, root).select("run_id", "format_version", F.array_join("feature_names", ",").alias("features"), F.lit("saved").alias("outcome"), n.alias("n_rows"))
    again = spark.createDataFrame([("run-b", 1, "p,prior", outcome, None)], listed.schema)
    return listed.unionByName(again)


@query(
    "s11_load_run",
    f"""WITH {LINES_SQL} SELECT 'run-b' AS run_id, 'p,prior' AS features, 'loaded' AS outcome, COUNT(*) AS n_rows, CAST(COUNT(*) FILTER (y = 1) AS BIGINT) AS positives FROM lines
    UNION ALL SELECT 'run-a', 'p,prior', 'refused', 0, 0""",
)
def load_run(spark, sf):
    """The latest run scores the table; a run whose model files were tampered with is not loaded."""
    from duelframe.operators.quality import DataCheckError
    from duelframe.operators.scorers import positive_probability

    root, _, scored = _saved_runs(spark, sf, "load-run")
    run = runs.load_run(spark, root)
    good = positive_probability(run.model, scored, "q").where("q between 0 and 1").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("y") == 1).alias("positives"))
    recorded = spark.read.parquet(f"{root}/components/run_id=run-a")
    recorded.withColumn("sha256", F.sha2("path", 256)).coalesce(1).write.mode("overwrite").parquet(f"{root}/changed")
    spark.read.parquet(f"{root}/changed").write.mode("overwrite").parquet(f"{root}/components/run_id=run-a")
    try:
        runs.load_run(spark, root, "run-a")
        outcome = "loaded"
    except DataCheckError:
        outcome = "refused"
    first = good.select(F.lit(run.run_id).alias("run_id"), F.lit(",".join(run.feature_names)).alias("features"), F.lit("loaded").alias("outcome"), "n_rows", "positives")
    return first.unionByName(spark.createDataFrame([("run-a", "p,prior", outcome, 0, 0)], first.schema))


@query(
    "s13_final_once",
    f"""WITH {LINES_SQL}, t AS (SELECT COUNT(*) AS sample_count, CAST(SUM(y) AS BIGINT) AS positive_count, round(AVG((p - y) * (p - y)), 6) AS brier_score FROM lines)
    SELECT outcome, CASE WHEN outcome = 'committed' THEN sample_count END AS sample_count, CASE WHEN outcome = 'committed' THEN positive_count END AS positive_count,
      CASE WHEN outcome = 'committed' THEN brier_score END AS brier_score FROM t, (SELECT unnest(['committed', 'refused before reading', 'refused at commit']) AS outcome)""",
)
def final_once(spark, sf):
    """Held-out results are written once: a later job is refused before it reads, and one that is under way at its commit."""
    from duelframe.operators.metrics import binary_metrics

    root = scratch(spark, "final")
    scored = fx.scored(spark, sf)
    runs.write_final(binary_metrics(scored, ranking=False), root, "run-a")
    outcomes = []
    for outcome, step in (
        ("refused before reading", lambda: runs.guard_final(spark, root, "run-a")),
        ("refused at commit", lambda: runs.write_final(binary_metrics(scored.limit(10), ranking=False), root, "run-a")),
    ):
        try:
            step()
        except FileExistsError:
            outcomes.append((outcome,))
    kept = runs.read_final(spark, root, "run-a").select(F.lit("committed").alias("outcome"), "sample_count", "positive_count", F.round("brier_score", 6).alias("brier_score"))
    return kept.unionByName(spark.createDataFrame(outcomes, "outcome string"), allowMissingColumns=True)
