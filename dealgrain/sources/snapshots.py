"""Versioned valuation snapshots: one run per month and revision."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators.scale import pick_row
from ..session import local_table

MANIFEST = "month string, run_id string, revision int, kind string, revision_reason string, input_hash string, rules_hash string, master_hash string, executed_at timestamp"


def run_id(month, input_hash, rules_hash, master_hash):
    """The same month and inputs always give the same 24-character run id."""
    return F.substring(F.sha2(F.concat_ws(":", month, input_hash, rules_hash, master_hash), 256), 1, 24)


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
    except AnalysisException:
        return local_table(spark, [], MANIFEST)


def select_revisions(manifest: DataFrame, mode: str = "latest") -> DataFrame:
    """The first or the latest revision of every month."""
    if mode not in ("first", "latest"):
        raise ValueError("mode must be 'first' or 'latest'")
    return pick_row(manifest, ["month"], [F.col("revision"), F.col("run_id")], last=mode == "latest")


def new_runs(candidates: DataFrame, manifest: DataFrame) -> DataFrame:
    """Candidate runs that are not in the manifest yet."""
    return candidates.join(manifest.select("month", "run_id").distinct(), ["month", "run_id"], "left_anti")


def save_month(
    root: str, month: str, totals: DataFrame, detail: DataFrame, used: DataFrame,
    input_hash: str, rules_hash: str, master_hash: str, reason: str = "",
) -> bool:
    """Write one month as a new revision; false when the same run is already there.

    A second revision needs a reason. Tables are committed before the manifest row, so a run
    that dies half-way is written again under the same id.
    """
    spark = totals.sparkSession
    parts = [F.lit(v) for v in (month, input_hash, rules_hash, master_hash)]
    rid = spark.range(1).select(run_id(*parts).alias("v")).first().v
    manifest = read_manifest(spark, root).where(F.col("month") == month)
    state = manifest.agg(
        F.count_if(F.col("run_id") == rid).alias("same"), F.coalesce(F.max("revision"), F.lit(0)).alias("last")
    ).first()
    if state.same:
        return False
    if state.last and not reason.strip():
        raise ValueError(f"{month}: a revision needs a reason")
    stamps = {"input_hash": input_hash, "rules_hash": rules_hash, "master_hash": master_hash}
    for name, df in (("complexes", totals.withColumns({k: F.lit(v) for k, v in stamps.items()})), ("areas", detail), ("contracts", used)):
        df.drop("month").write.mode("overwrite").parquet(f"{root}/{name}/month={month}/run_id={rid}")
    kind = "revision" if state.last else "initial"
    row = spark.range(1).select(
        F.lit(month).alias("month"), F.lit(rid).alias("run_id"), F.lit(state.last + 1).alias("revision"), F.lit(kind).alias("kind"),
        F.lit(reason).alias("revision_reason"), *[F.lit(v).alias(k) for k, v in stamps.items()], F.current_timestamp().alias("executed_at"),
    )
    row.write.mode("append").parquet(f"{root}/manifest")
    return True


def read_history(spark: SparkSession, root: str, mode: str = "latest", table: str = "complexes") -> DataFrame:
    """Snapshot rows of the chosen revision of every month; other revisions are pruned by partition."""
    chosen = select_revisions(read_manifest(spark, root), mode).select("month", "run_id")
    rows = spark.read.option("mergeSchema", "true").option("basePath", f"{root}/{table}").parquet(f"{root}/{table}")
    rows = rows.withColumns({"month": F.col("month").cast("string"), "run_id": F.col("run_id").cast("string")})
    return rows.join(chosen, ["month", "run_id"], "left_semi")


def release_problems(pointer: dict, metadata: dict, totals: DataFrame, detail: DataFrame, producer: str, schema_version: int = 1) -> list[str]:
    """Everything that speaks against publishing a release; empty when it is sound."""
    from ..operators.scale import unique_key_violations
    from ..operators.valuation import tie_out

    found = []
    for field in ("run_id", "input_hash", "rules_hash", "producer", "snapshot_schema_version", "release", "adjustment_policy"):
        if pointer.get(field) != metadata.get(field):
            found.append(f"pointer and metadata differ in {field}")
    if metadata.get("producer") != producer:
        found.append("unexpected producer")
    if metadata.get("snapshot_schema_version") != schema_version:
        found.append("unsupported schema version")
    if not unique_key_violations(totals, ["kapt_code"]).isEmpty():
        found.append("complex repeated")
    if not unique_key_violations(detail, ["kapt_code", "area_group_id"]).isEmpty():
        found.append("type repeated")
    if not tie_out(totals, detail).isEmpty():
        found.append("types do not add up to the complex")
    counts = totals.agg(F.count(F.lit(1)).alias("targets"), F.count("adjusted_market_cap_krw").alias("adjusted_complete")).first()
    for field in ("targets", "adjusted_complete"):
        if int(metadata.get(field, -1)) != counts[field]:
            found.append(f"{field} differs from the data")
    return found
