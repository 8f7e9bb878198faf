"""Writing tables, landing partitions and report files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import months, text
from ..session import local_table


def write_table(df: DataFrame, path: str, partition_by: list[str] = (), mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").option("encoding", "UTF-8").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


EMPTY_MARK = "is_empty_landing"


def land(df: DataFrame, path: str, keys: tuple[str, str] = ("ym", "lawd_cd"), rows_per_file: int = 5_000_000, attempted: DataFrame | None = None) -> None:
    """Replace exactly the month and district partitions present in ``df`` or listed in ``attempted``.

    An attempted target without rows gets a single marker row (``is_empty_landing``), so its old contracts go and it
    counts as collected; ``landed_rows`` leaves markers out. The rebalance hint lets adaptive execution gather small
    partitions and split crowded ones.
    """
    if attempted is not None:
        missing = attempted.select(*keys).distinct().join(df.select(*keys).distinct(), list(keys), "left_anti")
        df = df.withColumn(EMPTY_MARK, F.lit(False)).unionByName(missing.withColumn(EMPTY_MARK, F.lit(True)), allowMissingColumns=True)
    writer = df.hint("rebalance", *keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.option("maxRecordsPerFile", rows_per_file).partitionBy(*keys).parquet(path)


def landed_rows(df: DataFrame) -> DataFrame:
    """Landed contracts without the markers of empty targets."""
    return df.where(~F.coalesce(F.col(EMPTY_MARK), F.lit(False))).drop(EMPTY_MARK) if EMPTY_MARK in df.columns else df


def collection_targets(dimension: DataFrame, first: str, last: str) -> DataFrame:
    """Every month from first to last (``YYYYMM``) for every district."""
    month_list = months.months_between_labels(F.lit(first), F.lit(last))
    return dimension.select("lawd_cd").distinct().select(F.explode(month_list).alias("ym"), "lawd_cd")


def collection_plan(targets: DataFrame, landed: DataFrame, force: bool = False) -> DataFrame:
    """Targets still to collect: those not landed yet, or all of them when forced."""
    if force:
        return targets
    return targets.join(landed.select("ym", "lawd_cd").distinct(), ["ym", "lawd_cd"], "left_anti")


def collection_plan_counts(targets: DataFrame, landed: DataFrame, force: bool = False) -> DataFrame:
    """How many targets exist, are landed already and would be collected now."""
    known = landed.select("ym", "lawd_cd").distinct().withColumn("_landed", F.lit(True))
    marked = targets.join(known, ["ym", "lawd_cd"], "left")
    done = F.count_if(F.col("_landed"))
    new = F.count(F.lit(1)) if force else F.count(F.lit(1)) - done
    return marked.agg(F.count(F.lit(1)).alias("targets"), done.alias("existing"), new.alias("to_collect"))


def register_export(master: DataFrame, raw: DataFrame, labels: dict[str, str], descriptions: dict[str, str]) -> dict[str, DataFrame]:
    """Four tables for readers: sorted register, raw copy, quality summary and data dictionary."""
    from ..operators.quality import register_summary

    columns = [c for c in labels if c in master.columns]
    order = [F.asc_nulls_last(c) for c in ("sigungu", "dong", "complex_name")]
    spark: SparkSession = master.sparkSession
    dictionary = [(c, labels[c], descriptions.get(c, "")) for c in columns]
    return {
        "analysis": guarded(master.orderBy(*order).select(*[F.col(c).alias(labels[c]) for c in columns])),
        "raw": guarded(raw),
        "quality": register_summary(master),
        "dictionary": local_table(spark, dictionary, "column_name string, report_name string, description string"),
    }


def guarded(df: DataFrame) -> DataFrame:
    """Protect text columns against being read as spreadsheet formulas."""
    return df.select(*[text.guard_formula(F.col(f"`{n}`")).alias(n) if t == "string" else F.col(f"`{n}`") for n, t in df.dtypes])
