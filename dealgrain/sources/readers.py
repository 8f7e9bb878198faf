"""Reading landed tables and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import months
from ..functions.text import blank_if_null
from ..operators.quality import require_columns


def read_landed(spark: SparkSession, path: str, schema: T.StructType | str | None = None, skip_unreadable: bool = False) -> DataFrame:
    """All Parquet files under a path (or glob) as one table, with the source file and its time.

    A file that cannot be read aborts the job. With ``skip_unreadable`` it is left out; ``skipped_files``
    then lists such files. Pass a schema to avoid reading file footers for inference.
    """
    reader = spark.read.option("ignoreCorruptFiles", str(skip_unreadable).lower()).option("recursiveFileLookup", "true")
    reader = reader.schema(schema) if schema is not None else reader.option("mergeSchema", "true")
    df = reader.parquet(path)
    return df.select("*", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_modification_time").alias("source_time"))


def skipped_files(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet files under a path that gave no row: unreadable ones, and readable ones without rows."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    read = read_landed(spark, path, schema, skip_unreadable=True).select("source_file").distinct()
    return listed.select(F.col("path").alias("source_file"), "length").join(read, "source_file", "left_anti")


def path_month(path: Column) -> Column:
    """``YYYYMM`` of the folder of a file; null when the folder is not a month."""
    folder = F.regexp_extract(path, r"/(\d{6})/[^/]+$", 1)
    return F.when(months.packed_to_index(folder).isNotNull(), folder)


def path_stem(path: Column) -> Column:
    """File name without folder and suffix: the district code of a landed file."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]+)*$", 1)


def with_path_parts(df: DataFrame) -> DataFrame:
    return df.withColumns({"ym": path_month(F.col("source_file")), "file_code": F.lpad(path_stem(F.col("source_file")), 5, "0")})


def read_columns(spark: SparkSession, path: str, columns: list[str], where: Column | None = None, label: str = "table") -> DataFrame:
    """Chosen columns of a Parquet table; all missing names are reported at once.

    The filter and the column list reach the scan.
    """
    df = spark.read.parquet(path)
    require_columns(df, columns, label)
    return (df if where is None else df.where(where)).select(*columns)


def read_recent(spark: SparkSession, path: str, columns: list[str], last_months: int) -> DataFrame:
    """Rows of the last months of a table with a ``year_month`` column."""
    df = read_columns(spark, path, list(dict.fromkeys([*columns, "year_month"])))
    latest = months.label_to_index(latest_month(df).scalar())
    first = months.index_to_label(latest - (last_months - 1))
    return df.where(F.col("year_month") >= first).select(*columns)


def read_complex(spark: SparkSession, path: str, columns: list[str], complex_id: str) -> DataFrame:
    return read_columns(spark, path, columns, F.col("internal_complex_id") == complex_id)


def latest_month(df: DataFrame, column: str = "year_month") -> DataFrame:
    """The latest month label as a one-row table (a plain maximum over one pruned column)."""
    return df.agg(F.max(column).alias(column))


def profile_tables(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """family, column_name, kind, row_count and null_count of every column of several tables of different schemas.

    Each table is read once: one aggregation counts its rows and all its nulls, and one row per column comes out of it. A table
    without rows has counts of zero.
    """
    found = None
    for family, path in paths.items():
        df = spark.read.parquet(path)
        counts = df.agg(F.count(F.lit(1)).alias("row_count"), F.array(*[F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns]).alias("nulls"))
        names = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("kind")) for c, t in df.dtypes])
        each = counts.select("row_count", F.explode(F.arrays_zip(names.alias("about"), F.col("nulls").alias("null_count"))).alias("c"))
        rows = each.select(F.lit(family).alias("family"), "c.about.column_name", "c.about.kind", "row_count", "c.null_count")
        found = rows if found is None else found.unionByName(rows)
    return found


def read_text_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV with a header as text columns; a byte-order mark is ignored and blanks become empty.

    Columns are found by header name, in any order; missing ones are an error.
    """
    df = spark.read.option("header", "true").option("encoding", "UTF-8").option("mode", "FAILFAST").csv(path)
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    require_columns(df, columns, path)
    return df.select(*[blank_if_null(F.col(f"`{c}`")).alias(c) for c in columns])


def first_rows_per_file(df: DataFrame, order: list[str], n: int = 10) -> DataFrame:
    """The first rows of every file of a table read with ``read_landed``.

    The limit per group is applied before the shuffle by Spark's group limit.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("source_file").orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
