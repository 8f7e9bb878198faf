"""Reading and keying of the text tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def id_remainder(name: str, parts: int) -> Column:
    """crc32 of the id written as text, modulo ``parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit(""))) % parts


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under fixed names, so that other columns cannot clash.

    Names are taken literally, dots included.
    """
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def bounded_sample(df: DataFrame, rows: int, seed: int) -> DataFrame:
    """About ``rows`` rows, at most that many, picked by a hash of the whole row.

    A row is first admitted by its own hash, with a share worked out from the number of rows, so what the last
    step orders does not grow with the table.
    """
    total = df.count()
    if total <= rows:
        return df
    order = F.xxhash64(*df.columns, F.lit(seed))
    admitted = df.withColumn("_order", order).where(F.pmod("_order", F.lit(1 << 40)) < int((1 << 40) * min(1.0, rows / total)))
    return admitted.orderBy("_order", *df.columns).limit(rows).drop("_order")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not use."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
