"""Incremental landing: new payload files to partitions and status rows, each file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.status import upsert_status
from ..sources.writers import land


def land_new_files(spark: SparkSession, inbox: str, schema: str, target: str, checkpoint: str):
    """Land files that appeared since the last call and stop; returns the finished query.

    The checkpoint remembers which files were read. A batch repeated after a failure replaces
    the same partitions, so nothing is doubled.
    """
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(inbox)

    def write(batch: DataFrame, _: int) -> None:
        land(batch, target)

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def apply_attempts(spark: SparkSession, inbox: str, schema: str, table: str, checkpoint: str):
    """Fold new collection attempts into the status table, one version folder per batch.

    Every batch reads the version before it, so a repeated batch gives the same result.
    """
    stream = spark.readStream.schema(schema).json(inbox)

    def write(batch: DataFrame, batch_id: int) -> None:
        from ..sources.status import latest_status

        if batch_id == 0:
            new = latest_status(batch)
        else:
            new = upsert_status(spark.read.parquet(f"{table}/version={batch_id - 1}"), batch)
        new.write.mode("overwrite").parquet(f"{table}/version={batch_id}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def current_status(spark: SparkSession, table: str) -> DataFrame:
    """The newest version of the status table."""
    rows = spark.read.option("mergeSchema", "true").parquet(table)
    newest = rows.agg(F.max("version").alias("v")).scalar()
    return rows.withColumn("_v", newest).where(F.col("version") == F.col("_v")).drop("version", "_v")
