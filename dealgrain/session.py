"""Session defaults and durable intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def build_session(app_name: str = "dealgrain", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew handling and UTC dates.

    Shuffle partitions are left to the cluster unless passed in; adaptive execution
    merges small ones, so a generous number is safe at scale.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    It is the folder the cluster names in ``spark.checkpoint.dir``. Only a local
    session without one gets a folder of its own; a cluster session must name it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running on a cluster")
    folder = os.path.join(tempfile.mkdtemp(prefix="run-"), "checkpoints")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table held by the plan itself.

    Unlike a table made from Python rows its size is known to the optimizer, which therefore
    broadcasts it when it is small enough, and no Python worker is needed to read it.
    """
    struct = T.StructType.fromDDL(schema)
    columns = [[row[i] for row in rows] for i in range(len(struct))]
    arrow = to_arrow_schema(struct)
    arrays = [pa.array(values, type=field.type) for values, field in zip(columns, arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow), struct)


def materialise(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared folder and read it back.

    Used where a result feeds several later passes: the lineage is cut, a lost executor
    costs no recomputation, and later readers prune columns from the stored table.
    """
    spark = df.sparkSession
    path = f"{work_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
