"""Stage tables in the shared folder: what a stage wrote is not computed again, whatever is lost after it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where none is set and Spark runs on one machine."""
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="wirepost-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """df, written below the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def rows_of(df: DataFrame, name: str) -> DataFrame:
    """stage() of rows as many as flows, sessions or frames: joins with them shuffle and are never broadcast.

    Spark takes the size of files for that of rows. Parquet packs such rows to a tenth, so that the limit for broadcasts
    would let a hundred megabytes through the driver.
    """
    return stage(df, name).hint("merge")
