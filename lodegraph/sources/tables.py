"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the checkpoint folder that the session names; a temporary one only in local mode."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{named or tempfile.mkdtemp(prefix='lodegraph-')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of the shared folder: what reads it several times computes it once."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """``df`` in at least as many parts as the session has cores, for work on long texts that lie in few row groups."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def commit(df: DataFrame, root: str, publish: bool = True) -> str:
    """A new version of the table under ``root``; readers see it only once its one-row commit record is written.

    A write that fails or is repeated leaves a folder that no record names.
    """
    spark, name = df.sparkSession, f"version-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{name}")
    if publish:
        record = spark.range(1).select(F.lit(name).alias("name"), F.unix_micros(F.current_timestamp()).alias("at"))
        record.coalesce(1).write.mode("append").parquet(f"{root}/commits")
    return name


def latest(spark: SparkSession, root: str) -> DataFrame:
    """The version that was committed last."""
    last = spark.read.parquet(f"{root}/commits").agg(F.max(F.struct("at", "name"))["name"]).first()[0]
    return spark.read.parquet(f"{root}/{last}")
