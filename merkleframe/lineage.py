"""Cutting the lineage of iterative plans with reliable checkpoints."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only for a local session that names none."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir", None)
        if named is None and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def compact(df: DataFrame) -> DataFrame:
    """As ``checkpoint``, in compressed columns: rows of digests and paths take a fraction of the disk. Partitions and order may be others."""
    to = f"{shared_folder(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(to)
    return df.sparkSession.read.schema(df.schema).parquet(to)


def release(spark: SparkSession) -> None:
    """Have Spark remove the shuffle files of DataFrames that are gone; it does so when the JVM has collected them, which may be long after."""
    gc.collect()
    spark._jvm.System.gc()


def checkpoint(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
