"""Parquet tables by name."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """df as a table in the folder of spark.checkpoint.dir, which driver and executors share: what comes after reads it and doesn't compute it again.

    Only in local mode, and where the session names no folder, one of our own is taken.
    """
    spark = df.sparkSession
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        at = spark.conf.get("spark.checkpoint.dir", "")
        if not at and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(at or "file://" + tempfile.mkdtemp(prefix="scoreframe-written-"))
    return df.checkpoint(eager=True)
