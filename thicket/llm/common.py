"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def every(df: DataFrame) -> list[Column]:
    """All columns, whatever signs their names hold."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there.

    The folder is the session's ``spark.checkpoint.dir``; only where that is
    unset and all of Spark runs on this machine a temporary one is made.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="thicket-"))
    return df.checkpoint(eager=True)


#: Rows and bytes of an Arrow batch at most: what a task holds of its texts outside the JVM's heap, and again in Python.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of this session small; operators with Python in them call it, and leave it so, as their plans run later."""
    for name, most in BATCH.items():
        spark.conf.set(name, most)


def remainder(column, n: int):
    """crc32 of the id's decimal text, modulo ``n``: what the folds go by."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(n)
