"""Tables that a later job needs again, written to the shared folder."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def written(df: DataFrame, name: str) -> DataFrame:
    """df written under ``spark.checkpoint.dir`` and read back, so later jobs start from files and a lost executor
    loses none of them. A local session that names no folder gets a temporary one."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        base = spark.sparkContext.getCheckpointDir()
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts_for(spark: SparkSession, rows: int, a_part: int) -> int:
    """Parts of at most about ``a_part`` rows, so that what a task holds does not grow with the table; at least one a core."""
    return max(spark.sparkContext.defaultParallelism, math.ceil(rows / a_part))
