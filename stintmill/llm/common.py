"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A single-process local session that names none gets a temporary folder; any
    other session must name one, since executors do not share local disks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: later jobs start from the files,
    not from the lineage, and a lost executor loses none of them."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shielded(docs: DataFrame, **used: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with every column under a name that no operator takes for its own, and the way back.

    used: the names that the operator gives to columns that it works on, by keyword to the column's own name.
    """
    own = {c: n for n, c in used.items()}
    names = {c: own.get(c, f"kept_{k}_") for k, c in enumerate(docs.columns)}
    hidden = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    return hidden, lambda out: out.select(*[F.col(n).alias(c) for c, n in names.items()])


BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession, rows: int = 4000) -> None:
    """Arrow batches hold so many rows and about BATCH_BYTES bytes at most, so whole texts stay small
    enough for a Python worker. These are settings of the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def small_methods(spark: SparkSession) -> None:
    """Generated methods over 8,000 bytes of bytecode, which the JVM never compiles, are split instead; they come from
    expressions over dozens of columns. This is a setting of the session."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
