"""What the corpus operators share: reading, text columns, checkpoints."""

from __future__ import annotations

import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch handed to a Python worker, so that long texts do not pile up in memory.
ARROW_BATCH_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, unless the application or the session has a bound of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(ARROW_BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where none is set, a temporary folder serves a local master, as in tests;
    a cluster without one is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="quittance-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Removes an intermediate folder that nothing reads any more, in whatever store it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """(the rows, written to the shared folder and read again; their path).

    For steps that repeat: a checkpoint hands on the size that the plan before it
    was estimated at, which every join multiplies, so that after some rounds the
    number alone fills the driver. What is read has the size of its files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that is not to be broadcast, however small: what is broadcast lies in the driver, and steps that repeat pile it up there."""
    return df.hint("merge")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; pure ASCII takes the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )
