"""The folder that driver and executors share, for intermediate tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder serves a local master, and a cluster is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="quittance-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Bytecode of a method that HotSpot compiles; Spark's own limit lets far larger ones be interpreted for every row.
COMPILED_BYTES = 8000


def compiled_code(spark: SparkSession) -> None:
    """Keeps generated methods small enough to be compiled, unless the application or the session has a limit of its own."""
    key = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(key, None) in (None, "65535"):
        spark.conf.set(key, str(COMPILED_BYTES))


#: Bytes of a batch of pixels that goes to Python; several steps of a task hold one each, and copies of it.
PIXEL_BYTES = 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Keeps batches of pixels small, unless the application or the session has a limit of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in (None, "67108864b", "64MB"):
        spark.conf.set(key, str(PIXEL_BYTES))


def sorted_aggregates(spark: SparkSession) -> None:
    """Lets aggregates over rows that lie in order take a group at a time, where Spark would hash them and sort them again when they are many."""
    spark.conf.set("spark.sql.execution.replaceHashWithSortAgg", "true")


def receipts_together(spark: SparkSession) -> None:
    """Lets joins by receipt, page and token use rows that lie by receipt already, so tokens are not moved again for each of them."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder: what models and pixels cost is paid once, also when an executor is lost."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder that nothing reads any more, in whatever store it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
