"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings that matter for the plans of this package; sizes are left to the cluster.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}

# Texts go to the Python workers in batches of at most so many bytes: JVM and worker each hold a batch more than once.
BATCH_BYTES = "4m"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; on a cluster the session is given."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("textvane")
    builder = builder.config("spark.driver.memory", memory)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by spark.checkpoint.dir.

    Where the setting is absent a temporary folder is taken, in local mode only:
    on a cluster a machine-local folder would lose data with its machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="textvane-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return os.path.join(shared_dir(spark), "textvane", f"{label}-{uuid.uuid4().hex}")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is run inside sends Arrow batches of at most BATCH_BYTES, however many rows that is."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    given = spark.conf.get(name)
    spark.conf.set(name, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(name, given)


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Used where a value must not be computed twice (row positions) or where several
    branches read the same costly rows. Unlike a cache it outlives lost executors.
    """
    path = new_path(df.sparkSession, label)
    df.write.mode("error").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def discard(*staged: DataFrame) -> None:
    """Remove tables that `stage` returned, once nothing unwritten reads them any more."""
    for df in staged:
        spark = df.sparkSession
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._staged)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
