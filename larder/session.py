"""Session helpers.

`get_session` is for tests, the bench and local runs. On a cluster the caller
brings its own session; the library only reads settings from it.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings the library relies on: AQE re-plans joins at run time and splits
# skewed join partitions (a popular recipe or customer), UTC makes report days
# repeatable.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Remove numbering checkpoints once their DataFrame is out of scope.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName("larder")
    if master:
        builder = builder.master(master)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in {**_DEFAULTS, **conf}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediate tables.

    Taken from `spark.checkpoint.dir` as the cluster sets it. Only when it is
    unset (a local test session) do we pick a scratch folder of our own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = os.path.join(tempfile.gettempdir(), f"larder-ckpt-{uuid.uuid4().hex[:8]}")
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    base = checkpoint_dir(spark)
    return f"{base.rstrip('/')}/larder/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def conf_set(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """`key` set for what starts within."""
    old = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


#: Parquet codec of what is kept for a while or grows with a stream.
COMPACT = "zstd"
#: Files that a query's exchanges wrote go when it ends, and not when the driver happens to collect its garbage.
DROP_SHUFFLES = ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


@contextmanager
def kept_rows(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function that writes rows to the shared scratch folder, compressed, and gives them back as read from there.
    The files go at the end of the block, and nothing that reads them may run later."""
    paths: list[str] = []

    def keep(rows: DataFrame) -> DataFrame:
        paths.append(scratch_path(spark, "kept"))
        rows.write.option("compression", COMPACT).parquet(paths[-1])
        return spark.read.schema(rows.schema).parquet(paths[-1])

    try:
        yield keep
    finally:
        for path in paths:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
