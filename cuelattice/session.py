"""Session factory, table access and cuts of lineage."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings every plan here assumes: UTC, AQE, Arrow."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan before a costly function: over all cores where its files make fewer partitions than that.

    Only tables of few files are moved; a large one keeps the partitions it is read in, and what
    comes out of a shuffle those of the shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    execution = df._jdf.queryExecution()
    if execution.executedPlan().nodeName() == "AdaptiveSparkPlan":
        return df
    return df.repartition(cores) if execution.toRdd().getNumPartitions() < cores else df


class NoSharedFolder(RuntimeError):
    """A cluster names no folder that its executors share."""


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the one spark.checkpoint.dir names; only a local session may do without."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        return os.path.join(os.getcwd(), "spark-warehouse", "checkpoints")
    raise NoSharedFolder("set spark.checkpoint.dir to a folder that all executors share")


_cuts: dict[str, list[str]] = {}


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df to a table in the shared folder and read it back.

    Unlike an eager checkpoint this computes df once. The table goes when the driver ends, or with
    drop_cuts once nothing that reads it is to be computed any more.
    """
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{shared_folder(spark)}/{app}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _cuts.setdefault(app, []).append(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def drop_cuts(spark: SparkSession, keep: int = 0) -> int:
    """Delete the tables of the cuts so far, but for the first keep; how many they were. DataFrames that read them can no longer be computed."""
    paths = _cuts.get(spark.sparkContext.applicationId, [])
    dropped = paths[keep:]
    del paths[keep:]
    for path in dropped:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(dropped)


@contextmanager
def dropping_cuts(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables of the cuts made inside, at its end; what was cut before stays."""
    before = len(_cuts.get(spark.sparkContext.applicationId, []))
    try:
        yield
    finally:
        drop_cuts(spark, before)
