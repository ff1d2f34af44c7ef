"""Stage results as tables, and subtitle text as files."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from cuelattice import schemas

SCHEMAS = {"videos": schemas.VIDEO, "samples": schemas.SAMPLE, "ocr": schemas.RESULT, "tracks": schemas.TRACK, "segments": schemas.SEGMENT, "translations": schemas.TRANSLATION, "events": schemas.EVENT}


class IncompleteResults(RuntimeError):
    """Samples without a recognition result."""


class Workspace:
    """Tables of a run in one folder of a shared file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def write(self, name: str, df: DataFrame, partition_by: str | None = None, mode: str = "overwrite") -> None:
        writer = df.write.mode(mode)
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(self.path(name))

    def read(self, name: str, missing_ok: bool = True) -> DataFrame:
        """A stage's table; an empty one of its schema where the stage has not run."""
        if missing_ok and not self.exists(name):
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.parquet(self.path(name))


def samples_json(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a document with a header and a list of samples."""
    doc = spark.read.option("multiLine", True).schema("interval double, duration double, samples array<struct<index:int,timestamp:double,path:string,sha256:string,status:string>>").json(path)
    return doc.select("interval", "duration", F.explode("samples").alias("s")).select("interval", "duration", F.col("s.index").alias("sample_index"), F.col("s.timestamp").alias("timestamp_s"), "s.path", "s.sha256", "s.status")


def image_hashes(spark: SparkSession, pattern: str) -> DataFrame:
    """path and sha256 of every file that a pattern names; file contents never leave the executors."""
    return spark.read.format("binaryFile").load(pattern).select("path", F.sha2("content", 256).alias("sha256"))


def complete_results(samples: DataFrame, results: DataFrame) -> DataFrame:
    """Results in the samples' order of keys; raises where a sample has none."""
    keys = ["video_id", "sample_index"]
    missing = samples.join(results.select(*keys), keys, "left_anti").limit(1).count()
    if missing:
        raise IncompleteResults("some samples have no result")
    return samples.select(*keys).join(results, keys)


def write_lines(lines: DataFrame, name: Callable[[Row], str | Path]) -> list[str]:
    """lines: video_id, n, part, line -> a file for each video, under the name made of one of its rows.

    Lines are sorted over all videos and pass the driver a partition at a time, so a video may be of
    any length. Readers see a file when it is whole.
    """
    written: list[str] = []
    video, file, path = object(), None, None

    def done() -> None:
        if file is not None:
            file.close()
            os.replace(path.with_name(path.name + ".part"), path)
            written.append(str(path))

    try:
        for row in lines.orderBy("video_id", "n", "part").toLocalIterator():
            if row["video_id"] != video:
                done()
                video, path = row["video_id"], Path(name(row))
                path.parent.mkdir(parents=True, exist_ok=True)
                file = path.with_name(path.name + ".part").open("w", encoding="utf-8", newline="\n")
            file.write(row["line"])
        done()
    finally:
        if file is not None:
            file.close()
    return written
