"""Streams of samples: windows of delivery time, and the tracking fold over micro-batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelattice.config import Settings
from cuelattice.operators.samples import counting_rows
from cuelattice.operators.tracking import EVENT, quiescent_stretches, shows_text, track_events
from cuelattice.session import cut_lineage, dropping_cuts, shared_folder


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A table's files as a stream, in the order they were written."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)  # a stream reads folders only


def delivery_windows(samples: DataFrame, width: str = "1 hour", lateness: str = "2 days") -> DataFrame:
    """Samples by window of delivery time and status; rows later than lateness behind the newest are let go by the state."""
    timed = samples.where(F.col("ingested_at").isNotNull()).withColumn("ingested_at", F.col("ingested_at").cast("timestamp")).withWatermark("ingested_at", lateness)
    counts = timed.groupBy(F.window("ingested_at", width).alias("w"), "status").agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), "status", "n")


SLIM = ("video_id", "sample_index", "ingested_at", "status", "timestamp_s", "blocks")


class TrackingSteps:
    """The tracking fold over micro-batches; what is settled is folded, by the batch operator, and the rest kept.

    Samples are settled up to the end of a video's last stretch that enough samples without text
    follow, as no later sample changes its events, but not those within lateness samples of the
    newest, which may still come out of order or again. The state is a table of unsettled samples
    and a row a video with its settled number, in a folder of each step. A step reads that of the
    step before and writes its own, so a repeated step has the same result. Samples at or below the
    settled number are too late.
    """

    def __init__(self, spark: SparkSession, videos: DataFrame, settings: Settings, root: str, lateness: int = 0):
        self.spark, self.videos, self.settings, self.root, self.lateness = spark, videos, settings, root, lateness

    def _at(self, name: str, step: int) -> str:
        return f"{self.root}/{name}/step={step}"

    def _before(self, name: str, step: int, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self._at(name, step - 1)) if step else self.spark.createDataFrame([], schema)

    def __call__(self, batch: DataFrame, step: int) -> None:
        self.fold(batch.select(*SLIM).withColumn("ingested_at", F.col("ingested_at").cast("timestamp")).where("video_id is not null and sample_index is not null"), step)

    def finish(self, schema, step: int) -> None:
        """Fold what is left when no sample comes any more."""
        self.fold(self.spark.createDataFrame([], schema), step, last=True)

    def fold(self, samples: DataFrame, step: int, last: bool = False) -> None:
        with dropping_cuts(self.spark):
            bounds = self._before("bounds", step, "video_id long, settled int")
            fresh = samples.join(bounds, "video_id", "left").where(F.coalesce(F.col("sample_index") > F.col("settled"), F.lit(True))).drop("settled")
            held = cut_lineage(counting_rows(self._before("held", step, samples.schema).unionByName(fresh), ["status", "timestamp_s", "blocks"], "arrived"))
            upto = cut_lineage(held.groupBy("video_id").agg(F.max("sample_index").alias("settled")) if last else self._settled(held))
            split = held.join(upto, "video_id", "left")
            settled = F.coalesce(F.col("sample_index") <= F.col("settled"), F.lit(False))
            rows = lambda kept: split.where(kept).select(*[F.col("arrived").alias(c) if c == "ingested_at" else F.col(c) for c in SLIM])
            track_events(rows(settled), self.videos, self.settings).write.mode("overwrite").parquet(self._at("events", step))
            rows(~settled).write.mode("overwrite").parquet(self._at("held", step))
            bounds.unionByName(upto).groupBy("video_id").agg(F.max("settled").alias("settled")).write.mode("overwrite").parquet(self._at("bounds", step))

    def _settled(self, held: DataFrame) -> DataFrame:
        """video_id, settled: the sample number up to which nothing can change."""
        newest = held.groupBy("video_id").agg((F.max("sample_index") - self.lateness).alias("newest"))
        due = held.join(newest, "video_id").where(F.col("sample_index") <= F.col("newest"))
        ok = due.where((F.col("status") != "failed") & F.col("timestamp_s").isNotNull()).select("video_id", "sample_index", shows_text(F.col("blocks"), held.schema["blocks"].dataType).alias("busy"))
        busy = quiescent_stretches(ok, self.settings.gap_tolerance)
        final = busy.groupBy("video_id").agg(F.max(F.struct("stretch")).alias("top"), F.max("sample_index").alias("shown"))
        begins = busy.join(final, "video_id").where(F.col("stretch") == F.col("top.stretch")).groupBy("video_id").agg(F.min("sample_index").alias("begins"), F.first("shown").alias("shown"))
        silent = ok.join(begins, "video_id").where(F.col("sample_index") > F.col("shown")).groupBy("video_id").agg(F.count("*").alias("silent"))
        facts = due.groupBy("video_id").agg(F.max("sample_index").alias("upto")).join(begins, "video_id", "left").join(silent, "video_id", "left")
        over = F.col("begins").isNull() | (F.coalesce("silent", F.lit(0)) > self.settings.gap_tolerance)
        return facts.select("video_id", F.when(over, F.col("upto")).otherwise(F.col("begins") - 1).cast("int").alias("settled"))


def track_to_table(samples: DataFrame, videos: DataFrame, settings: Settings = Settings(), lateness: int = 0) -> DataFrame:
    """Events of a stream of samples, run over what is there and to its end: the same as of the batch operator unless samples come later than lateness.

    The folder of the result stays until the driver ends.
    """
    spark = samples.sparkSession
    root = scratch(spark)
    steps = TrackingSteps(spark, videos, settings, root, lateness)
    query = samples.writeStream.foreachBatch(steps).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    done = query.lastProgress
    schema = samples.select(*SLIM).withColumn("ingested_at", F.col("ingested_at").cast("timestamp")).schema
    steps.finish(schema, done["batchId"] + 1 if done and done["numInputRows"] else (done["batchId"] if done else 0))
    return spark.read.schema(EVENT).parquet(f"{root}/events").select(*[x.strip().split()[0] for x in ("video_id", "start_s", "end_s", "source_text", "bbox", "reading_order", "label", "confidence", "sample_indices", "observation_count", "close_seq")])


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one, deleted when the driver ends."""
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return root


def run_to_table(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what is there and read its result back from the shared folder.

    In complete mode every batch replaces the result; in append mode each adds to it.
    """
    root = scratch(stream.sparkSession)
    write = "overwrite" if mode == "complete" else "append"

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode(write).parquet(f"{root}/rows" if mode == "complete" else f"{root}/rows/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    read = stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/rows")
    return read.select(*stream.columns)
