"""All stages over many videos at once: each one a table, skipped where its parameters have not changed."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from cuelattice import schemas
from cuelattice.config import Settings, stable_hash
from cuelattice.functions.keys import image_key
from cuelattice.journal import STAGES, Journal, stage_bounds, write_atomically
from cuelattice.operators import adapter, cleanup, compose, dedupe, emit, stats, tracking, translate
from cuelattice.session import cut_lineage, dropping_cuts
from cuelattice.sources import media, tables

CACHE_COLUMNS = "cache_key string, normalized string, raw string, created_at timestamp, hit_count long"


class StrictError(RuntimeError):
    """Something failed in a run that allows no failure."""


#: Parts in which images are recognised; each is kept once it is done.
SLICES = 8


class Pipeline:
    """Stages of one run. Models and tools come as functions, so that any can be replaced; log is told of each stage."""

    def __init__(
        self, spark: SparkSession, settings: Settings, root: str, inputs: DataFrame, *, probe: Callable[[DataFrame], DataFrame] | None = None,
        sample: Callable[[DataFrame], DataFrame] | None = None, make_recogniser: Callable[[], media.Recogniser] | None = None, fingerprint: dict | None = None,
        make_chat: Callable[[], translate.Chat] | None = None, make_transcribe: Callable[[], media.Transcribe] | None = None, model: str = "none", cache: str | None = None,
        log: Callable[[str], None] | None = None, beside_inputs: bool = False,
    ):
        self.spark, self.settings, self.inputs, self.model = spark, settings, inputs, model
        self.work = tables.Workspace(spark, root)
        Path(root).mkdir(parents=True, exist_ok=True)
        self.cache = tables.Workspace(spark, cache or f"{root}/cache")
        self.journal = Journal(Path(root) / "manifest.json")
        self.probe = probe or media.probe_videos
        self.sample = sample or (lambda videos: media.sample_videos(videos, f"{root}/frames", settings))
        self.make_recogniser = make_recogniser or (lambda: media.make_recogniser(settings))
        self.fingerprint, self.make_chat, self.make_transcribe = fingerprint, make_chat, make_transcribe
        self.log, self.beside_inputs = log or (lambda line: None), beside_inputs
        self.stats: dict = {"durations": {}}

    def run(self, only: str | None = None, first: str | None = None, last: str | None = None) -> dict:
        low, high = stage_bounds(only, first, last)
        paths = [tuple(r) for r in self.inputs.orderBy("video_id").collect()]  # one small row a video file
        self.journal.add("input", digest=stable_hash(paths))
        for name in STAGES[low : high + 1]:
            digest = self.settings.stage_hash(name, self.fingerprint, self.model)
            if name == "ocr" and self.journal.standing.holds("ocr", former := self.settings.former_ocr_hash(self.fingerprint)) and former != digest:
                self.journal.add("renamed", stage="ocr", former=former, digest=digest)
                self._rename_cached(former, digest)
            if self.journal.standing.holds(name, digest):
                self.log(f"{name}: done before")
                continue
            began = time.monotonic()
            self.log(f"{name}: begins")
            self.journal.add("began", stage=name, digest=digest)
            with dropping_cuts(self.spark):
                getattr(self, f"_{name}")()
            self.journal.add("ended", stage=name, digest=digest)
            self.stats["durations"][name] = round(time.monotonic() - began, 3)
            self.log(f"{name}: {self.stats['durations'][name]} s")
        self.stats["outcome"] = self._outcome(len(paths))
        write_atomically(Path(self.work.root) / "stats.json", json.dumps(self.stats, ensure_ascii=False, indent=2))
        return self.stats

    def _outcome(self, inputs: int) -> dict:
        """How many inputs came through, and why the others did not; a row each for those only."""
        failed = [r.asDict() for name in ("probe", "sample") if self.work.exists(f"failed_{name}") for r in self.spark.read.parquet(self.work.path(f"failed_{name}")).orderBy("video_id").collect()]
        return {"inputs": inputs, "succeeded": inputs - len(failed), "failed": failed}

    def _split(self, stage: str, table: str, rows: DataFrame) -> None:
        """Write a table, and apart from it the videos for which it could not be made."""
        if "error" not in rows.columns:
            self.work.write(table, rows)
            return
        made = cut_lineage(rows)
        self.work.write(table, made.where("error is null").drop("error"))
        self.work.write(f"failed_{stage}", made.where("error is not null").select("video_id", "error"))

    def _probe(self) -> None:
        self._split("probe", "videos", self.probe(self.inputs))
        self.journal.add("facts", facts={"videos": self.work.read("videos").count()})

    def _sample(self) -> None:
        self._split("sample", "samples", self.sample(self.work.read("videos")))
        frames = self.work.read("videos")
        if "avg_fps" in frames.columns:
            share = stats.reduction(self.work.read("samples"), frames.select("video_id", "duration", F.col("avg_fps").alias("fps")))
            self.stats["reduction"] = share.agg(F.avg("share")).first()[0]

    def _recognised(self, missing: DataFrame, digest: str) -> DataFrame:
        """Results of images, in parts that a stopped run keeps; failed ones are not tried again."""
        name = f"recognised/{digest[:16]}"
        schema = "sha256 string, status string, raw string"
        for part in range(SLICES):
            done = self.spark.read.schema(schema).parquet(self.work.path(name)) if self.work.exists(name) else self.spark.createDataFrame([], schema)
            todo = dedupe.pending(missing.where(F.pmod(F.xxhash64("sha256"), F.lit(SLICES)) == part), done, ["sha256"])
            self.work.write(name, media.recognise_images(todo, self.make_recogniser, self.settings.ocr_batch_size), mode="append")
        return self.spark.read.schema(schema).parquet(self.work.path(name)).withColumnRenamed("sha256", "cache_key").join(missing.select(F.col("sha256").alias("cache_key")), "cache_key", "left_semi")

    def _ocr(self) -> None:
        """Every distinct image once, and only those that no earlier run has seen."""
        params = self.settings.stage_params("ocr", self.fingerprint)
        samples = self.work.read("samples").withColumn("cache_key", image_key(F.col("sha256"), params))
        images = dedupe.representatives(samples.select("cache_key", "path", "sha256"), "cache_key", "path")
        known = cut_lineage(self._cached())  # its table is rewritten below
        found = dedupe.look_up(images, known.select("cache_key", F.col("raw").alias("cached")))
        missing = cut_lineage(found.where(~F.col("hit")).select(F.col("cache_key").alias("sha256"), "path"))
        new = cut_lineage(self._recognised(missing, self.settings.stage_hash("ocr", self.fingerprint)))
        if not self.settings.no_ocr_cache:
            rows = new.where("status = 'ok'").select("cache_key", F.lit(None).cast("string").alias("normalized"), "raw", F.current_timestamp().alias("created_at"))
            counted = dedupe.count_hits(known, found.select("cache_key", "hit")) if self.cache.exists("images") else known
            self.cache.write("images", cut_lineage(dedupe.upsert(counted, rows)))
        raw = new.select("cache_key", "status", "raw").unionByName(known.join(images.select("cache_key"), "cache_key", "left_semi").select("cache_key", F.lit("ok").alias("status"), "raw"))
        facts = self.work.read("videos").select("video_id", "width", "height")
        results = samples.drop("status").join(raw, "cache_key").join(facts, "video_id", "left")
        # boxes of a picture without a size have no place in it
        sized = F.coalesce((F.col("width") > 0) & (F.col("height") > 0), F.lit(False))
        results = results.withColumn("status", F.when(sized, F.col("status")).otherwise("failed")).withColumn("raw", F.when(sized, F.col("raw")))
        blocks = adapter.parse_blocks(results.select("video_id", "sample_index", "width", "height", "raw"), self.settings.ocr_confidence)
        struct = F.struct("block_no", F.concat_ws("-", "sample_index", "block_no").alias("id"), "bbox", "source_text", "label", "reading_order", "confidence", "language")
        listed = blocks.groupBy("video_id", "sample_index").agg(F.sort_array(F.collect_list(struct)).alias("b"))
        made = results.select("video_id", "sample_index", "timestamp_s", "status").join(listed, ["video_id", "sample_index"], "left")
        plain = F.transform(F.coalesce("b", F.array().cast(listed.schema["b"].dataType)), lambda b: F.struct(*[b[c].alias(c) for c in ("id", "bbox", "source_text", "label", "reading_order", "confidence", "language")]))
        self.work.write("ocr", made.select("video_id", "sample_index", "timestamp_s", "status", adapter.renumber_blocks(plain, F.col("sample_index")).alias("blocks")))
        written = self.work.read("ocr")
        counts = stats.recognition_counters(written).agg(*[F.sum(c).alias(c) for c in ("n_samples", "n_failed", "n_no_text", "n_blocks")]).first().asDict()
        # a sample whose image was known, or is another sample's of this run, is a hit unless it failed
        recognised, failed = new.count(), new.where("status = 'failed'").count()
        n = {k: v or 0 for k, v in counts.items()}
        hits = n["n_samples"] - n["n_failed"] - (recognised - failed)
        self.stats["ocr"] = n | {"images": images.count(), "recognised": recognised, "batches": -(-recognised // self.settings.ocr_batch_size), "cache_hits": hits, "cache_misses": recognised, "hit_rate": hits / n["n_samples"] if n["n_samples"] else None}
        if self.settings.strict and n["n_failed"]:
            raise StrictError(f"{n['n_failed']} samples failed")

    def _cached(self) -> DataFrame:
        if self.settings.no_ocr_cache or not self.cache.exists("images"):
            return self.spark.createDataFrame([], CACHE_COLUMNS)
        return self.spark.read.parquet(self.cache.path("images"))

    def _rename_cached(self, old: str, new: str) -> None:
        """Cached images keep their results when only the way the hash is made has changed."""
        if self.cache.exists("images"):
            self.cache.write("images", cut_lineage(dedupe.migrate_keys(self._cached(), old, new)))

    def _track(self) -> None:
        results = tables.complete_results(self.work.read("samples"), self.work.read("ocr")).withColumn("ingested_at", F.lit(None).cast("timestamp"))
        facts = self.work.read("videos").select("video_id", "duration", F.lit(self.settings.interval).alias("sample_interval"))
        self.work.write("tracks", tracking.numbered_events(tracking.track_events(results, facts, self.settings)))

    def _asr(self) -> None:
        """Speech is empty where it is not asked for, and an error where it is but nothing can make it."""
        if not self.settings.audio_transcribe:
            self.work.write("segments", self.spark.createDataFrame([], schemas.SEGMENT))
            return
        settings, folder = self.settings, f"{self.work.root}/sound"
        if self.make_transcribe is None:
            media.make_transcriber(settings, folder)  # raises here, not on an executor
        make = self.make_transcribe or (lambda: media.make_transcriber(settings, folder))
        self.work.write("segments", media.speech_segments(self.work.read("videos"), make, settings))
        self.stats["asr"] = {"segments": self.work.read("segments").count()}

    def _cues(self) -> DataFrame:
        return compose.compose_cues(self.work.read("tracks"), self.settings.reading_order, ["event_no"])

    def _translate(self) -> None:
        wanted = translate.distinct_cues(self._cues(), self.work.read("segments"))
        if self.make_chat is None:
            self.work.write("translations", self.spark.createDataFrame([], schemas.TRANSLATION))
            return
        self.work.write("translations", translate.translate_keys(wanted, self.make_chat, self.settings.source_lang, self.settings.target_lang))
        done = self.work.read("translations").agg(
            F.count("*").alias("unique_cues"), F.count_if(F.size("failed") > 0).alias("failed_cues"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"), F.coalesce(F.sum("misses"), F.lit(0)).alias("misses")
        )
        counts = done.withColumn("hit_rate", F.try_divide(F.col("hits"), F.col("hits") + F.col("misses"))).first().asDict()
        self.stats["translate"] = counts
        if self.settings.strict and counts["failed_cues"]:
            raise StrictError(f"{counts['failed_cues']} cues kept source lines")

    def _cleanup(self) -> None:
        videos, done = self.work.read("videos"), self.work.read("translations")
        screen = cleanup.finalize_cues(self._cues(), done, videos)
        audio = cleanup.finalize_audio(self.work.read("segments"), done, videos, ["seg_no"])
        self.work.write("events", cleanup.merge_events(screen, audio))

    def _emit(self) -> None:
        events = self.spark.read.parquet(self.work.path("events"))
        videos = self.work.read("videos")
        made = {"srt": emit.srt_lines(events, self.settings.bilingual), "ass": emit.ass_lines(events, videos, self.settings)}
        self.stats["outputs"] = [path for kind, lines in made.items() for path in tables.write_lines(lines.join(videos.select("video_id", "path"), "video_id"), self._named(kind))]

    def _named(self, kind: str) -> Callable[[Row], Path]:
        """The place of a video's file: beside the input under its name, or in the run's folder under its number."""
        lang, root = self.settings.target_lang, Path(self.work.root)
        if self.beside_inputs:
            return lambda row: Path(row["path"]).with_name(f"{Path(row['path']).stem}.{lang}.{kind}")
        return lambda row: root / "out" / f"{row['video_id']}.{lang}.{kind}"
