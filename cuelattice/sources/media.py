"""Videos, frames and speech as rows, through command-line tools and models behind small interfaces.

Tools and models run on executors, one video or one batch of images at a time, and are made once a
task. Everything that needs one takes it as a function, so tests and machines without the tools
put in their own.
"""

from __future__ import annotations

import glob
import hashlib
import importlib.metadata
import importlib.util
import json
import os
import shutil
import subprocess
import uuid
import warnings
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cuelattice import schemas
from cuelattice.config import SERVER_BACKENDS, Settings
from cuelattice.functions.parse import stream_rotation, valid_interval

Run = Callable[[list[str]], str]


class ToolError(RuntimeError):
    """A tool is missing or failed."""


def expand_inputs(patterns: Iterable[str]) -> list[str]:
    """Files that patterns name, in order, each once; names without a wildcard stay as they are, one that names nothing is warned of."""
    found: dict[str, str] = {}
    for pattern in patterns:
        names = sorted(glob.glob(pattern)) if any(c in pattern for c in "*?[") else [pattern]
        if not names:
            warnings.warn(f"nothing is named {pattern}", stacklevel=2)
        for name in names:
            found.setdefault(os.path.realpath(name), name)
    return list(found.values())


def check_tools(*names: str) -> None:
    missing = [n for n in names or ("ffmpeg", "ffprobe") if shutil.which(n) is None]
    if missing:
        raise ToolError(f"not found: {', '.join(missing)}")


def run_tool(command: list[str]) -> str:
    """Standard output; the end of standard error is in the error of a failure."""
    done = subprocess.run(command, capture_output=True, text=True)
    if done.returncode:
        raise ToolError(f"{command[0]} failed: {done.stderr[-2000:]}")
    return done.stdout


def _number(*values: object) -> float | None:
    for value in values:
        try:
            return float(value)  # type: ignore[arg-type]
        except (TypeError, ValueError):
            continue
    return None


def _rate(text: str | None) -> float:
    top, _, bottom = (text or "").partition("/")
    n, d = _number(top), _number(bottom) if bottom else 1.0
    return n / d if n is not None and d else 0.0


def probe(path: str, run: Run = run_tool) -> dict:
    """Facts of a video: of its container first, then of its first picture stream."""
    shown = json.loads(run(["ffprobe", "-v", "error", "-show_format", "-show_streams", "-of", "json", path]))
    streams = shown.get("streams") or []
    video = next((s for s in streams if s.get("codec_type") == "video"), {})
    box = shown.get("format") or {}
    rotation = stream_rotation(video)
    w, h = int(video.get("width") or 0), int(video.get("height") or 0)
    turned = rotation in (90, 270)
    return {
        "path": path, "duration": _number(box.get("duration"), video.get("duration")), "start_time": _number(box.get("start_time"), video.get("start_time")) or 0.0,
        "coded_width": w, "coded_height": h, "width": h if turned else w, "height": w if turned else h, "rotation": rotation,
        "r_frame_rate": video.get("r_frame_rate"), "avg_frame_rate": video.get("avg_frame_rate"), "avg_fps": _rate(video.get("avg_frame_rate")),
        "has_audio": any(s.get("codec_type") == "audio" for s in streams),
    }


def _each_alone(names: list[str], make: Callable[..., list[dict]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows of each video; what fails for one is in the error of a row of its own."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows: list[dict] = []
            for video, *rest in frame.itertuples(index=False, name=None):
                try:
                    rows += [{"video_id": video, "error": None} | row for row in make(video, *rest)]
                except Exception as error:  # noqa: BLE001 - one video does not end the others
                    rows.append({"video_id": video, "error": f"{type(error).__name__}: {error}"[:2000]})
            yield pd.DataFrame([{name: row.get(name) for name in names} for row in rows], columns=names, dtype=object)

    return run


def _with_error(schema: str) -> tuple[list[str], str]:
    return [*(x.split()[0] for x in schema.split(", ")), "error"], f"{schema}, error string"


def probe_videos(paths: DataFrame, run: Run = run_tool) -> DataFrame:
    """paths: video_id, path -> videos, and error."""
    names, schema = _with_error(schemas.VIDEO)
    return paths.select("video_id", "path").mapInPandas(_each_alone(names, lambda _, path: [probe(path, run)]), schema)


def plain_number(x: float) -> str:
    """A decimal without exponent, as tools read it."""
    return f"{x:.6f}".rstrip("0").rstrip(".")


def file_sha256(path: str) -> str:
    with open(path, "rb") as file:
        return hashlib.file_digest(file, "sha256").hexdigest()


def sample_frames(path: str, folder: str, duration: float, settings: Settings, run: Run = run_tool) -> list[dict]:
    """Frames of a video at its interval, as images in a folder that all executors see."""
    if not valid_interval(settings.interval):
        raise ValueError(f"interval out of range: {settings.interval}")
    Path(folder).mkdir(parents=True, exist_ok=True)
    for old in Path(folder).glob("*.jpg"):
        old.unlink()
    filters = f"fps=1/{plain_number(settings.interval)}" + (f",scale='min({settings.max_width},iw)':-2" if settings.max_width else "")
    run(["ffmpeg", "-v", "error", "-i", path, "-vf", filters, "-q:v", str(settings.image_quality), "-fps_mode", "vfr", f"{folder}/%08d.jpg"])
    frames = sorted(str(p) for p in Path(folder).glob("*.jpg"))
    return [
        {"sample_index": i + 1, "timestamp_s": round(min(i * settings.interval, duration), 3), "path": p, "sha256": file_sha256(p), "status": "pending"}
        for i, p in enumerate(frames)
    ]


def sample_videos(videos: DataFrame, root: str, settings: Settings, run: Run = run_tool) -> DataFrame:
    """videos: video_id, path, duration -> samples, and error."""
    names, schema = _with_error(schemas.SAMPLE)
    return videos.select("video_id", "path", "duration").mapInPandas(_each_alone(names, lambda v, path, duration: sample_frames(path, f"{root}/{v}", duration, settings, run)), schema)


class Recogniser(Protocol):
    """Text of images; a task makes one and releases it at its end."""

    def recognise(self, paths: list[str]) -> list[str]:
        """Raw JSON results, one an image."""

    def release(self) -> None: ...


class VisionRecogniser:
    """The public document parser of the paddleocr package, loaded when it is first asked."""

    def __init__(self, settings: Settings):
        self.settings, self.model = settings, None

    def options(self) -> dict:
        s = self.settings
        found = {"device": None if s.ocr_device == "auto" else s.ocr_device, "engine": s.paddleocr_engine}
        if s.ocr_server_url:
            found |= {
                "vl_rec_backend": s.ocr_server_backend, "vl_rec_server_url": s.ocr_server_url, "vl_rec_api_model_name": s.ocr_server_model or s.paddleocr_model, "vl_rec_api_key": os.environ.get(s.ocr_api_key_env),
            }
        return {k: v for k, v in found.items() if v}

    def recognise(self, paths: list[str]) -> list[str]:
        if self.model is None:
            try:
                from paddleocr import PaddleOCRVL
            except ImportError as error:
                raise ToolError("the paddleocr package is not installed") from error
            self.model = PaddleOCRVL(**self.options())
        return [json.dumps(next(iter(self.model.predict(path))).json, ensure_ascii=False, default=str) for path in paths]

    def release(self) -> None:
        self.model = None


RECOGNISERS: dict[str, Callable[[Settings], Recogniser]] = {"paddleocr-vl": VisionRecogniser}


def register_recogniser(name: str, make: Callable[[Settings], Recogniser]) -> None:
    RECOGNISERS[name] = make


def fingerprint(settings: Settings) -> dict:
    """What results of the recogniser depend on beside the stage's parameters; addresses and keys are left out."""
    try:
        version = importlib.metadata.version("paddleocr")
    except importlib.metadata.PackageNotFoundError:
        version = None
    server = {"backend": settings.ocr_server_backend, "server_model": settings.ocr_server_model or settings.paddleocr_model} if settings.ocr_server_url else {}
    return {"provider": settings.ocr_provider, "model": settings.paddleocr_model, "engine": settings.paddleocr_engine, "device": settings.ocr_device, "version": version} | server


def make_recogniser(settings: Settings) -> Recogniser:
    if settings.ocr_server_url and settings.ocr_server_backend not in SERVER_BACKENDS:
        raise ValueError(f"unknown backend: {settings.ocr_server_backend}")
    if settings.ocr_provider not in RECOGNISERS:
        raise ValueError(f"no recogniser of the name {settings.ocr_provider} is registered")
    return RECOGNISERS[settings.ocr_provider](settings)


def isolated(recogniser: Recogniser, paths: list[str]) -> list[tuple[str, str | None]]:
    """Status and raw result of each image: the batch twice, then image by image; only what fails alone has failed."""
    for _ in range(2):
        try:
            found = recogniser.recognise(paths)
        except Exception:  # noqa: BLE001 - any failure of a model falls back to single images
            continue
        if len(found) == len(paths):
            return [("ok", raw) for raw in found]
    out: list[tuple[str, str | None]] = []
    for path in paths:
        try:
            out.append(("ok", recogniser.recognise([path])[0]))
        except Exception:  # noqa: BLE001
            out.append(("failed", None))
    return out


def recognise_images(images: DataFrame, make: Callable[[], Recogniser], batch_size: int = 8) -> DataFrame:
    """images: sha256, path, one row an image -> sha256, status, raw. Join the result to all samples of the image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recogniser = make()
        for batch in batches:
            paths = batch.column("path").to_pylist()
            done = [r for i in range(0, len(paths), batch_size) for r in isolated(recogniser, paths[i : i + batch_size])]
            yield pa.RecordBatch.from_arrays([batch.column("sha256"), pa.array([s for s, _ in done], pa.string()), pa.array([r for _, r in done], pa.string())], names=["sha256", "status", "raw"])
        getattr(recogniser, "release", lambda: None)()

    return images.select("sha256", "path").mapInArrow(run, "sha256 string, status string, raw string")


Transcribe = Callable[[str], Iterable[tuple[float, float, str]]]


def speech_device(settings: Settings, has_gpu: bool = False) -> tuple[str, str]:
    """Device and number type of the speech model where the settings leave them open."""
    device = settings.asr_device if settings.asr_device != "auto" else ("cuda" if has_gpu else "cpu")
    kind = settings.asr_compute_type if settings.asr_compute_type != "auto" else ("float16" if device == "cuda" else "int8")
    return device, kind


def extract_audio(path: str, folder: str, run: Run = run_tool) -> str:
    """16 kHz mono sound of a video, as a file in a folder that all executors see; the caller removes it once it is read."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    target = f"{folder}/{uuid.uuid4().hex}.wav"
    run(["ffmpeg", "-v", "error", "-y", "-i", path, "-vn", "-ac", "1", "-ar", "16000", target])
    return target


class SpeechTranscriber:
    """The public speech model of the faster_whisper package, loaded when it is first asked."""

    def __init__(self, settings: Settings, folder: str, run: Run = run_tool):
        self.settings, self.folder, self.run, self.model = settings, folder, run, None

    def _load(self) -> None:
        try:
            from faster_whisper import WhisperModel
        except ImportError as error:
            raise ToolError("the faster_whisper package is not installed") from error
        device, kind = speech_device(self.settings, shutil.which("nvidia-smi") is not None)
        self.model = WhisperModel(self.settings.asr_model, device=device, compute_type=kind)

    def __call__(self, path: str) -> list[tuple[float, float, str]]:
        if self.model is None:
            self._load()
        sound = extract_audio(path, self.folder, self.run)
        try:
            said, _ = self.model.transcribe(sound, language=self.settings.asr_language, vad_filter=self.settings.asr_vad)
            return [(x.start, x.end, x.text) for x in said]  # the model reads the file while it is asked for the next one
        finally:
            Path(sound).unlink(missing_ok=True)


def make_transcriber(settings: Settings, folder: str) -> Transcribe:
    if importlib.util.find_spec("faster_whisper") is None:
        raise ToolError("speech is asked for, but the faster_whisper package is not installed")
    return SpeechTranscriber(settings, folder)


def speech_segments(videos: DataFrame, make: Callable[[], Transcribe], settings: Settings) -> DataFrame:
    """videos: video_id, path, has_audio -> segments; none where speech is off or a video has no sound."""
    if not settings.audio_transcribe:
        return videos.sparkSession.createDataFrame([], schemas.SEGMENT)

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        transcribe = make()
        for frame in frames:
            rows = []
            for video, path in zip(frame["video_id"], frame["path"]):
                said = ((s, e, " ".join((t or "").split())) for s, e, t in transcribe(path))
                rows += [(video, n, round(s, 3), round(e, 3), t) for n, (s, e, t) in enumerate((x for x in said if x[2]), 1)]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in schemas.SEGMENT.split(", ")])

    return videos.where("has_audio").select("video_id", "path").mapInPandas(each, schemas.SEGMENT)


def input_paths(spark: SparkSession, patterns: Iterable[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(expand_inputs(patterns), 1)), "video_id long, path string")
