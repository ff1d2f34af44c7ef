"""Settings of a run, and the part of them that each stage's result depends on."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, fields

PROMPT_VERSION = "subtitle translation prompt v1"
ORDERS = ("auto", "ltr", "rtl", "ttb")
POSITIONS = ("bottom", "top")
RECOGNISERS = ("paddleocr-vl",)
SERVER_BACKENDS = ("vllm-server", "sglang-server", "fastdeploy-server", "mlx-vlm-server", "llama-cpp-server")


def stable_hash(value: object) -> str:
    """SHA-256 of the canonical JSON of a value: keys sorted, no blanks, no escapes beyond JSON's own."""
    text = json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()


@dataclass(frozen=True)
class Settings:
    # sampling
    interval: float = 1.0
    max_width: int = 1920
    image_quality: int = 3
    # places and languages
    work_dir: str = "./work"
    target_lang: str = "zh-TW"
    source_lang: str | None = None
    # recognition
    ocr_provider: str = "paddleocr-vl"
    paddleocr_model: str = "PaddleOCR-VL"
    paddleocr_engine: str | None = None
    ocr_device: str = "auto"
    ocr_batch_size: int = 8
    ocr_confidence: float | None = None
    no_ocr_cache: bool = False
    ocr_server_url: str | None = None
    ocr_server_backend: str = "vllm-server"
    ocr_server_model: str | None = None
    ocr_api_key_env: str = "PADDLEOCR_VL_API_KEY"
    # speech
    audio_transcribe: bool = False
    asr_model: str = "large-v3"
    asr_device: str = "auto"
    asr_compute_type: str = "auto"
    asr_language: str | None = None
    asr_vad: bool = False
    audio_subtitle_position: str = "top"
    audio_subtitle_color: str = "yellow"
    # translation
    llm_model: str | None = None
    llm_cache_url: str = "http://127.0.0.1:8790"
    # tracking
    text_similarity: float = 0.85
    gap_tolerance: int = 1
    iou_threshold: float = 0.3
    center_dist_ratio: float = 0.08
    min_event_duration: float = 0.4
    reading_order: str = "auto"
    # output
    bilingual: bool = False
    subtitle_position: str = "bottom"
    max_lines: int = 2
    # behaviour
    strict: bool = False

    def to_dict(self) -> dict:
        return asdict(self)

    def stage_params(self, stage: str, fingerprint: dict | None = None, model: str | None = None) -> dict:
        """What the result of a stage depends on; batch sizes, addresses and keys are left out."""
        named = STAGE_FIELDS[stage]
        params = {key: getattr(self, name) for key, name in named.items()}
        if stage == "probe":
            params = {"stage": "probe", "v": 1}
        elif stage == "ocr" and fingerprint:
            params["provider_fingerprint"] = fingerprint
        elif stage == "translate":
            params |= {"model": model or self.llm_model, "prompt_version": PROMPT_VERSION}
        return params

    def stage_hash(self, stage: str, fingerprint: dict | None = None, model: str | None = None) -> str:
        return stable_hash(self.stage_params(stage, fingerprint, model))

    def former_ocr_hash(self, fingerprint: dict | None = None) -> str:
        """The hash of an earlier version that counted the batch size in."""
        return stable_hash(self.stage_params("ocr", fingerprint) | {"batch_size": self.ocr_batch_size})


#: Stage -> name in its parameters -> field.
STAGE_FIELDS: dict[str, dict[str, str]] = {
    "probe": {},
    "sample": {x: x for x in ("interval", "max_width", "image_quality")},
    "ocr": {"provider": "ocr_provider", "model": "paddleocr_model", "engine": "paddleocr_engine", "device": "ocr_device", "confidence": "ocr_confidence"},
    "track": {x: x for x in ("text_similarity", "gap_tolerance", "iou_threshold", "center_dist_ratio", "min_event_duration", "reading_order")},
    "asr": {"enabled": "audio_transcribe", "model": "asr_model", "language": "asr_language", "vad": "asr_vad"},
    "translate": {"source_lang": "source_lang", "target_lang": "target_lang"},
    "cleanup": {"max_lines": "max_lines"},
    "emit": {x: x for x in ("subtitle_position", "bilingual", "target_lang", "audio_subtitle_position", "audio_subtitle_color")},
}
FIELD_NAMES = tuple(f.name for f in fields(Settings))
