"""Command line: videos in, subtitle files out."""

from __future__ import annotations

import argparse
import sys

from cuelattice.config import ORDERS, POSITIONS, RECOGNISERS, SERVER_BACKENDS, Settings
from cuelattice.journal import ALIASES, STAGES

#: Flag -> field and options of each setting that can be given.
FLAGS: dict[str, tuple[str, dict]] = {
    "--interval": ("interval", {"type": float}), "--max-width": ("max_width", {"type": int}), "--image-quality": ("image_quality", {"type": int}),
    "--work-dir": ("work_dir", {}), "--target-lang": ("target_lang", {}), "--source-lang": ("source_lang", {}),
    "--ocr-provider": ("ocr_provider", {"choices": RECOGNISERS}), "--paddleocr-model": ("paddleocr_model", {}), "--paddleocr-engine": ("paddleocr_engine", {}),
    "--ocr-device": ("ocr_device", {}), "--ocr-batch-size": ("ocr_batch_size", {"type": int}), "--ocr-confidence": ("ocr_confidence", {"type": float}),
    "--ocr-server-url": ("ocr_server_url", {}), "--ocr-server-backend": ("ocr_server_backend", {"choices": SERVER_BACKENDS}), "--ocr-server-model": ("ocr_server_model", {}),
    "--ocr-api-key-env": ("ocr_api_key_env", {}), "--audio-transcribe": ("audio_transcribe", {"action": "store_true"}), "--asr-model": ("asr_model", {}),
    "--asr-device": ("asr_device", {}), "--asr-compute-type": ("asr_compute_type", {}), "--asr-language": ("asr_language", {}), "--asr-vad": ("asr_vad", {"action": "store_true"}),
    "--audio-subtitle-position": ("audio_subtitle_position", {"choices": POSITIONS}), "--audio-color": ("audio_subtitle_color", {}),
    "--llm-model": ("llm_model", {}), "--llm-cache-url": ("llm_cache_url", {}), "--text-similarity": ("text_similarity", {"type": float}),
    "--gap-tolerance": ("gap_tolerance", {"type": int}), "--reading-order": ("reading_order", {"choices": ORDERS}), "--bilingual": ("bilingual", {"action": "store_true"}),
    "--subtitle-position": ("subtitle_position", {"choices": POSITIONS}), "--no-ocr-cache": ("no_ocr_cache", {"action": "store_true"}), "--strict": ("strict", {"action": "store_true"}),
}


def parser() -> argparse.ArgumentParser:
    made = argparse.ArgumentParser(prog="cuelattice", description=__doc__)
    made.add_argument("inputs", nargs="+")
    defaults = Settings()
    for flag, (name, options) in FLAGS.items():
        made.add_argument(flag, dest=name, default=getattr(defaults, name), **options)
    stages = [*STAGES, *ALIASES]
    for flag in ("--stage", "--from-stage", "--to-stage"):
        made.add_argument(flag, choices=stages)
    return made


def settings_of(args: argparse.Namespace) -> Settings:
    values = {name: getattr(args, name) for name, _ in FLAGS.values()}
    if values["source_lang"] in ("", "auto"):
        values["source_lang"] = None
    return Settings(**values)


def main(argv: list[str] | None = None) -> int:
    """0 when all inputs went well, 1 for a failure of any or all, 130 when interrupted."""
    made = parser()
    args = made.parse_args(argv)
    if args.stage and (args.from_stage or args.to_stage):
        made.error("--stage goes with neither --from-stage nor --to-stage")
    from cuelattice.plans.pipeline import Pipeline
    from cuelattice.session import get_session
    from cuelattice.sources import chat, media

    settings = settings_of(args)
    try:
        media.check_tools()
        if settings.audio_transcribe:
            media.make_transcriber(settings, settings.work_dir)
        spark = get_session()
        inputs = media.input_paths(spark, args.inputs)
        model = chat.first_model(settings.llm_cache_url, settings.llm_model)
        make_chat = lambda: chat.ChatClient(settings.llm_cache_url, model)
        run = Pipeline(spark, settings, settings.work_dir, inputs, model=model, make_chat=make_chat, fingerprint=media.fingerprint(settings), log=print, beside_inputs=True)
        return report(run.run(args.stage, args.from_stage, args.to_stage)["outcome"])
    except KeyboardInterrupt:
        return 130
    except Exception as error:  # noqa: BLE001 - a command reports and fails
        print(f"failed: {error}", file=sys.stderr)
        return 1


def report(outcome: dict) -> int:
    """Show how many inputs came through and why others did not; the exit code."""
    print(f"{outcome['succeeded']} of {outcome['inputs']} inputs done")
    for row in outcome["failed"]:
        print(f"failed: input {row['video_id']}: {row['error']}", file=sys.stderr)
    return 1 if outcome["failed"] else 0


if __name__ == "__main__":
    sys.exit(main())
