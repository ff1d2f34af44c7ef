"""The journal of a run: a line for each thing that happened, and what follows from them.

Nothing is ever changed in it; where a run stands is a fold over its lines. A readable summary is
kept beside it. Both are small whatever the data, and on the driver.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path

# The stages in order, and another name of one.
STAGES = ("probe", "sample", "ocr", "track", "asr", "translate", "cleanup", "emit")
ALIASES = {"cache": "ocr"}
#: What each stage reads; speech does not depend on the screen's branch.
READS = {
    "probe": (), "sample": ("probe",), "ocr": ("sample",), "track": ("ocr",), "asr": ("probe",), "translate": ("track", "asr"), "cleanup": ("translate",), "emit": ("cleanup",),
}


class StageRangeError(ValueError):
    """The first stage named comes after the last."""


def downstream(stage: str) -> list[str]:
    """Every stage that a stage's result reaches, in order."""
    reached = [stage]
    for later in STAGES:
        if set(READS[later]) & set(reached):
            reached.append(later)
    return reached[1:]


def stage_bounds(only: str | None = None, first: str | None = None, last: str | None = None) -> tuple[int, int]:
    """Positions of the first and last stage to run."""
    place = {name: STAGES.index(ALIASES.get(name, name)) for name in (*STAGES, *ALIASES)}
    low, high = place[only or first or STAGES[0]], place[only or last or STAGES[-1]]
    if low > high:
        raise StageRangeError(f"{first} comes after {last}")
    return low, high


def write_atomically(path: Path, text: str) -> None:
    """UTF-8 without a mark, line feeds only; readers see the old file or the new one."""
    part = path.with_name(path.name + ".part")
    part.write_text(text, encoding="utf-8", newline="\n")
    os.replace(part, path)


@dataclass
class Standing:
    """Where a run stands: the digest and time of what ended, the digest of what began and did not end."""

    source: str | None = None
    facts: dict = field(default_factory=dict)
    ended: dict[str, tuple[str, str]] = field(default_factory=dict)
    open: dict[str, str] = field(default_factory=dict)

    def holds(self, stage: str, digest: str) -> bool:
        return self.ended.get(stage, ("", ""))[0] == digest


def replay(events: Iterable[dict]) -> Standing:
    """Fold of a journal: another input starts over; what begins makes what it reaches stale."""
    now = Standing()
    for event in events:
        stage, digest = event.get("stage"), event.get("digest")
        if event["event"] == "input":
            now = now if now.source == digest else Standing(digest)
        elif event["event"] == "facts":
            now.facts = event["facts"]
        elif event["event"] == "renamed":
            if now.holds(stage, event["former"]):
                now.ended[stage] = (digest, now.ended[stage][1])
        elif event["event"] == "ended":
            now.open.pop(stage, None)
            now.ended[stage] = (digest, event.get("at", ""))
        else:  # began, dropped
            for name in (stage, *downstream(stage)):
                now.ended.pop(name, None)
                now.open.pop(name, None)
            if event["event"] == "began":
                now.open[stage] = digest
    return now


def summary(now: Standing) -> dict:
    """A standing as the format of manifests has it."""
    stages = {stage: {"status": "running", "params_hash": digest} for stage, digest in now.open.items()}
    stages |= {stage: {"status": "completed", "params_hash": digest, "completed_at": at} for stage, (digest, at) in now.ended.items()}
    return {"input_hash": now.source, "video_info": now.facts, "stages": {s: stages[s] for s in STAGES if s in stages}}


def events_of(manifest: dict) -> list[dict]:
    """Events that lead to a manifest."""
    out: list[dict] = [{"event": "input", "digest": manifest.get("input_hash")}, {"event": "facts", "facts": manifest.get("video_info") or {}}]
    for stage, held in (manifest.get("stages") or {}).items():
        kind = "ended" if held.get("status") == "completed" else "began"
        out.append({"event": kind, "stage": stage, "digest": held.get("params_hash"), "at": held.get("completed_at", "")})
    return sorted(out, key=lambda e: e["event"] == "ended")  # what began would make the rest stale


class Journal:
    """Lines in <path>.jsonl and the summary in <path>; a summary without lines is taken up."""

    def __init__(self, path: str | Path):
        self.path, self.lines = Path(path), Path(f"{path}l")
        self.events: list[dict] = []
        if self.lines.exists():
            for line in self.lines.read_text(encoding="utf-8").split("\n"):
                try:
                    self.events.append(json.loads(line))
                except ValueError:
                    continue  # the end of a line that was being written
        elif self.path.exists():
            for event in events_of(json.loads(self.path.read_text(encoding="utf-8"))):
                self.add(**event)

    @property
    def standing(self) -> Standing:
        return replay(self.events)

    def add(self, event: str, **what: object) -> Standing:
        line = {"event": event, **what} | ({"at": time.strftime("%Y-%m-%dT%H:%M:%S")} if event == "ended" and not what.get("at") else {})
        self.events.append(line)
        with self.lines.open("a", encoding="utf-8", newline="\n") as file:
            file.write(json.dumps(line, ensure_ascii=False) + "\n")
        now = self.standing
        write_atomically(self.path, json.dumps(summary(now), ensure_ascii=False, indent=2))
        return now
