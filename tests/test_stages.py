"""Cleanup, subtitle text, caches, manifest, sources, streams and a whole run with stand-ins."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cuelattice.config import Settings
from cuelattice.journal import Journal, StageRangeError, downstream, stage_bounds
from cuelattice.operators import adapter, cleanup, dedupe, emit, sampling, translate
from cuelattice.plans.catalogue import echo_chat
from cuelattice.plans.pipeline import Pipeline
from cuelattice.sources import chat, media, tables
from cuelattice.streaming import streams

EVENT = "video_id long, event_no int, start_s double, end_s double, source_lines array<string>, translated_lines array<string>, bboxes array<array<double>>, source string"
CUE = "video_id long, start_s double, end_s double, source_texts array<string>, bboxes array<array<double>>"
TRANSLATION = "canonical_key string, translated_lines array<string>"


def videos(spark, duration=1000.0):
    return spark.createDataFrame([(1, duration, 640, 360)], "video_id long, duration double, width int, height int")


def test_final_cues(spark):
    cues = spark.createDataFrame([(1, -1.0, 5.0, ["a", "b"], []), (1, 9.0, 8.0, ["x"], []), (1, 0.0, 3.0, ["c"], []), (1, 0.0, 3.0, ["c"], [[0.1]]), (2, 0.0, 3.0, ["d"], [])], CUE)
    told = spark.createDataFrame([('["a", "b"]', ["A", ""]), ('["c"]', ["one", "two"])], TRANSLATION)
    got = {(r["video_id"], r["start_s"], r["end_s"], tuple(r["translated_lines"])) for r in cleanup.finalize_cues(cues, told, videos(spark, 3.0)).collect()}
    assert got == {(1, 0.0, 3.0, ("A", "b")), (1, 0.0, 3.0, ("c",)), (2, 0.0, 3.0, ("d",))}


def test_final_audio_and_merge(spark):
    said = spark.createDataFrame([(1, 1.0, 2.0, " hi  there "), (1, 1.0, 2.0, "hi there"), (1, 3.0, 3.0, "gone"), (1, 4.0, 5.0, "  ")], "video_id long, start_s double, end_s double, text string")
    audio = cleanup.finalize_audio(said, spark.createDataFrame([('["hi there"]', ["hallo"])], TRANSLATION), videos(spark))
    assert [(r["source_lines"], r["translated_lines"], r["source"]) for r in audio.collect()] == [(["hi there"], ["hallo"], "audio")]
    screen = cleanup.finalize_cues(spark.createDataFrame([(1, 1.0, 2.0, ["s"], [])], CUE), spark.createDataFrame([], TRANSLATION), videos(spark))
    assert [r["source"] for r in cleanup.merge_events(screen, audio).orderBy("event_no").collect()] == ["ocr", "audio"]


def test_srt_and_ass(spark):
    rows = [
        (1, 1, 0.0, 1.5, ["一", "二", "三"], [None, "", "drei"], [], "ocr"), (1, 2, 2.0, 3.0, [""], [""], [], "ocr"), (1, 3, 3661.999, 3662.0, ["{x}"], [], [], "audio"),
    ]
    events = spark.createDataFrame(rows, EVENT)
    assert emit.srt_documents(events).first()["document"] == "1\n00:00:00,000 --> 00:00:01,500\n一\n二\ndrei\n\n2\n01:01:01,999 --> 01:01:02,000\n{x}\n\n"
    assert emit.srt_documents(events.limit(0)).count() == 0
    got = [r["dialogue"] for r in emit.ass_dialogues(events).orderBy("n", "part").collect()]
    assert got[0].endswith("Default,,0,0,0,,一\\N二") and got[1].endswith(",,drei") and got[2].endswith("Audio,,0,0,0,,(x)")
    assert len(emit.ass_dialogues(events, max_lines=0).collect()) == 2
    both = emit.srt_blocks(events, bilingual=True).orderBy("n").first()["block"]
    assert both.split("\n")[2:8] == ["一", "二", "drei", "一", "二", "三"]
    text = emit.ass_documents(events, videos(spark)).first()["document"]
    assert "PlayResX: 640" in text and "Style: Audio,Arial,20,&H0000FFFF" in text and text.endswith("(x)\n")
    plain = emit.ass_documents(events.where("source = 'ocr'"), videos(spark)).first()["document"]
    assert "Style: Audio" not in plain


def test_vendor_results(spark):
    items = [
        {"block_content": " 文字 ", "block_bbox": [64, 36, 128, 72], "block_order": 2}, {"content": "b", "bbox": [700, -5, 10, 900], "score": 0.5, "lang": "en"},
        {"content": "★", "bbox": [0, 0, 1, 1]}, {"content": "no box"}, {"content": "low", "bbox": [0, 0, 1, 1], "confidence": 0.1}, {"block_content": None, "content": "c", "bbox": [0, 0, 1]},
    ]
    rows = [(1, 1, 640, 360, json.dumps({"res": {"parsing_res_list": items}})), (1, 2, 640, 360, json.dumps({"parsing_res_list": []})), (1, 3, 640, 360, "{}"), (1, 4, 640, 360, None)]
    got = adapter.parse_blocks(spark.createDataFrame(rows, "video_id long, sample_index int, width int, height int, raw string"), 0.3).orderBy("block_no").collect()
    assert [(r["block_no"], r["source_text"], tuple(round(x, 4) for x in r["bbox"]), r["reading_order"], r["confidence"]) for r in got] == [
        (1, "文字", (0.1, 0.1, 0.2, 0.2), 2, None), (2, "b", (0.0156, 0.0, 1.0, 1.0), None, 0.5)]


def test_caches(spark):
    from datetime import datetime

    cache = spark.createDataFrame([("i1:old", "a", datetime(2024, 1, 1), 5), ("i2:old", "b", datetime(2024, 1, 1), 0), ("i2:new", "c", datetime(2024, 1, 1), 1), ("i3:x", "d", datetime(2024, 1, 1), 0)], "cache_key string, normalized string, created_at timestamp, hit_count long")
    moved = {r["cache_key"]: r["normalized"] for r in dedupe.migrate_keys(cache, "old", "new").collect()}
    assert moved == {"i1:new": "a", "i2:new": "c", "i3:x": "d"}
    new = spark.createDataFrame([("i1:old", "z", datetime(2025, 1, 1)), ("i9:x", "n", datetime(2025, 1, 1))], "cache_key string, normalized string, created_at timestamp")
    after = {r["cache_key"]: (r["normalized"], r["hit_count"]) for r in dedupe.upsert(cache, new).collect()}
    assert after["i1:old"] == ("z", 5) and after["i9:x"] == ("n", 0) and len(after) == 5
    seen = dedupe.look_up(spark.createDataFrame([("i1:old",), ("nope",), ("i1:old",)], "cache_key string"), cache.select("cache_key"))
    assert sorted(r["hit"] for r in seen.collect()) == [False, True, True]
    assert {r["cache_key"]: r["hit_count"] for r in dedupe.count_hits(cache, seen).collect()}["i1:old"] == 7
    asked = []
    rows = spark.createDataFrame([("k1",), ("k1",), ("k2",), (None,)], "key string")
    known = spark.createDataFrame([("k2", "cached")], "key string, value string")

    def compute(missing):
        asked.extend(r["key"] for r in missing.collect())
        return missing.withColumn("value", F.upper("key"))

    out, _ = dedupe.memo_map(rows, "key", known, compute)
    assert asked == ["k1"] and sorted((r["key"] or "", r["value"]) for r in out.collect()) == [("", None), ("k1", "K1"), ("k1", "K1"), ("k2", "cached")]


def test_grid(spark):
    rows = spark.createDataFrame([(1, 2.5, 1.0), (2, 0.0, 1.0), (3, None, 1.0)], "video_id long, duration double, sample_interval double")
    assert [(r["sample_index"], r["timestamp_s"]) for r in sampling.sample_grid(rows).orderBy("sample_index").collect()] == [(1, 0.0), (2, 1.0), (3, 2.0)]


def test_translate_lines_falls_back():
    assert translate.translate_lines(["a", "b"], None, "x", echo_chat()) == (["[a]", "[b]"], [])
    calls = []

    def stubborn(messages):
        lines = json.loads(messages[1]["content"])
        calls.append(len(lines))
        return '["A"]' if lines == ["a"] else "no"

    assert translate.translate_lines(["a", "b"], None, "x", stubborn) == (["A", "b"], [1]) and calls == [2, 2, 1, 1]
    assert translate.translate_lines([], None, "x", stubborn) == ([], [])


def test_manifest(tmp_path):
    assert downstream("asr") == ["translate", "cleanup", "emit"] and "asr" not in downstream("sample") and downstream("probe") == ["sample", "ocr", "track", "asr", "translate", "cleanup", "emit"]
    assert stage_bounds() == (0, 7) and stage_bounds("cache") == (2, 2) and stage_bounds(None, "track", "emit") == (3, 7)
    with pytest.raises(StageRangeError):
        stage_bounds(None, "emit", "ocr")
    m = Journal(tmp_path / "m.json")
    m.add("input", digest="h")
    m.add("facts", facts={"inputs": 1})
    m.add("ended", stage="ocr", digest="p")
    m.add("ended", stage="emit", digest="q")
    assert Journal(tmp_path / "m.json").standing.holds("ocr", "p") and m.standing.facts == {"inputs": 1}
    m.add("renamed", stage="ocr", former="p", digest="p2")
    m.add("renamed", stage="ocr", former="p", digest="p3")
    assert m.standing.holds("ocr", "p2")
    written = json.loads((tmp_path / "m.json").read_text())
    assert written["stages"]["ocr"] == {"status": "completed", "params_hash": "p2", "completed_at": m.standing.ended["ocr"][1]}
    m.add("began", stage="ocr", digest="other")
    assert m.standing.ended == {} and json.loads((tmp_path / "m.json").read_text())["stages"] == {"ocr": {"status": "running", "params_hash": "other"}}
    with (tmp_path / "m.jsonl").open("a") as file:
        file.write('{"event": "en')
    assert Journal(tmp_path / "m.json").standing == m.standing
    m.add("input", digest="h2")
    assert m.standing.open == {} == m.standing.ended and m.standing.source == "h2"


def test_manifests_are_taken_up(tmp_path):
    """Of the format that a run without a journal left."""
    (tmp_path / "m.json").write_text(json.dumps({"input_hash": "h", "video_info": {"a": 1}, "stages": {"emit": {"status": "running", "params_hash": "x"}, "ocr": {"status": "completed", "params_hash": "p", "completed_at": "t"}}}))
    now = Journal(tmp_path / "m.json").standing
    assert now.holds("ocr", "p") and now.open == {"emit": "x"} and now.source == "h" and now.facts == {"a": 1}


class Fake:
    """Reads the scene from the image's name."""

    def recognise(self, paths):
        if len(paths) > 1 and any("bad" in p for p in paths):
            raise RuntimeError("batch")
        if "bad" in paths[0]:
            raise RuntimeError("image")
        return [json.dumps({"parsing_res_list": [{"content": t, "bbox": b} for t, b in scene(int(p.split("-")[-1]))]}) for p in paths]

    def fingerprint(self):
        return {"fake": 1}


def scene(second):
    top, bottom = [64, 18, 576, 72], [64, 252, 576, 324]
    if second < 4:
        return [("こんにちは世界", bottom)]
    if second < 6 or second >= 15:
        return []
    return [("タイトル", top), ("本文A" if second < 9 else "本文Bですよ", bottom)]


def test_failing_images_are_isolated():
    got = media.isolated(Fake(), ["x-1", "bad-2", "x-5"])
    assert [s for s, _ in got] == ["ok", "failed", "ok"]


def make_run(spark, root, settings=Settings(), calls=None, name="img"):
    inputs = spark.createDataFrame([(1, "clip.mp4")], "video_id long, path string")
    facts = "video_id long, path string, duration double, width int, height int, has_audio boolean"
    probe = lambda df: spark.createDataFrame([(1, "clip.mp4", 20.0, 640, 360, True)], facts)
    shots = [(1, i + 1, float(i), f"{name}-{i}", f"sha{scene(i)}", "pending") for i in range(20)]
    sample = lambda df: spark.createDataFrame(shots, "video_id long, sample_index int, timestamp_s double, path string, sha256 string, status string")
    return Pipeline(spark, settings, str(root), inputs, probe=probe, sample=sample, make_recogniser=Fake, make_chat=echo_chat, make_transcribe=lambda: lambda path: [(1.0, 2.0, " said "), (3.0, 4.0, "")])


def test_whole_run_and_resume(spark, tmp_path):
    first = make_run(spark, tmp_path, Settings(audio_transcribe=True)).run()
    assert first["ocr"]["images"] == 4 == first["ocr"]["recognised"] and first["ocr"]["n_no_text"] == 7 and first["translate"]["failed_cues"] == 0
    srt = Path(tmp_path / "out/1.zh-TW.srt").read_text(encoding="utf-8")
    assert "[こんにちは世界]" in srt and "[said]" in srt and srt.startswith("1\n00:00:00,000 --> 00:00:04,000\n")
    assert "Style: Audio" in Path(tmp_path / "out/1.zh-TW.ass").read_text(encoding="utf-8")
    assert make_run(spark, tmp_path, Settings(audio_transcribe=True)).run()["durations"] == {}
    changed = make_run(spark, tmp_path, Settings(audio_transcribe=True, bilingual=True)).run()
    assert list(changed["durations"]) == ["emit"]
    again = make_run(spark, tmp_path, Settings(audio_transcribe=True, ocr_batch_size=1))
    again.journal.add("dropped", stage="ocr")
    assert again.run(first="ocr", last="ocr")["ocr"]["recognised"] == 0
    # a manifest and cache of the former hash are carried over, not done again
    former, now = Settings(ocr_batch_size=1).former_ocr_hash(), Settings().stage_hash("ocr")
    again.journal.add("ended", stage="ocr", digest=former)
    again._rename_cached(now, former)
    assert "ocr" not in make_run(spark, tmp_path, Settings(audio_transcribe=True, ocr_batch_size=1)).run(last="ocr")["durations"]
    assert {r["cache_key"].split(":")[1] for r in again._cached().collect()} == {now}


def test_one_bad_input_does_not_end_the_others(spark, tmp_path):
    inputs = spark.createDataFrame([(1, "clip.mp4"), (2, "torn.mp4"), (3, "dark.mp4")], "video_id long, path string")

    def run(command):
        if "torn" in command[-1]:
            raise media.ToolError("no moov atom")
        return json.dumps({"format": {"duration": "2"}, "streams": [{"codec_type": "video", "width": 4, "height": 4, "avg_frame_rate": "5/1"}]})

    def frames(command):
        if any("dark" in x for x in command):
            raise ValueError("no picture")
        for i in (1, 2):
            Path(command[-1].replace("%08d", f"{i:08d}")).write_bytes(bytes([i]))
        return ""

    said = []
    made = Pipeline(spark, Settings(), str(tmp_path / "w"), inputs, probe=lambda df: media.probe_videos(df, run), sample=lambda df: media.sample_videos(df, str(tmp_path / "f"), Settings(), frames), log=said.append)
    got = made.run(last="sample")
    assert got["outcome"]["succeeded"] == 1 and [(r["video_id"], r["error"]) for r in got["outcome"]["failed"]] == [(2, "ToolError: no moov atom"), (3, "ValueError: no picture")]
    assert made.work.read("samples").count() == 2 and got["reduction"] == 0.1 and said[0] == "probe: begins"
    from cuelattice import cli

    assert cli.report(got["outcome"]) == 1 and cli.report({"inputs": 2, "succeeded": 2, "failed": []}) == 0


def test_stopped_recognition_goes_on(spark, tmp_path):
    class Counting(Fake):
        def recognise(self, paths):
            with (tmp_path / "seen").open("a") as file:
                file.write("".join(f"{p}\n" for p in paths))
            return super().recognise(paths)

    rows = [(f"key{i}", f"img-{i}" if i % 4 else f"bad-{i}") for i in range(40)]
    images = spark.createDataFrame(rows, "sha256 string, path string")
    run = make_run(spark, tmp_path)
    run.make_recogniser = Counting
    half = images.where("cast(substr(sha256, 4) as int) < 20")
    assert run._recognised(half, "d1").count() == 20
    (tmp_path / "seen").write_text("")
    assert run._recognised(images, "d1").where("status = 'failed'").count() == 10
    assert {x.split("-")[1] for x in (tmp_path / "seen").read_text().split()} == {str(i) for i in range(20, 40)}


def test_speech_needs_its_package(spark, tmp_path, monkeypatch):
    run = make_run(spark, tmp_path, Settings(audio_transcribe=True))
    run.make_transcribe = None
    with pytest.raises(media.ToolError):
        run.run(last="asr")
    import importlib.util
    import sys
    import types

    asked = []

    class Model:
        def __init__(self, name, **options):
            asked.append((name, options))

        def transcribe(self, path, **options):
            assert Path(path).exists()
            asked.append(options)
            return iter([types.SimpleNamespace(start=0.0, end=1.5, text=" a ")]), None

    fake = types.ModuleType("faster_whisper")
    fake.WhisperModel, fake.__spec__ = Model, importlib.util.spec_from_loader("faster_whisper", None)
    monkeypatch.setitem(sys.modules, "faster_whisper", fake)
    speak = media.make_transcriber(Settings(asr_device="cpu", asr_language="de", asr_vad=True), str(tmp_path / "sound"))
    speak.run = lambda command: Path(command[-1]).write_text("wav") and ""
    assert speak("clip.mp4") == [(0.0, 1.5, " a ")] and asked == [("large-v3", {"device": "cpu", "compute_type": "int8"}), {"language": "de", "vad_filter": True}]
    assert list((tmp_path / "sound").iterdir()) == []


def test_recogniser_of_the_public_package(monkeypatch):
    import sys
    import types

    fake, made = types.ModuleType("paddleocr"), []

    class Parser:
        def __init__(self, **options):
            made.append(options)

        def predict(self, path):
            return [types.SimpleNamespace(json={"res": {"parsing_res_list": [], "path": path}})]

    fake.PaddleOCRVL = Parser
    monkeypatch.setitem(sys.modules, "paddleocr", fake)
    monkeypatch.setenv("PADDLEOCR_VL_API_KEY", "k")
    settings = Settings(ocr_server_url="http://x", ocr_device="gpu:0")
    reader = media.make_recogniser(settings)
    assert [json.loads(x)["res"]["path"] for x in reader.recognise(["a", "b"])] == ["a", "b"] and len(made) == 1
    assert made[0] == {"device": "gpu:0", "vl_rec_backend": "vllm-server", "vl_rec_server_url": "http://x", "vl_rec_api_model_name": "PaddleOCR-VL", "vl_rec_api_key": "k"}
    reader.release()
    assert reader.model is None
    assert not {"http://x", "k"} & set(map(str, media.fingerprint(settings).values())) and media.fingerprint(settings)["backend"] == "vllm-server"


def test_answers_outlast_the_proxy(tmp_path):
    calls = []

    def upstream(url, body=None, headers=None):
        calls.append((url, body, headers))
        return 200, answer("z"), {}

    path = str(tmp_path / "a.db")
    ask = {"model": "m", "messages": [{"role": "user", "content": "é"}], "stream": True}
    with chat.Answers(path) as store:
        assert chat.Proxy(chat.Upstream("http://u/", "k", upstream), store).chat(ask)[2]["x-cache"] == "miss"
    with chat.Answers(path) as store:
        proxy = chat.Proxy(chat.Upstream("http://u/", "k", upstream), store)
        assert proxy.chat(ask)[2]["x-cache"] == "hit" and len(store) == 1 and list(store) and proxy.chat([1])[0] == 400
        del store[next(iter(store))]
        assert len(store) == 0
    assert len(calls) == 1 and calls[0][1]["stream"] is False and calls[0][2] == {"Authorization": "Bearer k"}


def test_proxy_command(tmp_path, capsys):
    from cuelattice import proxy

    assert proxy.main(["--upstream-url", "http://127.0.0.1:9", "--port", "0", "--db", str(tmp_path / "p.db"), "--quiet"], wait=False) == 0
    assert capsys.readouterr().out.startswith("http://127.0.0.1:")
    served = chat.Proxy(lambda body: (200, answer("x"), {}))
    server = served.serve(port=0)
    try:
        import urllib.error
        import urllib.request

        with pytest.raises(urllib.error.HTTPError) as told:
            urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{server.server_address[1]}/v1/chat/completions", b"{torn"))
        assert told.value.code == 400
    finally:
        server.shutdown()


def test_files_beside_their_inputs(spark, tmp_path):
    rows = [(2, 1, 0, "b1\n", "x/two.mp4"), (1, 2, 0, "a2\n", "x/one.mp4"), (1, 1, 1, "a1b\n", "x/one.mp4"), (1, 1, 0, "a1\n", "x/one.mp4")]
    lines = spark.createDataFrame(rows, "video_id long, n int, part int, line string, path string")
    run = make_run(spark, tmp_path)
    assert str(run._named("srt")(lines.first())).endswith("out/2.zh-TW.srt")
    run.beside_inputs = True
    got = tables.write_lines(lines, lambda row: tmp_path / run._named("srt")(row))
    assert [Path(p).relative_to(tmp_path).as_posix() for p in got] == ["x/one.zh-TW.srt", "x/two.zh-TW.srt"] and Path(got[0]).read_text() == "a1\na1b\na2\n"


def test_strict_run_stops(spark, tmp_path):
    from cuelattice.plans.pipeline import StrictError

    with pytest.raises(StrictError):
        make_run(spark, tmp_path, Settings(strict=True), name="bad").run()


def test_incomplete_results(spark):
    rows = spark.createDataFrame([(1, 1), (1, 2)], "video_id long, sample_index int")
    with pytest.raises(tables.IncompleteResults):
        tables.complete_results(rows, rows.where("sample_index = 1"))
    assert tables.complete_results(rows, rows).count() == 2


def test_inputs_and_probe(tmp_path):
    for n in ("b.mp4", "a.mp4"):
        (tmp_path / n).write_text("x")
    got = media.expand_inputs([str(tmp_path / "*.mp4"), str(tmp_path / "a.mp4"), "kept.mp4", str(tmp_path / "*.none")])
    assert [Path(p).name for p in got] == ["a.mp4", "b.mp4", "kept.mp4"]
    shown = {"format": {"duration": "12.5"}, "streams": [{"codec_type": "video", "width": 640, "height": 360, "avg_frame_rate": "30000/1001", "side_data_list": [{"rotation": 90}]}, {"codec_type": "audio"}]}
    facts = media.probe("x", lambda command: json.dumps(shown))
    assert (facts["duration"], facts["width"], facts["height"], facts["rotation"], facts["has_audio"]) == (12.5, 360, 640, 90, True)
    made = []

    def fake(command):
        made.append(command)
        for i in (1, 2, 3):
            Path(command[-1].replace("%08d", f"{i:08d}")).write_bytes(bytes([i]))
        return ""

    rows = media.sample_frames("v.mp4", str(tmp_path / "f"), 1.5, Settings(), fake)
    assert [(r["sample_index"], r["timestamp_s"]) for r in rows] == [(1, 0.0), (2, 1.0), (3, 1.5)] and len({r["sha256"] for r in rows}) == 3 and "fps=1/1" in " ".join(made[0])
    with pytest.raises(media.ToolError):
        media.check_tools("no-such-tool-at-all")
    with pytest.raises(ValueError):
        media.make_recogniser(Settings(ocr_server_url="http://x", ocr_server_backend="nope"))
    assert media.speech_device(Settings()) == ("cpu", "int8") and media.speech_device(Settings(), True) == ("cuda", "float16")


def test_file_sources(spark, tmp_path):
    (tmp_path / "i.jpg").write_bytes(b"abc")
    assert spark and tables.image_hashes(spark, str(tmp_path / "*.jpg")).first()["sha256"].startswith("ba7816bf")
    doc = {"interval": 1.0, "duration": 2.0, "samples": [{"index": 1, "timestamp": 0.0, "path": "p", "sha256": "s", "status": "pending"}]}
    (tmp_path / "s.json").write_text(json.dumps(doc, indent=1))
    assert tables.samples_json(spark, str(tmp_path / "s.json")).first()["sample_index"] == 1
    work = tables.Workspace(spark, str(tmp_path / "w"))
    assert work.read("segments").count() == 0 and not work.exists("segments")


def answer(text):
    return {"choices": [{"message": {"role": "assistant", "content": text}}]}


def test_chat_client_and_proxy():
    waits, replies = [], [(429, {}, {"Retry-After": "7"}), (500, {}, {}), (200, answer("x"), {"X-Cache": "hit"})]
    client = chat.ChatClient("http://h/", "m", send=lambda *a: replies.pop(0), sleep=waits.append)
    assert client([]) == "x" and waits == [7.0, 4.0] and (client.hits, client.misses) == (1, 0)
    with pytest.raises(chat.ChatError):
        chat.ChatClient("http://h", "m", send=lambda *a: (401, {}, {}), sleep=waits.append)([])
    with pytest.raises(chat.ChatError):
        chat.ChatClient("http://h", "m", send=lambda *a: (503, {}, {}), sleep=waits.append)([])
    calls = []

    def upstream(body):
        calls.append(body)
        return (200, answer("y"), {}) if body["model"] == "m" else (429, {"error": 1}, {"Retry-After": "3", "Other": "1"})

    proxy = chat.Proxy(upstream, models=lambda: (500, {}, {}), default_model="d")
    server = proxy.serve(port=0)
    try:
        url = f"http://127.0.0.1:{server.server_address[1]}"
        live = chat.ChatClient(url, "m")
        assert [live([{"role": "user", "content": "a"}]) for _ in range(2)] == ["y", "y"] and (live.hits, live.misses, len(calls)) == (1, 1, 1)
        assert chat.first_model(url) == "d" and chat.http_json(url + "/stats")[1] == {"hits": 1, "misses": 1, "entries": 1}
        status, _, headers = chat.http_json(url + "/v1/chat/completions", {"model": "other"})
        assert status == 429 and headers["Retry-After"] == "3" and len(proxy.store) == 1
    finally:
        server.shutdown()


def test_stream_equals_batch(spark, tmp_path):
    from tests.test_tracking import SAMPLES, block, videos as facts
    from cuelattice.operators import tracking

    shown = ["aaaa", "aaaa", "", "", "bbbb", "bbbb", "cccc", "", "cccc", "", "", "", "dddd", "dddd", "", "eeee"]
    rows = [(v, i, float(i - 1), "failed" if (i, v) == (4, 2) else "ok", [block(t)] if t else [], None) for v in (1, 2) for i, t in enumerate(shown, 1)]
    batch = spark.createDataFrame(rows, SAMPLES)
    columns = ["video_id", "start_s", "end_s", "source_text", "sample_indices"]
    want = sorted(map(repr, tracking.track_events(batch, facts(spark)).select(*columns).collect()))
    for cut in ((3,), (1, 2, 6, 7, 9, 13), tuple(range(1, 16))):
        folder = tmp_path / f"in{len(cut)}"
        for k, (low, high) in enumerate(zip((0, *cut), (*cut, 16))):
            spark.createDataFrame([r for r in rows if low < r[1] <= high], SAMPLES).coalesce(1).write.parquet(str(folder / f"part{k:02d}"))
        frames = spark.readStream.schema(SAMPLES).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(folder))
        assert sorted(map(repr, streams.track_to_table(frames, facts(spark)).select(*columns).collect())) == want


def test_late_samples_and_repeated_steps(spark, tmp_path):
    from tests.test_tracking import SAMPLES, block, videos as facts
    from cuelattice.operators import tracking

    rows = [(1, i, float(i - 1), "ok", [block(t)] if t else [], None) for i, t in enumerate(["aaaa", "aaaa", "aaaa", "", "", "", "bbbb"], 1)]
    frame = lambda *numbers: spark.createDataFrame([rows[i - 1] for i in numbers], SAMPLES).withColumn("ingested_at", F.lit(None).cast("timestamp"))
    for lateness, observed in ((0, {(0.0, 2), (6.0, 1)}), (6, {(0.0, 3), (6.0, 1)})):
        steps = streams.TrackingSteps(spark, facts(spark), Settings(), str(tmp_path / f"s{lateness}"), lateness)
        for step, numbers in enumerate(((1, 2, 4, 5, 6), (3, 7))):
            for _ in range(2):  # a step that is done again changes nothing
                steps(frame(*numbers), step)
        steps.finish(frame(1).schema, 2)
        got = spark.read.schema(tracking.EVENT).parquet(f"{tmp_path}/s{lateness}/events")
        assert {(r["start_s"], r["observation_count"]) for r in got.collect()} == observed


def test_command_line():
    from cuelattice import cli

    made = cli.settings_of(cli.parser().parse_args(["a.mp4", "--source-lang", "auto", "--bilingual", "--interval", "2"]))
    assert made == Settings(bilingual=True, interval=2.0)
    with pytest.raises(SystemExit):
        cli.main(["a.mp4", "--stage", "ocr", "--to-stage", "emit"])
