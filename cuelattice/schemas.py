"""Schemas of the entities that stages hand on."""

from __future__ import annotations

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
BLOCK = f"struct<id:string,bbox:{BOX},source_text:string,label:string,reading_order:int,confidence:double,language:string>"
VIDEO = (
    "video_id long, path string, duration double, start_time double, coded_width int, coded_height int, width int, height int, "
    "rotation int, r_frame_rate string, avg_frame_rate string, avg_fps double, has_audio boolean"
)
SAMPLE = "video_id long, sample_index int, timestamp_s double, path string, sha256 string, status string"
RESULT = f"video_id long, sample_index int, timestamp_s double, status string, blocks array<{BLOCK}>"
RAW = "sample_index int, raw string"
TRACK = (
    f"video_id long, event_no int, start_s double, end_s double, source_text string, bbox {BOX}, reading_order int, label string, "
    "confidence double, sample_indices array<int>, observation_count int"
)
SEGMENT = "video_id long, seg_no int, start_s double, end_s double, text string"
TRANSLATION = "canonical_key string, translated_lines array<string>, failed array<int>, hits int, misses int"
EVENT = "video_id long, start_s double, end_s double, source_lines array<string>, translated_lines array<string>, bboxes array<array<double>>, source string"
CACHE = "cache_key string, normalized string, raw string, created_at timestamp, hit_count long"
