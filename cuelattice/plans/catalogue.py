"""Queries over the test tables, one or more for each operator, with their SQL.

Every query reads its whole tables. Times come out in whole milliseconds and ratios in millionths,
so that values compare exactly; counts are of type bigint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuelattice.config import Settings
from cuelattice.functions import geometry, keys, parse, text, timefmt
from cuelattice.operators import adapter, cleanup, compose, dedupe, emit, samples, sampling, stats, tracking, translate
from cuelattice.session import cut_lineage, table
from cuelattice.sources import media, tables
from cuelattice.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# ---- parts of SQL ----
COUNTED = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id, sample_index ORDER BY ingested_at DESC NULLS LAST) AS r_ FROM ocr_results) WHERE r_ = 1)"
BLOCKS = f"(SELECT video_id, sample_index, timestamp_s, status, unnest(blocks) AS b FROM {COUNTED})"
NUMBERED = f"(SELECT video_id, sample_index, timestamp_s, status, blocks[i] AS b, i AS n FROM (SELECT *, unnest(range(1, coalesce(len(blocks), 0) + 1)) AS i FROM {COUNTED}))"
TRACKS = "(SELECT DISTINCT * FROM tracks)"
CUES = "(SELECT DISTINCT * FROM cues)"
REGION = "CASE WHEN (b.bbox.y0 + b.bbox.y1) / 2 < 1.0::DOUBLE / 3 THEN 'top' WHEN (b.bbox.y0 + b.bbox.y1) / 2 > 2.0::DOUBLE / 3 THEN 'bottom' WHEN (b.bbox.y0 + b.bbox.y1) IS NOT NULL THEN 'middle' END"
BLANK = text.BLANK
INLINE = text.INLINE_BLANK
TIDY = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(%s, ''), '\\r\\n|\\r', chr(10), 'g'), '{INLINE}+', ' ', 'g'), ' *\\n *', chr(10), 'g'), '^[ \\n]+|[ \\n]+$', '', 'g')"
CLEAN = f"trim(regexp_replace(coalesce(%s, ''), '{BLANK}+', ' ', 'g'))"
KEY = "'[' || array_to_string(list_transform(%s, lambda x: coalesce(CAST(to_json(x) AS VARCHAR), 'null')), ', ') || ']'"
MS = "CAST(round_even(%s * 1000, 0) AS BIGINT)"
FRACTION = "coalesce(CASE WHEN strpos(%s, '/') = 0 THEN TRY_CAST(%s AS DOUBLE) ELSE TRY_CAST(split_part(%s, '/', 1) AS DOUBLE) / nullif(TRY_CAST(split_part(%s, '/', 2) AS DOUBLE), 0) END, 0)"


def ms(x: Column) -> Column:
    return F.rint(x * 1000).cast("bigint")


def millionths(x: Column) -> Column:
    return F.rint(x * 1_000_000).cast("bigint")


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def counted(spark: SparkSession, d: str, *keep: str) -> DataFrame:
    """Counting rows with the named columns only."""
    rows = table(spark, d, "ocr_results")
    return samples.counting_rows(rows.select("video_id", "sample_index", "ingested_at", *keep), list(keep))


def blocks(spark: SparkSession, d: str, *fields: str) -> DataFrame:
    return samples.counting_blocks(table(spark, d, "ocr_results"), *fields)


def tracks(spark: SparkSession, d: str, *keep: str) -> DataFrame:
    """Tracks without repeated rows; reads the named columns only, which the key keeps apart as whole rows would."""
    return table(spark, d, "tracks").select("track_id", *keep).distinct()


def cues(spark: SparkSession, d: str, *keep: str) -> DataFrame:
    return table(spark, d, "cues").select("cue_id", *keep).distinct()


# ---- samples and probes ----
@query(f"SELECT video_id, CAST(sample_index AS BIGINT) AS sample_index, status, CAST(coalesce(len(blocks), 0) AS BIGINT) AS n_blocks FROM {COUNTED}")
def counting_rows(spark, d):
    rows = counted(spark, d, "status", "blocks")
    return rows.select("video_id", F.col("sample_index").cast("bigint").alias("sample_index"), "status", F.coalesce(F.size("blocks"), F.lit(0)).cast("bigint").alias("n_blocks"))


@query(f"""SELECT video_id, CAST(coalesce(((round_even(rotation, 0) % 360) + 360) % 360, 0) AS BIGINT) AS rotation,
  CAST(CASE WHEN coalesce(rotation, 0) % 180 <> 0 THEN height ELSE width END AS BIGINT) AS shown_width,
  CAST(CASE WHEN coalesce(rotation, 0) % 180 <> 0 THEN width ELSE height END AS BIGINT) AS shown_height,
  CAST(round_even({FRACTION.replace("%s", "avg_frame_rate")} * 1000000, 0) AS BIGINT) AS fps_millionths,
  CAST(CASE WHEN duration > 0 AND sample_interval > 0 THEN ceil(duration / sample_interval) ELSE 0 END AS BIGINT) AS n_samples FROM videos""")
def probe_facts(spark, d):
    facts = sampling.probe_facts(table(spark, d, "videos"))
    return facts.select("video_id", *[F.col(c).cast("bigint").alias(c) for c in ("rotation", "shown_width", "shown_height")], millionths(F.col("fps")).alias("fps_millionths"), "n_samples")


@query(f"""SELECT video_id, CAST(i AS BIGINT) AS sample_index, {MS % "least((i - 1) * sample_interval, duration)"} AS ts_ms FROM (
  SELECT *, unnest(range(1, CAST(ceil(duration / sample_interval) AS BIGINT) + 1)) AS i FROM videos WHERE duration > 0 AND sample_interval > 0)""")
def sample_grid(spark, d):
    return sampling.sample_grid(table(spark, d, "videos")).select("video_id", F.col("sample_index").cast("bigint").alias("sample_index"), ms(F.col("timestamp_s")).alias("ts_ms"))


@query(f"""SELECT video_id, CAST(i AS BIGINT) AS sample_index FROM (SELECT *, unnest(range(1, CAST(ceil(duration / sample_interval) AS BIGINT) + 1)) AS i FROM videos
  WHERE duration > 0 AND sample_interval > 0) g WHERE NOT EXISTS (SELECT 1 FROM ocr_results o WHERE o.video_id = g.video_id AND o.sample_index = g.i)""")
def pending_samples(spark, d):
    grid = sampling.sample_grid(table(spark, d, "videos"))
    left = dedupe.pending(grid, table(spark, d, "ocr_results"), ["video_id", "sample_index"])
    return left.select("video_id", F.col("sample_index").cast("bigint").alias("sample_index"))


@query(f"""SELECT video_id, CAST(sample_index AS BIGINT) AS sample_index, CAST(row_number() OVER (PARTITION BY video_id ORDER BY path) AS BIGINT) AS frame_no FROM (
  SELECT video_id, sample_index, printf('%08d.jpg', sample_index) AS path FROM {COUNTED})""")
def frame_numbers(spark, d):
    frames = counted(spark, d, "status").select("video_id", F.col("sample_index").alias("s"), F.format_string("%08d.jpg", "sample_index").alias("path"))
    return sampling.number_frames(frames).select("video_id", F.col("s").cast("bigint").alias("sample_index"), F.col("sample_index").cast("bigint").alias("frame_no"))


@query(f"""SELECT video_id, CAST(count(*) AS BIGINT) AS n_samples, CAST(count(*) FILTER (status = 'failed') AS BIGINT) AS n_failed,
  CAST(count(*) FILTER (status <> 'failed' AND coalesce(len(blocks), 0) = 0) AS BIGINT) AS n_no_text, CAST(sum(coalesce(len(blocks), 0)) AS BIGINT) AS n_blocks FROM {COUNTED} GROUP BY video_id""")
def run_counters(spark, d):
    return stats.recognition_counters(counted(spark, d, "status", "blocks"))


@query(f"SELECT status, CAST(count(*) AS BIGINT) AS n FROM {COUNTED} GROUP BY status")
def outcomes(spark, d):
    return stats.outcomes(counted(spark, d, "status"))


@query(f"""SELECT v.video_id, CAST(count(o.sample_index) AS BIGINT) AS n_samples,
  coalesce(CAST(round_even(count(o.sample_index) / nullif(any_value(v.duration * {FRACTION.replace("%s", "v.avg_frame_rate")}), 0) * 1000000, 0) AS BIGINT), -1) AS share_millionths
  FROM videos v LEFT JOIN {COUNTED} o ON o.video_id = v.video_id GROUP BY v.video_id""")
def reduction_ratio(spark, d):
    videos = table(spark, d, "videos").select("video_id", "duration", parse.fraction(F.col("avg_frame_rate")).alias("fps"))
    return stats.reduction(counted(spark, d, "status"), videos).select("video_id", "n_samples", F.coalesce(millionths(F.col("share")), F.lit(-1)).alias("share_millionths"))


# ---- blocks ----
@query(f"SELECT video_id, b.id AS block_id FROM {BLOCKS} WHERE regexp_matches(coalesce(b.source_text, ''), '[\\p{{L}}\\p{{N}}]')")
def meaningful_blocks(spark, d):
    return blocks(spark, d, "source_text").where(text.is_meaningful(F.col("source_text"))).select("video_id", "block_id")


@query(f"SELECT video_id, b.id AS block_id FROM {BLOCKS} WHERE b.confidence IS NULL OR b.confidence >= 0.8")
def confidence_filter(spark, d):
    return blocks(spark, d, "confidence").where(F.col("confidence").isNull() | (F.col("confidence") >= 0.8)).select("video_id", "block_id")


@query(f"SELECT video_id, CAST(sample_index AS BIGINT) AS sample_index, sample_index || '-' || n AS new_id, b.id AS old_id FROM {NUMBERED}")
def renumbered_blocks(spark, d):
    rows = counted(spark, d, "blocks").select("video_id", "sample_index", F.transform("blocks", lambda b: F.struct(b["id"].alias("id"), b["id"].alias("old_id"))).alias("blocks"))
    made = rows.select("video_id", "sample_index", F.explode(adapter.renumber_blocks(F.col("blocks"), F.col("sample_index"))).alias("b"))
    return made.select("video_id", F.col("sample_index").cast("bigint").alias("sample_index"), F.col("b.id").alias("new_id"), "b.old_id")


def vendor_results(spark: SparkSession, d: str) -> DataFrame:
    """Counting rows as a vendor would write them: JSON with boxes in pixels."""
    rows = counted(spark, d, "blocks").join(table(spark, d, "videos").select("video_id", "width", "height"), "video_id")
    item = F.transform("blocks", lambda b: F.struct(
        b["source_text"].alias("block_content"), F.array(b["bbox"]["x0"] * F.col("width"), b["bbox"]["y0"] * F.col("height"), b["bbox"]["x1"] * F.col("width"), b["bbox"]["y1"] * F.col("height")).alias("bbox"),
        b["confidence"].alias("score"), b["reading_order"].alias("block_order"), b["label"].alias("label"), b["language"].alias("lang"),
    ))
    return rows.select("video_id", "sample_index", "width", "height", F.to_json(F.struct(F.struct(item.alias("parsing_res_list")).alias("res"))).alias("raw"))


def _unit_sql(a: str, b: str, pick: str) -> str:
    return f"CAST(round_even(least(1.0, greatest(0.0, {pick}({a}, {b}))) * 100000, 0) AS BIGINT)"


@query(f"""SELECT video_id, CAST(sample_index AS BIGINT) AS sample_index, CAST(n AS BIGINT) AS block_no, trim(b.source_text) AS source_text, b.label AS label,
  CAST(coalesce(b.reading_order, -1) AS BIGINT) AS reading_order, {_unit_sql("b.bbox.x0", "b.bbox.x1", "least")} AS x0, {_unit_sql("b.bbox.y0", "b.bbox.y1", "least")} AS y0,
  {_unit_sql("b.bbox.x0", "b.bbox.x1", "greatest")} AS x1, {_unit_sql("b.bbox.y0", "b.bbox.y1", "greatest")} AS y1 FROM {NUMBERED}
  WHERE video_id IN (SELECT video_id FROM videos) AND regexp_matches(coalesce(b.source_text, ''), '[\\p{{L}}\\p{{N}}]') AND (b.confidence IS NULL OR b.confidence >= 0.7)
  AND b.bbox.x0 IS NOT NULL""")
def parse_blocks(spark, d):
    made = adapter.parse_blocks(vendor_results(spark, d), 0.7)
    corner = [F.rint(F.col(f"bbox.{c}") * 100_000).cast("bigint").alias(c) for c in ("x0", "y0", "x1", "y1")]
    return made.select("video_id", *[F.coalesce(F.col(c), F.lit(-1)).cast("bigint").alias(c) for c in ("sample_index", "block_no", "reading_order")], "source_text", "label", *corner)


ORDERED = "{'x0': least(b.bbox.x0, b.bbox.x1), 'y0': least(b.bbox.y0, b.bbox.y1), 'x1': greatest(b.bbox.x0, b.bbox.x1), 'y1': greatest(b.bbox.y0, b.bbox.y1)}"
# each block beside the blocks of the next sample in its video
NEIGHBOURS = f"(SELECT p.video_id, p.b.id AS id_a, q.b.id AS id_b, p.n AS n_a, q.n AS n_b, p.box AS a, q.box AS c FROM (SELECT *, {ORDERED} AS box FROM {NUMBERED}) p JOIN (SELECT *, {ORDERED} AS box FROM {NUMBERED}) q ON p.video_id = q.video_id AND q.sample_index = p.sample_index + 1)"
COMMON = "(greatest(0.0, least(a.x1, c.x1) - greatest(a.x0, c.x0)) * greatest(0.0, least(a.y1, c.y1) - greatest(a.y0, c.y0)))"
UNION = f"(greatest(0.0, a.x1 - a.x0) * greatest(0.0, a.y1 - a.y0) + greatest(0.0, c.x1 - c.x0) * greatest(0.0, c.y1 - c.y0) - {COMMON})"
IOU = f"CASE WHEN {COMMON} > 0 AND {UNION} > 0 THEN {COMMON} / {UNION} ELSE 0 END"
APART = "sqrt(pow((a.x0 + a.x1) / 2 - (c.x0 + c.x1) / 2, 2) + pow((a.y0 + a.y1) / 2 - (c.y0 + c.y1) / 2, 2))"


def neighbours(spark: SparkSession, d: str) -> DataFrame:
    rows = counted(spark, d, "blocks").select("video_id", "sample_index", F.posexplode("blocks").alias("n", "b"))
    one = F.lit(1.0)
    box = geometry.unit_box(F.col("b.bbox.x0"), F.col("b.bbox.y0"), F.col("b.bbox.x1"), F.col("b.bbox.y1"), one, one)
    rows = rows.select("video_id", "sample_index", "n", F.col("b.id").alias("id"), box.alias("box"))
    a = rows.select("video_id", (F.col("sample_index") + 1).alias("sample_index"), F.col("n").alias("n_a"), F.col("id").alias("id_a"), F.col("box").alias("a"))
    b = rows.select("video_id", "sample_index", F.col("n").alias("n_b"), F.col("id").alias("id_b"), F.col("box").alias("c"))
    return a.join(b, ["video_id", "sample_index"])


@query(f"SELECT video_id, id_a, id_b, CAST(round_even(({IOU}) * 1000000, 0) AS BIGINT) AS iou_millionths FROM {NEIGHBOURS}")
def iou_pairs(spark, d):
    return neighbours(spark, d).select("video_id", "id_a", "id_b", millionths(geometry.iou(F.col("a"), F.col("c"))).alias("iou_millionths"))


@query(f"SELECT video_id, id_a, id_b, CAST(round_even({APART} * 1000000, 0) AS BIGINT) AS distance_millionths FROM {NEIGHBOURS}")
def center_distance_pairs(spark, d):
    return neighbours(spark, d).select("video_id", "id_a", "id_b", millionths(geometry.center_distance(F.col("a"), F.col("c"))).alias("distance_millionths"))


MATCHED = f"(({IOU}) > 0.3 OR {APART} < 0.08 * sqrt(2.0))"


@query(f"SELECT video_id, id_a, id_b FROM {NEIGHBOURS} WHERE {MATCHED}")
def region_match_join(spark, d):
    return neighbours(spark, d).where(geometry.region_match(F.col("a"), F.col("c"))).select("video_id", "id_a", "id_b")


@query(f"SELECT video_id, id_b, arg_min(id_a, n_a) AS id_a FROM {NEIGHBOURS} WHERE {MATCHED} GROUP BY video_id, id_b")
def region_first_match(spark, d):
    near = neighbours(spark, d).where(geometry.region_match(F.col("a"), F.col("c")))
    return near.groupBy("video_id", "id_b").agg(F.min_by("id_a", "n_a").alias("id_a"))


@query()
def similarity_pairs(spark, d):
    """Gestalt similarity of texts in the same place in neighbouring samples."""
    rows = counted(spark, d, "blocks").select("video_id", "sample_index", F.explode("blocks").alias("b"))
    rows = rows.select("video_id", "sample_index", samples.region_of(F.col("b.bbox")).alias("region"), F.col("b.source_text").alias("t"))
    a = rows.select("video_id", (F.col("sample_index") + 1).alias("sample_index"), "region", F.col("t").alias("t_a"))
    joined = a.join(rows.withColumnRenamed("t", "t_b"), ["video_id", "sample_index", "region"])
    pairs = joined.groupBy("t_a", "t_b").agg(F.count("*").alias("n"))
    return pairs.select("t_a", "t_b", "n", millionths(text.similarity(F.col("t_b"), F.col("t_a"))).alias("similarity_millionths"))


# ---- tracking ----
def _islands_sql(tolerance: int, least: int) -> str:
    return f"""WITH ok AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY sample_index) AS ord FROM {COUNTED} WHERE status <> 'failed'),
  seen AS (SELECT video_id, sample_index, timestamp_s, ord, {REGION} AS region, {TIDY % "b.source_text"} AS txt, b.confidence AS confidence FROM (SELECT *, unnest(blocks) AS b FROM ok)),
  flagged AS (SELECT *, CASE WHEN lag(txt) OVER w IS NULL OR txt <> lag(txt) OVER w OR ord - lag(ord) OVER w - 1 > {tolerance} THEN 1 ELSE 0 END AS fresh FROM seen WHERE txt <> '' AND region IS NOT NULL
    WINDOW w AS (PARTITION BY video_id, region ORDER BY ord)),
  marked AS (SELECT *, sum(fresh) OVER (PARTITION BY video_id, region ORDER BY ord) AS island FROM flagged),
  isl AS (SELECT video_id, region, island, min(timestamp_s) AS s, max(timestamp_s) AS e, arg_min(txt, ord) AS txt, min(ord) AS fo, max(ord) AS lo, max(confidence) AS confidence, count(*) AS n,
    min(sample_index) AS fs, max(sample_index) AS ls FROM marked GROUP BY ALL),
  nxt AS (SELECT i.*, CASE WHEN lead(fo) OVER w - lo - 1 <= {tolerance} THEN lead(s) OVER w END AS ns, v.sample_interval AS step, v.duration AS dur FROM isl i LEFT JOIN videos v USING (video_id)
    WINDOW w AS (PARTITION BY video_id, region ORDER BY island)),
  timed AS (SELECT *, {MS % "greatest(s, 0.0)"} AS start_ms, CAST(round_even(CASE WHEN dur > 0 THEN least(coalesce(ns, e + coalesce(step, 1.0)), dur) ELSE coalesce(ns, e + coalesce(step, 1.0)) END * 1000, 0) AS BIGINT) AS end_ms FROM nxt)
  SELECT video_id, region, start_ms, end_ms, txt AS text, confidence, CAST(n AS BIGINT) AS observation_count, CAST(fs AS BIGINT) AS first_sample, CAST(ls AS BIGINT) AS last_sample FROM timed WHERE end_ms - start_ms >= {least}"""


def _islands(spark, d, tolerance: int, least: float) -> DataFrame:
    made = tracking.region_islands(table(spark, d, "ocr_results"), table(spark, d, "videos"), tolerance, least)
    return made.select("video_id", "region", "start_ms", "end_ms", "text", "confidence", "observation_count", F.col("first_sample").cast("bigint").alias("first_sample"), F.col("last_sample").cast("bigint").alias("last_sample"))


@query(_islands_sql(1, 0))
def track_islands(spark, d):
    return _islands(spark, d, 1, 0.0)


@query(_islands_sql(0, 0))
def track_islands_tol0(spark, d):
    return _islands(spark, d, 0, 0.0)


@query(_islands_sql(1, 2000))
def track_min_duration(spark, d):
    return _islands(spark, d, 1, 2.0)


@query(f"""WITH ok AS (SELECT video_id, sample_index, row_number() OVER (PARTITION BY video_id ORDER BY sample_index) AS ord,
    len(list_filter(coalesce(blocks, []), lambda b: length(trim(coalesce(b.source_text, ''))) > 0)) > 0 AS busy FROM {COUNTED} WHERE status <> 'failed' AND timestamp_s IS NOT NULL),
  b AS (SELECT *, lag(ord) OVER (PARTITION BY video_id ORDER BY ord) AS before FROM ok WHERE busy),
  s AS (SELECT *, max(CASE WHEN before IS NULL OR ord - before - 1 > 1 THEN ord END) OVER (PARTITION BY video_id ORDER BY ord) AS stretch FROM b)
  SELECT video_id, CAST(stretch AS BIGINT) AS stretch, CAST(count(*) AS BIGINT) AS n_busy, CAST(min(sample_index) AS BIGINT) AS first_sample, CAST(max(sample_index) AS BIGINT) AS last_sample FROM s GROUP BY ALL""")
def quiescent_stretches(spark, d):
    rows = counted(spark, d, "status", "timestamp_s", "blocks").where((F.col("status") != "failed") & F.col("timestamp_s").isNotNull())
    busy = F.exists(F.coalesce("blocks", F.array().cast(rows.schema["blocks"].dataType)), lambda b: F.length(F.trim(F.coalesce(b["source_text"], F.lit("")))) > 0)
    found = tracking.quiescent_stretches(rows.select("video_id", "sample_index", busy.alias("busy")), 1)
    return found.groupBy("video_id", F.col("stretch").cast("bigint").alias("stretch")).agg(
        F.count("*").alias("n_busy"), F.min("sample_index").cast("bigint").alias("first_sample"), F.max("sample_index").cast("bigint").alias("last_sample")
    )


def tracked(spark: SparkSession, d: str) -> DataFrame:
    return tracking.track_events(table(spark, d, "ocr_results"), table(spark, d, "videos"))


@query()
def track_events(spark, d):
    events = tracking.numbered_events(tracked(spark, d))
    return events.select("video_id", "event_no", ms(F.col("start_s")).alias("start_ms"), ms(F.col("end_s")).alias("end_ms"), "source_text", "reading_order", "label", "confidence", "observation_count", F.array_join("sample_indices", ",").alias("sample_indices"))


#: Boxes that stand for the regions where only those count.
REGION_BOXES = {"top": (0.1, 0.0, 0.9, 0.3), "middle": (0.1, 0.35, 0.9, 0.65), "bottom": (0.1, 0.7, 0.9, 1.0)}


EXACT = f"SELECT video_id, region, start_ms, end_ms, md5(text) AS text, confidence, observation_count, first_sample, last_sample FROM ({_islands_sql(1, 0)})"
EXACT_SETTINGS = Settings(text_similarity=1.0, min_event_duration=0.0)


def exact_samples(rows: DataFrame) -> DataFrame:
    """Samples with texts as digests and boxes as those of regions, so that SQL can say what the fold does with them."""

    def plain(b: Column) -> Column:
        shown, region = text.tidy_display(b["source_text"]), samples.region_of(b["bbox"])
        box = F.coalesce(*[F.when(region == name, F.struct(*[F.lit(v).alias(k) for k, v in zip(("x0", "y0", "x1", "y1"), corners)])) for name, corners in REGION_BOXES.items()])
        return F.struct(box.alias("bbox"), F.when(shown != "", F.md5(shown)).otherwise("").alias("source_text"), b["label"].alias("label"), b["reading_order"].alias("reading_order"), b["confidence"].alias("confidence"))

    return rows.withColumn("blocks", F.transform("blocks", plain))


def exact_events(events: DataFrame) -> DataFrame:
    region = F.coalesce(*[F.when(F.col("bbox.y0") == corners[1], name) for name, corners in REGION_BOXES.items()])
    return events.select(
        "video_id", region.alias("region"), ms(F.col("start_s")).alias("start_ms"), ms(F.col("end_s")).alias("end_ms"), F.col("source_text").alias("text"), "confidence",
        F.col("observation_count").cast("bigint").alias("observation_count"), F.array_min("sample_indices").cast("bigint").alias("first_sample"), F.array_max("sample_indices").cast("bigint").alias("last_sample"),
    )


@query(EXACT)
def track_events_exact(spark, d):
    """The fold where only equal texts of a region continue an event."""
    return exact_events(tracking.track_events(exact_samples(table(spark, d, "ocr_results")), table(spark, d, "videos"), EXACT_SETTINGS))


@query("""SELECT track_id, video_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY start_s NULLS FIRST, bbox[2] NULLS FIRST, bbox[1] NULLS FIRST, end_s NULLS FIRST, source_text NULLS FIRST, track_id) AS BIGINT) AS event_no
  FROM (SELECT DISTINCT track_id, video_id, start_s, end_s, source_text, bbox FROM tracks)""")
def numbered_tracks(spark, d):
    rows = tracks(spark, d, "video_id", "start_s", "end_s", "source_text", "bbox")
    box = F.when(F.col("bbox").isNotNull(), F.struct(*[F.get("bbox", F.lit(k)).alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))]))
    events = rows.withColumn("bbox", box).withColumn("close_seq", F.col("track_id"))
    return tracking.numbered_events(events).select("track_id", "video_id", F.col("event_no").cast("bigint").alias("event_no"))


# ---- cues ----
def _compose_sql(k1: str, k2: str) -> str:
    return f"""WITH l AS (SELECT video_id, {MS % "start_s"} AS start_ms, {MS % "end_s"} AS end_ms, source_text, reading_order AS ro, {k1} AS k1, {k2} AS k2, track_id FROM {TRACKS}),
  g AS (SELECT *, bool_and(ro IS NOT NULL) OVER (PARTITION BY video_id, start_ms, end_ms) AS ordered FROM l)
  SELECT video_id, start_ms, end_ms, string_agg(coalesce(source_text, '<null>'), chr(10) ORDER BY CASE WHEN ordered THEN ro ELSE k1 END NULLS FIRST, CASE WHEN ordered THEN 0.0 ELSE k2 END NULLS FIRST, track_id) AS lines,
  CAST(count(*) AS BIGINT) AS n_lines FROM g GROUP BY video_id, start_ms, end_ms"""


def _composed(spark, d, order: str) -> DataFrame:
    made = compose.compose_cues(tracks(spark, d, "video_id", "start_s", "end_s", "source_text", "bbox", "reading_order"), order, ["track_id"])
    return made.select("video_id", ms(F.col("start_s")).alias("start_ms"), ms(F.col("end_s")).alias("end_ms"), F.array_join("source_texts", "\n", "<null>").alias("lines"), F.size("source_texts").cast("bigint").alias("n_lines"))


@query(_compose_sql("round_even(bbox[2], 3)", "bbox[1]"))
def compose_cues(spark, d):
    return _composed(spark, d, "auto")


@query(_compose_sql("round_even(bbox[2], 3)", "-bbox[1]"))
def compose_cues_rtl(spark, d):
    return _composed(spark, d, "rtl")


@query(_compose_sql("round_even(-bbox[1], 3)", "bbox[2]"))
def compose_cues_ttb(spark, d):
    return _composed(spark, d, "ttb")


@query(f"SELECT {KEY % 'source_lines'} AS canonical_key, CAST(count(*) AS BIGINT) AS n FROM {CUES} GROUP BY 1")
def canonical_keys(spark, d):
    return cues(spark, d, "source_lines").groupBy(keys.canonical_key(F.col("source_lines")).alias("canonical_key")).agg(F.count("*").alias("n"))


@query(f"""SELECT DISTINCT k AS canonical_key FROM (SELECT {KEY % "source_lines"} AS k FROM {CUES} WHERE coalesce(source, 'ocr') = 'ocr'
  UNION ALL SELECT {KEY % f"[{CLEAN % 'l'}]"} FROM (SELECT unnest(source_lines) AS l FROM {CUES} WHERE source = 'audio') WHERE {CLEAN % 'l'} <> '')""")
def distinct_cues(spark, d):
    every = cues(spark, d, "source_lines", "source")
    screen = every.where(F.coalesce("source", F.lit("ocr")) == "ocr").select(F.col("source_lines").alias("source_texts"))
    return translate.distinct_cues(screen, every.where("source = 'audio'").select(F.explode("source_lines").alias("text")))


@query(f"SELECT cue_id, CAST(i AS BIGINT) AS line_no, {CLEAN % 'source_lines[i]'} AS clean, {TIDY % 'source_lines[i]'} AS tidy FROM (SELECT *, unnest(range(1, len(source_lines) + 1)) AS i FROM {CUES})")
def clean_lines(spark, d):
    rows = cues(spark, d, "source_lines").select("cue_id", F.posexplode("source_lines").alias("i", "t"))
    return rows.select("cue_id", (F.col("i") + 1).cast("bigint").alias("line_no"), text.clean_text(F.col("t")).alias("clean"), text.tidy_display(F.col("t")).alias("tidy"))


@query()
def display_and_match_text(spark, d):
    lines = table(spark, d, "cues").select(F.explode("source_lines").alias("t")).distinct()
    return lines.select("t", text.display_text(F.col("t")).alias("display"), text.match_text(F.col("t")).alias("match"))


SHOWN = "list_transform(range(1, len(translated_lines) + 1), lambda i: coalesce(nullif(translated_lines[i], ''), source_lines[i], ''))"


@query(f"SELECT cue_id, array_to_string({SHOWN}, chr(10)) AS shown, array_to_string(list_concat({SHOWN}, source_lines), chr(10)) AS bilingual FROM {CUES} WHERE len(translated_lines) > 0")
def display_lines(spark, d):
    rows = cues(spark, d, "source_lines", "translated_lines").where(F.size("translated_lines") > 0)
    return rows.select("cue_id", *[F.array_join(emit.display_lines(F.col("translated_lines"), F.col("source_lines"), b), "\n").alias(n) for n, b in (("shown", False), ("bilingual", True))])


def translations(spark: SparkSession, d: str) -> DataFrame:
    """The first translation of each key that the final cues have."""
    rows = cues(spark, d, "source_lines", "translated_lines").select("cue_id", "translated_lines", keys.canonical_key(F.col("source_lines")).alias("canonical_key"))
    return rows.groupBy("canonical_key").agg(F.min_by("translated_lines", "cue_id").alias("translated_lines"))


TRANSLATIONS = f"(SELECT {KEY % 'source_lines'} AS k, arg_min(translated_lines, cue_id) AS tl FROM {CUES} GROUP BY 1)"
FALLBACK = "CASE WHEN tl IS NOT NULL AND len(tl) = len(sl) THEN list_transform(range(1, len(sl) + 1), lambda i: coalesce(nullif(tl[i], ''), sl[i])) ELSE sl END"
FINAL = f"""(SELECT video_id, start_ms, end_ms, sl, told, cue_id, row_number() OVER (PARTITION BY video_id, start_ms, end_ms, sl, told ORDER BY cue_id) AS r FROM (
  SELECT c.video_id, c.cue_id, {MS % "CASE WHEN v.duration > 0 THEN least(greatest(c.start_s, 0.0), v.duration) ELSE greatest(c.start_s, 0.0) END"} AS start_ms,
  {MS % "CASE WHEN v.duration > 0 THEN least(c.end_s, v.duration) ELSE c.end_s END"} AS end_ms, c.source_lines AS sl, {FALLBACK.replace("sl", "c.source_lines").replace("tl", "t.tl")} AS told
  FROM {CUES} c LEFT JOIN (SELECT video_id, max(duration) AS duration FROM videos GROUP BY 1) v USING (video_id) LEFT JOIN {TRANSLATIONS} t ON t.k = {KEY % "c.source_lines"}
  WHERE coalesce(c.source, 'ocr') = 'ocr' AND CASE WHEN v.duration > 0 THEN least(c.end_s, v.duration) ELSE c.end_s END > CASE WHEN v.duration > 0 THEN least(greatest(c.start_s, 0.0), v.duration) ELSE greatest(c.start_s, 0.0) END))"""
SPOKEN = f"""(SELECT video_id, start_ms, end_ms, txt, line, row_number() OVER (PARTITION BY video_id, start_ms, end_ms, txt ORDER BY cue_id) AS r FROM (
  SELECT c.video_id, c.cue_id, c.txt, coalesce(CASE WHEN len(t.tl) = 1 THEN nullif(t.tl[1], '') END, c.txt) AS line,
  {MS % "CASE WHEN v.duration > 0 THEN least(greatest(c.start_s, 0.0), v.duration) ELSE greatest(c.start_s, 0.0) END"} AS start_ms, {MS % "CASE WHEN v.duration > 0 THEN least(c.end_s, v.duration) ELSE c.end_s END"} AS end_ms
  FROM (SELECT *, {CLEAN % "array_to_string(source_lines, ' ')"} AS txt FROM {CUES} WHERE source = 'audio') c LEFT JOIN (SELECT video_id, max(duration) AS duration FROM videos GROUP BY 1) v USING (video_id)
  LEFT JOIN {TRANSLATIONS} t ON t.k = {KEY % "[c.txt]"} WHERE c.txt <> ''
  AND CASE WHEN v.duration > 0 THEN least(c.end_s, v.duration) ELSE c.end_s END > CASE WHEN v.duration > 0 THEN least(greatest(c.start_s, 0.0), v.duration) ELSE greatest(c.start_s, 0.0) END))"""


def final_screen(spark: SparkSession, d: str) -> DataFrame:
    rows = cues(spark, d, "video_id", "start_s", "end_s", "source_lines", "bboxes", "source").where(F.coalesce("source", F.lit("ocr")) == "ocr").withColumnRenamed("source_lines", "source_texts")
    return cleanup.finalize_cues(rows.select("cue_id", "video_id", "start_s", "end_s", "source_texts", "bboxes"), translations(spark, d), table(spark, d, "videos"), ["cue_id"])


def final_audio(spark: SparkSession, d: str) -> DataFrame:
    rows = cues(spark, d, "video_id", "start_s", "end_s", "source_lines", "source").where("source = 'audio'").select("cue_id", "video_id", "start_s", "end_s", F.array_join("source_lines", " ").alias("text"))
    return cleanup.finalize_audio(rows, translations(spark, d), table(spark, d, "videos"), ["cue_id"])


def _event_columns(df: DataFrame, *more: str) -> DataFrame:
    return df.select("video_id", ms(F.col("start_s")).alias("start_ms"), ms(F.col("end_s")).alias("end_ms"), F.array_join("source_lines", "\n", "<null>").alias("source_lines"), F.array_join("translated_lines", "\n", "<null>").alias("translated_lines"), *more)


LINES = "array_to_string(list_transform(%s, lambda x: coalesce(x, '<null>')), chr(10))"


@query(f"SELECT video_id, start_ms, end_ms, {LINES % 'sl'} AS source_lines, {LINES % 'told'} AS translated_lines FROM {FINAL} WHERE r = 1")
def final_cues(spark, d):
    return _event_columns(final_screen(spark, d))


@query(f"SELECT video_id, start_ms, end_ms, txt AS source_lines, line AS translated_lines FROM {SPOKEN} WHERE r = 1")
def audio_events(spark, d):
    return _event_columns(final_audio(spark, d))


EVENTS = f"""(SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start_ms, end_ms, rank, sl, told) AS event_no FROM (
  SELECT video_id, start_ms, end_ms, sl, told, 'ocr' AS source, 0 AS rank FROM {FINAL} WHERE r = 1 UNION ALL SELECT video_id, start_ms, end_ms, [txt], [line], 'audio', 1 FROM {SPOKEN} WHERE r = 1))"""


def merged(spark: SparkSession, d: str) -> DataFrame:
    return cleanup.merge_events(final_screen(spark, d), final_audio(spark, d))


@query(f"SELECT video_id, CAST(event_no AS BIGINT) AS event_no, source, start_ms, end_ms, {LINES % 'sl'} AS source_lines, {LINES % 'told'} AS translated_lines FROM {EVENTS}")
def merged_events(spark, d):
    return _event_columns(merged(spark, d).withColumn("event_no", F.col("event_no").cast("bigint")), "event_no", "source")


# ---- subtitle text ----
SRT = "printf('%02d:%02d:%02d,%03d', {0} // 3600000, ({0} // 60000) % 60, ({0} // 1000) % 60, {0} % 1000)"
ASS = "printf('%d:%02d:%02d.%02d', {0} // 360000, ({0} // 6000) % 60, ({0} // 100) % 60, {0} % 100)"
CS = "CAST(round_even(%s * 100, 0) AS BIGINT)"


@query(f"SELECT track_id, {SRT.format(MS % 'greatest(start_s, 0.0)')} AS srt, {ASS.format(CS % 'greatest(start_s, 0.0)')} AS ass FROM {TRACKS} WHERE start_s IS NOT NULL")
def time_codes(spark, d):
    rows = tracks(spark, d, "start_s").where(F.col("start_s").isNotNull())
    return rows.select("track_id", timefmt.srt_time(F.col("start_s")).alias("srt"), timefmt.ass_time(F.col("start_s")).alias("ass"))


SHOW = "list_filter(list_transform(range(1, len(told) + 1), lambda i: coalesce(nullif(told[i], ''), sl[i], '')), lambda x: x <> '')"
SHOWING = f"(SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start_ms, end_ms, event_no) AS n FROM (SELECT *, {SHOW} AS ln FROM {EVENTS}) WHERE len(ln) > 0)"
SRT_BLOCK = f"n || chr(10) || {SRT.format('start_ms')} || ' --> ' || {SRT.format('end_ms')} || chr(10) || array_to_string(ln, chr(10)) || chr(10)"


@query(f"SELECT video_id, CAST(n AS BIGINT) AS n, {SRT_BLOCK} AS block FROM {SHOWING}")
def srt_blocks(spark, d):
    return emit.srt_blocks(merged(spark, d)).select("video_id", F.col("n").cast("bigint").alias("n"), "block")


@query(f"SELECT video_id, string_agg({SRT_BLOCK}, chr(10) ORDER BY n) || chr(10) AS document FROM {SHOWING} GROUP BY video_id")
def srt_documents(spark, d):
    return emit.srt_documents(merged(spark, d))


BOTH = SHOW.replace("list_transform(range(1, len(told) + 1), lambda i: coalesce(nullif(told[i], ''), sl[i], ''))", "list_concat(list_transform(range(1, len(told) + 1), lambda i: coalesce(nullif(told[i], ''), sl[i], '')), sl)")
SHOWING_BOTH = SHOWING.replace(SHOW, BOTH)


@query(f"SELECT video_id, CAST(n AS BIGINT) AS n, {SRT_BLOCK} AS block FROM {SHOWING_BOTH}")
def srt_blocks_bilingual(spark, d):
    return emit.srt_blocks(merged(spark, d), True).select("video_id", F.col("n").cast("bigint").alias("n"), "block")


DIALOGUE = f"""(SELECT video_id, n, p, 'Dialogue: 0,' || {ASS.format("CAST(round_even(start_ms / 1000.0::DOUBLE * 100, 0) AS BIGINT)")} || ',' || {ASS.format("CAST(round_even(end_ms / 1000.0::DOUBLE * 100, 0) AS BIGINT)")} || ',' || CASE WHEN source = 'audio' THEN 'Audio' ELSE 'Default' END
  || ',,0,0,0,,' || replace(replace(replace(replace(array_to_string(ln[p * 2 + 1 : p * 2 + 2], chr(10)), '{{', '('), '}}', ')'), chr(13) || chr(10), chr(10)), chr(10), '\\N') AS dialogue
  FROM (SELECT *, unnest(range(0, CAST(ceil(len(ln) / 2.0) AS BIGINT))) AS p FROM {SHOWING}))"""


@query(f"SELECT video_id, CAST(n AS BIGINT) AS n, CAST(p AS BIGINT) AS part, dialogue FROM {DIALOGUE}")
def ass_dialogues(spark, d):
    return emit.ass_dialogues(merged(spark, d)).select("video_id", F.col("n").cast("bigint").alias("n"), F.col("part").cast("bigint").alias("part"), "dialogue")


def _ass_header_sql() -> str:
    style = "'Style: {0},Arial,' || greatest(20, CAST(round_even(h * 0.05, 0) AS INT)) || ',{1},&H000000FF,&H00000000,&H80000000,0,0,0,0,100,100,0,0,1,' || greatest(1, CAST(round_even(h * 0.002, 0) AS INT)) || ',1,{2},' || greatest(10, CAST(round_even(w * 0.03, 0) AS INT)) || ',' || greatest(10, CAST(round_even(w * 0.03, 0) AS INT)) || ',' || greatest(10, CAST(round_even(h * 0.04, 0) AS INT)) || ',1'"
    default, spoken = style.format("Default", timefmt.WHITE, 2), style.format("Audio", timefmt.COLORS["yellow"], 8)
    line = lambda x: "'" + x.replace("\n", "' || chr(10) || '") + "'"
    return f"""{line(emit.INFO)} || 'PlayResX: ' || w || chr(10) || 'PlayResY: ' || h || chr(10) || chr(10) || {line(emit.STYLES)} || {default} || CASE WHEN spoken THEN chr(10) || {spoken} ELSE '' END || chr(10) || chr(10) || {line(emit.EVENTS)}"""


SIZES = f"""(SELECT e.video_id, e.spoken, CASE WHEN coalesce(v.width, 0) = 0 THEN 1920 ELSE v.width END AS w, CASE WHEN coalesce(v.height, 0) = 0 THEN 1080 ELSE v.height END AS h
  FROM (SELECT video_id, bool_or(source = 'audio') AS spoken FROM {EVENTS} GROUP BY 1) e LEFT JOIN videos v USING (video_id))"""


@query(f"""SELECT s.video_id, {_ass_header_sql()} || coalesce((SELECT string_agg(dialogue, chr(10) ORDER BY n, p) || chr(10) FROM {DIALOGUE} x WHERE x.video_id = s.video_id), '') AS document FROM {SIZES} s""")
def ass_documents(spark, d):
    return emit.ass_documents(merged(spark, d), table(spark, d, "videos"))


# ---- equal inputs and caches ----
@query("SELECT sha256(text) AS key, CAST(min(doc_id) AS BIGINT) AS doc_id, CAST(count(*) AS BIGINT) AS n_members FROM documents WHERE text IS NOT NULL GROUP BY 1")
def exact_dedupe_groups(spark, d):
    rows = table(spark, d, "documents").where(F.col("text").isNotNull()).select(F.sha2("text", 256).alias("key"), "doc_id")
    return dedupe.representatives(rows, "key", "doc_id")


@query("SELECT d.doc_id, r.first_id FROM documents d JOIN (SELECT sha256(text) AS key, min(doc_id) AS first_id FROM documents GROUP BY 1) r ON r.key = sha256(d.text)")
def dedupe_fanout(spark, d):
    rows = table(spark, d, "documents").where(F.col("text").isNotNull()).select(F.sha2("text", 256).alias("key"), "doc_id")
    first = dedupe.representatives(rows, "key", "doc_id").select("key", F.col("doc_id").alias("first_id"))
    return dedupe.fan_out(first, rows, "key").select("doc_id", "first_id")


def memo(spark: SparkSession, d: str) -> DataFrame:
    """Cached answers by the lines they answer: the latest of each."""
    rows = table(spark, d, "llm_cache").select(F.get_json_object("request", "$.messages[1].content").alias("cache_key"), F.col("response").alias("normalized"), "created_at")
    return rows.groupBy("cache_key").agg(F.max_by("normalized", "created_at").alias("normalized"), F.max("created_at").alias("created_at")).withColumn("hit_count", F.lit(0).cast("bigint"))


MEMO = "(SELECT json_extract_string(request, '$.messages[1].content') AS cache_key, max(created_at) AS created_at FROM llm_cache GROUP BY 1)"


@query(f"SELECT c.cue_id, m.cache_key IS NOT NULL AS hit FROM (SELECT cue_id, {KEY % 'source_lines'} AS k FROM {CUES}) c LEFT JOIN {MEMO} m ON m.cache_key = c.k")
def cache_lookup(spark, d):
    rows = cues(spark, d, "source_lines").select("cue_id", keys.canonical_key(F.col("source_lines")).alias("cache_key"))
    return dedupe.look_up(rows, memo(spark, d)).select("cue_id", "hit")


@query(f"""SELECT CAST(count(*) FILTER (hit) AS BIGINT) AS hits, CAST(count(*) FILTER (NOT hit) AS BIGINT) AS misses, CAST(round_even(count(*) FILTER (hit) / count(*) * 1000000, 0) AS BIGINT) AS rate_millionths
  FROM (SELECT m.cache_key IS NOT NULL AS hit FROM (SELECT {KEY % 'source_lines'} AS k FROM {CUES}) c LEFT JOIN {MEMO} m ON m.cache_key = c.k)""")
def hit_ratio(spark, d):
    return stats.hit_ratio(cache_lookup(spark, d)).select("hits", "misses", millionths(F.col("hit_rate")).alias("rate_millionths"))


@query(f"SELECT m.cache_key, CAST(count(c.k) AS BIGINT) AS hit_count FROM {MEMO} m LEFT JOIN (SELECT {KEY % 'source_lines'} AS k FROM {CUES}) c ON c.k = m.cache_key GROUP BY 1")
def cache_hit_counts(spark, d):
    rows = cues(spark, d, "source_lines").select(keys.canonical_key(F.col("source_lines")).alias("cache_key"))
    return dedupe.count_hits(memo(spark, d), dedupe.look_up(rows, memo(spark, d).select("cache_key"))).select("cache_key", "hit_count")


@query(f"""SELECT cache_key, epoch_us(arg_max(created_at, (fresh, created_at))) AS created_us, CAST(max(fresh) AS BIGINT) AS is_new FROM (
  SELECT cache_key, created_at, 0 AS fresh FROM {MEMO} UNION ALL SELECT {KEY % 'source_lines'}, max(written_at), 1 FROM {CUES} GROUP BY 1) GROUP BY 1""")
def cache_upsert(spark, d):
    new = cues(spark, d, "source_lines", "written_at").groupBy(keys.canonical_key(F.col("source_lines")).alias("cache_key")).agg(F.max("written_at").alias("created_at")).withColumn("normalized", F.lit("new"))
    after = dedupe.upsert(memo(spark, d), new)
    return after.select("cache_key", F.unix_micros(F.col("created_at").cast("timestamp")).alias("created_us"), (F.coalesce("normalized", F.lit("")) == "new").cast("bigint").alias("is_new"))


@query("""WITH c AS (SELECT DISTINCT sha256(text) || ':' || source AS k FROM documents), kept AS (SELECT k FROM c WHERE split_part(k, ':', 2) <> 'slide_ocr')
  SELECT k AS cache_key FROM kept UNION ALL SELECT split_part(k, ':', 1) || ':fansub_pool' FROM c WHERE split_part(k, ':', 2) = 'slide_ocr' AND split_part(k, ':', 1) || ':fansub_pool' NOT IN (SELECT k FROM kept)""")
def cache_migrate(spark, d):
    cache = table(spark, d, "documents").select(F.concat_ws(":", F.sha2("text", 256), "source").alias("cache_key")).distinct()
    return dedupe.migrate_keys(cache, "slide_ocr", "fansub_pool")


@query("""SELECT l.cache_key, sha256('{"messages":[{"content":' || CAST(to_json(s) AS VARCHAR) || ',"role":"system"},{"content":' || CAST(to_json(u) AS VARCHAR) || ',"role":"user"}],"model":' || CAST(to_json(m) AS VARCHAR) || ',"temperature":0}') AS request_key
  FROM (SELECT cache_key, json_extract_string(request, '$.messages[0].content') AS s, json_extract_string(request, '$.messages[1].content') AS u, json_extract_string(request, '$.model') AS m FROM llm_cache) l""")
def request_keys(spark, d):
    return table(spark, d, "llm_cache").select("cache_key", keys.request_keys(F.col("request")).alias("request_key"))


@query("""SELECT cache_key, CASE WHEN length(t) > 30 THEN left(t, 30) || '…' ELSE t END AS preview FROM (SELECT cache_key, trim(regexp_replace(json_extract_string(request, '$.messages[1].content'), '\\s+', ' ', 'g')) AS t FROM llm_cache)""")
def request_previews(spark, d):
    return table(spark, d, "llm_cache").select("cache_key", keys.request_preview(F.col("request")).alias("preview"))


@query("""WITH s AS (SELECT cache_key, nullif(regexp_extract(json_extract_string(response, '$.choices[0].message.content'), '(?s)\\[.*\\]'), '') AS t FROM llm_cache),
  a AS (SELECT cache_key, CASE WHEN json_valid(t) THEN list_transform(json_extract(t, '$[*]'), lambda x: CASE WHEN json_type(x) = 'BOOLEAN' THEN upper(left(CAST(x AS VARCHAR), 1)) || substr(CAST(x AS VARCHAR), 2) ELSE coalesce(x ->> '$', 'None') END) END AS a FROM s)
  SELECT cache_key, CAST(coalesce(len(a), 0) AS BIGINT) AS n_lines, array_to_string(a, chr(10)) AS lines FROM a""")
def parsed_answers(spark, d):
    content = F.get_json_object("response", "$.choices[0].message.content")
    parsed = table(spark, d, "llm_cache").select("cache_key", parse.json_arrays(content).alias("a"))
    return parsed.select("cache_key", F.coalesce(F.size("a"), F.lit(0)).cast("bigint").alias("n_lines"), F.array_join("a", "\n").alias("lines"))


def echo_chat():
    """A stand-in for a translation model: every line comes back in brackets."""
    import json

    return lambda messages: json.dumps([f"[{line}]" for line in json.loads(messages[-1]["content"])], ensure_ascii=False)


@query(f"""SELECT {KEY % 'source_lines'} AS canonical_key, any_value(array_to_string(list_transform(source_lines, lambda x: '[' || x || ']'), chr(10))) AS lines FROM {CUES} GROUP BY 1""")
def memo_translate(spark, d):
    wanted = cues(spark, d, "source_lines").select(keys.canonical_key(F.col("source_lines")).alias("canonical_key"))
    empty = spark.createDataFrame([], translate.TRANSLATION)
    _, new = dedupe.memo_map(wanted, "canonical_key", empty, lambda missing: translate.translate_keys(missing, echo_chat, None, "xx"))
    return new.select("canonical_key", F.array_join("translated_lines", "\n").alias("lines"))


@query(f"""WITH m AS (SELECT * FROM (SELECT json_extract_string(request, '$.messages[1].content') AS k, json_extract_string(response, '$.choices[0].message.content') AS t, row_number() OVER (PARTITION BY k ORDER BY created_at DESC, cache_key DESC) AS r FROM llm_cache) WHERE r = 1)
  SELECT c.canonical_key, CASE WHEN m.k IS NULL THEN c.lines ELSE m.t END AS lines, m.k IS NOT NULL AS hit FROM (
    SELECT {KEY % 'source_lines'} AS canonical_key, any_value(array_to_string(list_transform(source_lines, lambda x: '[' || x || ']'), chr(10))) AS lines FROM {CUES} GROUP BY 1) c LEFT JOIN m ON m.k = c.canonical_key""")
def memo_translate_filled(spark, d):
    """Answers that the cache has, as it has them, and translations of what it lacks."""
    wanted = cues(spark, d, "source_lines").select(keys.canonical_key(F.col("source_lines")).alias("canonical_key")).distinct()
    rows = table(spark, d, "llm_cache").select(F.get_json_object("request", "$.messages[1].content").alias("canonical_key"), F.get_json_object("response", "$.choices[0].message.content").alias("told"), "created_at", "cache_key")
    known = rows.groupBy("canonical_key").agg(F.max_by("told", F.struct("created_at", "cache_key")).alias("told"))
    cache = known.select("canonical_key", F.col("told").alias("lines"), F.lit(True).alias("hit"))

    def compute(missing: DataFrame) -> DataFrame:
        done = translate.translate_keys(missing, echo_chat, None, "xx")
        return done.select("canonical_key", F.array_join("translated_lines", "\n").alias("lines"), F.lit(False).alias("hit"))

    return dedupe.memo_map(wanted, "canonical_key", cache, compute)[0]


@query()
def subtitles_from_samples(spark, d):
    """The whole path: samples tracked, composed, translated by the stand-in, made final and written as SRT."""
    events = tracking.numbered_events(tracked(spark, d))
    made = cut_lineage(compose.compose_cues(events, Settings().reading_order, ["event_no"]))
    done = translate.translate_keys(translate.distinct_cues(made), echo_chat, None, "xx")
    final = cleanup.finalize_cues(made, done, table(spark, d, "videos"))
    speech = spark.createDataFrame([], "video_id long, start_s double, end_s double, source_lines array<string>, translated_lines array<string>, bboxes array<array<double>>, source string")
    return emit.srt_documents(cleanup.merge_events(final, speech))


# ---- windows of time ----
@query(f"SELECT video_id, CAST(floor(timestamp_s / 10) AS BIGINT) AS window_no, CAST(count(*) AS BIGINT) AS n_samples, CAST(sum(coalesce(len(blocks), 0)) AS BIGINT) AS n_blocks FROM {COUNTED} WHERE timestamp_s IS NOT NULL GROUP BY ALL")
def sample_windows(spark, d):
    rows = counted(spark, d, "timestamp_s", "blocks").where(F.col("timestamp_s").isNotNull())
    n = F.coalesce(F.size("blocks"), F.lit(0))
    return rows.groupBy("video_id", F.floor(F.col("timestamp_s") / 10).cast("bigint").alias("window_no")).agg(F.count("*").alias("n_samples"), F.sum(n).cast("bigint").alias("n_blocks"))


@query("""SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ingested_at)) AS window_us, status, CAST(count(*) AS BIGINT) AS n FROM ocr_results WHERE ingested_at IS NOT NULL GROUP BY ALL""")
def stream_delivery_windows(spark, d):
    counts = streams.delivery_windows(streams.table_stream(spark, d, "ocr_results"))
    return streams.run_to_table(counts, "complete").select(F.unix_micros("window_start").alias("window_us"), "status", "n")


@query()
def stream_track_events(spark, d):
    """The fold over the stream of samples, to its end: the events of track_events."""
    events = streams.track_to_table(streams.table_stream(spark, d, "ocr_results", files_per_trigger=64), table(spark, d, "videos"))
    return events.select("video_id", ms(F.col("start_s")).alias("start_ms"), ms(F.col("end_s")).alias("end_ms"), "source_text", "reading_order", "label", "confidence", "observation_count", F.array_join("sample_indices", ",").alias("sample_indices"))


@query(EXACT)
def stream_track_exact(spark, d):
    """The fold over the stream of samples where only equal texts of a region continue an event."""
    rows = exact_samples(streams.table_stream(spark, d, "ocr_results", files_per_trigger=64))
    return exact_events(streams.track_to_table(rows, table(spark, d, "videos"), EXACT_SETTINGS))


# ---- stages as tables, images ----
@query("SELECT video_id, CAST(2 * count(*) AS BIGINT) AS n, CAST(2 * coalesce(sum(len(sample_indices)), 0) AS BIGINT) AS n_samples FROM tracks GROUP BY 1")
def stage_table_roundtrip(spark, d):
    """A stage's table written by video, added to, and read again; an absent one is empty."""
    rows = table(spark, d, "tracks").select("video_id", "track_id", "sample_indices")
    work = tables.Workspace(spark, streams.scratch(spark))
    work.write("tracks", rows, partition_by="video_id")
    work.write("tracks", rows, partition_by="video_id", mode="append")
    both = work.read("tracks").unionByName(work.read("segments").select("video_id", F.lit(None).cast("long").alias("track_id"), F.lit(None).cast("array<int>").alias("sample_indices")))
    return both.groupBy(F.col("video_id").cast("bigint").alias("video_id")).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("sample_indices")), F.lit(0)).cast("bigint").alias("n_samples"))


class LengthReader:
    """A stand-in for a recogniser: the number of letters of a text, and an error for term lists."""

    def recognise(self, paths: list[str]) -> list[str]:
        if any(p.startswith("list:") for p in paths):
            raise ValueError("not for term lists")
        return ['{"n": %d}' % (len(p) - p.index(":") - 1) for p in paths]

    def release(self) -> None:
        pass


@query("""SELECT sha256(text) AS sha256, CASE WHEN min(doc_format) = 'list' THEN 'failed' ELSE 'ok' END AS status, CASE WHEN min(doc_format) <> 'list' THEN '{"n": ' || any_value(length(text)) || '}' END AS raw FROM documents WHERE text IS NOT NULL AND doc_format IS NOT NULL GROUP BY 1""")
def recognised_images(spark, d):
    """Texts in place of images, each once; those that fail are found by asking for fewer."""
    rows = table(spark, d, "documents").where(F.col("text").isNotNull() & F.col("doc_format").isNotNull()).select(F.sha2("text", 256).alias("sha256"), F.concat_ws(":", "doc_format", "text").alias("path"))
    return media.recognise_images(dedupe.representatives(rows, "sha256", "path").select("sha256", "path"), LengthReader)


@query(f"SELECT DISTINCT sha256(text) || ':{Settings().stage_hash('ocr')}' AS cache_key FROM documents WHERE text IS NOT NULL")
def image_keys(spark, d):
    digest = table(spark, d, "documents").where(F.col("text").isNotNull()).select(F.sha2("text", 256).alias("sha256"))
    return digest.select(keys.image_key(F.col("sha256"), Settings().stage_params("ocr")).alias("cache_key")).distinct()


@query(f"SELECT s.video_id, CAST(s.sample_index AS BIGINT) AS sample_index, o.status FROM (SELECT DISTINCT video_id, sample_index FROM ocr_results) s JOIN {COUNTED} o USING (video_id, sample_index)")
def results_of_samples(spark, d):
    grid = table(spark, d, "ocr_results").select("video_id", "sample_index").distinct()
    return grid.join(counted(spark, d, "status"), ["video_id", "sample_index"]).select("video_id", F.col("sample_index").cast("bigint").alias("sample_index"), "status")
