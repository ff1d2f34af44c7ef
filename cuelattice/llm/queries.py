"""Queries of the training-data operators, by problem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelattice.llm.langid import label_code, language_segments
from cuelattice.llm.langmodel import fitted
from cuelattice.llm.leakage import leaked_items
from cuelattice.llm.mixing import copies, shares
from cuelattice.llm.neardup import near_duplicate_classes, near_duplicates
from cuelattice.llm.pairs import WordBook, cache_pairs, cue_pairs, defective_pairs
from cuelattice.llm.plainform import plain_form
from cuelattice.llm.runs import text_runs
from cuelattice.llm.truncation import FDR, LIFT, NEIGHBOURS, cut_rates, length_hazards, text_endings, truncated
from cuelattice.operators.samples import block_key, counting_blocks
from cuelattice.session import spread, table


def block_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = counting_blocks(table(spark, sf_dir, "ocr_results"), "source_text")
    return blocks.select(block_key(F.col("video_id"), F.col("block_id")).alias("rec_key"), F.col("source_text").alias("text"))


def cue_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = table(spark, sf_dir, "cues").select("cue_id", F.posexplode("source_lines").alias("at", "text"))
    return cues.select(F.concat(F.lit("c:"), F.col("cue_id").cast("string"), F.lit(":"), (F.col("at") + 1).cast("string")).alias("rec_key"), "text")


def p1_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text that the plain form changes, with both forms."""
    texts = block_texts(spark, sf_dir).unionByName(cue_lines(spark, sf_dir)).where(F.col("text").isNotNull())
    # filtered after the operator: the optimiser would otherwise run it twice, for the filter and for the column
    plain = texts.withColumn("both", F.struct("text", plain_form(F.col("text")).alias("plain")))
    return plain.where(F.col("both.text") != F.col("both.plain")).select("rec_key", "both.text", "both.plain").distinct()


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_plain(spark, sf_dir).select("rec_key").distinct()


def p2_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_runs(table(spark, sf_dir, "ocr_results"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = p2_runs(spark, sf_dir).where(F.col("n_obs") >= 2)
    return runs.select("video_id", "region", "first_sample", "last_sample", "n_obs", "duration_ms")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    models, words = fitted(table(spark, sf_dir, "documents"), WordBook.words, endings=True, calibrated=False)  # only the segments of problem 4 ask for confidences
    cues = cue_pairs(spread(table(spark, sf_dir, "cues").select("cue_id", "video_id", "source_lines", "translated_lines")), table(spark, sf_dir, "videos"))
    pairs = cues.unionByName(cache_pairs(spread(table(spark, sf_dir, "llm_cache").select("cache_key", "request", "response"))))
    return defective_pairs(pairs, models, WordBook.counted(words)).distinct()


def block_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of every block that has enough letters: video_id, block_id, label and those of language_segments."""
    models, _ = fitted(table(spark, sf_dir, "documents"))
    blocks = counting_blocks(table(spark, sf_dir, "ocr_results"), "source_text", "language")
    texts = blocks.select("video_id", "block_id", label_code(F.col("language")).alias("label"), F.col("source_text").alias("text"))
    return language_segments(texts, models)


def p4_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_segments(spark, sf_dir).select("video_id", "block_id", "label", "seg_no", "lang", "confidence", "n_segments")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = block_segments(spark, sf_dir).where((F.col("n_segments") > 1) | (F.col("label") != F.col("lang")))
    return found.select("video_id", "block_id", "seg_no", "lang")


def long_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks = table(spark, sf_dir, "tracks").select(F.concat(F.lit("t:"), F.col("track_id").cast("string")).alias("rec_key"), F.col("source_text").alias("text"))
    return block_texts(spark, sf_dir).unionByName(tracks)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(long_records(spark, sf_dir))


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(long_records(spark, sf_dir))


def p6_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of letters in common, and paraphrases."""
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), paraphrases=False).select("doc_id", "item_id").distinct()


def p7_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncated(table(spark, sf_dir, "documents")).select("doc_id")


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_rates(table(spark, sf_dir, "documents"))


def p8_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths at which a source's texts end more often than at the lengths beside them."""
    hazards = length_hazards(text_endings(table(spark, sf_dir, "documents")))
    millionths = lambda c: F.rint(F.col(c) * 1_000_000).cast("bigint").alias(f"{c}_millionths")
    return hazards.where("significant").select("source", "measure", F.col("length").cast("bigint").alias("length"), "n", "at_risk", millionths("hazard"), millionths("neighbours"))


#: Hazards, Poisson tails and the false-discovery step of p8_limits.
LIMITS = """WITH m AS (SELECT source, 'chars' AS measure, length(text) AS length FROM documents WHERE text IS NOT NULL UNION ALL SELECT source, 'bytes', strlen(text) FROM documents WHERE text IS NOT NULL),
  c AS (SELECT source, measure, CAST(length AS BIGINT) AS length, count(*) AS n FROM m WHERE length > 0 GROUP BY ALL),
  r AS (SELECT *, CAST(sum(n) OVER (PARTITION BY source, measure ORDER BY length DESC) AS BIGINT) AS at_risk FROM c),
  h AS (SELECT *, n / at_risk AS hazard, (sum(n) OVER w - n + 0.5) / {0} / avg(at_risk) OVER w AS neighbours FROM r WINDOW w AS (PARTITION BY source, measure ORDER BY length RANGE BETWEEN {1} PRECEDING AND {1} FOLLOWING)),
  e AS (SELECT *, greatest(neighbours * at_risk, 1e-3) AS mean FROM h),
  p AS (SELECT *, CASE WHEN n <= mean THEN 1.0 ELSE least(1.0, list_sum(list_transform(range(n, n + 1000), lambda i: exp(i * ln(mean) - mean - lgamma(i + 1))))) END AS p FROM e),
  k AS (SELECT *, row_number() OVER (PARTITION BY source, measure ORDER BY p, length) AS r, count(*) OVER (PARTITION BY source, measure) AS m FROM p),
  f AS (SELECT *, max(CASE WHEN p <= r * {2} / m THEN r END) OVER (PARTITION BY source, measure) AS passed FROM k)
  SELECT source, measure, length, CAST(n AS BIGINT) AS n, at_risk, CAST(round_even(hazard * 1000000, 0) AS BIGINT) AS hazard_millionths, CAST(round_even(neighbours * 1000000, 0) AS BIGINT) AS neighbours_millionths
  FROM f WHERE r <= passed AND n > 2 AND hazard >= {3} * neighbours""".format(2 * NEIGHBOURS, NEIGHBOURS, FDR, LIFT)

QUERIES = {f.__name__: f for f in (p1_found, p1_plain, p2_found, p2_runs, p3_found, p4_found, p4_segments, p5_found, p5_classes, p6_found, p6_leaks, p7_copies, p7_shares, p8_found, p8_rates, p8_limits)}
ORACLES: dict[str, str] = {"p8_limits": LIMITS}
