"""Events shown in the same window of time composed to one cue with ordered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def round3(x: Column) -> Column:
    """Three decimals, a tie of the exact binary value to the even one.

    The product with 1000 is rounded itself, so where it is a tie its error tells on which side the
    value lies; splitting the value into two halves gives that error exactly.
    """
    product = x * 1000
    split = x * 134217729.0
    high = split - (split - x)
    error = (high * 1000 - product) + (x - high) * 1000
    below = F.floor(product)
    tie = product - below == 0.5
    whole = F.when(tie & (error > 0), below + 1).when(tie & (error < 0), below).otherwise(F.rint(product))
    return whole.cast("double") / 1000


def geometric_order(mode: str, x0: Column, y0: Column) -> list[Column]:
    """Sort keys of a line by its box: ltr and auto down then right, rtl down then left, ttb left then down."""
    if mode == "rtl":
        return [round3(y0), -x0]
    if mode == "ttb":
        return [round3(-x0), y0]
    return [round3(y0), x0]


def compose_cues(events: DataFrame, order: str = "auto", tie: list[str] | None = None) -> DataFrame:
    """events: video_id, start_s, end_s, source_text, bbox (array or struct), reading_order -> a row a cue.

    Lines go by reading_order where all of a cue's lines have one, else by geometry; ties by the
    tie columns, then text.
    """
    struct = events.schema["bbox"].dataType.typeName() == "struct"
    x0, y0 = (F.col("bbox.x0"), F.col("bbox.y0")) if struct else (F.get("bbox", F.lit(0)), F.get("bbox", F.lit(1)))
    box = F.array("bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1") if struct else F.col("bbox")
    first, second = geometric_order(order, x0, y0)
    line = F.struct(
        F.col("reading_order").alias("ro"), first.alias("k1"), second.alias("k2"), F.struct(*(tie or [])).alias("tie") if tie else F.lit(0).alias("tie"),
        F.col("source_text").alias("text"), box.alias("box"),
    )
    grouped = events.groupBy("video_id", round3(F.col("start_s")).alias("start_s"), round3(F.col("end_s")).alias("end_s")).agg(
        F.collect_list(line).alias("lines"), F.every(F.col("reading_order").isNotNull()).alias("ordered")
    )
    by_number = F.array_sort(F.transform("lines", lambda x: F.struct(x["ro"].cast("double").alias("a"), F.lit(0.0).alias("b"), x["tie"].alias("t"), x["text"].alias("text"), x["box"].alias("box"))))
    by_place = F.array_sort(F.transform("lines", lambda x: F.struct(x["k1"].alias("a"), x["k2"].alias("b"), x["tie"].alias("t"), x["text"].alias("text"), x["box"].alias("box"))))
    lines = F.when(F.col("ordered"), by_number).otherwise(by_place)
    made = grouped.select("video_id", "start_s", "end_s", lines.alias("lines"))
    return made.select("video_id", "start_s", "end_s", F.col("lines.text").alias("source_texts"), F.col("lines.box").alias("bboxes"))
