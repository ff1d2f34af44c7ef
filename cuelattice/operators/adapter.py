"""Vendor recognition results brought to blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelattice.functions.geometry import unit_box
from cuelattice.functions.text import is_meaningful
from cuelattice.schemas import BOX

ITEM = (
    "array<struct<block_content:string,content:string,block_bbox:array<double>,bbox:array<double>,confidence:double,score:double,"
    "block_order:int,order:int,reading_order:int,block_label:string,label:string,language:string,lang:string>>"
)
#: Each field of a block and its names in vendor results, the first one that is there counts.
ALIASES = {
    "content": ("block_content", "content"), "bbox": ("block_bbox", "bbox"), "confidence": ("confidence", "score"),
    "reading_order": ("block_order", "order", "reading_order"), "label": ("block_label", "label"), "language": ("language", "lang"),
}


def parsing_list(raw: Column) -> Column:
    """The list of items of a raw JSON result, wrapped in res or not; null where there is none."""
    text = F.coalesce(F.get_json_object(raw, "$.res.parsing_res_list"), F.get_json_object(raw, "$.parsing_res_list"))
    return F.from_json(text, ITEM)


def first_of(item: Column, field: str) -> Column:
    return F.coalesce(*[item[name] for name in ALIASES[field]])


def parse_blocks(results: DataFrame, confidence: float | None = None, strict: bool = False) -> DataFrame:
    """results: video_id, sample_index, width, height, raw -> a row a block, block_no in the vendor's order from 1.

    Items without a letter or number, with fewer than four corners, or below the confidence (where
    both are known) are left out. A missing or zero size gives null boxes, or an error if strict.
    """
    items = results.select("video_id", "sample_index", "width", "height", F.posexplode(parsing_list(F.col("raw"))).alias("at", "item"))
    item = F.col("item")
    text = F.trim(F.coalesce(first_of(item, "content"), F.lit("")))
    box = first_of(item, "bbox")
    fields = items.select(
        "video_id", "sample_index", (F.col("at") + 1).alias("block_no"), text.alias("source_text"), box.alias("px"), "width", "height",
        first_of(item, "confidence").alias("confidence"), first_of(item, "reading_order").alias("reading_order"),
        first_of(item, "label").alias("label"), first_of(item, "language").alias("language"),
    )
    kept = fields.where(is_meaningful(F.col("source_text")) & F.coalesce(F.size("px") >= 4, F.lit(False)))
    if confidence is not None:
        kept = kept.where(F.col("confidence").isNull() | (F.col("confidence") >= confidence))
    corner = [F.get("px", F.lit(k)) for k in range(4)]
    bbox = unit_box(*corner, F.col("width"), F.col("height"))
    if strict:
        sized = F.coalesce((F.col("width") > 0) & (F.col("height") > 0), F.lit(False))
        bbox = F.when(sized, bbox).otherwise(F.raise_error(F.lit("a picture without a size")).cast(BOX))
    return kept.select("video_id", "sample_index", "block_no", bbox.alias("bbox"), "source_text", "label", "reading_order", "confidence", "language")


def renumber_blocks(blocks: Column, sample_index: Column) -> Column:
    """Block ids '<sample>-<n>', n from 1 in the order of the array."""
    return F.transform(blocks, lambda b, i: b.withField("id", F.concat(sample_index.cast("string"), F.lit("-"), (i + 1).cast("string"))))
