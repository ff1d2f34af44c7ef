"""Row numbers within groups that may be large, without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuelattice.session import cut_lineage


def numbered(rows: DataFrame, name: str, by: str, bucket: Column, order: list[str | Column]) -> DataFrame:
    """rows with their number from 1 within each value of by, by bucket and then order.

    The bucket must not fall along the order. Rows are sorted within buckets only, and numbers
    shifted by the counts of earlier buckets, of which a group has one row each. The rows are used
    for both, so they are computed once and written.
    """
    rows = cut_lineage(rows.withColumn("__bucket", bucket))
    counts = rows.groupBy(by, "__bucket").agg(F.count("*").alias("__n"))
    earlier = W.partitionBy(by).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    shifts = counts.select(F.col(by).alias("__by"), F.col("__bucket").alias("__b"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__shift"))
    inside = rows.withColumn("__at", F.row_number().over(W.partitionBy(by, "__bucket").orderBy(*order)))
    same = F.col(by).eqNullSafe(F.col("__by")) & F.col("__bucket").eqNullSafe(F.col("__b"))
    joined = inside.join(shifts, same)
    return joined.withColumn(name, (F.col("__at") + F.col("__shift")).cast("int")).drop("__bucket", "__at", "__by", "__b", "__shift")


def time_bucket(seconds: str, width: float = 600.0) -> Column:
    """Stretches of time; a null time comes before all others, as it does in an order."""
    return F.floor(F.col(seconds) / width)
