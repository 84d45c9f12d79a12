"""Dense ids without one global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Hash digits that pick a bucket: at most 16 ** 4 = 65,536 buckets of even size.
BUCKET_DIGITS = 4
# The same inside each of several lots, which are small: at most 256 buckets a lot.
LOT_DIGITS = 2


def assign_ids(
    df: DataFrame, start: int | Column = 1, key: str = "hash", id_column: str = "image_id", lot: str | None = None
) -> DataFrame:
    """Number the rows start, start + 1, ... in the order of a unique hexadecimal hash; with a column ``lot``, of
    numbers from 0, in the order of lots and of the hashes inside each.

    Rows are ranked inside buckets of equal hash prefix, and each bucket starts where the ones
    before it end. Bucket and order depend on the data alone, so a task that is run again gives
    the same ids, whatever the partitions are. The table of bucket starts is bounded by the
    number of prefixes, so it may be summed in one task and broadcast.

    The input is read twice. Buckets are shuffled by range, so each partition of the result, and
    each file written from it, holds one range of hashes and of ids.
    """
    bucket = F.substring(key, 1, BUCKET_DIGITS)
    if lot is not None:
        bucket = F.concat(F.lpad(F.col(lot).cast("string"), 10, "0"), F.substring(key, 1, LOT_DIGITS))
    bucketed = df.withColumn("_bucket", bucket)
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        bucketed.groupBy("_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    first = start if isinstance(start, Column) else F.lit(start)
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy(key))
    return (
        bucketed.repartitionByRange("_bucket")
        .withColumn("_rank", rank)
        .join(F.broadcast(starts), "_bucket")
        .withColumn(id_column, (first + F.col("_before") + F.col("_rank") - 1).cast("bigint"))
        .drop("_bucket", "_rank", "_before")
    )
