"""Dense numbers over any order, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.sources.staged import staged

#: The place within a partition takes the low bits of Spark's row ids.
PLACE_BITS = 33


def dense_number(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds ``name``: the place of each row, from 1 on, in ``order``. Rows equal in it stand in any order, next to each other.

    Rows are exchanged once by ranges of the order and sorted within them, and written with the
    partition and the place there (so that no task can see another deal); the rows of earlier
    partitions, one count each, are added. Equal rows of the order don't fill one range: a hash of
    the whole row and a row id part them.
    """
    keyed = df.withColumns({"_whole": F.xxhash64(*df.columns), "_row": F.monotonically_increasing_id()})
    by = [*order, F.col("_whole"), F.col("_row")]
    dealt = keyed.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    rows = staged(dealt.drop("_whole", "_row"), "numbered")
    part = F.shiftright("_at", PLACE_BITS)
    counts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # One row a partition of the exchange: their number is a setting, not a matter of the data.
    earlier = Window.partitionBy().orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    out = rows.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    place = F.col("_before") + F.col("_at").bitwiseAND((1 << PLACE_BITS) - 1) + 1
    return out.select(*df.columns, place.alias(name))
