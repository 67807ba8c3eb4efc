"""Scans over long sequences in blocks: local passes, one summary a block, and a scan over summaries.

A window over a whole clip sorts it in one task. Here a clip is cut into blocks of ``BLOCK`` frame
numbers. Rows are sorted within their block only; each block leaves one associative summary (a
count, a minimum, its last value, its runs at both ends); a window over the summaries, one row a
block, gives what all earlier blocks hand on; and the rows of a block take that from a join on
(clip, block), by which they are dealt already.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Frame numbers of a block.
BLOCK = 4096


def in_blocks(df: DataFrame, order: str = "frame_idx", size: int | None = None) -> DataFrame:
    """Adds ``_block``: which ``size`` numbers of ``order`` the row lies in."""
    return df.withColumn("_block", F.floor(F.col(order) / (size or BLOCK)))


def own(by: list[str], order: str = "frame_idx") -> WindowSpec:
    """The rows of a block in order."""
    return Window.partitionBy(*by, "_block").orderBy(order)


def handed_on(rows: DataFrame, by: list[str], summary: dict[str, Column], carried: Callable[[WindowSpec, WindowSpec], dict[str, Column]]) -> DataFrame:
    """``rows`` with the columns that ``carried`` makes of the summaries of the earlier and of the later blocks of their key.

    A column of ``carried`` may use those before it.
    """
    blocks = rows.groupBy(*by, "_block").agg(*[c.alias(n) for n, c in summary.items()])
    over = Window.partitionBy(*by).orderBy("_block")
    made = carried(over.rowsBetween(Window.unboundedPreceding, -1), over.rowsBetween(1, Window.unboundedFollowing))
    for name, column in made.items():
        blocks = blocks.withColumn(name, column)
    return rows.join(blocks.select(*by, "_block", *made), [*by, "_block"])


def numbered(df: DataFrame, by: list[str], order: str = "frame_idx", size: int | None = None) -> DataFrame:
    """Adds ``_i``, the place of the row among those of its key from 0 on, and ``_all``, how many the key has."""
    rows = in_blocks(df, order, size)
    rows = rows.withColumn("_i", F.row_number().over(own(by, order)) - 1)
    counts = lambda before, after: {"_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_after": F.coalesce(F.sum("_n").over(after), F.lit(0)), "_own": F.col("_n")}
    rows = handed_on(rows, by, {"_n": F.count("*")}, counts)
    return rows.withColumns({"_i": F.col("_i") + F.col("_before"), "_all": F.col("_before") + F.col("_own") + F.col("_after")}).drop("_before", "_own", "_after", "_block")


def with_neighbours(df: DataFrame, before: int, after: int, size: int | None = None) -> DataFrame:
    """Rows of ``numbered`` in blocks of places, each with copies (``_copy``) of so many rows around it.

    A window of that reach over a block then sees what a window over the whole key sees; drop the copies after it.
    """
    size = max(size or BLOCK, before, after, 1)
    at, block = F.col("_i") % size, F.floor(F.col("_i") / size)
    # A row among the last of its block stands before the next one, one among the first after the one before.
    copies = F.array_compact(F.array(F.lit(0), F.when(at >= size - before, 1), F.when((at < after) & (block > 0), -1)))
    return df.withColumn("_shift", F.explode(copies)).withColumns({"_block": block + F.col("_shift"), "_copy": F.col("_shift") != 0}).drop("_shift")
