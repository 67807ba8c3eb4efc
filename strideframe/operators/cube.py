"""One mergeable count of predictions from which all reports are made.

A cube has a row for each head, model, occlusion flag and pair of true and predicted class that
occurs, with ``n``. Predictions are read once; cubes of parts of the data add up; a table keeps one
cube a day, and adding a day again replaces it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADS = ("gloss", "cat")
DIMENSIONS = ("model", "occluded")
COLUMNS = ("head", *DIMENSIONS, "y", "yhat")


def confusion_cube(preds: DataFrame) -> DataFrame:
    """``head``, ``model``, ``occluded``, ``y``, ``yhat`` and ``n``, counted in one pass for both heads."""
    sides = [F.struct(F.lit(h).alias("head"), F.col(f"{h}_gt").cast("int").alias("y"), F.col(f"{h}_pred").cast("int").alias("yhat")) for h in HEADS]
    rows = preds.select(*DIMENSIONS, F.explode(F.array(*sides)).alias("s")).select("s.head", *DIMENSIONS, "s.y", "s.yhat")
    return rows.groupBy(*COLUMNS).agg(F.count("*").alias("n"))


def merge_cubes(*cubes: DataFrame) -> DataFrame:
    """The cube of all rows from cubes of parts of them."""
    every = cubes[0].select(*COLUMNS, "n")
    for cube in cubes[1:]:
        every = every.unionByName(cube.select(*COLUMNS, "n"))
    return every.groupBy(*COLUMNS).agg(F.sum("n").alias("n"))


def add_to_cube(preds: DataFrame, path: str, day: str) -> None:
    """Count the predictions of ``day`` into the table at ``path``; what it held of that day is replaced."""
    rows = confusion_cube(preds).withColumn("day", F.lit(day))
    # Few rows: classes squared.
    rows.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def read_cube(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """The cube of the days from ``first`` to ``last``; other days are not read."""
    rows = spark.read.schema("head string, model string, occluded int, y int, yhat int, n long, day string").parquet(path)
    for bound, keep in ((first, lambda d: d >= first), (last, lambda d: d <= last)):
        rows = rows.filter(keep(F.col("day"))) if bound else rows
    return merge_cubes(rows)


def of_head(cube: DataFrame, head: str, *by: str) -> DataFrame:
    """The counts of pairs of one head, as ``confusion`` makes them, for each value of ``by``."""
    return cube.filter(F.col("head") == head).groupBy(*by, "y", "yhat").agg(F.sum("n").alias("n"))


def model_accuracies(cube: DataFrame) -> DataFrame:
    """For each model its rows and the accuracy of both heads."""
    right = lambda h: F.sum(F.when((F.col("head") == h) & (F.col("y") == F.col("yhat")), F.col("n")).otherwise(0))
    rows = lambda h: F.sum(F.when(F.col("head") == h, F.col("n")).otherwise(0))
    return cube.groupBy("model").agg(rows("gloss").alias("n"), *[(right(h) / rows(h)).alias(f"{h}_accuracy") for h in HEADS])
