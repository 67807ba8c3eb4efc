"""Training runs and processing batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.functions import arrays as A


def best_epoch(epochs: DataFrame) -> DataFrame:
    """For each run the first epoch with its highest gloss accuracy."""
    return epochs.groupBy("run").agg(F.max(F.struct(F.col("val_gloss_acc"), (-F.col("epoch")).alias("e"))).alias("b")).select("run", (-F.col("b.e")).alias("best_epoch"), F.col("b.val_gloss_acc").alias("best_gloss_acc"))


def early_stop(epochs: DataFrame, patience: int) -> DataFrame:
    """Each epoch with ``improved`` (strictly above all before) and ``waited`` epochs since, and the run's ``stop_epoch`` (null if none)."""
    order = Window.partitionBy("run").orderBy("epoch")
    before = F.max("val_gloss_acc").over(order.rowsBetween(Window.unboundedPreceding, -1))
    df = epochs.withColumn("improved", before.isNull() | (F.col("val_gloss_acc") > before))
    last = F.max(F.when(F.col("improved"), F.col("epoch"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("waited", F.col("epoch") - last)
    return df.withColumn("stop_epoch", F.min(F.when(F.col("waited") >= patience, F.col("epoch"))).over(Window.partitionBy("run")))


def run_summary(results: DataFrame) -> DataFrame:
    """Successes, failures, total and mean seconds, videos an hour."""
    ok = F.col("status") == "success"
    seconds = F.sum(F.when(ok, F.col("seconds")))
    n = F.count(F.when(ok, 1))
    return results.agg(n.alias("successes"), F.count(F.when(~ok, 1)).alias("failures"), seconds.alias("total_s"), (seconds / n).alias("mean_s"), (n * 3600 / seconds).alias("videos_per_hour"))


def batch_summary(clips: DataFrame, preds: DataFrame) -> DataFrame:
    """Totals of a batch: files, predicted, from video, compatible by model, explicitly occluded (flag 1 only)."""
    rows = clips.join(preds.select("clip_id").distinct().withColumn("has", F.lit(True)), "clip_id", "left")
    count = lambda c: F.count(F.when(c, 1))
    return rows.agg(F.count("*").alias("files"), count(F.col("has")).alias("predicted"), count(F.col("from_video")).alias("from_video"), count(F.col("transformer")).alias("transformer"), count(F.col("iv3_gru")).alias("iv3_gru"), count(F.col("occlusion_flag") == 1).alias("occluded"))


def batch_files(clips: DataFrame, preds: DataFrame, ref: DataFrame) -> DataFrame:
    """One row for each file of a batch: source, frames, compatible models, best labels with their probability, occlusion, status.

    ``clips`` has ``clip_id``, ``n_frames``, ``from_video``, ``transformer``, ``iv3_gru``, ``occlusion_text``.
    """
    yes = lambda c: F.when(F.col(c), "Yes").otherwise("No")
    gloss = ref.groupBy("gloss_id").agg(F.max("label").alias("_gloss"))
    cats = ref.groupBy("cat_id").agg(F.max("category").alias("_cat"))
    best = preds.groupBy("clip_id").agg(F.max_by(F.struct("gloss_pred", "cat_pred", "gloss_prob", "cat_prob"), "gloss_prob").alias("p")).select("clip_id", "p.*")
    rows = clips.join(best, "clip_id", "left").join(gloss, F.col("gloss_pred") == F.col("gloss_id"), "left").join(cats, F.col("cat_pred") == F.col("cat_id"), "left")

    def top(name: str, pred: str, prob: str) -> Column:
        label = F.coalesce(F.col(name), F.format_string("Unknown (%d)", F.col(pred)))
        return F.when(F.col(pred).isNull(), "Prediction Failed").otherwise(F.format_string("%s (%.1f%%)", label, A.rounded(F.col(prob) * 100, 1)))

    return rows.select(
        F.col("clip_id").alias("file"),
        F.lit("NPZ").alias("type"),
        F.when(F.col("from_video"), "Video").otherwise("Original").alias("source"),
        F.col("n_frames").alias("frames"),
        yes("transformer").alias("transformer"),
        yes("iv3_gru").alias("iv3_gru"),
        top("_gloss", "gloss_pred", "gloss_prob").alias("top_gloss"),
        top("_cat", "cat_pred", "cat_prob").alias("top_category"),
        F.col("occlusion_text").alias("occluded"),
        F.when(F.col("gloss_pred").isNull(), "failed").otherwise("completed").alias("status"),
    )
