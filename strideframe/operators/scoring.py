"""Distributed scoring of clips with a user's model, and a two-head classifier on pooled features."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.functions import arrays as A

PREDS = "clip_id long, gloss_pred int, cat_pred int, gloss_prob double, cat_prob double, gloss_top array<struct<id:int,prob:double>>, cat_top array<struct<id:int,prob:double>>"


#: Frames of a batch of clips at most, padding included.
FRAMES_A_BATCH = 4096


def pack_sequences(frames: DataFrame, most: int = 300) -> DataFrame:
    """One row for each clip: the first ``most`` frames in order and their number."""
    # Later frames are never used by models, so a clip's list is bounded by `most`.
    seq = frames.filter(F.col("frame_idx") < most).groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("frame_idx", "x"))).alias("s"))
    return seq.select("clip_id", F.transform("s", lambda f: f["x"]).alias("sequence"), F.size("s").alias("length"))


def batches_of(lengths: list[int], batch: int, budget: int) -> Iterator[tuple[int, int]]:
    """Where batches of clips of rising length begin and end; a longer clip than ``budget`` is a batch of its own."""
    at = 0
    for to, length in enumerate(lengths):
        if to > at and (to - at == batch or (to - at + 1) * length > budget):
            yield at, to
            at = to
    if len(lengths) > at:
        yield at, len(lengths)


def score_clips(frames: DataFrame, make_model: Callable[[], Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]], batch: int = 32, most: int = 300, budget: int = FRAMES_A_BATCH) -> DataFrame:
    """Predictions of both heads.

    A task takes its clips by length, so that a batch is padded little: it ends at ``batch`` clips,
    or where its clips, padded to the longest, would have more than ``budget`` frames.

    ``make_model`` runs once in each task and returns a function of (padded batch [n, T, d],
    lengths [n]) to gloss and category probabilities.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()

        def best(row: np.ndarray, k: int) -> list[dict]:
            order = np.lexsort((np.arange(len(row)), -row))[:k]
            return [{"id": int(i), "prob": float(row[i])} for i in order]

        for part in parts:
            for at, to in batches_of(part["length"].tolist(), batch, budget):
                some = part.iloc[at:to]
                lengths = some["length"].to_numpy()
                rows = [np.stack([np.asarray(f, np.float64) for f in s]) for s in some["sequence"]]
                padded = np.zeros((len(rows), lengths.max(), rows[0].shape[1]))
                for i, r in enumerate(rows):
                    padded[i, : len(r)] = r
                gloss, cat = model(padded, lengths)
                tops = [(best(g, 5), best(c, 3)) for g, c in zip(gloss, cat, strict=True)]
                yield pd.DataFrame(
                    {
                        "clip_id": some["clip_id"].to_numpy(),
                        "gloss_pred": [g[0]["id"] for g, _ in tops],
                        "cat_pred": [c[0]["id"] for _, c in tops],
                        "gloss_prob": [g[0]["prob"] for g, _ in tops],
                        "cat_prob": [c[0]["prob"] for _, c in tops],
                        "gloss_top": [g for g, _ in tops],
                        "cat_top": [c for _, c in tops],
                    }
                )

    return pack_sequences(frames, most).sortWithinPartitions("length").mapInPandas(run, PREDS)


def fit_clip_classifier(pooled: DataFrame, labels: DataFrame, heads: tuple[str, ...] = ("gloss", "cat"), max_iter: int = 50) -> dict:
    """One multinomial logistic model for each head on pooled vectors: {head: fitted model}."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    data = pooled.join(labels, "clip_id").withColumn("features", array_to_vector(A.double(F.col("pooled"))))
    return {h: LogisticRegression(featuresCol="features", labelCol=h, family="multinomial", maxIter=max_iter, regParam=0.01).fit(data) for h in heads}


def predict_clips(models: dict, pooled: DataFrame) -> DataFrame:
    """``clip_id`` with the prediction of each head."""
    from pyspark.ml.functions import array_to_vector

    df = pooled.withColumn("features", array_to_vector(A.double(F.col("pooled"))))
    for head, model in models.items():
        model = model.copy().setPredictionCol(f"{head}_pred").setProbabilityCol(f"{head}_p").setRawPredictionCol(f"{head}_r")
        df = model.transform(df).withColumn(f"{head}_pred", F.col(f"{head}_pred").cast("int")).drop(f"{head}_p", f"{head}_r")
    return df.drop("features", "pooled")
