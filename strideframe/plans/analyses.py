"""From raw frames to occlusion flags; from predictions to a report; from labels to a split."""

from __future__ import annotations

from pyspark.sql import DataFrame

from strideframe.operators import evaluation as E
from strideframe.operators import labels as L
from strideframe.operators import occlusion as O
from strideframe.operators import quality as Q
from strideframe.operators import sequence as S


def prepare(frames: DataFrame, fps: int, max_gap: int = 5) -> DataFrame:
    """Sampled frames with short gaps filled and values in [0, 1]."""
    points = S.interpolate_gaps(S.to_keypoints(S.downsample(frames, fps)), max_gap, clamp=True)
    return S.from_keypoints(points)


def flag_occlusion(frames: DataFrame, fps: int) -> DataFrame:
    return O.occlusion(prepare(frames, fps))


def evaluate(preds: DataFrame, ref: DataFrame) -> DataFrame:
    """The class report of the gloss head with names, balance and tiers."""
    report = E.class_tiers(E.classification_report(preds))
    return L.lookup_labels(report, ref, "cls", "gloss_id", "label", "label")


def split_labels(labels: DataFrame, clips: DataFrame, ref: DataFrame, ratio: float = 0.8, seed: int = 42) -> DataFrame:
    """Labels with ids by name, whose clips exist, split by class."""
    known = L.match_files(L.assign_ids(labels, ref), clips).filter("gloss IS NOT NULL")
    return L.stratified_split(known, ratio, seed)


def audit(frames: DataFrame) -> DataFrame:
    """Audit figures of each clip with its readiness for both models."""
    return S.sanity(frames).join(Q.readiness(frames), "clip_id")
