"""Table schemas and the keypoint layout."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T


@dataclass(frozen=True)
class KeypointLayout:
    """Named ranges (first, end) of keypoints in a frame."""

    groups: dict[str, tuple[int, int]] = field(default_factory=lambda: {"pose": (0, 25), "left_hand": (25, 46), "right_hand": (46, 67), "face": (67, 78)})

    @property
    def total(self) -> int:
        return max(end for _, end in self.groups.values())


LAYOUT = KeypointLayout()

#: ``dims_per_frame`` and ``keypoints_total`` are text because archives hold 156 as well as "156".
META = T.StructType(
    [
        T.StructField("video", T.StringType()),
        T.StructField("target_fps", T.IntegerType()),
        T.StructField("out_size", T.IntegerType()),
        T.StructField("dims_per_frame", T.StringType()),
        T.StructField("keypoints_total", T.StringType()),
        T.StructField("order", T.StringType()),
        T.StructField("conf_thresh", T.DoubleType()),
        T.StructField("interpolation_max_gap", T.IntegerType()),
        T.StructField("model_type", T.StringType()),
        T.StructField("occluded_flag", T.IntegerType()),
    ]
)
LABEL_REF = T.StructType([T.StructField("gloss_id", T.StringType()), T.StructField("label", T.StringType()), T.StructField("cat_id", T.StringType()), T.StructField("category", T.StringType())])
