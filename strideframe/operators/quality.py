"""Validation of clips: issue lists, readiness, compatibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.functions import arrays as A

#: Widths and keypoint order of a valid archive.
X_WIDTH, MASK_WIDTH, CNN_WIDTH = 156, 78, 2048
ORDER = "pose25,left_hand21,right_hand21,face11"
#: Types of a valid archive's arrays.
X_TYPE, MASK_TYPE, TIME_TYPE = "float32", "bool", "int64"


#: Issue texts below are fixed values: reports of other tools are compared with them.


def _issues(*pairs: tuple[Column, Column | str]) -> Column:
    listed = [F.when(F.coalesce(c, F.lit(False)), F.lit(m) if isinstance(m, str) else m) for c, m in pairs]
    return F.filter(F.array(*listed), lambda v: v.isNotNull())


def clip_facts(frames: DataFrame) -> DataFrame:
    """Figures of each clip that the rules below read: one shuffle by clip.

    A frame's own figures are made first, so that no array is sorted for the comparison of times.
    """
    order = Window.partitionBy("clip_id").orderBy("frame_idx")
    wild = lambda v: F.isnan(v) | (F.abs(v) == float("inf"))
    cnn = F.col("x2048") if "x2048" in frames.columns else F.lit(None).cast("array<float>")
    rows = frames.select(
        "clip_id",
        "frame_idx",
        "t_ms",
        F.size("x").alias("w"),
        F.size("mask").alias("m"),
        F.exists("x", wild).alias("wild"),
        F.exists("x", lambda v: ~F.isnan(v) & ((v < 0) | (v > 1))).alias("out"),
        F.exists("mask", lambda v: v).alias("seen"),
        F.size(cnn).alias("c"),
        F.exists(cnn, wild).alias("cnn_wild"),
        (F.col("x").isNull() | F.col("mask").isNull() | F.col("t_ms").isNull()).alias("ragged"),
    )
    rows = rows.withColumn("down", F.col("t_ms") < F.lag("t_ms").over(order))
    return rows.groupBy("clip_id").agg(
        F.count("*").alias("n"),
        F.bool_or(F.col("w") != X_WIDTH).alias("bad_x"),
        F.bool_or(F.col("m") != MASK_WIDTH).alias("bad_mask"),
        F.count("w").alias("x_n"),
        F.count("m").alias("mask_n"),
        F.max(F.when(F.col("w") != X_WIDTH, F.col("w"))).alias("x_w"),
        F.max(F.when(F.col("m") != MASK_WIDTH, F.col("m"))).alias("mask_w"),
        F.bool_or("ragged").alias("ragged"),
        F.bool_or("wild").alias("wild"),
        F.bool_or("out").alias("out"),
        F.bool_or("seen").alias("seen"),
        F.bool_or("down").alias("down"),
        F.bool_or(F.col("t_ms") < 0).alias("negative"),
        F.count(F.when(F.col("c") > 0, 1)).alias("cnn_n"),
        F.bool_or((F.col("c") > 0) & (F.col("c") != CNN_WIDTH)).alias("bad_cnn"),
        F.bool_or("cnn_wild").alias("cnn_wild"),
    )


def validate_clips(clips: DataFrame, frames: DataFrame, require_cnn: bool = False) -> DataFrame:
    """``clip_id`` and ``issues``, a list of texts that is empty for a good clip.

    Arrays of unlike length show as frames that lack ``x``, ``mask`` or ``t_ms``. ``clips`` may name
    the stored types in ``x_type``, ``mask_type`` and ``t_type``, as the archive reader does.
    """
    stored = {n: F.coalesce(F.col(n), F.lit(t)) if n in clips.columns else F.lit(t) for n, t in (("x_type", X_TYPE), ("mask_type", MASK_TYPE), ("t_type", TIME_TYPE))}
    df = clips.select("clip_id", "meta", *[c.alias(n) for n, c in stored.items()]).join(clip_facts(frames), "clip_id", "left").withColumn("m", A.parse_meta(F.col("meta")))
    m = F.col("m")

    def shape(of: str, width: int, kind: str) -> tuple[Column, Column]:
        text = F.format_string(f"{of} bad shape/dtype: (%d, %d) %s", F.col(f"{of.lower()}_n"), F.coalesce(F.col(f"{of.lower()}_w"), F.lit(width)), F.col(f"{of.lower()}_type"))
        return F.col("n").isNotNull() & (F.col(f"bad_{of.lower()}") | (F.col(f"{of.lower()}_type") != kind)), text

    issues = _issues(
        (m.isNull(), "meta is not valid JSON"),
        (F.col("n").isNull(), "empty sequence (T == 0)"),
        shape("X", X_WIDTH, X_TYPE),
        shape("mask", MASK_WIDTH, MASK_TYPE),
        (F.col("n").isNotNull() & (F.col("t_type") != TIME_TYPE), F.format_string("timestamps_ms bad shape/dtype: (%d,) %s", F.col("n"), F.col("t_type"))),
        (F.col("ragged"), "T mismatch among X/mask/timestamps_ms"),
        (F.col("wild"), "X has non-finite values"),
        (F.col("out"), "X outside [0,1]"),
        (F.col("down"), "timestamps_ms not monotonic nondecreasing"),
        (F.col("negative"), "timestamps_ms contains negative values"),
        (F.col("n").isNotNull() & ~F.coalesce("seen", F.lit(False)), "mask has no visible keypoints across all frames"),
        (m.isNotNull() & ~m["dims_per_frame"].eqNullSafe(str(X_WIDTH)), F.concat(F.lit("meta.dims_per_frame != 156 (got "), F.coalesce(m["dims_per_frame"], F.lit("None")), F.lit(")"))),
        (m.isNotNull() & ~m["keypoints_total"].eqNullSafe(str(MASK_WIDTH)), F.concat(F.lit("meta.keypoints_total != 78 (got "), F.coalesce(m["keypoints_total"], F.lit("None")), F.lit(")"))),
        (m.isNotNull() & ~m["order"].eqNullSafe(ORDER), F.concat(F.lit("meta.order unexpected: "), F.coalesce(m["order"], F.lit("None")))),
        (F.lit(require_cnn) & (F.coalesce("cnn_n", F.lit(0)) == 0), "missing key: X2048 (required)"),
        ((F.col("cnn_n") > 0) & (F.col("bad_cnn") | (F.col("cnn_n") != F.col("n"))), "X2048 bad shape/dtype"),
        (F.col("cnn_wild"), "X2048 has non-finite values"),
    )
    return df.select("clip_id", issues.alias("issues"))


def readiness(frames: DataFrame) -> DataFrame:
    """``transformer_ready`` and ``iv3_ready`` with their issue lists."""
    df = clip_facts(frames)
    first = _issues(
        (F.col("bad_x"), "X shape/dtype incorrect (expected [T,156] float32)"),
        (F.col("bad_mask"), "mask shape/dtype incorrect (expected [T,78] bool)"),
        (F.col("wild"), "non-finite values in X"),
        (F.col("out"), "X outside [0,1] range (expected normalized)"),
        (F.col("down"), "timestamps not monotonic"),
    )
    none = F.col("cnn_n") == 0
    second = _issues(
        (none, "X2048 missing (required for IV3-GRU)"),
        (F.col("bad_cnn"), "X2048 shape/dtype incorrect (expected [T,2048] float32)"),
        (~none & (F.col("cnn_n") != F.col("n")), F.concat(F.lit("X2048 temporal mismatch: X("), F.col("n").cast("string"), F.lit(") vs X2048("), F.col("cnn_n").cast("string"), F.lit(")"))),
        (F.col("cnn_wild"), "non-finite values in X2048"),
    )
    df = df.select("clip_id", first.alias("transformer_issues"), second.alias("iv3_issues"))
    return df.withColumns({"transformer_ready": F.size("transformer_issues") == 0, "iv3_ready": F.size("iv3_issues") == 0})


def data_checks(frames: DataFrame) -> DataFrame:
    """The four checks of a single clip view: widths of X, mask and X2048, monotonic times."""
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    return clip_facts(frames).select("clip_id", no("bad_x").alias("x_ok"), no("bad_mask").alias("mask_ok"), no("down").alias("monotonic"), ((F.col("cnn_n") > 0) & no("bad_cnn")).alias("x2048_ok"))


def audit_summary(audit: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` most frequent issues over both lists, by count, then text."""
    texts = audit.select(F.explode(F.concat("transformer_issues", "iv3_issues")).alias("issue"))
    return texts.groupBy("issue").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "issue").limit(n)


def audit_totals(audit: DataFrame) -> DataFrame:
    return audit.agg(F.count("*").alias("total"), F.count(F.when(F.col("transformer_ready"), 1)).alias("transformer_ready"), F.count(F.when(F.col("iv3_ready"), 1)).alias("iv3_ready"))


def model_compat(clips: DataFrame) -> DataFrame:
    """Which models a clip suits: by its meta's ``model_type``, or by widths where that is missing; an unknown type suits none."""
    kind = F.nullif(A.parse_meta(F.col("meta"))["model_type"], F.lit(""))
    t = F.when(kind.isNotNull(), kind.isin("T", "B")).otherwise(F.col("x_width") == X_WIDTH)
    i = F.when(kind.isNotNull(), kind.isin("I", "B")).otherwise(F.col("x2048_width") == CNN_WIDTH)
    out = clips.withColumns({"transformer": F.coalesce(t, F.lit(False)), "iv3_gru": F.coalesce(i, F.lit(False))})
    return out.withColumn("both", F.col("transformer") & F.col("iv3_gru"))


def occlusion_status(clips: DataFrame) -> DataFrame:
    """``occlusion_flag`` 0, 1 or -1 (missing or no JSON) and its text."""
    flag = F.coalesce(A.parse_meta(F.col("meta"))["occluded_flag"], F.lit(-1))
    return clips.withColumn("occlusion_flag", flag).withColumn("occlusion_text", F.when(flag == 0, "No").when(flag == 1, "Yes").otherwise("Unknown"))


def meta_summary(clips: DataFrame, n: int = 8) -> DataFrame:
    """``meta_ok`` and the first ``n`` keys of the meta JSON."""
    ok = A.parse_meta(F.col("meta")).isNotNull()
    return clips.withColumns({"meta_ok": ok, "meta_keys": F.when(ok, F.slice(F.json_object_keys("meta"), 1, n))})
