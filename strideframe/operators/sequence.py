"""Cleaning, measuring and reshaping of frame sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.functions import arrays as A
from strideframe.operators.quantiles import percentiles
from strideframe.operators.scans import handed_on, in_blocks, own
from strideframe.operators.vectors import array_stats

#: Keypoint pairs whose distance should stay stable.
BONES = ((5, 7), (7, 9), (6, 8), (8, 10), (11, 13), (13, 15), (12, 14), (14, 16), (5, 6), (5, 11), (6, 12), (11, 12))
LOW_VISIBLE = 10
SPIKE_SIGMA = 3.0
#: A step is a spike only if it is longer than its limit by more than rounding.
SPIKE_SLACK = 1e-9
BONE_Z = 3.5


def to_keypoints(frames: DataFrame) -> DataFrame:
    """Long form of flat frames: one row for each keypoint with ``kp``, ``x``, ``y``, ``visible``."""
    pairs = F.transform(F.col("mask"), lambda m, i: F.struct(F.col("x")[2 * i].alias("x"), F.col("x")[2 * i + 1].alias("y"), m.alias("visible")))
    rest = [c for c in frames.columns if c not in ("x", "mask")]
    return frames.select(*rest, F.posexplode(pairs).alias("kp", "one_point")).select(*rest, "kp", "one_point.*")


def from_keypoints(keypoints: DataFrame, dealt: bool = False) -> DataFrame:
    """Flat frames from the long form; a frame has a bounded number of keypoints.

    Frames come dealt by clip, which all that follows asks for. Where the points are so already
    (``dealt``), nothing is exchanged. Sorting and flattening need no lambda, which Spark doesn't compile.
    """
    points = F.sort_array(F.collect_list(F.struct("kp", F.array("x", "y").alias("xy"), "visible")))
    frames = keypoints.groupBy("clip_id", "frame_idx").agg(F.first("t_ms").alias("t_ms"), points.alias("p"))
    frames = A.once(frames, x=F.flatten("p.xy"), mask=F.col("p.visible")).select("clip_id", "frame_idx", "t_ms", "x", "mask")
    return frames if dealt else frames.repartition("clip_id")


def pad_batch(df: DataFrame, group: str, col: str) -> DataFrame:
    """``col`` padded to the longest of its ``group``, and ``length``."""
    most = df.groupBy(group).agg(F.max(F.size(col)).alias("most"))
    return df.join(most, group).withColumn("length", F.size(col)).withColumn(col, A.pad_or_trim(F.col(col), F.col("most"))).drop("most")


def downsample(frames: DataFrame, fps: int) -> DataFrame:
    """Frames whose time reaches the next multiple of 1/``fps``, counting only frames that were kept.

    How many are kept up to a frame is its place plus the least slack so far, a running minimum: a
    block hands on its rows and its least slack, so no task sorts a whole clip.
    """
    order = own(["clip_id"])
    step = F.floor(F.col("t_ms") * fps / 1000) + 1
    rows = in_blocks(frames).withColumns({"_i": F.row_number().over(order), "_c": step})
    rows = rows.withColumn("_low", F.min(F.col("_c") - F.col("_i")).over(order.rowsBetween(Window.unboundedPreceding, 0)))

    # A block's slack counts its places from 1 on; before it come the rows of earlier blocks.
    rows = handed_on(rows, ["clip_id"], {"_n": F.count("*"), "_least": F.min(F.col("_c") - F.col("_i"))}, lambda before, _: {
        "_before": F.coalesce(F.sum("_n").over(before), F.lit(0)),
        "_past": F.min(F.col("_least") - F.col("_before")).over(before),
    })
    kept = lambda i, low: i + F.least(F.lit(0), F.col("_past"), low)
    rows = rows.withColumn("_k", kept(F.col("_before") + F.col("_i"), F.col("_low") - F.col("_before")))
    first = kept(F.col("_before"), F.lit(None).cast("long"))
    return rows.withColumn("_b", F.coalesce(F.lag("_k").over(order), first)).filter("_k > _b").select(*frames.columns)


def interpolate_gaps(keypoints: DataFrame, max_gap: int = 5, clamp: bool = False) -> DataFrame:
    """Linear fill of inner gaps of 1 to ``max_gap`` invisible frames; filled points become visible."""
    order = Window.partitionBy("clip_id", "kp").orderBy("frame_idx")
    seen = F.when(F.col("visible"), F.struct(F.col("frame_idx").alias("i"), "x", "y"))
    before = F.last(seen, True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(seen, True).over(order.rowsBetween(1, Window.unboundedFollowing))
    df = keypoints.withColumn("_p", before).withColumn("_n", after)
    gap = F.col("_n.i") - F.col("_p.i") - 1
    fill = F.coalesce(~F.col("visible") & gap.between(1, max_gap), F.lit(False))
    part = (F.col("frame_idx") - F.col("_p.i")) / (F.col("_n.i") - F.col("_p.i"))

    def value(c: str) -> Column:
        v = F.when(fill, F.col(f"_p.{c}") + (F.col(f"_n.{c}") - F.col(f"_p.{c}")) * part).otherwise(F.col(c))
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), v)) if clamp else v

    return df.withColumns({"x": value("x"), "y": value("y"), "visible": F.col("visible") | fill}).drop("_p", "_n")


def steps(keypoints: DataFrame) -> DataFrame:
    """``v``: the length of each point's step from its frame before, null for the first one and where it is not a number."""
    key, point = ["clip_id", "kp"], F.struct("x", "y")
    rows = handed_on(in_blocks(keypoints), key, {"_last": F.max_by(point, "frame_idx")}, lambda before, _: {"_past": F.last("_last").over(before)})
    was = F.coalesce(F.lag(point).over(own(key)), F.col("_past"))
    rows = rows.withColumn("_was", was)
    step = F.sqrt((F.col("x") - F.col("_was.x")) ** 2 + (F.col("y") - F.col("_was.y")) ** 2)
    return rows.withColumn("v", A.nan_to_null(step)).select(*keypoints.columns, "v")


def velocity(keypoints: DataFrame, sigma: float = SPIKE_SIGMA) -> DataFrame:
    """For each clip the 95th percentile and maximum of step lengths, and frames whose largest step is a spike."""
    made = steps(keypoints).select("clip_id", "frame_idx", "v")
    # A clip's steps spread over its frames: a frame's list is bounded by its keypoints.
    frames = made.groupBy("clip_id", "frame_idx").agg(F.max("v").alias("top"))
    middle = percentiles(frames, ["clip_id"], "top", {"middle": 0.5}, F.stddev_pop("top").alias("spread"), counted=keypoints)
    spread = middle.select("clip_id", (F.col("middle") + sigma * F.col("spread")).alias("limit"))
    spikes = frames.join(spread, "clip_id").groupBy("clip_id").agg(F.count(F.when(F.col("top") > F.col("limit") + SPIKE_SLACK, 1)).alias("vel_spike_frames"))
    whole = percentiles(made, ["clip_id"], "v", {"vel_p95": 0.95}, F.coalesce(F.max("v"), F.lit(0.0)).alias("vel_max"), counted=keypoints)
    return whole.withColumn("vel_p95", F.coalesce("vel_p95", F.lit(0.0))).join(spikes, "clip_id")


def bone_stability(frames: DataFrame, bones=BONES, limit: float = BONE_Z) -> DataFrame:
    """Variation of bone lengths in percent, and frames with an outlying bone."""
    x = F.col("x")
    size = lambda a, b: F.sqrt((x[2 * a] - x[2 * b]) ** 2 + (x[2 * a + 1] - x[2 * b + 1]) ** 2)
    long = frames.select("clip_id", "frame_idx", F.posexplode(F.array(*[size(a, b) for a, b in bones])).alias("bone", "v")).withColumn("v", A.nan_to_null(F.col("v")))
    whole = long.groupBy("clip_id").agg((F.stddev_pop("v") / (F.avg("v") + 1e-9) * 100).alias("bone_len_cv_pct"))
    each = long.groupBy("clip_id", "bone").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    odd = long.join(each, ["clip_id", "bone"]).filter(F.abs((F.col("v") - F.col("m")) / (F.col("s") + 1e-9)) > limit)
    odd = odd.groupBy("clip_id").agg(F.countDistinct("frame_idx").alias("bone_outlier_frames"))
    return whole.join(odd, "clip_id", "left").fillna(0, ["bone_outlier_frames"])


def monotonic(frames: DataFrame) -> DataFrame:
    """Whether the times of each clip never decrease."""
    down = lambda now, was: F.coalesce(now < was, F.lit(False))
    rows = in_blocks(frames).select("clip_id", "_block", "frame_idx", "t_ms")
    rows = rows.withColumn("_down", down(F.col("t_ms"), F.lag("t_ms").over(own(["clip_id"]))))
    ends = [F.min_by("t_ms", "frame_idx").alias("first"), F.max_by("t_ms", "frame_idx").alias("last"), F.bool_or("_down").alias("inside")]
    blocks = rows.groupBy("clip_id", "_block").agg(*ends)
    between = down(F.col("first"), F.lag("last").over(Window.partitionBy("clip_id").orderBy("_block")))
    return blocks.select("clip_id", (F.col("inside") | between).alias("down")).groupBy("clip_id").agg((~F.bool_or("down")).alias("timestamps_monotonic"))


def coverage(frames: DataFrame, low: int = LOW_VISIBLE) -> DataFrame:
    """Visible share in percent, least and most visible points of a frame, frames with few; zeros without masks."""
    seen = F.aggregate(F.coalesce("mask", F.array().cast("array<boolean>")), F.lit(0), lambda a, v: a + v.cast("int"))
    rows = frames.select("clip_id", seen.alias("n"), F.coalesce(F.size("mask"), F.lit(0)).alias("of"), F.col("mask").isNotNull().alias("has"))
    return rows.groupBy("clip_id").agg(
        F.coalesce(F.sum("n") / F.nullif(F.sum("of"), F.lit(0)) * 100, F.lit(0.0)).alias("coverage_pct"),
        F.min("n").alias("min_visible"),
        F.max("n").alias("max_visible"),
        F.count(F.when(F.col("has") & (F.col("n") < low), 1)).alias("low_vis_frames"),
    )


def sanity(frames: DataFrame) -> DataFrame:
    """Audit figures of each clip: length, finiteness, range, times, coverage, motion, bones.

    One exchange by clip serves the windows and the one aggregation, which sees each frame once a
    keypoint: frame figures count in the first of these rows, steps and bones in their own.
    """
    order, whole = Window.partitionBy("clip_id").orderBy("frame_idx"), Window.partitionBy("clip_id")
    finite = lambda v: ~F.isnan(v) & (F.abs(v) != float("inf"))
    x, mask = F.col("x"), F.coalesce("mask", F.array().cast("array<boolean>"))
    rows = A.once(
        frames.select("clip_id", "frame_idx", "t_ms", "x", "mask"),
        nan=F.exists(x, F.isnan),
        inf=F.exists(x, lambda v: F.abs(v) == float("inf")),
        out=F.size(F.filter(x, lambda v: ~F.isnan(v) & ((v < 0) | (v > 1)))),
        fits=F.coalesce(F.size(x) == 2 * F.size("mask"), F.lit(False)),
        n=F.aggregate(mask, F.lit(0), lambda a, v: a + v.cast("int")),
        of=F.size(mask),
        has=F.col("mask").isNotNull(),
        c=F.transform(x, lambda v: F.when(finite(v), v.cast("double"))),
    )
    rows = rows.select(*[c for c in rows.columns if c not in ("x", "mask")], F.lag("c").over(order).alias("p"), F.coalesce(F.col("t_ms") < F.lag("t_ms").over(order), F.lit(False)).alias("down"))
    square = lambda a, b: (a - b) ** 2
    at = lambda col, i: F.get(F.col(col), i)
    step = lambda i: F.sqrt(square(at("c", 2 * i), at("p", 2 * i)) + square(at("c", 2 * i + 1), at("p", 2 * i + 1)))
    bone = lambda a, b: F.sqrt(square(at("c", F.lit(2 * a)), at("c", F.lit(2 * b))) + square(at("c", F.lit(2 * a + 1)), at("c", F.lit(2 * b + 1))))
    places = F.when(F.col("of") > 0, F.sequence(F.lit(0), F.greatest(F.col("of") - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    rows = A.once(rows, steps=F.transform(places, step), bones=F.array(*[bone(a, b) for a, b in BONES])).drop("c", "p")
    each = [F.get(F.col("bones"), F.lit(i)) for i in range(len(BONES))]
    limits = {f"m{i}": F.avg(b).over(whole) for i, b in enumerate(each)} | {f"s{i}": F.stddev_pop(b).over(whole) for i, b in enumerate(each)}
    rows = rows.withColumn("top", F.array_max("steps"))
    rows = rows.withColumns(limits | {"limit": F.percentile("top", 0.5).over(whole) + SPIKE_SIGMA * F.stddev_pop("top").over(whole)})
    odd = F.coalesce(F.array_max(F.array(*[F.abs((b - F.col(f"m{i}")) / (F.col(f"s{i}") + 1e-9)) for i, b in enumerate(each)])) > BONE_Z, F.lit(False))
    spike = F.coalesce(F.col("top") > F.col("limit") + SPIKE_SLACK, F.lit(False))
    figures = ("clip_id", "frame_idx", "t_ms", "nan", "inf", "out", "fits", "n", "of", "has", "down")
    long = rows.select(*figures, "bones", odd.alias("odd"), spike.alias("spike"), F.posexplode_outer("steps").alias("kp", "v"))
    long = long.withColumns({"first": F.coalesce("kp", F.lit(0)) == 0, "b": F.get(F.col("bones"), F.col("kp"))})
    once = lambda c: F.when(F.col("first"), c)
    count = lambda c: F.count(once(F.when(c, 1)))
    return long.groupBy("clip_id").agg(
        F.count(once(F.lit(1))).alias("T"),
        F.bool_or("nan").alias("x_has_nan"),
        F.bool_or("inf").alias("x_has_inf"),
        F.sum(once(F.col("out"))).alias("x_out_of_range"),
        (F.max_by("t_ms", "frame_idx") - F.min_by("t_ms", "frame_idx")).alias("duration_ms"),
        F.bool_and("fits").alias("temporal_consistent"),
        (~F.bool_or("down")).alias("timestamps_monotonic"),
        F.coalesce(F.sum(once(F.col("n"))) / F.nullif(F.sum(once(F.col("of"))), F.lit(0)) * 100, F.lit(0.0)).alias("coverage_pct"),
        F.min("n").alias("min_visible"),
        F.max("n").alias("max_visible"),
        count(F.col("has") & (F.col("n") < LOW_VISIBLE)).alias("low_vis_frames"),
        F.coalesce(F.percentile("v", 0.95), F.lit(0.0)).alias("vel_p95"),
        F.coalesce(F.max("v"), F.lit(0.0)).alias("vel_max"),
        count(F.col("spike")).alias("vel_spike_frames"),
        (F.stddev_pop("b") / (F.avg("b") + 1e-9) * 100).alias("bone_len_cv_pct"),
        count(F.col("odd")).alias("bone_outlier_frames"),
    )


def feature_stats(frames: DataFrame, col: Column | str = "x") -> DataFrame:
    """For each clip and place of the array: mean, population deviation, least, most, range (4 decimals)."""
    stats = array_stats(frames.select("clip_id", (F.col(col) if isinstance(col, str) else col).alias("v")), "clip_id", "v")
    each = stats.select("clip_id", F.posexplode(F.arrays_zip("mean", "std", F.col("low").alias("min"), F.col("high").alias("max"))).alias("dim", "s"))
    return each.select("clip_id", "dim", *[F.round(f"s.{c}", 4).alias(c) for c in ("mean", "std", "min", "max")], F.round(F.col("s.max") - F.col("s.min"), 4).alias("range"))


def vector_stats(frames: DataFrame, col: str) -> DataFrame:
    """NaN-ignoring least, most, mean and population deviation of all values of a clip, from sums of each row."""
    v = F.filter(F.transform(F.col(col), lambda x: A.nan_to_null(x.cast("double"))), lambda x: x.isNotNull())
    rows = frames.select("clip_id", F.size(v).alias("n"), A.total(v).alias("s"), A.total(F.transform(v, lambda x: x * x)).alias("q"), F.array_min(v).alias("lo"), F.array_max(v).alias("hi"))
    sums = rows.groupBy("clip_id").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.min("lo").alias("min"), F.max("hi").alias("max"))
    mean = F.col("s") / F.col("n")
    return sums.select("clip_id", "min", "max", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - mean * mean)).alias("std"))


def sequence_overview(frames: DataFrame, target: int) -> DataFrame:
    """Length, width, duration, rate and coverage of each clip, and how it meets a target length."""
    seen = F.aggregate("mask", F.lit(0), lambda a, v: a + v.cast("int"))
    rows = frames.select("clip_id", "frame_idx", "t_ms", F.size("x").alias("width"), seen.alias("n"), F.size("mask").alias("of"))
    seconds = (F.max_by("t_ms", "frame_idx") - F.min_by("t_ms", "frame_idx")) / 1000
    out = rows.groupBy("clip_id").agg(F.count("*").alias("frames"), F.max("width").alias("width"), seconds.alias("duration_s"), (F.sum("n") / F.sum("of") * 100).alias("coverage_pct"))
    fit = F.when(F.col("frames") > target, "trim").when(F.col("frames") < target, "pad").otherwise("fits")
    return out.withColumn("fps", F.col("frames") / F.nullif(F.col("duration_s"), F.lit(0.0))).withColumn("fit", fit)


def pool_sequence(frames: DataFrame, method: str = "mean", valid: Column | None = None) -> DataFrame:
    """One vector for each clip: mean (zeros without a valid frame) or maximum over its valid frames."""
    kept = F.col("x") if valid is None else F.when(valid, F.col("x")).otherwise(F.transform("x", lambda v: F.lit(None)))
    stats = array_stats(frames.select("clip_id", kept.cast("array<double>").alias("v")), "clip_id", "v")
    pooled = F.transform("mean", lambda v: F.coalesce(v, F.lit(0.0))) if method == "mean" else F.col("high")
    return stats.select("clip_id", pooled.alias("pooled"))


def augment(frames: DataFrame, noise_std: float = 0.01, p_noise: float = 0.3, p_mask: float = 0.1, ratio: float = 0.1, seed: int = 42) -> DataFrame:
    """Seeded augmentation: some clips get normal noise, some a run of zero frames.

    What a clip draws is drawn once a frame, and values only of noisy clips are hashed.
    """
    unit = lambda what: A.hash_unit(F.concat_ws("|", F.col("clip_id").cast("string"), F.lit(what)), seed) / float(2**32)
    df = frames.withColumn("_t", F.count("*").over(Window.partitionBy("clip_id")))
    block = F.greatest(F.lit(1), F.floor(F.col("_t") * ratio))
    first = F.floor(unit("start") * (F.col("_t") - block + 1))
    blank = (unit("mask") < p_mask) & (F.col("frame_idx") >= first) & (F.col("frame_idx") < first + block)
    place = F.concat_ws("|", F.col("clip_id").cast("string"), F.col("frame_idx").cast("string"))
    df = A.once(df, _blank=blank, _noisy=unit("noise") < p_noise, _place=place)

    def noise(v: Column, i: Column) -> Column:
        part = lambda k: (A.hash_unit(F.concat_ws("|", F.col("_place"), i.cast("string"), F.lit(k)), seed) + 1) / float(2**32 + 1)
        return v + F.sqrt(-2 * F.log(part("a"))) * F.cos(2 * 3.141592653589793 * part("b")) * noise_std

    moved = F.when(F.col("_blank"), F.transform("x", lambda v: v * 0)).when(F.col("_noisy"), F.transform("x", noise)).otherwise(F.col("x"))
    return A.once(df, x=moved).select(*frames.columns)


def frame_summary(frames: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """For each frame: visible points, centre over all points, points that are not at the origin.

    With ``marks`` (``clip_id``, ``frame_idx``, ``occluded``) also ``occluded``, false where a frame has no mark.
    """
    xs, ys = F.filter("x", lambda v, i: i % 2 == 0), F.filter("x", lambda v, i: i % 2 == 1)
    seen = F.aggregate("mask", F.lit(0), lambda a, v: a + v.cast("int"))
    shown = F.size(F.filter(F.arrays_zip(xs.alias("a"), ys.alias("b")), lambda p: ~((p["a"] == 0) & (p["b"] == 0))))
    n = F.size("mask")
    out = frames.select("clip_id", "frame_idx", seen.alias("visible_points"), n.alias("points"), (A.total(A.double(xs)) / n).alias("center_x"), (A.total(A.double(ys)) / n).alias("center_y"), shown.alias("drawn_points"))
    if marks is None:
        return out
    return out.join(marks.select("clip_id", "frame_idx", "occluded"), ["clip_id", "frame_idx"], "left").fillna(False, ["occluded"])


#: Skeleton edges as keypoint pairs within each group.
POSE_EDGES = ((11, 12), (11, 13), (12, 14), (13, 15), (14, 16), (15, 17), (15, 19), (15, 21), (17, 19), (16, 18), (16, 20), (16, 22), (18, 20), (11, 23), (12, 24), (23, 24))
HAND_EDGES = ((0, 1), (1, 2), (2, 3), (3, 4), (0, 5), (5, 6), (6, 7), (7, 8), (0, 9), (9, 10), (10, 11), (11, 12), (0, 13), (13, 14), (14, 15), (15, 16), (0, 17), (17, 18), (18, 19), (19, 20))
FACE_EDGES = ((0, 10), (1, 3), (2, 4), (1, 7), (2, 8), (5, 6), (0, 5), (0, 6), (9, 5), (9, 6))


def skeleton_segments(keypoints: DataFrame, edges: DataFrame) -> DataFrame:
    """One row for each edge of a frame whose ends are both away from the origin; ``edges`` has ``a``, ``b``."""
    points = keypoints.filter(~((F.col("x") == 0) & (F.col("y") == 0))).select("clip_id", "frame_idx", "kp", "x", "y")
    first = points.join(F.broadcast(edges), F.col("kp") == F.col("a")).select("clip_id", "frame_idx", "a", "b", F.col("x").alias("x1"), F.col("y").alias("y1"))
    second = points.select("clip_id", "frame_idx", F.col("kp").alias("b"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return first.join(second, ["clip_id", "frame_idx", "b"])


def edge_table(spark) -> DataFrame:
    """All skeleton edges as absolute keypoints: a fixed few rows."""
    from strideframe.schema import LAYOUT

    groups = (("pose", POSE_EDGES), ("left_hand", HAND_EDGES), ("right_hand", HAND_EDGES), ("face", FACE_EDGES))
    return spark.createDataFrame([(LAYOUT.groups[g][0] + a, LAYOUT.groups[g][0] + b) for g, es in groups for a, b in es], "a int, b int")
