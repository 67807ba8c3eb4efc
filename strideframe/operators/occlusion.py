"""Hands over the face: region geometry, confidence, temporal smoothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.functions import arrays as A
from strideframe.operators.scans import in_blocks, numbered, own, with_neighbours
from strideframe.schema import LAYOUT
from strideframe.sources.staged import staged

#: Fixed values: (x from, x to, y from, y to) in which each face landmark is plausible, by its number.
FACE_BOXES = (
    (0.3, 0.7, 0.3, 0.7),
    (0.2, 0.8, 0.2, 0.6),
    (0.2, 0.8, 0.2, 0.6),
    (0.3, 0.7, 0.2, 0.6),
    (0.3, 0.7, 0.2, 0.6),
    (0.2, 0.8, 0.5, 0.8),
    (0.2, 0.8, 0.5, 0.8),
    (0.2, 0.8, 0.1, 0.4),
    (0.3, 0.7, 0.6, 0.9),
    (0.1, 0.9, 0.3, 0.7),
    (0.1, 0.9, 0.3, 0.7),
)
#: Face landmarks that regions use, region radii, hand landmarks.
NOSE, EYES, MOUTH, FOREHEAD, CHIN = 0, (1, 2), (5, 6), 7, 8
RADII = {"forehead": 0.12, "cheeks": 0.15, "nose": 0.10, "mouth": 0.12, "neck": 0.15}
NECK_DROP, FACE_SIZE = 0.05, 0.35
KNUCKLES, WRIST, TIPS = (5, 9, 13, 17), 0, (4, 8, 12, 16, 20)
MIN_FACE, MIN_HAND, DETECT = 3, 3, 0.4

POINT = "struct<x:double,y:double>"


def _point(i: int, box: tuple[float, float, float, float] = (0.0, 1.0, 0.0, 1.0)) -> Column:
    """Keypoint ``i`` where it is visible and lies in the box (x from, x to, y from, y to)."""
    x, y = F.col("x")[2 * i].cast("double"), F.col("x")[2 * i + 1].cast("double")
    a, b, c, d = box
    return F.when(F.col("mask")[i] & x.between(a, b) & y.between(c, d), F.struct(x.alias("x"), y.alias("y"))).cast(POINT)


def _seen(first: int, end: int) -> Column:
    return F.size(F.filter(F.slice("mask", first + 1, end - first), lambda v: v))


def _mean(a: Column, b: Column) -> Column:
    return F.struct(((a["x"] + b["x"]) / 2).alias("x"), ((a["y"] + b["y"]) / 2).alias("y"))


def valid_face(frames: DataFrame) -> DataFrame:
    """Adds ``face``: array by landmark of plausible points (null otherwise), null where the face is unusable."""
    first, end = LAYOUT.groups["face"]

    face = F.array(*[_point(first + i, FACE_BOXES[i]) for i in range(end - first)])
    usable = (_seen(first, end) >= MIN_FACE) & (F.size(F.filter("face", lambda p: p.isNotNull())) >= MIN_FACE)
    return A.once(A.once(frames, face=face), face=F.when(usable, F.col("face")))


def face_scale(face: Column) -> Column:
    """Mean of width and height over the usual size, from 0.5 to 2; 1 with fewer than two points."""
    # Nulls don't count for the least and the most.
    xs, ys = F.transform(face, lambda p: p["x"]), F.transform(face, lambda p: p["y"])
    size = ((F.array_max(xs) - F.array_min(xs)) + (F.array_max(ys) - F.array_min(ys))) / 2 / FACE_SIZE
    return F.when(F.size(F.filter(face, lambda p: p.isNotNull())) < 2, 1.0).otherwise(F.greatest(F.lit(0.5), F.least(F.lit(2.0), size)))


def head_regions(frames: DataFrame) -> DataFrame:
    """Adds ``regions``: array of (name, x, y, r) of the circles that the landmarks allow; all need the nose."""
    frames = A.once(frames, scale=face_scale(F.col("face")))
    at = lambda i: F.col("face")[i]
    chin = at(CHIN)
    centers = {
        "forehead": at(FOREHEAD),
        "cheeks": F.when(at(EYES[0]).isNotNull() & at(EYES[1]).isNotNull(), _mean(at(EYES[0]), at(EYES[1]))),
        "nose": at(NOSE),
        "mouth": F.when(at(MOUTH[0]).isNotNull() & at(MOUTH[1]).isNotNull(), _mean(at(MOUTH[0]), at(MOUTH[1]))),
        "neck": F.when(chin.isNotNull(), F.struct(chin["x"].alias("x"), (chin["y"] + NECK_DROP * F.col("scale")).alias("y"))),
    }
    circle = lambda n, c: F.when(at(NOSE).isNotNull() & c.isNotNull(), F.struct(F.lit(n).alias("name"), c["x"].alias("x"), c["y"].alias("y"), (RADII[n] * F.col("scale")).alias("r")))
    return A.once(frames, regions=F.filter(F.array(*[circle(n, c) for n, c in centers.items()]), lambda r: r.isNotNull()))


def hand_points(frames: DataFrame, every: bool = False) -> DataFrame:
    """One row for each hand with enough visible points: ``hand``, ``palm`` (may be null), ``tips``.

    With ``every`` a hand without them, or of a frame whose ``face`` is null, has a row of nulls, so that no frame is lost.
    """

    def points(name: str, places: tuple[int, ...]) -> Column:
        first = LAYOUT.groups[name][0]
        return F.filter(F.array(*[_point(first + i) for i in places]), lambda p: p.isNotNull())

    def hand(name: str) -> Column:
        shown = _seen(*LAYOUT.groups[name]) >= MIN_HAND
        seen = F.when(shown & F.col("face").isNotNull() if every else shown, F.lit(name))
        return F.struct(seen.alias("hand"), points(name, KNUCKLES).alias("mcp"), points(name, (WRIST,)).alias("wrist"), points(name, TIPS).alias("tips"))

    keep = [c for c in frames.columns if c not in ("x", "mask")]
    # An outer explode: the filter that Spark infers for an inner one would copy the whole expression below it.
    rows = frames.select(*keep, F.explode_outer(F.array(hand("left_hand"), hand("right_hand"))).alias("one_hand"))
    rows = rows if every else rows.filter("one_hand.hand IS NOT NULL")
    rows = rows.select(*keep, "one_hand.*")
    mean = lambda c: F.aggregate("mcp", F.lit(0.0), lambda a, p: a + p[c]) / F.size("mcp")
    palm = F.when(F.size("mcp") >= 2, F.struct(mean("x").alias("x"), mean("y").alias("y")).cast(POINT)).otherwise(F.try_element_at("wrist", F.lit(1)))
    return A.once(rows, palm=F.when(F.col("hand").isNotNull(), palm) if every else palm).select(*keep, "hand", "palm", "tips")


def _dist(p: Column, r: Column) -> Column:
    return F.sqrt((p["x"] - r["x"]) ** 2 + (p["y"] - r["y"]) ** 2)


def approach(hands: DataFrame, last: int = 5) -> DataFrame:
    """Adds ``recent``: the ``last`` palms of the hand up to this frame (null palms don't count), null while fewer.

    Each palm carries how many came before it, so a bounded row window is enough: the frames that
    hold them are found by a range window over that count.
    """
    key = Window.partitionBy("clip_id", "hand").orderBy("frame_idx")
    hands = hands.withColumn("_n", F.count("palm").over(key.rowsBetween(Window.unboundedPreceding, 0)))
    near = Window.partitionBy("clip_id", "hand").orderBy("_n").rangeBetween(-(last - 1), 0)
    # Rows without a palm share the count of the palm before them and add nothing to the list.
    seen = F.collect_list(F.when(F.col("palm").isNotNull(), F.struct("_n", "palm"))).over(near)
    recent = F.transform(F.array_sort(seen), lambda s: s["palm"])
    return hands.withColumn("recent", F.when(F.col("_n") >= last, recent)).drop("_n")


def region_confidence(hands: DataFrame, every: bool = False) -> DataFrame:
    """One row for each hand and region with ``confidence`` in [0, 1]; with ``every`` also one with nulls for other hands."""
    each = hands.select("clip_id", "frame_idx", "hand", "palm", "tips", "recent", F.explode_outer("regions").alias("circle"))
    each = each if every else each.filter("circle IS NOT NULL")
    r = F.col("circle")
    away = lambda ps: F.transform(ps, lambda p: _dist(p, r))
    each = A.once(each.withColumn("region", r["name"]).withColumn("radius", r["r"]), d=_dist(F.col("palm"), r), tip=F.array_min(away("tips")), track=away("recent"))
    d, tip, track, radius = map(F.col, ("d", "tip", "track", "radius"))
    inside = F.when(tip <= radius, 0.5).otherwise(0.0)
    reach = radius * 1.5
    near = F.when(d <= reach, F.greatest(F.lit(0.0), 1 - d / reach) * 0.3).otherwise(0.0)
    falls = F.size(F.filter(F.zip_with(F.slice(track, 2, 4), F.slice(track, 1, 4), lambda now, before: now < before), lambda b: b))
    first, now = track[0], track[4]
    # A track that starts in the very centre gets no score for approaching it.
    closing = F.when(track.isNotNull() & (falls >= 2) & (now <= reach) & (first > 0), F.greatest(F.lit(0.0), (first - now) / first) * 0.15).otherwise(0.0)
    least, wide = F.least(d, tip), radius * 1.8
    facing = F.when(d.isNotNull() & (F.size("tips") >= 2) & (least <= wide), F.greatest(F.lit(0.0), 1 - least / wide) * 0.05).otherwise(0.0)
    score = F.least(F.lit(1.0), inside + near + closing + facing)
    score = F.when(F.col("hand").isNotNull() & F.col("circle").isNotNull(), score) if every else score
    return each.select("clip_id", "frame_idx", "hand", "region", score.alias("confidence"))


def detect_frames(frames: DataFrame) -> DataFrame:
    """For each frame of the input: ``detected``, sorted ``regions`` and ``confidence`` (0 without detection)."""
    scores = region_confidence(approach(hand_points(head_regions(valid_face(frames)), every=True)), every=True)
    hit = F.col("confidence") > DETECT
    out = scores.groupBy("clip_id", "frame_idx").agg(F.array_sort(F.collect_set(F.when(hit, F.col("region")))).alias("regions"), F.max(F.when(hit, F.col("confidence"))).alias("confidence"))
    return out.select("clip_id", "frame_idx", F.col("confidence").isNotNull().alias("detected"), "regions", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def consecutive_filter(det: DataFrame, size: int = 5, skips: int = 2, min_conf: float = 0.2) -> DataFrame:
    """Smooth detections over a centred window of ``size`` frames, of which ``skips`` may miss.

    A window cut by the start or end of its clip detects nothing; clips of one frame stay as they
    are. For an even size either of the two windows around a frame is enough. Detections are written and
    read back, as both the numbering and the windows read them: else each would be made twice.
    """
    half, need = size // 2, size - skips
    det = staged(det.select("clip_id", "frame_idx", "detected", "regions", "confidence"), "detections")
    # Windows reach ``half`` rows: blocks with so many rows of their neighbours see all of them.
    det, order = with_neighbours(numbered(det, ["clip_id"]), half, half), own(["clip_id"], "_i")
    around = order.rowsBetween(-half, half)
    ok = F.col("detected") & (F.col("confidence") >= min_conf)
    det = det.withColumn("_ok", ok)
    spans = [(-half, half)] if size % 2 else [(-half, half - 1), (-half + 1, half)]
    hits = [(F.count("*").over(order.rowsBetween(a, b)) >= size) & (F.count(F.when(F.col("_ok"), 1)).over(order.rowsBetween(a, b)) >= need) for a, b in spans]
    hit = hits[0] if len(hits) == 1 else hits[0] | hits[1]
    listed = F.flatten(F.collect_list(F.when(F.col("_ok"), F.array_distinct("regions"))).over(around))
    often = max(1, need // 2)
    det = det.withColumns({"_hit": hit, "_list": listed, "_conf": F.coalesce(F.avg(F.when(F.col("_ok"), F.col("confidence"))).over(around), F.lit(0.0))})
    kept = F.array_sort(F.filter(F.array_distinct("_list"), lambda n: F.size(F.filter("_list", lambda m: m == n)) >= often))
    short = F.col("_all") < 2
    pick = lambda old, new: F.when(short, F.col(old)).otherwise(new).alias(old)
    return det.filter("NOT _copy").select("clip_id", "frame_idx", pick("detected", F.col("_hit")), pick("regions", kept), pick("confidence", F.col("_conf")))


def occlusion_summary(det: DataFrame) -> DataFrame:
    """For each clip: flag, rate, frames, occluded frames and the details of its frames."""
    hits = F.count(F.when(F.col("detected"), 1))
    return det.groupBy("clip_id").agg(
        F.max(F.col("detected").cast("int")).alias("binary_flag"),
        (hits / F.count("*")).alias("occlusion_rate"),
        F.count("*").alias("total_frames"),
        hits.alias("occluded_frames"),
        F.array_sort(F.collect_list(F.struct("frame_idx", "detected", "regions", "confidence"))).alias("details"),
    )


def occlusion(frames: DataFrame, dealt: bool = False) -> DataFrame:
    """The whole analysis: faces, regions, hands, confidence, smoothing, summary of each clip.

    Frames are dealt by clip once, unless they come so (``dealt``), and the whole detection keeps to that.
    """
    frames = frames if dealt else frames.repartition("clip_id")
    return occlusion_summary(consecutive_filter(detect_frames(frames)))


def majority_vote(counts: DataFrame, size: int = 5, limit: int = 100) -> DataFrame:
    """``vote``: most of the last ``size`` values of a (clip, region) exceed ``limit``; before that the current one decides."""
    order = Window.partitionBy("clip_id", "region").orderBy("frame_idx")
    over = (F.col("pixels") > limit).cast("int")
    votes = F.sum(over).over(order.rowsBetween(-(size - 1), 0))
    return counts.withColumn("vote", F.when(F.row_number().over(order) < size, over == 1).otherwise(votes * 2 > size))


def visibility_run_flag(frames: DataFrame, visible: float = 0.6, share: float = 0.4, run: int = 15) -> DataFrame:
    """Clips with too many frames, or too long a run of frames, in which too few points are visible."""
    seen = F.size(F.filter("mask", lambda v: v)) / F.size("mask")
    key, order = ["clip_id", "_block"], own(["clip_id"])
    rows = in_blocks(frames.select("clip_id", "frame_idx", (seen < visible).alias("bad"))).withColumn("i", F.row_number().over(order))
    rows = rows.withColumn("island", F.col("i") - F.row_number().over(Window.partitionBy(*key, "bad").orderBy("frame_idx")))
    runs = rows.groupBy(*key, "bad", "island").agg(F.count("*").alias("n"), F.min("i").alias("first"), F.max("i").alias("last"))
    # A block's summary: its frames, its bad ones, its longest bad run and those at its two ends.
    bad = F.when(F.col("bad"), F.col("n")).otherwise(0)
    blocks = runs.groupBy(*key).agg(
        F.sum("n").alias("n"), F.sum(bad).alias("bad"), F.max(bad).alias("best"),
        F.max_by(bad, -F.col("first")).alias("head"), F.max_by(bad, "last").alias("tail"),
    )
    # A run that goes on through whole blocks grows by them: since the last block that ended it, its tail and those frames.
    before = Window.partitionBy("clip_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.col("head") == F.col("n")
    blocks = blocks.withColumn("upto", F.sum(F.when(whole, F.col("n")).otherwise(0)).over(before.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = blocks.withColumn("open", F.coalesce(F.last("upto").over(before), F.lit(0)) + F.coalesce(F.last(F.when(~whole, F.col("tail") - F.col("upto")), True).over(before), F.lit(0)))
    longest = F.greatest("best", F.col("open") + F.col("head"))
    out = blocks.groupBy("clip_id").agg(F.sum("n").alias("frames"), F.sum("bad").alias("bad_frames"), F.max(longest).alias("longest_run"))
    return out.withColumn("occluded", ((F.col("bad_frames") / F.col("frames")) >= share) | (F.col("longest_run") >= run))


def join_frame_occlusion(frames: DataFrame, clips: DataFrame) -> DataFrame:
    """``occluded`` of each frame from the detailed results that the clip's meta JSON holds."""
    shape = "struct<occlusion_results:struct<detailed_results:array<struct<frame_idx:int,occlusion_detected:boolean>>>>"
    found = clips.select("clip_id", F.explode(F.from_json("meta", shape)["occlusion_results"]["detailed_results"]).alias("d"))
    found = found.select("clip_id", F.col("d.frame_idx").alias("frame_idx"), F.col("d.occlusion_detected").alias("occluded"))
    return frames.join(found, ["clip_id", "frame_idx"], "left").fillna(False, ["occluded"])


def head_polygons(landmarks: DataFrame) -> DataFrame:
    """``region`` and ``polygon`` (array of points) of the five head regions of each frame.

    ``landmarks`` has struct columns (x, y): forehead, left_eye, right_eye, nose, mouth_left,
    mouth_right, chin. Offsets are in units of the frame.
    """
    c = F.col
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    own = lambda n: p(c(n)["x"], c(n)["y"])
    off = lambda n, dx, dy: p(c(n)["x"] + dx, c(n)["y"] + dy)
    mix = lambda a, dx, b: p(c(a)["x"] + dx, c(b)["y"] + 0.0)
    shapes = {
        "forehead": F.array(own("forehead"), mix("left_eye", 0.0, "forehead"), mix("right_eye", 0.0, "forehead"), own("left_eye"), own("right_eye")),
        "cheeks": F.array(own("left_eye"), own("right_eye"), own("nose"), mix("left_eye", -0.08, "nose"), mix("right_eye", 0.08, "nose")),
        "nose": F.array(*[off("nose", dx, dy) for dx, dy in ((-0.06, -0.04), (0.06, -0.04), (0.06, 0.04), (-0.06, 0.04))]),
        "mouth": F.array(own("mouth_left"), own("mouth_right"), own("chin"), mix("mouth_left", 0.0, "chin"), mix("mouth_right", 0.0, "chin")),
        "neck": F.array(*[off("chin", dx, dy) for dx, dy in ((-0.12, 0.0), (0.12, 0.0), (0.16, 0.20), (-0.16, 0.20))]),
    }
    rows = F.array(*[F.struct(F.lit(n).alias("region"), s.alias("polygon")) for n, s in shapes.items()])
    return landmarks.select("clip_id", "frame_idx", F.explode(rows).alias("one_shape")).select("clip_id", "frame_idx", "one_shape.region", "one_shape.polygon")
