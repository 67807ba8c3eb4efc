"""Sequence and occlusion operators against loops written from their definitions, and edge rows."""

import random

import pytest
from pyspark.sql import functions as F

from strideframe.operators import occlusion as O
from strideframe.operators import quality as Q
from strideframe.operators import sequence as S
from strideframe.plans import analyses


def sampled(times, fps):
    kept = []
    for i, ms in enumerate(times):
        if ms * fps >= 1000 * len(kept):
            kept.append(i)
    return kept


def test_downsample_loop(spark):
    rng = random.Random(4)
    clips = {c: sorted(rng.randrange(0, 3000) for _ in range(rng.randrange(1, 60))) for c in range(200)}
    for fps in (5, 15, 24):
        df = spark.createDataFrame([(c, i, t) for c, ts in clips.items() for i, t in enumerate(ts)], "clip_id long, frame_idx int, t_ms long")
        got = {}
        for r in S.downsample(df, fps).orderBy("clip_id", "frame_idx").collect():
            got.setdefault(r.clip_id, []).append(r.frame_idx)
        assert got == {c: k for c, ts in clips.items() if (k := sampled(ts, fps))}


def test_gaps(spark):
    seen = {0: 0.0, 2: 0.2, 8: 0.8, 15: 0.1}
    rows = [(1, 0, i, seen.get(i, 0.0), 0.0, i in seen) for i in range(18)]
    df = spark.createDataFrame(rows, "clip_id long, kp int, frame_idx int, x double, y double, visible boolean")
    out = {r.frame_idx: r for r in S.interpolate_gaps(df, 5).collect()}
    assert [i for i in range(18) if out[i].visible] == [0, 1, 2, 3, 4, 5, 6, 7, 8, 15]
    assert out[1].x == pytest.approx(0.1) and out[5].x == pytest.approx(0.5) and out[10].x == 0.0
    again = S.interpolate_gaps(S.interpolate_gaps(df, 5), 5).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, out.values()))


def smoothed(det, size, skips):
    """det: (detected, regions, confidence) of each frame."""
    n, half, need = len(det), size // 2, size - skips
    if n < 2:
        return det
    out = []
    for i in range(n):
        span = [j for j in range(i - half, i + half + 1) if 0 <= j < n]
        ok = [j for j in span if det[j][0] and det[j][2] >= 0.2]
        starts = [i - half] if size % 2 else [i - half, i - half + 1]
        hit = any(a >= 0 and a + size <= n and sum(a <= j < a + size for j in ok) >= need for a in starts)
        names = sorted({r for j in ok for r in det[j][1] if sum(r in det[k][1] for k in ok) >= max(1, need // 2)})
        out.append((hit, names, sum(det[j][2] for j in ok) / len(ok) if ok else 0.0))
    return out


@pytest.mark.parametrize("size", [3, 4, 5])
def test_temporal_filter_loop(spark, size):
    rng = random.Random(size)
    clips = {c: [(d := rng.random() < 0.6, sorted(rng.sample(["nose", "mouth", "neck"], rng.randrange(1, 3))) if d else [], round(rng.random(), 3) if d else 0.0) for _ in range(n)] for c, n in enumerate([1, 2, 3, 4, 5, 6, 9, 20, 30])}
    df = spark.createDataFrame([(c, i, *d) for c, ds in clips.items() for i, d in enumerate(ds)], "clip_id long, frame_idx int, detected boolean, regions array<string>, confidence double")
    got = {}
    for r in O.consecutive_filter(df, size, 2).orderBy("clip_id", "frame_idx").collect():
        got.setdefault(r.clip_id, []).append((r.detected, r.regions, pytest.approx(r.confidence)))
    assert {c: smoothed(d, size, 2) for c, d in clips.items()} == got


def one_frame(face=11, hand=21, wrist_only=False):
    x, mask = [0.0] * 156, [False] * 78
    marks = [(0.5, 0.5), (0.4, 0.42), (0.6, 0.42), (0.45, 0.42), (0.55, 0.42), (0.45, 0.6), (0.55, 0.6), (0.5, 0.3), (0.5, 0.72), (0.38, 0.5), (0.62, 0.5)]
    for i in range(face):
        x[2 * (67 + i)], x[2 * (67 + i) + 1], mask[67 + i] = *marks[i], True
    for i in range(hand):
        if not wrist_only or i not in (5, 9, 13, 17):
            x[2 * (25 + i)], x[2 * (25 + i) + 1], mask[25 + i] = 0.5, 0.5, True
    return x, mask


def test_face_and_hand_edges(spark):
    cases = {0: one_frame(), 1: one_frame(face=2), 2: one_frame(face=3), 3: one_frame(hand=2), 4: one_frame(wrist_only=True), 5: one_frame(face=0)}
    df = spark.createDataFrame([(c, 0, 0, x, m) for c, (x, m) in cases.items()], "clip_id long, frame_idx int, t_ms long, x array<double>, mask array<boolean>")
    got = {r.clip_id: r for r in O.detect_frames(df).collect()}
    assert [got[c].detected for c in range(6)] == [True, False, True, False, True, False]
    assert O.occlusion(df).filter("binary_flag = 1").count() == 6 - 3  # clips of one frame stay as they are


def test_planted_clips_are_flagged(spark):
    from strideframe.fixtures import fixture

    frames = S.from_keypoints(fixture(spark, "/root/testdata/sf0.01", "fx_holistic"))
    flagged = {r.clip_id for r in O.occlusion(frames).filter("binary_flag = 1").collect()}
    assert flagged == {c for c in range(1, 101) if c % 3 == 0} | ({0} & flagged)


def test_bad_values(spark):
    nan, inf = float("nan"), float("inf")
    good = [0.5] * 156
    rows = [("a", 0, 0, good, [True] * 78), ("b", 0, -1, [nan, *good[1:]], [False] * 78), ("c", 0, 5, [inf, -0.1, 1.1, *good[3:]], [True] * 78), ("c", 1, 4, good, [True] * 78), ("d", 0, 0, good[1:], [True] * 77)]
    df = spark.createDataFrame(rows, "clip_id string, frame_idx int, t_ms long, x array<double>, mask array<boolean>")
    clips = spark.createDataFrame([(c, None) for c in "abcde"], "clip_id string, meta string")
    issues = {r.clip_id: set(r.issues) - {"meta is not valid JSON"} for r in Q.validate_clips(clips, df).collect()}
    assert issues["a"] == set() and issues["e"] == {"empty sequence (T == 0)"}
    assert issues["b"] == {"X has non-finite values", "timestamps_ms contains negative values", "mask has no visible keypoints across all frames"}
    assert issues["c"] == {"X has non-finite values", "X outside [0,1]", "timestamps_ms not monotonic nondecreasing"}
    assert issues["d"] == {"X bad shape/dtype: (1, 155) float32", "mask bad shape/dtype: (1, 77) bool"}
    ragged = spark.createDataFrame([("r", 0, 0, good, [True] * 78), ("r", 1, None, good, None)], df.schema)
    typed = spark.createDataFrame([("r", None, "float64", "int32")], "clip_id string, meta string, x_type string, t_type string")
    (row,) = Q.validate_clips(typed, ragged).collect()
    assert set(row.issues) == {"meta is not valid JSON", "X bad shape/dtype: (2, 156) float64", "timestamps_ms bad shape/dtype: (2,) int32", "T mismatch among X/mask/timestamps_ms"}


def test_gap_fill_shuffles_once(spark):
    from strideframe.fixtures import fixture

    plan = S.interpolate_gaps(fixture(spark, "/root/testdata/sf0.001", "fx_track").withColumn("kp", F.lit(0)).repartition("clip_id", "kp"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning(clip_id") <= 2 and "Python" not in text


def test_prepare_keeps_shape(spark):
    from strideframe.fixtures import fixture

    frames = S.from_keypoints(fixture(spark, "/root/testdata/sf0.001", "fx_holistic"))
    out = analyses.prepare(frames, 15)
    assert out.filter("size(x) <> 156 OR size(mask) <> 78").count() == 0 and 0 < out.count() < frames.count()


def test_each_face_and_hand_is_computed_once(spark):
    frames = spark.createDataFrame([(1, 0, 0, *one_frame())], "clip_id long, frame_idx int, t_ms long, x array<double>, mask array<boolean>")
    for df in (O.head_regions(O.valid_face(frames)), O.hand_points(O.head_regions(O.valid_face(frames))), O.region_confidence(O.approach(O.hand_points(O.head_regions(O.valid_face(frames)))))):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        # Eleven face points, two times ten hand points, and three counts of visible ones look at the mask.
        assert plan.count("mask#") < 60, plan.count("mask#")


def test_spikes(spark):
    rows = [(1, 0, i, (0.5 if i == 20 else 0.01 * i), 0.0) for i in range(40)] + [(2, 0, i, 0.01 * i, 0.0) for i in range(40)]
    df = spark.createDataFrame(rows, "clip_id long, kp int, frame_idx int, x double, y double")
    got = {r.clip_id: r for r in S.velocity(df).collect()}
    assert got[1].vel_spike_frames == 2 and got[2].vel_spike_frames == 0 and got[1].vel_max == pytest.approx(0.31)


def test_bone_outliers(spark):
    def frame(stretch):
        x = [0.0] * 156
        for kp in range(78):
            x[2 * kp], x[2 * kp + 1] = 0.01 * kp, 0.3
        x[14] += stretch
        return x

    rows = [(1, i, 0, frame(0.3 if i == 7 else 0.001 * (i % 2)), [True] * 78) for i in range(30)]
    (row,) = S.bone_stability(spark.createDataFrame(rows, "clip_id long, frame_idx int, t_ms long, x array<double>, mask array<boolean>")).collect()
    assert row.bone_outlier_frames == 1 and row.bone_len_cv_pct > 0


def test_sanity_is_one_pass_and_agrees_with_its_parts(spark):
    rng = random.Random(9)
    nan = float("nan")
    rows = []
    for c in range(4):
        for i in range(12):
            x = [rng.random() for _ in range(156)]
            if (c, i) == (1, 3):
                x[5] = nan
            rows.append((c, i, i * 33 - (c == 2 and i == 7) * 100, x, [rng.random() < 0.5 for _ in range(78)]))
    rows.append((9, 0, 0, [], []))
    df = spark.createDataFrame(rows, "clip_id long, frame_idx int, t_ms long, x array<double>, mask array<boolean>").repartition("clip_id")
    out = S.sanity(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    got = {r.clip_id: r for r in out.collect()}
    assert got[9].T == 1 and got[9].coverage_pct == 0 and got[9].vel_max == 0
    full = df.filter("clip_id < 9")
    clean = full.withColumn("x", F.transform("x", lambda v: F.when(~F.isnan(v), v)))
    for part in (S.coverage(full), S.velocity(S.to_keypoints(clean)), S.bone_stability(clean), S.monotonic(full)):
        for r in part.collect():
            for name, value in r.asDict().items():
                assert getattr(got[r.clip_id], name) == (pytest.approx(value) if isinstance(value, float) else value), name
    assert got[1].x_has_nan and not got[0].x_has_nan and not got[2].timestamps_monotonic


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_points_of_clips_are_made_in_many_tasks(spark, monkeypatch):
    """Suppliers lie in one file of one task: the points of a hundred of them are made in five tasks and more, and not exchanged."""
    from strideframe import catalog, fixtures

    monkeypatch.setattr(fixtures, "CLIPS", 20)
    points = fixtures.fixture(spark, "/root/testdata/sf0.01", "fx_holistic")
    tasks = points.select("clip_id", F.spark_partition_id().alias("task")).distinct().collect()
    assert len({r.task for r in tasks}) == 5 and len(tasks) == len({r.clip_id for r in tasks}) == 100
    plan = plan_of(catalog.queries()["a25_sequence_overview"](spark, "/root/testdata/sf0.01"))
    assert "hashpartitioning(clip_id" not in plan and plan.count("Exchange hashpartitioning(s_suppkey") == 1


def test_frames_of_scattered_points(spark):
    """Points in any order, of which some occur twice; both ways to deal give the same frames, points by number."""
    rows = [(c, f, k, float(k + f), None if k == 2 else float(c), k != 1, 10 * f) for c in range(3) for f in range(4) for k in (*range(5), 3)]
    df = spark.createDataFrame(rows, "clip_id long, frame_idx int, kp int, x double, y double, visible boolean, t_ms long").repartition(7)
    want = {(c, f, 10 * f, tuple(v for k in (0, 1, 2, 3, 3, 4) for v in (float(k + f), None if k == 2 else float(c))), tuple(k != 1 for k in (0, 1, 2, 3, 3, 4))) for c in range(3) for f in range(4)}
    for dealt in (False, True):
        out = S.from_keypoints(df, dealt)
        assert out.columns == ["clip_id", "frame_idx", "t_ms", "x", "mask"]
        assert {(r.clip_id, r.frame_idx, r.t_ms, tuple(r.x), tuple(r["mask"])) for r in out.collect()} == want


@pytest.mark.parametrize("name, times", [("p15_augment", 1), ("p18_frame_summary", 1), ("o6_detect_frames", 1), ("w7_consecutive_filter", 0), ("o7_occlusion", 0), ("j6_join_frame_occlusion", 0), ("a19_sanity", 1), ("v1_broken_clips", 1), ("v2_readiness", 1)])
def test_arrays_of_frames_are_made_once_and_not_exchanged(spark, name, times):
    """Points are collected once (not again where detections were written), and no exchange moves their arrays."""
    from strideframe import catalog

    plan = plan_of(catalog.queries()[name](spark, "/root/testdata/sf0.001"))
    assert plan.count("partial_collect_list(struct(kp") == times
    if name not in ("p18_frame_summary", "j6_join_frame_occlusion"):  # their join exchanges figures of frames
        assert plan.count("BroadcastNestedLoopJoin") == 2 * times


def test_compared_times_are_sorted_without_arrays(spark):
    """The window that compares the times of a clip's frames sorts figures, not arrays of 156 and 2,048 numbers."""
    from strideframe import catalog

    for name in ("v1_broken_clips", "v2_readiness"):
        df = catalog.queries()[name](spark, "/root/testdata/sf0.001")
        lines = df._jdf.queryExecution().optimizedPlan().toString().split("\n")
        below = next(b for a, b in zip(lines, lines[1:]) if "Window [lag(t_ms" in a)
        assert " AS w#" in below and " AS cnn_wild#" in below
