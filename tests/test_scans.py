"""Scans in blocks, percentiles by histograms and distributed numbers against plain loops, with tiny blocks and bins."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideframe.operators import evaluation as E
from strideframe.operators import labels as L
from strideframe.operators import occlusion as O
from strideframe.operators import quantiles as Q
from strideframe.operators import scans
from strideframe.operators import sequence as S
from strideframe.operators.numbering import dense_number


@pytest.fixture(scope="module")
def frames(spark):
    """Clips of 1 to 40 frames with gaps in their numbers, null and falling times."""
    rng, rows = random.Random(4), []
    for clip in range(12):
        at, t = 0, 0
        for _ in range(rng.choice((1, 2, 7, 40))):
            at, t = at + rng.choice((1, 1, 1, 5, 9)), t + rng.choice((5, 33, 80) if clip % 3 else (-5, 33, 80))
            shown = rng.random() < (0.9 if clip % 2 else 0.3)
            rows.append((clip, at, None if clip == 5 and rng.random() < 0.2 else t, [0.0, 1.0], [shown, shown, True]))
    return spark.createDataFrame(rows, "clip_id long, frame_idx int, t_ms long, x array<float>, mask array<boolean>")


def by_clip(df, *cols):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.clip_id, r.frame_idx)):
        out.setdefault(r.clip_id, []).append(tuple(r[c] for c in cols))
    return out


@pytest.mark.parametrize("size", [1, 3, 4096])
def test_downsample(frames, monkeypatch, size):
    monkeypatch.setattr(scans, "BLOCK", size)
    timed = frames.filter("t_ms IS NOT NULL")
    want = {}
    for clip, rows in by_clip(timed, "frame_idx", "t_ms").items():
        kept = 0
        for at, t in rows:
            if t * 10 / 1000 >= kept:
                kept += 1
                want.setdefault(clip, []).append((at,))
    assert by_clip(S.downsample(timed, 10), "frame_idx") == want


@pytest.mark.parametrize("size", [1, 3, 4096])
def test_monotonic(frames, monkeypatch, size):
    monkeypatch.setattr(scans, "BLOCK", size)
    want = {c: not any(a is not None and b is not None and b < a for (a,), (b,) in zip(r, r[1:], strict=False)) for c, r in by_clip(frames, "t_ms").items()}
    assert {r.clip_id: r.timestamps_monotonic for r in S.monotonic(frames).collect()} == want


@pytest.mark.parametrize("size", [1, 3, 4096])
def test_visibility_runs(frames, monkeypatch, size):
    monkeypatch.setattr(scans, "BLOCK", size)
    want = {}
    for clip, rows in by_clip(frames, "mask").items():
        bad, longest, now = 0, 0, 0
        for (mask,) in rows:
            now = now + 1 if sum(mask) / 3 < 0.6 else 0
            bad, longest = bad + (now > 0), max(longest, now)
        want[clip] = (len(rows), bad, longest)
    got = {r.clip_id: (r.frames, r.bad_frames, r.longest_run) for r in O.visibility_run_flag(frames).collect()}
    assert got == want and max(v[2] for v in want.values()) > 4


def tracks(spark, seed=6):
    rng = random.Random(seed)
    rows = [(c, i * (1 + c % 2), k, rng.random(), rng.random() if k else math.nan, rng.random() < 0.5) for c in range(4) for i in range(25) for k in range(2)]
    return spark.createDataFrame(rows, "clip_id long, frame_idx int, kp int, x double, y double, visible boolean")


@pytest.mark.parametrize("size", [1, 4, 4096])
def test_steps_and_gaps(spark, monkeypatch, size):
    monkeypatch.setattr(scans, "BLOCK", size)
    df = tracks(spark)
    rows = {}
    for r in sorted(df.collect(), key=lambda r: r.frame_idx):
        rows.setdefault((r.clip_id, r.kp), []).append(r)
    want_v, want_x = {}, {}
    for key, points in rows.items():
        for n, r in enumerate(points):
            v = math.hypot(r.x - points[n - 1].x, r.y - points[n - 1].y) if n else None
            want_v[(*key, r.frame_idx)] = None if v is None or math.isnan(v) else pytest.approx(v)
            before = next((p for p in reversed(points[:n]) if p.visible), None)
            after = next((p for p in points[n + 1 :] if p.visible), None)
            x, shown = r.x, r.visible
            if not shown and before and after and after.frame_idx - before.frame_idx - 1 <= 5:
                x, shown = before.x + (after.x - before.x) * (r.frame_idx - before.frame_idx) / (after.frame_idx - before.frame_idx), True
            want_x[(*key, r.frame_idx)] = (pytest.approx(x), shown)
    assert {(r.clip_id, r.kp, r.frame_idx): r.v for r in S.steps(df).collect()} == want_v
    assert {(r.clip_id, r.kp, r.frame_idx): (r.x, r.visible) for r in S.interpolate_gaps(df).collect()} == want_x


@pytest.mark.parametrize(("size", "width"), [(2, 5), (3, 4), (4096, 5), (5, 3)])
def test_consecutive_filter(spark, monkeypatch, size, width):
    rng = random.Random(9)
    rows = [(c, 2 * i, (hit := rng.random() < 0.6), ["nose"] if hit else [], rng.random()) for c in range(4) for i in range((1, 2, 9, 30)[c])]
    df = spark.createDataFrame(rows, "clip_id long, frame_idx int, detected boolean, regions array<string>, confidence double")
    monkeypatch.setattr(scans, "BLOCK", 4096)
    whole = sorted(map(str, O.consecutive_filter(df, size=width).collect()))
    monkeypatch.setattr(scans, "BLOCK", size)
    assert sorted(map(str, O.consecutive_filter(df, size=width).collect())) == whole
    assert len(whole) == len(rows)


def test_a_long_clip_lies_in_many_tasks(spark):
    one = spark.range(300_000).select(F.lit(1).alias("clip_id"), F.col("id").cast("int").alias("frame_idx"), (F.col("id") * 33).alias("t_ms"))
    for made in (S.downsample(one, 25), S.monotonic(one)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "_block" in plan
    rows = scans.in_blocks(one).repartition(8, "clip_id", "_block").groupBy(F.spark_partition_id()).count().collect()
    assert len(rows) == 8 and max(r["count"] for r in rows) < 150_000
    assert S.downsample(one, 25).count() == sum(1 for _ in plain_kept(300_000))


def plain_kept(n):
    kept = 0
    for i in range(n):
        if i * 33 * 25 / 1000 >= kept:
            kept += 1
            yield i


VALUES = {
    "ties": [0.5] * 50 + [0.25] * 3,
    "spread": [float(i * i % 97) for i in range(200)],
    "wide": [10.0 ** (i % 40 - 20) * (-1) ** i for i in range(150)],
    "odd": [math.inf, -math.inf, math.nan, 0.0, -0.0, 1e308, -1e308] * 5 + [None] * 4,
    "one": [3.0],
    "none": [None] * 30,
    None: [float(i) for i in range(60)],
}


@pytest.mark.parametrize(("direct", "broadcast"), [(10, 10_000), (10, 0), (1_000_000, 10)])
def test_percentiles(spark, monkeypatch, direct, broadcast):
    for name, value in (("DIRECT", direct), ("BINS", 5), ("BROADCAST", broadcast), ("PARTS", 3)):
        monkeypatch.setattr(Q, name, value)
    df = spark.createDataFrame([(g, v) for g, vs in VALUES.items() for v in vs], "g string, v double")
    probs = {"a": 0.5, "b": 0.95, "c": 0.0, "d": 1.0, "e": 1 / 3}
    got = {r.g: r for r in Q.percentiles(df, ["g"], "v", probs, F.count("*").alias("n")).collect()}
    assert set(got) == set(VALUES)
    want = {r.g: r for r in df.groupBy("g").agg(*[F.percentile("v", p).alias(n) for n, p in probs.items()], F.count("*").alias("n")).collect()}
    for g, r in got.items():
        assert list(r.asDict()) == ["g", *probs, "n"]
        for c in (*probs, "n"):
            assert r[c] == want[g][c] or r[c] == pytest.approx(want[g][c], nan_ok=True), (g, c)
    whole = df.filter("g IN ('ties', 'spread')")
    assert Q.percentiles(whole, [], "v", {"m": 0.5}).collect()[0].m == np.percentile(VALUES["ties"] + VALUES["spread"], 50)


def test_confidence_stats_by_histogram(spark, monkeypatch):
    df = spark.createDataFrame([(i * 7919 % 1000 / 1000,) for i in range(500)], "gloss_prob double")
    want = E.confidence_stats(df).collect()
    monkeypatch.setattr(Q, "DIRECT", 20)
    assert [pytest.approx(tuple(r)) for r in E.confidence_stats(df).collect()] == [tuple(r) for r in want]


def test_numbers_of_one_hot_id(spark, request):
    """All stems of one id that begin alike, repeated rows too, lie in many tasks and get each number once."""
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    request.addfinalizer(lambda: spark.conf.unset(coalesce))
    spark.conf.set(coalesce, "false")
    n = 20_000
    files = spark.range(n).select(F.lit(7).alias("id"), F.format_string("clip_%06d", F.col("id") * 7919 % n).alias("stem"))
    ref = spark.createDataFrame([(7, "A b")], "id long, label string")
    got = L.number_clips(files.union(files.limit(3)), ref)
    rows = sorted((r.number, r.stem) for r in got.collect())
    assert [r[0] for r in rows] == list(range(1, n + 4))
    assert [r[1] for r in rows] == sorted(r[1] for r in rows)
    placed = dense_number(files, [F.col("stem")], "k").withColumn("_at", F.spark_partition_id())
    assert placed.select("_at").distinct().count() > 1
    same = dense_number(spark.range(5000).select(F.lit("x").alias("s")), [F.col("s")], "k")
    assert sorted(r.k for r in same.collect()) == list(range(1, 5001))


def test_names_of_a_hot_stem(spark):
    files = spark.createDataFrame([("s", f"/p/{i:04d}") for i in range(500)] + [("t", "/p/1"), ("t", "/p/1")], "stem string, path string")
    got = [(r.stem, r.path, r.name) for r in L.unique_names(files).collect()]
    assert [p for s, p, n in got if n == "s"] == ["/p/0000"]
    assert sorted(n == "t" for s, _, n in got if s == "t") == [False, True]
    assert len(got) == 502


def test_restriction_by_names_in_files(spark):
    ref = spark.createDataFrame([(1, "Hello", 0, "GREET"), (2, "Rare", 1, "OTHER"), (3, "Late", 1, "OTHER")], "gloss_id int, label string, cat_id int, category string")
    rows = [("a_hello", 1, 0), ("a_hello", 1, 0), ("b_nosuch", 2, 1), ("c", 2, 1), ("d_NOSUCH", 9, 0), ("e", 3, 1), (None, 1, 0)]
    labels = spark.createDataFrame(rows, "file string, gloss int, cat int")
    chosen = lambda *a: sorted([tuple(r) for r in L.restrict_pairs(labels, ref, *a).collect()], key=str)
    want = lambda keep: sorted([r for r in rows if keep(r)], key=str)
    assert chosen(None, ["hello"]) == want(lambda r: r[1] == 1)
    # An unknown name allows the glosses of files that hold it, and categories still count.
    assert chosen(None, ["hello", "nosuch"]) == want(lambda r: r[1] in (1, 2, 9))
    assert chosen([0], ["hello", "nosuch"]) == want(lambda r: r[1] in (1, 9))
    assert chosen(["other"], ["nosuch"]) == want(lambda r: r[1] == 2)
    assert chosen(None, ["nothing at all"]) == want(lambda r: True)
    assert chosen([1], None) == want(lambda r: r[2] == 1)
    many = [f"name{i}" for i in range(3000)] + ["nosuch"]
    assert chosen(None, many) == want(lambda r: r[1] in (2, 9))
    with pytest.raises(ValueError):
        L.restrict_pairs(labels, ref, ["unheard"], None)
