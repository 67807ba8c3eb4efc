"""Cubes, array statistics, stratified bootstrap and batches by length."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideframe.operators import cube as K
from strideframe.operators import evaluation as E
from strideframe.operators import runs as R
from strideframe.operators import scoring as U
from strideframe.operators import sequence as S
from strideframe.operators import vectors as V
from strideframe.operators.vectors import array_stats


def predictions(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.choice("AB"), rng.choice((0, 1)), rng.randrange(6), rng.randrange(6), rng.randrange(2), rng.randrange(2)) for i in range(n)]
    return spark.createDataFrame(rows, "clip_id long, model string, occluded int, gloss_gt int, gloss_pred int, cat_gt int, cat_pred int")


def as_set(df):
    return sorted(str([round(v, 10) if isinstance(v, float) else v for v in r]) for r in df.collect())


def test_cubes_add_up_and_reports_agree(spark, tmp_path):
    df = predictions(spark)
    whole = K.confusion_cube(df)
    parts = [K.confusion_cube(df.filter(F.col("clip_id") % 3 == k)) for k in range(3)]
    assert as_set(K.merge_cubes(*parts)) == as_set(whole)
    path = f"{tmp_path}/cube"
    for day, k in (("2024-01-01", 2), ("2024-01-01", 0), ("2024-01-02", 1), ("2024-01-03", 2)):
        K.add_to_cube(df.filter(F.col("clip_id") % 3 == k), path, day)
    assert as_set(K.read_cube(spark, path)) == as_set(whole)
    assert as_set(K.read_cube(spark, path, "2024-01-02", "2024-01-02")) == as_set(parts[1])
    cube = K.read_cube(spark, path)
    gloss, cat = (K.of_head(cube, h) for h in K.HEADS)
    assert as_set(E.report_of(gloss)) == as_set(E.classification_report(df))
    assert as_set(E.overall_of(gloss, cat)) == as_set(E.overall_metrics(df))
    assert as_set(E.segments_of(*[K.of_head(cube, h, "occluded") for h in K.HEADS])) == as_set(E.segment_metrics(df))
    assert as_set(E.agreement_of(cat)) == as_set(E.agreement(df, "cat_gt", "cat_pred"))
    assert E.pairs_of(gloss).collect() == E.confused_pairs(df).collect()
    assert as_set(E.confusion_matrix(gloss)) == as_set(E.confusion_matrix(E.confusion(df)))
    models = E.compare_models(df.withColumn("gloss_prob", F.lit(0.5))).drop("mean_confidence")
    assert as_set(K.model_accuracies(cube)) == as_set(models)
    assert K.confusion_cube(df.limit(0)).count() == 0


ARRAYS = [
    ("a", [1.0, 2.0, 3.0]),
    ("a", [5.0, None, -1.0, 9.0]),
    ("a", None),
    ("b", [math.nan, 4.0]),
    ("b", [1.0, math.inf]),
    (None, [7.0]),
    (None, []),
    ("c", []),
    ("d", [None, None]),
]


@pytest.mark.parametrize("batch", [1, 2, 10_000])
def test_array_stats_against_exploded_rows(spark, request, batch):
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    request.addfinalizer(lambda: spark.conf.set(size, before))
    spark.conf.set(size, str(batch))
    rng = random.Random(2)
    rows = ARRAYS + [(rng.choice("xyz"), [rng.gauss(1000, 1) for _ in range(5)]) for _ in range(200)]
    df = spark.createDataFrame(rows, "k string, v array<double>").repartition(3)
    got = array_stats(df, "k", "v").select("k", F.posexplode(F.arrays_zip("n", "mean", "std", "low", "high")).alias("dim", "s")).select("k", "dim", "s.*")
    long = df.select("k", F.posexplode("v").alias("dim", "v"))
    want = long.groupBy("k", "dim").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("low"), F.max("v").alias("high"))
    key = lambda r: (str(r.k), r.dim)
    a, b = sorted(got.collect(), key=key), sorted(want.collect(), key=key)
    assert [(r.k, r.dim, r.n) for r in a] == [(r.k, r.dim, r.n) for r in b]
    for x, y in zip(a, b, strict=True):
        for c in ("mean", "low", "high", "std"):
            assert x[c] == y[c] or x[c] == pytest.approx(y[c], nan_ok=True, rel=1e-9) or (c in ("mean", "std") and x.k == "b"), (x, y)


def test_partial_arrays_are_exchanged(spark):
    df = spark.range(2000, numPartitions=4).select((F.col("id") % 3).alias("clip_id"), F.array_repeat(F.col("id").cast("double"), 156).alias("x"))
    stats = array_stats(df, "clip_id", "x")
    assert stats.count() == 3
    plan = stats._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange") == 1
    pooled = {r.clip_id: r.pooled for r in S.pool_sequence(df, "max").collect()}
    assert pooled[1][0] == 1999.0 and len(pooled[1]) == 156
    none = S.pool_sequence(df, "mean", F.lit(False)).first()
    assert none.pooled == [0.0] * 156


def test_merging_parts_is_stable():
    values = np.random.default_rng(3).normal(1e6, 1e-3, (1000, 2))
    there = np.ones(values.shape, bool)
    parts = [V._summed(values[a : a + 100], there[a : a + 100]) for a in range(0, 1000, 100)]
    n, mean, m2, low, high = V._merged(parts)
    assert n.tolist() == [1000, 1000]
    assert np.sqrt(m2 / n) == pytest.approx(values.std(0), rel=1e-6)
    assert (low == values.min(0)).all() and (high == values.max(0)).all() and mean == pytest.approx(values.mean(0))


def test_bootstrap_costs_no_more_for_more_rows(spark, monkeypatch):
    monkeypatch.setattr(E, "STRATA", 64)
    small, large = predictions(spark, 300), predictions(spark, 3000)
    for df in (small, large):
        reps = E._resampled(df, {"acc": F.col("gloss_gt") == F.col("gloss_pred")}, "clip_id", 50, 42)
        assert reps.count() == 50
    monkeypatch.setattr(E, "STRATA", 4096)
    got = E.bootstrap_ci(large).first()
    right = E.error_summary(large).first()
    p = 1 - right.error_rate
    spread = 1.96 * math.sqrt(p * (1 - p) / 3000)
    assert got.mean == pytest.approx(p, abs=0.002)
    assert got.high - got.low == pytest.approx(2 * spread, rel=0.15)


def test_every_row_has_its_own_weight_in_every_resample(spark, monkeypatch):
    monkeypatch.setattr(E, "STRATA", 7)
    df = predictions(spark, 300)
    got = {r.rep: r for r in E._resampled(df, {"g": F.col("gloss_gt") == F.col("gloss_pred"), "k": F.col("cat_gt") == F.col("cat_pred")}, "clip_id", 40, 42).collect()}
    assert sorted(got) == list(range(1, 41))
    rows = [(hashlib.md5(f"{r.clip_id}|42".encode()).hexdigest(), r.gloss_gt == r.gloss_pred, r.cat_gt == r.cat_pred) for r in df.collect()]
    for rep in got:
        c, d = (rep * 1103515245 + 12345) % E.PRIME, (rep * rep * 69069 + rep * 362437 + 1) % E.PRIME
        weighed = []
        for h, g, k in rows:
            u = (int(h[:8], 16) % E.PRIME * c + int(h[8:16], 16) % E.PRIME * d) % E.PRIME
            weighed.append((sum(u >= int(s * E.PRIME) for s in E.POISSON), g, k))
        total = sum(w for w, _, _ in weighed)
        assert got[rep].g == sum(w for w, g, _ in weighed if g) / total
        assert got[rep].k == sum(w for w, _, k in weighed if k) / total


@pytest.mark.parametrize("keep", ["clip_id < 0", "clip_id = 5", "gloss_gt <> gloss_pred", "gloss_gt = gloss_pred"])
def test_bootstrap_of_few_or_like_rows(spark, keep):
    got = E.bootstrap_ci(predictions(spark, 300).filter(keep)).first()
    want = {"clip_id < 0": [None] * 3, "gloss_gt <> gloss_pred": [0.0] * 3, "gloss_gt = gloss_pred": [1.0] * 3}.get(keep)
    assert list(got) == pytest.approx(want) if want and want[0] is not None else want is None or list(got) == want


def test_batches_by_length_are_padded_little():
    rng = random.Random(7)
    lengths = sorted(rng.choice((10, 33, 40, 80, 300, 290)) for _ in range(2000))
    cuts = list(U.batches_of(lengths, 32, 4096))
    assert [i for a, b in cuts for i in range(a, b)] == list(range(2000))
    padded = sum((b - a) * lengths[b - 1] for a, b in cuts)
    assert padded / sum(lengths) < 1.1
    assert all((b - a) <= 32 and (b - a == 1 or (b - a) * lengths[b - 1] <= 4096) for a, b in cuts)
    assert list(U.batches_of([5000, 6000], 32, 4096)) == [(0, 1), (1, 2)]
    assert list(U.batches_of([], 32, 4096)) == []


def test_intervals_of_the_summary_weigh_rows(spark, monkeypatch):
    df = predictions(spark, 300)
    monkeypatch.setattr(E, "STRATA", 1)  # one part of all rows would give every resample the same accuracy
    got = {r.metric: r.confidence_interval for r in E.performance_summary(df).collect()}
    heads = {"Gloss Accuracy": "gloss", "Category Accuracy": "cat"}
    for metric, h in heads.items():
        want = E.bootstrap_ci(df, y=f"{h}_gt", yhat=f"{h}_pred").first()
        assert want.low < want.high and got[metric] == f"[{want.low:.4f}, {want.high:.4f}]"


def test_percent_texts_of_a_batch_round_as_their_sql(spark):
    """Halves that only the scaled double has: 0.301 / 2 * 100 is just below 15.05, ten times that is 150.5."""
    import duckdb

    probs = [k / 1000 for k in range(300, 1000)]
    clips = spark.createDataFrame([(i, 20, True, True, False, "No") for i in range(len(probs))], "clip_id long, n_frames int, from_video boolean, transformer boolean, iv3_gru boolean, occlusion_text string")
    found = spark.createDataFrame([(i, 1, 2, p, p / 2) for i, p in enumerate(probs)], "clip_id long, gloss_pred int, cat_pred int, gloss_prob double, cat_prob double")
    ref = spark.createDataFrame([(1, "A", 2, "B")], "gloss_id int, label string, cat_id int, category string")
    got = {r.file: (r.top_gloss, r.top_category) for r in R.batch_files(clips, found, ref).collect()}
    want = duckdb.sql("SELECT k - 300, printf('A (%.1f%%)', round(k::DOUBLE / 1000 * 100, 1)), printf('B (%.1f%%)', round(k::DOUBLE / 1000 / 2 * 100, 1)) FROM range(300, 1000) t(k)").fetchall()
    assert got == {i: (a, b) for i, a, b in want} and got[1] == ("A (30.1%)", "B (15.1%)")
