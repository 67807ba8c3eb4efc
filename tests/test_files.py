"""Sources and sinks on small files."""

import json
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strideframe.operators import evaluation as E
from strideframe.operators import labels as L
from strideframe.sources import archives as Z
from strideframe.sources import clips as C
from strideframe.sources import tables as T


def write_npz(path, x, mask, t_ms, meta, x2048=None):
    more = {} if x2048 is None else {"X2048": x2048.astype(np.float32)}
    np.savez(path, X=x.astype(np.float32), mask=mask.astype(bool), timestamps_ms=t_ms.astype(np.int64), meta=np.array(json.dumps(meta)), **more)


def test_archives_and_dumps(spark, tmp_path):
    rng = np.random.default_rng(0)
    for i in range(3):
        write_npz(f"{tmp_path}/clip_{i}.npz", rng.random((4, 156)), rng.random((4, 78)) > 0.2, np.arange(4) * 33, {"model_type": "B"}, rng.random((4, 2048)) if i else None)
    (tmp_path / "broken.npz").write_bytes(b"no archive")
    np.savez(f"{tmp_path}/part.npz", X=np.zeros((1, 156)))
    whole = (tmp_path / "clip_0.npz").read_bytes()
    (tmp_path / "cut.npz").write_bytes(b"PK\x03\x04" + bytes(40))
    (tmp_path / "torn.npz").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "film.MOV").write_bytes(b"x")
    clips, frames = C.read_npz_clips(spark, str(tmp_path))
    rows = {r.clip_id: r for r in clips.collect()}
    assert rows["clip_1"].has_x2048 and not rows["clip_0"].has_x2048 and rows["clip_0"].issue is None
    assert "load error" in rows["broken"].issue and rows["part"].issue == "missing key: mask"
    assert "load error" in rows["cut"].issue and "load error" in rows["torn"].issue
    assert (rows["clip_1"].x_type, rows["clip_1"].mask_type, rows["clip_1"].t_type) == ("float32", "bool", "int64")
    assert frames.count() == 12
    assert [r.path.rsplit("/", 1)[1] for r in C.list_media(spark, str(tmp_path)).collect()] == ["film.MOV"]
    C.write_frame_parquet(frames, f"{tmp_path}/dump")
    back = C.read_frame_parquet(spark, f"{tmp_path}/dump")
    key = lambda r: (r.clip_id, r.frame_idx)
    a, b = sorted(frames.collect(), key=key), sorted(back.collect(), key=key)
    assert all(x.x == y.x and x.mask == y.mask and x.t_ms == y.t_ms and y.issue is None for x, y in zip(a, b, strict=True))


def test_labels_and_reference(spark, tmp_path):
    (tmp_path / "l.csv").write_text("file,gloss,cat\na.npz,1,2\nB.NPZ,3,4\n")
    rows = sorted(map(tuple, T.read_labels(spark, f"{tmp_path}/l.csv").collect()))
    assert rows == [("B", 3, 4, 0), ("a", 1, 2, 0)]
    (tmp_path / "bad.csv").write_text("file,gloss\na,1\n")
    with pytest.raises(ValueError, match="missing columns"):
        T.read_labels(spark, f"{tmp_path}/bad.csv")
    (tmp_path / "r.csv").write_text("﻿gloss_id,label,cat_id,category\n0,hello,0,greet\nx,no,1,no\n0,hi,0,greet\n", encoding="utf-8")
    assert [tuple(r) for r in T.read_label_ref(spark, f"{tmp_path}/r.csv").collect()] == [(0, "hi", 0, "greet")]
    df = T.read_labels(spark, f"{tmp_path}/l.csv")
    T.append_labels(df, f"{tmp_path}/out", overwrite=True)
    T.append_labels(df, f"{tmp_path}/out")
    assert T.read_labels(spark, f"{tmp_path}/out").count() == 4
    # A table without the column stays without it.
    df.drop("occluded").write.option("header", "true").csv(f"{tmp_path}/plain")
    T.append_labels(df.withColumn("occluded", F.lit(1)), f"{tmp_path}/plain")
    assert "occluded" not in spark.read.option("header", "true").csv(f"{tmp_path}/plain").columns
    assert [r.occluded for r in T.read_labels(spark, f"{tmp_path}/plain").collect()] == [0] * 4


def test_logs_and_reports(spark, tmp_path):
    (tmp_path / "t.csv").write_text('"# Training Configuration: epochs=2, batch_size=4"\n"# Rate: 0.1, Decay: 0"\n# Time\n\nepoch,train_loss,val_loss,val_gloss_acc,val_cat_acc,lr,epoch_time,extra\n1,2.5,2.0,0.1,0.2,0.001,3.0,x\n2,2.0,1.5,0.3,0.4,0.001,3.0,y\n')
    rows = sorted(T.read_training_csv(spark, f"{tmp_path}/t.csv").collect(), key=lambda r: r.epoch)
    assert [(r.epoch, r.train_loss, r.val_gloss_acc, r.epoch_time) for r in rows] == [(1, 2.5, 0.1, 3.0), (2, 2.0, 0.3, 3.0)]
    (tmp_path / "log.txt").write_text("Start\nEpoch  1/30 | Train Loss: 3.4921 | Val Loss: 3.4831 | Val Gloss Acc: 0.007 | Val Cat Acc: 0.115 | Time: 25.8s\nweights\n")
    (tmp_path / "more.txt").write_text("Epoch  1/30 | Train Loss: 3.4 | Val Loss: 3.4 | Val Gloss Acc: 0.007 | Val Cat Acc: 0.115 | Time: 25.8s\n  Curriculum: Phase 1 | Weights: α=0.300, β=0.700\nEpoch  2/30 | Train Loss: 3.0 | Val Loss: 3.4 | Val Gloss Acc: 0.007 | Val Cat Acc: 0.115 | Time: 25.8s\nEpoch  3/30 | Train Loss: 2.0 | Val Loss: 3.4 | Val Gloss Acc: 0.007 | Val Cat Acc: 0.115 | Time: 25.8s\n  Loss Weighting: uncertainty | Weights: α=0.1, β=0.9\n", encoding="utf-8")
    more = sorted((r.epoch, r.weighting, r.alpha, r.beta) for r in T.parse_training_log(spark, f"{tmp_path}/more.txt").collect())
    assert more == [(1, "Phase 1", 0.3, 0.7), (2, None, None, None), (3, "uncertainty", 0.1, 0.9)]
    (row,) = T.parse_training_log(spark, f"{tmp_path}/log.txt").collect()
    assert (row.epoch, row.epochs, row.train_loss, row.epoch_time) == (1, 30, 3.4921, 25.8)
    df = spark.createDataFrame([(1, [1, 2])], "a int, b array<int>")
    T.write_report(df, f"{tmp_path}/j")
    T.write_report(df, f"{tmp_path}/c", "csv")
    assert spark.read.json(f"{tmp_path}/j").first().b == [1, 2] and spark.read.option("header", "true").csv(f"{tmp_path}/c").first().b == "[1,2]"


def test_label_edges(spark):
    ref = spark.createDataFrame([(0, "How Are You", 1, "TALK"), (1, "Yes", 0, "SHORT")], "gloss_id int, label string, cat_id int, category string")
    rows = [("clip_1_how are you.npz",), ("0/clip_2_yes.npz",), ("clip_3_unknown_more.npz",)]
    got = {r.file: (r.gloss, r.cat) for r in L.assign_ids(spark.createDataFrame(rows, "file string"), ref).collect()}
    assert got == {rows[0][0]: (0, 1), rows[1][0]: (1, 0), rows[2][0]: (None, None)}
    labels = spark.createDataFrame([("clip_yes", 1, 0), ("clip_how", 0, 1), ("clip_other", 5, 5)], "file string, gloss int, cat int")
    assert {r.file for r in L.restrict_pairs(labels, ref, None, ["yes", "other"]).collect()} == {"clip_yes", "clip_other"}
    with pytest.raises(ValueError, match="no known category"):
        L.restrict_pairs(labels, ref, ["nothing"])
    with pytest.raises(ValueError, match="out of range"):
        L.validate_labels(labels, 5, 6)


def test_single_class_and_empty_segments(spark):
    preds = spark.createDataFrame([(1, 0, 0, 0, 0, 0), (2, 0, 0, 0, 0, 0)], "clip_id long, gloss_gt int, gloss_pred int, cat_gt int, cat_pred int, occluded int")
    assert tuple(E.agreement(preds).first()) == (0.0, 0.0)
    assert {r.segment for r in E.segment_metrics(preds).collect()} == {"overall", "non_occluded"}
    assert E.segment_differences(E.segment_metrics(preds)).first().gloss_accuracy is None
    assert E.overall_metrics(preds.limit(0)).first().n == 0


def test_no_match_and_bad_splits_are_errors(spark):
    labels = spark.createDataFrame([("a", 0, 0), ("b", 0, 0), ("c", 1, 0)], "file string, gloss int, cat int")
    with pytest.raises(ValueError, match="no label has a clip"):
        L.match_files(labels, spark.createDataFrame([("x/z.npz",)], "file string"))
    assert L.match_files(labels, spark.createDataFrame([("x/b.npz",)], "file string")).count() == 1
    assert tuple(L.match_counts(labels, spark.createDataFrame([("x/b.npz",), ("b",)], "file string")).first()) == (3, 1, 2)
    with pytest.raises(ValueError, match="single row"):
        L.stratified_split(labels)
    with pytest.raises(ValueError, match="too few"):
        L.stratified_split(labels.union(labels), ratio=0.9)
    assert L.stratified_split(labels.limit(0)).count() == 0


def test_only_wanted_members_are_read(spark, tmp_path):
    """``X`` is damaged: frames without ``x`` are whole, with it the archive has none, and its clip has an issue."""
    rng = np.random.default_rng(1)
    path = f"{tmp_path}/a.npz"
    write_npz(path, rng.random((50, 156)), rng.random((50, 78)) > 0.2, np.arange(50) * 33, {})
    with zipfile.ZipFile(path) as z:
        at = z.getinfo("X.npy").header_offset + 2000
    with open(path, "r+b") as f:
        f.seek(at)
        f.write(b"\x00\x01\x02\x03\x04\x05")
    clips, times = C.read_npz_clips(spark, str(tmp_path), columns=("clip_id", "frame_idx", "t_ms"))
    assert times.columns == ["clip_id", "frame_idx", "t_ms"]
    assert [r.t_ms for r in times.orderBy("frame_idx").collect()] == [33 * i for i in range(50)]
    assert C.read_npz_clips(spark, f"file://{tmp_path}")[1].count() == 0
    assert "checksum" in clips.first().issue


def test_archives_share_partitions(spark, tmp_path, monkeypatch):
    for i in range(7):
        write_npz(f"{tmp_path}/{i}.npz", np.zeros((2, 156)), np.zeros((2, 78)), np.arange(2), {})
    reader = Z.NpzFrames({"path": str(tmp_path)}).reader(None or spark.createDataFrame([], Z.FRAMES).schema)
    assert [len(p.files) for p in reader.partitions()] == [7]
    monkeypatch.setattr(Z, "PARTITION_FILES", 3)
    assert [len(p.files) for p in reader.partitions()] == [3, 3, 1]
    monkeypatch.setattr(Z, "PARTITION_BYTES", 1)
    assert [len(p.files) for p in reader.partitions()] == [1] * 7
    assert C.read_npz_clips(spark, str(tmp_path))[1].count() == 14


def test_frames_round_trip_with_features(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(f"c{c}", i, 33 * i, rng.random(156).astype(np.float32).tolist(), (rng.random(78) > 0.5).tolist(), rng.random(2048).astype(np.float32).tolist() if c else None) for c in range(3) for i in range(5)]
    frames = spark.createDataFrame(rows, Z.FRAMES)
    meta = spark.createDataFrame([("c0", '{"model_type": "T"}'), ("c1", None)], "clip_id string, meta string")
    done = C.write_npz_clips(frames, meta, f"file://{tmp_path}/out")
    assert sorted((r.clip_id, r.n_frames) for r in done.collect()) == [("c0", 5), ("c1", 5), ("c2", 5)]
    clips, back = C.read_npz_clips(spark, f"{tmp_path}/out")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, frames.collect()))
    assert sorted((r.clip_id, r.meta, r.has_x2048) for r in clips.collect()) == [("c0", '{"model_type": "T"}', False), ("c1", "{}", True), ("c2", "{}", True)]
    names = [p.name for p in (tmp_path / "out").iterdir()]
    assert "_SUCCESS" in names and not list((tmp_path / "out").glob("_temporary/*"))


def test_a_lost_and_a_doubled_task_leave_one_file(tmp_path):
    one = pa.table({"clip_id": ["a", "a", "b"], "frame_idx": pa.array([0, 1, 0], pa.int32()), "t_ms": [0, 33, 0], "x": [[0.5] * 156] * 3, "mask": [[True] * 78] * 3}).to_batches()
    writer = Z.NpzFrames({"path": str(tmp_path / "out")}).writer(None, False)

    def killed():
        yield one[0].slice(0, 2)
        yield one[0].slice(2, 1)
        raise InterruptedError("lost executor")

    with pytest.raises(InterruptedError):
        writer.write(killed())
    first, second = writer.write(iter(one)), writer.write(iter(one))
    assert first.folder != second.folder
    assert not list((tmp_path / "out").glob("part-*")), "nothing is seen before the commit"
    writer.commit([first, None, writer.write(iter([]))])
    assert sorted(p.name for p in (tmp_path / "out").rglob("*.npz")) == ["a.npz", "b.npz"]
    assert not list((tmp_path / "out" / "_temporary").iterdir())
    again = Z.NpzFrames({"path": str(tmp_path / "out")}).writer(None, True)
    again.abort([again.write(iter(one))])
    assert len(list((tmp_path / "out").rglob("*.npz"))) == 2
    again.commit([again.write(iter([one[0].slice(2, 1)]))])
    assert [p.name for p in (tmp_path / "out").rglob("*.npz")] == ["b.npz"]
    with np.load(next((tmp_path / "out").rglob("*.npz"))) as z:
        assert z["X"].shape == (1, 156) and z["timestamps_ms"].tolist() == [0]
