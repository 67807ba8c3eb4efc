"""Media listings, clip archives and frame dumps."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.schema import LAYOUT
from strideframe.sources.archives import FRAMES, NpzClips, NpzFrames

VIDEO = (".mp4", ".mov", ".avi", ".mkv")


def list_media(spark: SparkSession, root: str, exts: tuple[str, ...] = VIDEO) -> DataFrame:
    """Files below ``root`` with one of the extensions (any case): ``path``, ``bytes``. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return files.select("path", F.col("length").alias("bytes")).filter(ext.isin([e.lower() for e in exts])).dropDuplicates(["path"])


def read_npz_clips(spark: SparkSession, path: str, with_cnn: bool = True, columns: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """``clips`` and ``frames`` from .npz archives. One that can't be read is a clip with an ``issue`` and has no frames.

    ``columns`` (of ``FRAMES``) are those that ``frames`` has: the members behind others are not read.
    """
    for source in (NpzFrames, NpzClips):
        spark.dataSource.register(source)
    kinds = dict(c.strip().split(" ", 1) for c in FRAMES.split(","))
    wanted = columns or tuple(c for c in kinds if with_cnn or c != "x2048")
    frames = spark.read.format("npz_frames").schema(", ".join(f"{c} {kinds[c]}" for c in wanted)).load(path)
    if not columns and not with_cnn:
        frames = frames.withColumn("x2048", F.lit(None).cast("array<float>"))
    return spark.read.format("npz_clips").load(path), frames


def write_npz_clips(frames: DataFrame, meta: DataFrame, folder: str) -> DataFrame:
    """One archive for each clip below ``folder``, on a file system that all executors reach: ``clip_id``, ``path``, ``n_frames``.

    A clip's frames meet in one task, as they do in its file; files show up when all are written
    (see ``archives``). ``meta`` has ``clip_id`` and JSON text.
    """
    spark = frames.sparkSession
    spark.dataSource.register(NpzFrames)
    ready = frames.join(meta.select("clip_id", "meta"), "clip_id", "left").withColumn("clip_id", F.col("clip_id").cast("string"))
    columns = [c for c in ("clip_id", "frame_idx", "t_ms", "x", "mask", "x2048", "meta") if c in ready.columns]
    kinds = {"t_ms": "long", "x": "array<float>", "mask": "array<boolean>", "x2048": "array<float>"}
    ready = ready.select(*[F.col(c).cast(kinds[c]).alias(c) if c in kinds else c for c in columns])
    ready.repartition("clip_id").sortWithinPartitions("clip_id", "frame_idx").write.format("npz_frames").mode("append").save(folder)
    return read_npz_clips(spark, folder)[0].select("clip_id", "path", "n_frames")


def wide_frames(frames: DataFrame) -> DataFrame:
    """Columns "0" to "155", ``t_ms`` and ``mask_bits``; ``clip_id`` and ``frame_idx`` stay."""
    bits = F.array_join(F.transform("mask", lambda m: F.when(m, "1").otherwise("0")), "")
    return frames.select("clip_id", "frame_idx", *[F.col("x")[i].cast("float").alias(str(i)) for i in range(2 * LAYOUT.total)], "t_ms", bits.alias("mask_bits"))


def write_frame_parquet(frames: DataFrame, path: str) -> None:
    wide_frames(frames).write.mode("overwrite").partitionBy("clip_id").parquet(path)


def narrow_frames(wide: DataFrame) -> DataFrame:
    """The inverse of ``wide_frames``, with ``issue`` where the mask text has the wrong length."""
    missing = {"t_ms", "mask_bits"} - set(wide.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    x = F.array(*[F.col(str(i)) for i in range(2 * LAYOUT.total)])
    mask = F.transform(F.split("mask_bits", ""), lambda b: b == "1")
    issue = F.when(F.length("mask_bits") != LAYOUT.total, "mask_bits length")
    return wide.select("clip_id", "frame_idx", "t_ms", x.alias("x"), mask.alias("mask"), issue.alias("issue"))


def read_frame_parquet(spark: SparkSession, path: str) -> DataFrame:
    return narrow_frames(spark.read.parquet(path))


def _size_text(b: Column) -> Column:
    text = F.when(b < 1024, F.format_string("%d B", b)).when(b < 1024**2, F.format_string("%.1f KB", F.round(b / 1024, 1)))
    return text.when(b < 1024**3, F.format_string("%.1f MB", F.round(b / 1024**2, 1))).otherwise(F.format_string("%.1f GB", F.round(b / 1024**3, 1)))


def file_inventory(files: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Files, bytes and a size text by type: npz, video (.mp4 and .mov only), unknown.

    With ``labels`` (``file``, ``occluded``) also ``labelled``, the files whose base name has a
    label, and ``occluded``, those of them that are.
    """
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    kind = F.when(ext == ".npz", "npz").when(ext.isin(".mp4", ".mov"), "video").otherwise("unknown")
    more = []
    if labels is not None:
        base = lambda c: F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"\.[^.]+$", "")
        known = labels.groupBy(base("file").alias("_base")).agg(F.max("occluded").alias("_occluded"))
        files = files.withColumn("_base", base("path")).join(known.withColumn("_known", F.lit(1)), "_base", "left")
        more = [F.count("_known").alias("labelled"), F.count(F.when(F.col("_occluded") == 1, 1)).alias("occluded")]
    sums = files.groupBy(kind.alias("type")).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), *more)
    return sums.withColumn("size", _size_text(F.col("bytes")))
