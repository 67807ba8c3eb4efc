"""Label tables, label references, training logs and reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strideframe.schema import LABEL_REF


def decoded_csv(spark: SparkSession, path: str, encodings: tuple[str, ...]) -> DataFrame:
    """A table with a header in the first encoding that leaves no character undecoded; the last one is taken as it is."""
    for encoding in encodings[:-1]:
        raw = spark.read.option("header", "true").option("encoding", encoding).csv(path)
        odd = [F.contains(F.col(f"`{c}`"), F.lit("\ufffd")) for c in raw.columns]
        if "\ufffd" not in "".join(raw.columns) and raw.filter(F.coalesce(F.array_contains(F.array(*odd), True), F.lit(False))).isEmpty():
            return raw
    return spark.read.option("header", "true").option("encoding", encodings[-1]).csv(path)


def read_labels(spark: SparkSession, path: str, encoding: str | tuple[str, ...] = ("UTF-8", "ISO-8859-1")) -> DataFrame:
    """Labels with typed columns; ``occluded`` is 0 where absent; ``file`` loses its extension, whichever it is.

    Of several encodings the first that decodes the table is taken.
    """
    raw = decoded_csv(spark, path, (encoding,) if isinstance(encoding, str) else encoding)
    missing = {"file", "gloss", "cat"} - set(raw.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    if "occluded" not in raw.columns:
        raw = raw.withColumn("occluded", F.lit("0"))
    file = F.regexp_replace("file", r"(?<=[^/.])\.[^./]*$", "")
    more = ["split"] if "split" in raw.columns else []
    return raw.select(file.alias("file"), *[F.col(c).try_cast("int").alias(c) for c in ("gloss", "cat", "occluded")], *more)


def append_labels(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Append rows; ``occluded`` is written only if the table that is there has it. A new or overwritten table has it."""
    spark, columns = df.sparkSession, ["file", "gloss", "cat", "occluded"]
    if not overwrite:
        try:
            there = spark.read.option("header", "true").csv(path).columns
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            there = []
        columns = [c for c in columns if c != "occluded" or not there or "occluded" in there]
    if "occluded" in columns and "occluded" not in df.columns:
        df = df.withColumn("occluded", F.lit(0))
    df.select(*columns).write.mode("overwrite" if overwrite else "append").option("header", "true").csv(path)


def clean_label_ref(raw: DataFrame, order: Column) -> DataFrame:
    """Rows with integer ids; of a repeated gloss id the last row counts."""
    ids = raw.withColumns({"gloss_id": F.expr("try_cast(gloss_id AS int)"), "cat_id": F.expr("try_cast(cat_id AS int)")}).withColumn("_o", order)
    ids = ids.filter("gloss_id IS NOT NULL AND cat_id IS NOT NULL")
    return ids.groupBy("gloss_id").agg(F.max_by(F.struct("label", "cat_id", "category"), "_o").alias("last_row")).select("gloss_id", "last_row.*")


def read_label_ref(spark: SparkSession, path: str) -> DataFrame:
    """The label reference; a byte order mark is dropped by the reader."""
    raw = spark.read.schema(LABEL_REF).option("header", "true").csv(path)
    return clean_label_ref(raw, F.monotonically_increasing_id())


def write_report(df: DataFrame, path: str, fmt: str = "json") -> None:
    """JSON lines (nested columns as they are) or CSV with a header (nested columns as JSON, quotes doubled)."""
    if fmt == "json":
        df.write.mode("overwrite").json(path)
    else:
        flat = [F.to_json(c).alias(c) if t.startswith(("struct", "array", "map")) else F.col(c) for c, t in df.dtypes]
        df.select(*flat).write.mode("overwrite").option("header", "true").option("escape", "\"").csv(path)


#: Number and text columns of training tables; a header names some of them.
EPOCH_NUMBERS = ("train_loss", "val_loss", "val_gloss_acc", "val_cat_acc", "lr", "epoch_time", "gpu_memory_allocated", "gpu_memory_reserved", "alpha", "beta")
EPOCH_TEXTS = ("curriculum_phase", "loss_weighting_strategy")


def parse_epoch_lines(lines: DataFrame) -> DataFrame:
    """Epoch rows from the lines (``run``, ``value``) of training tables: comments and blanks dropped, columns by each run's header (null where it has none)."""
    clean = lines.filter("trim(value) <> '' AND NOT ltrim(replace(value, '\"', '')) LIKE '#%'")
    header = clean.filter(F.col("value").startswith("epoch,")).groupBy("run").agg(F.split(F.min("value"), ",").alias("names"))
    rows = clean.filter(~F.col("value").startswith("epoch,")).join(header, "run").withColumn("cells", F.split("value", ","))
    cell = lambda n: F.when(F.array_contains("names", n), F.try_element_at("cells", F.array_position("names", n).cast("int")))
    return rows.select("run", cell("epoch").try_cast("int").alias("epoch"), *[cell(n).try_cast("double").alias(n) for n in EPOCH_NUMBERS], *[F.trim(cell(n)).alias(n) for n in EPOCH_TEXTS])


def read_training_csv(spark: SparkSession, path: str) -> DataFrame:
    return parse_epoch_lines(spark.read.text(path).select(F.input_file_name().alias("run"), "value"))


#: The shapes of an epoch line and of the weights line that may follow it in a console log.
EPOCH_LINE = r"Epoch\s+(\d+)/(\d+) \| Train Loss: ([\d.]+) \| Val Loss: ([\d.]+) \| Val Gloss Acc: ([\d.]+) \| Val Cat Acc: ([\d.]+) \| Time: ([\d.]+)s"
WEIGHTS_LINE = r"^\s*(?:Curriculum|Loss Weighting): (.*) \| Weights: α=([\d.]+), β=([\d.]+)"


def parse_log_lines(lines: DataFrame) -> DataFrame:
    """Epoch rows from console log lines (``run``, ``line``, ``value``), with ``weighting``, ``alpha``, ``beta`` of the next line if it tells them."""
    part = lambda i, n, t: F.regexp_extract("value", EPOCH_LINE, i).cast(t).alias(n)
    after = F.lead("value").over(Window.partitionBy("run").orderBy("line"))
    hits = lines.filter(F.col("value").rlike(EPOCH_LINE) | F.col("value").rlike(WEIGHTS_LINE)).withColumn("after", after).filter(F.col("value").rlike(EPOCH_LINE))
    names = ("train_loss", "val_loss", "val_gloss_acc", "val_cat_acc", "epoch_time")
    told = lambda i, n, t: F.nullif(F.regexp_extract("after", WEIGHTS_LINE, i), F.lit("")).cast(t).alias(n)
    return hits.select("run", part(1, "epoch", "int"), part(2, "epochs", "int"), *[part(i + 3, n, "double") for i, n in enumerate(names)], told(1, "weighting", "string"), told(2, "alpha", "double"), told(3, "beta", "double"))


def parse_training_log(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(F.input_file_name().alias("run"), "value", F.struct("_metadata.file_block_start", F.monotonically_increasing_id().alias("row")).alias("line"))
    return parse_log_lines(lines)
