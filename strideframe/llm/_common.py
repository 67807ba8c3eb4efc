"""Shared helpers of the training-data operators: staging, row keys, column names."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where staged tables go when a local session names no shared folder (tests on one machine).
LOCAL_ROOT = "/tmp/checkpoints"
#: A key with more than one in so many rows is hot: fewer than ``HOT`` keys can be.
HOT = 200


#: Rows of long texts that travel to a Python worker at a time.
BATCH_ROWS = 1000


def text_rows(docs: DataFrame, text: str, **columns: str) -> DataFrame:
    """The named id columns as longs and the text as ``text``, for a Python worker.

    Texts can be long, so fewer rows than the session's default go to a worker at a time: memory
    of executors then follows the texts of a small batch.
    """
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name, "10000")) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return docs.select(*[column(c).cast("long").alias(n) for n, c in columns.items()], column(text).cast("string").alias("text"))


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; only a local session may leave it unset."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (root or LOCAL_ROOT).rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    It cuts the lineage, survives the loss of executors, and makes every later reader see the same
    rows in the same files.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/staged/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path  # noqa: SLF001 - lets release() find it
    return out


def release(*tables: DataFrame | None) -> None:
    """Delete staged tables that no later plan reads; others are left alone."""
    for df in tables:
        path = getattr(df, "_staged_path", None)
        if not path:
            continue
        sc = df.sparkSession.sparkContext
        target = sc._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names close to ``wanted`` that ``df`` does not use (names compare without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def column(name: str) -> Column:
    """The column of exactly this name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def keyed(df: DataFrame, id_col: str, key: str, text_col: str | None = None) -> DataFrame:
    """``df`` with a long column ``key`` that tells its rows apart and grows with (id, text hash).

    Where ``id_col`` is unique and never null it is the key. Otherwise (nulls, repeated ids) the
    rows are staged once with a number in the order of (id, hash of the text), null ids last, so
    that what else the table holds and how its files are laid out don't change the order.
    """
    ids = df.select(column(id_col).cast("long").alias("id"))
    clash = ids.groupBy("id").count().filter("count > 1 OR id IS NULL").limit(1).count()
    if not clash:
        return df.withColumn(key, column(id_col).cast("long"))
    # Rows equal in id and text may stand in any order; a third key spreads them over partitions.
    own, mark, tie = fresh(df, "order_id", "order_text", "order_row")
    text = F.xxhash64(column(text_col).cast("string")) if text_col else F.lit(0).cast("long")
    rows = df.withColumns({own: column(id_col).cast("long"), mark: text, tie: F.monotonically_increasing_id()})
    order = [F.col(own).asc_nulls_last(), F.col(mark), F.col(tie)]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return stage(rows.withColumn(key, F.monotonically_increasing_id()).drop(own, mark, tie), "keyed")


def hot_limit(one: DataFrame, weight: str) -> float | None:
    """The weight above which a key holds more than one in ``HOT`` of all rows; None where no key does."""
    got = one.agg(F.sum(weight).alias("total"), F.max(weight).alias("most")).first()
    return got.total / HOT if got.total and got.most > max(1, got.total / HOT) else None


def join_hot(many: DataFrame, one: DataFrame, on: list[str], weight: str, limit: float | None | str = "find") -> DataFrame:
    """Inner join of ``many`` with ``one``, which has each key once and, as ``weight``, how many rows of ``many`` it meets.

    Keys with more than one in ``HOT`` of all rows (the sum of the weights) would fill one task
    each. There are fewer than ``HOT`` of them whatever the data, so their rows are broadcast; all
    others are exchanged by key. ``limit`` is the result of ``hot_limit`` where it is known. Both
    tables are read more than once: stage them.
    """
    limit = hot_limit(one, weight) if limit == "find" else limit
    if limit is None:
        return many.join(one, on)
    is_hot = F.col(weight) > F.lit(float(limit))
    rest = many.join(F.broadcast(one.filter(is_hot).select(*on)), on, "left_anti")
    return many.join(F.broadcast(one.filter(is_hot)), on).unionByName(rest.join(one.filter(~is_hot), on))
