"""Label tables: ids, matching with files, restriction, splits, names."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.functions import arrays as A
from strideframe.operators.numbering import dense_number

#: Bits of the hash that make a slice of a class.
SLICE_BITS = 12


def assign_ids(labels: DataFrame, ref: DataFrame) -> DataFrame:
    """``gloss`` and ``cat`` by the gloss text of ``file``, without case; null where the text is unknown."""
    ids = ref.groupBy(F.lower("label").alias("_text")).agg(F.max("gloss_id").alias("gloss"), F.max_by("cat_id", "gloss_id").alias("cat"))
    return labels.drop("gloss", "cat").withColumn("_text", A.gloss_text(F.col("file"))).join(ids, "_text", "left").drop("_text")


def _base(file: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(file, "/"), -1), r"(?i)\.npz$", "")


def match_files(labels: DataFrame, clips: DataFrame, check: bool = True) -> DataFrame:
    """Labels whose clip exists (by base name). With ``check`` it is an error if none has one (one short job)."""
    have = clips.select(_base(F.col("file")).alias("_base")).distinct()
    out = labels.withColumn("_base", _base(F.col("file"))).join(have, "_base", "left_semi").drop("_base")
    if check and out.isEmpty():
        raise ValueError("no label has a clip of its name")
    return out


def match_counts(labels: DataFrame, clips: DataFrame) -> DataFrame:
    """One row: labels before matching, those with a clip, those without."""
    have = clips.select(_base(F.col("file")).alias("_base"), F.lit(True).alias("_has")).distinct()
    found = labels.select(_base(F.col("file")).alias("_base")).join(have, "_base", "left")
    return found.agg(F.count("*").alias("before"), F.count("_has").alias("after"), F.count(F.when(F.col("_has").isNull(), 1)).alias("missing"))


def missing_files(labels: DataFrame, clips: DataFrame) -> DataFrame:
    """The complement of ``match_files``."""
    have = clips.select(_base(F.col("file")).alias("_base")).distinct()
    return labels.withColumn("_base", _base(F.col("file"))).join(have, "_base", "left_anti").drop("_base")


def resolve_paths(labels: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """The best path for each label: root/base, root/0/base, root/file, then any file of that base name."""
    base = F.element_at(F.split("file", "/"), -1)
    rows = labels.withColumn("_base", base)
    have = files.select("path", F.element_at(F.split("path", "/"), -1).alias("_base"))
    found = rows.select("file", "_base").distinct().join(have, "_base")
    order = F.when(F.col("path") == F.concat(F.lit(root + "/"), F.col("_base")), 0).when(F.col("path") == F.concat(F.lit(root + "/0/"), F.col("_base")), 1).when(F.col("path") == F.concat(F.lit(root + "/"), F.col("file")), 2).otherwise(3)
    best = found.groupBy("file").agg(F.min(F.struct(order.alias("p"), "path")).alias("b"))
    return labels.join(best.select("file", F.col("b.path").alias("path")), "file", "left")


def lookup_labels(df: DataFrame, ref: DataFrame, id_col: str, key: str, name: str, out: str) -> DataFrame:
    """``out``: the name of ``id_col`` in ``ref``, or ``Unknown``."""
    names = ref.groupBy(F.col(key).alias("_k")).agg(F.max(name).alias("_n"))
    return df.join(names, F.col(id_col) == F.col("_k"), "left").withColumn(out, F.coalesce("_n", F.lit("Unknown"))).drop("_k", "_n")


def contains_any(text: Column, words: list[str]) -> Column:
    """Whether ``text`` holds one of ``words``: one automaton of all words, built once a task, reads each text once."""
    words = sorted(set(words))

    @F.pandas_udf("boolean")
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for word in filter(None, words):
            automaton.add_word(word)
        automaton.make_automaton()
        every = "" in words
        has = lambda t: t is not None and (every or (len(automaton) > 0 and next(automaton.iter(t), None) is not None))
        for texts in parts:
            yield texts.map(has).astype(bool)

    return found(text)


def restrict_pairs(labels: DataFrame, ref: DataFrame, cats: list | None = None, glosses: list | None = None) -> DataFrame:
    """Rows whose category and gloss are allowed; lists hold ids or names. An empty list allows all.

    A gloss name that is not in ``ref`` allows the glosses of all rows whose file name contains it.
    Category names of which none is known raise an error. Repeated rows stay; rows of a null id are
    allowed only by an empty list.
    """

    def ids(values: list | None, key: str, name: str) -> tuple[list[int], list[str], list[int]]:
        """Ids asked for, names asked for, and the ids of known names: as many as were asked for, about."""
        texts = sorted({v.upper() for v in values or [] if not isinstance(v, int)})
        wanted = labels.sparkSession.createDataFrame([(t,) for t in texts], "_name string")
        known = ref.select(F.col(key).alias("id"), F.upper(name).alias("_name")).join(F.broadcast(wanted), "_name").distinct().collect() if texts else []
        return [v for v in values or [] if isinstance(v, int)], [t for t in texts if t not in {r[0] for r in known}], [r.id for r in known if r.id is not None]

    asked, strange, named = ids(cats, "cat_id", "category")
    if cats and strange and not asked and not named:
        raise ValueError(f"no known category in {strange}")
    out = labels.filter(F.col("cat").isin(asked + named)) if cats else labels
    if not glosses:
        return out
    asked, strange, named = ids(glosses, "gloss_id", "label")
    spark = labels.sparkSession
    allowed = spark.createDataFrame([(i,) for i in asked + named], "gloss long")
    if strange:
        matched = labels.filter(contains_any(F.upper("file"), strange)).select(F.col("gloss").cast("long").alias("gloss"))
        allowed = allowed.union(matched).distinct()
    if not asked and not named and strange and allowed.isEmpty():
        return out  # nothing is known of any name: it restricts nothing
    return out.join(allowed, "gloss", "left_semi").select(*labels.columns)


def missing_classes(labels: DataFrame, n: int, col: str = "gloss") -> DataFrame:
    """Classes 0 to n - 1 that no label has."""
    every = labels.sparkSession.range(n).select(F.col("id").cast("int").alias(col))
    return every.join(labels.select(col).distinct(), col, "left_anti")


def class_distribution(labels: DataFrame, col: str = "gloss") -> DataFrame:
    """Classes, rows, least, most, mean and sample deviation of class counts, and their variation with a warning above 0.5."""
    counts = labels.groupBy(col).count()
    stats = counts.agg(F.count("*").alias("classes"), F.sum("count").alias("rows"), F.min("count").alias("min"), F.max("count").alias("max"), F.avg("count").alias("mean"), F.stddev("count").alias("std"))
    return stats.withColumn("cv", F.col("std") / F.col("mean")).withColumn("imbalanced", F.col("cv") > 0.5)


def validate_labels(labels: DataFrame, n_gloss: int, n_cat: int) -> DataFrame:
    """Labels with null ids as 0; ids beyond the class counts raise an error."""
    missing = {"file", "gloss", "cat"} - set(labels.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    top = labels.agg(F.max("gloss").alias("g"), F.max("cat").alias("c")).first()
    if (top.g or 0) >= n_gloss or (top.c or 0) >= n_cat:
        raise ValueError(f"class ids out of range: gloss {top.g} of {n_gloss}, cat {top.c} of {n_cat}")
    return labels.fillna(0, ["gloss", "cat"])


def stratified_split(labels: DataFrame, ratio: float = 0.8, seed: int = 42, key: str = "file", by: str = "gloss") -> DataFrame:
    """``split``: train or val, stratified by class with largest-remainder quotas and a seeded hash order.

    A ``split`` column that is there already is kept; rows with other values drop out. It is an
    error if a class has one row only, or a side fewer rows than there are classes. No task sorts
    more than a slice of a class.
    """
    if "split" in labels.columns:
        return labels.filter(F.col("split").isin("train", "val"))
    counts = labels.groupBy(by).count()
    n = F.sum("count").over(Window.partitionBy())  # over classes, not rows
    train = n - F.ceil(F.round(n * (1 - ratio), 9))
    exact = F.col("count") * train / n
    quota = counts.withColumns({"_floor": F.floor(exact), "_rest": exact - F.floor(exact), "_train": train, "_n": n})
    side = quota.agg(F.min("count").alias("least"), F.count("*").alias("classes"), F.max("_train").alias("train"), F.max("_n").alias("n")).first()
    if side.classes and side.least < 2:
        raise ValueError(f"a class of {by} has a single row")
    if side.classes and min(side.train, side.n - side.train) < side.classes:
        raise ValueError(f"{side.train} and {side.n - side.train} rows are too few for {side.classes} classes")
    left = F.col("_train") - F.sum("_floor").over(Window.partitionBy())
    rank = F.row_number().over(Window.partitionBy().orderBy(F.desc(F.round("_rest", 9)), by))
    quota = quota.withColumn("_quota", F.col("_floor") + (rank <= left).cast("long")).select(by, "_quota")
    # A row's place in the hash order of its class: the rows of lower slices of the hash, and its place in its own.
    rows = labels.withColumn("_h", A.hash_unit(F.col(key), seed)).withColumn("_slice", F.shiftright("_h", 32 - SLICE_BITS))
    slices = rows.groupBy(by, "_slice").agg(F.count("*").alias("_m"))
    lower = Window.partitionBy(by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # over slices, not rows
    slices = slices.withColumn("_before", F.coalesce(F.sum("_m").over(lower), F.lit(0))).join(quota, by).select(by, "_slice", "_before", "_quota")
    own = F.row_number().over(Window.partitionBy(by, "_slice").orderBy("_h", key))
    placed = rows.withColumn("_own", own).join(slices, [by, "_slice"])
    split = F.when(F.col("_before") + F.col("_own") <= F.col("_quota"), "train").otherwise("val")
    return placed.withColumn("split", split).select(*labels.columns, "split")


def shuffle_rows(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """All rows in a seeded order."""
    return df.orderBy(A.hash_unit(F.col(key), seed), key)


def number_clips(files: DataFrame, ref: DataFrame, suffix: str = ".MOV") -> DataFrame:
    """``number`` and ``name`` (clip_NNNN_label): by id, numeric stems first; unknown ids are left out and use no number."""
    known = files.join(ref.select(F.col("id"), "label"), "id").select("id", "stem", "label")
    numeric = F.col("stem").cast("string").rlike("^[0-9]+$")
    placed = dense_number(known, [F.col("id"), (~numeric).cast("int"), F.expr("try_cast(stem AS bigint)"), F.col("stem")], "number")
    most = placed.agg(F.max("number").alias("most"))
    width = F.greatest(F.lit(4), F.length(F.col("most").cast("string")))
    name = F.concat(F.lit("clip_"), F.lpad(F.col("number").cast("string"), width, F.lit("0")), F.lit("_"), A.slugify(F.col("label")), F.lit(suffix))
    return placed.crossJoin(F.broadcast(most)).select("id", "stem", "number", name.alias("name"))  # one row


def unique_names(files: DataFrame) -> DataFrame:
    """``name``: the stem for its first holder, with 8 digits of md5(path) for later ones."""
    placed = dense_number(files, [F.col("stem"), F.col("path")], "_n")
    first = placed.groupBy("stem").agg(F.min("_n").alias("_n")).select("_n", F.lit(True).alias("_first"))
    later = F.concat("stem", F.lit("-"), F.substring(F.md5(F.col("path").cast("binary")), 1, 8))
    # Numbers are unique: a stem of many rows fills no task.
    return placed.join(first, "_n", "left").withColumn("name", F.when(F.col("_first"), F.col("stem")).otherwise(later)).select(*files.columns, "name")


def encode_categories(labels: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
    """``col`` as integers: kept where all values are integers, else places in the sorted distinct values; and the mapping."""
    values = labels.select(F.trim(F.col(col).cast("string")).alias("value")).filter("value IS NOT NULL").distinct()
    textual = not values.filter(~F.col("value").rlike("^-?[0-9]+$")).isEmpty()
    mapping = dense_number(values, [F.col("value")], "code").withColumn("code", F.col("code") - 1) if textual else values.withColumn("code", F.col("value").cast("int"))
    out = labels.join(mapping, F.trim(F.col(col).cast("string")) == F.col("value"), "left").withColumn(col, F.col("code")).drop("value", "code")
    return out, mapping


def pair_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("cat", "gloss").intersect(b.select("cat", "gloss"))


def class_difference(expected: DataFrame, actual: DataFrame, col: str = "gloss") -> DataFrame:
    return expected.select(col).subtract(actual.select(col))
