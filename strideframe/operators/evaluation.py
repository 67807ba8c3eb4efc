"""Classification reports from prediction records, all from one confusion count."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.functions import arrays as A
from strideframe.operators.quantiles import percentiles

#: Bounds of the F1 tiers and of the verdicts.
TIERS = ((0.8, "excellent"), (0.6, "good"), (0.4, "fair"))
VERDICTS = {"gloss_accuracy": (0.8, 0.6, 0.4), "cat_accuracy": (0.7, 0.5, 0.3), "kappa": (0.8, 0.6, 0.4)}


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def confusion(preds: DataFrame, y: str = "gloss_gt", yhat: str = "gloss_pred", by: tuple[str, ...] = ()) -> DataFrame:
    """``n`` of each (true, predicted) pair that occurs."""
    return preds.groupBy(*by, F.col(y).alias("y"), F.col(yhat).alias("yhat")).agg(F.count("*").alias("n"))


def confusion_matrix(conf: DataFrame) -> DataFrame:
    """All pairs of occurring labels with ``n`` and ``share`` of the true class (NaN without rows)."""
    labels = conf.select("y").union(conf.select("yhat")).distinct()
    grid = labels.crossJoin(labels.select(F.col("y").alias("yhat")))  # classes only
    rows = grid.join(conf, ["y", "yhat"], "left").fillna(0, ["n"])
    support = conf.groupBy("y").agg(F.sum("n").alias("s"))
    rows = rows.join(support, "y", "left")
    return rows.select("y", "yhat", "n", F.when(F.col("s") > 0, F.col("n") / F.col("s")).otherwise(float("nan")).alias("share"))


def confusion_highlights(conf: DataFrame) -> DataFrame:
    """Diagonal accuracy, most frequent class, most and least accurate class."""
    per = conf.groupBy("y").agg(F.sum("n").alias("s"), F.sum(F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(0)).alias("tp"))
    per = per.withColumn("acc", F.col("tp") / F.col("s"))
    return per.agg(
        (F.sum("tp") / F.sum("s")).alias("accuracy"),
        F.max_by("y", F.struct("s", -F.col("y"))).alias("most_frequent"),
        F.max_by("y", F.struct("tp", -F.col("y"))).alias("best_predicted"),
        F.max_by("y", F.struct("acc", -F.col("y"))).alias("most_accurate"),
        F.min_by("y", F.struct("acc", "y")).alias("least_accurate"),
    )


def _per_class(conf: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    n = F.col("n")
    tp = F.when(F.col("y") == F.col("yhat"), n).otherwise(0)
    # One pass: each confusion cell counts for its true and for its predicted class.
    sides = F.array(F.struct(F.col("y").alias("cls"), tp.alias("tp"), n.alias("support"), F.lit(0).cast("long").alias("predicted")), F.struct(F.col("yhat").alias("cls"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("support"), n.alias("predicted")))
    long = conf.select(*by, F.explode(sides).alias("one_side")).select(*by, "one_side.*")
    per = long.groupBy(*by, "cls").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))
    p, r = _ratio(F.col("tp"), F.col("predicted")), _ratio(F.col("tp"), F.col("support"))
    return per.withColumn("precision", p).withColumn("recall", r).withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def classification_report(preds: DataFrame, y: str = "gloss_gt", yhat: str = "gloss_pred") -> DataFrame:
    """Precision, recall, F1 and support of each class that occurs as truth or prediction."""
    return report_of(confusion(preds, y, yhat))


def report_of(conf: DataFrame) -> DataFrame:
    """``classification_report`` from counts of pairs."""
    return _per_class(conf).select("cls", "precision", "recall", "f1", "support")


def report_averages(report: DataFrame) -> DataFrame:
    """Macro and weighted averages of a report."""
    stats = ("precision", "recall", "f1")
    macro = report.agg(*[F.avg(c).alias(c) for c in stats], F.sum("support").alias("support")).withColumn("average", F.lit("macro"))
    weighted = report.agg(*[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in stats], F.sum("support").alias("support")).withColumn("average", F.lit("weighted"))
    return macro.unionByName(weighted).select("average", *stats, "support")


def _overall(per: DataFrame, by: tuple[str, ...], prefix: str) -> DataFrame:
    weighted = lambda c: F.sum(F.col(c) * F.col("support")) / F.sum("support")
    return per.groupBy(*by).agg((F.sum("tp") / F.sum("support")).alias(f"{prefix}_accuracy"), *[weighted(c).alias(f"{prefix}_{c}") for c in ("precision", "recall", "f1")], F.sum("support").alias(f"{prefix}_n"))


def overall_metrics(preds: DataFrame) -> DataFrame:
    """One row: accuracy, weighted precision, recall and F1 of both heads, rows; nulls without rows."""
    return overall_of(*[confusion(preds, f"{h}_gt", f"{h}_pred") for h in ("gloss", "cat")])


def overall_of(gloss: DataFrame, cat: DataFrame) -> DataFrame:
    """``overall_metrics`` from the counts of pairs of both heads."""
    heads = [_overall(_per_class(conf), (), h) for h, conf in (("gloss", gloss), ("cat", cat))]
    both = heads[0].crossJoin(heads[1])  # one row each
    return both.withColumn("n", F.coalesce("gloss_n", F.lit(0))).drop("gloss_n", "cat_n")


def segment_metrics(preds: DataFrame) -> DataFrame:
    """``overall_metrics`` for all rows, occluded and non-occluded ones: ``segment`` and the metrics; absent segments have no row."""
    return segments_of(*[confusion(preds, f"{h}_gt", f"{h}_pred", ("occluded",)) for h in ("gloss", "cat")])


def segments_of(gloss: DataFrame, cat: DataFrame) -> DataFrame:
    """``segment_metrics`` from the counts of pairs of both heads by ``occluded``."""

    def head(h: str, conf: DataFrame) -> DataFrame:
        segments = F.array(F.lit("overall"), F.when(F.col("occluded") == 1, "occluded").otherwise("non_occluded"))
        conf = conf.select(F.explode(segments).alias("segment"), "y", "yhat", "n").groupBy("segment", "y", "yhat").agg(F.sum("n").alias("n"))
        return _overall(_per_class(conf, ("segment",)), ("segment",), h)

    return head("gloss", gloss).join(head("cat", cat), "segment").withColumn("n", F.col("gloss_n")).drop("gloss_n", "cat_n")


def segment_differences(segments: DataFrame) -> DataFrame:
    """Metrics of the non-occluded less those of the occluded segment; nulls where one is empty."""
    names = [c for c in segments.columns if c not in ("segment", "n")]
    of = lambda s, c: F.max(F.when(F.col("segment") == s, F.col(c)))
    return segments.agg(*[(of("non_occluded", c) - of("occluded", c)).alias(c) for c in names])


def agreement(preds: DataFrame, y: str = "gloss_gt", yhat: str = "gloss_pred") -> DataFrame:
    """Cohen's kappa and the multiclass Matthews correlation; 0 where the denominator is."""
    return agreement_of(confusion(preds, y, yhat))


def agreement_of(conf: DataFrame) -> DataFrame:
    """``agreement`` from counts of pairs."""
    per = _per_class(conf)
    s = per.agg(*[F.sum(c).cast("double").alias(a) for c, a in (("tp", "c"), ("support", "s"))], *[F.sum(F.col(a).cast("double") * F.col(b)).alias(n) for a, b, n in (("predicted", "support", "pt"), ("predicted", "predicted", "pp"), ("support", "support", "tt"))])
    c, n, pt, pp, tt = map(F.col, ("c", "s", "pt", "pp", "tt"))
    pe = pt / (n * n)
    mcc = F.sqrt((n * n - pp) * (n * n - tt))
    return s.select(F.when(pe == 1, 0.0).otherwise((c / n - pe) / (1 - pe)).alias("kappa"), F.when(mcc == 0, 0.0).otherwise((c * n - pt) / mcc).alias("mcc"))


def _ranked_above(probs: str, y: str) -> Column:
    """How many classes rank before the true one."""
    own = F.element_at(F.col(probs), (F.col(y) + 1).cast("int"))
    return F.size(F.filter(F.transform(probs, lambda p, i: (p > own) | ((p == own) & (i < F.col(y)))), lambda b: b))


def top_k_accuracy(df: DataFrame, probs: str, y: str, ks: tuple[int, ...] = (3, 5)) -> DataFrame:
    """Share of rows whose class is among the k best; ties rank by class id."""
    rows = df.select(_ranked_above(probs, y).alias("above"))
    return rows.agg(*[F.avg((F.col("above") < k).cast("double")).alias(f"top{k}_accuracy") for k in ks])


#: Cumulative Poisson(1) probabilities.
POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940581, 0.99991675)
#: A prime below 2**31: two products of numbers below it add up to less than 2**63.
PRIME = 2147483647
#: Rows that are weighed at a time, against all resamples: one matrix of integers that stays in a core's cache.
STRATA = 128


def _weighed(batches: Iterator[pa.RecordBatch], n: int, rows: int) -> Iterator[pa.RecordBatch]:
    """For rows of (a, b, right of each head): ``rep``, the sum of the weights, and of those of the right rows of each head.

    The weight is the number of ``POISSON`` steps that (a c + b d) mod ``PRIME`` reaches, c and d being those of the resample.
    """
    rep = np.arange(1, n + 1, dtype=np.uint64)
    prime, c, d = np.uint64(PRIME), (rep * 1103515245 + 12345) % PRIME, (rep * rep * 69069 + rep * 362437 + 1) % PRIME
    sums = None
    for batch in batches:
        a, b, *right = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
        sums = np.zeros((1 + len(right), n), np.int64) if sums is None else sums
        counted = np.stack([np.ones(len(a), np.float32), *[np.nan_to_num(x).astype(np.float32) for x in right]])
        a, b = a.astype(np.uint64), b.astype(np.uint64)
        for at in range(0, len(a), rows):
            u = a[at : at + rows, None] * c + b[at : at + rows, None] * d
            u = (u & prime) + (u >> np.uint64(31))  # 2**31 is 1 modulo this prime
            u = ((u & prime) + (u >> np.uint64(31))).astype(np.uint32)
            u[u >= PRIME] -= np.uint32(PRIME)
            weight = np.zeros(u.shape, np.uint8)
            for step in POISSON:
                weight += u >= np.uint32(step * PRIME)
            sums += (counted[:, at : at + rows] @ weight.astype(np.float32)).astype(np.int64)
    if sums is not None:
        yield pa.RecordBatch.from_arrays([pa.array(rep.astype(np.int64)), *map(pa.array, sums)], ["rep", "total", *[f"h{i}" for i in range(len(sums) - 1)]])


def _resampled(preds: DataFrame, right: dict[str, Column], key: str, n: int, seed: int) -> DataFrame:
    """The accuracy of each head in each of ``n`` resamples: ``rep`` and one column a head.

    Every row has a weight of its own in every resample. A row is hashed once; its weight is then
    a step of a linear combination of the two halves of its hash, so all is plain integers. The rows
    are dealt over all cores, as a row costs as much as its resamples, and a task gives one sum a
    resample and head. A resample in which all weights are zero has no number.
    """
    digest = lambda i: F.conv(F.substring(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))).cast("binary")), i, 8), 16, 10).cast("long")
    rows = preds.select((digest(1) % PRIME).alias("a"), (digest(9) % PRIME).alias("b"), *[c.cast("int").alias(h) for h, c in right.items()])
    rows = rows.repartition(preds.sparkSession.sparkContext.defaultParallelism)
    heads, strata = [f"h{i}" for i in range(len(right))], STRATA
    parts = rows.mapInArrow(lambda batches: _weighed(batches, n, strata), ", ".join(f"{c} long" for c in ("rep", "total", *heads)))
    sums = parts.groupBy("rep").agg(F.sum("total").alias("total"), *[F.sum(h).alias(h) for h in heads])
    return sums.select("rep", *[F.when(F.col("total") == 0, F.lit(float("nan"))).otherwise(F.col(h) / F.nullif(F.col("total"), F.lit(0))).alias(c) for h, c in zip(heads, right, strict=True)])


def bootstrap_ci(preds: DataFrame, key: str = "clip_id", y: str = "gloss_gt", yhat: str = "gloss_pred", n: int = 1000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """Percentile interval of the accuracy over ``n`` seeded Poisson resamples."""
    reps = _resampled(preds, {"acc": F.col(y) == F.col(yhat)}, key, n, seed)
    tail = (1 - level) / 2
    return reps.agg(F.avg("acc").alias("mean"), F.percentile("acc", tail).alias("low"), F.percentile("acc", 1 - tail).alias("high"))


def sample_losses(df: DataFrame, logits: str, y: str, gamma: float = 2.0, alpha: float = 1.0, smoothing: float = 0.1) -> DataFrame:
    """Adds ``ce``, ``focal`` and ``smoothed`` losses of each row."""
    df = df.withColumn("_lp", A.log_softmax(A.double(F.col(logits))))
    nll = -F.element_at("_lp", (F.col(y) + 1).cast("int"))
    mean = -A.total(F.col("_lp")) / F.size("_lp")
    return df.withColumns({"ce": nll, "focal": alpha * F.pow(1 - F.exp(-nll), gamma) * nll, "smoothed": (1 - smoothing) * nll + smoothing * mean}).drop("_lp")


def loss_metrics(losses: DataFrame, batch: str | None = None) -> DataFrame:
    """Mean losses over rows, or over the means of batches."""
    names = ("ce", "focal", "smoothed")
    if batch:
        losses = losses.groupBy(batch).agg(*[F.avg(c).alias(c) for c in names])
    return losses.agg(*[F.avg(c).alias(c) for c in names])


def confused_pairs(preds: DataFrame, n: int = 10, y: str = "gloss_gt", yhat: str = "gloss_pred") -> DataFrame:
    """The ``n`` most frequent wrong pairs."""
    return pairs_of(confusion(preds, y, yhat), n)


def pairs_of(conf: DataFrame, n: int = 10) -> DataFrame:
    """``confused_pairs`` from counts of pairs."""
    return top_n(conf.filter("y <> yhat"), "n", n, ("y", "yhat"))


def error_summary(preds: DataFrame, y: str = "gloss_gt", yhat: str = "gloss_pred") -> DataFrame:
    wrong = F.count(F.when(F.col(y) != F.col(yhat), 1))
    return preds.agg(F.count("*").alias("total"), wrong.alias("errors"), (wrong / F.count("*")).alias("error_rate"))


def confidence_stats(preds: DataFrame, p: str = "gloss_prob") -> DataFrame:
    """Mean, quartiles, deviation and range of ``p``; the quartiles are exact, without all values in one task."""
    others = [F.avg(p).alias("mean"), F.stddev_pop(p).alias("std"), F.min(p).alias("min"), F.max(p).alias("max")]
    return percentiles(preds, [], p, {"median": 0.5, "p25": 0.25, "p75": 0.75}, *others)


def accuracy_by_confidence(preds: DataFrame, p: str = "gloss_prob", y: str = "gloss_gt", yhat: str = "gloss_pred", above=(0.5, 0.6, 0.7, 0.8, 0.9)) -> DataFrame:
    """Accuracy and rows above each threshold that rows exceed."""
    rows = preds.select(F.col(p).alias("p"), (F.col(y) == F.col(yhat)).cast("double").alias("ok"))
    return rows.select("ok", F.explode(F.filter(F.array(*map(F.lit, above)), lambda t: F.col("p") > t)).alias("threshold")).groupBy("threshold").agg(F.avg("ok").alias("accuracy"), F.count("*").alias("n"))


def confidence_errors(preds: DataFrame, p: str = "gloss_prob", y: str = "gloss_gt", yhat: str = "gloss_pred") -> DataFrame:
    """Error rates below 0.5 and above 0.8."""
    wrong = (F.col(y) != F.col(yhat)).cast("double")
    return preds.agg(F.avg(F.when(F.col(p) < 0.5, wrong)).alias("low_confidence_error"), F.avg(F.when(F.col(p) > 0.8, wrong)).alias("high_confidence_error"))


def rare_class_error(preds: DataFrame, y: str = "gloss_gt", yhat: str = "gloss_pred") -> DataFrame:
    """Classes whose count is at most the lower quartile of class counts, and their error rate."""
    per = preds.groupBy(F.col(y).alias("cls")).agg(F.count("*").alias("n"), F.sum((F.col(y) != F.col(yhat)).cast("long")).alias("wrong"))
    cut = per.agg(F.percentile("n", 0.25).alias("cut"))
    rare = per.crossJoin(F.broadcast(cut)).filter("n <= cut")  # one row
    return rare.agg(F.count("*").alias("rare_classes"), F.sum("n").alias("n"), (F.sum("wrong") / F.sum("n")).alias("error_rate"))


def class_tiers(report: DataFrame) -> DataFrame:
    """A report with ``balanced`` (mean of precision and recall), ``tier`` and ``problem`` (F1 below 0.5)."""
    tier = F.lit("poor")
    for bound, name in reversed(TIERS):
        tier = F.when(F.col("f1") >= bound, name).otherwise(tier)
    return report.withColumns({"balanced": (F.col("precision") + F.col("recall")) / 2, "tier": tier, "problem": F.col("f1") < 0.5})


def tier_counts(tiers: DataFrame) -> DataFrame:
    n = tiers.groupBy("tier").agg(F.count("*").alias("classes"))
    return n.withColumn("share", F.col("classes") / F.sum("classes").over(Window.partitionBy()))  # four rows


def f1_stats(report: DataFrame) -> DataFrame:
    return report.agg(F.avg("f1").alias("mean"), F.stddev("f1").alias("std"), F.percentile("f1", 0.5).alias("median"), F.min("f1").alias("min"), F.max("f1").alias("max"))


def overall_tiers(summary: DataFrame) -> DataFrame:
    """``metric``, ``value``, ``verdict`` for gloss and category accuracy and kappa."""
    rows = []
    for metric, bounds in VERDICTS.items():
        verdict = F.lit("poor")
        for bound, name in zip(reversed(bounds), ("fair", "good", "excellent"), strict=True):
            verdict = F.when(F.col(metric) > bound, name).otherwise(verdict)
        rows.append(F.struct(F.lit(metric).alias("metric"), F.col(metric).alias("value"), verdict.alias("verdict")))
    return summary.select(F.explode(F.array(*rows)).alias("one_row")).select("one_row.*")


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Equal-width bins between the least and the largest value, the last one closed: ``bin`` from 0, ``low``, ``high``, ``n``."""
    ends = df.agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    place = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col(col) - F.col("_lo")) / width))).otherwise(0).cast("int")
    rows = df.filter(F.col(col).isNotNull()).crossJoin(F.broadcast(ends))  # one row
    counts = rows.groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = every.join(counts, "bin", "left").fillna(0, ["n"]).crossJoin(F.broadcast(ends))
    return out.select("bin", (F.col("_lo") + F.col("bin") * width).alias("low"), (F.col("_lo") + (F.col("bin") + 1) * width).alias("high"), "n")


def compare_models(preds: DataFrame, logits: str | None = None) -> DataFrame:
    """One row for each model: rows, gloss and category accuracy, mean confidence.

    With the name of a column of gloss ``logits`` also ``gloss_top3_accuracy``,
    ``gloss_top5_accuracy`` and ``loss``, the mean cross-entropy.
    """
    right = lambda h: F.avg((F.col(f"{h}_gt") == F.col(f"{h}_pred")).cast("double")).alias(f"{h}_accuracy")
    more = []
    if logits:
        preds = sample_losses(preds.withColumn("_above", _ranked_above(logits, "gloss_gt")), logits, "gloss_gt")
        more = [*[F.avg((F.col("_above") < k).cast("double")).alias(f"gloss_top{k}_accuracy") for k in (3, 5)], F.avg("ce").alias("loss")]
    return preds.groupBy("model").agg(F.count("*").alias("n"), right("gloss"), right("cat"), F.avg("gloss_prob").alias("mean_confidence"), *more)


def metrics_long(compared: DataFrame) -> DataFrame:
    """``model``, ``metric``, ``value`` rows."""
    return compared.unpivot("model", [c for c in compared.columns if c not in ("model", "n")], "metric", "value")


def metrics_by_model(long: DataFrame, models: list[str]) -> DataFrame:
    """``metric`` and one column for each model."""
    return long.groupBy("metric").pivot("model", models).agg(F.first("value"))


def scaffold_classes(report: DataFrame, n: int) -> DataFrame:
    """A report with every class 0 to n - 1, zeros where a class is absent."""
    every = report.sparkSession.range(n).select(F.col("id").cast("int").alias("cls"))
    return every.join(report, "cls", "left").fillna(0)


def compare_per_class(a: DataFrame, b: DataFrame, metric: str = "f1") -> DataFrame:
    """``cls`` with the metric in both reports and the difference b - a."""
    left, right = a.select("cls", F.col(metric).alias("a")), b.select("cls", F.col(metric).alias("b"))
    return left.join(right, "cls", "full").withColumn("difference", F.col("b") - F.col("a"))


def union_runs(**runs: DataFrame) -> DataFrame:
    """Predictions of several runs, tagged by ``model``."""
    frames = [df.withColumn("model", F.lit(name)) for name, df in runs.items()]
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def top_n(df: DataFrame, col: str, n: int, ties: tuple[str, ...] = ()) -> DataFrame:
    """The ``n`` rows with the largest ``col``, ties in ascending order of the other columns named."""
    return df.orderBy(F.desc(col), *ties).limit(n)


def performance_summary(preds: DataFrame, logits: str | None = None, key: str = "clip_id", n: int = 1000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """``metric``, ``value``, ``percentage`` and ``confidence_interval`` texts of the metrics of both heads.

    Loss and top-k rows need a column of gloss ``logits`` and have a null value without. The
    interval is that of ``n`` bootstrap resamples for the accuracies, ``N/A`` for the others.
    """
    one = overall_metrics(preds).drop("n")
    for h in ("gloss", "cat"):
        one = one.crossJoin(agreement(preds, f"{h}_gt", f"{h}_pred").toDF(f"{h}_kappa", f"{h}_mcc"))  # one row each
    tail = (1 - level) / 2
    reps = _resampled(preds, {h: F.col(f"{h}_gt") == F.col(f"{h}_pred") for h in ("gloss", "cat")}, key, n, seed)
    one = one.crossJoin(reps.agg(*[F.percentile(h, q).alias(f"{h}_{side}") for h in ("gloss", "cat") for side, q in (("low", tail), ("high", 1 - tail))]))
    if logits:
        one = one.crossJoin(top_k_accuracy(preds, logits, "gloss_gt").crossJoin(sample_losses(preds, logits, "gloss_gt").agg(F.avg("ce").alias("loss"))))
    else:
        one = one.withColumns({c: F.lit(None).cast("double") for c in ("loss", "top3_accuracy", "top5_accuracy")})
    #: Names of the rows.
    rows = (
        ("Test Loss", "loss"),
        ("Gloss Accuracy", "gloss_accuracy"),
        ("Category Accuracy", "cat_accuracy"),
        ("Gloss Top-3 Accuracy", "top3_accuracy"),
        ("Gloss Top-5 Accuracy", "top5_accuracy"),
        ("Gloss Cohen's Kappa", "gloss_kappa"),
        ("Category Cohen's Kappa", "cat_kappa"),
        ("Gloss Matthews Correlation", "gloss_mcc"),
        ("Category Matthews Correlation", "cat_mcc"),
    )

    def row(name: str, c: str) -> Column:
        v = F.col(c)
        text = F.format_string("%.2f", F.round(v, 2)) if c == "loss" else F.format_string("%.2f%%", F.round(v * 100, 2))
        head = c.removesuffix("_accuracy")
        span = F.format_string("[%.4f, %.4f]", F.round(F.col(f"{head}_low"), 4), F.round(F.col(f"{head}_high"), 4)) if c in ("gloss_accuracy", "cat_accuracy") else F.lit("N/A")
        return F.struct(F.lit(name).alias("metric"), v.alias("value"), F.when(v.isNotNull(), text).alias("percentage"), span.alias("confidence_interval"))

    return one.select(F.explode(F.array(*[row(*r) for r in rows])).alias("one_row")).select("one_row.*")


def format_predictions(preds: DataFrame, ref: DataFrame) -> DataFrame:
    """Nested records: file, ground truth, prediction and correctness, with ``LABEL (id)`` texts.

    Where ``preds`` has them, ``occluded`` is part of the ground truth, and the best classes
    ``gloss_top`` and ``cat_top`` (arrays of id and prob) become ``gloss_top`` and ``category_top``
    with such texts.
    """
    gloss = ref.groupBy("gloss_id").agg(F.max("label").alias("label"))
    cats = ref.groupBy("cat_id").agg(F.max("category").alias("category"))

    def named(df: DataFrame, names: DataFrame, key: str, name: str, col: str) -> DataFrame:
        text = F.concat(F.coalesce(F.col("_n"), F.lit("Unknown")), F.lit(" ("), F.col(col).cast("string"), F.lit(")"))
        return df.join(names.select(F.col(key).alias("_k"), F.col(name).alias("_n")), F.col(col) == F.col("_k"), "left").withColumn(col + "_text", text).drop("_k", "_n")

    for col in ("gloss_gt", "gloss_pred"):
        preds = named(preds, gloss, "gloss_id", "label", col)
    for col in ("cat_gt", "cat_pred"):
        preds = named(preds, cats, "cat_id", "category", col)

    def top(col: str, known: str) -> Column:
        text = lambda i: F.concat(F.coalesce(F.col(known)[i], F.lit("Unknown")), F.lit(" ("), i.cast("string"), F.lit(")"))
        return F.transform(col, lambda t: F.struct(text(t["id"]).alias("label"), t["prob"].alias("prob")))

    tops = []
    for col, out, names, key, name in (("gloss_top", "gloss_top", gloss, "gloss_id", "label"), ("cat_top", "category_top", cats, "cat_id", "category")):
        if col in preds.columns:
            known = names.agg(F.map_from_entries(F.collect_list(F.struct(F.col(key).cast("int"), name))).alias(f"_{col}"))  # one row, classes only
            preds = preds.crossJoin(F.broadcast(known))
            tops.append(top(col, f"_{col}").alias(out))
    truth = [F.col("gloss_gt_text").alias("gloss"), F.col("cat_gt_text").alias("category"), *([F.col("occluded").cast("boolean").alias("occluded")] if "occluded" in preds.columns else [])]
    return preds.select(
        F.col("clip_id").alias("file"),
        F.struct(*truth).alias("ground_truth"),
        F.struct(F.col("gloss_pred_text").alias("gloss"), F.col("cat_pred_text").alias("category"), "gloss_prob", "cat_prob").alias("prediction"),
        F.struct((F.col("gloss_gt") == F.col("gloss_pred")).alias("gloss"), (F.col("cat_gt") == F.col("cat_pred")).alias("category")).alias("correct"),
        *tops,
    )


def ranked_labels(df: DataFrame, probs: str, k: int) -> DataFrame:
    """Rank table of the k best classes with percentage texts."""
    keep = [c for c in df.columns if c != probs]
    out = df.select(*keep, F.posexplode(A.top_k(F.col(probs), k)).alias("place", "t"))
    return out.select(*keep, (F.col("place") + 1).alias("rank"), F.col("t.id").alias("id"), F.col("t.prob").alias("prob"), F.format_string("%.1f%%", F.round(F.col("t.prob") * 100, 1)).alias("text"))


def filter_predictions(preds: DataFrame, result: str = "All", occluded: str = "All") -> DataFrame:
    """Rows by result (All, Correct Only, Incorrect Only: of the gloss) and occlusion (All, Occluded, Non-Occluded)."""
    right = F.col("gloss_gt") == F.col("gloss_pred")
    by_result = {"All": F.lit(True), "Correct Only": right, "Incorrect Only": ~right}[result]
    by_cover = {"All": F.lit(True), "Occluded": F.col("occluded") == 1, "Non-Occluded": F.col("occluded") == 0}[occluded]
    return preds.filter(by_result & by_cover)


def prediction_counts(preds: DataFrame) -> DataFrame:
    g, c = F.col("gloss_gt") == F.col("gloss_pred"), F.col("cat_gt") == F.col("cat_pred")
    return preds.agg(F.count("*").alias("total"), F.count(F.when(g, 1)).alias("correct_gloss"), F.count(F.when(c, 1)).alias("correct_cat"), F.count(F.when(g & c, 1)).alias("both_correct"))


def prediction_entropy(df: DataFrame, gloss: str, cat: str) -> DataFrame:
    """Entropies of the 5 and 3 best probabilities as they are, and the top confidences in percent."""
    g, c = (F.transform(A.top_k(F.col(p), k), lambda s: s["prob"]) for p, k in ((gloss, 5), (cat, 3)))
    return df.withColumns({"gloss_entropy": A.entropy(g), "cat_entropy": A.entropy(c), "gloss_confidence": g[0] * 100, "cat_confidence": c[0] * 100})
