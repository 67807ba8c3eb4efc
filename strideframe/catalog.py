"""All registered queries of the library and their SQL.

Each query reads the whole given tables through a derived input and applies one operator. Doubles
are rounded to six places so that sums in another order give equal rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.fixtures import duck, fixture
from strideframe.functions import arrays as A
from strideframe.operators import cube as K
from strideframe.operators import evaluation as E
from strideframe.operators import labels as L
from strideframe.operators import occlusion as O
from strideframe.operators import quality as Q
from strideframe.operators import runs as R
from strideframe.operators import scoring as U
from strideframe.operators import sequence as S
from strideframe.sources import clips as C
from strideframe.sources import tables as T
from strideframe.sources.staged import staged_folder

FLAGSHIP = "o7_occlusion"
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])

        _QUERIES[f.__name__] = run
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- inputs ------------------------------------------------------------------------------------


def preds(spark, sf):
    return fixture(spark, sf, "fx_predictions")


def labels(spark, sf):
    return fixture(spark, sf, "fx_labels")


def ref(spark, sf):
    return fixture(spark, sf, "fx_label_ref")


def points(spark, sf):
    return fixture(spark, sf, "fx_holistic")


def frames(spark, sf):
    return S.from_keypoints(points(spark, sf), dealt=True)


def keys(spark, sf):
    """Clip and number of each frame, without the cost of its arrays."""
    return points(spark, sf).select("clip_id", "frame_idx").distinct()


def vectors(spark, sf):
    return fixture(spark, sf, "fx_vec_frames").withColumn("x", A.double(F.col("x")))


def scored(spark, sf):
    """Predictions with gloss logits from the vectors: ten classes, about three of five right; a category is the gloss by parity."""
    lifted = F.transform(F.slice("x", 1, 10), lambda v, i: v + F.when((i == F.col("gloss")) & (F.col("frame_idx") % 10 < 6), 2.0).otherwise(0.0))
    df = vectors(spark, sf).select((F.col("clip_id") * 20 + F.col("frame_idx")).alias("clip_id"), "frame_idx", F.col("gloss").cast("int").alias("gloss_gt"), lifted.alias("logits"))
    df = A.once(df, gloss_pred=A.argmax(F.col("logits")), gloss_prob=F.array_max(A.softmax(F.col("logits"))))
    model = F.when(F.col("frame_idx") % 2 == 0, "A").otherwise("B")
    return df.withColumns({"model": model, "cat_gt": F.col("gloss_gt") % 2, "cat_pred": F.col("gloss_pred") % 2, "occluded": (F.col("clip_id") % 4 == 0).cast("int")})


def clip_meta(spark, sf):
    """One clip for each supplier with JSON of several qualities."""
    return spark.read.parquet(f"{sf}/supplier.parquet").selectExpr(
        "s_suppkey AS clip_id",
        """CASE s_suppkey % 6 WHEN 0 THEN '{"dims_per_frame": 156, "keypoints_total": "78", "order": "pose25,left_hand21,right_hand21,face11", "model_type": "T", "occluded_flag": 1}'
           WHEN 1 THEN '{"dims_per_frame": "156", "keypoints_total": 78, "order": "pose25,left_hand21,right_hand21,face11", "model_type": "B", "occluded_flag": 0}'
           WHEN 2 THEN '{"dims_per_frame": 150, "order": "other", "model_type": "I"}' WHEN 3 THEN '{"model_type": "Z"}' WHEN 4 THEN '{broken' ELSE NULL END AS meta""",
        "156 AS x_width",
        "CASE WHEN s_suppkey % 4 = 0 THEN 2048 ELSE 0 END AS x2048_width",
        "s_suppkey % 2 = 0 AS from_video",
    )


_META_SQL = """m AS (SELECT s_suppkey AS clip_id, s_suppkey % 6 AS k, CASE WHEN s_suppkey % 4 = 0 THEN 2048 ELSE 0 END AS x2048_width, s_suppkey % 2 = 0 AS from_video FROM supplier)"""
_FX = {n: duck(n) for n in ("fx_predictions", "fx_labels", "fx_label_ref", "fx_holistic", "fx_track", "fx_vec_frames")}
_P, _LB, _H, _TR, _V = (f"WITH {_FX[n]}" for n in ("fx_predictions", "fx_labels", "fx_holistic", "fx_track", "fx_vec_frames"))

_SCORED = f"""{_V}, sl AS (SELECT clip_id * 20 + frame_idx AS clip_id, frame_idx, gloss::INT AS gloss_gt, list_transform(x[1:10], lambda v, i: v::DOUBLE + CASE WHEN i = gloss + 1 AND frame_idx % 10 < 6 THEN 2.0 ELSE 0.0 END) AS logits FROM fx_vec_frames),
sz AS (SELECT *, ln(list_sum(list_transform(logits, lambda v: exp(v - list_max(logits))))) + list_max(logits) AS z, (list_position(logits, list_max(logits)) - 1)::INT AS gloss_pred, logits[gloss_gt + 1] AS own FROM sl),
fx_predictions AS (SELECT clip_id, CASE WHEN frame_idx % 2 = 0 THEN 'A' ELSE 'B' END AS model, gloss_gt, gloss_pred, gloss_gt % 2 AS cat_gt, gloss_pred % 2 AS cat_pred, exp(list_max(logits) - z) AS gloss_prob, z - own AS ce,
  len(list_filter(range(1, 11), lambda i: logits[i] > own OR (logits[i] = own AND i < gloss_gt + 1))) AS above FROM sz)"""

# --- evaluation --------------------------------------------------------------------------------


@query(f"{_LB}, c AS (SELECT gloss, count(*) AS n FROM fx_labels GROUP BY gloss) SELECT count(*) AS classes, cast(sum(n) AS BIGINT) AS rows, min(n) AS min, max(n) AS max, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, round(stddev_samp(n) / avg(n), 6) AS cv, stddev_samp(n) / avg(n) > 0.5 AS imbalanced FROM c")
def a1_class_distribution(spark, sf):
    return L.class_distribution(labels(spark, sf))


@query(f"{_P} SELECT gloss_gt AS y, gloss_pred AS yhat, count(*) AS n FROM fx_predictions GROUP BY 1, 2")
def a2_confusion(spark, sf):
    return E.confusion(preds(spark, sf))


@query(
    f"{_P}, c AS (SELECT cat_gt AS y, cat_pred AS yhat, count(*) AS n FROM fx_predictions GROUP BY 1, 2), l AS (SELECT y FROM c UNION SELECT yhat FROM c), s AS (SELECT y, sum(n) AS s FROM c GROUP BY y) "
    "SELECT a.y, b.y AS yhat, cast(coalesce(c.n, 0) AS BIGINT) AS n, round(CASE WHEN s.s > 0 THEN coalesce(c.n, 0) / cast(s.s AS DOUBLE) ELSE 'nan'::DOUBLE END, 6) AS share FROM l a CROSS JOIN l b LEFT JOIN c ON c.y = a.y AND c.yhat = b.y LEFT JOIN s ON s.y = a.y"
)
def a2_confusion_matrix(spark, sf):
    return E.confusion_matrix(E.confusion(preds(spark, sf), "cat_gt", "cat_pred"))


@query(
    f"{_P}, p AS (SELECT gloss_gt AS y, count(*) AS s, count(*) FILTER (gloss_gt = gloss_pred) AS tp FROM fx_predictions GROUP BY 1) "
    "SELECT round(sum(tp) / cast(sum(s) AS DOUBLE), 6) AS accuracy, arg_max(y, s * 1000 - y) AS most_frequent, arg_max(y, tp * 1000 - y) AS best_predicted, arg_max(y, (tp / cast(s AS DOUBLE), -y)) AS most_accurate, arg_min(y, (tp / cast(s AS DOUBLE), y)) AS least_accurate FROM p"
)
def a2_confusion_highlights(spark, sf):
    return E.confusion_highlights(E.confusion(preds(spark, sf)))


def _report_sql(y="gloss_gt", p="gloss_pred"):
    return f"""{_P}, g AS (SELECT {y} AS cls, count(*) AS support FROM fx_predictions GROUP BY 1), q AS (SELECT {p} AS cls, count(*) AS predicted FROM fx_predictions GROUP BY 1),
t AS (SELECT {y} AS cls, count(*) AS tp FROM fx_predictions WHERE {y} = {p} GROUP BY 1),
c AS (SELECT coalesce(g.cls, q.cls) AS cls, coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted FROM g FULL JOIN q ON g.cls = q.cls),
b AS (SELECT c.*, coalesce(tp, 0) AS tp FROM c LEFT JOIN t ON c.cls = t.cls),
pr AS (SELECT *, CASE WHEN predicted = 0 THEN 0.0::DOUBLE ELSE tp / predicted::DOUBLE END AS precision, CASE WHEN support = 0 THEN 0.0::DOUBLE ELSE tp / support::DOUBLE END AS recall FROM b),
rep AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0::DOUBLE ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM pr)"""


@query(_report_sql() + " SELECT cls, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM rep")
def a3_classification_report(spark, sf):
    return E.classification_report(preds(spark, sf))


@query(
    _report_sql()
    + " SELECT 'macro' AS average, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1, cast(sum(support) AS BIGINT) AS support FROM rep UNION ALL SELECT 'weighted', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), cast(sum(support) AS BIGINT) FROM rep"
)
def a3_report_averages(spark, sf):
    return E.report_averages(E.classification_report(preds(spark, sf)))


def _head_sql(h: str) -> str:
    return f"SELECT round(sum(tp) / sum(support)::DOUBLE, 6) AS {h}_accuracy, round(sum(precision * support) / sum(support), 6) AS {h}_precision, round(sum(recall * support) / sum(support), 6) AS {h}_recall, round(sum(f1 * support) / sum(support), 6) AS {h}_f1 FROM rep"


@query(f"SELECT g.*, c.*, (SELECT count(*) FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey) AS n FROM ({_report_sql()} {_head_sql('gloss')}) g, ({_report_sql('cat_gt', 'cat_pred')} {_head_sql('cat')}) c")
def a4_overall_metrics(spark, sf):
    return E.overall_metrics(preds(spark, sf))


def _segments_sql(round_to: int) -> str:
    def head(h: str) -> str:
        return f"""x_{h} AS (SELECT segment, {h}_gt AS y, {h}_pred AS yhat, count(*) AS n FROM s GROUP BY 1, 2, 3),
k_{h} AS (SELECT segment, cls, sum(tp) AS tp, sum(support) AS support, sum(predicted) AS predicted FROM (SELECT segment, y AS cls, CASE WHEN y = yhat THEN n ELSE 0 END AS tp, n AS support, 0 AS predicted FROM x_{h} UNION ALL SELECT segment, yhat, 0, 0, n FROM x_{h}) GROUP BY 1, 2),
p_{h} AS (SELECT *, CASE WHEN predicted = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / predicted END AS pr, CASE WHEN support = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / support END AS re FROM k_{h}),
m_{h} AS (SELECT segment, round(sum(tp)::DOUBLE / sum(support)::DOUBLE, {round_to}) AS {h}_accuracy, round(sum(pr * support) / sum(support), {round_to}) AS {h}_precision, round(sum(re * support) / sum(support), {round_to}) AS {h}_recall, round(sum(CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END * support) / sum(support), {round_to}) AS {h}_f1, cast(sum(support) AS BIGINT) AS n FROM p_{h} GROUP BY 1)"""

    return f"{_P}, s AS (SELECT *, 'overall' AS segment FROM fx_predictions UNION ALL SELECT *, CASE WHEN occluded = 1 THEN 'occluded' ELSE 'non_occluded' END FROM fx_predictions), {head('gloss')}, {head('cat')}, seg AS (SELECT g.* EXCLUDE (n), c.* EXCLUDE (segment, n), g.n FROM m_gloss g JOIN m_cat c ON g.segment = c.segment)"


@query(_segments_sql(6) + " SELECT * FROM seg")
def a5_segment_metrics(spark, sf):
    return E.segment_metrics(preds(spark, sf))


def _cube(spark, sf):
    """The cube of all predictions, kept by day and read back; a day that is added twice counts once."""
    folder, rows = staged_folder(spark, "cube"), preds(spark, sf)
    for day, part in enumerate((2, 0, 1, 2)):
        K.add_to_cube(rows.filter(F.col("clip_id") % 3 == part if day else F.col("clip_id") % 5 == 1), folder, f"2024-01-0{part + 1}")
    return K.read_cube(spark, folder)


@query(f"{_P} SELECT head, model, occluded, y, yhat, count(*) AS n FROM (SELECT 'gloss' AS head, model, occluded, gloss_gt AS y, gloss_pred AS yhat FROM fx_predictions UNION ALL SELECT 'cat', model, occluded, cat_gt, cat_pred FROM fx_predictions) GROUP BY ALL")
def a2_cube(spark, sf):
    return _cube(spark, sf)


@query(_report_sql() + " SELECT cls, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM rep")
def a3_cube_report(spark, sf):
    return E.report_of(K.of_head(_cube(spark, sf), "gloss"))


@query(_segments_sql(6) + " SELECT * FROM seg")
def a5_cube_segments(spark, sf):
    cube = _cube(spark, sf)
    return E.segments_of(*[K.of_head(cube, h, "occluded") for h in K.HEADS])


@query(f"{_P} SELECT model, count(*) AS n, round(avg((gloss_gt = gloss_pred)::INT), 6) AS gloss_accuracy, round(avg((cat_gt = cat_pred)::INT), 6) AS cat_accuracy FROM fx_predictions GROUP BY 1")
def a17_cube_models(spark, sf):
    return K.model_accuracies(_cube(spark, sf))


_METRICS = [f"{h}_{m}" for h in ("gloss", "cat") for m in ("accuracy", "precision", "recall", "f1")]


@query(_segments_sql(15) + " SELECT " + ", ".join(f"round(a.{m} - b.{m}, 6) AS {m}" for m in _METRICS) + " FROM seg a, seg b WHERE a.segment = 'non_occluded' AND b.segment = 'occluded'")
def a5_segment_differences(spark, sf):
    return E.segment_differences(E.segment_metrics(preds(spark, sf)))


@query(
    _report_sql()
    + ", z AS (SELECT sum(tp)::DOUBLE AS c, sum(support)::DOUBLE AS s, sum(predicted::DOUBLE * support) AS pt, sum(predicted::DOUBLE * predicted) AS pp, sum(support::DOUBLE * support) AS tt FROM rep) SELECT round((c / s - pt / (s * s)) / (1 - pt / (s * s)), 6) AS kappa, round((c * s - pt) / sqrt((s * s - pp) * (s * s - tt)), 6) AS mcc FROM z"
)
def a6_agreement(spark, sf):
    return E.agreement(preds(spark, sf))


@query(f"{_V}, r AS (SELECT gloss, x[gloss + 1] AS own, x FROM fx_vec_frames), a AS (SELECT len(list_filter(range(1, len(x) + 1), lambda i: x[i] > own OR (x[i] = own AND i < gloss + 1))) AS above FROM r) SELECT round(avg(CASE WHEN above < 3 THEN 1.0 ELSE 0 END), 6) AS top3_accuracy, round(avg(CASE WHEN above < 5 THEN 1.0 ELSE 0 END), 6) AS top5_accuracy FROM a")
def a7_top_k_accuracy(spark, sf):
    return E.top_k_accuracy(vectors(spark, sf), "x", "gloss")


_HASHED = """hs AS (SELECT (gloss_gt = gloss_pred)::INT AS g, (cat_gt = cat_pred)::INT AS k, ('0x' || substr(md5(concat_ws('|', cast(clip_id AS VARCHAR), '42')), 1, 8))::BIGINT % 2147483647 AS ha, ('0x' || substr(md5(concat_ws('|', cast(clip_id AS VARCHAR), '42')), 9, 8))::BIGINT % 2147483647 AS hb FROM fx_predictions),
rp AS (SELECT rep, (rep * 1103515245 + 12345) % 2147483647 AS c, (rep * rep * 69069 + rep * 362437 + 1) % 2147483647 AS d FROM (SELECT unnest(range(1, 1001)) AS rep)),
uu AS (SELECT rep, g, k, (ha * c + hb * d) % 2147483647 AS u FROM hs, rp),
wt AS (SELECT rep, g, k, """ + " + ".join(f"(u >= {int(x * E.PRIME)})::INT" for x in E.POISSON) + " AS w FROM uu), br AS (SELECT rep, sum(w * g)::DOUBLE / sum(w)::DOUBLE AS acc, sum(w * k)::DOUBLE / sum(w)::DOUBLE AS cat FROM wt GROUP BY rep)"


@query(f"{_P}, {_HASHED} SELECT round(avg(acc), 6) AS mean, round(quantile_cont(acc, 0.025), 6) AS low, round(quantile_cont(acc, 0.975), 6) AS high FROM br")
def a8_bootstrap_ci(spark, sf):
    return E.bootstrap_ci(preds(spark, sf))


_LOSS = f"""{_V}, r AS (SELECT clip_id, gloss, list_transform(x, lambda v: v::DOUBLE) AS x FROM fx_vec_frames),
p AS (SELECT clip_id, gloss, x, ln(list_sum(list_transform(x, lambda v: exp(v - list_max(x))))) + list_max(x) AS z FROM r),
l AS (SELECT clip_id, z - x[gloss + 1] AS ce, z - list_sum(x) / len(x) AS m FROM p),
f AS (SELECT clip_id, ce, pow(1 - exp(-ce), 2) * ce AS focal, 0.9 * ce + 0.1 * m AS smoothed FROM l)"""


@query(_LOSS + " SELECT round(avg(ce), 6) AS ce, round(avg(focal), 6) AS focal, round(avg(smoothed), 6) AS smoothed FROM f")
def a9_loss_metrics(spark, sf):
    return E.loss_metrics(E.sample_losses(vectors(spark, sf), "x", "gloss"))


@query(_LOSS + ", b AS (SELECT clip_id, avg(ce) AS ce, avg(focal) AS focal, avg(smoothed) AS smoothed FROM f GROUP BY 1) SELECT round(avg(ce), 6) AS ce, round(avg(focal), 6) AS focal, round(avg(smoothed), 6) AS smoothed FROM b")
def a9_batch_losses(spark, sf):
    return E.loss_metrics(E.sample_losses(vectors(spark, sf), "x", "gloss"), "clip_id")


@query(f"{_P} SELECT gloss_gt AS y, gloss_pred AS yhat, count(*) AS n FROM fx_predictions WHERE gloss_gt <> gloss_pred GROUP BY 1, 2 ORDER BY n DESC, y, yhat LIMIT 10")
def a10_confused_pairs(spark, sf):
    return E.confused_pairs(preds(spark, sf))


@query(f"{_P} SELECT count(*) AS total, count(*) FILTER (gloss_gt <> gloss_pred) AS errors, round(count(*) FILTER (gloss_gt <> gloss_pred) / count(*)::DOUBLE, 6) AS error_rate FROM fx_predictions")
def a10_error_summary(spark, sf):
    return E.error_summary(preds(spark, sf))


@query(f"{_P} SELECT round(avg(gloss_prob), 6) AS mean, round(quantile_cont(gloss_prob, 0.5), 6) AS median, round(stddev_pop(gloss_prob), 6) AS std, min(gloss_prob) AS min, max(gloss_prob) AS max, round(quantile_cont(gloss_prob, 0.25), 6) AS p25, round(quantile_cont(gloss_prob, 0.75), 6) AS p75 FROM fx_predictions")
def a11_confidence_stats(spark, sf):
    return E.confidence_stats(preds(spark, sf))


@query(f"{_P} SELECT t AS threshold, round(avg(CASE WHEN gloss_gt = gloss_pred THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy, count(*) AS n FROM fx_predictions, (SELECT unnest([0.5::DOUBLE, 0.6, 0.7, 0.8, 0.9]) AS t) WHERE gloss_prob > t GROUP BY t")
def a12_accuracy_by_confidence(spark, sf):
    return E.accuracy_by_confidence(preds(spark, sf))


@query(f"{_P} SELECT round(avg(CASE WHEN gloss_gt <> gloss_pred THEN 1.0::DOUBLE ELSE 0 END) FILTER (gloss_prob < 0.5), 6) AS low_confidence_error, round(avg(CASE WHEN gloss_gt <> gloss_pred THEN 1.0::DOUBLE ELSE 0 END) FILTER (gloss_prob > 0.8), 6) AS high_confidence_error FROM fx_predictions")
def a12_confidence_errors(spark, sf):
    return E.confidence_errors(preds(spark, sf))


@query(f"{_P}, p AS (SELECT gloss_gt, count(*) AS n, count(*) FILTER (gloss_gt <> gloss_pred) AS w FROM fx_predictions GROUP BY 1) SELECT count(*) AS rare_classes, cast(sum(n) AS BIGINT) AS n, round(sum(w)::DOUBLE / sum(n)::DOUBLE, 6) AS error_rate FROM p WHERE n <= (SELECT quantile_cont(n, 0.25) FROM p)")
def a13_rare_class_error(spark, sf):
    return E.rare_class_error(preds(spark, sf))


_TIER = "CASE WHEN f1 >= 0.8 THEN 'excellent' WHEN f1 >= 0.6 THEN 'good' WHEN f1 >= 0.4 THEN 'fair' ELSE 'poor' END"


@query(_report_sql() + f" SELECT cls, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support, round((precision + recall) / 2, 6) AS balanced, {_TIER} AS tier, f1 < 0.5 AS problem FROM rep")
def a14_class_tiers(spark, sf):
    return E.class_tiers(E.classification_report(preds(spark, sf)))


@query(_report_sql() + f", tc AS (SELECT {_TIER} AS tier, count(*) AS classes FROM rep GROUP BY 1) SELECT tier, classes, round(classes / (SELECT sum(classes) FROM tc)::DOUBLE, 6) AS share FROM tc")
def a14_tier_counts(spark, sf):
    return E.tier_counts(E.class_tiers(E.classification_report(preds(spark, sf))))


@query(_report_sql() + " SELECT round(avg(f1), 6) AS mean, round(stddev_samp(f1), 6) AS std, round(quantile_cont(f1, 0.5), 6) AS median, round(min(f1), 6) AS min, round(max(f1), 6) AS max FROM rep")
def a14_f1_stats(spark, sf):
    return E.f1_stats(E.classification_report(preds(spark, sf)))


@query(
    _report_sql()
    + ", z AS (SELECT sum(tp)::DOUBLE AS c, sum(support)::DOUBLE AS s, sum(predicted::DOUBLE * support) AS pt FROM rep), v AS (SELECT c / s AS g, (SELECT avg(CASE WHEN cat_gt = cat_pred THEN 1.0::DOUBLE ELSE 0 END) FROM fx_predictions) AS k, (c / s - pt / (s * s)) / (1 - pt / (s * s)) AS ka FROM z) "
    "SELECT 'gloss_accuracy' AS metric, round(g, 6) AS value, CASE WHEN g > 0.8 THEN 'excellent' WHEN g > 0.6 THEN 'good' WHEN g > 0.4 THEN 'fair' ELSE 'poor' END AS verdict FROM v UNION ALL SELECT 'cat_accuracy', round(k, 6), CASE WHEN k > 0.7 THEN 'excellent' WHEN k > 0.5 THEN 'good' WHEN k > 0.3 THEN 'fair' ELSE 'poor' END FROM v UNION ALL SELECT 'kappa', round(ka, 6), CASE WHEN ka > 0.8 THEN 'excellent' WHEN ka > 0.6 THEN 'good' WHEN ka > 0.4 THEN 'fair' ELSE 'poor' END FROM v"
)
def a15_overall_tiers(spark, sf):
    p = preds(spark, sf)
    return E.overall_tiers(E.overall_metrics(p).crossJoin(E.agreement(p)))


@query(
    f"{_P}, e AS (SELECT min(gloss_prob) AS lo, (max(gloss_prob) - min(gloss_prob)) / 30 AS w FROM fx_predictions), c AS (SELECT least(29, floor((gloss_prob - lo) / w))::INT AS bin, count(*) AS n FROM fx_predictions, e GROUP BY 1) "
    "SELECT b.bin::INT AS bin, round(lo + b.bin * w, 6) AS low, round(lo + (b.bin + 1) * w, 6) AS high, coalesce(n, 0)::BIGINT AS n FROM (SELECT unnest(range(30)) AS bin) b CROSS JOIN e LEFT JOIN c ON c.bin = b.bin"
)
def a16_histogram(spark, sf):
    return E.histogram(preds(spark, sf), "gloss_prob", 30)


_MODELS = f"{_SCORED}, cm AS (SELECT model, count(*) AS n, round(avg(CASE WHEN gloss_gt = gloss_pred THEN 1.0::DOUBLE ELSE 0 END), 6) AS gloss_accuracy, round(avg(CASE WHEN cat_gt = cat_pred THEN 1.0::DOUBLE ELSE 0 END), 6) AS cat_accuracy, round(avg(gloss_prob), 6) AS mean_confidence, round(avg((above < 3)::INT), 6) AS gloss_top3_accuracy, round(avg((above < 5)::INT), 6) AS gloss_top5_accuracy, round(avg(ce), 6) AS loss FROM fx_predictions GROUP BY 1)"
_LONG = ", ln AS (SELECT model, metric, value FROM (UNPIVOT cm ON gloss_accuracy, cat_accuracy, mean_confidence, gloss_top3_accuracy, gloss_top5_accuracy, loss INTO NAME metric VALUE value))"


@query(_MODELS + " SELECT * FROM cm")
def a17_compare_models(spark, sf):
    return E.compare_models(scored(spark, sf), "logits")


@query(_MODELS + _LONG + " SELECT * FROM ln")
def a17_metrics_long(spark, sf):
    return E.metrics_long(E.compare_models(scored(spark, sf), "logits"))


@query(_MODELS + _LONG + " SELECT metric, max(value) FILTER (model = 'A') AS \"A\", max(value) FILTER (model = 'B') AS \"B\" FROM ln GROUP BY 1")
def a17_metrics_by_model(spark, sf):
    return E.metrics_by_model(E.metrics_long(E.compare_models(scored(spark, sf), "logits")), ["A", "B"])


def _agreement_sql(h: str) -> str:
    return f"""c_{h} AS (SELECT cls, sum(tp)::DOUBLE AS tp, sum(s)::DOUBLE AS s, sum(q)::DOUBLE AS q FROM (SELECT {h}_gt AS cls, ({h}_gt = {h}_pred)::INT AS tp, 1 AS s, 0 AS q FROM fx_predictions UNION ALL SELECT {h}_pred, 0, 0, 1 FROM fx_predictions) GROUP BY 1),
s_{h} AS (SELECT sum(tp) AS c, sum(s) AS n, sum(s * q) AS pt, sum(q * q) AS pp, sum(s * s) AS tt FROM c_{h}), g_{h} AS (SELECT c / n AS acc, (c / n - pt / (n * n)) / (1 - pt / (n * n)) AS kappa, (c * n - pt) / sqrt((n * n - pp) * (n * n - tt)) AS mcc FROM s_{h})"""


_PERCENT = "printf('%.2f%%', round(v * 100, 2))"
_SUMMARY = (
    f"{_SCORED}, {_HASHED}, {_agreement_sql('gloss')}, {_agreement_sql('cat')}, t AS (SELECT avg(ce) AS loss, avg((above < 3)::INT) AS t3, avg((above < 5)::INT) AS t5 FROM fx_predictions), "
    "ci AS (SELECT printf('[%.4f, %.4f]', round(quantile_cont(acc, 0.025), 4), round(quantile_cont(acc, 0.975), 4)) AS g, printf('[%.4f, %.4f]', round(quantile_cont(cat, 0.025), 4), round(quantile_cont(cat, 0.975), 4)) AS k FROM br), "
    "su AS (SELECT 'Test Loss' AS metric, loss AS v, 'N/A' AS ci FROM t UNION ALL SELECT 'Gloss Accuracy', acc, (SELECT g FROM ci) FROM g_gloss UNION ALL SELECT 'Category Accuracy', acc, (SELECT k FROM ci) FROM g_cat UNION ALL SELECT 'Gloss Top-3 Accuracy', t3, 'N/A' FROM t UNION ALL SELECT 'Gloss Top-5 Accuracy', t5, 'N/A' FROM t "
    "UNION ALL SELECT 'Gloss Cohen''s Kappa', kappa, 'N/A' FROM g_gloss UNION ALL SELECT 'Category Cohen''s Kappa', kappa, 'N/A' FROM g_cat UNION ALL SELECT 'Gloss Matthews Correlation', mcc, 'N/A' FROM g_gloss UNION ALL SELECT 'Category Matthews Correlation', mcc, 'N/A' FROM g_cat) "
    f"SELECT metric, round(v, 6) AS value, CASE WHEN metric = 'Test Loss' THEN printf('%.2f', round(v, 2)) ELSE {_PERCENT} END AS percentage, ci AS confidence_interval FROM su"
)


@query(_SUMMARY)
def a28_performance_summary(spark, sf):
    return E.performance_summary(scored(spark, sf), "logits")


@query(_report_sql() + " SELECT b.c::INT AS cls, round(coalesce(precision, 0), 6) AS precision, round(coalesce(recall, 0), 6) AS recall, round(coalesce(f1, 0), 6) AS f1, coalesce(support, 0)::BIGINT AS support FROM (SELECT unnest(range(30)) AS c) b LEFT JOIN rep ON rep.cls = b.c")
def j8_scaffold_classes(spark, sf):
    return E.scaffold_classes(E.classification_report(preds(spark, sf)), 30)


@query(
    f"{_P}, k AS (SELECT model, cls, sum(tp) AS tp, sum(s) AS s, sum(q) AS q FROM (SELECT model, gloss_gt AS cls, (gloss_gt = gloss_pred)::INT AS tp, 1 AS s, 0 AS q FROM fx_predictions UNION ALL SELECT model, gloss_pred, 0, 0, 1 FROM fx_predictions) GROUP BY 1, 2), "
    "f AS (SELECT model, cls, CASE WHEN tp = 0 THEN 0.0::DOUBLE ELSE 2 * (tp::DOUBLE / q) * (tp::DOUBLE / s) / ((tp::DOUBLE / q) + (tp::DOUBLE / s)) END AS f1 FROM k) "
    "SELECT coalesce(a.cls, b.cls) AS cls, round(a.f1, 6) AS a, round(b.f1, 6) AS b, round(b.f1 - a.f1, 6) AS difference FROM (SELECT * FROM f WHERE model = 'A') a FULL JOIN (SELECT * FROM f WHERE model = 'B') b ON a.cls = b.cls"
)
def j9_compare_per_class(spark, sf):
    p = preds(spark, sf)
    return E.compare_per_class(*[E.classification_report(p.filter(F.col("model") == m)) for m in ("A", "B")])


@query(f"{_P} SELECT model, count(*) AS n FROM (SELECT clip_id, 'first' AS model FROM fx_predictions WHERE model = 'A' UNION ALL SELECT clip_id, 'second' FROM fx_predictions WHERE model = 'B') GROUP BY 1")
def d1_union_runs(spark, sf):
    p = preds(spark, sf)
    return E.union_runs(first=p.filter("model = 'A'"), second=p.filter("model = 'B'")).groupBy("model").agg(F.count("*").alias("n"))


@query(
    f"WITH {_FX['fx_predictions']}, {_FX['fx_label_ref']}, c AS (SELECT DISTINCT cat_id, category FROM fx_label_ref) SELECT p.clip_id AS file, g.label || ' (' || p.gloss_gt || ')' AS gt_gloss, c.category || ' (' || p.cat_gt || ')' AS gt_cat, h.label || ' (' || p.gloss_pred || ')' AS pred_gloss, d.category || ' (' || p.cat_pred || ')' AS pred_cat, p.gloss_gt = p.gloss_pred AS gloss_ok, p.cat_gt = p.cat_pred AS cat_ok "
    "FROM fx_predictions p JOIN fx_label_ref g ON g.gloss_id = p.gloss_gt JOIN fx_label_ref h ON h.gloss_id = p.gloss_pred JOIN c ON c.cat_id = p.cat_gt JOIN c d ON d.cat_id = p.cat_pred"
)
def p13_format_predictions(spark, sf):
    out = E.format_predictions(preds(spark, sf), ref(spark, sf))
    return out.select("file", F.col("ground_truth.gloss").alias("gt_gloss"), F.col("ground_truth.category").alias("gt_cat"), F.col("prediction.gloss").alias("pred_gloss"), F.col("prediction.category").alias("pred_cat"), F.col("correct.gloss").alias("gloss_ok"), F.col("correct.category").alias("cat_ok"))


@query(f"{_P} SELECT count(*) AS total, count(*) FILTER (gloss_gt = gloss_pred) AS correct_gloss, count(*) FILTER (cat_gt = cat_pred) AS correct_cat, count(*) FILTER (gloss_gt = gloss_pred AND cat_gt = cat_pred) AS both_correct FROM fx_predictions WHERE gloss_gt <> gloss_pred AND occluded = 1")
def p14_filter_predictions(spark, sf):
    return E.prediction_counts(E.filter_predictions(preds(spark, sf), "Incorrect Only", "Occluded"))


_SOFT = f"""{_V}, r AS (SELECT clip_id, frame_idx, list_transform(x, lambda v: v::DOUBLE) AS x FROM fx_vec_frames),
z AS (SELECT clip_id, frame_idx, x, ln(list_sum(list_transform(x, lambda v: exp(v - list_max(x))))) + list_max(x) AS z FROM r),
sm AS (SELECT clip_id, frame_idx, unnest(range(len(x))) AS id, unnest(list_transform(x, lambda v: exp(v - z))) AS p FROM z)"""


@query(_SOFT + " SELECT clip_id, frame_idx, round(max(p), 6) AS top, (arg_max(id, (p, -id)))::INT AS best, round(sum(p), 6) AS total FROM sm GROUP BY 1, 2")
def p11_softmax(spark, sf):
    df = vectors(spark, sf).withColumn("p", A.softmax(F.col("x")))
    return df.select("clip_id", "frame_idx", F.array_max("p").alias("top"), A.argmax(F.col("x")).alias("best"), A.total(F.col("p")).alias("total"))


@query(_SOFT + ", k AS (SELECT *, row_number() OVER (PARTITION BY clip_id, frame_idx ORDER BY p DESC, id) AS rank FROM sm) SELECT clip_id, frame_idx, rank::INT AS rank, id::INT AS id, round(p, 6) AS prob, printf('%.1f%%', round(p * 100, 1)) AS text FROM k WHERE rank <= 5")
def p12_top_k(spark, sf):
    df = vectors(spark, sf).select("clip_id", "frame_idx", A.softmax(F.col("x")).alias("p"))
    return E.ranked_labels(df, "p", 5)


@query(_SOFT + ", k AS (SELECT *, row_number() OVER (PARTITION BY clip_id, frame_idx ORDER BY p DESC, id) AS rank FROM sm) SELECT clip_id, frame_idx, round(-sum(p * ln(p + 1e-10)) FILTER (rank <= 5), 6) AS gloss_entropy, round(-sum(p * ln(p + 1e-10)) FILTER (rank <= 3), 6) AS cat_entropy, round(max(p) * 100, 6) AS gloss_confidence FROM k GROUP BY 1, 2")
def p17_prediction_entropy(spark, sf):
    df = vectors(spark, sf).select("clip_id", "frame_idx", A.softmax(F.col("x")).alias("p"))
    return E.prediction_entropy(df, "p", "p").select("clip_id", "frame_idx", "gloss_entropy", "cat_entropy", "gloss_confidence")


@query(_report_sql() + " SELECT cls, round(f1, 6) AS f1, support FROM rep ORDER BY support DESC, cls LIMIT 10")
def t1_top_n(spark, sf):
    return E.top_n(E.classification_report(preds(spark, sf)).select("cls", "f1", "support"), "support", 10, ("cls",))


# --- labels ------------------------------------------------------------------------------------


@query(f"WITH {duck('fx_labels', 'fx_label_ref')} SELECT l.file, l.occluded, r.gloss_id AS gloss, r.cat_id AS cat FROM fx_labels l LEFT JOIN fx_label_ref r ON lower(r.label) = lower(trim(replace(regexp_replace(l.file, '^[^_]*_[^_]*_', ''), '.npz', '')))")
def j1_assign_ids(spark, sf):
    return L.assign_ids(labels(spark, sf), ref(spark, sf)).select("file", "occluded", "gloss", "cat")


def _some_clips(spark, sf):
    return labels(spark, sf).filter("substr(file, 12, 1) NOT IN ('0', '5')").select(F.concat(F.lit("0/"), "file").alias("file"))


@query(f"{_LB} SELECT file, gloss, cat, occluded FROM fx_labels WHERE substr(file, 12, 1) NOT IN ('0', '5')")
def j2_match_files(spark, sf):
    return L.match_files(labels(spark, sf), _some_clips(spark, sf))


@query(f"{_LB} SELECT count(*) AS before, count(*) FILTER (substr(file, 12, 1) NOT IN ('0', '5')) AS after, count(*) FILTER (substr(file, 12, 1) IN ('0', '5')) AS missing FROM fx_labels")
def j2_match_counts(spark, sf):
    return L.match_counts(labels(spark, sf), _some_clips(spark, sf))


@query(f"{_LB} SELECT file, gloss, cat, occluded FROM fx_labels WHERE substr(file, 12, 1) IN ('0', '5')")
def j2_missing_files(spark, sf):
    return L.missing_files(labels(spark, sf), _some_clips(spark, sf))


@query(f"{_LB} SELECT file, CASE WHEN gloss % 3 = 0 THEN '/data/' || file WHEN gloss % 3 = 1 THEN '/data/0/' || file ELSE '/other/' || file END AS path FROM fx_labels")
def j3_resolve_paths(spark, sf):
    rows = labels(spark, sf).select("file", "gloss")
    files = rows.select(F.explode(F.filter(F.array(F.concat(F.lit("/other/"), "file"), F.when(F.col("gloss") % 3 < 2, F.concat(F.lit("/data/0/"), "file")), F.when(F.col("gloss") % 3 == 0, F.concat(F.lit("/data/"), "file"))), lambda p: p.isNotNull())).alias("path"))
    return L.resolve_paths(rows.select("file"), files, "/data")


@query(f"WITH {duck('fx_predictions', 'fx_label_ref')} SELECT p.clip_id, coalesce(r.label, 'Unknown') AS label FROM fx_predictions p LEFT JOIN (SELECT * FROM fx_label_ref WHERE gloss_id < 20) r ON r.gloss_id = p.gloss_pred")
def j4_lookup_labels(spark, sf):
    return L.lookup_labels(preds(spark, sf), ref(spark, sf).filter("gloss_id < 20"), "gloss_pred", "gloss_id", "label", "label").select("clip_id", "label")


@query(f"{_LB} SELECT l.cat, l.gloss, l.file, l.occluded FROM fx_labels l JOIN nation n ON n.n_nationkey = l.gloss JOIN region r ON r.r_regionkey = l.cat WHERE upper(r.r_name) IN ('ASIA', 'EUROPE', 'AMERICA') AND n.n_name NOT IN ('FRANCE', 'CHINA', 'BRAZIL')")
def j5_restrict_pairs(spark, sf):
    names = [r.label for r in ref(spark, sf).filter("label NOT IN ('FRANCE', 'CHINA', 'BRAZIL')").select(F.lower("label").alias("label")).collect()]  # 25 nations at most
    return L.restrict_pairs(labels(spark, sf), ref(spark, sf), ["asia", "Europe", "AMERICA"], names).select("cat", "gloss", "file", "occluded")


@query(f"{_LB}, r AS (SELECT * FROM fx_labels UNION ALL SELECT * FROM fx_labels WHERE gloss % 5 = 0), g AS (SELECT DISTINCT gloss FROM r WHERE contains(upper(file), 'ION_2.') UNION SELECT n_nationkey FROM nation WHERE n_name IN ('NATION_6', 'NATION_13')) SELECT cat, gloss, file, occluded FROM r WHERE cat IN (1, 2, 3) AND gloss IN (SELECT gloss FROM g)")
def j5_restrict_by_file_names(spark, sf):
    """A name that no gloss has is looked for in file names; repeated rows stay."""
    rows = labels(spark, sf)
    rows = rows.unionByName(rows.filter("gloss % 5 = 0"))
    return L.restrict_pairs(rows, ref(spark, sf), [1, "ASIA", 3], ["nation_6", "Nation_13", "ion_2."]).select("cat", "gloss", "file", "occluded")


@query(f"{_LB} SELECT c::INT AS gloss FROM (SELECT unnest(range(40)) AS c) WHERE c NOT IN (SELECT gloss FROM fx_labels)")
def j7_missing_classes(spark, sf):
    return L.missing_classes(labels(spark, sf), 40)


@query(f"{_LB} SELECT file, lower(trim(replace(regexp_replace(file, '^[^_]*_[^_]*_', ''), '.npz', ''))) AS text FROM fx_labels")
def p6_gloss_text(spark, sf):
    return labels(spark, sf).select("file", A.gloss_text(F.col("file")).alias("text"))


@query("SELECT p_partkey, CASE WHEN s = '' THEN 'uncategorized' ELSE s END AS slug FROM (SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(p_type || ' / ' || p_brand)), '[-/]', ' ', 'g'), '\\s+', '_', 'g'), '[^a-z0-9_]', '', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') AS s FROM part)")
def p7_slugify(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet")
    return part.select("p_partkey", A.slugify(F.concat_ws(" / ", "p_type", "p_brand")).alias("slug"))


@query(f"{_LB} SELECT file, coalesce(gloss, 0) AS gloss, coalesce(cat, 0) AS cat, occluded FROM fx_labels")
def v3_validate_labels(spark, sf):
    return L.validate_labels(labels(spark, sf), 25, 5).select("file", "gloss", "cat", "occluded")


@query(
    f"""{_LB}, c AS (SELECT gloss, count(*) AS n FROM fx_labels GROUP BY 1), t AS (SELECT sum(n)::BIGINT AS n, sum(n)::BIGINT - ceil(round(sum(n)::BIGINT * (1 - 0.8::DOUBLE), 9))::BIGINT AS tr FROM c),
q AS (SELECT gloss, floor(c.n * t.tr / t.n::DOUBLE)::BIGINT AS f, round(c.n * t.tr / t.n::DOUBLE - floor(c.n * t.tr / t.n::DOUBLE), 9) AS rest, t.tr FROM c, t),
k AS (SELECT gloss, f + CASE WHEN row_number() OVER (ORDER BY rest DESC, gloss) <= tr - sum(f) OVER () THEN 1 ELSE 0 END AS quota FROM q),
o AS (SELECT *, row_number() OVER (PARTITION BY gloss ORDER BY ('0x' || substr(md5(file || '|42'), 1, 8))::UBIGINT, file) AS place FROM fx_labels)
SELECT file, o.gloss, cat, occluded, CASE WHEN place <= quota THEN 'train' ELSE 'val' END AS split FROM o JOIN k ON o.gloss = k.gloss"""
)
def w11_stratified_split(spark, sf):
    return L.stratified_split(labels(spark, sf)).select("file", "gloss", "cat", "occluded", "split")


def _stems(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    return orders.select((F.col("o_custkey") % 30).alias("id"), F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("take"), F.col("o_orderkey").cast("string"))).otherwise(F.col("o_orderkey").cast("string")).alias("stem"))


@query(
    """WITH s AS (SELECT o_custkey % 30 AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'take' || o_orderkey ELSE cast(o_orderkey AS VARCHAR) END AS stem FROM orders),
k AS (SELECT s.id, stem, n_name AS label, row_number() OVER (ORDER BY s.id, CASE WHEN stem LIKE 'take%' THEN 1 ELSE 0 END, TRY_CAST(stem AS BIGINT), stem) AS number FROM s JOIN nation ON n_nationkey = s.id)
SELECT id, stem, number, 'clip_' || lpad(cast(number AS VARCHAR), greatest(4, length(cast((SELECT count(*) FROM k) AS VARCHAR)))::INT, '0') || '_' || replace(lower(label), ' ', '_') || '.MOV' AS name FROM k"""
)
def w10_number_clips(spark, sf):
    nation = spark.read.parquet(f"{sf}/nation.parquet")
    return L.number_clips(_stems(spark, sf), nation.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("label")))


@query("WITH f AS (SELECT 'stem' || (o_orderkey % 1000) AS stem, '/in/' || o_orderkey || '.npz' AS path FROM orders), p AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY path) AS k FROM f) SELECT stem, path, CASE WHEN k = 1 THEN stem ELSE stem || '-' || substr(md5(path), 1, 8) END AS name FROM p")
def w12_unique_names(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    files = orders.select(F.concat(F.lit("stem"), (F.col("o_orderkey") % 1000).cast("string")).alias("stem"), F.concat(F.lit("/in/"), F.col("o_orderkey").cast("string"), F.lit(".npz")).alias("path"))
    return L.unique_names(files)


@query("WITH d AS (SELECT p_partkey AS id, p_brand AS cat FROM part), m AS (SELECT cat AS v, row_number() OVER (ORDER BY cat) - 1 AS code FROM (SELECT DISTINCT cat FROM d)) SELECT id, code::INT AS cat FROM d JOIN m ON d.cat = m.v")
def w14_encode_categories(spark, sf):
    rows = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("cat"))
    out = L.encode_categories(rows, "cat")[0]
    return out.select("id", F.col("cat").cast("int").alias("cat"))


@query("SELECT o_orderkey, o_custkey FROM orders")
def t2_shuffle_rows(spark, sf):
    return L.shuffle_rows(spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey"), "o_orderkey")


@query(f"{_LB} SELECT DISTINCT cat, gloss FROM fx_labels WHERE occluded = 1 INTERSECT SELECT DISTINCT cat, gloss FROM fx_labels WHERE occluded = 0")
def d2_pair_intersection(spark, sf):
    df = labels(spark, sf)
    return L.pair_intersection(df.filter("occluded = 1"), df.filter("occluded = 0"))


@query(f"WITH {duck('fx_labels', 'fx_label_ref')} SELECT gloss_id AS gloss FROM fx_label_ref EXCEPT SELECT gloss FROM fx_labels WHERE gloss % 4 <> 0")
def d2_class_difference(spark, sf):
    return L.class_difference(ref(spark, sf).select(F.col("gloss_id").alias("gloss")), labels(spark, sf).filter("gloss % 4 <> 0"))


@query("WITH r AS (SELECT p_partkey, p_size % 7 AS gloss_id, p_name AS label, p_size % 3 AS cat_id, p_brand AS category FROM part WHERE p_partkey % 5 <> 0) SELECT gloss_id, arg_max(label, p_partkey) AS label, arg_max(cat_id, p_partkey) AS cat_id, arg_max(category, p_partkey) AS category FROM r GROUP BY 1")
def s7_clean_label_ref(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet")
    gloss = F.when(F.col("p_partkey") % 5 == 0, F.lit("none")).otherwise((F.col("p_size") % 7).cast("string"))
    raw = part.select("p_partkey", gloss.alias("gloss_id"), F.col("p_name").alias("label"), (F.col("p_size") % 3).cast("string").alias("cat_id"), F.col("p_brand").alias("category"))
    return T.clean_label_ref(raw, F.col("p_partkey"))


# --- sequences ---------------------------------------------------------------------------------


@query(f"{_H} SELECT clip_id, frame_idx, kp, round(x, 6) AS x, round(y, 6) AS y, visible FROM fx_holistic")
def p1_to_keypoints(spark, sf):
    return S.to_keypoints(frames(spark, sf)).select("clip_id", "frame_idx", "kp", "x", "y", "visible")


@query(f"{_H} SELECT clip_id, frame_idx, round(sum(x) FILTER (kp BETWEEN 25 AND 45), 6) AS left_x, round(sum(y) FILTER (kp >= 67), 6) AS face_y FROM fx_holistic GROUP BY 1, 2")
def p2_slice_group(spark, sf):
    return frames(spark, sf).select("clip_id", "frame_idx", A.total(A.slice_group(F.col("x"), "left_hand", "x")).alias("left_x"), A.total(A.slice_group(F.col("x"), "face", "y")).alias("face_y"))


@query(f"{_V} SELECT clip_id, frame_idx, 80 AS n, round(list_sum(list_transform(x, lambda v: v::DOUBLE)), 6) AS total, 10 AS short FROM fx_vec_frames")
def p3_pad_or_trim(spark, sf):
    df = vectors(spark, sf)
    return df.select("clip_id", "frame_idx", F.size(A.pad_or_trim(F.col("x"), 80)).alias("n"), A.total(A.pad_or_trim(F.col("x"), 80)).alias("total"), F.size(A.pad_or_trim(F.col("x"), 10)).alias("short"))


@query("WITH g AS (SELECT o_custkey, o_orderkey, 1 + o_orderkey % 9 AS n FROM orders), m AS (SELECT o_custkey, max(n) AS most FROM g GROUP BY 1) SELECT o_custkey, o_orderkey, n::INT AS length, most::INT AS padded FROM g JOIN m USING (o_custkey)")
def p3_pad_batch(spark, sf):
    rows = spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey", "o_orderkey", F.array_repeat(F.lit(1.0), (1 + F.col("o_orderkey") % 9).cast("int")).alias("v"))
    return S.pad_batch(rows, "o_custkey", "v").select("o_custkey", "o_orderkey", "length", F.size("v").alias("padded"))


@query(f"{_H} SELECT clip_id, frame_idx, bool_or(visible) AS any_visible, least(frame_idx, 50) AS valid FROM fx_holistic GROUP BY 1, 2")
def p4_length_mask(spark, sf):
    df = frames(spark, sf)
    return df.select("clip_id", "frame_idx", A.any_visible(F.col("mask")).alias("any_visible"), F.size(F.filter(A.length_mask(F.col("frame_idx"), 50), lambda v: v)).alias("valid"))


@query(f"{_V} SELECT clip_id, frame_idx, round(list_sum(list_transform(x, lambda v: least(1.0::DOUBLE, greatest(0.0::DOUBLE, v::DOUBLE)))), 6) AS total FROM fx_vec_frames")
def p5_clip_unit(spark, sf):
    return vectors(spark, sf).select("clip_id", "frame_idx", A.total(A.clip_unit(F.col("x"))).alias("total"))


@query(f"{_TR} SELECT clip_id, frame_idx, (x - 50) * (x - 50) / 900.0 + (y - 25) * (y - 25) / 100.0 <= 1 AS inside FROM fx_track")
def p10_point_in_ellipse(spark, sf):
    c = F.lit
    return fixture(spark, sf, "fx_track").select("clip_id", "frame_idx", A.point_in_ellipse(F.col("x"), F.col("y"), c(50.0), c(25.0), c(30.0), c(10.0)).alias("inside"))


_UNIT = lambda *parts: "('0x' || substr(md5(concat_ws('|', " + ", ".join(parts) + ", '42')), 1, 8))::BIGINT"
_CLIP = "cast(clip_id AS VARCHAR)"
_PLACE = f"{_CLIP}, cast(frame_idx AS VARCHAR), cast(i AS VARCHAR)"


@query(
    f"""{_H}, cl AS (SELECT clip_id, count(DISTINCT frame_idx) AS t FROM fx_holistic GROUP BY 1),
co AS (SELECT clip_id, greatest(1, floor(t * 0.1))::BIGINT AS block, t, {_UNIT(_CLIP, "'start'")} / 4294967296.0::DOUBLE AS st, {_UNIT(_CLIP, "'mask'")} / 4294967296.0::DOUBLE < 0.1 AS masked, {_UNIT(_CLIP, "'noise'")} / 4294967296.0::DOUBLE < 0.3 AS noisy FROM cl),
be AS (SELECT *, floor(st * (t - block + 1))::BIGINT AS first FROM co),
v AS (SELECT clip_id, frame_idx, 2 * kp AS i, x AS v FROM fx_holistic UNION ALL SELECT clip_id, frame_idx, 2 * kp + 1, y FROM fx_holistic),
n AS (SELECT v.*, masked AND frame_idx >= first AND frame_idx < first + block AS blank, noisy, ({_UNIT(_PLACE, "'a'").replace("clip_id", "v.clip_id")} + 1) / 4294967297.0::DOUBLE AS a, ({_UNIT(_PLACE, "'b'").replace("clip_id", "v.clip_id")} + 1) / 4294967297.0::DOUBLE AS b FROM v JOIN be ON be.clip_id = v.clip_id)
SELECT clip_id, frame_idx, i::INT AS place, round(CASE WHEN blank THEN 0 WHEN noisy THEN v + sqrt(-2 * ln(a)) * cos(2 * 3.141592653589793::DOUBLE * b) * 0.01 ELSE v END, 6) AS v FROM n"""
)
def p15_augment(spark, sf):
    return S.augment(frames(spark, sf)).select("clip_id", "frame_idx", F.posexplode("x").alias("place", "v"))


@query(f"{_H} SELECT clip_id, frame_idx, count(*) FILTER (visible)::INT AS visible_points, count(*)::INT AS points, round(round(avg(x), 9), 6) AS center_x, round(round(avg(y), 9), 6) AS center_y, count(*) FILTER (NOT (x = 0 AND y = 0))::INT AS drawn_points, frame_idx % 4 = 1 AS occluded FROM fx_holistic GROUP BY 1, 2")
def p18_frame_summary(spark, sf):
    df = frames(spark, sf)
    out = S.frame_summary(df, keys(spark, sf).filter("frame_idx % 4 <> 3").select("clip_id", "frame_idx", (F.col("frame_idx") % 4 == 1).alias("occluded")))
    # Centres that lie on a half of the sixth decimal but for the order of their sum.
    return out.withColumns({c: F.round(c, 9) for c in ("center_x", "center_y")})


@query(
    f"""{_H}, f AS (SELECT DISTINCT clip_id, frame_idx, t_ms FROM fx_holistic), i AS (SELECT *, row_number() OVER w AS i, floor(t_ms * 15 / 1000.0)::BIGINT + 1 AS c FROM f WINDOW w AS (PARTITION BY clip_id ORDER BY frame_idx)),
k AS (SELECT *, i + least(0, min(c - i) OVER (PARTITION BY clip_id ORDER BY frame_idx)) AS k FROM i), l AS (SELECT *, lag(k, 1, 0) OVER (PARTITION BY clip_id ORDER BY frame_idx) AS b FROM k) SELECT clip_id, frame_idx, t_ms FROM l WHERE k > b"""
)
def w1_downsample(spark, sf):
    return S.downsample(points(spark, sf).select("clip_id", "frame_idx", "t_ms").distinct(), 15)


@query(
    f"""{_H}, n AS (SELECT *, max(CASE WHEN visible THEN frame_idx END) OVER (PARTITION BY clip_id, kp ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p, min(CASE WHEN visible THEN frame_idx END) OVER (PARTITION BY clip_id, kp ORDER BY frame_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS q FROM fx_holistic),
j AS (SELECT n.*, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, NOT n.visible AND n.q - n.p - 1 BETWEEN 1 AND 5 AS fill FROM n LEFT JOIN fx_holistic a ON a.clip_id = n.clip_id AND a.kp = n.kp AND a.frame_idx = n.p LEFT JOIN fx_holistic b ON b.clip_id = n.clip_id AND b.kp = n.kp AND b.frame_idx = n.q)
SELECT clip_id, frame_idx, kp, round(CASE WHEN fill THEN ax + (bx - ax) * ((frame_idx - p) / (q - p)::DOUBLE) ELSE x END, 6) AS x, round(CASE WHEN fill THEN ay + (by_ - ay) * ((frame_idx - p) / (q - p)::DOUBLE) ELSE y END, 6) AS y, visible OR coalesce(fill, false) AS visible FROM j"""
)
def w2_interpolate_gaps(spark, sf):
    return S.interpolate_gaps(points(spark, sf)).select("clip_id", "frame_idx", "kp", "x", "y", "visible")


_VELOCITY = """st AS (SELECT clip_id, frame_idx, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS v FROM fx_holistic WINDOW w AS (PARTITION BY clip_id, kp ORDER BY frame_idx)),
fm AS (SELECT clip_id, frame_idx, max(v) AS top FROM st GROUP BY 1, 2), lim AS (SELECT clip_id, quantile_cont(top, 0.5) + 3 * stddev_pop(top) AS l FROM fm GROUP BY 1),
sp AS (SELECT fm.clip_id, count(*) FILTER (top > l + 1e-9::DOUBLE) AS vel_spike_frames FROM fm JOIN lim ON fm.clip_id = lim.clip_id GROUP BY 1),
vl AS (SELECT st.clip_id, round(quantile_cont(v, 0.95), 6) AS vel_p95, round(max(v), 6) AS vel_max, max(vel_spike_frames) AS vel_spike_frames FROM st JOIN sp ON sp.clip_id = st.clip_id GROUP BY 1)"""


@query(f"{_H}, {_VELOCITY} SELECT * FROM vl")
def w3_velocity(spark, sf):
    return S.velocity(points(spark, sf))


_PAIRS = "[" + ", ".join(f"[{a}, {b}]" for a, b in S.BONES) + "]"
_STABLE = f"""bn AS (SELECT b[1] AS a, b[2] AS b FROM (SELECT unnest({_PAIRS}) AS b)), le AS (SELECT p.clip_id, p.frame_idx, bn.a, bn.b, sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) AS v FROM bn JOIN fx_holistic p ON p.kp = bn.a JOIN fx_holistic q ON q.kp = bn.b AND q.clip_id = p.clip_id AND q.frame_idx = p.frame_idx),
be AS (SELECT clip_id, a, b, avg(v) AS m, stddev_pop(v) AS s FROM le GROUP BY 1, 2, 3), bo AS (SELECT le.clip_id, count(DISTINCT frame_idx) FILTER (abs((v - m) / (s + 1e-9::DOUBLE)) > 3.5) AS n FROM le JOIN be ON be.clip_id = le.clip_id AND be.a = le.a AND be.b = le.b GROUP BY 1),
bl AS (SELECT le.clip_id, round(stddev_pop(v) / (avg(v) + 1e-9) * 100, 6) AS bone_len_cv_pct, max(n) AS bone_outlier_frames FROM le JOIN bo ON bo.clip_id = le.clip_id GROUP BY 1)"""


@query(f"{_H}, {_STABLE} SELECT * FROM bl")
def w4_bone_stability(spark, sf):
    return S.bone_stability(frames(spark, sf))


@query("WITH f AS (SELECT user_id AS clip_id, event_id, event_id % 1000 AS t, lag(event_id % 1000) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) SELECT clip_id, count(*) FILTER (t < b) = 0 AS timestamps_monotonic FROM f GROUP BY 1")
def w5_monotonic(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    return S.monotonic(events.select(F.col("user_id").alias("clip_id"), F.col("event_id").alias("frame_idx"), (F.col("event_id") % 1000).alias("t_ms")))


_COVER = "cf AS (SELECT clip_id, frame_idx, count(*) FILTER (visible) AS n, count(*) AS o FROM fx_holistic GROUP BY 1, 2), cv AS (SELECT clip_id, round(sum(n)::DOUBLE / sum(o)::DOUBLE * 100, 6) AS coverage_pct, min(n)::INT AS min_visible, max(n)::INT AS max_visible, count(*) FILTER (n < 10) AS low_vis_frames FROM cf GROUP BY 1)"


@query(f"{_H}, {_COVER} SELECT * FROM cv")
def a18_coverage(spark, sf):
    return S.coverage(frames(spark, sf))


@query(
    f"""{_H}, {_COVER}, {_VELOCITY}, {_STABLE}, ba AS (SELECT clip_id, count(DISTINCT frame_idx) AS "T", false AS x_has_nan, false AS x_has_inf, (count(*) FILTER (x < 0 OR x > 1) + count(*) FILTER (y < 0 OR y > 1))::BIGINT AS x_out_of_range, max(t_ms) - min(t_ms) AS duration_ms, true AS temporal_consistent, true AS timestamps_monotonic FROM fx_holistic GROUP BY 1)
SELECT ba.*, cv.* EXCLUDE (clip_id), vl.* EXCLUDE (clip_id), bl.* EXCLUDE (clip_id) FROM ba JOIN cv ON cv.clip_id = ba.clip_id JOIN vl ON vl.clip_id = ba.clip_id JOIN bl ON bl.clip_id = ba.clip_id"""
)
def a19_sanity(spark, sf):
    return S.sanity(frames(spark, sf))


@query(f"{_V}, u AS (SELECT clip_id, unnest(range(len(x)))::INT AS dim, unnest(x)::DOUBLE AS v FROM fx_vec_frames) SELECT clip_id, dim, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std, round(min(v), 4) AS min, round(max(v), 4) AS max, round(max(v) - min(v), 4) AS range FROM u GROUP BY 1, 2")
def a20_feature_stats(spark, sf):
    return S.feature_stats(vectors(spark, sf))


@query(f"{_V}, u AS (SELECT clip_id, unnest(x)::DOUBLE AS v FROM fx_vec_frames) SELECT clip_id, round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM u GROUP BY 1")
def a21_vector_stats(spark, sf):
    return S.vector_stats(vectors(spark, sf), "x")


@query(f"{_H}, f AS (SELECT clip_id, frame_idx, max(t_ms) AS t, count(*) FILTER (visible) AS n, count(*) AS o FROM fx_holistic GROUP BY 1, 2) SELECT clip_id, count(*) AS frames, 156 AS width, round((max(t) - min(t)) / 1000.0, 6) AS duration_s, round(sum(n)::DOUBLE / sum(o)::DOUBLE * 100, 6) AS coverage_pct, round(count(*) / ((max(t) - min(t)) / 1000.0), 6) AS fps, CASE WHEN count(*) > 30 THEN 'trim' WHEN count(*) < 30 THEN 'pad' ELSE 'fits' END AS fit FROM f GROUP BY 1")
def a25_sequence_overview(spark, sf):
    return S.sequence_overview(frames(spark, sf), 30)


@query(f"{_V}, u AS (SELECT clip_id, unnest(range(len(x)))::INT AS dim, unnest(x)::DOUBLE AS v FROM fx_vec_frames) SELECT clip_id, dim, round(avg(v), 6) AS v FROM u GROUP BY 1, 2")
def a26_pool_sequence(spark, sf):
    pooled = S.pool_sequence(vectors(spark, sf))
    return pooled.select("clip_id", F.posexplode("pooled").alias("dim", "v"))


_EDGES = ", ".join(f"({O.LAYOUT.groups[g][0] + a}, {O.LAYOUT.groups[g][0] + b})" for g, es in (("pose", S.POSE_EDGES), ("left_hand", S.HAND_EDGES), ("right_hand", S.HAND_EDGES), ("face", S.FACE_EDGES)) for a, b in es)
# Some points stand at the origin, so that edges without an end occur.
_AT_ORIGIN = "(clip_id + frame_idx + kp) % 11 = 0"


@query(
    f"{_H}, pt AS (SELECT clip_id, frame_idx, kp, CASE WHEN {_AT_ORIGIN} THEN 0.0::DOUBLE ELSE x END AS x, CASE WHEN {_AT_ORIGIN} THEN 0.0::DOUBLE ELSE y END AS y FROM fx_holistic), e AS (SELECT * FROM (VALUES {_EDGES}) v(a, b)) "
    ", fr AS MATERIALIZED (SELECT clip_id, frame_idx, list(x ORDER BY kp) AS xs, list(y ORDER BY kp) AS ys FROM pt GROUP BY 1, 2), sg AS (SELECT clip_id, frame_idx, a, b, xs[a + 1] AS x1, ys[a + 1] AS y1, xs[b + 1] AS x2, ys[b + 1] AS y2 FROM fr, e) "
    "SELECT clip_id, frame_idx, a, b, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2 FROM sg WHERE NOT (x1 = 0 AND y1 = 0) AND NOT (x2 = 0 AND y2 = 0)"
)
def j10_skeleton_segments(spark, sf):
    df = points(spark, sf)
    moved = df.withColumns({c: F.when(F.expr(_AT_ORIGIN), 0.0).otherwise(F.col(c)) for c in ("x", "y")})
    return S.skeleton_segments(moved, S.edge_table(spark)).select("clip_id", "frame_idx", "a", "b", "x1", "y1", "x2", "y2")


# --- occlusion ---------------------------------------------------------------------------------

_BOX = "[" + ", ".join("[" + ", ".join(f"{v}::DOUBLE" for v in b) + "]" for b in O.FACE_BOXES) + "]"
_DETECT = f"""{_H}, fc AS (SELECT clip_id, frame_idx, kp - 67 AS i, x, y, visible AND x BETWEEN {_BOX}[kp - 66][1] AND {_BOX}[kp - 66][2] AND y BETWEEN {_BOX}[kp - 66][3] AND {_BOX}[kp - 66][4] AS ok, visible FROM fx_holistic WHERE kp >= 67),
fa AS MATERIALIZED (SELECT clip_id, frame_idx, count(*) FILTER (ok) AS k, greatest(0.5::DOUBLE, least(2.0::DOUBLE, ((max(x) FILTER (ok) - min(x) FILTER (ok)) + (max(y) FILTER (ok) - min(y) FILTER (ok))) / 2 / 0.35::DOUBLE)) AS s, {", ".join(f"max(x) FILTER (ok AND i = {i}) AS x{i}, max(y) FILTER (ok AND i = {i}) AS y{i}" for i in range(11))} FROM fc GROUP BY 1, 2 HAVING count(*) FILTER (visible) >= 3 AND count(*) FILTER (ok) >= 3),
rg AS MATERIALIZED (SELECT clip_id, frame_idx, 'forehead' AS region, x7 AS cx, y7 AS cy, 0.12::DOUBLE * s AS r FROM fa WHERE x0 IS NOT NULL AND x7 IS NOT NULL UNION ALL SELECT clip_id, frame_idx, 'cheeks', (x1 + x2) / 2, (y1 + y2) / 2, 0.15::DOUBLE * s FROM fa WHERE x0 IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL
 UNION ALL SELECT clip_id, frame_idx, 'nose', x0, y0, 0.10::DOUBLE * s FROM fa WHERE x0 IS NOT NULL UNION ALL SELECT clip_id, frame_idx, 'mouth', (x5 + x6) / 2, (y5 + y6) / 2, 0.12::DOUBLE * s FROM fa WHERE x0 IS NOT NULL AND x5 IS NOT NULL AND x6 IS NOT NULL
 UNION ALL SELECT clip_id, frame_idx, 'neck', x8, y8 + 0.05::DOUBLE * s, 0.15::DOUBLE * s FROM fa WHERE x0 IS NOT NULL AND x8 IS NOT NULL),
hp AS (SELECT h.clip_id, h.frame_idx, CASE WHEN kp < 46 THEN 'left_hand' ELSE 'right_hand' END AS hand, (kp - 25) % 21 AS j, x, y, visible, visible AND x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1 AS ok FROM fx_holistic h SEMI JOIN fa ON fa.clip_id = h.clip_id AND fa.frame_idx = h.frame_idx WHERE kp BETWEEN 25 AND 66),
hs AS (SELECT clip_id, frame_idx, hand, count(*) FILTER (ok AND j IN (5, 9, 13, 17)) AS m, avg(x) FILTER (ok AND j IN (5, 9, 13, 17)) AS mx, avg(y) FILTER (ok AND j IN (5, 9, 13, 17)) AS my, max(x) FILTER (ok AND j = 0) AS wx, max(y) FILTER (ok AND j = 0) AS wy, count(*) FILTER (ok AND j IN (4, 8, 12, 16, 20)) AS nt FROM hp GROUP BY 1, 2, 3 HAVING count(*) FILTER (visible) >= 3),
hd AS MATERIALIZED (SELECT clip_id, frame_idx, hand, nt, CASE WHEN m >= 2 THEN mx ELSE wx END AS px, CASE WHEN m >= 2 THEN my ELSE wy END AS py FROM hs),
hn AS MATERIALIZED (SELECT *, count(px) OVER (PARTITION BY clip_id, hand ORDER BY frame_idx) AS n FROM hd),
hk AS (SELECT clip_id, hand, frame_idx, q, n - 5 + q AS n FROM hn, (SELECT unnest(range(1, 6)) AS q) WHERE n >= 5),
tr AS MATERIALIZED (SELECT a.clip_id, a.hand, a.frame_idx, a.q, b.px, b.py FROM hk a JOIN (SELECT * FROM hn WHERE px IS NOT NULL) b ON a.clip_id = b.clip_id AND a.hand = b.hand AND a.n = b.n),
td AS (SELECT tr.clip_id, tr.hand, tr.frame_idx, region, q, sqrt(pow(px - cx, 2) + pow(py - cy, 2)) AS d, r FROM tr JOIN rg ON rg.clip_id = tr.clip_id AND rg.frame_idx = tr.frame_idx),
tl AS (SELECT *, lag(d) OVER (PARTITION BY clip_id, hand, frame_idx, region ORDER BY q) AS b FROM td),
ap AS (SELECT clip_id, hand, frame_idx, region, count(*) FILTER (d < b) AS falls, max(d) FILTER (q = 1) AS d0, max(d) FILTER (q = 5) AS d4 FROM tl GROUP BY 1, 2, 3, 4),
tp AS (SELECT hp.clip_id, hp.frame_idx, hp.hand, region, min(sqrt(pow(x - cx, 2) + pow(y - cy, 2))) AS d FROM hp JOIN rg ON rg.clip_id = hp.clip_id AND rg.frame_idx = hp.frame_idx WHERE ok AND j IN (4, 8, 12, 16, 20) GROUP BY 1, 2, 3, 4),
sc AS (SELECT hd.clip_id, hd.frame_idx, hd.hand, rg.region, nt, r, px, tp.d AS t, sqrt(pow(px - cx, 2) + pow(py - cy, 2)) AS p, falls, d0, d4 FROM hd JOIN rg ON rg.clip_id = hd.clip_id AND rg.frame_idx = hd.frame_idx LEFT JOIN tp ON tp.clip_id = hd.clip_id AND tp.frame_idx = hd.frame_idx AND tp.hand = hd.hand AND tp.region = rg.region LEFT JOIN ap ON ap.clip_id = hd.clip_id AND ap.frame_idx = hd.frame_idx AND ap.hand = hd.hand AND ap.region = rg.region),
cf AS (SELECT clip_id, frame_idx, hand, region, least(1.0::DOUBLE, CASE WHEN t <= r THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN p <= r * 1.5 THEN greatest(0, 1 - p / (r * 1.5)) * 0.3 ELSE 0 END + CASE WHEN falls >= 2 AND d4 <= r * 1.5 AND d0 > 0 THEN greatest(0, (d0 - d4) / d0) * 0.15 ELSE 0 END
 + CASE WHEN px IS NOT NULL AND nt >= 2 AND least(p, t) <= r * 1.8 THEN greatest(0, 1 - least(p, t) / (r * 1.8)) * 0.05 ELSE 0 END) AS c FROM sc),
ht AS (SELECT clip_id, frame_idx, string_agg(DISTINCT region, ',' ORDER BY region) AS regions, list_distinct(list(region)) AS rl, max(c) AS c FROM cf WHERE c > 0.4 GROUP BY 1, 2),
de AS (SELECT f.clip_id, f.frame_idx, ht.c IS NOT NULL AS detected, coalesce(regions, '') AS regions, coalesce(rl, []) AS rl, coalesce(ht.c, 0.0::DOUBLE) AS confidence FROM (SELECT DISTINCT clip_id, frame_idx FROM fx_holistic) f LEFT JOIN ht ON ht.clip_id = f.clip_id AND ht.frame_idx = f.frame_idx)"""
_FILTER = f"""{_DETECT}, wi AS (SELECT *, detected AND confidence >= 0.2 AS ok, count(*) OVER w AS n, count(*) FILTER (detected AND confidence >= 0.2) OVER w AS k, avg(confidence) FILTER (detected AND confidence >= 0.2) OVER w AS a FROM de WINDOW w AS (PARTITION BY clip_id ORDER BY frame_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
rs AS (SELECT a.clip_id, a.frame_idx, string_agg(DISTINCT u.region, ',' ORDER BY u.region) AS regions FROM wi a JOIN (SELECT clip_id, frame_idx, unnest(rl) AS region FROM wi WHERE ok) u ON u.clip_id = a.clip_id AND u.frame_idx BETWEEN a.frame_idx - 2 AND a.frame_idx + 2 GROUP BY 1, 2),
fl AS (SELECT wi.clip_id, wi.frame_idx, n >= 5 AND k >= 3 AS detected, coalesce(rs.regions, '') AS regions, coalesce(a, 0.0::DOUBLE) AS confidence FROM wi LEFT JOIN rs ON rs.clip_id = wi.clip_id AND rs.frame_idx = wi.frame_idx)"""


@query(_DETECT + " SELECT clip_id, frame_idx, k::INT AS valid, round(s, 6) AS scale FROM fa")
def o1_valid_face(spark, sf):
    df = O.valid_face(frames(spark, sf)).filter("face IS NOT NULL")
    return df.select("clip_id", "frame_idx", F.size(F.filter("face", lambda p: p.isNotNull())).alias("valid"), O.face_scale(F.col("face")).alias("scale"))


@query(_DETECT + " SELECT clip_id, frame_idx, region, round(cx, 6) AS x, round(cy, 6) AS y, round(r, 6) AS r FROM rg")
def o3_head_regions(spark, sf):
    df = O.head_regions(O.valid_face(frames(spark, sf))).select("clip_id", "frame_idx", F.explode_outer("regions").alias("g")).filter("g IS NOT NULL")
    return df.select("clip_id", "frame_idx", F.col("g.name").alias("region"), "g.x", "g.y", "g.r")


@query(_DETECT + " SELECT clip_id, frame_idx, hand, nt::INT AS tips, round(px, 6) AS px, round(py, 6) AS py FROM hd")
def o4_hand_points(spark, sf):
    df = O.hand_points(O.valid_face(frames(spark, sf)).filter("face IS NOT NULL"))
    return df.select("clip_id", "frame_idx", "hand", F.size("tips").alias("tips"), F.col("palm.x").alias("px"), F.col("palm.y").alias("py"))


@query(_DETECT + " SELECT clip_id, frame_idx, hand, region, round(c, 6) AS confidence FROM cf")
def o5_region_confidence(spark, sf):
    faces = O.head_regions(O.valid_face(frames(spark, sf))).filter("face IS NOT NULL")
    return O.region_confidence(O.approach(O.hand_points(faces)))


@query(_DETECT + " SELECT clip_id, frame_idx, detected, regions, round(confidence, 6) AS confidence FROM de")
def o6_detect_frames(spark, sf):
    return O.detect_frames(frames(spark, sf)).withColumn("regions", F.array_join("regions", ","))


@query(_FILTER + " SELECT clip_id, frame_idx, detected, regions, round(confidence, 6) AS confidence FROM fl")
def w7_consecutive_filter(spark, sf):
    return O.consecutive_filter(O.detect_frames(frames(spark, sf))).withColumn("regions", F.array_join("regions", ","))


@query(_FILTER + " SELECT clip_id, max(detected::INT) AS binary_flag, round(avg(detected::INT), 6) AS occlusion_rate, count(*) AS total_frames, count(*) FILTER (detected) AS occluded_frames, string_agg(frame_idx || ':' || detected::INT || ':' || regions || ':' || printf('%.4f', round(confidence, 4)), ';' ORDER BY frame_idx) AS details FROM fl GROUP BY 1")
def o7_occlusion(spark, sf):
    text = lambda d: F.concat_ws(":", d["frame_idx"].cast("string"), d["detected"].cast("int").cast("string"), F.array_join(d["regions"], ","), F.format_string("%.4f", F.round(d["confidence"], 4)))
    return O.occlusion(frames(spark, sf), dealt=True).withColumn("details", F.array_join(F.transform("details", text), ";"))


@query("WITH c AS (SELECT user_id AS clip_id, event_type AS region, event_id AS frame_idx, value AS v FROM events), w AS (SELECT *, row_number() OVER (PARTITION BY clip_id, region ORDER BY frame_idx) AS k, sum((v > 100)::INT) OVER (PARTITION BY clip_id, region ORDER BY frame_idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS n FROM c) SELECT clip_id, region, frame_idx, CASE WHEN k < 5 THEN v > 100 ELSE n > 2 END AS vote FROM w")
def w8_majority_vote(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    rows = events.select(F.col("user_id").alias("clip_id"), F.col("event_type").alias("region"), F.col("event_id").alias("frame_idx"), F.col("value").alias("pixels"))
    return O.majority_vote(rows).drop("pixels")


@query(
    f"{_H}, f AS (SELECT clip_id, frame_idx, count(*) FILTER (visible) / count(*)::DOUBLE < 0.955 AS bad FROM fx_holistic GROUP BY 1, 2), i AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY frame_idx) - row_number() OVER (PARTITION BY clip_id, bad ORDER BY frame_idx) AS g FROM f), r AS (SELECT clip_id, bad, g, count(*) AS n FROM i GROUP BY 1, 2, 3) "
    "SELECT clip_id, sum(n)::BIGINT AS frames, sum(CASE WHEN bad THEN n ELSE 0 END)::BIGINT AS bad_frames, max(CASE WHEN bad THEN n ELSE 0 END)::BIGINT AS longest_run, sum(CASE WHEN bad THEN n ELSE 0 END)::DOUBLE / sum(n)::DOUBLE >= 0.4 OR max(CASE WHEN bad THEN n ELSE 0 END) >= 15 AS occluded FROM r GROUP BY 1"
)
def w9_visibility_run_flag(spark, sf):
    return O.visibility_run_flag(frames(spark, sf), visible=0.955)


@query(_FILTER + " SELECT clip_id, frame_idx, detected AS occluded FROM fl")
def j6_join_frame_occlusion(spark, sf):
    details = O.occlusion(frames(spark, sf), dealt=True).select("clip_id", F.transform("details", lambda d: F.struct(d["frame_idx"].alias("frame_idx"), d["detected"].alias("occlusion_detected"))).alias("detailed_results"))
    clips = details.select("clip_id", F.to_json(F.struct(F.struct("detailed_results").alias("occlusion_results"))).alias("meta"))
    return O.join_frame_occlusion(keys(spark, sf), clips)


_MARKS = {"forehead": 7, "left_eye": 1, "right_eye": 2, "nose": 0, "mouth_left": 5, "mouth_right": 6, "chin": 8}
_MARK_SQL = ", ".join("{'x': max(x) FILTER (kp = %d), 'y': max(y) FILTER (kp = %d)} AS %s" % (67 + i, 67 + i, n) for n, i in _MARKS.items())
_CORNERS = {
    "forehead": ("forehead.x, forehead.y", "left_eye.x, forehead.y", "right_eye.x, forehead.y", "left_eye.x, left_eye.y", "right_eye.x, right_eye.y"),
    "cheeks": ("left_eye.x, left_eye.y", "right_eye.x, right_eye.y", "nose.x, nose.y", "left_eye.x - 0.08, nose.y", "right_eye.x + 0.08, nose.y"),
    "nose": ("nose.x - 0.06, nose.y - 0.04", "nose.x + 0.06, nose.y - 0.04", "nose.x + 0.06, nose.y + 0.04", "nose.x - 0.06, nose.y + 0.04"),
    "mouth": ("mouth_left.x, mouth_left.y", "mouth_right.x, mouth_right.y", "chin.x, chin.y", "mouth_left.x, chin.y", "mouth_right.x, chin.y"),
    "neck": ("chin.x - 0.12, chin.y", "chin.x + 0.12, chin.y", "chin.x + 0.16, chin.y + 0.20", "chin.x - 0.16, chin.y + 0.20"),
}


@query(
    f"{_H}, mk AS (SELECT clip_id, frame_idx, {_MARK_SQL} FROM fx_holistic GROUP BY 1, 2) "
    + " UNION ALL ".join(f"SELECT clip_id, frame_idx, '{region}' AS region, {n} AS corner, round({c.split(', ')[0]}, 6) AS x, round({c.split(', ')[1]}, 6) AS y FROM mk" for region, corners in _CORNERS.items() for n, c in enumerate(corners))
)
def o8_head_polygons(spark, sf):
    at = lambda i: F.struct(F.col("x")[2 * (67 + i)].alias("x"), F.col("x")[2 * (67 + i) + 1].alias("y"))
    marks = frames(spark, sf).select("clip_id", "frame_idx", *[at(i).alias(n) for n, i in _MARKS.items()])
    return O.head_polygons(marks).select("clip_id", "frame_idx", "region", F.posexplode("polygon").alias("corner", "p")).select("clip_id", "frame_idx", "region", "corner", "p.x", "p.y")


# --- quality, runs, scoring, files -------------------------------------------------------------


@query(
    f"WITH {_META_SQL}, t AS (SELECT clip_id, CASE k WHEN 0 THEN [] WHEN 1 THEN [] WHEN 2 THEN ['meta.dims_per_frame != 156 (got 150)', 'meta.keypoints_total != 78 (got None)', 'meta.order unexpected: other'] WHEN 3 THEN ['meta.dims_per_frame != 156 (got None)', 'meta.keypoints_total != 78 (got None)', 'meta.order unexpected: None'] ELSE ['meta is not valid JSON'] END AS i FROM m) SELECT clip_id, array_to_string(i, '; ') AS issues FROM t"
)
def v1_validate_clips(spark, sf):
    df = frames(spark, sf).withColumn("x", A.clip_unit(F.col("x")))
    return Q.validate_clips(clip_meta(spark, sf), df).select("clip_id", F.array_join("issues", "; ").alias("issues"))


_OUT = f"{_H}, o AS (SELECT clip_id, count(*) FILTER (x < 0 OR x > 1 OR y < 0 OR y > 1) > 0 AS out FROM fx_holistic GROUP BY 1)"


@query(_OUT + " SELECT clip_id, NOT out AS transformer_ready, false AS iv3_ready, CASE WHEN out THEN 'X outside [0,1] range (expected normalized)' ELSE '' END AS transformer_issues, 'X2048 missing (required for IV3-GRU)' AS iv3_issues FROM o")
def v2_readiness(spark, sf):
    out = Q.readiness(frames(spark, sf))
    return out.select("clip_id", "transformer_ready", "iv3_ready", F.array_join("transformer_issues", "; ").alias("transformer_issues"), F.array_join("iv3_issues", "; ").alias("iv3_issues"))


@query(_OUT + " SELECT clip_id, true AS x_ok, true AS mask_ok, true AS monotonic, false AS x2048_ok FROM o")
def v4_data_checks(spark, sf):
    return Q.data_checks(frames(spark, sf))


@query(_OUT + ", i AS (SELECT 'X outside [0,1] range (expected normalized)' AS issue FROM o WHERE out UNION ALL SELECT 'X2048 missing (required for IV3-GRU)' FROM o) SELECT issue, count(*) AS n FROM i GROUP BY 1")
def a22_audit_summary(spark, sf):
    return Q.audit_summary(Q.readiness(frames(spark, sf)))


@query(_OUT + " SELECT count(*) AS total, count(*) FILTER (NOT out) AS transformer_ready, 0::BIGINT AS iv3_ready FROM o")
def a22_audit_totals(spark, sf):
    return Q.audit_totals(Q.readiness(frames(spark, sf)))


# Clips with one defect each, by their number: widths, missing and wild values, times, masks, X2048.
DEFECTS = 14
_BROKEN = f"""{_H}, {_META_SQL}, bf AS (SELECT clip_id, frame_idx, clip_id % {DEFECTS} AS d, max(t_ms) AS t0, list(greatest(0.0::DOUBLE, least(1.0::DOUBLE, x)) ORDER BY kp) || list(greatest(0.0::DOUBLE, least(1.0::DOUBLE, y)) ORDER BY kp) AS v0, list(visible ORDER BY kp) AS m0 FROM fx_holistic GROUP BY 1, 2, 3),
bb AS (SELECT clip_id, frame_idx, d, CASE WHEN d = 7 AND frame_idx = 3 THEN 0 WHEN d = 8 THEN t0 - 100000 ELSE t0 END AS t,
  CASE WHEN d = 3 AND frame_idx = 1 THEN NULL WHEN d = 1 THEN v0[1:155] WHEN d = 4 AND frame_idx = 2 THEN ['nan'::DOUBLE] || v0[2:156] WHEN d = 5 AND frame_idx = 2 THEN ['-inf'::DOUBLE] || v0[2:156] WHEN d = 6 AND frame_idx = 0 THEN [1.5::DOUBLE] || v0[2:156] ELSE v0 END AS v,
  CASE WHEN d = 2 THEN m0[1:77] WHEN d = 9 THEN list_transform(m0, lambda b: false) ELSE m0 END AS m,
  CASE WHEN d = 13 OR (d = 11 AND frame_idx >= 10) THEN NULL WHEN d = 10 THEN 2047 ELSE 2048 END AS c, d = 12 AND frame_idx = 0 AS cw FROM bf),
bl AS (SELECT *, lag(t) OVER (PARTITION BY clip_id ORDER BY frame_idx) AS was FROM bb),
fa AS (SELECT clip_id, count(*) AS n, bool_or(len(v) <> 156) AS bad_x, bool_or(len(m) <> 78) AS bad_m, count(v) AS x_n, max(len(v)) FILTER (len(v) <> 156) AS x_w, max(len(m)) FILTER (len(m) <> 78) AS m_w, bool_or(v IS NULL) AS ragged,
  bool_or(len(list_filter(v, lambda a: isnan(a) OR isinf(a))) > 0) AS wild, bool_or(len(list_filter(v, lambda a: NOT isnan(a) AND (a < 0 OR a > 1))) > 0) AS out, bool_or(list_contains(m, true)) AS seen,
  bool_or(t < was) AS down, bool_or(t < 0) AS negative, count(c) AS cnn_n, bool_or(c <> 2048) AS bad_c, bool_or(cw) AS c_wild FROM bl GROUP BY 1)"""
_BROKEN_READY = _BROKEN + """, rd AS (SELECT clip_id, list_filter([CASE WHEN bad_x THEN 'X shape/dtype incorrect (expected [T,156] float32)' END, CASE WHEN bad_m THEN 'mask shape/dtype incorrect (expected [T,78] bool)' END, CASE WHEN wild THEN 'non-finite values in X' END,
  CASE WHEN out THEN 'X outside [0,1] range (expected normalized)' END, CASE WHEN down THEN 'timestamps not monotonic' END], lambda i: i IS NOT NULL) AS ti,
  list_filter([CASE WHEN cnn_n = 0 THEN 'X2048 missing (required for IV3-GRU)' END, CASE WHEN bad_c THEN 'X2048 shape/dtype incorrect (expected [T,2048] float32)' END, CASE WHEN cnn_n > 0 AND cnn_n <> n THEN 'X2048 temporal mismatch: X(' || n || ') vs X2048(' || cnn_n || ')' END, CASE WHEN c_wild THEN 'non-finite values in X2048' END], lambda i: i IS NOT NULL) AS ii FROM fa)"""


def broken(spark, sf):
    """Valid frames with features, but for the defect of each clip."""
    x, m, d, i = F.col("x"), F.col("mask"), F.col("clip_id") % DEFECTS, F.col("frame_idx")
    rest = F.slice(x, 2, 155)
    first = lambda v: F.concat(F.array(F.lit(v)), rest)
    features = F.array_repeat(F.lit(0.5).cast("float"), 2048)
    return (
        frames(spark, sf)
        .withColumn("x", A.clip_unit(x))
        .withColumns(
            {
                "t_ms": F.when((d == 7) & (i == 3), 0).when(d == 8, F.col("t_ms") - 100000).otherwise(F.col("t_ms")),
                "x": F.when((d == 3) & (i == 1), None).when(d == 1, F.slice(x, 1, 155)).when((d == 4) & (i == 2), first(float("nan"))).when((d == 5) & (i == 2), first(float("-inf"))).when((d == 6) & (i == 0), first(1.5)).otherwise(x),
                "mask": F.when(d == 2, F.slice(m, 1, 77)).when(d == 9, F.transform(m, lambda _: F.lit(False))).otherwise(m),
                "x2048": F.when((d == 13) | ((d == 11) & (i >= 10)), None).when(d == 10, F.slice(features, 1, 2047)).when((d == 12) & (i == 0), F.concat(F.array(F.lit(float("nan")).cast("float")), F.slice(features, 1, 2047))).otherwise(features),
            }
        )
    )


@query(
    _BROKEN
    + """, mi AS (SELECT clip_id, CASE k WHEN 2 THEN ['meta.dims_per_frame != 156 (got 150)', 'meta.keypoints_total != 78 (got None)', 'meta.order unexpected: other'] WHEN 3 THEN ['meta.dims_per_frame != 156 (got None)', 'meta.keypoints_total != 78 (got None)', 'meta.order unexpected: None'] ELSE [] END AS i, k > 3 AS bad FROM m)
SELECT clip_id, array_to_string(list_filter([CASE WHEN bad THEN 'meta is not valid JSON' END, CASE WHEN n IS NULL THEN 'empty sequence (T == 0)' END,
  CASE WHEN bad_x THEN 'X bad shape/dtype: (' || x_n || ', ' || coalesce(x_w, 156) || ') float32' END, CASE WHEN bad_m THEN 'mask bad shape/dtype: (' || n || ', ' || coalesce(m_w, 78) || ') bool' END, CASE WHEN ragged THEN 'T mismatch among X/mask/timestamps_ms' END,
  CASE WHEN wild THEN 'X has non-finite values' END, CASE WHEN out THEN 'X outside [0,1]' END, CASE WHEN down THEN 'timestamps_ms not monotonic nondecreasing' END, CASE WHEN negative THEN 'timestamps_ms contains negative values' END,
  CASE WHEN NOT seen THEN 'mask has no visible keypoints across all frames' END] || i || [CASE WHEN cnn_n = 0 THEN 'missing key: X2048 (required)' END, CASE WHEN cnn_n > 0 AND (bad_c OR cnn_n <> n) THEN 'X2048 bad shape/dtype' END,
  CASE WHEN c_wild THEN 'X2048 has non-finite values' END], lambda t: t IS NOT NULL), '; ') AS issues FROM mi LEFT JOIN fa USING (clip_id)"""
)
def v1_broken_clips(spark, sf):
    return Q.validate_clips(clip_meta(spark, sf), broken(spark, sf), require_cnn=True).select("clip_id", F.array_join("issues", "; ").alias("issues"))


@query(_BROKEN_READY + " SELECT clip_id, len(ti) = 0 AS transformer_ready, len(ii) = 0 AS iv3_ready, array_to_string(ti, '; ') AS transformer_issues, array_to_string(ii, '; ') AS iv3_issues FROM rd")
def v2_broken_clips(spark, sf):
    out = Q.readiness(broken(spark, sf))
    return out.select("clip_id", "transformer_ready", "iv3_ready", F.array_join("transformer_issues", "; ").alias("transformer_issues"), F.array_join("iv3_issues", "; ").alias("iv3_issues"))


@query(_BROKEN + " SELECT clip_id, NOT coalesce(bad_x, false) AS x_ok, NOT bad_m AS mask_ok, NOT down AS monotonic, cnn_n > 0 AND NOT bad_c AS x2048_ok FROM fa")
def v4_broken_clips(spark, sf):
    return Q.data_checks(broken(spark, sf))


@query(_BROKEN_READY + ", i AS (SELECT unnest(ti || ii) AS issue FROM rd), n AS (SELECT issue, count(*) AS n FROM i GROUP BY 1) SELECT issue, n FROM n ORDER BY n DESC, issue LIMIT 20")
def a22_broken_summary(spark, sf):
    return Q.audit_summary(Q.readiness(broken(spark, sf)))


@query(_BROKEN_READY + " SELECT count(*) AS total, count(*) FILTER (len(ti) = 0) AS transformer_ready, count(*) FILTER (len(ii) = 0) AS iv3_ready FROM rd")
def a22_broken_totals(spark, sf):
    return Q.audit_totals(Q.readiness(broken(spark, sf)))


@query(f"WITH {_META_SQL} SELECT clip_id, CASE WHEN k IN (0, 1) THEN true WHEN k IN (2, 3) THEN false ELSE true END AS transformer, CASE WHEN k IN (1, 2) THEN true WHEN k IN (0, 3) THEN false ELSE x2048_width = 2048 END AS iv3_gru, CASE WHEN k = 1 THEN true WHEN k IN (0, 2, 3) THEN false ELSE x2048_width = 2048 END AS both FROM m")
def p8_model_compat(spark, sf):
    return Q.model_compat(clip_meta(spark, sf)).select("clip_id", "transformer", "iv3_gru", "both")


@query(f"WITH {_META_SQL} SELECT clip_id, CASE k WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE -1 END AS occlusion_flag, CASE k WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' ELSE 'Unknown' END AS occlusion_text FROM m")
def p9_occlusion_status(spark, sf):
    return Q.occlusion_status(clip_meta(spark, sf)).select("clip_id", "occlusion_flag", "occlusion_text")


@query(f"WITH {_META_SQL} SELECT clip_id, k < 4 AS meta_ok, CASE k WHEN 0 THEN 'dims_per_frame,keypoints_total,order,model_type,occluded_flag' WHEN 1 THEN 'dims_per_frame,keypoints_total,order,model_type,occluded_flag' WHEN 2 THEN 'dims_per_frame,order,model_type' WHEN 3 THEN 'model_type' END AS keys FROM m")
def p16_parse_meta(spark, sf):
    return Q.meta_summary(clip_meta(spark, sf)).select("clip_id", "meta_ok", F.array_join("meta_keys", ",").alias("keys"))


@query(f"WITH {_META_SQL} SELECT count(*) AS files, count(*) FILTER (clip_id % 3 <> 0) AS predicted, count(*) FILTER (from_video) AS from_video, count(*) FILTER (k IN (0, 1, 4, 5)) AS transformer, count(*) FILTER (k IN (1, 2) OR (k > 3 AND x2048_width = 2048)) AS iv3_gru, count(*) FILTER (k = 0) AS occluded FROM m")
def a23_batch_summary(spark, sf):
    clips = Q.occlusion_status(Q.model_compat(clip_meta(spark, sf)))
    return R.batch_summary(clips, clips.filter("clip_id % 3 <> 0"))


@query(
    f"""WITH {_META_SQL}, {duck("fx_label_ref")}, g AS (SELECT gloss_id, max(label) AS label FROM fx_label_ref GROUP BY 1), c AS (SELECT cat_id, max(category) AS category FROM fx_label_ref GROUP BY 1),
b AS (SELECT *, clip_id % 30 AS gp, clip_id % 7 AS cp, (300 + clip_id * 7919 % 700)::DOUBLE / 1000 AS pr, clip_id % 3 <> 0 AS has FROM m)
SELECT clip_id AS file, 'NPZ' AS type, CASE WHEN from_video THEN 'Video' ELSE 'Original' END AS source, (clip_id % 50)::INT AS frames, CASE WHEN k IN (0, 1, 4, 5) THEN 'Yes' ELSE 'No' END AS transformer, CASE WHEN k IN (1, 2) OR (k > 3 AND x2048_width = 2048) THEN 'Yes' ELSE 'No' END AS iv3_gru,
 CASE WHEN has THEN coalesce(label, 'Unknown (' || gp || ')') || printf(' (%.1f%%)', round(pr * 100, 1)) ELSE 'Prediction Failed' END AS top_gloss, CASE WHEN has THEN coalesce(category, 'Unknown (' || cp || ')') || printf(' (%.1f%%)', round(pr / 2 * 100, 1)) ELSE 'Prediction Failed' END AS top_category,
 CASE k WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' ELSE 'Unknown' END AS occluded, CASE WHEN has THEN 'completed' ELSE 'failed' END AS status FROM b LEFT JOIN g ON g.gloss_id = gp LEFT JOIN c ON c.cat_id = cp"""
)
def a23_batch_files(spark, sf):
    clips = Q.occlusion_status(Q.model_compat(clip_meta(spark, sf))).withColumn("n_frames", (F.col("clip_id") % 50).cast("int"))
    prob = (300 + F.col("clip_id") * 7919 % 700) / 1000
    found = clips.filter("clip_id % 3 <> 0").select("clip_id", (F.col("clip_id") % 30).alias("gloss_pred"), (F.col("clip_id") % 7).alias("cat_pred"), prob.alias("gloss_prob"), (prob / 2).alias("cat_prob"))
    return R.batch_files(clips, found, ref(spark, sf))


@query("SELECT count(*) FILTER (event_type <> 'error') AS successes, count(*) FILTER (event_type = 'error') AS failures, round(sum(value) FILTER (event_type <> 'error'), 6) AS total_s, round(avg(value) FILTER (event_type <> 'error'), 6) AS mean_s, round(3600 / avg(value) FILTER (event_type <> 'error'), 6) AS videos_per_hour FROM events")
def a27_run_summary(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    return R.run_summary(events.select(F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"), F.col("value").alias("seconds")))


def _epochs(spark, sf):
    """One run for each customer, one epoch for each of its orders."""
    return spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_custkey AS run", "cast(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS int) AS epoch", "cast((o_orderkey * 7919) % 100 AS double) / 100 AS val_gloss_acc")


_EPOCHS = "WITH ep AS (SELECT o_custkey AS run, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS epoch, ((o_orderkey * 7919) % 100)::DOUBLE / 100 AS acc FROM orders)"


@query(_EPOCHS + " SELECT run, arg_min(epoch, (-acc, epoch)) AS best_epoch, max(acc) AS best_gloss_acc FROM ep GROUP BY 1")
def w13_best_epoch(spark, sf):
    return R.best_epoch(_epochs(spark, sf))


@query(
    _EPOCHS
    + ", b AS (SELECT *, max(acc) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM ep), i AS (SELECT *, m IS NULL OR acc > m AS improved FROM b), w AS (SELECT *, epoch - max(CASE WHEN improved THEN epoch END) OVER (PARTITION BY run ORDER BY epoch) AS waited FROM i) "
    "SELECT run, epoch, improved, waited, min(CASE WHEN waited >= 4 THEN epoch END) OVER (PARTITION BY run) AS stop_epoch FROM w"
)
def w13_early_stop(spark, sf):
    return R.early_stop(_epochs(spark, sf), 4).drop("val_gloss_acc")


@query(
    "WITH f AS (SELECT CASE o_orderkey % 4 WHEN 0 THEN 'npz' WHEN 1 THEN 'video' WHEN 2 THEN 'video' ELSE 'unknown' END AS type, o_custkey AS b, o_orderkey % 3 = 0 AS known, o_orderstatus = 'F' AS occ FROM orders), "
    "g AS (SELECT type, count(*) AS files, sum(b)::BIGINT AS bytes, count(*) FILTER (known) AS labelled, count(*) FILTER (known AND occ) AS occluded FROM f GROUP BY 1) "
    "SELECT *, CASE WHEN bytes < 1024 THEN bytes || ' B' WHEN bytes < 1048576 THEN printf('%.1f KB', round(bytes / 1024.0::DOUBLE, 1)) WHEN bytes < 1073741824 THEN printf('%.1f MB', round(bytes / 1048576.0::DOUBLE, 1)) ELSE printf('%.1f GB', round(bytes / 1073741824.0::DOUBLE, 1)) END AS size FROM g"
)
def s11_file_inventory(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    name = F.col("o_orderkey").cast("string")
    ext = F.element_at(F.array(*map(F.lit, (".npz", ".MP4", ".mov", ".avi"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    files = orders.select(F.concat(F.lit("/d/"), name, ext).alias("path"), F.col("o_custkey").alias("bytes"))
    known = orders.filter("o_orderkey % 3 = 0").select(F.concat(name, F.lit(".npz")).alias("file"), (F.col("o_orderstatus") == "F").cast("int").alias("occluded"))
    return C.file_inventory(files, known)


@query(f"{_H} SELECT clip_id, frame_idx, max(t_ms) AS t_ms, string_agg(CASE WHEN visible THEN '1' ELSE '0' END, '' ORDER BY kp) AS mask_bits, round(sum(x::FLOAT::DOUBLE) + sum(y::FLOAT::DOUBLE), 4) AS total FROM fx_holistic GROUP BY 1, 2")
def s3_wide_frames(spark, sf):
    wide = C.wide_frames(frames(spark, sf))
    return wide.select("clip_id", "frame_idx", "t_ms", "mask_bits", F.round(A.total(F.array(*[F.col(str(i)).cast("double") for i in range(156)])), 4).alias("total"))


@query(f"{_H} SELECT clip_id, frame_idx, max(t_ms) AS t_ms, 156 AS width, count(*) FILTER (visible)::INT AS visible FROM fx_holistic GROUP BY 1, 2")
def s4_narrow_frames(spark, sf):
    df = C.narrow_frames(C.wide_frames(frames(spark, sf)))
    return df.select("clip_id", "frame_idx", "t_ms", F.size("x").alias("width"), F.size(F.filter("mask", lambda v: v)).alias("visible"))


@query(
    "SELECT o_custkey AS run, (o_orderkey % 100000)::INT AS epoch, ((o_orderkey * 7919) % 1000)::DOUBLE / 1000 AS train_loss, ((o_orderkey * 6007) % 1000)::DOUBLE / 1000 AS val_gloss_acc, CASE o_custkey % 3 WHEN 0 THEN 'phase ' || (o_orderkey % 5) WHEN 1 THEN 'uncertainty' END AS weighting, "
    "CASE WHEN o_custkey % 3 < 2 THEN (o_orderkey % 100)::DOUBLE / 100 END AS alpha, CASE WHEN o_custkey % 3 < 2 THEN (100 - o_orderkey % 100)::DOUBLE / 100 END AS beta FROM orders"
)
def s10_parse_log(spark, sf):
    k, run = F.col("o_orderkey"), F.col("o_custkey")
    epoch = F.format_string("Epoch  %d/100000 | Train Loss: %.3f | Val Loss: 1.0 | Val Gloss Acc: %.3f | Val Cat Acc: 0.5 | Time: 2.5s", k % 100000, (k * 7919 % 1000) / 1000, (k * 6007 % 1000) / 1000)
    told = F.when(run % 3 == 0, F.format_string("  Curriculum: phase %d", k % 5)).when(run % 3 == 1, F.lit("  Loss Weighting: uncertainty"))
    weights = F.concat(told, F.format_string(" | Weights: α=%.3f, β=%.3f", (k % 100) / 100, (100 - k % 100) / 100))
    lines = spark.read.parquet(f"{sf}/orders.parquet").select(run.alias("run"), k.alias("order"), F.posexplode(F.array(F.lit("Training"), epoch, F.coalesce(weights, F.lit("done")))).alias("at", "value"))
    out = T.parse_log_lines(lines.select("run", F.struct("order", "at").alias("line"), "value"))
    return out.select("run", "epoch", "train_loss", "val_gloss_acc", "weighting", "alpha", "beta")


_VARIANTS = ("", ",alpha,beta,curriculum_phase", ",alpha,beta,loss_weighting_strategy")


@query(
    "SELECT o_custkey AS run, (o_orderkey % 100000)::INT AS epoch, ((o_orderkey * 7919) % 1000)::DOUBLE / 1000 AS train_loss, NULL::DOUBLE AS val_loss, ((o_orderkey * 6007) % 1000)::DOUBLE / 1000 AS lr, 0.5::DOUBLE AS gpu_memory_allocated, (o_orderkey % 7)::DOUBLE AS gpu_memory_reserved, "
    "CASE WHEN o_custkey % 3 > 0 THEN (o_orderkey % 10)::DOUBLE / 10 END AS alpha, CASE WHEN o_custkey % 3 > 0 THEN 0.25::DOUBLE END AS beta, CASE WHEN o_custkey % 3 = 1 THEN 'name ' || (o_orderkey % 4) END AS curriculum_phase, CASE WHEN o_custkey % 3 = 2 THEN 'name ' || (o_orderkey % 4) END AS loss_weighting_strategy FROM orders"
)
def s9_epoch_table(spark, sf):
    k, run = F.col("o_orderkey"), F.col("o_custkey")
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    plain = F.concat_ws(",", (k % 100000).cast("string"), (k * 7919 % 1000 / 1000).cast("string"), (k * 6007 % 1000 / 1000).cast("string"), F.lit("0.5"), (k % 7).cast("string"))
    more = F.concat_ws(",", (k % 10 / 10).cast("string"), F.lit("0.25"), F.concat(F.lit("name "), (k % 4).cast("string")))
    rows = orders.select(run.alias("run"), F.when(run % 3 == 0, plain).otherwise(F.concat_ws(",", plain, more)).alias("value"))
    head = F.concat(F.lit("epoch,train_loss,lr,gpu_memory_allocated,gpu_memory_reserved"), F.element_at(F.array(*map(F.lit, _VARIANTS)), (run % 3 + 1).cast("int")))
    heads = orders.select("o_custkey").distinct().select(run.alias("run"), F.explode(F.array(F.lit('"# Training Configuration: epochs=40"'), F.lit("# Timestamp"), F.lit(""), head)).alias("value"))
    return T.parse_epoch_lines(heads.union(rows)).select("run", "epoch", "train_loss", "val_loss", "lr", "gpu_memory_allocated", "gpu_memory_reserved", "alpha", "beta", "curriculum_phase", "loss_weighting_strategy")


# --- written to the shared folder and read back ------------------------------------------------


def _archives(spark, sf) -> str:
    """Archives of all clips, written by the executors."""
    folder = staged_folder(spark, "archives")
    C.write_npz_clips(frames(spark, sf), clip_meta(spark, sf).withColumn("meta", F.lit('{"model_type": "T"}')), folder)
    return folder


@query("SELECT s_suppkey || '.npz' AS file, true AS has_bytes FROM supplier")
def s1_list_media(spark, sf):
    found = C.list_media(spark, _archives(spark, sf), (".NPZ",))
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file"), (F.col("bytes") > 0).alias("has_bytes"))


@query(f"{_H} SELECT clip_id::VARCHAR AS clip_id, frame_idx, max(t_ms) AS t_ms, count(*) FILTER (visible)::INT AS visible, 78 AS points, round(sum(x::FLOAT::DOUBLE) + sum(y::FLOAT::DOUBLE), 4) AS total, NULL::VARCHAR AS issue FROM fx_holistic GROUP BY 1, 2")
def s2_read_npz_clips(spark, sf):
    clips, back = C.read_npz_clips(spark, _archives(spark, sf))
    rows = back.join(clips.select("clip_id", "issue"), "clip_id")
    return rows.select("clip_id", "frame_idx", "t_ms", F.size(F.filter("mask", lambda v: v)).alias("visible"), F.size("mask").alias("points"), F.round(A.total(A.double(F.col("x"))), 4).alias("total"), "issue")


@query(f"{_LB} SELECT replace(file, '.npz', '') AS file, gloss::INT AS gloss, cat::INT AS cat, occluded FROM fx_labels")
def s5_read_labels(spark, sf):
    folder = staged_folder(spark, "labels")
    T.append_labels(labels(spark, sf), folder)
    return T.read_labels(spark, folder)


@query(f"{_LB} SELECT replace(file, '.npz', '') AS file, gloss::INT AS gloss, cat::INT AS cat, 0 AS occluded FROM fx_labels")
def s6_append_labels(spark, sf):
    """A table without ``occluded`` stays without it."""
    folder, df = staged_folder(spark, "labels"), labels(spark, sf)
    df.filter("gloss < 12").select("file", "gloss", "cat").write.option("header", "true").csv(folder)
    T.append_labels(df.filter("gloss >= 12"), folder)
    return T.read_labels(spark, folder)


@query(_report_sql() + " SELECT cls::BIGINT AS cls, round(precision, 6) AS precision, round(f1, 6) AS f1, support FROM rep")
def s8_write_report(spark, sf):
    folder = staged_folder(spark, "report")
    T.write_report(E.classification_report(preds(spark, sf)), folder)
    return spark.read.schema("cls long, precision double, f1 double, support long").json(folder)


def _records(spark, sf):
    """Predictions with a second best class of either head, as nested records."""
    second = lambda h, n: F.array(F.struct(F.col(f"{h}_pred").alias("id"), F.col(f"{h}_prob").alias("prob")), F.struct(((F.col(f"{h}_pred") + 1) % n).cast("int").alias("id"), (1 - F.col(f"{h}_prob")).alias("prob")))
    return E.format_predictions(preds(spark, sf).withColumns({"gloss_top": second("gloss", 26), "cat_top": second("cat", 5)}), ref(spark, sf))


_RECORD = "file long, ground_truth struct<gloss:string,category:string,occluded:boolean>, prediction struct<gloss:string,category:string,gloss_prob:double,cat_prob:double>, correct struct<gloss:boolean,category:boolean>, gloss_top array<struct<label:string,prob:double>>, category_top array<struct<label:string,prob:double>>"
_RECORD_SQL = (
    f"WITH {_FX['fx_predictions']}, {_FX['fx_label_ref']}, c AS (SELECT DISTINCT cat_id, category FROM fx_label_ref) SELECT p.clip_id AS file, g.label || ' (' || p.gloss_gt || ')' AS gt_gloss, p.occluded = 1 AS gt_occluded, d.category || ' (' || p.cat_pred || ')' AS pred_cat, round(p.gloss_prob, 6) AS gloss_prob, p.cat_gt = p.cat_pred AS cat_ok, "
    "coalesce(h.label, 'Unknown') || ' (' || ((p.gloss_pred + 1) % 26) || ')' AS second_gloss, round(1 - p.cat_prob, 6) AS second_cat_prob FROM fx_predictions p JOIN fx_label_ref g ON g.gloss_id = p.gloss_gt LEFT JOIN fx_label_ref h ON h.gloss_id = (p.gloss_pred + 1) % 26 JOIN c d ON d.cat_id = p.cat_pred"
)


def _record_columns(df):
    return df.select("file", F.col("ground_truth.gloss").alias("gt_gloss"), F.col("ground_truth.occluded").alias("gt_occluded"), F.col("prediction.category").alias("pred_cat"), F.round("prediction.gloss_prob", 6).alias("gloss_prob"), F.col("correct.category").alias("cat_ok"), F.col("gloss_top")[1]["label"].alias("second_gloss"), F.round(F.col("category_top")[1]["prob"], 6).alias("second_cat_prob"))


@query(_RECORD_SQL)
def s8_nested_report(spark, sf):
    folder = staged_folder(spark, "records")
    T.write_report(_records(spark, sf), folder)
    return _record_columns(spark.read.schema(_RECORD).json(folder))


@query(_RECORD_SQL)
def s8_csv_report(spark, sf):
    """Nested columns are JSON texts in the table."""
    folder = staged_folder(spark, "records")
    T.write_report(_records(spark, sf), folder, "csv")
    raw = spark.read.option("header", "true").option("escape", '"').csv(folder)
    kinds = {f.name: f.dataType for f in spark.createDataFrame([], _RECORD).schema}
    return _record_columns(raw.select(F.col("file").cast("long").alias("file"), *[F.from_json(c, kinds[c]).alias(c) for c in raw.columns if c != "file"]))


def _mean_model():
    """A model for scoring: the mean of the real frames, split into two heads."""
    import numpy as np

    def model(batch, lengths):
        mean = batch.sum(axis=1) / lengths[:, None]
        soft = lambda v: np.exp(v - v.max(axis=1, keepdims=True)) / np.exp(v - v.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)
        return soft(mean[:, :40]), soft(mean[:, 40:])

    return model


@query(
    f"{_V}, u AS (SELECT clip_id, unnest(range(len(x)))::INT AS dim, unnest(x)::DOUBLE AS v FROM fx_vec_frames), m AS (SELECT clip_id, dim, avg(v) AS v FROM u GROUP BY 1, 2) "
    "SELECT clip_id, arg_max(dim, (v, -dim)) FILTER (dim < 40) AS gloss_pred, arg_max(dim - 40, (v, -dim)) FILTER (dim >= 40) AS cat_pred, round(exp(max(v) FILTER (dim < 40)) / sum(exp(v)) FILTER (dim < 40), 6) AS gloss_prob, round(exp(max(v) FILTER (dim >= 40)) / sum(exp(v)) FILTER (dim >= 40), 6) AS cat_prob FROM m GROUP BY 1"
)
def u1_score_clips(spark, sf):
    return U.score_clips(vectors(spark, sf), _mean_model).select("clip_id", "gloss_pred", "cat_pred", "gloss_prob", "cat_prob")


@query()
def u2_fit_clip_classifier(spark, sf):
    df = vectors(spark, sf).withColumn("clip_id", F.col("clip_id") * 100 + F.col("frame_idx"))
    pooled = S.pool_sequence(df)
    known = df.select("clip_id", "gloss", (F.col("gloss") % 2).alias("cat"))
    models = U.fit_clip_classifier(pooled, known)
    return U.predict_clips(models, pooled).join(known, "clip_id")
