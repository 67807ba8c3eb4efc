"""Document quality by a hierarchical empirical Bayes model.

A logistic classifier on text statistics gives each document its own evidence. Grouped
aggregation sums the evidence by path (a section of a host) and by host; the strengths of the
priors come from the spread between hosts and between paths (method of moments). A sparse path is
shrunk toward its host, a sparse host toward the corpus, and each document's posterior combines
its own log odds with those of its path, its own share left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.llm._common import column, fresh, stage, text_rows

#: Rows of labels, by hash of the id, on which the classifier is fitted at most.
FIT_ROWS = 20_000
#: Probabilities stay this far from 0 and 1.
EDGE = 0.01
#: The site's log odds move a document's by this much at most.
SITE_REACH = 1.5
N_FEATURES = 14

_UPPER = np.array([65 <= i <= 90 for i in range(256)])
_LETTER = np.array([65 <= i <= 90 or 97 <= i <= 122 or i >= 128 for i in range(256)])
_DIGIT = np.array([48 <= i <= 57 for i in range(256)])
_SPACE = np.array([i in (9, 10, 11, 12, 13, 32) for i in range(256)])
_PROSE = np.array([chr(i) in ".,;:?!'\"()-" for i in range(256)])


def text_features(text: str | None) -> np.ndarray:
    """Statistics of a whole text; all zero for a null or empty one."""
    out = np.zeros(N_FEATURES)
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return out
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n = len(data)
    letters, digits, spaces, prose = (counts[m].sum() for m in (_LETTER, _DIGIT, _SPACE, _PROSE))
    words = data.split()
    lines = data.count(b"\n") + 1
    distinct = len(set(words))
    pairs = len(set(zip(words, words[1:], strict=False)))
    out[0] = np.log1p(len(words))
    out[1] = letters / n
    out[2] = digits / n
    out[3] = counts[_UPPER].sum() / max(1, letters)
    out[4] = prose / n
    out[5] = (n - letters - digits - spaces - prose) / n
    out[6] = letters / max(1, len(words)) / 10
    out[7] = np.log1p(len(words)) - np.log1p(distinct)
    out[8] = np.log1p(max(0, len(words) - 1)) - np.log1p(pairs)
    out[9] = np.log1p(len(words) / lines)
    out[10] = counts[ord("!")] / max(1, len(words))
    out[11] = counts[ord("|")] / max(1, len(words))
    out[12] = counts[ord(".")] / max(1, len(words))
    out[13] = 1.0
    return out


class Classifier:
    """Logistic regression on standardized text features and their squares."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, weights: np.ndarray) -> None:
        self.mean, self.spread, self.weights = mean, spread, weights

    def log_odds(self, features: np.ndarray) -> np.ndarray:
        z = np.clip((features - self.mean) / self.spread, -6, 6)
        return np.clip(np.concatenate([np.ones((len(z), 1)), z, z * z], axis=1) @ self.weights, -12, 12)

    @classmethod
    def fit(cls, features: np.ndarray, good: np.ndarray) -> Classifier:
        """Ridge-penalised Newton steps; one class only (or no rows) gives its constant log odds."""
        if not len(features):
            return cls(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(1 + 2 * N_FEATURES))
        mean, spread = features.mean(axis=0), features.std(axis=0) + 1e-6
        out = cls(mean, spread, np.zeros(1 + 2 * features.shape[1]))
        z = np.clip((features - mean) / spread, -6, 6)
        x = np.concatenate([np.ones((len(z), 1)), z, z * z], axis=1)
        ridge = np.full(x.shape[1], 1e-3 * len(x))
        ridge[0] = 1e-6 * len(x)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ out.weights, -15, 15)))
            grad = x.T @ (p - good) + ridge * out.weights
            hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
            step = np.linalg.solve(hess, grad)
            out.weights = out.weights - step
            if np.abs(step).max() < 1e-6:
                break
        return out


def fit_classifier(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = FIT_ROWS) -> Classifier:
    """Fit on at most ``rows`` labelled documents, chosen by a hash of their ids; of repeated ids one row counts."""
    marked = labels.select(column(id_col).cast("long").alias("id"), column(label_col).cast("int").alias("good")).filter("id IS NOT NULL AND good IN (0, 1)")
    chosen = marked.groupBy("id").agg(F.max("good").alias("good")).orderBy(F.xxhash64("id"), "id").limit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [text_features(x.as_py()).tolist() for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.list_(pa.float64()))], ["id", "good", "features"])

    texts = text_rows(docs, text_col, id=id_col)
    rows = texts.join(F.broadcast(chosen), "id").select("id", "good", "text").mapInArrow(run, "id long, good int, features array<double>")
    # One row a labelled id, however many rows have it: the driver gets ``rows`` of them at most.
    got = rows.groupBy("id").agg(F.min(F.struct("good", "features")).alias("r")).select("r.*").collect()
    got = sorted((r.good, r.features) for r in got)
    return Classifier.fit(np.array([f for _, f in got]).reshape(len(got), N_FEATURES), np.array([g for g, _ in got], float))


def _strength(mean: Column, spread: Column) -> Column:
    """Pseudo-count of a beta prior with this mean and variance, between 2 and 1000."""
    return F.coalesce(F.least(F.lit(1000.0), F.greatest(F.lit(2.0), mean * (1 - mean) / F.nullif(spread, F.lit(0.0)) - 1)), F.lit(1000.0))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def site_posteriors(evidence: DataFrame) -> DataFrame:
    """``host``, ``path``, ``n``, ``total``, ``host_mean``, ``path_strength``, ``base`` from rows of (host, path, p).

    ``base`` is the corpus mean. Sums of a hot host are partial before the shuffle.
    """
    paths = stage(evidence.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("total"), F.sum(F.col("p") * (1 - F.col("p"))).alias("noise")), "paths")
    hosts = stage(paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("total").alias("host_total")), "hosts")
    top = hosts.agg(
        (F.sum("host_total") / F.sum("host_n")).alias("base"),
        # Spread of host means beyond that of the mean of so many documents.
        F.var_samp(F.col("host_total") / F.col("host_n")).alias("between"),
        F.avg(1 / F.col("host_n")).alias("per_doc"),
    )
    spread = F.greatest(F.lit(1e-4), F.col("between") - F.col("base") * (1 - F.col("base")) * F.col("per_doc"))
    top = top.select("base", _strength(F.col("base"), spread).alias("host_strength"))
    hosts = hosts.crossJoin(F.broadcast(top))  # one row
    hosts = hosts.withColumn("host_mean", (F.col("host_total") + F.col("host_strength") * F.col("base")) / (F.col("host_n") + F.col("host_strength")))
    joined = stage(paths.join(hosts, "host"), "sites")
    inner = joined.agg(F.var_samp(F.col("total") / F.col("n") - F.col("host_mean")).alias("between"), F.avg(F.col("host_mean") * (1 - F.col("host_mean")) / F.col("n")).alias("noise"), F.first("base").alias("m"))
    inner = inner.select(_strength(F.col("m"), F.greatest(F.lit(1e-4), F.col("between") - F.col("noise"))).alias("path_strength"))
    return joined.crossJoin(F.broadcast(inner)).select("host", "path", "n", "total", "host_mean", "path_strength", "base")


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host: Column | None = None,
    path: Column | None = None,
    label_col: str = "quality",
    threshold: float = 0.5,
    outputs: tuple[str, ...] = ("doc_score", "host_posterior", "path_posterior", "posterior", "keep"),
) -> DataFrame:
    """``docs`` with the document's own probability, those of its host and path, the posterior and the decision.

    ``host`` defaults to the part of ``source`` before the first slash, ``path`` to the host and
    the document's ``lang``; a missing column counts as one empty host or path. What a path says
    moves a document's log odds by ``SITE_REACH`` at most, so that no site, however bad, takes a
    clearly good document with it. ``outputs`` are the names of the five added columns; columns of ``docs`` with these names are replaced.

    Null hosts and paths are a site of their own. Null or empty texts have all features zero and
    are scored like any other. Null ids and repeated rows are scored each; an id labelled more
    than once counts with its larger label; null or other labels are ignored. Without labels of
    both kinds the classifier is constant. An empty table gives an empty result. Extra columns
    pass through.
    """
    has = {c.lower() for c in docs.columns}
    text_of = lambda c: F.coalesce(column(c).cast("string"), F.lit("")) if c in has else F.lit("")
    host = F.substring_index(text_of("source"), "/", 1) if host is None else F.coalesce(host, F.lit(""))
    path = F.concat_ws("/", text_of("source"), text_of("lang")) if path is None else F.coalesce(path, F.lit(""))
    model = fit_classifier(docs, labels, id_col, text_col, label_col)

    @F.arrow_udf("double")
    def log_odds(texts: pa.Array) -> pa.Array:
        rows = np.array([text_features(x.as_py()) for x in texts]).reshape(len(texts), N_FEATURES)
        return pa.array(model.log_odds(rows), pa.float64())

    h, p, own, chance = fresh(docs, "site_host", "site_path", "own_log_odds", "own_chance")
    odds = docs.withColumn(h, host).withColumn(p, path).withColumn(own, log_odds(column(text_col).cast("string")))
    odds = odds.withColumn(chance, F.least(F.lit(1 - EDGE), F.greatest(F.lit(EDGE), 1 / (1 + F.exp(-F.col(own))))))
    sites = stage(site_posteriors(odds.select(F.col(h).alias("host"), F.col(p).alias("path"), F.col(chance).alias("p"))), "posteriors")
    names = fresh(odds, "s_n", "s_total", "s_mean", "s_strength", "s_base")
    sites = sites.toDF(h, p, *names)
    n, total, mean, strength, base = map(F.col, names)
    joined = odds.join(sites, [h, p])
    # The document's own share is left out of what its path says.
    others = (total - F.col(chance) + strength * mean) / (n - 1 + strength)
    others = F.least(F.lit(1 - EDGE), F.greatest(F.lit(EDGE), others))
    shift = F.greatest(F.lit(-SITE_REACH), F.least(F.lit(SITE_REACH), _logit(others) - _logit(F.least(F.lit(1 - EDGE), F.greatest(F.lit(EDGE), base)))))
    posterior = 1 / (1 + F.exp(-(F.col(own) + shift)))
    values = (F.col(chance), mean, others, posterior, posterior >= threshold)
    kept = [column(c) for c in docs.columns if c not in outputs]
    return joined.select(*kept, *[v.alias(c) for c, v in zip(outputs, values, strict=True)])


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose posterior reaches ``threshold``, with their columns (see ``score_quality``)."""
    names = fresh(docs, "q_doc", "q_host", "q_path", "q_posterior", "q_keep")
    scored = score_quality(docs, labels, id_col, text_col, threshold=threshold, outputs=tuple(names))
    # A bare condition says that the log odds are not null, which is tested below the join: they are computed twice, in two workers a task.
    return scored.filter(F.coalesce(F.col(names[4]), F.lit(False))).select(*[column(c) for c in docs.columns])
