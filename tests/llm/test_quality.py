import numpy as np
from pyspark.sql import functions as F

from strideframe.llm.quality import EDGE, SITE_REACH, fit_classifier, keep_good, score_quality, site_posteriors, text_features
from strideframe.llm.queries import op10_bayes_quality


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    fit, held = labels.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1")
    out = score_quality(docs, fit).join(held, "doc_id").select("quality", "keep").collect()
    right = np.mean([r.keep == bool(r.quality) for r in out])
    kept_good = np.mean([r.keep for r in out if r.quality == 1])
    assert right >= 0.95 and kept_good >= 0.97


def test_query_covers_all_rows(spark, sf_dir):
    out = op10_bayes_quality(spark, sf_dir)
    assert out.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert out.filter("posterior IS NULL OR keep IS NULL OR NOT posterior BETWEEN 0 AND 1").count() == 0


def test_posteriors_against_plain_sums(spark):
    rng = np.random.default_rng(0)
    rows = [(f"h{i % 5}", f"h{i % 5}/{i % 3}", float(np.clip(rng.normal(0.4 + 0.1 * (i % 5), 0.1), 0.01, 0.99))) for i in range(400)]
    rows.append(("lone", "lone/x", 0.05))
    got = {(r.host, r.path): r for r in site_posteriors(spark.createDataFrame(rows, "host string, path string, p double")).collect()}
    base = np.mean([p for _, _, p in rows])
    hosts = {h: [p for x, _, p in rows if x == h] for h in {h for h, _, _ in rows}}
    means = [np.mean(x) for x in hosts.values()]
    spread = max(1e-4, np.var(means, ddof=1) - base * (1 - base) * np.mean([1 / len(x) for x in hosts.values()]))
    strength = min(1000, max(2, base * (1 - base) / spread - 1))
    for (h, path), r in got.items():
        own = hosts[h]
        assert np.isclose(r.base, base) and np.isclose(r.host_mean, (sum(own) + strength * base) / (len(own) + strength))
        assert r.n == sum(x == path for _, x, _ in rows)
    # One document hardly moves its host from the corpus.
    assert abs(got["lone", "lone/x"].host_mean - base) < 0.6 * abs(0.05 - base)


def test_odd_rows(odd_docs, no_docs, labels):
    out = score_quality(odd_docs, labels)
    assert out.count() == odd_docs.count() and out.filter("keep IS NULL").count() == 0
    kept = keep_good(odd_docs, labels)
    assert kept.columns == odd_docs.columns
    assert score_quality(no_docs, labels).count() == 0
    assert score_quality(odd_docs, labels.limit(0)).count() == odd_docs.count()
    bare = odd_docs.select("doc_id", "text", F.lit(None).cast("string").alias("source"))
    assert score_quality(bare, labels).filter("posterior IS NULL").count() == 0


def test_bounded_sample(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert fit_classifier(docs, labels, rows=10).weights.shape == fit_classifier(docs, labels).weights.shape


def test_query_against_plain_loops(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_classifier(docs, labels)
    rows = docs.collect()
    own = model.log_odds(np.array([text_features(r.text) for r in rows]))
    inside = lambda p: min(1 - EDGE, max(EDGE, p))
    logit = lambda p: np.log(p / (1 - p))
    chance = [inside(1 / (1 + np.exp(-x))) for x in own]
    host_of = [(r.source or "").split("/")[0] for r in rows]
    path_of = [f"{r.source or ''}/{r.lang or ''}" for r in rows]
    base = np.mean(chance)
    hosts, paths = {}, {}
    for p, h, k in zip(chance, host_of, path_of, strict=True):
        hosts.setdefault(h, []).append(p)
        paths.setdefault((h, k), []).append(p)
    strength = lambda m, spread: min(1000, max(2, m * (1 - m) / spread - 1))
    between = np.var([np.mean(x) for x in hosts.values()], ddof=1) - base * (1 - base) * np.mean([1 / len(x) for x in hosts.values()])
    k = strength(base, max(1e-4, between))
    mean = {h: (sum(x) + k * base) / (len(x) + k) for h, x in hosts.items()}
    inner = np.var([np.mean(x) - mean[h] for (h, _), x in paths.items()], ddof=1) - np.mean([mean[h] * (1 - mean[h]) / len(x) for (h, _), x in paths.items()])
    j = strength(base, max(1e-4, inner))
    got = {r.doc_id: r for r in op10_bayes_quality(spark, sf_dir).collect()}
    for r, x, p, h, q in zip(rows, own, chance, host_of, path_of, strict=True):
        mine = paths[h, q]
        others = inside((sum(mine) - p + j * mean[h]) / (len(mine) - 1 + j))
        posterior = 1 / (1 + np.exp(-(x + min(SITE_REACH, max(-SITE_REACH, logit(others) - logit(inside(base)))))))
        assert np.isclose(got[r.doc_id].posterior, posterior, atol=1e-9) and np.isclose(got[r.doc_id].host_posterior, mean[h], atol=1e-9)
        assert got[r.doc_id].keep == (posterior >= 0.5) or abs(posterior - 0.5) < 1e-9


def test_an_id_of_many_rows_is_one_row_to_the_driver(spark):
    rows = [(1, f"Text number {i}. It goes on.") for i in range(300)] + [(2, "!!! ||| 000"), (3, "A fair text.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    alone = fit_classifier(docs.groupBy("doc_id").agg(F.min("text").alias("text")).filter("doc_id > 1"), labels.filter("doc_id > 1"))
    assert np.isfinite(fit_classifier(docs, labels).weights).all() and np.isfinite(alone.weights).all()


def test_kept_rows_are_scored_once(odd_docs, labels):
    kept = keep_good(odd_docs, labels)
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    names = score_quality(odd_docs, labels).filter("keep").select("doc_id", "text").collect()
    assert sorted(kept.select("doc_id", "text").collect(), key=str) == sorted(names, key=str)
