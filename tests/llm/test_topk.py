import math
from fractions import Fraction

import numpy as np
import pytest

from strideframe.llm.queries import op6_histogram_topk
from strideframe.llm.topk import top_k


def plain(rows, asked, k):
    ok = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v)
    whole = lambda x: math.floor(Fraction(float(x)) * 256)
    fixed = [(i, [whole(x) for x in v]) for i, v in rows if i is not None and ok(v)]
    out = []
    for q in sorted({i for i, _ in fixed if i in asked}):
        vec = [whole(x) for x in min([float(x) for x in v] for i, v in rows if i == q and ok(v))]
        found = sorted((-sum(a * b for a, b in zip(vec, v, strict=True)), i) for i, v in fixed if i != q and len(v) == len(vec))
        out += [(q, n + 1, i, min(2**63 - 1, max(-(2**63), -s))) for n, (s, i) in enumerate(found[:k])]
    return sorted(out)


def test_query_against_brute_force(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = sorted(tuple(r) for r in op6_histogram_topk(spark, sf_dir).collect())
    assert got == plain(rows, {i for i, _ in rows if i % 50 == 0}, 5)


@pytest.mark.parametrize("k", [1, 3, 50])
def test_ties_nulls_and_short_tables(spark, k):
    rows = [(i, [0.5, -0.25]) for i in range(20)] + [(20, [0.5, None]), (21, None), (22, [float("nan"), 1.0]), (23, [float("inf"), 0.0]), (24, [1.0, 2.0, 3.0]), (25, []), (None, [1.0, 1.0]), (3, [0.5, -0.25]), (30, [0.001, 3.0]), (31, [-4.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    got = sorted(tuple(r) for r in top_k(df, df.filter("vec_id % 5 = 0"), k=k).collect())
    assert got == plain(rows, {i for i in range(0, 40, 5)}, k)


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert top_k(df, df).count() == 0


@pytest.mark.parametrize("k", [2, 5])
def test_components_of_any_size(spark, k):
    rng = np.random.default_rng(k)
    sizes = [1.0, 1e3, 1e5, 3e5, 1e7, 8e6, 1e12, 1e150, 1e308]
    rows = [(i, (rng.normal(size=8) * sizes[i % len(sizes)]).clip(-1.7e308, 1.7e308).tolist()) for i in range(60)]
    rows += [(60, [8e6] * 8), (65, [8e6] * 8), (66, [-8e6] * 8), (70, [1.7e308] * 8), (71, [1.7e308] * 8), (72, [-1.7e308] * 8), (73, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(tuple(r) for r in top_k(df, df.filter("vec_id % 5 = 0"), k=k).collect())
    assert got == plain(rows, set(range(0, 100, 5)), k)


def test_vectors_of_one_length_meet_in_many_tasks(spark):
    from strideframe.llm import topk

    df = spark.range(400).selectExpr("id AS vec_id", "transform(sequence(1, 8), x -> (id * x % 17) / 7D) AS embedding").repartition(8)
    plan = top_k(df, df.filter("vec_id % 50 = 0"))._jdf.queryExecution().optimizedPlan().toString()
    pairs = plan[plan.index("MapInArrow") :] if "MapInArrow" in plan else plan
    assert "Join Cross" in pairs and "dim" not in pairs[pairs.index("Join Cross") : pairs.index("Join Cross") + 40]
    assert topk.ROWS >= 1
