import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tests.llm.test_lines import plain as plain_lines
from tokenizers import Tokenizer

import corpus_pipeline
from strideframe.llm.pii import base_spans


def staged(spark, sf_dir, tmp_path, docs=None):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet") if docs is None else docs
    out = {"input": docs}
    for name, step in corpus_pipeline.STAGES:
        step(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        docs = out[name] = spark.read.parquet(f"{tmp_path}/{name}")
    return out


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_each_stage_against_brute_force(spark, sf_dir, tmp_path):
    out = staged(spark, sf_dir, tmp_path)
    for name in ("quality", "line_dedup", "near_dedup", "pii"):
        assert out[name].columns == out["input"].columns
    rows = {name: {r.doc_id: r for r in df.collect()} for name, df in out.items() if name != "packing"}
    # Quality: labelled documents mostly follow their labels, and most documents stay.
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert np.mean([(i in rows["quality"]) == bool(labels[i]) for i in rows["input"] if i in labels]) > 0.95
    # Lines: the plain rule gives the same texts.
    want = plain_lines([(i, r.text) for i, r in sorted(rows["quality"].items())], 50)
    assert {i: r.text for i, r in rows["line_dedup"].items()} == want
    assert all(r.n_chars == len(r.text) for r in rows["line_dedup"].values())
    # Near copies: no two that stay are linked, and every one that goes is reachable from one that stays.
    sets = {i: shingles(r.text) for i, r in rows["line_dedup"].items()}
    near = lambda a, b: not sets[a] and not sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    kept, gone = set(rows["near_dedup"]), set(rows["line_dedup"]) - set(rows["near_dedup"])
    assert not any(near(a, b) for a in kept for b in kept if a < b)
    reached, rest = set(kept), set(gone)
    while step := {i for i in rest if any(near(i, j) for j in reached)}:
        reached |= step
        rest -= step
    assert not rest
    # Personal data: no base span is left.
    assert rows["pii"].keys() == kept
    assert not any(base_spans(r.text) for r in rows["pii"].values())
    # Packing: the ids of every text, whole.
    coder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = {}
    for r in out["packing"].orderBy("doc_id", "start").collect():
        pieces.setdefault(r.doc_id, []).extend(r.ids)
    assert pieces == {i: [*coder.encode(r.text, add_special_tokens=False).ids, 1] for i, r in rows["pii"].items()}


def test_odd_rows(spark, sf_dir, odd_docs, no_docs, tmp_path):
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, odd_docs, sf_dir)
        assert name == "packing" or out.columns == odd_docs.columns
        out.write.mode("overwrite").parquet(f"{tmp_path}/odd_{name}")
        assert step(spark, no_docs, sf_dir).count() == 0
    assert corpus_pipeline.near_dedup(spark, odd_docs, sf_dir).filter(F.col("doc_id").isin(1, 2, 12)).count() == 1


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "start", "length", "sequence_id", "offset", "ids"} <= set(out.columns) and out.count() > 100


def test_near_dedup_keeps_texts_of_null_and_reused_ids(spark, sf_dir):
    one, two, three, four = (" ".join(f"{c}{i}" for i in range(80)) for c in "abcd")
    rows = [(None, one), (None, two), (None, two), (7, three), (7, four), (None, three), (9, four), (8, three)]
    out = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf_dir)
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(None, one), (None, two), (7, three), (7, four)], key=str)
