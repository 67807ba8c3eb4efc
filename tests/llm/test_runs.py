import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strideframe.llm import runs as R
from strideframe.llm.queries import op13_word_runs
from strideframe.llm.runs import find_runs, periodic_runs


def plain(words, least=6, times=4):
    """Every period of every stretch, one after the other."""
    number = {}
    codes = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        same = np.concatenate([[False], codes[:-q] == codes[q:], [False]])
        cuts = np.flatnonzero(same[1:] != same[:-1]).tolist()
        for i, j in zip(cuts[::2], cuts[1::2], strict=True):
            if j - i + q >= max(least, times * q):
                found.setdefault((i, j - i + q), q)  # the smallest period comes first
    return sorted((s, n, q) for (s, n), q in found.items())


def digest(doc_id, text):
    words = [w for w in (text or "").encode().split()]
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
    found = sorted(plain(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None, None, None)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return (doc_id, len(found), *best, best[0] is not None and 1000 * best[1] // best[2] or None, sha("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def of_core(texts):
    words = np.array([w for t in texts for w in t], np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    out = [[] for _ in texts]
    for o, s, n, q in find_runs(words, owner).tolist():
        out[o].append((s, n, q))
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), min_size=1, max_size=4))
def test_core_on_small_alphabets(texts):
    assert of_core(texts) == [plain(t) for t in texts]


def test_core_on_built_runs():
    rng = random.Random(5)
    texts = []
    for _ in range(300):
        words = []
        for _ in range(rng.randrange(6)):
            cycle = [rng.randrange(rng.choice((2, 3, 50))) for _ in range(rng.randrange(1, 40))]
            words += (cycle * rng.randrange(1, 9))[: rng.randrange(1, 200)] + [rng.randrange(60) for _ in range(rng.randrange(4))]
        texts.append(words)
    assert of_core(texts) == [plain(t) for t in texts]


def test_query_against_plain_loops(spark, sf_dir):
    got = {r.doc_id: r for r in op13_word_runs(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    some = 0
    for d in docs:
        want, r = digest(d.doc_id, d.text), got[d.doc_id]
        assert (r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == want
        some += want[1] > 0
    assert some > 10


def test_odd_rows(odd_docs, monkeypatch):
    monkeypatch.setattr(R, "BATCH_WORDS", 40)
    out = periodic_runs(odd_docs).collect()
    key = lambda r: (r[0] is None, r[0], r[1])
    want = []
    for d in odd_docs.collect():
        words = (d.text or "").encode().split()
        found = plain(words)
        gone = {i for s, m, q in found for i in range(s + q, s + m)}
        want.append((d.doc_id, b" ".join(w for i, w in enumerate(words) if i not in gone).decode(), found))
    assert sorted(((r.doc_id, r.collapsed, [tuple(x) for x in r.runs]) for r in out), key=key) == sorted(want, key=key)
    assert all((r.best is None) == (not r.runs) for r in out)


def test_one_long_run(spark):
    docs = spark.createDataFrame([(1, "a b c " * 40_000), (2, "x " * 100_000), (3, " ".join(map(str, range(50_000))))], "doc_id long, text string")
    got = {r.doc_id: [tuple(x) for x in r.runs] for r in periodic_runs(docs).collect()}
    assert got == {1: [(0, 120_000, 3)], 2: [(0, 100_000, 1)], 3: []}


def test_empty_table_and_parameters(no_docs):
    assert periodic_runs(no_docs).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(no_docs, times=2)
