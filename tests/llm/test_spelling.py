import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strideframe.llm import spelling as S
from strideframe.llm.queries import op12_spelling_forms
from strideframe.llm.spelling import LETTERS, near_pairs, spelling_variants


def near(a, b):
    """One insertion, deletion or replacement apart, by trying every place."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(docs, plant=False, min_length=7, min_count=2, times=10):
    counts = Counter()
    for i, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if plant and h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}
    # Near words share what is left when one letter of either goes.
    by_rest = {}
    for w in words:
        for rest in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by_rest.setdefault(rest, set()).add(w)
    out = {}
    for w, n in words.items():
        others = {o for rest in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))} for o in by_rest[rest] if near(w, o)}
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form = best if best and words[best] >= times * n else None
        out[w] = (form, n, len(others), words.get(form))
    rows = []
    for w, (form, n, count, form_n) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, n, count, form_n))
    return sorted(rows)


def found(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abÿ×", min_size=1, max_size=9), min_size=1, max_size=30, unique=True), st.integers(1, 40), st.integers(1, 5))
def test_pairs_of_a_block_and_its_visitor(words, cut, count):
    groups = np.arange(90) % count
    weights = np.random.default_rng(0).integers(1 << 40, 1 << 56, count)
    moves = np.unique([0, *weights, *-weights, *(a - b for a in weights for b in weights)])
    sides = [x for x in (words[:cut], words[cut:]) if x]
    blocks = [S.Block(x, np.ones(len(x), np.int64), groups, weights) for x in sides]
    pairs = lambda a, b, m: sorted(tuple(sorted((a.words[i], b.words[j]))) for i, j in zip(*near_pairs(a, b, m), strict=True))
    if len(blocks) == 2:
        assert pairs(*blocks, moves) == sorted(tuple(sorted((x, y))) for x in sides[0] for y in sides[1] if near(x, y))
    half = np.unique([0, *weights, *(b - a for k, a in enumerate(weights) for b in weights[k + 1 :])])
    assert pairs(blocks[0], blocks[0], half) == sorted((x, y) for x in sides[0] for y in sides[0] if x < y and near(x, y))


@settings(max_examples=300, deadline=None)
@given(st.text("ab", max_size=6), st.text("ab", max_size=6))
def test_one_edit(a, b):
    assert S.one_edit(a, b) == near(a, b)


def test_query_against_plain_loops(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got, want = found(op12_spelling_forms(spark, sf_dir)), plain(docs, plant=True)
    assert got == want
    assert sum(r[1] is not None for r in want) > 5


def test_chains_ties_and_blocks_of_two(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_WORDS", 2)
    monkeypatch.setattr(S, "VISITORS", 3)
    monkeypatch.setattr(S, "ROW_WORDS", 1)
    monkeypatch.setattr(S, "COLUMNS", 2)
    rng = random.Random(3)
    counts = {"abcdefgh": 2000, "abcdefg": 100, "abcdefgi": 100, "abcdefi": 9, "bcdefgh": 9, "ßbcdefi": 2, "abcdéfi": 1}
    for _ in range(300):  # few letters: many words of one cell
        counts["".join(rng.choice("xyzÀ") for _ in range(rng.choice((7, 8, 9))))] = rng.choice((2, 3, 30, 400))
    text = " ".join(w.upper() if w.isascii() and i % 2 else w for w, n in counts.items() for i in range(n))
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (None, "abcdefgh" * 600)] * 1, "doc_id long, text string")
    got = found(spelling_variants(df))
    assert got == plain([(1, text), (None, "abcdefgh" * 600)])
    roots = {r[0]: r for r in got}
    assert roots["abcdefi"][1] == "abcdefg" and roots["abcdefi"][2] == "abcdefgh"  # of the tie the smaller, then on to its form


def test_odd_rows(odd_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    for plant in (False, True):
        assert found(spelling_variants(odd_docs, plant=plant)) == plain(docs, plant=plant)


def test_long_words(spark):
    docs = [(1, "a" * 5000 + " " + "a" * 4999 + "b"), (2, ("a" * 5000 + " ") * 20), (3, "a" * 4999 + "b")]
    assert found(spelling_variants(spark.createDataFrame(docs, "doc_id long, text string"))) == plain(docs)


def test_empty_table_and_parameters(no_docs):
    assert spelling_variants(no_docs).count() == 0
    with pytest.raises(ValueError):
        spelling_variants(no_docs, times=1)


def test_words_longer_than_the_matrix(spark):
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdef") for _ in range(n)) for n in (62, 63, 64, 65, 66, 130) for _ in range(3)]
    words = base + [w[:k] + c + w[k + d :] for w in base for k, c, d in ((0, "z", 0), (len(w), "z", 0), (len(w) // 2, "", 1), (len(w) - 1, "q", 1), (63, "k", 1))]
    docs = [(1, " ".join(words + words + base * 20))]
    assert found(spelling_variants(spark.createDataFrame(docs, "doc_id long, text string"))) == plain(docs)


def test_letters():
    assert len(set(LETTERS)) == 90 and np.array_equal(S._column_of[[ord(c) for c in LETTERS]], np.arange(90))
