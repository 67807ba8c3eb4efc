import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strideframe.llm import packing
from strideframe.llm.packing import OpenWindows, encode_texts, pack_documents
from strideframe.llm.queries import op2_bounded_packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def coder():
    return Tokenizer.from_file(PATH)


def check(docs, out, coder, window, ids_too):
    want = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        want[r.doc_id].append([*coder.encode(r.text or "", add_special_tokens=False).ids, 1])
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in out.collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert pieces.keys() == want.keys()
    for ident, own in pieces.items():
        # Repeated rows are equal texts: each start comes once for each of them.
        copies = len(want[ident])
        ids = want[ident][0]
        assert sum(r.length for r in own) == copies * len(ids)
        covered = np.zeros(len(ids), int)
        for r in own:
            part = ids[r.start : r.start + r.length]
            covered[r.start : r.start + r.length] += 1
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
            assert not ids_too or list(r.ids) == part
        assert (covered == copies).all()
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    return sequences


def test_odd_rows(odd_docs, coder):
    check(odd_docs, pack_documents(odd_docs, PATH, window=64), coder, 64, True)


def test_query(spark, sf_dir, coder):
    sequences = check(spark.read.parquet(f"{sf_dir}/documents.parquet"), op2_bounded_packing(spark, sf_dir), coder, 2048, False)
    used = sum(r.length for own in sequences.values() for r in own)
    assert used / (2048 * len(sequences)) > 0.97


def test_bounded_space():
    windows = OpenWindows(100, 4, 8)
    rng = np.random.default_rng(0)
    for i in range(500):
        n = int(rng.integers(1, 250))
        windows.add(i, bytes(4 * n), n)
        assert len(windows.open) <= 4
    assert all(used <= 100 for _, used, _ in windows.closed)
    assert np.mean([used for _, used, _ in windows.closed]) > 95


def test_empty_table(no_docs):
    assert pack_documents(no_docs, PATH).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abÉßẞİΣक़ AB.,.,\n\t 's12²_<|日\u0301 "), st.characters(codec="utf-8")), max_size=60))
def test_ids_of_any_text(coder, text):
    assert np.frombuffer(encode_texts([text], PATH)[0], "<u4").tolist() == coder.encode(text, add_special_tokens=False).ids


def test_special_tokens_in_a_text(coder):
    texts = ["a <|endoftext|> b", "<|startoftext|>x<|endoftext|>", "A. <|ENDOFTEXT|> b", "a<|endoftext|>.", "<|endoftext|", "one two. <|endoftext|>three, " * 3, None, "<"]
    got = [np.frombuffer(x, "<u4").tolist() for x in encode_texts(texts, PATH)]
    assert got == [coder.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert got[0] == [320, 49407, 321]


def test_chunks_of_many_texts_at_once(coder, monkeypatch):
    monkeypatch.setattr(packing, "CACHE_CHUNKS", 20)
    packing._chunks.clear()
    odd = ["", None, " ", ".", "\n.\n", "a", ".a", "a. b, C.\n\nÉ. ×. ÷, ÿ, 7. ７.", "THE the The.", "H̱. ẖ", "<|ENDOFTEXT|> <|endoftext|>", "<B> B", "x" * 60, "It's don'T", "á. Á,", "K. K", "ÀÖØÞßöøÿ. ẞ", "a.\tb,\xa0c. d."]
    for texts in (odd, odd[::-1], [x for x in odd for _ in range(3)], [None, ""], []):
        got = [np.frombuffer(x, "<u4").tolist() for x in encode_texts(texts, PATH)]
        assert got == [coder.encode(x or "", add_special_tokens=False).ids for x in texts]
        assert len(packing._chunks.get(PATH, {})) <= 60  # those of one call, and what was remembered before


def test_a_worker_keeps_no_chunks_and_loads_no_pandas(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(50).coalesce(1)
    assert pack_documents(docs, PATH).count() >= 50

    def held(batches):
        list(batches)
        yield pa.RecordBatch.from_pydict({"pandas_of_packing": ["pd" in vars(packing)], "chunks": [sum(map(len, packing._chunks.values()))]})

    for r in spark.range(8).repartition(8).mapInArrow(held, "pandas_of_packing boolean, chunks long").collect():
        assert not r.pandas_of_packing and r.chunks == 0


def test_groups_of_texts(monkeypatch):
    monkeypatch.setattr(packing, "GROUP_BYTES", 10)
    texts = ["a" * 4, None, "b" * 6, "c", "d" * 30, "", "é" * 5, "e"]
    assert list(packing._groups(pa.array(texts))) == [(0, 3), (3, 4), (4, 5), (5, 7), (7, 8)]
    assert list(packing._groups(pa.array([], pa.string()))) == []


def test_remembered_chunks_stay_few_over_many_groups(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_CHUNKS", 300)
    packing.forget_chunks()
    for i in range(50):
        encode_texts([f"the q{i * 100 + j} of" for j in range(100)], PATH)
        assert {"the", "of"} <= packing._chunks[PATH].keys() and len(packing._chunks[PATH]) <= 300
