import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from strideframe.llm import pieces as P
from strideframe.llm.pieces import PieceAgenda, encode_pieces
from strideframe.llm.queries import op11_piece_agenda

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def whole(library, text):
    ids = library.encode(text or "", add_bos=True, add_eos=True)
    return ids, library.decode(ids)


def test_odd_rows(odd_docs, library):
    out = encode_pieces(odd_docs, PATH, outputs=("ids", "decoded", "n_tokens")).collect()
    got = sorted(((r.doc_id, list(r.ids), r.decoded, r.n_tokens) for r in out), key=str)
    want = sorted(((r.doc_id, *whole(library, r.text), len(whole(library, r.text)[0])) for r in odd_docs.collect()), key=str)
    assert got == want


def test_query_against_the_library_on_whole_texts(spark, sf_dir, library):
    out = {r.doc_id: r for r in op11_piece_agenda(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(out) == len(docs)
    for r in docs:
        ids, text = whole(library, r.text)
        got = out[r.doc_id]
        assert (got.n_tokens, got.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab AB\n\t 'the12é_.日 ▁\x00  <s>"), st.characters(codec="utf-8")), max_size=60))
def test_any_text(text):
    coder = PieceAgenda.load(PATH)
    (packed,) = coder.encode([text])
    ids, back = whole(coder.library, text)
    assert np.frombuffer(packed, "<u4").tolist() == ids
    assert coder.decode(np.array(ids)) == back.encode()


@settings(max_examples=500, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31_999), st.integers(0, 270)), max_size=30))
def test_decoding_of_any_ids(ids):
    coder = PieceAgenda.load(PATH)
    assert coder.decode(np.array(ids, np.int64)) == coder.library.decode(ids).encode()


def test_bytes_around_a_control_id(library):
    coder = PieceAgenda.load(PATH)
    for ids in ([197, 1, 131], [1, 197, 131, 2], [197, 131, 1], [229, 154, 2, 168], [197, 1, 2, 131, 197, 131], [227, 131, 1, 133, 300], [1, 2]):
        assert coder.decode(np.array(ids, np.int64)) == library.decode(ids).encode(), ids


def test_long_units(library):
    coder = PieceAgenda.load(PATH)
    for text in ("a" * 5000, "=" * 3000 + "x", "ab" * 4000, " " * 900 + "z" + "\n" * 300, "日本語のテキスト" * 300, "aGVsbG8gd29ybGQ" * 500):
        assert np.frombuffer(next(coder.encode([text])), "<u4").tolist() == whole(library, text)[0]


def test_small_batches_and_memory(odd_docs, library, monkeypatch):
    monkeypatch.setattr(P, "BATCH_CHARS", 100)
    monkeypatch.setattr(P, "KNOWN_UNITS", 30)
    out = encode_pieces(odd_docs.repartition(3), PATH, outputs=("ids",), ends=False).collect()
    got = sorted(((r.doc_id, list(r.ids)) for r in out), key=str)
    assert got == sorted(((r.doc_id, library.encode(r.text or "")) for r in odd_docs.collect()), key=str)


def test_a_wrong_unit_is_found():
    coder = PieceAgenda(PATH)
    coder.pair_keys -= 1
    with pytest.raises(ValueError, match="disagree"):
        list(coder.encode(["the theatre heard here"]))


def test_empty_table(no_docs):
    assert encode_pieces(no_docs, PATH).count() == 0
