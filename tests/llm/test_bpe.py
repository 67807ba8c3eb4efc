import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from strideframe.llm.bpe import MergeReplay, encode_documents
from strideframe.llm.queries import op4_merge_replay

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def known():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_odd_rows(odd_docs, known):
    out = encode_documents(odd_docs, PATH, public_tokenizers.PATTERN).collect()
    got = sorted(((r.doc_id, list(r.ids), bytes(r.decoded)) for r in out), key=str)
    want = sorted(((r.doc_id, known.encode_ordinary(r.text or ""), (r.text or "").encode()) for r in odd_docs.collect()), key=str)
    assert got == want


def test_query(spark, sf_dir, known):
    out = {r.doc_id: r for r in op4_merge_replay(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(out) == len(docs)
    for r in docs:
        ids = known.encode_ordinary(r.text or "")
        got = out[r.doc_id]
        assert got.n_tokens == len(ids)
        assert got.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


@settings(max_examples=1000, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab AB\n\t 'st12é_.日  \x1c\x85"), st.characters(codec="utf-8")), max_size=60))
def test_any_text(text):
    global _known
    coder = MergeReplay.load(PATH, public_tokenizers.PATTERN)
    if "_known" not in globals():
        _known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    (ids,) = coder.encode([text])
    assert ids.tolist() == _known.encode_ordinary(text)
    assert coder.decode(ids) == text.encode()


def test_all_characters_in_some_contexts(known):
    """Every character in one context, and those whose class the regex module sees otherwise in more."""
    coder = MergeReplay.load(PATH, public_tokenizers.PATTERN)
    every = list(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    odd = [c for c in every if any(p.search(c) for p in coder.newer)]
    assert len(odd) > 10_000
    for around, chars in (("a{}b ", every), ("1{}2 ", odd), (".{}. {}a", odd), ("'{}s {}\n", odd), ("\ue000{}뀀", odd)):
        texts = ["".join(around.replace("{}", c) for c in chars[i : i + 3000]) for i in range(0, len(chars), 3000)]
        for text in texts:
            (ids,) = coder.encode([text])
            assert ids.tolist() == known.encode_ordinary(text)


def test_long_runs():
    coder = MergeReplay.load(PATH, public_tokenizers.PATTERN)
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    for text in ("a" * 3000, "=" * 2000 + "x", "ab" * 1500, " " * 500 + "z" + "\n" * 300):
        (ids,) = coder.encode([text])
        assert ids.tolist() == known.encode_ordinary(text)


def test_empty_table(no_docs):
    assert encode_documents(no_docs, PATH, public_tokenizers.PATTERN).count() == 0


def test_small_batches_parts_and_memory(odd_docs, known, monkeypatch):
    from strideframe.llm import bpe

    for name, value in (("BATCH_CHARS", 100), ("REPLAY_BYTES", 20), ("PART_BYTES", 10_000), ("KNOWN_WORDS", 30)):
        monkeypatch.setattr(bpe, name, value)
    out = encode_documents(odd_docs.repartition(3), PATH, public_tokenizers.PATTERN, outputs=("ids",)).collect()
    got = sorted(((r.doc_id, list(r.ids)) for r in out), key=str)
    assert got == sorted(((r.doc_id, known.encode_ordinary(r.text or "")) for r in odd_docs.collect()), key=str)
