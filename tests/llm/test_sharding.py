import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideframe.llm.queries import op8_histogram_shards
from strideframe.llm import sharding
from strideframe.llm.sharding import shard_by_bytes


def check(rows, shards, largest):
    total = sum(r.size for r in rows)
    sizes, slots = Counter(), defaultdict(list)
    for r in rows:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
        assert 0 <= r.shard < shards
    for own in slots.values():
        assert sorted(own) == list(range(len(own)))
    for s in range(shards):
        assert abs(sizes[s] - total / shards) <= 2 * largest + 0.01 * total / shards


def test_query(spark, sf_dir):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op8_histogram_shards(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        data = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
    check(rows, 16, max(r.size for r in rows))


@pytest.mark.parametrize("hot", [0.4, 1.0])
def test_hot_text_is_split_by_id(spark, hot):
    rows = [(i, "same text" if i < 1000 * hot else f"text {i}" * (i % 7)) for i in range(1000)]
    out = shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), shards=8).collect()
    assert len(out) == 1000
    check(out, 8, max(r.size for r in out))


def test_odd_rows(odd_docs, no_docs):
    out = shard_by_bytes(odd_docs, shards=4).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(r.doc_id) for r in odd_docs.collect())
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert {r.size for r in out if r.doc_id in (3, 4)} == {1}
    assert shard_by_bytes(no_docs).count() == 0


def test_pieces_follow_the_splitters(spark, monkeypatch):
    # Small pieces, a third of the rows empty, a hot text, null ids: shards, slots and the order within shards stay.
    monkeypatch.setattr(sharding, "PIECE_ROWS", 40)
    rows = [(None if i % 50 == 7 else i, "" if i % 3 == 0 else "hot text " * 4 if i % 3 == 1 else f"text {i} " * (i % 11)) for i in range(900)]
    out = shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), shards=4, keep={"body": F.col("text")}).collect()
    assert len(out) == 900
    check(out, 4, max(r.size for r in out))
    shards = defaultdict(set)
    for r in out:
        shards[r.body].add(r.shard)
    # Only the groups through which a border of shards goes are split.
    assert sum(len(x) > 1 for x in shards.values()) <= 3
    assert all(max(x) - min(x) + 1 == len(x) for x in shards.values())


def test_equal_texts_share_a_shard(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    shards, sizes = defaultdict(set), Counter()
    for r in op8_histogram_shards(spark, sf_dir).collect():
        shards[docs[r.doc_id]].add(r.shard)
        sizes[docs[r.doc_id]] += r.size
    total = sum(sizes.values())
    assert all(len(x) == 1 for t, x in shards.items() if sizes[t] < 0.002 * total / 16)
    assert sum(len(x) > 1 for x in shards.values()) <= 15


def test_splitters_against_a_sorted_list(spark):
    rows = [(i % 40, (i * i * 2654435761) % (1 << 64) - (1 << 63) if i % 4 else 5, 1 + i % 9) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, key long, size long")
    found = sharding.find_splitters(df, 7, 0.01)
    places = [sharding._place(x) for x in found]
    assert places == sorted(places)
    total = sum(s for _, _, s in rows)
    for i, place in enumerate(places, 1):
        below = sum(s for d, k, s in rows if (k, d) < place)
        largest = max(sum(s for d, k, s in rows if (k, d) == p) for p in {(k, d) for d, k, _ in rows})
        assert abs(below - total * i / 7) <= largest
    keys, ids = np.array([k for _, k, _ in rows]), np.array([d for d, _, _ in rows])
    got = sharding.piece_of(keys, ids, np.ones(600, bool), found)
    assert got.tolist() == [sum(p <= (k, d) for p in places) for d, k, _ in rows]
