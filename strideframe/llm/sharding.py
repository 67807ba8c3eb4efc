"""Shards of near equal bytes by histogram sort.

Rows are ordered by (hash of the text, id), so that equal texts stand together. Splitters between
shards are found by counting the exact bytes below candidate key boundaries over all partitions:
each round refines the probes around every splitter that is not within tolerance by the next bits
of the hash, and at last by the id within a single hash. More splitters, found in the same way by
counting rows, cut large shards into pieces that fit a task, however few bytes many rows have. Then
the rows are exchanged once, by these splitters, which gives each row its place in its shard.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.llm._common import column, release, stage

#: Bits of the key that a round of probes resolves: 2**BITS probes around each open splitter.
BITS = 8
KEY_BITS = 64
#: A splitter may miss its share by this part of a shard.
TOLERANCE = 0.002
#: Rows of a piece, about.
PIECE_ROWS = 2_000_000
#: A splitter (hash, id): rows at or above it belong to later shards; id None stands for the first.
Splitter = tuple[int, int | None]


def find_splitters(rows: DataFrame, shards: int, tolerance: float) -> list[Splitter]:
    """Splitters between ``shards`` parts with near equal sums of ``size`` over rows (``key``, ``id``, ``size``)."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    slack = total / shards * tolerance
    targets = [total * i / shards for i in range(1, shards)]
    found: dict[int, tuple[int, int | None]] = {}
    # For each open splitter: the bits of the key known so far and the bytes below them.
    open_at = {i: (0, 0) for i in range(len(targets))}
    # The key as an unsigned number in the order of the signed long.
    key = F.col("key").bitwiseXOR(F.lit(-(1 << 63)))
    for done in range(0, KEY_BITS, BITS):
        if not open_at:
            break
        prefix = F.shiftrightunsigned(key, KEY_BITS - done) if done else F.lit(0).cast("long")
        bucket = F.shiftrightunsigned(key, KEY_BITS - done - BITS).bitwiseAND((1 << BITS) - 1)
        near = sorted({p for p, _ in open_at.values()})
        # At most (shards - 1) * 2**BITS sums come back.
        sums: dict[int, dict[int, int]] = {p: {} for p in near}
        for p, b, n in rows.select(prefix.alias("p"), bucket.alias("b"), "size").filter(F.col("p").isin([_signed(p) for p in near])).groupBy("p", "b").agg(F.sum("size")).collect():
            sums[p % (1 << 64)][b] = n
        for i, (p, below) in list(open_at.items()):
            probes = []
            for b in range(1 << BITS):
                n = sums[p].get(b, 0)
                probes.append((below, b, n))
                below += n
            probes.append((below, 1 << BITS, 0))
            near_at, b, _ = min(probes, key=lambda x: (abs(x[0] - targets[i]), x[1]))
            if abs(near_at - targets[i]) <= slack:
                found[i] = (((p << BITS) + b) << (KEY_BITS - done - BITS), None)
                del open_at[i]
            else:
                start, b, _ = max(x for x in probes[:-1] if x[0] <= targets[i])
                open_at[i] = ((p << BITS) + b, start)
    hot = sorted({p for p, _ in open_at.values()})
    if hot:
        found |= _split_hot(rows, hot, open_at, targets)
    return [(_order(k), v) for k, v in (found[i] for i in range(len(targets)))]


def _split_hot(rows: DataFrame, hot: list[int], open_at: dict, targets: list[float]) -> dict:
    """Splitters within single hashes: probes over the ids, refined until one id is left."""
    out = {}
    signed = F.col("key")
    spans = {k: (lo, hi) for k, lo, hi in rows.filter(signed.isin([_order(h) for h in hot])).groupBy("key").agg(F.min("id"), F.max("id")).collect()}
    for i, (h, below) in open_at.items():
        mine = rows.filter(signed == _order(h))
        lo, hi = spans[_order(h)]
        if lo is None:
            out[i] = (h, None)
            continue
        below += mine.filter("id IS NULL").agg(F.sum("size")).first()[0] or 0
        while hi > lo:
            width = -(-(hi - lo + 1) // (1 << BITS))
            sums = dict(mine.filter(F.col("id").between(lo, hi)).groupBy(F.floor((F.col("id") - lo) / width).alias("b")).agg(F.sum("size")).collect())
            at, pick = below, 0
            for b in range(1 << BITS):
                if at <= targets[i]:
                    pick, below = b, at
                at += sums.get(b, 0)
            lo, hi = lo + pick * width, min(hi, lo + (pick + 1) * width - 1)
        # The border goes before or after the last id, whichever is nearer.
        size = mine.filter(F.col("id") == lo).agg(F.sum("size")).first()[0] or 0
        out[i] = (h, lo if targets[i] - below <= below + size - targets[i] else lo + 1)
    return out


def _signed(u: int) -> int:
    return u - (1 << 64) if u >> 63 else u


def _order(u: int) -> int:
    """The signed long at place ``u`` of the order (the end of the order for 2**64)."""
    return min(u, (1 << 64) - 1) - (1 << 63)


def _place(splitter: Splitter) -> tuple[int, float | int]:
    return splitter[0], -np.inf if splitter[1] is None else splitter[1]


def piece_of(keys: np.ndarray, ids: np.ndarray, known: np.ndarray, splitters: list[Splitter]) -> np.ndarray:
    """How many splitters each row is at or above; rows of unknown id stand before all ids of their hash."""
    out = np.searchsorted(np.array([k for k, v in splitters if v is None], np.int64), keys, side="right")
    hot: dict[int, list[int]] = {}
    for k, v in splitters:
        if v is not None:
            hot.setdefault(k, []).append(v)
    for k, own in hot.items():
        within = np.where(known, np.searchsorted(np.array(sorted(own), np.int64), ids, side="right"), 0)
        out = out + np.where(keys == k, within, np.where(keys > k, len(own), 0))
    return out.astype(np.int32)


def shard_by_bytes(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", tolerance: float = TOLERANCE, keep: dict[str, Column] | None = None) -> DataFrame:
    """Put rows into ``shards`` shards of near equal bytes: ``id_col``, ``size``, ``shard``, ``slot``.

    A row's size is the UTF-8 bytes of its text plus 1. ``slot`` counts from 0 in each shard
    without gaps, in the order of (hash of the text, id). ``keep`` names more columns to carry
    along, as expressions over ``docs``.

    Equal texts stand together; a shard's border goes through a group of equal texts only where no
    border between groups is within ``tolerance`` (a part of a shard), and then between ids. A
    null text has no bytes and so size 1. Null ids sort first. Rows equal in text and id can't be
    told apart and share a shard. Fewer rows than shards leave shards empty; an empty table gives
    an empty result. Other columns are ignored, whatever their names.
    """
    keep = keep or {}
    text = column(text_col).cast("string")
    kept = [c.alias(f"kept_{i}") for i, c in enumerate(keep.values())]
    rows = docs.select(column(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("key"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), *kept)
    rows = stage(rows, "sizes")
    borders = find_splitters(rows.select("id", "key", "size"), shards, tolerance)
    parts = -(-rows.count() // PIECE_ROWS)
    inner = find_splitters(rows.select("id", "key", F.lit(1).cast("long").alias("size")), parts, 0.25) if parts > 1 else []
    splitters = sorted([*borders, *inner], key=_place)
    # The shard of each piece: the borders at or below its first row.
    places = sorted(map(_place, borders))
    shard_of = [0, *[bisect.bisect_right(places, _place(x)) for x in splitters]]

    @F.arrow_udf("int")
    def piece(keys: pa.Array, ids: pa.Array) -> pa.Array:
        known = np.asarray(ids.is_valid())
        return pa.array(piece_of(keys.to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False), known, splitters))

    # The one exchange. A row's number holds its partition, which is its piece, in the upper bits.
    dealt = rows.withColumn("piece", piece("key", "id")).repartitionById(len(splitters) + 1, "piece").sortWithinPartitions("key", "id")
    numbered = stage(dealt.withColumn("number", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "sorted")
    release(rows)
    # One row for each piece.
    counts = dict(numbered.groupBy("piece").count().collect())
    starts, before = [], {}
    for at, shard in enumerate(shard_of):
        starts.append((at, shard, before.get(shard, 0)))
        before[shard] = before.get(shard, 0) + counts.get(at, 0)
    offsets = docs.sparkSession.createDataFrame(starts, "piece int, shard int, base long")
    out = numbered.join(F.broadcast(offsets), "piece")
    return out.select(F.col("id").alias(id_col), "size", "shard", (F.col("number") + F.col("base")).alias("slot"), *[F.col(f"kept_{i}").alias(n) for i, n in enumerate(keep)])
