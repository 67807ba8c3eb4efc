"""Near-duplicate documents by SimHash and pivot distance tables.

A fingerprint is a majority vote of the hashes of word shingles, 64 bits (XXH64) or 128 (XXH3).
Links between fingerprints are found in three steps:

1. Every distinct fingerprint gets its row of the *pivot table* once: its Hamming distances to
   reference fingerprints. The row travels with it. What meets is decided by references of bit
   blocks: a block's distances to its zero and unit words are the same as its bits, and equal
   distances in three blocks make a bucket. With 64 bits there are ``bits + 3`` blocks and every
   choice of three is used: fingerprints that differ in at most ``bits`` places agree in at least
   three blocks, and no link is lost. With 128 bits, made for wide radii that no such count can
   cover, the blocks are wide draws of places, and a fingerprint enters each block's table under
   its own row and under the rows of its nearest alternatives, those with the least decided bits of
   the block flipped: near copies differ mostly there. A link is missed with a small probability,
   which the tests measure.
2. Within a bucket, pairs whose table rows differ by more than ``bits`` in any coordinate are
   discarded (triangle inequality).
3. Survivors are verified bit by bit. A bucket gives a spanning forest, never all its pairs, and a
   task joins the forests of its buckets, as near copies meet in many of them.

Buckets beyond ``cell_rows`` are dealt out as cells (pairs of hash chunks) over many tasks.

Fingerprints only estimate how alike two texts are. With ``confirm`` the groups found so are
candidates: the texts of a group are compared by their exact sets of shingles, again in cells of
hash chunks, and only pairs with that Jaccard similarity or more are links. Short texts have few
shingles, so their fingerprints are coarse: those of up to ``INDEXED`` distinct shingles are also
matched exactly, by a prefix-filtered index of shingles between the groups of candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm._common import column, fresh, join_hot, keyed, release, stage, text_rows
from strideframe.llm.components import connected_components, starred, stars, thin_edges

WORD = 64
SEED = 42
#: Shingles hashed at a time, so that memory does not follow the length of a text.
STEP = 1 << 16
#: Full-width reference fingerprints: fixed pseudo-random words.
PIVOTS = np.random.default_rng(2024).integers(0, 2**64, (16, 2), dtype=np.uint64)
#: References of the table for 64 and for 128 bits: eight distances to a long. At 25 of 128 bits
#: hardly any pair differs so much in a coordinate, so half as many are carried along.
N_PIVOTS = {1: 16, 2: 8}
#: With 128 bits: blocks, places of a block, and the least decided of them that are flipped.
WIDE_BLOCKS, WIDE_PLACES, WIDE_FLIPS = 16, 20, 3
#: Fingerprints of 128 bits that a task enters into the tables, 128 keys each: the keys are sorted in its executor's memory.
ENTERED = 8192


#: Distinct texts of a group in a chunk; a task compares two chunks at a time.
CHUNK = 128
#: Distinct shingles of a text that is also matched by the index: with a similarity of 0.8, every pair
#: whose smaller text has 128 or fewer is found.
INDEXED = 160
#: A shingle in more texts than this is put last in the order of the index; so many of them are told apart, the most frequent ones.
FREQUENT, MOST_FREQUENT = 32, 100_000
#: Shingles counted at a time when sets are compared.
COLUMNS = 2048


def digests(text: str | None, shingle: int, words: int) -> Iterator[np.ndarray]:
    """Hashes [shingle, byte] of a text's shingles, in parts; a text with fewer words than a shingle has one, one without words (or null) none."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return
    size = min(shingle, len(tokens))
    joined = b" ".join(tokens)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(tokens) - size + 1].tolist()
    ends = ends[size - 1 :].tolist()
    for at in range(0, len(starts), STEP):
        spans = zip(starts[at : at + STEP], ends[at : at + STEP], strict=True)
        if words == 1:
            digest = xxhash.xxh64_intdigest
            yield np.array([digest(joined[s:e], SEED) for s, e in spans], "<u8").view(np.uint8).reshape(-1, 8)
        else:
            digest = xxhash.xxh3_128_digest
            yield np.frombuffer(b"".join([digest(joined[s:e], SEED) for s, e in spans]), np.uint8).reshape(-1, 16)


def _votes(parts: list[np.ndarray], words: int) -> np.ndarray:
    votes, n = np.zeros(WORD * words, np.int64), 0
    for part in parts:
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(part)
    return 2 * votes - n


def majority(text: str | None, shingle: int = 4, words: int = 1) -> np.ndarray:
    """For each bit of a text's SimHash, votes for one less votes for zero; no words (or null) gives zeros."""
    return _votes(digests(text, shingle, words), words)


def _set(parts: list[np.ndarray]) -> np.ndarray:
    """The distinct shingles of 128-bit hashes, as 64 of their bits, sorted."""
    return np.unique(np.concatenate([np.ascontiguousarray(p).view("<u8")[:, 0] for p in parts])) if parts else np.zeros(0, "<u8")


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    return _set(list(digests(text, shingle, 2)))


def fingerprint(text: str | None, shingle: int = 4, words: int = 1) -> list[int]:
    """SimHash of one text as 64-bit words, lowest first: a bit is 1 where the votes for it are over half."""
    return _as_words(majority(text, shingle, words))


def _as_words(votes: np.ndarray) -> list[int]:
    return np.packbits(votes > 0, bitorder="little").view("<u8").tolist()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, words: int = 1) -> DataFrame:
    """One row per document: ``id_col``, ``fp`` and ``fp_high`` (words as signed longs; the second is 0 for 64 bits).

    With two words also ``weak``: the places of all bits, one byte each, the least decided first;
    ``mark``: a hash of the set of shingles; and ``small``: the set, if it is not too large for the index.
    """
    names = ["id", "fp", "fp_high", "weak", "mark", "small"][: 3 if words == 1 else 6]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes, marks, small = [], [], []
            for text in batch.column(1):
                parts = list(digests(text.as_py(), shingle, words))
                votes.append(_votes(parts, words))
                if words > 1:
                    own = _set(parts)
                    marks.append(xxhash.xxh3_64_intdigest(own.tobytes()))
                    small.append(own.tobytes() if 0 < len(own) <= INDEXED else None)
            got = np.array([_as_words(v) for v in votes], np.uint64).reshape(-1, words).view(np.int64)
            high = got[:, 1].copy() if words > 1 else np.zeros(len(got), np.int64)
            weak = [np.argsort(np.abs(v), kind="stable").astype(np.uint8).tobytes() for v in votes] if words > 1 else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got[:, 0].copy()), pa.array(high), pa.array(weak, pa.binary()), pa.array(np.array(marks, np.uint64).view(np.int64)), pa.array(small, pa.binary())][: len(names)], names)

    rows = text_rows(docs, text_col, id=id_col)
    return rows.mapInArrow(run, "id long, fp long, fp_high long" + (", weak binary, mark long, small binary" if words > 1 else "")).withColumnRenamed("id", id_col)


def _block_masks(blocks: int) -> list[list[int]]:
    """For each block of a 64-bit word its places."""
    edges = [WORD * i // blocks for i in range(blocks + 1)]
    return [list(range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bucket_keys(fps: np.ndarray, bits: int) -> np.ndarray:
    """Keys [row, choice of blocks] made from the distances of 64-bit words to the references of three blocks."""
    blocks = bits + 3
    cells = []
    for places in _block_masks(blocks):
        cell = np.zeros(len(fps), np.uint64)
        mask = np.uint64(sum(1 << b for b in places))
        for unit in [0, *(1 << b for b in places)]:
            distance = np.bitwise_count((fps[:, 0] ^ np.uint64(unit)) & mask).astype(np.uint64)
            cell = _mix(cell * np.uint64(0x9E3779B97F4A7C15) + distance + np.uint64(1))
        cells.append(cell)
    choices = combinations(range(blocks), 3)
    keys = [_mix(_mix(_mix(cells[i] + np.uint64(n + 1)) + cells[j]) + cells[k]) for n, (i, j, k) in enumerate(choices)]
    return np.stack(keys, axis=1)


def probe_keys(fps: np.ndarray, weak: np.ndarray) -> np.ndarray:
    """Keys [row, probe] of 128-bit fingerprints [row, word] and the order ``weak`` [row, bit] of their bits, least decided first.

    A block's key is its row of distances to the block's references: the distance to a unit word
    is that to the zero word, less one where the bit is set and one more where it is not, so the
    row is written as those bits. Every subset of the least decided places gives one more row.
    """
    width = WORD * fps.shape[1]
    on = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")
    order = np.empty((len(fps), width), np.uint8)
    np.put_along_axis(order, weak.astype(np.int64), np.arange(width, dtype=np.uint8)[None, :], axis=1)
    units = np.int64(1) << np.arange(WIDE_PLACES)
    rng, keys, drawn = np.random.default_rng(7), [], []
    while len(drawn) < WIDE_BLOCKS:  # every place comes into as many blocks as any other, or one less
        shuffled = rng.permutation(width)
        drawn += [shuffled[i * WIDE_PLACES : (i + 1) * WIDE_PLACES] for i in range(width // WIDE_PLACES)]
    for block, places in enumerate(drawn[:WIDE_BLOCKS]):
        row = on[:, places] @ units + (np.int64(block) << WIDE_PLACES)
        flips = units[np.argpartition(order[:, places], WIDE_FLIPS, axis=1)[:, :WIDE_FLIPS]]
        for subset in range(1 << WIDE_FLIPS):
            chosen = [flips[:, i] for i in range(WIDE_FLIPS) if subset >> i & 1]
            keys.append(row ^ sum(chosen, np.zeros(len(fps), np.int64)))
    return np.stack(keys, axis=1)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int16)


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """The rows of fingerprints [row, word] in the pivot table: distances to all references, as bytes of longs [row, long]."""
    words = fps.shape[1]
    near = _distance(fps[:, None, :], PIVOTS[None, : N_PIVOTS[words], :words])
    return near.astype(np.uint8).view(np.int64)


def bucket_links(keys: np.ndarray, fps: np.ndarray, table: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links among the rows of equal key (rows sorted by key) that differ in <= ``bits``, as row numbers.

    ``table`` has the pivot table's row of each fingerprint.
    """
    same = np.flatnonzero(np.append(keys[1:] == keys[:-1], False))
    rows = np.unique(np.concatenate([same, same + 1]))
    keys, fps = keys[rows], fps[rows]
    table = np.ascontiguousarray(table[rows]).view(np.uint8).astype(np.int16)
    parent = np.arange(len(fps))
    made_a, made_b = [], []

    def find(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    def compare(lefts: np.ndarray, rights: np.ndarray) -> None:
        apart = parent[lefts] != parent[rights]
        lefts, rights = lefts[apart], rights[apart]
        before = len(made_a)
        for at in range(0, len(lefts), STEP):
            i, j = lefts[at : at + STEP], rights[at : at + STEP]
            near = np.abs(table[i] - table[j]).max(axis=1) <= bits
            i, j = i[near], j[near]
            near = _distance(fps[i], fps[j]) <= bits
            for a, b in zip(i[near].tolist(), j[near].tolist(), strict=True):
                a, b = find(a), find(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    made_a.append(a)
                    made_b.append(b)
        if len(made_a) > before:  # every row points at its root again, so that joined pairs are skipped
            while (up := parent[parent] != parent).any():
                parent[up] = parent[parent[up]]

    # First every row with its bucket's first row, which joins most copies; then all other pairs.
    firsts = np.maximum.accumulate(np.where(np.append(True, keys[1:] != keys[:-1])[: len(keys)], np.arange(len(keys)), 0))
    compare(firsts, np.arange(len(keys)))
    lag, left = 1, np.arange(max(0, len(fps) - 1))
    while len(left):
        left = left[left + lag < len(fps)]
        left = left[keys[left] == keys[left + lag]]
        compare(left, left + lag)
        lag += 1
    return rows[np.array(made_a, np.int64)], rows[np.array(made_b, np.int64)]


def near_links(distinct: DataFrame, bits: int = 4, words: int = 1, cell_rows: int = 2048) -> DataFrame:
    """Links ``a``, ``b`` (nodes) whose closure joins all fingerprints within ``bits`` bits.

    ``distinct`` holds each fingerprint once: ``fp``; with two words also ``node`` (a long of its
    own), ``fp_high`` and ``weak``. With one word ``fp`` is the node. Only links between different
    fingerprints appear, and a task gives no more of them than the fingerprints it reads.
    """
    own = ["fp"] if words == 1 else ["node", "fp", "fp_high"]
    table = [f"t{i}" for i in range(N_PIVOTS[words] // 8)]
    names = [*own, *table]
    typed = ", ".join(f"{n} long" for n in names)

    def longs(batch: pa.RecordBatch) -> np.ndarray:
        return np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = longs(batch.select(own))
            for at in range(0, rows.shape[1], 1024):
                part = rows[:, at : at + 1024]
                fps = np.ascontiguousarray(part[-words:].T).view(np.uint64)
                if words == 1:
                    keys = bucket_keys(fps, bits)
                else:
                    weak = b"".join(batch.column("weak").slice(at, 1024).to_pylist())
                    keys = probe_keys(fps, np.frombuffer(weak, np.uint8).reshape(len(fps), -1))
                carried = [*part, *pivot_table(fps).T]
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), *[pa.array(np.repeat(x, keys.shape[1])) for x in carried]], ["key", *names])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b in starred(pairs(batches)):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        # Rows come sorted by (key, cell); the last run of a batch waits for the next batch.
        held = np.zeros((2 + len(names), 0), np.int64)

        def links(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            run = _mix(rows[0].view(np.uint64)) + rows[1].view(np.uint64)
            mine, dist = rows[2 : 2 + len(own)], rows[2 + len(own) :]
            a, b = bucket_links(run, np.ascontiguousarray(mine[-words:].T).view(np.uint64), dist.T, bits)
            return mine[0][a], mine[0][b]

        for batch in batches:
            rows = np.concatenate([held, longs(batch)], axis=1)
            if not rows.shape[1]:
                continue
            ends = np.flatnonzero((rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1]))
            cut = ends[-1] + 1 if len(ends) else 0
            if cut:
                yield links(np.ascontiguousarray(rows[:, :cut]))
            held = np.ascontiguousarray(rows[:, cut:])
        if held.shape[1]:
            yield links(held)

    entered = distinct.select(*own, *["weak"][: words - 1])
    if words > 1:
        entered = entered.repartition(max(1, -(-distinct.count() // ENTERED)))
    keys = entered.mapInArrow(explode, f"key long, {typed}")
    hot = stage(keys.groupBy("key").count().filter(F.col("count") > cell_rows), "hot")
    if hot.limit(1).count():
        # A member of a hot bucket goes to one cell with every chunk of the bucket.
        hot = hot.select("key", F.ceil(F.col("count") / cell_rows).cast("long").alias("chunks"))
        keys = keys.join(hot, "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        keys = keys.withColumn("own", F.pmod(F.xxhash64(own[0]), F.col("chunks")))
        keys = keys.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        keys = keys.select("key", (F.least("own", "other") * F.col("chunks") + F.greatest("own", "other")).alias("cell"), *names)
    else:
        keys = keys.select("key", F.lit(0).cast("long").alias("cell"), *names)
    return keys.repartition("key", "cell").sortWithinPartitions("key", "cell").mapInArrow(link, "a long, b long")


def alike(nodes: np.ndarray, sets: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links among sets (sorted, distinct) with a Jaccard similarity of ``least`` or more, all pairs compared."""
    sizes = np.array([len(x) for x in sets])
    whole, n = np.unique(np.concatenate(sets), return_counts=True)
    shared = whole[n > 1]
    common = np.zeros((len(sets), len(sets)))
    at = [np.flatnonzero(np.isin(shared, x, assume_unique=True)) for x in sets]
    for first in range(0, len(shared), COLUMNS):
        block = np.zeros((len(sets), min(COLUMNS, len(shared) - first)), np.float32)
        for i, own in enumerate(at):
            block[i, own[np.searchsorted(own, first) : np.searchsorted(own, first + COLUMNS)] - first] = 1
        common += block @ block.T
    either = sizes[:, None] + sizes[None, :] - common
    a, b = np.nonzero(np.triu(common >= least * np.maximum(either, 1), 1))
    return stars(nodes[a], nodes[b])


def confirmed_links(docs: DataFrame, members: DataFrame, shingle: int, least: float, chunk: int = CHUNK) -> DataFrame:
    """Links ``a``, ``b`` among the candidates of each group whose shingle sets are alike.

    ``docs`` has ``id`` (telling rows apart) and ``text``; ``members`` has each candidate ``node``
    once with its group's ``root``, the number of candidates ``members`` and the ``id`` of a text.
    A group of many chunks is many cells: its texts go to as many tasks as it has chunks.
    """

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x.as_py(), shingle).tobytes() for x in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sets, pa.binary())], ["node", "root", "members", "shingles"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, sets = None, [], []

        def done() -> Iterator[pa.RecordBatch]:
            if len(nodes) > 1:
                a, b = alike(np.array(nodes, np.int64), sets, least)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        # Rows come sorted by cell.
        for batch in batches:
            for *cell, node, raw in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if cell != key:
                    yield from done()
                    key, nodes, sets = cell, [], []
                nodes.append(node)
                sets.append(np.frombuffer(raw, "<u8"))
        yield from done()

    texts = docs.join(members, "id").select("node", "root", "members", "text").mapInArrow(to_sets, "node long, root long, members long, shingles binary")
    chunks = F.ceil(F.col("members") / chunk).cast("long")
    dealt = texts.withColumns({"chunks": chunks, "own": F.pmod(F.xxhash64("node"), chunks)})
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    cells = dealt.select("root", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "node", "shingles")
    return cells.repartition("root", "low", "high").sortWithinPartitions("root", "low", "high").mapInArrow(compare, "a long, b long")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Rows [column, row] of longs sorted by their first column, so that each of its values lies in one piece."""
    held = None
    for batch in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        rows = rows if held is None else np.concatenate([held, rows], axis=1)
        ends = np.flatnonzero(rows[0, 1:] != rows[0, :-1])
        cut = ends[-1] + 1 if len(ends) else 0
        if cut:
            yield rows[:, :cut]
        held = rows[:, cut:]
    if held is not None and held.shape[1]:
        yield held


def indexed_links(sets: DataFrame, least: float) -> DataFrame:
    """All pairs ``a``, ``b`` of nodes of different ``root`` whose sets have a similarity of ``least`` or more.

    ``sets`` (staged) has ``node``, ``root`` and ``small``, the sorted set. Two such sets share one of
    their first shingles in any common order of shingles, floor((1 - ``least``) n) + 1 of n: the
    order is by hash, frequent shingles last, so lists of texts with the same shingle stay short.
    Where two meet, sizes and 128 parities of the sets bound the similarity; what is left is verified once.
    """
    longs = ["h", "node", "root", "n", "even", "odd"]
    apart = (1 - least) / (1 + least)  # of both sizes: the most that may lie in one set alone

    def prefix(n: int) -> int:
        return n - int(np.ceil(least * n - 1e-9)) + 1

    def first_ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                own = np.frombuffer(raw.as_py(), "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(own[: 2 * prefix(len(own))])], ["h"])

    counts = sets.select("small").mapInArrow(first_ones, "h long").groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > FREQUENT)
    frequent = [r.h for r in counts.orderBy(F.desc("n"), "h").limit(MOST_FREQUENT).collect()]
    late = np.sort(np.array(frequent, np.int64))
    place = np.zeros(len(late), np.int64)
    place[np.searchsorted(late, np.array(frequent, np.int64))] = -np.arange(len(late))  # the most frequent is the last

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for node, root, raw in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                own = np.frombuffer(raw, "<i8")
                at = np.minimum(np.searchsorted(late, own), max(0, len(late) - 1))
                last = late[at] == own if len(late) else np.zeros(len(own), bool)
                order = np.lexsort((np.where(last, place[at] if len(late) else 0, own), last))
                chosen = own[order[: prefix(len(own))]]
                parity = np.packbits(np.bincount(own & 127, minlength=128).astype(np.uint8) & 1, bitorder="little").view("<i8")
                parts.append(np.stack([chosen, *[np.full(len(chosen), v, np.int64) for v in (node, root, len(own), *parity)]]))
            if parts:
                whole = np.concatenate(parts, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in whole], longs)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            h, node, root, n, even, odd = rows
            left, lag = np.arange(max(0, len(h) - 1)), 1
            while len(left):
                left = left[left + lag < len(h)]
                left = left[h[left] == h[left + lag]]
                for at in range(0, len(left), STEP):
                    i = left[at : at + STEP]
                    j = i + lag
                    both = (root[i] != root[j]) & (np.minimum(n[i], n[j]) >= least * np.maximum(n[i], n[j]) - 1e-9)
                    i, j = i[both], j[both]
                    differ = np.bitwise_count(even[i] ^ even[j]).astype(np.int64) + np.bitwise_count(odd[i] ^ odd[j])
                    near = differ <= apart * (n[i] + n[j]) + 1e-9
                    i, j = i[near], j[near]
                    if len(i):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], ["a", "b"])
                lag += 1

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<i8"), np.frombuffer(y, "<i8")
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(common >= least * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    dealt = sets.select("node", "root", "small").mapInArrow(entries, ", ".join(f"{c} long" for c in longs)).repartition("h").sortWithinPartitions("h")
    pairs = dealt.mapInArrow(meet, "a long, b long").distinct()
    side = lambda c: sets.select(F.col("node").alias(c), F.col("small").alias(f"{c}_set"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_set", "b_set").mapInArrow(verify, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, bits: int = 4, words: int = 1, confirm: float | None = None) -> DataFrame:
    """Groups of documents whose fingerprints of 64 * ``words`` bits link at ``bits`` or fewer differing bits.

    With ``confirm`` (two words only) documents link if their sets of shingles have that Jaccard
    similarity or more; fingerprints find the candidates, with a small chance to miss one, and an
    exact index those of texts of up to ``INDEXED`` distinct shingles. Returns
    one row per input row: ``id_col``, ``fingerprint`` (16 hex digits for each word) and
    ``component_id``, the smallest id reachable over links (itself included).

    Null or word-less texts have fingerprint zero and no shingles and link like any other, with
    ``confirm`` to each other. Null ids stay as rows with a null id; a group of null ids only has a
    null component. Repeated rows are kept and share a component. Other columns are ignored,
    whatever their names. An empty table gives an empty result. Texts of any length are hashed whole.
    """
    mark = ["fp"] if words == 1 else ["fp", "fp_high", "mark"] if confirm else ["fp", "fp_high"]
    wanted = ["id", *mark, *(["weak", "row"] if words > 1 else []), *(["small"] if confirm else [])]
    if confirm:
        (key,) = fresh(docs, "own_row")
        docs = keyed(docs, id_col, key, text_col)
        rows = fingerprints(docs, key, text_col, shingle, words).withColumnRenamed(key, "row")
        ids = docs.select(column(key).alias("row"), column(id_col).cast("long").alias("id"))
        # The key is the id where ids tell rows apart, so a join is needed for others only.
        marks = rows.withColumn("id", F.col("row")) if getattr(docs, "_staged_path", None) is None else rows.join(ids, "row")
    else:
        marks = fingerprints(docs, id_col, text_col, shingle, words).withColumnRenamed(id_col, "id").withColumn("row", F.lit(None).cast("long"))
    marks = stage(marks.select(*wanted), "fingerprints")
    least = [F.min("weak").alias("weak"), F.min("row").alias("row")] if words > 1 else []
    firsts = marks.groupBy(*mark).agg(F.min("id").alias("first"), F.count("*").alias("n"), *least)
    # The bits of two words don't fit a node's long: a number stands for them.
    firsts = stage(firsts.withColumn("node", F.col("fp") if words == 1 else F.monotonically_increasing_id()), "firsts")
    links = thin_edges(stage(near_links(firsts, bits, words, 2048 if words == 1 else 512), "links"))
    roots = connected_components(links)
    release(links)
    if confirm:
        sizes = roots.groupBy("root").agg(F.count("*").alias("members")).filter("members > 1")
        sizes = stage(sizes, "sizes")
        members = join_hot(roots, sizes, ["root"], "members").join(firsts.select("node", F.col("row").alias("id")), "node")
        texts = docs.select(column(key).alias("id"), column(text_col).cast("string").alias("text"))
        members = stage(members.select("id", "node", "root", "members"), "members")
        # Within a group of candidates all pairs are compared; the index is for pairs of different groups.
        sets = marks.filter("small IS NOT NULL").select("row", "small").join(firsts.select("node", "row"), "row").join(roots, "node", "left")
        sets = stage(sets.select("node", F.coalesce("root", "node").alias("root"), "small"), "small_sets")
        links = thin_edges(stage(confirmed_links(texts, members, shingle, confirm), "confirmed"))
        release(roots, sizes, members)
        roots = connected_components(links)
        release(links)
        more = stage(indexed_links(sets, confirm), "indexed")
        if not more.isEmpty():
            joined = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)
            again = connected_components(thin_edges(stage(joined, "joined")))
            release(roots)
            roots = again
        release(sets, more)
    grouped = stage(firsts.join(roots, "node", "left").select(*mark, "first", "n", F.coalesce("root", "node").alias("root")), "grouped")
    classes = stage(grouped.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("members")), "classes")
    of = stage(join_hot(grouped, classes, ["root"], "members").select(*mark, "n", "component_id"), "of")
    release(firsts, roots, grouped, classes)
    digits = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    shown = digits("fp") if words == 1 else F.concat(digits("fp_high"), digits("fp"))
    return join_hot(marks, of, mark, "n").select(F.col("id").alias(id_col), shown.alias("fingerprint"), "component_id")
