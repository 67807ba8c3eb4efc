"""Exact top-k by inner product with distributed histogram selection.

Every query is scored against every row: blocks of queries meet blocks of rows, many cells a task.
Each round histograms the scores of every query over equal bins of the range that holds its kth
value, adds the histograms up over the cluster, and narrows the range to the bin with the kth
value, until a bin is one score wide. A last pass keeps the scores above that value and, of those
equal to it, the smallest ids.

Components are integers of any size. Blocks hold vectors of one length and one class of size: with
small ones products are exact in doubles, with medium ones in 64-bit integers, and the few vectors
beyond are multiplied as Python integers. Scores beyond 2**62 share one value in the histograms and
are told apart by a text of fixed length that sorts like the number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strideframe.llm._common import column, release, stage

BINS = 4096
#: Rows of a block of candidates, of a block of queries.
ROWS, QUERIES = 4096, 512
#: Scores at or beyond this, either side, count as this in histograms.
MOST = (1 << 62) - 1
#: Classes of vectors by their largest component after scaling: below 2**20, below 2**26, any.
SMALL, MEDIUM = 2.0**20, 2.0**26
#: Hexadecimal digits of the sortable text of a score: products of two doubles, scaled, and their sums.
DIGITS = 640


def finite(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id``, ``vec`` (array of double) of the rows that take part: no null or non-finite component, an id."""
    rows = rows.select(column(id_col).cast("long").alias("id"), column(vec_col).cast("array<double>").alias("vec"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return rows.filter("id IS NOT NULL AND vec IS NOT NULL").filter(F.forall("vec", fine))


def integers(vecs: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as Python integers, also where the product is beyond the doubles."""

    def one(x: float) -> int:
        y = x * scale
        return math.floor(y) if math.isfinite(y) else math.floor(x) * math.floor(scale)

    return np.array([[one(x) for x in v] for v in vecs.tolist()], dtype=object).reshape(vecs.shape)


def sortable(score: int) -> str:
    """A text that sorts like the number."""
    return format(score + (1 << (4 * DIGITS - 1)), f"0{DIGITS}x")


def _blocks(rows: DataFrame, most: int, scale: float, extra: str | None = None) -> DataFrame:
    """Rows of each partition as blocks of one length and class: ``dim``, ``size``, ids, vectors (unscaled for the last class), ``extra`` (longs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[tuple]] = {}

        def block(dim: int, size: int, part: list[tuple]) -> pa.RecordBatch:
            ids, vecs, more = zip(*part, strict=True)
            vecs = np.array(vecs, np.float64).reshape(len(part), dim)
            vecs = vecs if size == 2 else np.floor(vecs * scale)
            cols = [pa.array([x], t) for x, t in ((dim, pa.int32()), (size, pa.int32()), (np.array(ids, np.int64).tobytes(), pa.binary()), (vecs.tobytes(), pa.binary()), (np.array(more, np.int64).tobytes(), pa.binary()))]
            return pa.RecordBatch.from_arrays(cols, ["dim", "size", "ids", "vecs", "extra"])

        for batch in batches:
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                largest = max(map(abs, row[1]), default=0.0) * scale
                kind = len(row[1]), 0 if largest < SMALL else 1 if largest < MEDIUM else 2
                own = held.setdefault(kind, [])
                own.append(row)
                if len(own) == most:
                    yield block(*kind, own)
                    own.clear()
        for kind, own in held.items():
            if own:
                yield block(*kind, own)

    more = F.col(extra) if extra else F.lit(0).cast("long")
    return rows.select("id", "vec", more.alias("extra")).mapInArrow(run, "dim int, size int, ids binary, vecs binary, extra binary")


def scores(q: np.ndarray, c: np.ndarray, sizes: tuple[int, int], scale: float) -> np.ndarray:
    """Inner products [query, candidate]: longs, or Python integers where a vector of the last class takes part."""
    if max(sizes) < 2:
        bound = q.shape[1] * max(1.0, np.abs(q).max(initial=0)) * max(1.0, np.abs(c).max(initial=0))
        if bound < 2.0**53:
            return (q @ c.T).astype(np.int64)
        if bound < 2.0**62:
            return q.astype(np.int64) @ c.astype(np.int64).T
    whole = [integers(v, scale if size == 2 else 1.0) for v, size in zip((q, c), sizes, strict=True)]
    return np.array([[sum(map(int.__mul__, a, b)) for b in whole[1].tolist()] for a in whole[0].tolist()], dtype=object).reshape(len(q), len(c))


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """The ``k`` best rows for each query: ``query_id``, ``rank`` (from 1), ``id_col``, ``score``.

    Vectors are quantized to floor(``scale`` * x). Ties go to the smaller id. Rows with the
    query's own id are no candidates for it. A query with fewer candidates than ``k`` gets all.

    Vectors (of rows or queries) that are null, or hold a null, a NaN or an infinity, take no part,
    and neither do rows with a null id; finite components of any size do. Ranks follow the exact
    scores; one beyond the range of a long is returned as the nearest long. Vectors of another
    length than the query's are no candidates for it. Repeated rows are candidates each on their
    own; a repeated query id is asked once, with its smallest vector. Empty tables give an empty
    result. Other columns are ignored, whatever their names.
    """
    asked = finite(queries, id_col, vec_col)
    asked = stage(asked.groupBy("id").agg(F.min("vec").alias("vec")), "queries")
    body = stage(_blocks(finite(rows, id_col, vec_col), ROWS, scale), "blocks")

    def largest(df: DataFrame) -> tuple[float, int]:
        one = df.agg(F.max(F.array_max(F.transform("vec", F.abs))).alias("m"), F.max(F.size("vec")).alias("d")).first()
        return (one.m or 0.0) * scale + 1, one.d or 0

    (a, dim), (b, _) = largest(asked), largest(finite(rows, id_col, vec_col))
    bound = int(min(float(MOST), a * b * max(dim, 1))) + 1
    bound = min(bound, MOST)

    def blocked(state: DataFrame) -> DataFrame:
        return stage(_blocks(asked.join(state, "id"), QUERIES, scale, "low"), "asked")

    def paired(blocks: DataFrame) -> DataFrame:
        blocks = blocks.toDF("q_dim", "q_size", "q_ids", "q_vecs", "q_low")
        # The stated query set meets all rows block by block. Lengths are compared in the task: as a
        # condition here they would be a join key, and all vectors of one length one task.
        return body.drop("extra").crossJoin(blocks)

    def each(batch: pa.RecordBatch):
        for r in batch.to_pylist():
            if r["dim"] != r["q_dim"]:
                continue
            q_ids, c_ids, low = (np.frombuffer(r[x], np.int64) for x in ("q_ids", "ids", "q_low"))
            q, c = (np.frombuffer(r[x], np.float64).reshape(n, r["dim"]) for x, n in (("q_vecs", len(q_ids)), ("vecs", len(c_ids))))
            exact = scores(q, c, (r["q_size"], r["size"]), scale)
            short = exact if exact.dtype == np.int64 else np.array([[min(MOST, max(-MOST, x)) for x in own] for own in exact.tolist()], np.int64).reshape(exact.shape)
            yield q_ids, c_ids, low, exact, short, q_ids[:, None] != c_ids[None, :]

    def histogram(span: int, width: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for q_ids, _, low, _, short, other in each(batch):
                    place = short - low[:, None]
                    bins = np.where(other & (short >= low[:, None]) & (place < span), place // width, -1)
                    # No bin below a block's own kth score can hold the kth of all.
                    if bins.shape[1] > k:
                        floor = np.partition(bins, bins.shape[1] - k, axis=1)[:, bins.shape[1] - k]
                        bins = np.where(bins >= floor[:, None], bins, -1)
                    q, c = np.nonzero(bins >= 0)
                    codes, n = np.unique(q * BINS + bins[q, c], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[codes // BINS]), pa.array(codes % BINS), pa.array(n.astype(np.int64))], ["id", "bin", "n"])

        return run

    state = stage(asked.select("id", F.lit(-bound).cast("long").alias("low"), F.lit(0).cast("long").alias("above")), "range")
    span = 2 * bound + 1
    down = Window.partitionBy("id").orderBy(F.desc("bin"))
    up = Window.partitionBy("id").orderBy("bin")
    while span > 1:
        width = -(-span // BINS)
        blocks = blocked(state)
        counts = paired(blocks).mapInArrow(histogram(span, width), "id long, bin long, n long").groupBy("id", "bin").agg(F.sum("n").alias("n"))
        # At most BINS rows for a query: the highest bin that reaches k, or the lowest one there is.
        counts = counts.join(state, "id").withColumn("over", F.sum("n").over(down) + F.col("above"))
        reached = counts.filter((F.col("over") - F.col("n") < k)).withColumn("place", F.row_number().over(up)).filter("place = 1")
        found = stage(reached.select("id", (F.col("low") + F.col("bin") * width).alias("low"), (F.col("over") - F.col("n")).alias("above")), "range")
        release(state, blocks)
        state, span = found, width

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_ids, c_ids, low, exact, short, other in each(batch):
                order = np.argsort(c_ids, kind="stable")
                exact, short, other, c_ids = exact[:, order], short[:, order], other[:, order], c_ids[order]
                tied = other & (short == low[:, None])
                first = np.cumsum(tied, axis=1) <= k
                # Scores that share the end of the range are not ties: all of them go on.
                first |= (np.abs(low) >= MOST)[:, None]
                q, c = np.nonzero((other & (short > low[:, None])) | (tied & first))
                score = short[q, c]
                far = [sortable(int(x)) if abs(s) >= MOST else None for s, x in zip(score.tolist(), exact[q, c].tolist(), strict=True)]
                shown = [min((1 << 63) - 1, max(-(1 << 63), int(x))) for x in exact[q, c].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[q]), pa.array(c_ids[c]), pa.array(score), pa.array(far, pa.string()), pa.array(shown, pa.int64())], ["id", "other", "short", "far", "score"])

    blocks = blocked(state)
    release(asked, state)
    best = paired(blocks).mapInArrow(last, "id long, other long, short long, far string, score long")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("short"), F.desc("far"), "other"))
    best = best.withColumn("rank", place).filter(F.col("rank") <= k)
    return best.select(F.col("id").alias("query_id"), "rank", F.col("other").alias(id_col), "score")
