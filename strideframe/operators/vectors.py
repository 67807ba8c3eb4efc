"""Statistics of whole arrays: partial sums of a batch's rows in Arrow, merged by key, never a row for each value."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATS = {"n": "array<long>", "mean": "array<double>", "m2": "array<double>", "low": "array<double>", "high": "array<double>"}
_TYPES = [pa.list_(pa.int64())] + [pa.list_(pa.float64())] * 4


def _matrix(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values [row, place], which are there, and the length of each row: rows may be null, of unlike length and hold nulls."""
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    sizes = np.array([len(v) if v.is_valid else 0 for v in values], np.int64) if values.null_count else np.diff(values.offsets.to_numpy())
    flat = values.flatten()
    made = np.zeros((len(values), sizes.max(initial=0)))
    there = np.zeros(made.shape, bool)
    at = np.arange(made.shape[1])[None, :] < sizes[:, None]
    there[at] = flat.is_valid().to_numpy(zero_copy_only=False)
    made[at] = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
    return made, there, sizes


def _summed(made: np.ndarray, there: np.ndarray) -> list[np.ndarray]:
    """Count, mean, sum of squared differences, least and most of each place; NaN is the largest value."""
    n = there.sum(0)
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        mean = np.where(there, made, 0.0).sum(0) / n
        m2 = np.where(there, (made - mean) ** 2, 0.0).sum(0)
    odd = np.isnan(made) & there
    low = np.where(there & ~odd, made, np.inf).min(0, initial=np.inf)
    high = np.where(there & ~odd, made, -np.inf).max(0, initial=-np.inf)
    return [n, mean, m2, np.where(odd.sum(0) == n, np.nan, low), np.where(odd.any(0), np.nan, high)]


def _merged(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """The statistics of all rows from those of parts, whose places may be unlike in number."""
    width = max(len(p[0]) for p in parts)
    n, mean, m2 = np.zeros(width, np.int64), np.zeros(width), np.zeros(width)
    low, high = np.full(width, np.nan), np.full(width, -np.inf)
    with np.errstate(invalid="ignore", divide="ignore"):
        for k, m, q, lo, hi in parts:
            at = np.flatnonzero(k)
            a, b = n[at], k[at]
            gap = m[at] - mean[at]
            m2[at] += q[at] + np.where(a > 0, gap**2 * a * b / (a + b), 0.0)
            mean[at] = np.where(a > 0, mean[at] + gap * b / (a + b), m[at])
            n[at] = a + b
            low[at], high[at] = np.fmin(low[at], lo[at]), np.maximum(high[at], hi[at])
    return [n, mean, m2, low, high]


def array_stats(df: DataFrame, by: str, col: str) -> DataFrame:
    """``by``, and arrays ``n``, ``mean``, ``std`` (population), ``low``, ``high`` of each place of ``col`` over the rows of the key.

    Nulls don't count; a place without a value has n = 0 and nulls. Only partial arrays are
    exchanged: one row for each key and batch that has it.
    """
    key = df.schema[by].dataType.simpleString()
    schema = f"`{by}` {key}, " + ", ".join(f"{n} {t}" for n, t in STATS.items())

    def rows(keys: pa.Array, parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        arrays = [pa.array([p[i] for p in parts], t) for i, t in enumerate(_TYPES)]
        return pa.RecordBatch.from_arrays([keys, *arrays], [by, *STATS])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).dictionary_encode(null_encoding="encode")
            codes = keys.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(codes, kind="stable")
            made, there, sizes = _matrix(batch.column(1).take(pa.array(order)))
            cuts = np.flatnonzero(np.diff(codes[order], prepend=-1)).tolist()
            parts = [_summed(made[a:b, :w], there[a:b, :w]) for a, b in zip(cuts, [*cuts[1:], len(codes)], strict=True) for w in [sizes[a:b].max()]]
            if parts:
                yield rows(keys.dictionary.take(pa.array(codes[order][cuts])), parts)

    def merge(table: pa.Table) -> pa.Table:
        parts = [[np.array(v) for v in p] for p in zip(*[table.column(c).to_pylist() for c in STATS], strict=True)]
        return pa.Table.from_batches([rows(table.column(by).combine_chunks().slice(0, 1), [_merged(parts)])])

    values = df.select(F.col(by), F.transform(F.col(col), lambda v: v.cast("double")).alias("_values"))
    out = values.mapInArrow(partial, schema).groupBy(by).applyInArrow(merge, schema)
    known = lambda c, f=lambda v, k: v: F.zip_with(c, "n", lambda v, k: F.when(k > 0, f(v, k)))
    return out.select(by, "n", known("mean").alias("mean"), known("m2", lambda v, k: F.sqrt(v / k)).alias("std"), known("low").alias("low"), known("high").alias("high"))
