"""Connected components of an edge table by label hooking and pointer jumping."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm._common import hot_limit, join_hot, release, stage

#: Edges that a task holds at a time when it thins them.
HELD_EDGES = 1 << 20


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges with the same components as ``a``, ``b``: every node with the smallest of its component, itself left out."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        ends = parent[x], parent[y]
        low, high = np.minimum(*ends), np.maximum(*ends)
        open_ = low < high
        if not open_.any():
            break
        np.minimum.at(parent, high[open_], low[open_])
        while not np.array_equal(up := parent[parent], parent):
            parent = up
    other = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[parent[other]], nodes[other]


def starred(edges: Iterable[tuple[np.ndarray, np.ndarray]], most: int = HELD_EDGES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The edges of a task as stars; about ``most`` edges are held at a time, whatever the task reads."""
    held, count = [], 0
    for a, b in edges:
        for at in range(0, len(a), most):
            held.append((a[at : at + most], b[at : at + most]))
            count += len(held[-1][0])
            if count >= most:
                made = stars(*map(np.concatenate, zip(*held, strict=True)))
                held, count = [made], len(made[0])
                if count > most // 2:
                    yield made
                    held, count = [], 0
    if count:
        yield stars(*map(np.concatenate, zip(*held, strict=True)))


def thin_edges(edges: DataFrame, most: int = HELD_EDGES) -> DataFrame:
    """A staged edge table (longs ``a``, ``b``, no nulls) with the components of ``edges`` and fewer edges.

    Every task turns about ``most`` edges into stars, without a shuffle, for as long as that halves
    the table; what is left goes on to ``connected_components``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = (tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns) for batch in batches if batch.num_rows)
        for a, b in starred(ends, most):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    n = edges.count()
    while n:
        tasks = -(-n // most)
        thin = stage(edges.select("a", "b").coalesce(tasks).mapInArrow(run, "a long, b long"), "thin")
        release(edges)
        before, n, edges = n, thin.count(), thin
        if tasks == 1 or 2 * n > before:
            break
    return edges


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Label every node of ``edges`` (two long columns) with the smallest node it can reach.

    Each round every class of nodes takes the smallest label among its neighbour classes, then
    labels jump to the label of their label, so that distances halve. Labels live in staged
    tables; the driver only learns how many labels changed. Returns ``node``, ``root``; an empty
    edge table gives an empty result. Self-loops are fine, rows with a null end are ignored.
    """
    edges = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    both = stage(edges.union(edges.select("y", "x")).distinct(), "edges")
    # ``n``: the neighbours of a node, so that those of a hub can be told from others before the join.
    labels = stage(both.groupBy(F.col("x").alias("node")).agg(F.min(F.least("x", "y")).alias("root"), F.count("*").alias("n")), "labels")
    hubs = hot_limit(labels, "n")
    while True:
        seen = join_hot(both, labels.withColumnRenamed("node", "y"), ["y"], "n", hubs)
        near = seen.groupBy(F.col("x").alias("node")).agg(F.min("root").alias("near"))
        # A class moves to the smallest label that any of its members sees.
        hook = labels.join(near, "node").groupBy(F.col("root").alias("old")).agg(F.min(F.least("root", "near")).alias("to"), F.count("*").alias("members"))
        hook = stage(hook, "hook")
        jump = hook.select(F.col("old").alias("to"), F.col("to").alias("over"))
        hooked = hook.join(jump, "to", "left").select(F.col("old").alias("root"), F.coalesce("over", "to").alias("to"), "members")
        moved = join_hot(labels, hooked, ["root"], "members")
        moved = stage(moved.select("node", F.col("to").alias("root"), "n", (F.col("to") != F.col("root")).alias("moved")), "labels")
        changed = moved.filter("moved").limit(1).count()
        release(labels)
        release(hook)
        labels = moved.drop("moved")
        labels._staged_path = moved._staged_path  # noqa: SLF001
        if not changed:
            release(both)
            out = labels.select("node", "root")
            out._staged_path = labels._staged_path  # noqa: SLF001 - for release()
            return out
