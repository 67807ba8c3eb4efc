"""Removal of repeated line runs by prefix doubling over line sequences.

Lines become 128-bit ids, documents sequences of ids. Prefix doubling ranks all suffixes of the
sequences by their first 1, 2, 4, ... lines: the rank of a suffix at level j + 1 is the place of
the pair (its rank, the rank of the suffix 2**j lines on) in the sorted order of all pairs, found
by a range exchange and prefix sums. A suffix that shares its first 2**j lines with no other, or
ends before, leaves the work, so levels shrink fast. Suffixes of one rank are an interval of the
suffix array whose longest common prefix is 2**j lines or more.

A run counts once it has ``min_words`` words, and a line goes if it lies in any run that began
earlier elsewhere. Every such run is the union of its shortest windows of ``min_words`` words: the
one from its first line on, and for each later line the one that ends there. A window of k lines
lies in the interval that the ranks of its first and its last 2**j lines (2**j <= k < 2**(j+1))
name; where its interval holds an earlier suffix, the window's lines are a copy. The first copy in
the order of (row, line) stays. So a maximal run is deleted whole, however long, without comparing
prefixes longer than a window.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.llm._common import column, fresh, join_hot, keyed, release, stage, text_rows


def line_table(docs: DataFrame, key: str, text_col: str, min_words: int) -> DataFrame:
    """``key``, ``pos``, the line's 128-bit id ``h1``, ``h2``, and ``least``, ``most``: how many lines the windows from here have.

    ``least`` is the fewest lines from here on with ``min_words`` words, 0 for never. Up to ``most``
    lines, no window with as many words begins later and ends in the same place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                keys, pos, digests, least, most = [], [], [], [], []
                for ident, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    if text is None:
                        continue
                    own = text.encode("utf-8", "surrogatepass").split(b"\n")
                    words = np.cumsum([0, *[len(x.split()) for x in own]])
                    reach = np.searchsorted(words, words[:-1] + max(1, min_words))
                    enough = reach < len(words)
                    upto = np.minimum(np.append(reach[1:], len(words)), len(words)) - 1
                    least.append(np.where(enough, reach - np.arange(len(own)), 0))
                    most.append(np.where(enough, np.maximum(upto, reach) - np.arange(len(own)), 0))
                    digests += [xxhash.xxh3_128_digest(x) for x in own]
                    keys.append(np.full(len(own), ident, np.int64))
                    pos.append(np.arange(len(own), dtype=np.int32))
                halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                flat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
                cols = [pa.array(flat(keys, np.int64)), pa.array(flat(pos, np.int32)), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), pa.array(flat(least, np.int32)), pa.array(flat(most, np.int32))]
                yield pa.RecordBatch.from_arrays(cols, ["key", "pos", "h1", "h2", "least", "most"])

    rows = text_rows(docs, text_col, key=key)
    return rows.mapInArrow(run, "key long, pos int, h1 long, h2 long, least int, most int")


def ranked(pairs: DataFrame) -> DataFrame:
    """``a``, ``b``, ``n``, ``rank``: how many suffixes stand before the pair in sorted order.

    ``pairs`` has each pair (``a``, ``b``) once with its number of suffixes ``n``. The driver gets
    one sum for each partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(n) + before
            before = int(ends[-1]) if len(ends) else before
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(ends - n), pa.array(np.full(len(n), part, np.int32))], ["a", "b", "n", "before", "part"])

    ordered = pairs.select("a", "b", "n").repartitionByRange("a", "b").sortWithinPartitions("a", "b")
    placed = stage(ordered.mapInArrow(run, "a long, b long, n long, before long, part int"), "ranked")
    sums = sorted(placed.groupBy("part").agg(F.sum("n").alias("n")).collect())
    starts, total = [], 0
    for part, n in sums:
        starts.append((part, total))
        total += n
    offsets = placed.sparkSession.createDataFrame(starts, "part int, start long")
    return placed.join(F.broadcast(offsets), "part").select("a", "b", "n", (F.col("before") + F.col("start")).alias("rank"))


def repeated_runs(lines: DataFrame) -> DataFrame:
    """Copies of windows that began earlier elsewhere: ``key``, ``pos``, ``k`` (lines ``pos`` to ``pos + k - 1``).

    ``lines`` is staged, and released where there are any windows. A line, pair or window that a great part of all rows repeat goes to all tasks.
    """
    repeated = lines.groupBy(F.col("h1").alias("a"), F.col("h2").alias("b")).agg(F.count("*").alias("n")).filter("n > 1")
    ids = stage(ranked(repeated), "ids")
    named = join_hot(lines.withColumnsRenamed({"h1": "a", "h2": "b"}), ids, ["a", "b"], "n")
    active = stage(named.select("key", "pos", "least", "most", "rank"), "level")
    longest = active.agg(F.max("most")).first()[0] or 0
    runs, spent, level = [], [ids, active], 0
    while longest >= 1 << level:
        step = 1 << level
        # Windows of step to 2 * step - 1 lines: the ranks of their first and last step lines name them.
        ends = active.select("key", F.col("pos").alias("at"), F.col("rank").alias("last"))
        first, end = F.greatest("least", F.lit(step)), F.least("most", F.lit(2 * step - 1))
        found = active.filter("least > 0").filter(first <= end).withColumn("k", F.explode(F.sequence(first, end))).withColumn("at", F.col("pos") + F.col("k") - step)
        found = found.join(ends, ["key", "at"]).select("key", "pos", "k", F.lit(level).alias("level"), F.col("rank").alias("first"), "last")
        runs.append(found)
        level += 1
        if longest < 1 << level:
            break
        after = active.select("key", (F.col("pos") - step).alias("pos"), F.col("rank").alias("b"))
        pairs = active.withColumnRenamed("rank", "a").join(after, ["key", "pos"])
        pairs = stage(pairs.select("key", "pos", "least", "most", "a", "b"), "pairs")
        ranks = stage(ranked(pairs.groupBy("a", "b").agg(F.count("*").alias("n")).filter("n > 1")), "ids")
        active = stage(join_hot(pairs, ranks, ["a", "b"], "n").select("key", "pos", "least", "most", "rank"), "level")
        release(pairs)
        spent += [ranks, active]
    if not runs:
        return lines.select("key", "pos", F.col("least").alias("k")).limit(0)
    runs = stage(reduce(DataFrame.unionByName, runs), "runs")
    release(lines)
    release(*spent)
    name = ["level", "k", "first", "last"]
    heads = stage(runs.groupBy(*name).agg(F.count("*").alias("n"), F.min(F.struct("key", "pos")).alias("head")).filter("n > 1"), "heads")
    later = join_hot(runs, heads, name, "n").filter(F.struct("key", "pos") != F.col("head"))
    return later.select("key", "pos", "k")


def remove_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, report: bool = False) -> DataFrame:
    """``docs`` without the later copies of repeated line runs of ``min_words`` or more words.

    Lines are split at line feeds and compared byte for byte; words are runs without ASCII white
    space. A line goes if it lies in a run of ``min_words`` or more words that also begins at an
    earlier place. Places are ordered by ``id_col``, then line number; an earlier place within the
    same text counts too. The result has the rows and columns of ``docs``, with the text changed;
    with ``report``, also ``n_lines`` and ``removed`` (array of line numbers from 0).

    Null texts stay null and take no part; empty texts are one line without words, never a run.
    A text that is deleted whole becomes empty. Rows of equal ids are ordered by a hash of their
    texts, null ids come last, and of repeated rows one keeps its lines; what else the table holds
    changes no order. An empty table gives an empty result. Extra columns pass through unchanged,
    whatever their names.
    """
    key, cuts, total, gone = fresh(docs, "row_key", "run_cuts", "n_lines", "removed")
    docs = keyed(docs, id_col, key, text_col)
    lines = stage(line_table(docs, key, text_col, min_words), "lines")
    later = repeated_runs(lines)
    # Windows as spans (first, last) of lines, those that touch made one: a few a text.
    spans = F.array_sort(F.collect_list(F.struct("pos", (F.col("pos") + F.col("k") - 1).alias("last"))))
    nothing = F.array().cast("array<struct<pos:int,last:int>>")

    def united(out: Column, s: Column) -> Column:
        tail = F.element_at(out, -1)
        touches = (F.size(out) > 0) & (s["pos"] <= F.try_element_at(out, F.lit(-1))["last"] + 1)
        grown = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(tail["pos"].alias("pos"), F.greatest(tail["last"], s["last"]).alias("last"))))
        return F.when(touches, grown).otherwise(F.concat(out, F.array(s)))

    per_row = later.groupBy(F.col("key").alias(key)).agg(spans.alias(cuts))
    per_row = per_row.select(key, F.aggregate(cuts, nothing, united).alias(cuts))

    joined = docs.join(per_row, key, "left")
    inside = lambda i: F.exists(F.col(cuts), lambda s: i.between(s["pos"], s["last"]))
    rest = F.array_join(F.filter(F.split(column(text_col).cast("string"), "\n", -1), lambda x, i: ~inside(i)), "\n")
    text = F.when(F.col(cuts).isNull(), column(text_col).cast("string")).otherwise(rest)
    out = [text.alias(c) if c == text_col else column(c) for c in docs.columns if c != key]
    if report:
        split = F.when(column(text_col).isNull(), 0).otherwise(F.size(F.split(column(text_col), "\n", -1)))
        listed = F.flatten(F.transform(F.col(cuts), lambda s: F.sequence(s["pos"], s["last"])))
        out += [split.alias(total), F.coalesce(listed, F.array().cast("array<int>")).alias(gone)]
    return joined.select(*out)
