"""Spelling variants of a corpus: words one edit apart, found by blocked Gram matrices of letter counts.

Letters are dealt into groups by how often they occur in the vocabulary. One edit changes at most
two counts of letters by one, so the counts of two near words by group differ by one letter moved
between groups, one letter more, or not at all. The counts of the first few groups are the cell of
a word on Spark's side: cells are cut into blocks of bounded size, and a block visits the cells on
one side of its own, so that each pair of blocks meets once. Where blocks meet, the counts of all groups
part their words further (lengths too), and a NumPy product of the letter counts of each such part
(the Gram matrix) with those of the parts around it gives all squared distances; pairs at most two
apart stay, and their edit is verified letter by letter. More groups for a larger vocabulary keep
cells and parts small.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.llm._common import column, join_hot, stage

#: Words of a block, words that travel in a row, visiting words that meet a block at a time, and columns of a product.
BLOCK_WORDS = 16_384
ROW_WORDS = 1024
VISITORS = 65_536
COLUMNS = 8192
#: Groups of letters beyond those of a cell, by which the words of a block are parted.
FINER = 5
#: Longer words are verified one by one.
LONG = 64
#: Letters that make words, and the one case that is folded.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = LOWER + "".join(map(chr, range(0xC0, 0x100)))
RUN = r"[A-Za-zÀ-ÿ]+"
#: One word of so many loses a letter when misspellings are planted.
EVERY = 31

_column_of = np.zeros(256, np.int64)
_column_of[[ord(c) for c in LETTERS]] = np.arange(len(LETTERS))


class Block:
    """Words with their occurrences in the order of their parts: letter counts, and the places where each part begins."""

    def __init__(self, words: list[str], n: np.ndarray, groups: np.ndarray, weights: np.ndarray) -> None:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        letters = _column_of[np.frombuffer("".join(words).encode("latin-1"), np.uint8)]
        counts = np.bincount(np.repeat(np.arange(len(words)), sizes) * len(LETTERS) + letters, minlength=len(words) * len(LETTERS)).reshape(len(words), -1)
        # A part's number is linear in the counts by group, so that one letter moved adds a constant.
        key = counts @ weights[groups]
        order = np.argsort(key, kind="stable")
        self.words, self.n, self.sizes = np.array(words, object)[order], n[order], sizes[order]
        # Products of counts are whole numbers and exact below 2**24 (or 2**53).
        self.counts = counts[order].astype(np.float32 if sizes.max() < 4000 else np.float64)
        self.squares = (self.counts * self.counts).sum(1)
        self.keys, self.starts = np.unique(key[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(words))
        short = np.minimum(self.sizes, LONG)
        places = np.arange(short.sum()) - np.repeat(np.cumsum(short) - short, short)
        self.codes = np.zeros((len(words), LONG), np.uint8)
        self.codes[np.repeat(np.arange(len(words)), short), places] = np.frombuffer("".join([w[:LONG] for w in self.words]).encode("latin-1"), np.uint8)


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced letter parts two different words."""
    if len(a) > len(b):
        a, b = b, a
    lead = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a != b and (a[lead + 1 :] == b[lead + 1 :] if len(a) == len(b) else a[lead:] == b[lead + 1 :])


def _verified(home: Block, i: np.ndarray, guest: Block, j: np.ndarray) -> np.ndarray:
    """Which of the pairs are one edit apart."""
    good, more = np.zeros(len(i), bool), home.sizes[i] - guest.sizes[j]
    long = (home.sizes[i] > LONG) | (guest.sizes[j] > LONG)
    good[long] = [one_edit(x, y) for x, y in zip(home.words[i[long]], guest.words[j[long]], strict=True)]
    for step in range(0, len(i), 100_000):
        at = np.arange(step, min(step + 100_000, len(i)))
        same = at[(more[at] == 0) & ~long[at]]
        good[same] = (home.codes[i[same]] != guest.codes[j[same]]).sum(1) == 1
        for sign, longer, x, shorter, y in ((1, home, i, guest, j), (-1, guest, j, home, i)):
            one = at[(more[at] == sign) & ~long[at]]
            a, b = longer.codes[x[one]], shorter.codes[y[one]]
            # Up to the first difference both agree; from there on the longer one is a place behind.
            lead = np.cumprod(a == b, 1, dtype=np.uint8)
            shifted = np.concatenate([a[:, 1:], np.zeros((len(a), 1), np.uint8)], 1) == b
            good[one] = ((lead == 1) | shifted).all(1)
    return good


def near_pairs(home: Block, guest: Block, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``home`` and ``guest`` of words one edit apart, in parts that differ by one of ``moves``."""
    wanted = guest.keys[:, None] + moves[None, :]
    found = np.minimum(np.searchsorted(home.keys, wanted), len(home.keys) - 1)
    of_guest, which = np.nonzero(home.keys[found] == wanted)
    of_home = found[of_guest, which]
    order = np.argsort(of_home, kind="stable")
    of_home, of_guest = of_home[order], of_guest[order]
    # The guests of each part, one part after the other.
    sizes = guest.ends[of_guest] - guest.starts[of_guest]
    upto = np.cumsum(sizes)
    guests = np.arange(upto[-1] if len(upto) else 0) - np.repeat(upto - sizes - guest.starts[of_guest], sizes)
    parts, first = np.unique(of_home, return_index=True)
    bounds = np.append(0, upto)[np.append(first, len(of_home))].tolist() if len(parts) else [0]
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for part, a, b in zip(parts.tolist(), bounds, bounds[1:], strict=False):
        start, end = home.starts[part], home.ends[part]
        for k in range(a, b, COLUMNS):
            some = guests[k : min(b, k + COLUMNS)]
            squared = home.squares[start:end, None] + guest.squares[some][None, :] - 2 * (home.counts[start:end] @ guest.counts[some].T)
            i, j = np.nonzero(squared <= 2)
            left.append(i + start)
            right.append(some[j])
    i, j = np.concatenate(left), np.concatenate(right)
    if home is guest:  # a part meets itself from both sides
        once = (i < j) | (np.searchsorted(home.starts, i, "right") != np.searchsorted(home.starts, j, "right"))
        i, j = i[once], j[once]
    good = _verified(home, i, guest, j)
    return i[good], j[good]


def _met(groups: list[str]):
    """Near words of blocks and their visitors (rows of ``key``, ``visits``, ``words``, ``ns`` in this order): ``a``, ``a_n``, ``b``, ``b_n``."""
    group_of = np.array([next(k for k, g in enumerate(groups) if c in g) for c in LETTERS])
    weights = np.random.default_rng(1).integers(1 << 40, 1 << 56, len(groups))  # fixed, so that every task has the same
    one_side = np.unique(np.concatenate([[0], weights, [b - a for k, a in enumerate(weights) for b in weights[k + 1 :]]]))
    every = np.unique(np.concatenate([one_side, -one_side]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(rows: list[tuple[str, pa.ListScalar]]) -> Block:
            return Block([w for words, _ in rows for w in words.split("\n")], np.concatenate([n.values.to_numpy() for _, n in rows]), group_of, weights)

        def products(a: Block, b: Block, moves: np.ndarray) -> Iterator[pa.RecordBatch]:
            i, j = near_pairs(a, b, moves)
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(a.words[i], pa.string()), pa.array(a.n[i], pa.int64()), pa.array(b.words[j], pa.string()), pa.array(b.n[j], pa.int64())], ["a", "a_n", "b", "b_n"])

        now, own, home, guests, size = None, [], None, [], 0
        for batch in batches:
            keys, visits = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for r, (key, visiting) in enumerate(zip(keys, visits, strict=True)):
                if guests and (key != now or size >= VISITORS):
                    yield from products(home, block(guests), every)
                    guests, size = [], 0
                if (key != now or visiting) and own:  # the block is whole
                    home, own = block(own), []
                    yield from products(home, home, one_side)
                if key != now and visiting:  # no word fell into this block
                    home = None
                now = key
                row = (batch.column(2)[r].as_py(), batch.column(3)[r])
                if not visiting:
                    own.append(row)
                elif home is not None:
                    guests.append(row)
                    size += len(row[1])
        if own:
            home = block(own)
            yield from products(home, home, one_side)
        if guests:
            yield from products(home, block(guests), every)

    return run


def count_words(docs: DataFrame, id_col: str, text_col: str, min_length: int, min_count: int, plant: bool) -> DataFrame:
    """``word`` and ``n`` of the words of all texts, A-Z in lower case."""
    text = F.translate(column(text_col).cast("string"), UPPER, LOWER)
    runs = docs.select(F.coalesce(column(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(RUN), 0)).alias("run"))
    runs, word = runs.filter(F.length("run") >= min_length), F.col("run")
    if plant:
        runs = runs.withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
        at = F.pmod("h", F.length("run").cast("long")).cast("int")
        shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        word = F.when(F.col("h") % EVERY == 0, shorter).otherwise(F.col("run"))
    return runs.select(word.alias("word")).filter(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def _groups(words: DataFrame, count: int) -> list[str]:
    """The letters in ``count`` groups of about equal weight; at most one row a letter comes to the driver."""
    seen = words.select(F.explode(F.split("word", "")).alias("letter")).groupBy("letter").count().collect()
    weight = {r.letter: r["count"] for r in seen}
    groups = [""] * count
    for k, letter in enumerate(sorted(LETTERS, key=lambda c: (-weight.get(c, 0), c))):
        turn = k % (2 * count)
        groups[min(turn, 2 * count - 1 - turn)] += letter
    return groups


def near_words(words: DataFrame, total: int) -> DataFrame:
    """All pairs of ``words`` (distinct, with ``n``; staged) that are one edit apart, once each: ``a``, ``a_n``, ``b``, ``b_n``."""
    count = max(1, math.ceil(math.log(max(1, total) / BLOCK_WORDS, 3)))
    groups = _groups(words, count + FINER)
    names = [f"c{k}" for k in range(count)]

    def cell(counts: list[Column]) -> Column:
        return F.concat_ws(",", *[c.cast("string") for c in counts])

    # A translation without a counterpart deletes: what is left are the letters of the group.
    sizes = [F.length(F.translate("word", "".join(g for g in groups if g is not group), "")).cast("int").alias(c) for group, c in zip(groups, names, strict=False)]
    celled = words.select("word", "n", *sizes).withColumn("cell", cell([F.col(c) for c in names]))
    held = celled.groupBy("cell").agg(F.count("*").alias("held")).withColumn("chunks", F.ceil(F.col("held") / BLOCK_WORDS).cast("int"))
    held = stage(held.withColumn("rows", F.ceil(F.col("held") / F.col("chunks") / ROW_WORDS).cast("int")), "cells")
    mark = F.xxhash64("word")
    chunked = join_hot(celled, held, ["cell"], "held").withColumn("chunk", F.pmod(mark, F.col("chunks")).cast("int")).withColumn("row", F.pmod(F.shiftright(mark, 32), F.col("rows")))
    rows = chunked.groupBy("cell", "chunk", "row").agg(F.collect_list(F.struct("word", "n")).alias("w"), *[F.first(c).alias(c) for c in names])
    blocks = stage(rows.select("cell", "chunk", *names, F.array_join("w.word", "\n").alias("words"), F.col("w.n").alias("ns")), "blocks")

    def moved(more: int | None, less: int | None) -> Column:
        return cell([F.col(c) + (int(k == more) - int(k == less)) for k, c in enumerate(names)])

    targets = [moved(k, None) for k in range(count)] + [F.when(F.col(names[a]) > 0, moved(b, a)) for a in range(count) for b in range(a + 1, count)]
    # Of the blocks of its own cell, a block visits those after it.
    to = F.array(F.struct(F.col("cell").alias("to"), (F.col("chunk") + 1).alias("since")), *[F.struct(t.alias("to"), F.lit(0).alias("since")) for t in targets])
    visits = blocks.select(F.explode(to).alias("v"), "words", "ns").select(F.col("v.to").alias("cell"), "v.since", "words", "ns").filter("cell IS NOT NULL")
    # Rows are hundreds of words here: a cell has few, and every block of it is a key of its own.
    visits = visits.join(held.select("cell", "chunks"), "cell").filter("since < chunks").withColumn("chunk", F.explode(F.sequence("since", F.col("chunks") - 1)))
    both = [df.select(F.concat_ws("/", "cell", "chunk").alias("key"), F.lit(visiting).alias("visits"), "words", "ns") for df, visiting in ((blocks, False), (visits, True))]
    meet = both[0].unionByName(both[1]).repartition("key").sortWithinPartitions("key", "visits")
    return meet.mapInArrow(_met(groups), "a string, a_n long, b string, b_n long")


def spelling_variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_length: int = 7,
    min_count: int = 2,
    times: int = 10,
    plant: bool = False,
) -> DataFrame:
    """Words of all texts with the more frequent word that each is a variant of.

    Words are runs of A-Z, a-z and the letters U+00C0 to U+00FF, with A-Z in lower case, of
    ``min_length`` letters and ``min_count`` occurrences at least. Two are near if one inserted,
    deleted or replaced letter parts them. ``form`` is the near word with most occurrences (of ties
    the smallest), if it has ``times`` as many or more; ``root`` follows forms to the last one.
    Returns ``word, form, root, n, n_near, form_n``; ``form`` and ``form_n`` are null without a form.
    ``plant`` first deletes a letter of one word in ``EVERY``, by a checksum of id and word.

    Null and empty texts have no words, a null id counts as an empty one, repeated rows count each.
    Texts and words of any length are taken whole. An empty table gives an empty result; other
    columns are ignored, whatever their names. A word has at most 90 near words a letter and place,
    so no join or group here has a key with more rows than that.
    """
    if times < 2:
        raise ValueError("a form has to be more frequent than its variant")
    words = stage(count_words(docs, id_col, text_col, min_length, min_count, plant), "words")
    total, most = words.agg(F.count("*"), F.max("n")).first()
    near = near_words(words, total)
    sides = F.explode(F.array(*[F.struct(F.col(w).alias("word"), F.col(f"{w}_n").alias("n"), F.struct((-F.col(f"{o}_n")).alias("less"), F.col(o).alias("near")).alias("best")) for w, o in (("a", "b"), ("b", "a"))]))
    both = near.select(sides.alias("s")).select("s.*")
    every = words.select("word", "n", F.lit(None).cast(both.schema["best"].dataType).alias("best")).unionByName(both)
    found = every.groupBy("word").agg(F.max("n").alias("n"), F.count("best").alias("n_near"), F.min("best").alias("best"))
    has = -F.col("best.less") >= times * F.col("n")
    forms = stage(found.select("word", "n", "n_near", F.when(has, F.col("best.near")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n")), "forms")
    # Each step multiplies n, which bounds the length of a chain; each round doubles what a jump covers.
    jumps = forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    steps = int(math.log((most or 1), times)) + 1
    for _ in range(math.ceil(math.log2(max(1, steps)))):
        nxt = jumps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        jumps = stage(jumps.join(nxt, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
    out = forms.join(jumps, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
