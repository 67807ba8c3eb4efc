"""Periodic runs of words by a dictionary of basic factors.

The dictionary names every stretch of 1, 2, 4, ... words of a text by a number: equal stretches of
one text have equal numbers, and the numbers of one length come from pairs of the length below. A
run of period q with four periods or more holds, for the power of two m with m <= q < 2m, a stretch
of m words that occurs once in each period (more than half of q distinct stretches of m words stand
in a period, so one of them stands there once). Its successive occurrences lie q apart: they form an
arithmetic progression of three or more. So equal gaps below 2m between neighbouring occurrences
propose every period; a proposal is extended to both sides by the same numbers, longest first, and
runs found by several proposals or by multiples of their period are kept once.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strideframe.llm._common import text_rows

#: Words of the texts that are searched together (a longer text alone).
BATCH_WORDS = 300_000

OUTPUTS = {
    "n_runs": "long",
    "runs": "array<struct<start: long, length: long, period: long>>",
    "best": "struct<start: long, length: long, period: long>",
    "collapsed": "string",
    "runs_sha256": "string",
    "collapsed_sha256": "string",
}
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_ARROW = {"n_runs": pa.int64(), "runs": pa.list_(_RUN), "best": _RUN, "collapsed": pa.string(), "runs_sha256": pa.string(), "collapsed_sha256": pa.string()}


def _named(codes: np.ndarray, places: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of ``codes`` at ``places``; every place whose code is nowhere else gets a number of its own, below zero.

    Also the places whose code repeats, in the order of (code, place), and whether each has the code of the one before it.
    """
    names = -1 - np.arange(total, dtype=np.int32)
    order = np.argsort(codes, kind="stable")
    codes, places = codes[order], places[order]
    same = np.zeros(len(codes), bool)
    same[1:] = codes[1:] == codes[:-1]
    repeats = same.copy()
    repeats[:-1] |= same[1:]
    number = np.cumsum(~same)
    names[places[repeats]] = number[repeats]
    return names, places[repeats], same[repeats]


def _steps(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, back: bool) -> np.ndarray:
    """How many words after places ``a`` and ``b`` (before them with ``back``) agree."""
    total, moved = len(levels[0]), np.zeros(len(a), np.int64)
    # The longest stretch can agree many times, each shorter one once after it.
    for k in range(len(levels) - 1, -1, -1):
        active = np.arange(len(a))
        while len(active):
            x, y = (a[active] - moved[active] - (1 << k), b[active] - moved[active] - (1 << k)) if back else (a[active] + moved[active], b[active] + moved[active])
            inside = (x >= 0) & (y >= 0) & (x < total) & (y < total)
            active, x, y = active[inside], x[inside], y[inside]
            active = active[levels[k][x] == levels[k][y]]
            moved[active] += 1 << k
            if k < len(levels) - 1:
                break
    return moved


def find_runs(words: np.ndarray, owner: np.ndarray, least: int = 6, times: int = 4) -> np.ndarray:
    """Maximal runs as rows (owner, start, length, period) in the order of owner, start, period.

    ``words`` are the word numbers of texts one after the other and ``owner`` the text of each. A run
    has ``least`` words and ``times`` (three or more) of its smallest period at least.
    """
    total = len(words)
    if total < least:
        return np.zeros((0, 4), np.int64)
    sizes = np.bincount(owner)
    ends = np.cumsum(sizes)
    end_of = ends[owner]
    base = int(words.max()) + 1
    names, places, same = _named(owner.astype(np.int64) * base + words, np.arange(total), total)
    levels, found = [names], []
    while len(places):
        m = 1 << (len(levels) - 1)
        gap = np.where(same, places - np.roll(places, 1), 0)
        gap = np.where((gap >= m) & (gap < 2 * m), gap, 0)
        # The middle one of three occurrences with equal gaps names a period.
        middle = np.flatnonzero((gap[1:-1] > 0) & (gap[1:-1] == gap[2:])) + 1 if len(gap) > 2 else np.zeros(0, np.int64)
        found.append(np.stack([places[middle] - gap[middle], gap[middle]], 1))
        # A stretch twice as long repeats only where both its halves do.
        at = np.sort(places)
        at = at[at + 2 * m <= end_of[at]]
        second = names[at + m]
        at, second = at[second >= 0], second[second >= 0]
        names, places, same = _named(names[at].astype(np.int64) * (total + 1) + second, at, total)
        levels.append(names)
    proposals = np.concatenate([np.zeros((0, 2), np.int64), *found])
    # Neighbouring proposals of one period mostly lie in one run: the first of each row of them stands for all.
    proposals = proposals[np.lexsort((proposals[:, 0], proposals[:, 1]))]
    if len(proposals):
        follows = (np.diff(proposals[:, 0]) == 1) & (np.diff(proposals[:, 1]) == 0)
        proposals = proposals[np.concatenate([[True], ~follows])]
    a, q = proposals[:, 0], proposals[:, 1]
    before, after = _steps(levels, a, a + q, True), _steps(levels, a, a + q, False)
    start, length = a - before, before + after + q
    long = (length >= least) & (length >= times * q)
    start, length, q = start[long], length[long], q[long]
    # Of the periods of one stretch the smallest counts; others are its multiples.
    order = np.lexsort((q, length, start))
    start, length, q = start[order], length[order], q[order]
    first = np.ones(len(start), bool)
    first[1:] = (np.diff(start) != 0) | (np.diff(length) != 0)
    start, length, q = start[first], length[first], q[first]
    order = np.lexsort((q, start))
    start, length, q = start[order], length[order], q[order]
    text = owner[start]
    return np.stack([text, start - (ends - sizes)[text], length, q], 1)


def _best(runs: np.ndarray) -> tuple[int, int, int] | None:
    """The run of greatest length / period, then of smallest start, then period."""
    best = None
    for s, n, q in runs.tolist():
        if best is None or n * best[2] > best[1] * q:
            best = (s, n, q)
    return best


def _kept(size: int, runs: np.ndarray) -> np.ndarray:
    """Which words stay if only the first period of each run does."""
    marks = np.zeros(size + 1, np.int64)
    np.add.at(marks, runs[:, 0] + runs[:, 2], 1)
    np.add.at(marks, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(marks[:-1]) == 0


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with the tail that the id's checksum makes periodic, in one text of ten; unchanged for a null id."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    cycle = words[a : a + p]
    return words[:a] + (cycle * -(-(n - a) // p))[: n - a]


def periodic_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: int = 6,
    times: int = 4,
    plant: bool = False,
    outputs: tuple[str, ...] = ("runs", "best", "collapsed"),
) -> DataFrame:
    """Runs of repeated words in each whole text: ``id_col`` and the chosen ``outputs``.

    Words are parted by ASCII white space. A run is a stretch of ``least`` words and ``times``
    (three or more) of its smallest period at least that no neighbouring word extends. ``runs`` are in
    the order of start and period, ``best`` has the greatest length by period, ``collapsed`` are the
    words without those that any run holds after its first period, joined by one space.
    ``n_runs``, ``runs_sha256`` (of lines ``start,length,period``) and ``collapsed_sha256`` tell of these.
    ``plant`` first makes the tail of one text in ten periodic, by the id's checksum.

    Null and empty texts have no words and no run, ``best`` is null and ``collapsed`` empty. Null
    ids (nothing is planted there) and repeated rows pass through, one row for each row. An empty
    table gives an empty result; other columns are ignored, whatever their names. Texts are
    searched whole, some at a time; memory of a task grows with its longest text alone.
    """
    if times < 3:
        raise ValueError("periods are proposed by three occurrences: times has to be 3 or more")

    def made(name: str, words: list[bytes], runs: np.ndarray):
        if name == "n_runs":
            return len(runs)
        if name == "runs":
            return [{"start": s, "length": n, "period": q} for s, n, q in runs.tolist()]
        if name == "best":
            best = _best(runs)
            return dict(zip(("start", "length", "period"), best, strict=True)) if best else None
        if name == "runs_sha256":
            return hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs.tolist()).encode()).hexdigest()
        if len(runs):
            words = [words[i] for i in np.flatnonzero(_kept(len(words), runs)).tolist()]
        whole = b" ".join(words)
        return whole.decode() if name == "collapsed" else hashlib.sha256(whole).hexdigest()

    def searched(ids: list[pa.Array], texts: list[list[bytes]]) -> pa.RecordBatch:
        codes = []
        for words in texts:
            number: dict[bytes, int] = {}
            codes.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)))
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        runs = find_runs(np.concatenate(codes), np.repeat(np.arange(len(texts)), sizes), least, times)
        cuts = np.searchsorted(runs[:, 0], np.arange(len(texts) + 1))
        rows = [[made(name, words, runs[a:b, 1:]) for name in outputs] for words, a, b in zip(texts, cuts, cuts[1:], strict=False)]
        columns = [pa.array([r[i] for r in rows], _ARROW[name]) for i, name in enumerate(outputs)]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *columns], ["id", *outputs])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, size, at = [], 0, 0
            for to, (i, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True), 1):
                words = (text.as_py() or "").encode().split()  # ASCII white space alone, as these are bytes
                texts.append(planted(words, i) if plant else words)
                size += len(words)
                if size >= BATCH_WORDS or to == batch.num_rows:
                    yield searched([batch.column(0).slice(at, to - at)], texts)
                    texts, size, at = [], 0, to

    schema = "id long, " + ", ".join(f"{name} {OUTPUTS[name]}" for name in outputs)
    return text_rows(docs, text_col, id=id_col).mapInArrow(search, schema).withColumnRenamed("id", id_col)
