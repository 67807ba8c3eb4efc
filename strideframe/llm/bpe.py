"""Byte-level BPE of a corpus by merge replay over an inverted index from token pairs to word positions.

One pass cuts the texts into words (matches of the pattern) and writes each text as numbers of the
words of its batch of texts. A batch's distinct words go, packed, to parts by a hash of the word, so
that equal words of all batches meet and every word of the corpus is encoded once. A task lays out
the words of its part as arrays of tokens with links to the left and right neighbour. An index maps
the rank of every mergeable pair to the places where it stands, in whatever words. Ranks are taken
in order from a heap; a merge is applied at all its places, and only the two touched neighbours get
new index entries. The ids go back, packed, to the batches that have the words, and a batch's texts
become ids.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm._common import column, shared_root, text_rows

#: Characters of text of a batch, and bytes of words that are laid out at a time (a longer word alone).
BATCH_CHARS = 8_000_000
REPLAY_BYTES = 1 << 19
#: Bytes of text for each part of the words, the most parts, and words that a task remembers at a time.
PART_BYTES = 8_000_000
MOST_PARTS = 4096
KNOWN_WORDS = 1_000_000
#: Batches that a task turns into ids, about.
BATCHES_A_TASK = 2
#: Neither a letter nor a number nor white space: stands for characters that only the regex module knows.
OTHER = "\ue000"
#: Stands between packed words; no byte of UTF-8.
BETWEEN = b"\xff"

OUTPUTS = {"ids": "array<int>", "decoded": "binary", "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
_ARROW = {"ids": pa.list_(pa.int32()), "decoded": pa.binary(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}

_coders: dict[tuple[str, str], MergeReplay] = {}


@functools.cache
def _newer_characters() -> tuple[re.Pattern, re.Pattern]:
    r"""The characters that are letters or numbers (``\p{L}``, ``\p{N}``) to the regex module but not to tiktoken, whose Unicode tables are older.

    Those of two bytes (a bit map, looked up at once) and those beyond (ranges).
    """
    import regex
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    extra: set[int] = set()
    for kind in (r"\p{L}", r"\p{N}"):
        lists = tiktoken.Encoding("class", pat_str=kind, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        own, theirs = set(regex.findall(kind, every)), set(lists.decode(lists.encode_ordinary(every)))
        if theirs - own:
            raise ValueError("the regex module is older than tiktoken: a character can't be made a letter")
        extra |= set(map(ord, own - theirs))

    def listed(codes: list[int]) -> re.Pattern:
        starts = [c for c in codes if c - 1 not in extra]
        ends = [c for c in codes if c + 1 not in extra]
        return re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends, strict=True)) + "]") if codes else re.compile("(?!)")

    return listed(sorted(c for c in extra if c < 0x10000)), listed(sorted(c for c in extra if c >= 0x10000))


class MergeReplay:
    """Encoder and decoder of one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.ranks = ranks
        self.words = {r: b for b, r in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.newer = _newer_characters()
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.pairs: dict[int, int] = {}  # pair of ids -> rank of the merge, -1 for none
        most = max(self.words) + 1
        self.bytes_of, self.shown = np.empty(most, object), np.empty(most, object)
        for i, b in self.words.items():
            self.bytes_of[i], self.shown[i] = b, str(i)

    @classmethod
    def load(cls, path: str, pattern: str) -> MergeReplay:
        if (path, pattern) not in _coders:
            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            _coders[path, pattern] = cls(ranks, pattern)
        return _coders[path, pattern]

    def find(self, text: str) -> list[str]:
        """The matches of the pattern, with tiktoken's classes of characters."""
        near, far = self.newer
        if text.isascii() or not (near.search(text) or (max(text) > "\uffff" and far.search(text))):
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(near.sub(OTHER, far.sub(OTHER, text)))]

    def rank(self, a: int, b: int) -> int:
        code = a << 32 | b
        found = self.pairs.get(code)
        if found is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            found = self.pairs[code] = self.ranks.get(self.words[a] + self.words[b], -1)
        return found

    def replay(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word, all words at once."""
        if not words:
            return []
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        first = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        n = len(first)
        right = np.arange(1, n + 1)
        left = np.arange(-1, n - 1)
        right[ends[lengths > 0] - 1] = -1
        left[(ends - lengths)[lengths > 0]] = -1
        index: dict[int, list[int]] = {}
        if n > 1:
            places = np.flatnonzero(right[:-1] >= 0)
            codes, which = np.unique(first[places] << 32 | first[places + 1], return_inverse=True)
            rank_of = np.array([self.rank(c >> 32, c & 0xFFFFFFFF) for c in codes.tolist()], np.int64)
            ranks = rank_of[which]
            places, ranks = places[ranks >= 0], ranks[ranks >= 0]
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            if len(ranks):
                index = {int(ranks[a]): p.tolist() for a, p in zip([0, *cuts.tolist()], np.split(places, cuts), strict=True)}
        heap = list(index)
        heapq.heapify(heap)
        token, right, left, rank = first.tolist(), right.tolist(), left.tolist(), self.rank
        while heap:
            now = heapq.heappop(heap)
            at = sorted(index.pop(now))
            for done, p in enumerate(at, 1):
                q = right[p]
                if token[p] < 0 or q < 0 or rank(token[p], token[q]) != now:
                    continue
                token[p], token[q] = now, -1
                after, before, sooner = right[q], left[p], False
                right[p] = after
                touched = []
                if after >= 0:
                    left[after] = p
                    touched.append((rank(now, token[after]), p))
                if before >= 0:
                    touched.append((rank(token[before], now), before))
                for r, place in touched:
                    if r >= 0:
                        if r in index:
                            index[r].append(place)
                        else:
                            index[r] = [place]
                            heapq.heappush(heap, r)
                        sooner |= r < now
                if sooner and done < len(at):  # a merge of lower rank came up: it goes first
                    if now not in index:
                        heapq.heappush(heap, now)
                    index.setdefault(now, []).extend(at[done:])
                    break
        token = np.array(token, np.int64)
        kept = np.flatnonzero(token >= 0)
        ids, upto = token[kept].astype(np.uint32), np.searchsorted(kept, ends).tolist()
        return [ids[a:b] for a, b in zip([0, *upto], upto, strict=False)]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(self.bytes_of[ids].tolist())

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        split = [self.find(x) for x in texts]
        every = list(set().union(*split))
        known = dict(zip(every, self.replay([w.encode("utf-8", "surrogatepass") for w in every]), strict=True))
        for words in split:
            yield np.concatenate([known[w] for w in words]) if words else np.zeros(0, np.uint32)


def _pack(numbers: np.ndarray) -> bytes:
    """32-bit numbers, all their lowest bytes first, then all second ones and so on: those of small numbers are zeros."""
    return zlib.compress(np.ascontiguousarray(numbers, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _replayed(packs: DataFrame, parts: int, ranks_path: str, pattern: str) -> DataFrame:
    """``of_batch``, ``part``, ``lengths`` and ``ids`` (32 bits each, packed) of the words of each pack (``batch``, ``part``, ``words``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = MergeReplay.load(ranks_path, pattern)
        known: dict[bytes, bytes] = {}

        def learn(words: list[bytes]) -> None:
            at, size = 0, 0
            for to, word in enumerate([*words, None]):
                if word is None or (to > at and size + len(word) > REPLAY_BYTES):
                    some = words[at:to]
                    known.update(zip(some, [x.tobytes() for x in coder.replay(some)], strict=True))
                    at, size = to, 0
                size += len(word or b"")

        for batch in batches:
            for first in range(0, batch.num_rows, 64):  # packs whose new words are replayed together
                some = batch.slice(first, 64)
                split = [zlib.decompress(x).split(BETWEEN) for x in some.column(2).to_pylist()]
                every = set().union(*split)
                if len(known) + len(every) > KNOWN_WORDS:
                    known.clear()
                learn(list(every - known.keys()))
                found = [list(map(known.__getitem__, x)) for x in split]
                lengths = [_pack(np.fromiter(map(len, x), "<u4", len(x)) // 4) for x in found]
                ids = [_pack(np.frombuffer(b"".join(x), "<u4")) for x in found]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(lengths, pa.binary()), pa.array(ids, pa.binary())], ["of_batch", "part", "lengths", "ids"])

    return packs.repartitionById(parts, "part").mapInArrow(run, "of_batch long, part int, lengths binary, ids binary")


def encode_documents(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    outputs: tuple[str, ...] = ("ids", "decoded"),
) -> DataFrame:
    """Encode whole texts and decode the ids again: ``id_col`` and the chosen ``outputs``.

    ``outputs`` may name ``ids``, ``decoded`` (the bytes of the ids), ``n_tokens``, ``ids_sha256``
    (of the decimal ids joined by commas) and ``decoded_sha256``.

    Null and empty texts have no ids and decode to no bytes. Null ids, repeated rows and ties pass
    through, one row for each row. Texts of any length are encoded whole. An empty table gives an
    empty result. Other columns are ignored, whatever their names.
    """

    def made(coder: MergeReplay, name: str, ids: np.ndarray):
        if name == "n_tokens":
            return len(ids)
        if name == "ids_sha256":
            return hashlib.sha256(",".join(coder.shown[ids].tolist()).encode()).hexdigest()
        if name == "ids":
            return ids.astype(np.int32)
        whole = coder.decode(ids)
        return whole if name == "decoded" else hashlib.sha256(whole).hexdigest()

    size = docs.agg(F.sum(F.octet_length(column(text_col).cast("string")).cast("long"))).first()[0] or 0
    parts = int(min(MOST_PARTS, max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // PART_BYTES))))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, number = MergeReplay.load(ranks_path, pattern).find, TaskContext.get().partitionId() << 32
        names = ["id", "batch", "codes", "part", "words"]
        types = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]

        def rows(n: int, columns: dict) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns.get(c, [None] * n), t) for c, t in zip(names, types, strict=True)], names)

        def written(ids: list[pa.Array], texts: list[str]) -> Iterator[pa.RecordBatch]:
            nonlocal number
            split = [find(x) for x in texts]
            # The most frequent words have the smallest numbers.
            words = [w for w, _ in Counter(chain.from_iterable(split)).most_common()]
            code = dict(zip(words, range(len(words)), strict=True))
            coded = [w.encode("utf-8", "surrogatepass") for w in words]
            part = np.fromiter(map(zlib.crc32, coded), np.int64, len(coded)) % parts
            n = len(texts)
            yield rows(n, {"id": pa.concat_arrays(ids), "batch": [number] * n, "codes": [_pack(np.fromiter(map(code.__getitem__, x), "<u4", len(x))) for x in split]})
            # The parts of all words, from which the batch tells whose ids come back.
            yield rows(1, {"batch": [number], "part": [-1], "codes": [_pack(part)]})
            order = np.argsort(part, kind="stable")
            held, starts = np.unique(part[order], return_index=True)
            ends = np.append(starts[1:], len(order))[: len(starts)].tolist()
            packs = [zlib.compress(BETWEEN.join([coded[i] for i in order[a:b].tolist()]), 1) for a, b in zip(starts.tolist(), ends, strict=True)]
            yield rows(len(held), {"batch": [number] * len(held), "part": held.astype(np.int32).tolist(), "words": packs})
            number += 1

        ids: list[pa.Array] = []
        texts: list[str] = []
        chars = 0
        for batch in batches:
            at = 0
            for to, text in enumerate(batch.column(1).to_pylist(), 1):
                texts.append(text or "")
                chars += len(texts[-1])
                if chars >= BATCH_CHARS:
                    yield from written([*ids, batch.column(0).slice(at, to - at)], texts)
                    ids, texts, chars, at = [], [], 0, to
            ids.append(batch.column(0).slice(at))
        if texts:
            yield from written(ids, texts)

    def filled(texts: pa.Table, words: pa.Table) -> pa.Table:
        coder = MergeReplay.load(ranks_path, pattern)
        heads = pc.is_valid(texts.column("part"))
        part = _unpack(texts.filter(heads).column("codes")[0].as_py())
        packs = sorted(zip(*[words.column(c).to_pylist() for c in ("part", "lengths", "ids")], strict=True))
        none = [np.zeros(0, "<u4")]
        # Packs hold the words of their part by number.
        order = np.argsort(part, kind="stable")
        packed = np.concatenate([*none, *[_unpack(x) for _, x, _ in packs]]).astype(np.int64)
        lengths, first = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
        lengths[order], first[order] = packed, np.cumsum(packed) - packed
        ids = np.concatenate([*none, *[_unpack(x) for _, _, x in packs]])
        texts = texts.filter(pc.invert(heads))
        made_rows = []
        for raw in texts.column("codes").to_pylist():
            codes = _unpack(raw)
            own = lengths[codes]
            # The places of each word's ids, one word after the other.
            places = np.arange(own.sum()) + np.repeat(first[codes] - (np.cumsum(own) - own), own)
            made_rows.append([made(coder, name, ids[places]) for name in outputs])
        columns = [pa.array([r[i] for r in made_rows], _ARROW[name]) for i, name in enumerate(outputs)]
        return pa.Table.from_arrays([texts.column("id"), *columns], ["id", *outputs])

    spark = docs.sparkSession
    tasks = int(max(spark.sparkContext.defaultParallelism, -(-size // (BATCH_CHARS * BATCHES_A_TASK))))
    # Buckets by batch: the texts, by far the most of it, are read where they were written and never exchanged.
    rows_of = text_rows(docs, text_col, id=id_col).mapInArrow(cut, "id long, batch long, codes binary, part int, words binary")
    name = f"merge_replay_{uuid.uuid4().hex}"
    rows_of.write.bucketBy(tasks, "batch").option("path", f"{shared_root(spark)}/staged/{name}").saveAsTable(name)
    both = spark.table(name)
    placed = _replayed(both.filter("words IS NOT NULL").select("batch", "part", "words"), parts, ranks_path, pattern)
    texts = both.filter("codes IS NOT NULL").select("id", "batch", "codes", "part")
    schema = "id long, " + ", ".join(f"{name} {OUTPUTS[name]}" for name in outputs)
    dealt = texts.groupBy("batch").cogroup(placed.repartition(tasks, "of_batch").groupBy("of_batch"))
    return dealt.applyInArrow(filled, schema).withColumnRenamed("id", id_col)
