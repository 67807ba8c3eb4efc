"""Bounded-space online packing of tokenized documents into fixed windows.

Every partition reads its documents once and keeps at most ``open_windows`` windows open. What is
left of a document after its whole windows goes to the open window with the smallest sufficient
room. Where none has room, the fullest is topped up with a cut of the document and emitted, and a
new one opens. The windows still open when a partition ends are merged with those of neighbouring
partitions in bounded groups.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm._common import stage, text_rows

#: Distinct chunks of text whose ids a task remembers between groups of texts.
CACHE_CHUNKS = 250_000
#: Longer chunks are encoded each time.
CACHE_CHARS = 48
#: Bytes of texts that are encoded at a time (a longer text alone): they share the lookup of their distinct chunks.
GROUP_BYTES = 1 << 19
#: Letters that normalization turns into one letter: a token never crosses the place between one of them and a mark or blank.
LETTERS = "a-zA-ZÀ-ÖØ-öø-ÿ"
WORD = re.compile(f"[{LETTERS}]+").fullmatch
#: Which bytes are an ASCII letter or digit.
_PLAIN = np.array([chr(i).isalnum() and i < 128 for i in range(256)])
#: The characters that stand for bytes in a byte-level vocabulary.
_SHOWN = dict(zip([i for i in range(256) if not (33 <= i <= 126 or 161 <= i <= 172 or i >= 174)], map(chr, range(256, 324)), strict=True))
#: Partitions whose leftover windows meet in one task.
MERGE_PARTITIONS = 8
ID_BYTES = 4

_tokenizers: dict[str, object] = {}
_specials: dict[str, re.Pattern] = {}
_chunks: dict[str, dict[str, bytes]] = {}


def _tokenizer(path: str):
    if path not in _tokenizers:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(path)
        _tokenizers[path] = found
        # A special token in a text is matched as it stands, before anything else; a text with one is not cut into chunks.
        _specials[path] = re.compile("|".join(re.escape(t.content) for t in found.get_added_tokens_decoder().values()) or r"(?!)")
    return _tokenizers[path]


def _chunks_of(texts: list[bytes]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The chunks of all texts in order, and after how many of them each text ends.

    A chunk is what stands between blanks and line ends, but a full stop or comma at its end, after a
    letter of ``LETTERS`` or a digit, is a chunk of its own. ASCII chunks get small letters, as the
    vocabulary has no others, so that copies meet; not those that could become a special token's name.
    """
    data = np.frombuffer(b"".join(x + b" " for x in texts), np.uint8)
    blank = (data == ord(" ")) | (data == ord("\n"))
    first = ~blank
    first[1:] &= blank[:-1]
    marks = 1 + np.flatnonzero(((data[1:-1] == ord(".")) | (data[1:-1] == ord(","))) & blank[2:])
    before, lead = data[marks - 1], data[np.maximum(marks - 2, 0)]
    # In UTF-8 À to ÿ are the byte C3 and one more; × and ÷ among them are no letters.
    first[marks[_PLAIN[before] | ((lead == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7))]] = True
    kept = data[~blank]
    offsets = np.append(np.flatnonzero(first[~blank]), len(kept)).astype(np.int32)
    if len(kept):
        other = np.repeat(np.logical_or.reduceat((kept >= 0x80) | (kept == ord("<")), offsets[:-1]), np.diff(offsets))
        kept |= np.where((kept >= ord("A")) & (kept <= ord("Z")) & ~other, np.uint8(0x20), np.uint8(0))
    chunks = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(kept))
    ends = np.cumsum([len(x) + 1 for x in texts])
    return chunks.dictionary_encode(), np.searchsorted(np.flatnonzero(first), ends)


def encode_texts(texts: list[str | None], path: str) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit words.

    The vocabulary drops white space and no token crosses it, nor the place between a letter or
    digit and a mark, so a text's ids are those of its chunks; distinct chunks of the texts are
    looked up once, and the ids are laid out by their places.
    """
    if not texts:
        return []
    known = _chunks.setdefault(path, {})
    coder = _tokenizer(path)
    special = _specials[path].search
    whole = {i: array("I", coder.encode(x, add_special_tokens=False).ids).tobytes() for i, x in enumerate(texts) if x and "<" in x and special(x)}
    chunks, ends = _chunks_of([b"" if not x or i in whole else x.encode() for i, x in enumerate(texts)])
    every = chunks.dictionary.to_numpy(zero_copy_only=False).tolist()
    new = [c for c in every if c not in known]
    if len(known) + len(new) > CACHE_CHUNKS:
        recent = {c: known[c] for c in every if c in known}  # frequent ones are among these
        known.clear()
        known.update(recent)
    model = coder.model
    for word in filter(WORD, new):  # one word, whose normal form is small letters: only the merges are left to do
        shown = word if word.isascii() else word.lower().encode().decode("latin-1").translate(_SHOWN)
        known[word] = array("I", [t.id for t in model.tokenize(shown)]).tobytes()
    rest = [c for c in new if c not in known]
    for at in range(0, len(rest), 4096):
        part = rest[at : at + 4096]
        for chunk, got in zip(part, coder.encode_batch_fast(part, add_special_tokens=False), strict=True):
            known[chunk] = array("I", got.ids).tobytes()
    values = list(map(known.__getitem__, every))
    for chunk in new:
        if len(chunk) > CACHE_CHARS:
            known.pop(chunk, None)
    sizes = np.fromiter(map(len, values), np.int64, len(values)) // ID_BYTES
    places = chunks.indices.to_numpy()
    lengths = sizes[places]
    upto = np.concatenate([[0], np.cumsum(lengths)])
    ids = np.frombuffer(b"".join(values), "<u4")[np.repeat((np.cumsum(sizes) - sizes)[places] - upto[:-1], lengths) + np.arange(upto[-1])]
    bounds = [0, *upto[ends].tolist()]
    return [whole[i] if i in whole else ids[bounds[i] : bounds[i + 1]].tobytes() for i in range(len(texts))]


def forget_chunks() -> None:
    """At the end of a task: its worker lives on, idle or in other operators' tasks, next to those that pack."""
    _chunks.clear()


def _groups(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Where groups of texts of ``GROUP_BYTES`` or fewer, or of one longer text, begin and end."""
    begin = size = 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        if i > begin and size + (n or 0) > GROUP_BYTES:
            yield begin, i
            begin = i
            size = 0
        size += n or 0
    if begin < len(texts):
        yield begin, len(texts)


class OpenWindows:
    """The open windows of one partition; ``closed`` gets (sequence, used, pieces) as they fill."""

    def __init__(self, size: int, most: int, least_cut: int) -> None:
        self.size, self.most, self.least_cut = size, most, least_cut
        self.open: list[list] = []  # [sequence, used, pieces]
        self.next = 0
        self.closed: list[list] = []

    def _start(self) -> list:
        self.next += 1
        return [self.next - 1, 0, []]

    def _put(self, window: list, piece: tuple, length: int) -> None:
        window[2].append((*piece, length, window[1]))
        window[1] += length

    def add(self, ident, ids: bytes, total: int) -> None:
        at = 0

        def put(window: list, length: int) -> None:
            nonlocal at
            self._put(window, (ident, at, ids[ID_BYTES * at : ID_BYTES * (at + length)], total), length)
            at += length

        while total - at >= self.size:
            put(window := self._start(), self.size)
            self.closed.append(window)
        if at == total:
            return
        rest = total - at
        fitting = [w for w in self.open if self.size - w[1] >= rest]
        if fitting:
            window = max(fitting, key=lambda w: w[1])
            put(window, rest)
            if window[1] == self.size:
                self.open.remove(window)
                self.closed.append(window)
            return
        if len(self.open) >= self.most:
            fullest = max(self.open, key=lambda w: w[1])
            if self.size - fullest[1] >= self.least_cut:
                put(fullest, self.size - fullest[1])
            self.open.remove(fullest)
            self.closed.append(fullest)
        window = self._start()
        put(window, total - at)
        self.open.append(window)


_FIELDS = [
    ("id", pa.int64()),
    ("start", pa.int64()),
    ("length", pa.int64()),
    ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()),
    ("part", pa.int64()),
    ("sequence", pa.int64()),
    ("offset", pa.int64()),
    ("left", pa.bool_()),
    ("ids", pa.list_(pa.int32())),
]
_SCHEMA = "id long, start long, length long, ids_crc32 long, doc_tokens long, part long, sequence long, offset long, left boolean, ids array<int>"


def _columns(rows: list[tuple]) -> list[pa.Array]:
    """The columns of ``_FIELDS``, from rows of them."""
    cols = zip(*rows, strict=True) if rows else [()] * len(_FIELDS)
    return [pa.array(c, t) for c, (_, t) in zip(cols, _FIELDS, strict=True)]


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 2048,
    end_id: int = 1,
    open_windows: int = 32,
    least_cut: int = 8,
    with_ids: bool = True,
) -> DataFrame:
    """Pieces of documents and their places in sequences of at most ``window`` tokens.

    A document is its ids and then ``end_id``; each id lies in exactly one piece. Returns
    ``id_col``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``,
    and ``ids`` (array of int) unless ``with_ids`` is false. Offsets are gapless from 0.

    Ids are those of the tokenizer's ``encode`` without added special tokens; the name of a special
    token within a text becomes that token, as there. Null and empty texts are just ``end_id``. Null ids and repeated rows are packed as they come,
    each row on its own. A text of any length is encoded whole and cut into as many windows as it
    fills. An empty table gives no pieces. Other columns are ignored, whatever their names.
    """
    closing = int(end_id).to_bytes(ID_BYTES, "little")

    def rows(windows: list[list], part: int, left: bool) -> pa.RecordBatch:
        flat = [(i, s, n, zlib.crc32(ids), total, part, seq, off, left, np.frombuffer(ids, "<i4") if left or with_ids else None) for seq, _, pieces in windows for i, s, ids, total, n, off in pieces]
        return pa.RecordBatch.from_arrays(_columns(flat), schema=pa.schema(_FIELDS))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        windows = OpenWindows(window, open_windows, least_cut)
        for batch in batches:
            for begin, end in _groups(batch.column(1)):
                some = batch.slice(begin, end - begin)
                for ident, ids in zip(some.column(0).to_pylist(), encode_texts(some.column(1).to_pylist(), tokenizer_path), strict=True):
                    windows.add(ident, ids + closing, len(ids) // ID_BYTES + 1)
                if windows.closed:
                    yield rows(windows.closed, part, False)
                    windows.closed.clear()
        yield rows(windows.open, part, True)
        forget_chunks()

    def merge(key: tuple[pa.Scalar], table: pa.Table) -> pa.Table:
        # Bounded: MERGE_PARTITIONS x open_windows windows, each of at most `window` tokens.
        table = table.sort_by([(c, "ascending") for c in ("part", "sequence", "offset")]).combine_chunks()
        lists = pa.concat_arrays(table["ids"].chunks)
        every, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
        merged = -1 - key[0].as_py()
        seq, used, out = 0, 0, []
        for at, (ident, start, rest, total) in enumerate(zip(*[table[c].to_pylist() for c in ("id", "start", "length", "doc_tokens")], strict=True)):
            ids = every[ends[at] : ends[at + 1]]
            while rest:
                take = min(rest, window - used)
                part = ids[:take]
                out.append((ident, start, take, zlib.crc32(part.tobytes()), total, merged, seq, used, True, part if with_ids else None))
                start, ids, rest, used = start + take, ids[take:], rest - take, used + take
                if used == window:
                    seq, used = seq + 1, 0
        return pa.table(_columns(out), schema=pa.schema(_FIELDS))

    rows_in = text_rows(docs, text_col, id=id_col)
    placed = stage(rows_in.mapInArrow(place, _SCHEMA), "pieces")
    group = F.floor(F.col("part") / MERGE_PARTITIONS).cast("long")
    merged = placed.filter("left").groupBy(group.alias("merged_in")).applyInArrow(merge, _SCHEMA)
    both = placed.filter("NOT left").unionByName(merged)
    # Merged windows have negative parts; the sign keeps their numbers apart from the others.
    both = both.withColumn("sequence_id", F.col("part") * F.lit(1 << 32) + F.col("sequence"))
    columns = [F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    if with_ids:
        columns.append("ids")
    return both.select(*columns)
