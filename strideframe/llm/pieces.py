"""SentencePiece encoding and decoding with merge-type vocabularies by a score-ordered agenda.

A text is normalized and cut before each row of word starts: no piece of the vocabulary holds a
word start after another character (looked up when the model is loaded; a model that has such a
piece gets whole texts), so no merge crosses a cut. The agenda of a unit are its adjacent
symbol pairs that form a piece, best score first, then leftmost. The top pair is joined and its two
new neighbours enter; pairs that one of their symbols has left are passed over. Short units, nearly
all, have their agendas side by side in arrays, and each takes its top pair in the same round; long
ones have a heap each. Symbols that are no piece become bytes. Every unit is encoded once while a worker remembers it, and all new units of
some texts are held against the sentencepiece library together.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strideframe.llm._common import text_rows

#: Units that a worker remembers at a time, and characters of texts that are encoded together.
KNOWN_UNITS = 1_200_000
BATCH_CHARS = 2_000_000
#: Characters of a unit that is merged beside others (a longer one has a heap), and the rank of a pair that forms no piece.
SHORT, NO_PIECE = 40, 1 << 60
#: Stands for a blank within pieces.
BLANK = "▁"
#: Fixed values of the model's format: the merge type, and the kinds of pieces.
MERGE_TYPE, NORMAL, UNKNOWN, CONTROL, BYTE = 2, 1, 2, 3, 6

OUTPUTS = {"ids": "array<int>", "decoded": "string", "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
_ARROW = {"ids": pa.list_(pa.int32()), "decoded": pa.string(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}

_coders: dict[str, PieceAgenda] = {}


class PieceAgenda:
    """Encoder and decoder of one merge-type model with byte fallback."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = proto.ModelProto()
        model.ParseFromString(self.library.serialized_model_proto())
        kinds = {p.type for p in model.pieces}
        if model.trainer_spec.model_type != MERGE_TYPE or not model.trainer_spec.byte_fallback or kinds - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only merge-type models with byte fallback and without user-defined or unused pieces")
        normal = [(i, p.piece, p.score) for i, p in enumerate(model.pieces) if p.type == NORMAL]
        order = {score: at for at, score in enumerate(sorted({s for _, _, s in normal}, reverse=True))}
        self.ids = {piece: i for i, piece, _ in normal}
        self.ranks = {piece: order[score] for _, piece, score in normal}
        most = len(model.pieces)
        self.span = most + 0x110000
        self.char = most + np.arange(0x110000, dtype=np.int64)  # a character that is no piece has a symbol of its own
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.char[ord(piece)] = i
        symbol = lambda x: int(self.char[ord(x)]) if len(x) == 1 else self.ids.get(x, -1)
        cuts = [(symbol(p[:k]), symbol(p[k:]), self.ranks[p], i) for p, i in self.ids.items() for k in range(1, len(p))]
        pairs = sorted((a * self.span + b, r, i) for a, b, r, i in cuts if a >= 0 and b >= 0)
        self.pair_keys, self.pair_ranks, self.pair_pieces = np.array(pairs, np.int64).reshape(-1, 3).T.copy()
        self.byte_ids = [i for i, p in enumerate(model.pieces) if p.type == BYTE]
        self.prefix = model.normalizer_spec.add_dummy_prefix
        self.units = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+" if not any(re.search(f"[^{BLANK}]{BLANK}", p) for _, p, _ in normal) else r"(?s).+").findall
        self.around = tuple(np.array([i], "<u4").tobytes() if i >= 0 else b"" for i in (self.library.bos_id(), self.library.eos_id()))
        self.surface = np.empty(len(model.pieces), object)
        for i, p in enumerate(model.pieces):
            self.surface[i] = p.piece.replace(BLANK, " ").encode() if p.type == NORMAL else b""
        for value, i in enumerate(self.byte_ids):
            self.surface[i] = bytes([value])
        self.surface[self.library.unk_id()] = model.trainer_spec.unk_surface.encode()
        self.control = np.array([p.type == CONTROL for p in model.pieces])
        self.normal = np.array([p.type == NORMAL for p in model.pieces])
        self.known: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str) -> PieceAgenda:
        if path not in _coders:
            _coders[path] = cls(path)
        return _coders[path]

    def merge(self, units: list[str]) -> list[list[int]]:
        """The ids of each unit."""
        out: list[list[int]] = [[]] * len(units)
        short = [i for i, u in enumerate(units) if len(u) <= SHORT]
        symbols, sizes = self._short([units[i] for i in short])
        ends = np.cumsum(sizes).tolist()
        flat = symbols.tolist()
        for i, a, b in zip(short, [0, *ends], ends, strict=False):
            out[i] = flat[a:b]
        for i, unit in enumerate(units):
            if len(unit) > SHORT:
                out[i] = [self.char[ord(x)] if len(x) == 1 else self.ids[x] for x in self._long(unit)]
        # Symbols that are no piece become bytes.
        most = len(self.surface)
        for i in {*np.searchsorted(ends, np.flatnonzero(symbols >= most), "right").tolist()}:
            out[short[i]] = self._bytes(out[short[i]])
        return [self._bytes(x) if len(u) > SHORT else x for u, x in zip(units, out, strict=True)]

    def _bytes(self, symbols: list[int]) -> list[int]:
        most = len(self.surface)
        return [int(y) for x in symbols for y in ([x] if x < most else [self.byte_ids[b] for b in chr(x - most).encode()])]

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of the pairs of symbols; ``NO_PIECE`` where they form none."""
        keys = left * self.span + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NO_PIECE), self.pair_pieces[at]

    def _short(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All units side by side: in each round every unit takes the first of its agenda."""
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        symbols = self.char[np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)]
        final, owner = [], np.repeat(np.arange(len(units)), sizes)
        # The agenda: rank and piece of each symbol with its right neighbour, none at the end of a unit.
        rank, piece = np.full(len(symbols), NO_PIECE), np.zeros(len(symbols), np.int64)

        def renew(at: np.ndarray) -> None:
            inner = at[(at >= 0) & (at + 1 < len(symbols))]
            inner = inner[owner[inner] == owner[inner + 1]]
            rank[at[at >= 0]] = NO_PIECE
            rank[inner], piece[inner] = self._pairs(symbols[inner], symbols[inner + 1])

        renew(np.arange(len(symbols)))
        while len(symbols):
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            best = np.minimum.reduceat(rank, starts)
            each = np.repeat(best, np.diff(np.append(starts, len(symbols))))
            # Units without a pair leave.
            done = each >= NO_PIECE
            if done.any():
                final.append((owner[done], symbols[done]))
                symbols, owner, rank, piece, each = symbols[~done], owner[~done], rank[~done], piece[~done], each[~done]
            hits = np.flatnonzero(rank == each)
            hits = hits[np.concatenate([[True], owner[hits[1:]] != owner[hits[:-1]]])] if len(hits) else hits
            symbols[hits] = piece[hits]
            stay = np.ones(len(symbols), bool)
            stay[hits + 1] = False
            hits -= np.arange(len(hits))  # so many symbols before have gone
            symbols, owner, rank, piece = symbols[stay], owner[stay], rank[stay], piece[stay]
            renew(hits)
            before = hits - 1
            before = before[before >= 0]
            renew(before[owner[before] == owner[before + 1]])
        if not final:
            return np.zeros(0, np.int64), np.zeros(len(units), np.int64)
        owners, values = (np.concatenate(x) for x in zip(*final, strict=True))
        return values[np.argsort(owners, kind="stable")], np.bincount(owners, minlength=len(units))

    def _long(self, unit: str) -> list[str]:
        ranks, n = self.ranks, len(unit)
        symbols: list[str | None] = list(unit)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(unit[i : i + 2])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, i, size = heapq.heappop(agenda)
            j = right[i]
            if symbols[i] is None or j >= n or len(symbols[i]) + len(symbols[j]) != size:
                continue
            joined = symbols[i] = symbols[i] + symbols[j]
            symbols[j] = None
            after, before = right[j], left[i]
            right[i] = after
            if after < n:
                left[after] = i
                if (r := ranks.get(joined + symbols[after])) is not None:
                    heapq.heappush(agenda, (r, i, size + len(symbols[after])))
            if before >= 0 and (r := ranks.get(symbols[before] + joined)) is not None:
                heapq.heappush(agenda, (r, before, size + len(symbols[before])))
        return [x for x in symbols if x is not None]

    def learn(self, units: list[str]) -> None:
        """Encode new units and hold them against the library, all in one call."""
        made = self.merge(units)
        # The library puts a blank of its own before each text, but for an empty one.
        texts = [(u[1:] if self.prefix else u).replace(BLANK, " ") for u in units]
        for unit, own, theirs in zip(units, made, self.library.encode(texts, num_threads=1), strict=True):
            theirs = theirs or [self.library.piece_to_id(BLANK)]
            if own != theirs:
                raise ValueError(f"the agenda and the library disagree on {unit!r}: {own} and {theirs}")
            self.known[unit] = np.array(own, "<u4").tobytes()

    def encode(self, texts: list[str], ends: bool = True) -> Iterator[bytes]:
        """The ids of each text as little-endian 32-bit numbers; ``ends`` puts the ids of begin and end around them."""
        split = [self.units(x) for x in self.library.normalize(texts)]
        every = set().union(*split)
        if len(self.known) + len(every) > KNOWN_UNITS:
            self.known.clear()
        self.learn([u for u in every if u not in self.known])
        first, last = self.around if ends else (b"", b"")
        for units in split:
            yield b"".join([first, *map(self.known.__getitem__, units), last])

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids in UTF-8: control ids say nothing, the blank before the first piece goes."""
        shown = np.flatnonzero(~self.control[ids])
        ids = ids[shown]
        parts = self.surface[ids].tolist()
        if len(parts) and self.prefix and self.normal[ids[0]] and parts[0].startswith(b" "):
            parts[0] = parts[0][1:]
        whole = b"".join(parts)
        if len(shown) and shown[-1] - shown[0] >= len(shown):  # control ids in between: bytes around one form no character
            return self._mended(ids, parts, shown)
        try:
            whole.decode()
        except UnicodeDecodeError:  # bytes that form no character
            whole = self._mended(ids, parts, shown)
        return whole

    def _mended(self, ids: np.ndarray, parts: list[bytes], shown: np.ndarray) -> bytes:
        is_byte, out, at = np.isin(ids, self.byte_ids), [], 0
        while at < len(parts):
            if not is_byte[at]:
                out.append(parts[at])
                at += 1
                continue
            next_to = shown[at : at + 4] - shown[at] == np.arange(len(shown[at : at + 4]))
            run = b"".join(parts[at : at + 4][: int(np.argmin(np.append(is_byte[at : at + 4] & next_to, False)))])
            for size in range(1, len(run) + 1):
                try:
                    out.append(run[:size].decode().encode())
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�".encode())
                size = 1
            at += size
        return b"".join(out)


def encode_pieces(
    docs: DataFrame,
    model_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    outputs: tuple[str, ...] = ("ids", "decoded"),
    ends: bool = True,
) -> DataFrame:
    """Encode whole texts and decode the ids again: ``id_col`` and the chosen ``outputs``.

    ``outputs`` may name ``ids``, ``decoded``, ``n_tokens``, ``ids_sha256`` (of the ids as
    little-endian 32-bit numbers) and ``decoded_sha256`` (of UTF-8). ``ends`` puts the ids of begin
    and end around each text.

    Null and empty texts have the two ids of begin and end alone and decode to the empty text. Null
    ids, repeated rows and ties pass through, one row for each row. Texts of any length are encoded
    whole. An empty table gives an empty result; other columns are ignored, whatever their names.
    Nothing is exchanged: a worker's memory is bounded by the units it remembers and some texts.
    """

    def made(coder: PieceAgenda, name: str, packed: bytes):
        if name == "n_tokens":
            return len(packed) // 4
        if name == "ids_sha256":
            return hashlib.sha256(packed).hexdigest()
        ids = np.frombuffer(packed, "<u4")
        if name == "ids":
            return ids.astype(np.int32)
        whole = coder.decode(ids)
        return whole.decode() if name == "decoded" else hashlib.sha256(whole).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = PieceAgenda.load(model_path)
        for batch in batches:
            texts, size, at = [], 0, 0
            for to, text in enumerate(batch.column(1), 1):
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if size >= BATCH_CHARS or to == batch.num_rows:
                    rows = [[made(coder, name, x) for name in outputs] for x in coder.encode(texts, ends)]
                    columns = [pa.array([r[i] for r in rows], _ARROW[name]) for i, name in enumerate(outputs)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), *columns], ["id", *outputs])
                    texts, size, at = [], 0, to

    schema = "id long, " + ", ".join(f"{name} {OUTPUTS[name]}" for name in outputs)
    return text_rows(docs, text_col, id=id_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)
