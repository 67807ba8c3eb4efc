"""Clip archives (``.npz``) as Spark data sources: a reader that opens members, a writer that commits.

``npz_frames`` and ``npz_clips`` read all archives below a folder of any file system that pyarrow
knows by its address. A partition holds several archives, up to ``PARTITION_BYTES`` of them. Of an
archive its directory and the members behind the wanted columns are read: a schema without ``x``
reads no ``X``. ``npz_frames`` also writes: every task attempt fills a folder of its own below
``_temporary``, and the driver moves the folders of the attempts that count when all are done, one
move a task, so a task that is lost, retried or doubled leaves no trace and no half table is seen.
"""

from __future__ import annotations

import io
import json
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Bytes and number of the archives of a partition at most (a larger archive alone), and frames of a batch.
PARTITION_BYTES = 64_000_000
PARTITION_FILES = 512
BATCH_FRAMES = 2048
#: Columns of a frame and the members they come from; every archive has to have the needed ones.
MEMBERS = {"t_ms": "timestamps_ms", "x": "X", "mask": "mask", "x2048": "X2048"}
NEEDED = ("X", "mask", "timestamps_ms", "meta")
TYPES = {"t_ms": np.int64, "x": np.float32, "mask": np.bool_, "x2048": np.float32}
FRAMES = "clip_id string, frame_idx int, t_ms long, x array<float>, mask array<boolean>, x2048 array<float>"
CLIPS = "clip_id string, path string, meta string, n_frames int, has_x2048 boolean, bytes long, x_width int, mask_width int, x2048_width int, x_type string, mask_type string, t_type string, issue string"
UNREADABLE = (OSError, ValueError, EOFError, IndexError, KeyError, NotImplementedError, zipfile.BadZipFile, zlib.error)


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address and the path there; plain paths are local."""
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


@dataclass
class Archives(InputPartition):
    files: list[tuple[str, int]]


def _name(path: str) -> str:
    return path.rsplit("/", 1)[-1][: -len(".npz")]


def _header(archive: zipfile.ZipFile, member: str) -> tuple[tuple[int, ...], np.dtype]:
    """Shape and type of a member, without its data."""
    with archive.open(member + ".npy") as f:
        read = np.lib.format.read_array_header_1_0 if np.lib.format.read_magic(f) == (1, 0) else np.lib.format.read_array_header_2_0
        shape, _, kind = read(f)
        return shape, kind


def _array(archive: zipfile.ZipFile, member: str) -> np.ndarray:
    with archive.open(member + ".npy") as f:
        return np.lib.format.read_array(f, allow_pickle=False)


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.wanted, self.root = [f.name for f in schema], options["path"]

    def partitions(self) -> list[Archives]:
        system, root = place(self.root)
        found = system.get_file_info(fs.FileSelector(root, recursive=True)) if system.get_file_info(root).type == fs.FileType.Directory else [system.get_file_info(root)]
        # Folders that begin with _ belong to writers that have not committed.
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(".npz") and "/_" not in f.path.removeprefix(root))
        parts: list[Archives] = []
        held = PARTITION_BYTES
        for path, size in files:
            if held + size > PARTITION_BYTES or len(parts[-1].files) >= PARTITION_FILES:
                parts.append(Archives([]))
                held = 0
            parts[-1].files.append((path, size))
            held += size
        return parts or [Archives([])]


class _FramesReader(_Reader):
    def read(self, partition: Archives) -> Iterator[pa.RecordBatch]:
        system, _ = place(self.root)
        members = [c for c in self.wanted if c in MEMBERS]
        for path, _ in partition.files:
            try:
                with system.open_input_file(path) as f, zipfile.ZipFile(f) as archive:
                    names = {n.removesuffix(".npy") for n in archive.namelist()}
                    if any(n not in names for n in NEEDED):
                        continue
                    held = {c: _array(archive, MEMBERS[c]).astype(TYPES[c]) if MEMBERS[c] in names else None for c in members}
                    frames = min([len(a) for a in held.values() if a is not None], default=_header(archive, "timestamps_ms")[0][0])
            except UNREADABLE:
                continue
            for at in range(0, frames, BATCH_FRAMES):
                n = min(BATCH_FRAMES, frames - at)
                made = {"clip_id": lambda n=n, path=path: pa.array([_name(path)] * n), "frame_idx": lambda n=n, at=at: pa.array(np.arange(at, at + n, dtype=np.int32))}
                columns = [made[c]() if c in made else _column(c, held[c], at, n) for c in self.wanted]
                yield pa.RecordBatch.from_arrays(columns, self.wanted)


def _column(name: str, values: np.ndarray | None, at: int, n: int) -> pa.Array:
    kind = pa.from_numpy_dtype(np.dtype(TYPES[name]))
    if values is None:
        return pa.nulls(n, pa.list_(kind))
    part = values[at : at + n]
    if name == "t_ms":
        return pa.array(part, kind)
    width = part.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.array(part.reshape(-1), kind))


class _ClipsReader(_Reader):
    def read(self, partition: Archives) -> Iterator[tuple]:
        system, _ = place(self.root)
        for path, size in partition.files:
            row = dict.fromkeys(("meta", "x_type", "mask_type", "t_type", "issue")) | dict.fromkeys(("n_frames", "x_width", "mask_width", "x2048_width"), 0)
            row |= {"clip_id": _name(path), "path": path, "bytes": size}
            try:
                with system.open_input_file(path) as f, zipfile.ZipFile(f) as archive:
                    row |= self._described(archive)
            except UNREADABLE as e:
                row["issue"] = f"npz load error: {e}"
            row["has_x2048"] = row["x2048_width"] > 0
            yield tuple(row[c] for c in self.wanted)

    @staticmethod
    def _described(archive: zipfile.ZipFile) -> dict:
        names = {n.removesuffix(".npy") for n in archive.namelist()}
        missing = [k for k in NEEDED if k not in names]
        if missing:
            return {"issue": f"missing key: {missing[0]}"}
        if (torn := archive.testzip()) is not None:  # reads the members through, a piece at a time
            raise zipfile.BadZipFile(f"bad checksum of {torn}")
        (frames, width), x_type = _header(archive, "X")
        (_, mask_width), mask_type = _header(archive, "mask")
        out = {"n_frames": frames, "x_width": width, "mask_width": mask_width, "x_type": str(x_type), "mask_type": str(mask_type), "t_type": str(_header(archive, "timestamps_ms")[1])}
        out["meta"] = str(_array(archive, "meta")[()])
        return out | ({"x2048_width": _header(archive, "X2048")[0][1]} if "X2048" in names else {})


@dataclass
class _Done(WriterCommitMessage):
    folder: str | None


class _FramesWriter(DataSourceArrowWriter):
    """Writes the frames of a clip, which have to follow one another, to one archive."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.root, self.overwrite, self.job = options["path"].rstrip("/"), overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Done:
        system, root = place(self.root)
        folder = None
        held: list[pa.RecordBatch] = []

        def close() -> None:
            nonlocal folder
            if not held:
                return
            if folder is None:  # an attempt of its own, whatever else runs for the same rows
                folder = f"{root}/_temporary/{self.job}/part-{uuid.uuid4().hex}"
                system.create_dir(folder, recursive=True)
            clip = pa.Table.from_batches(held)
            held.clear()
            with system.open_output_stream(f"{folder}/{clip.column('clip_id')[0].as_py()}.npz") as f:
                f.write(packed(clip))

        for batch in iterator:
            ids = batch.column("clip_id").to_pylist()
            starts = [i for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1]]
            for a, b in zip(starts, [*starts[1:], len(ids)], strict=True):
                if held and held[-1].column("clip_id")[0].as_py() != ids[a]:
                    close()
                held.append(batch.slice(a, b - a))
        close()
        return _Done(folder)

    def commit(self, messages: list) -> None:
        system, root = place(self.root)
        system.create_dir(root, recursive=True)
        old = [f for f in system.get_file_info(fs.FileSelector(root)) if not f.base_name.startswith("_")] if self.overwrite else []
        for m in messages:
            if m is not None and m.folder:
                system.move(m.folder, f"{root}/{m.folder.rsplit('/', 1)[-1]}")
        for f in old:
            (system.delete_dir if f.type == fs.FileType.Directory else system.delete_file)(f.path)
        self._clear(system, root)
        with system.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages: list) -> None:
        self._clear(*place(self.root))

    def _clear(self, system: fs.FileSystem, root: str) -> None:
        folder = f"{root}/_temporary/{self.job}"
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)


def packed(clip: pa.Table) -> bytes:
    """One clip's archive; ``meta`` is JSON text, ``x2048`` is left out where a frame has none."""
    columns = {}
    for name, member in MEMBERS.items():
        if name in clip.column_names and not clip.column(name).null_count:
            column = clip.column(name).combine_chunks()
            flat = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if pa.types.is_list(column.type) else column.to_numpy()
            columns[member] = flat.astype(TYPES[name])
    columns["meta"] = np.array(json.dumps(json.loads((clip.column("meta")[0].as_py() if "meta" in clip.column_names else None) or "{}")))
    out = io.BytesIO()
    np.savez(out, **columns)
    return out.getvalue()


class NpzFrames(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npz_frames"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema: StructType) -> _FramesReader:
        return _FramesReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> _FramesWriter:
        return _FramesWriter(dict(self.options), overwrite)


class NpzClips(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npz_clips"

    def schema(self) -> str:
        return CLIPS

    def reader(self, schema: StructType) -> _ClipsReader:
        return _ClipsReader(schema, self.options)
