"""Audio columns: 8-bit WAV by the wave module, short-time Fourier transforms, peak-pair fingerprints.

A payload of bytes is stored as the samples of a mono WAV file and read back from it. The samples
go through a short-time Fourier transform; the strongest local maxima of each frame are its peaks;
pairs of a peak with the peaks of the next frames become hashes, stored with their frame numbers.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strideframe.llm._common import text_rows

RATE = 8000
UNIT = 64
FRAME = 512
HOP = 256
#: Strongest local maxima of a frame, and frames of the target zone of a peak.
PEAKS = 3
AHEAD = 3
#: Frames transformed at a time.
STEP = 4096

_WINDOW = np.hanning(FRAME)


def to_payload(data: bytes) -> bytes:
    """``data`` and zero bytes up to a positive multiple of ``UNIT``."""
    return data + bytes(max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def write_wav(payload: bytes) -> bytes:
    """A mono WAV file with one unsigned 8-bit sample for each byte."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(RATE)
        f.writeframes(payload)
    return out.getvalue()


def read_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as f:
        return f.readframes(f.getnframes())


def framed(samples: bytes) -> np.ndarray:
    """Frames [frame, sample] of a signal between a hop of silence before and one or more after it.

    Every sample lies in two frames, whose windows add up to about one, the first and last too.
    """
    x = np.frombuffer(samples, np.uint8)
    quiet = lambda n: np.full(n, 128, np.uint8)
    x = np.concatenate([quiet(HOP), x, quiet(HOP + -len(x) % HOP)])
    return np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]


def peak_pairs(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers and hashes of the peak pairs; a silent or flat signal has none."""
    frames = framed(samples)
    bins, heights = [], []
    for at in range(0, len(frames), STEP):
        power = np.abs(np.fft.rfft((frames[at : at + STEP].astype(np.float64) - 128.0) * _WINDOW, axis=1))
        middle = power[:, 1:-1]
        local = np.where((middle > power[:, :-2]) & (middle >= power[:, 2:]) & (middle > 1e-6), middle, 0.0)
        top = np.sort(np.argpartition(local, -PEAKS, axis=1)[:, -PEAKS:], axis=1)
        bins.append(top + 1)
        heights.append(np.take_along_axis(local, top, axis=1))
    peak, height = np.concatenate(bins), np.concatenate(heights)
    times, hashes = [], []
    # Two peaks of one frame are a pair as well, so that a single frame has a fingerprint.
    for a, b in combinations(range(PEAKS), 2):
        at = np.flatnonzero((height[:, a] > 0) & (height[:, b] > 0))
        times.append(at)
        hashes.append((peak[at, a] << 16) | (peak[at, b] << 4))
    for gap in range(1, AHEAD + 1):
        for a in range(PEAKS):
            for b in range(PEAKS):
                good = (height[:-gap, a] > 0) & (height[gap:, b] > 0)
                at = np.flatnonzero(good)
                times.append(at)
                hashes.append((peak[at, a] << 16) | (peak[at + gap, b] << 4) | gap)
    time, code = np.concatenate(times), np.concatenate(hashes)
    order = np.lexsort((code, time))
    return time[order].astype(np.int32), code[order].astype(np.int32)


OUTPUTS = {
    "media": ("binary", pa.binary()),
    "peaks": ("array<struct<t:int,hash:int>>", pa.list_(pa.struct([("t", pa.int32()), ("hash", pa.int32())]))),
    "n_bytes": ("long", pa.int64()),
    "payload_bytes": ("long", pa.int64()),
    "payload_sha256": ("string", pa.string()),
    "tail_crc32": ("long", pa.int64()),
    "media_bytes": ("long", pa.int64()),
    "media_sha256": ("string", pa.string()),
    "feature": ("string", pa.string()),
}


def text_as_audio(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("media", "peaks")) -> DataFrame:
    """Store each text as a WAV file and fingerprint what is read back.

    ``outputs`` may name ``media`` (the file), ``peaks`` (time-coded array of pair hashes), the
    lengths and digests of payload and file, and ``feature`` (the peaks as ``t:hash`` in hex,
    joined by blanks).

    Null and empty texts are a payload of zero bytes. Null ids and repeated rows pass through, one
    row for each row; equal texts give equal values. Texts of any length are stored whole, their
    frames transformed in blocks. An empty table gives an empty result. Other columns are ignored,
    whatever their names.
    """

    def values(text: str | None) -> dict:
        data = (text or "").encode("utf-8", "surrogatepass")
        stored = write_wav(to_payload(data))
        back = read_wav(stored)
        time, code = peak_pairs(back)
        pairs = list(zip(time.tolist(), code.tolist(), strict=True))
        return {
            "media": stored,
            "peaks": [{"t": t, "hash": h} for t, h in pairs] if "peaks" in outputs else None,
            "n_bytes": len(data),
            "payload_bytes": len(back),
            "payload_sha256": hashlib.sha256(back).hexdigest(),
            "tail_crc32": zlib.crc32(back[-UNIT:]),
            "media_bytes": len(stored),
            "media_sha256": hashlib.sha256(stored).hexdigest(),
            "feature": " ".join([f"{t:x}:{h:x}" for t, h in pairs]) if "feature" in outputs else None,
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                some = batch.slice(at, 128)
                made = [values(x.as_py()) for x in some.column(1)]
                yield pa.RecordBatch.from_arrays([some.column(0), *[pa.array([m[c] for m in made], OUTPUTS[c][1]) for c in outputs]], ["id", *outputs])

    rows = text_rows(docs, text_col, id=id_col)
    return rows.mapInArrow(run, "id long, " + ", ".join(f"{c} {OUTPUTS[c][0]}" for c in outputs)).withColumnRenamed("id", id_col)
