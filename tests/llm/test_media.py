import hashlib
import io
import wave
import zlib

import numpy as np

from strideframe.llm.media import FRAME, framed, peak_pairs, read_wav, text_as_audio, to_payload, write_wav
from strideframe.llm.queries import op5_wav_peaks


def check(docs, out):
    want = {}
    for r in docs.select("doc_id", "text").collect():
        data = (r.text or "").encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        want.setdefault(r.doc_id, (len(data), payload))
    rows = out.collect()
    assert len(rows) == docs.count()
    for r in rows:
        n, payload = want[r.doc_id]
        assert (r.n_bytes, r.payload_bytes) == (n, len(payload)) and len(payload) % 64 == 0 and payload
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
        assert r.media_bytes == len(write_wav(payload)) and r.media_sha256 == hashlib.sha256(write_wav(payload)).hexdigest()
    return rows


def test_odd_rows(odd_docs):
    outputs = ("media", "peaks", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    rows = check(odd_docs, text_as_audio(odd_docs, outputs=outputs))
    for r in rows:
        with wave.open(io.BytesIO(bytes(r.media))) as f:
            assert (f.getsampwidth(), f.getnchannels()) == (1, 1)
        assert r.feature == " ".join(f"{p.t:x}:{p.hash:x}" for p in r.peaks)
    assert len({(r.feature, r.media_sha256) for r in rows if r.doc_id in (1, 2, 12)}) == 1


def test_query(spark, sf_dir):
    rows = check(spark.read.parquet(f"{sf_dir}/documents.parquet"), op5_wav_peaks(spark, sf_dir))
    assert sum(bool(r.feature) for r in rows) > 0.9 * len(rows)


def test_round_trip_and_tone():
    payload = to_payload(bytes(range(256)) * 3)
    assert read_wav(write_wav(payload)) == payload
    tone = (128 + 100 * np.sin(2 * np.pi * 40 / 512 * np.arange(8192))).astype(np.uint8).tobytes()
    time, code = peak_pairs(tone)
    assert len(time) and ((code >> 16 == 40) | ((code >> 4 & 0xFFF) == 40)).mean() > 0.5
    assert (np.diff(time) >= 0).all()


def test_empty_table(no_docs):
    assert text_as_audio(no_docs).count() == 0


def test_every_byte_reaches_the_transform():
    rng = np.random.default_rng(1)
    for size in (64, 448, 512, 576, 704, 768, 832, 2048, 2112):
        data = rng.integers(32, 127, size, dtype=np.uint8)
        for at in (0, size // 2, size - 1):
            one = np.zeros(size, np.uint8)
            one[at] = 100
            weight = ((framed((data + one).tobytes()).astype(float) - framed(data.tobytes())) * np.hanning(FRAME)).sum()
            assert 95 < weight < 105
        changed = data.copy()
        changed[-64:] = 128 + 90 * np.sin(2 * np.pi * np.arange(64) / 5)
        features = [[x.tolist() for x in peak_pairs(d.tobytes())] for d in (data, changed)]
        assert features[0] != features[1], size


def test_targets_lie_in_several_frames():
    noise = np.random.default_rng(2).integers(0, 256, 8192, dtype=np.uint8).tobytes()
    time, code = peak_pairs(noise)
    assert set((code & 15).tolist()) == {0, 1, 2, 3}
    assert np.bincount(time[code & 15 == 0]).min() == 3


def plain_feature(payload):
    """The peak pairs by a transform written out as sums, frame by frame, and pairs written out as loops."""
    n = 512
    quiet = [128] * 256
    x = quiet + list(payload) + quiet + [128] * (-len(payload) % 256)
    window = [0.5 - 0.5 * np.cos(2 * np.pi * i / (n - 1)) for i in range(n)]
    angle = 2 * np.pi * np.outer(np.arange(n // 2 + 1), np.arange(n)) / n
    cosines, sines = np.cos(angle), np.sin(angle)
    peaks = []
    for at in range(0, len(x) - n + 1, 256):
        frame = np.array([(x[at + i] - 128) * window[i] for i in range(n)])
        power = np.sqrt((cosines @ frame) ** 2 + (sines @ frame) ** 2)
        local = [(power[k], k) for k in range(1, n // 2) if power[k] > power[k - 1] and power[k] >= power[k + 1] and power[k] > 1e-6]
        peaks.append([k for _, k in sorted(sorted(local, reverse=True)[:3], key=lambda p: p[1])])
    pairs = []
    for t, own in enumerate(peaks):
        pairs += [(t, a << 16 | b << 4) for i, a in enumerate(own) for b in own[i + 1 :]]
        for gap in (1, 2, 3):
            if t + gap < len(peaks):
                pairs += [(t, a << 16 | b << 4 | gap) for a in own for b in peaks[t + gap]]
    return sorted(pairs)


def test_feature_against_a_plain_transform(spark, sf_dir):
    """Whole documents of all kinds: the stored feature is that of sums written out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in op5_wav_peaks(spark, sf_dir).collect()}
    seen = 0
    for r in docs.orderBy("doc_id").collect():
        payload = to_payload((r.text or "").encode())
        if len(payload) > 6000:
            continue
        want = plain_feature(payload)
        assert got[r.doc_id].feature == " ".join(f"{t:x}:{h:x}" for t, h in want)
        seen += 1
    assert seen > 60


def test_feature_of_short_and_flat_payloads():
    rng = np.random.default_rng(4)
    for payload in (to_payload(b""), to_payload(b"a" * 1000), to_payload(b"ab" * 700), rng.integers(32, 127, 640, dtype=np.uint8).tobytes(), rng.integers(0, 256, 64, dtype=np.uint8).tobytes()):
        time, code = peak_pairs(payload)
        assert sorted(zip(time.tolist(), code.tolist(), strict=True)) == plain_feature(payload)
